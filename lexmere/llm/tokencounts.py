"""Exact token counts; huge documents are encoded as overlapping chunks and spliced.

A boundary between two characters is proven stable if no vocabulary piece holds the two
next to each other: no merge can cross it, so both sides encode alone as they do together.
Chunks of a huge document overlap. Each is encoded with offsets, and two neighbours are
spliced at the first boundary in their overlap that both encodings have and that is proven
stable. Where an overlap has none, that document is encoded again with chunks and overlaps
four times as long, until it is one chunk if need be. Counts add up: the tokens of the
last chunk, plus, for each splice, the tokens before it in the left chunk less those in
the right one. So a document's chunks lie in as many tasks as they like.

Texts up to one chunk are counted whole, each different space-separated part once.

Defined cases: a null text counts as empty, with no bytes and no tokens; repeated rows and
null ids are counted row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.units import MARK, unit_encoder
from lexmere.session import written

CHUNK = 16_384
OVERLAP = 256


def joined_pairs(pieces: list[str]) -> set[str]:
    """Every two characters that stand next to each other in some piece."""
    return {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}


def chunk_boundaries(model, pairs: set[str], text: str, start: int, head: int, tail: int) -> tuple[int, list, list]:
    """(tokens, head cuts, tail cuts) of one chunk that begins at `start` of its document.

    A cut is (offset in the document, tokens of the chunk before it); head cuts lie in the
    first `head` characters, tail cuts in the last `tail`.
    """
    offsets = model.encode(text, return_type="offset_mapping")["offsets"]
    n = len(offsets)
    marked = text.replace(" ", MARK)

    def cuts(tokens, low: int, high: int) -> list[tuple[int, int]]:
        found = []
        for k in tokens:
            at = offsets[k][0]
            if at < low:
                if k > n // 2:
                    break
                continue
            if at > high:
                if k <= n // 2:
                    break
                continue
            # byte tokens of one character share its place; the first one counts
            first_there = k == 0 or offsets[k - 1][0] < at
            if 0 < at < len(text) and first_there and marked[at - 1 : at + 1] not in pairs:
                found.append((start + at, k))
        return sorted(found)

    first = cuts(range(n), 1, head) if head else []
    last = cuts(range(n - 1, -1, -1), len(text) - tail, len(text) - 1) if tail else []
    return n, first, last


CUTS = "array<struct<at: long, before: long>>"


def _small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder("pieces", path)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts = [len(ids) // 4 for ids in encoder.encode(texts)]
            sizes = [len(t or b"") for t in texts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run


def _chunks(chunk: int, overlap: int):
    """(row, doc_id, n_bytes, chunk, last, text): overlapping chunks of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_bytes", "chunk", "last", "text"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                size = len(text.encode())
                n = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(n):
                    part = text[k * chunk :] if k == n - 1 else text[k * chunk : (k + 1) * chunk + overlap]
                    values = (row, doc_id, size, k, k == n - 1, part)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    return run


def _encode_chunks(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pairs = joined_pairs([model.id_to_piece(i) for i in range(model.get_piece_size())])
        kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for batch in batches:
            counts, heads, tails = [], [], []
            for k, last, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "last", "text"))):
                n, head, tail = chunk_boundaries(
                    model, pairs, text, k * chunk, overlap if k else 0, 0 if last else overlap
                )
                counts.append(n)
                heads.append([{"at": a, "before": b} for a, b in head])
                tails.append([{"at": a, "before": b} for a, b in tail])
            columns = [batch.column(c) for c in ("row", "doc_id", "n_bytes", "chunk", "last")]
            columns += [pa.array(counts, pa.int64()), pa.array(heads, kind), pa.array(tails, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "chunk", "last", "n", "head", "tail"])

    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens): n_tokens is null where a splice found no place."""
    right = chunks.filter("chunk > 0").select("row", (F.col("chunk") - 1).alias("chunk"), "head")
    pairs = chunks.join(right.withColumnRenamed("head", "right"), ["row", "chunk"], "left")
    common = F.expr(
        """get(filter(transform(tail, t -> t.before - map_from_entries(transform(right, h -> struct(h.at, h.before)))[t.at]),
                      d -> d IS NOT NULL), 0)"""
    )
    part = F.when(F.col("last"), F.col("n")).otherwise(common)
    return pairs.withColumn("part", part).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_bytes").alias("n_bytes"),
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"),
    )


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the sentencepiece model at `path` counts."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is longer than 0 and at most a chunk")
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    huge = F.char_length("text") > chunk + overlap
    out = picked.filter(~huge).mapInArrow(_small(path), "doc_id long, n_bytes long, n_tokens long")
    rest = picked.filter(huge).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rest = written(rest, "huge-texts")
    while not rest.isEmpty():
        cut = rest.mapInArrow(_chunks(chunk, overlap), "row long, doc_id long, n_bytes long, chunk long, last boolean, text string")
        dealt = cut.repartition(F.col("row"), F.col("chunk"))
        encoded = dealt.mapInArrow(
            _encode_chunks(path, chunk, overlap),
            f"row long, doc_id long, n_bytes long, chunk long, last boolean, n long, head {CUTS}, tail {CUTS}",
        )
        counted = written(_spliced(written(encoded, "token-chunks")), "token-counts")
        out = out.unionByName(counted.filter("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens"))
        failed = counted.filter("n_tokens IS NULL").select("row")
        rest = written(rest.join(failed, "row", "left_semi"), "huge-texts")
        chunk, overlap = 4 * chunk, 4 * overlap
    return out
