"""Phrase collocations by Toivonen's method: sample, one full pass with border, closing passes.

Words are what lies between spaces and tabs inside a piece, pieces what lies between
`[.,;:!?\\x0A-\\x0D]`. A phrase of k words can only be frequent if its first and its last
k - 1 words are. A sample of the documents proposes phrases at a lowered threshold. The
full pass counts all words and all phrases whose two parts are proposed: the proposals and
their negative border. Border phrases found frequent are failures; they admit phrases
nobody has counted yet, and passes over those alone follow until none fails. Each pass
settles at least one more length, so there are at most `longest` of them, and the sample
never changes the result.

These passes count by a phrase's hash of `hash_bits`. Phrases that share a hash count as one there,
which can only let a rare phrase through: a last pass counts what came through by its text,
exactly. Sets of phrases are bitmaps of a fixed size by hash, the only thing that is
broadcast or collected; a false hit there, too, only adds to what is counted. Each task
counts its texts in chunks of about CHUNK bytes, and Spark adds up the counts with map-side
combining, so that frequent phrases arrive as one row a task.

Defined cases: a null text is empty, a null lang is `und`; repeated rows count again; an
empty table gives no rows; a text over CHUNK is cut at piece ends. Other columns are left
behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import join_counted
from lexmere.operators.ranking import top_k
from lexmere.session import written

CHUNK = 2 << 20
BUCKET_BITS = 32_768  # of Spark's bitmap functions
COUNTS = "lang string, k int, phrase string, f long"
PIECE_END = re.compile(rb"[.,;:!?\n-\r]")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)  # 0 word, 1 space, 2 end of a piece
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


@dataclass(frozen=True)
class PhraseOptions:
    longest: int = 4
    min_count: int = 30
    share: float = 0.0625  # of the documents, for the sample
    bits: int = 27  # a bitmap has 2 ** bits
    hash_bits: int = 40
    covered_percent: int = 80
    top: int = 2000

    def sample_count(self) -> int:
        """Threshold of the sample: what a phrase of `min_count` is expected to show, 2 at least.

        Half of such phrases fail at the border. That costs passes over what they admit,
        which is little; a lower threshold would make the border of the full pass longer.
        """
        return max(2, round(self.min_count * self.share))


# ---- one chunk of one language ----


def _words(data: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Words of joined lower-case texts, and the number of the piece of each."""
    kind = KIND[data]
    inside = kind == 0
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])), piece


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chunk:
    """Phrases of some texts of one language: for each length, by position of the first word.

    `hashes[k - 1][i]` is the hash of the k words from word i, odd for the longest phrases
    alone, `whole[k - 1][i]` whether they lie in one piece.
    """

    def __init__(self, lang: str, texts: list[bytes], longest: int, hash_bits: int = 40) -> None:
        self.lang = lang
        # a piece end between two texts
        self.words, piece = _words(LOWER[np.frombuffer(b"\n".join(texts), np.uint8)])
        self.n = len(self.words)
        coded = self.words.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.kinds = max(1, len(coded.dictionary))
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
        word = known[self.ids] if self.n else np.zeros(0, np.uint64)
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
        self.hashes, self.whole = [_mixed(word + seed)], [np.ones(self.n, bool)]
        for k in range(2, longest + 1):
            m = max(0, self.n - k + 1)
            self.hashes.append(_mixed(self.hashes[-1][:m] * np.uint64(0x9E3779B97F4A7C15) + word[k - 1 :][:m]))
            self.whole.append(piece[:m] == piece[k - 1 :][:m])
        cut = np.uint64(64 - hash_bits)
        self.hashes = [(h >> cut) & ~np.uint64(1) | np.uint64(k == longest) for k, h in enumerate(self.hashes, 1)]

    def admitted(self, k: int, bitmap: np.ndarray) -> np.ndarray:
        """Which k-word phrases have both parts of k - 1 words in the bitmap."""
        if k == 1:
            return self.whole[0]
        in_set = in_bitmap(bitmap, self.hashes[k - 2])
        m = len(self.whole[k - 1])
        return self.whole[k - 1] & in_set[:m] & in_set[1 : m + 1]

    def counted(self, chosen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """COUNTS of the chosen phrases of each length."""
        needed = [c.copy() for c in chosen]
        for k in range(len(chosen) - 1, 0, -1):  # a phrase needs its beginning's number
            needed[k - 1][: len(needed[k])] |= needed[k]
        number = self.ids  # of the phrase that begins at each position
        for k, wanted in enumerate(chosen, 1):
            m = len(wanted)
            keys = number
            if k > 1:
                # numbers of the phrase's beginning and of its last word make one, exactly
                keys = number[:m] * self.kinds + self.ids[k - 1 :][:m]
                number = np.zeros(m, np.int64)
                _, number[needed[k - 1]] = np.unique(keys[needed[k - 1]], return_inverse=True)
                keys = number
            at = np.flatnonzero(wanted)
            _, first, f = np.unique(keys[at], return_index=True, return_counts=True)
            if not len(first):
                continue
            at = at[first]
            parts = [self.words.take(pa.array(at + i)) for i in range(k)]
            phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
            size = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.lang]).take(pa.array(np.zeros(size, np.int32))),
                    pa.array(np.full(size, k, np.int32)),
                    phrase,
                    pa.array(f.astype(np.int64)),
                ],
                names=["lang", "k", "phrase", "f"],
            )


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _cut(text: bytes) -> Iterator[bytes]:
    """The text in parts of about CHUNK bytes that end with a piece."""
    start = 0
    while len(text) - start > CHUNK:
        found = PIECE_END.search(text, start + CHUNK)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def _chunks(batches: Iterator[pa.RecordBatch], options: PhraseOptions) -> Iterator[Chunk]:
    """Texts collected by language; about CHUNK bytes each, twice that in all."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    some = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
    for batch in some:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for part in _cut(text):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 64
                full = [lang] if sizes[lang] >= CHUNK else list(held) if sum(sizes.values()) >= 2 * CHUNK else []
                for name in full:
                    sizes.pop(name)
                    yield Chunk(name, held.pop(name), options.longest, options.hash_bits)
    for name, texts in held.items():
        yield Chunk(name, texts, options.longest, options.hash_bits)


# ---- passes ----


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits with the bits of a `hash` column; built by Spark in buckets."""
    place = F.col("hash").bitwiseAND((1 << bits) - 1) + 1  # the functions count from 1
    parts = hashes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = BUCKET_BITS // 8
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")).toLocalIterator():
        out[(row["bucket"] - 1) * size : row["bucket"] * size] = np.frombuffer(row["bitmap"], np.uint8)
    return out


SHORTER = np.uint8(0x55)  # the even places: all phrases but the longest


def hash_counts(texts: DataFrame, proposed: np.ndarray | None, counted: np.ndarray | None, options: PhraseOptions) -> DataFrame:
    """(hash, f) of all phrases that `proposed` admits and `counted` did not.

    Without `proposed` all phrases but the longest count, without `counted` all words do.
    """
    lengths = options.longest + (proposed is not None)
    context = texts.sparkSession.sparkContext
    new = None if proposed is None else context.broadcast(proposed)
    old = None if counted is None else context.broadcast(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, options):
            for k in range(1, lengths):
                chosen = chunk.whole[k - 1] if new is None else chunk.admitted(k, new.value)
                if old is not None:
                    chosen = chosen & ~chunk.admitted(k, old.value)
                h, f = np.unique(chunk.hashes[k - 1][chosen], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.astype(np.int64))], ["hash", "f"])

    return texts.mapInArrow(run, "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f"))


def candidates(texts: DataFrame, options: PhraseOptions) -> np.ndarray:
    """Bitmap with the hashes of all frequent phrases, and few others."""
    sampled = hash_counts(texts.sample(options.share, seed=7), None, None, options)
    proposed = _bitmap(sampled.filter(F.col("f") >= options.sample_count()), options.bits) & SHORTER
    counted: np.ndarray | None = None
    frequent = np.zeros_like(proposed)
    while True:
        passed = hash_counts(texts, proposed, counted, options)
        bits = _bitmap(passed.filter(F.col("f") >= options.min_count), options.bits)
        frequent |= bits
        failed = bits & ~proposed & SHORTER
        if not failed.any():
            return frequent
        proposed, counted = proposed | failed, proposed


def frequent_phrases(docs: DataFrame, options: PhraseOptions = PhraseOptions(), *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, k, phrase, f) of all frequent phrases of up to `longest` words, exactly.

    A row of length 0 holds the number of words of its lang.
    """
    texts = _texts(docs, text, lang)
    frequent = texts.sparkSession.sparkContext.broadcast(candidates(texts, options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, options):
            total = zip([[chunk.lang], [0], [""], [chunk.n]], (pa.string(), pa.int32(), pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in total], ["lang", "k", "phrase", "f"])
            yield from chunk.counted([w & in_bitmap(frequent.value, h) for w, h in zip(chunk.whole, chunk.hashes)])

    summed = texts.mapInArrow(run, COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return written(summed.filter((F.col("f") >= options.min_count) | (F.col("k") == 0)), "phrase-counts")


# ---- collocations ----


def collocations(docs: DataFrame, options: PhraseOptions = PhraseOptions(), *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    a: occurrences; l and r: those of the two parts of the lowest-scoring cut; n: words of
    the language; score: floor(2,000,000 a / (l + r)) of that cut. A phrase that lies in a
    longer candidate with at least `covered_percent` of its occurrences is left out.
    """
    found = frequent_phrases(docs, options, text=text, lang=lang)
    table = found.filter("k > 0").select("lang", "phrase", F.col("k").cast("int").alias("k"), "f")
    total = table.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    several = table.filter("k > 1").withColumnRenamed("f", "a")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "*",
        F.expr("substring_index(phrase, ' ', cut)").alias("left"),
        F.expr("substring_index(phrase, ' ', cut - k)").alias("right"),
    )
    for side, count in (("left", "l"), ("right", "r")):
        parts = table.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cuts = join_counted(cuts, parts, ["lang", side], count, total)
    # exact: the product may pass 64 bits
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a")).alias("low"))
    scored = lowest.select("lang", "phrase", "low.a", "low.l", "low.r", "low.score")
    inner = F.expr(
        """array_distinct(flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1),
             i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))"""
    )
    covers = several.filter("k > 2").select("lang", F.col("a").alias("cover"), F.explode(inner).alias("phrase"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    share = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(cover AS DECIMAL(19, 0)) >= CAST({options.covered_percent} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))")
    kept = scored.join(covers, ["lang", "phrase"], "left").filter(~F.coalesce(share, F.lit(False))).drop("cover")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sizes = found.filter("k = 0").select("lang", F.col("f").alias("n"))
    return top_k(kept, ["lang"], order, options.top).join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
