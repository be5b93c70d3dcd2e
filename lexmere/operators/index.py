"""The lexical index: texts become terms once, and every search uses that.

Building counts the corpus statistics and writes a forward index, one row of counted terms
per chunk. Searches, vector lengths and the saved index read the forward index; no text is
split by them. For one batch of BM25 questions the forward index costs more than it saves:
without it, the texts are counted once more for the terms that are asked. The saved index holds postings in blocks: all postings of
one term in one range of chunks, with the largest count among them. A posting is a chunk's
number and a count; the rest of a chunk is kept once, in `facts`, and the smallest length of a
range once, in `lengths`. Chunks are numbered by length, so those of a range are about as long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmere.operators.counting import asked_rows, posting_lists, text_stats
from lexmere.operators.packed import dealt, grouped, groups_of, sliced, term_hashes
from lexmere.operators.terms import TermOptions, array_rows, smooth_idf, term_arrays
from lexmere.session import BROADCAST_ROWS, at_most, join_probe, small, spread, written

POSTING_BUCKETS = 256
CHUNK_FOLDERS = 64
PUSHED = 2000
ASKED_TERMS = 100_000  # terms that go to every task as a list
RANGE_CHUNKS = 128  # chunks of a range, on average
BUCKET_POSTINGS = 2_000_000  # postings that are merged together, on average
POSTING_BYTES = 5  # of text, for each posting: a guess that decides how many tasks merge them
BLOCKS = "term string, range long, df int, cf long, max_tf int, n int, docs array<struct<doc:long,tf:int>>, bucket int"
FORMAT = 6
KEY_END = "\x1f"  # ends the chunk id inside an internal key


@dataclass(frozen=True)
class LexicalIndex:
    """Chunks plus term statistics over all of them (topic never narrows these).

    chunks: (chunk_id, text, topic array<string>, ...), skipped chunks already out.
    stats: (term, df, cf, only_doc) for every term, a written table; None in an index that is
    only built to be saved.
    The scalars come from one aggregate over `stats`.
    texts: (chunk_id, doc, topic, text), a written table, `doc` a number that tells chunks apart.
    forward: (chunk_id, doc, topic, n_terms, counts), a written table, or None where the index
    was built without it; a saved index has `postings`, `facts` (chunk_id, doc, topic, dl,
    norm) and `lengths` (range, min_dl) in its place.
    """

    chunks: DataFrame
    options: TermOptions
    stats: DataFrame | None
    n_docs: int
    kept_tokens: int
    n_vocabulary: int
    n_postings: int
    n_too_common: int
    texts: DataFrame | None = None
    forward: DataFrame | None = None
    once: DataFrame | None = None  # (chunk_id, lost) where `stats` has no only_doc
    postings: DataFrame | None = None
    facts: DataFrame | None = None
    lengths: DataFrame | None = None
    buckets: int = 0
    range_chunks: int = RANGE_CHUNKS
    narrow: bool = False  # `forward` holds some chunks only, see `narrowed`

    @property
    def avgdl(self) -> float:
        return self.kept_tokens / self.n_docs if self.n_docs else 0.0

    @property
    def df_bounds(self) -> tuple[float, float]:
        return self.options.df_bounds(self.n_docs)

    def vocabulary(self) -> DataFrame:
        """(term, df, cf) within the document-frequency bounds."""
        low, high = self.df_bounds
        return self.stats.filter((F.col("df") >= low) & (F.col("df") <= high)).select(
            "term", "df", "cf"
        )

    def too_common(self) -> DataFrame:
        """(term, df) above max_df: at most (postings per document) / max_df terms."""
        return self.stats.filter(F.col("df") > self.df_bounds[1]).select("term", "df")

    def head_floor(self) -> float:
        """Document frequency above which fewer than BROADCAST_ROWS terms can lie."""
        if self.n_vocabulary <= BROADCAST_ROWS:
            return 0.0
        return self.n_postings / BROADCAST_ROWS

    def term_arrays(self) -> DataFrame:
        """(chunk_id, topic, n_terms, counts) for every chunk; `doc` too in a built index."""
        if self.forward is not None:
            return self.forward
        if self.texts is not None:
            return term_arrays(self.texts, "text", self.options, [c for c in self.texts.columns if c != "text"])
        return term_arrays(self.chunks, "text", self.options, ["chunk_id", "topic"])

    def term_rows(self) -> DataFrame:
        """(chunk_id, topic, n_terms, term, tf) for every chunk."""
        return array_rows(self.term_arrays())

    def asked_rows(self, wanted: DataFrame, fits: bool) -> DataFrame:
        """The term rows of the wanted terms only.

        Without a forward index the texts are counted for up to ASKED_TERMS terms, which go
        to the tasks as a list.
        """
        if self.forward is None and self.texts is not None:
            listed = [r["term"] for r in wanted.select("term").limit(ASKED_TERMS + 1).collect()]
            if len(listed) <= ASKED_TERMS:
                return asked_rows(self.texts, "text", self.options, [c for c in self.texts.columns if c != "text"], listed)
        return join_probe(self.term_rows(), wanted.select("term"), "term", fits, by="chunk_id")

    def stored_blocks(self, wanted: DataFrame, fits: bool) -> DataFrame:
        """Saved blocks of the wanted terms, with the other columns of `wanted`.

        Up to PUSHED terms go into the scan as a list, with their folders, so that only
        matching row groups are read. More are broadcast with their folder. A probe too
        large for that asks for all folders anyway and is joined salted by range.
        """
        if not fits:
            return join_probe(self.postings.drop("bucket"), wanted, "term", False, "range")
        keyed = written(_with_bucket(wanted, self.buckets), "keyed-terms")
        listed = keyed.select("bucket", "term").limit(PUSHED + 1).collect()
        postings = self.postings
        if len(listed) <= PUSHED:
            postings = postings.filter(
                F.col("bucket").isin(sorted({r["bucket"] for r in listed})) & F.col("term").isin([r["term"] for r in listed])
            )
        return postings.join(F.broadcast(keyed), ["bucket", "term"]).drop("bucket")

    def stored_rows(self, wanted: DataFrame, fits: bool) -> DataFrame:
        """(term, doc, chunk_id, topic, dl, norm, tf): saved postings of the wanted terms."""
        return self.with_facts(self.stored_blocks(wanted, fits).select("term", F.inline("docs")))

    def with_facts(self, rows: DataFrame) -> DataFrame:
        """Saved posting rows with (chunk_id, topic, dl, norm) of `doc`."""
        return rows.join(small(self.facts, self.n_docs <= BROADCAST_ROWS), "doc")

    def _tail_rows(self, above: float) -> DataFrame:
        """Term rows without the terms of a document frequency over `above` and the head's:
        fewer than BROADCAST_ROWS terms, taken out before anything is shuffled by term."""
        floor = max(above, self.n_postings / BROADCAST_ROWS)
        head = self.stats.filter(F.col("df") > floor).select("term")
        return self.term_rows().join(F.broadcast(head), "term", "left_anti")

    def _lost_once(self) -> DataFrame:
        """(chunk_id, lost): tokens of each chunk whose term no other chunk holds."""
        if self.once is not None:
            return self.once
        once = self.stats.filter("df = 1").groupBy(F.col("only_doc").alias("doc")).agg(F.sum("cf").alias("lost"))
        named = self.texts if self.forward is None else self.forward
        return named.select("doc", "chunk_id").join(once, "doc").select("chunk_id", "lost")

    def dropped_tokens(self) -> DataFrame:
        """(chunk_id, lost): tokens of each chunk whose term is not in the vocabulary.

        A term seen in one chunk names that chunk itself, so the usual min_df of 2 is
        corrected from the statistics alone. Rarer settings and too common terms, if
        there are any, go through the term rows.
        """
        low = self.df_bounds[0]
        row_lost = F.col("tf").cast("long").alias("lost")
        lost = self._lost_once().filter(F.lit(1) < low)
        if low > 2:
            rare = self.stats.filter((F.col("df") > 1) & (F.col("df") < low)).select("term")
            more = self._tail_rows(low).join(rare.hint("merge"), "term")
            lost = lost.unionByName(more.select("chunk_id", row_lost))
        if self.n_too_common:
            common = self.too_common().filter((F.col("df") > 1) | (F.lit(1) >= low)).select("term")
            more = self.asked_rows(common, self.n_too_common <= BROADCAST_ROWS)
            lost = lost.unionByName(more.select("chunk_id", row_lost))
        return lost.groupBy("chunk_id").agg(F.sum("lost").alias("lost"))

    def chunk_lengths(self) -> DataFrame:
        """(chunk_id, dl): vocabulary tokens of every chunk, 0 included."""
        return (
            self.term_arrays()
            .select("chunk_id", "n_terms")
            .join(self.dropped_tokens(), "chunk_id", "left")
            .select(
                "chunk_id",
                (F.col("n_terms") - F.coalesce("lost", F.lit(0))).cast("long").alias("dl"),
            )
        )

    def chunk_facts(self) -> DataFrame:
        """(chunk_id, dl, norm) of every chunk with a vocabulary term: its tokens, and the
        L2 length of its tf * idf vector. One reading of the forward index.

        Terms frequent enough to be few are broadcast and summed up per chunk where they
        are read. A posting of the tail goes to its term, where the length of the list is
        the document frequency and gives the square; the tail's lists are at most
        `head_floor` long. Both kinds share one shuffle.
        """
        low, high = self.df_bounds
        floor = self.head_floor()
        kept = (F.col("df") >= low) & (F.col("df") <= high)
        head = self.stats.select("term", "df").filter(F.col("df") > floor)
        if floor == 0:
            head = head.filter(kept)
        rows = self.term_rows().select("chunk_id", "term", "tf").join(F.broadcast(head), "term", "left")
        square = F.pow(F.col("tf") * smooth_idf(F.col("df"), self.n_docs), 2)
        sums = [F.sum(F.when(kept, square)).alias("square"), F.sum(F.when(kept, F.col("tf"))).cast("long").alias("dl")]
        if floor > 0:
            tail = F.col("df").isNull()
            key = F.when(tail, F.concat(F.lit("t"), "term")).otherwise(F.concat(F.lit("c"), "chunk_id"))
            posting = F.when(tail, F.struct("chunk_id", "tf"))
            met = rows.groupBy(key.alias("key")).agg(*sums, F.collect_list(posting).alias("tail"))
            df = F.size("tail")
            squares = F.transform(
                "tail",
                lambda p: F.struct(
                    p["chunk_id"].alias("chunk_id"),
                    F.pow(p["tf"] * smooth_idf(df, self.n_docs), 2).alias("square"),
                    p["tf"].cast("long").alias("dl"),
                ),
            )
            summed = F.array(F.struct(F.expr("substring(key, 2)").alias("chunk_id"), "square", "dl"))
            out = F.when(F.col("key").startswith("c"), summed).when((df >= low) & (df <= high), squares)
            rows = met.select(F.inline(out))
            sums = [F.sum("square").alias("square"), F.sum("dl").alias("dl")]
        facts = rows.groupBy("chunk_id").agg(*sums).filter(F.col("square").isNotNull())
        return facts.select("chunk_id", "dl", F.sqrt("square").alias("norm"))

    def norm_bounds(self) -> DataFrame:
        """(doc, low, high): bounds of every chunk's L2 length, without moving a posting.

        Frequent terms are broadcast, so their squares are exact. A tail term's document
        frequency lies between the least one of the vocabulary and `head_floor`, which bounds
        its idf on both sides. Terms of one document are taken out by the statistics, if those
        name the document; otherwise the lower bound leaves the whole tail out.
        """
        low, high = self.df_bounds
        floor = self.head_floor()
        kept = (F.col("df") >= low) & (F.col("df") <= high)
        head = self.stats.filter(F.col("df") > floor).select("term", "df")
        rows = self.term_rows().select("doc", "term", "tf").join(F.broadcast(head), "term", "left")
        square = F.pow(F.col("tf") * smooth_idf(F.col("df"), self.n_docs), 2)
        own = F.pow("tf", 2)
        sums = rows.groupBy("doc").agg(
            F.coalesce(F.sum(F.when(kept, square)), F.lit(0.0)).alias("head"),
            F.coalesce(F.sum(F.when(F.col("df").isNull(), own)), F.lit(0.0)).alias("tail"),
        )
        tail, sure = F.col("tail"), F.lit(0.0)
        if low <= 1 and floor <= high:
            sure = tail
        elif low <= 2 and floor <= high and "only_doc" in self.stats.columns:
            once = self.stats.filter("df = 1").groupBy(F.col("only_doc").alias("doc")).agg(F.sum(F.pow("cf", 2)).alias("lost"))
            sums = sums.join(once, "doc", "left")
            tail = sure = F.col("tail") - F.coalesce("lost", F.lit(0.0))
        least = F.pow(smooth_idf(F.lit(float(floor)), self.n_docs), 2)
        most = F.pow(smooth_idf(F.lit(float(max(low, 1))), self.n_docs), 2)
        return sums.select("doc", F.sqrt(F.col("head") + sure * least).alias("low"), F.sqrt(F.col("head") + tail * most).alias("high"))

    def narrowed(self, docs: DataFrame) -> LexicalIndex:
        """The index with only the chunks that `docs` (doc), a written table, names; the
        statistics are still those of all chunks."""
        forward = self.forward.join(small(docs, at_most(docs)), "doc", "left_semi")
        return replace(self, forward=written(forward, "narrowed-index", "zstd"), narrow=True)

    def held_facts(self) -> DataFrame:
        """`chunk_facts` of a narrowed index: its terms are looked up in the statistics."""
        terms = written(self.term_rows().select("term").distinct(), "held-terms", "zstd")
        vocabulary = self.vocabulary().select("term", "df").join(small(terms, at_most(terms)), "term", "left_semi")
        df = written(vocabulary, "held-frequencies", "zstd")
        rows = self.term_rows().select("chunk_id", "term", "tf").join(small(df, at_most(df)), "term")
        square = F.pow(F.col("tf") * smooth_idf(F.col("df"), self.n_docs), 2)
        return rows.groupBy("chunk_id").agg(F.sum("tf").cast("long").alias("dl"), F.sqrt(F.sum(square)).alias("norm"))


def public_id(key: str = "chunk_id") -> Column:
    """The chunk id inside an internal key."""
    return F.substring_index(F.col(key), KEY_END, 1)


def _repeated(chunks: DataFrame) -> DataFrame | None:
    """The chunk ids that occur more than once, a written table; None if there are none."""
    ids = written(chunks.groupBy("chunk_id").count().filter("count > 1").select(F.col("chunk_id").alias("_id")), "repeated-ids")
    return None if ids.isEmpty() else ids


def _lengthened(chunks: DataFrame, ids: DataFrame, by: Column) -> DataFrame:
    """`chunks` with KEY_END and `by` behind every chunk_id in `ids`."""
    marked = chunks.join(small(ids, at_most(ids)), F.col("chunk_id") == F.col("_id"), "left")
    longer = F.when(F.col("_id").isNotNull(), F.concat("chunk_id", F.lit(KEY_END), by)).otherwise(F.col("chunk_id"))
    return marked.select(*(longer.alias(c) if c == "chunk_id" else F.col(c) for c in chunks.columns))


def _keyed(chunks: DataFrame) -> DataFrame:
    """Chunks whose chunk_id is a key: a repeated id is lengthened by what else describes
    its row, and, where that repeats too, by its text's hash and a number among equal rows.
    Chunks that were changed are a written table: building and payload read them."""
    ids = _repeated(chunks)
    if ids is None:
        return chunks
    others = [c for c in chunks.columns if c not in ("chunk_id", "text")]
    keyed = written(_lengthened(chunks, ids, F.to_json(F.struct(*others)) if others else F.lit("")), "keyed-chunks")
    ids = _repeated(keyed)
    if ids is None:
        return keyed
    # rows of one key and text are equal in all columns: any order gives the same numbers
    numbered = keyed.join(small(ids, at_most(ids)), F.col("chunk_id") == F.col("_id"), "left_semi").withColumn(
        "_n", F.row_number().over(Window.partitionBy("chunk_id", "text").orderBy(F.lit(0)))
    )
    longer = F.concat("chunk_id", F.lit(KEY_END), F.hex(F.xxhash64("text")), F.lit("#"), "_n")
    rest = keyed.join(small(ids, at_most(ids)), F.col("chunk_id") == F.col("_id"), "left_anti")
    longer_rows = numbered.select(*(longer.alias(c) if c == "chunk_id" else F.col(c) for c in keyed.columns))
    return written(rest.unionByName(longer_rows), "numbered-chunks")


def _numbered(chunks: DataFrame, by_length: bool = False) -> DataFrame:
    """(chunk_id, topic, doc, text), a written table. Statistics name documents by the number,
    since Spark sorts all rows to aggregate a string and only hashes them for a number."""
    keep = [c for c in ("chunk_id", "topic") if c in chunks.columns]
    rows = spread(chunks, "chunk_id")
    if by_length:
        rows = rows.sortWithinPartitions(F.length("text"))
    return written(rows.select(*keep, F.monotonically_increasing_id().alias("doc"), "text"), "numbered-texts", "zstd")


def build_index(chunks: DataFrame, options: TermOptions = TermOptions(), forward: bool = True, counted: bool = True) -> LexicalIndex:
    """Index `chunks` (chunk_id, text, topic, ...): statistics take one shuffle.

    `chunks` is read again for payload, so it should be a stored table. Chunk ids may
    repeat (files of one name in two folders): chunks are told apart by an internal key.
    `forward=False` is meant for one batch of BM25 questions; every search works without
    a forward index, but each then counts texts again. `counted=False` is for saving only:
    the texts are numbered, and `save_index` counts them.
    """
    n_docs = chunks.count()
    chunks = _keyed(chunks)
    if not counted:
        return LexicalIndex(chunks, options, None, n_docs, 0, 0, 0, 0, texts=_numbered(chunks, by_length=True))
    texts = _numbered(chunks)
    stats = written(text_stats(texts, "text", options), "term-stats", "zstd")
    index = replace(measured(chunks, n_docs, options, stats), texts=texts)
    return replace(index, forward=written(index.term_arrays(), "forward-index")) if forward else index


def measured(
    chunks: DataFrame, n_docs: int, options: TermOptions, stats: DataFrame
) -> LexicalIndex:
    """An index with the scalars that follow from its statistics."""
    low, high = options.df_bounds(n_docs)
    kept = (F.col("df") >= low) & (F.col("df") <= high)
    row = stats.agg(
        F.sum(F.when(kept, F.col("cf"))).alias("tokens"),
        F.count_if(kept).alias("terms"),
        F.sum("df").alias("postings"),
        F.count_if(F.col("df") > high).alias("common"),
    ).first()
    return LexicalIndex(
        chunks=chunks,
        options=options,
        stats=stats,
        n_docs=n_docs,
        kept_tokens=row["tokens"] or 0,
        n_vocabulary=row["terms"] or 0,
        n_postings=row["postings"] or 0,
        n_too_common=row["common"] or 0,
    )


def _with_bucket(terms: DataFrame, buckets: int) -> DataFrame:
    """`terms` with the folder of each term's postings."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = groups_of(term_hashes(batch["term"].to_pylist()), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "bucket"])

    return terms.mapInArrow(add, StructType([*terms.schema.fields]).add("bucket", "integer"))


def _folder(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CHUNK_FOLDERS)).cast("int")


def with_chunks(chunks: DataFrame, ranked: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`ranked`, a written table, with `columns` of the chunks that `key` names.

    The ids are broadcast and no text is shuffled. Chunks of a saved index lie in folders by
    key: up to PUSHED ids go into the scan with their folders; more are joined on folder and
    key, which prunes the folders at run time. Ids too many for one broadcast are joined in
    groups of folders, each group against its own ids.
    """
    n = ranked.count()
    payload = chunks.select(F.col("chunk_id").alias(key), *columns)
    if "folder" not in chunks.columns:
        return payload.join(small(ranked, n <= BROADCAST_ROWS), key)
    payload = chunks.select(F.col("chunk_id").alias(key), "folder", *columns)
    # the test of the rank holds for all rows; the planner prunes folders only by a filtered side
    asked = ranked.filter(F.col("rank") > 0).withColumn("folder", _folder(key))
    if n <= PUSHED:
        wanted = asked.select(key, "folder").distinct().collect()
        listed = F.col("folder").isin(sorted({r["folder"] for r in wanted})) & F.col(key).isin([r[key] for r in wanted])
        return payload.filter(listed).join(F.broadcast(asked), ["folder", key]).drop("folder")
    groups = min(CHUNK_FOLDERS, -(-n * 2 // BROADCAST_ROWS))  # hashed: half full on average
    parts = []
    for group in range(groups):
        mine = F.pmod("folder", F.lit(groups)) == group
        ids = asked.filter(mine)
        parts.append(payload.filter(mine).join(small(ids, groups == 1 or at_most(ids, BROADCAST_ROWS)), ["folder", key]))
    return reduce(DataFrame.unionByName, parts).drop("folder")


def _merged_blocks(packed: DataFrame, tasks: int, parts: int, range_chunks: int) -> DataFrame:
    """Rows of BLOCKS from packed lists; a folder's terms lie in `parts` groups."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, lists in grouped(batches):
            coded = pa.concat_arrays([t["term"] for _, t in lists]).dictionary_encode()
            sorted_ = np.asarray(pc.sort_indices(coded.dictionary)).astype(np.int64)
            rank = np.empty(len(sorted_), np.int64)
            rank[sorted_] = np.arange(len(sorted_))
            held = [t["held"] for _, t in lists]
            n = np.concatenate([pc.list_value_length(h).to_numpy() for h in held])
            code = np.repeat(rank[coded.indices.to_numpy()], n)
            doc = np.concatenate([base + h.flatten().field("at").to_numpy() for (base, _), h in zip(lists, held)])
            tf = np.concatenate([h.flatten().field("tf").to_numpy() for h in held])
            order = np.lexsort((doc, code))
            code, doc, tf = code[order], doc[order], tf[order]
            range_ = doc // range_chunks
            first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(range_, prepend=-1) != 0))
            begun = np.flatnonzero(np.diff(code, prepend=-1))
            df, cf = np.diff(begun, append=len(code)), np.add.reduceat(tf.astype(np.int64), begun)
            at = code[first]
            postings = pa.StructArray.from_arrays([pa.array(doc), pa.array(tf)], ["doc", "tf"])
            yield from sliced(
                {
                    "term": coded.dictionary.take(pa.array(sorted_[at])),
                    "range": pa.array(range_[first]),
                    "df": pa.array(df[at].astype(np.int32)),
                    "cf": pa.array(cf[at], mask=np.diff(at, prepend=-1) == 0),  # with a term's first block
                    "max_tf": pa.array(np.maximum.reduceat(tf, first)),
                    "n": pa.array(np.diff(first, append=len(code)).astype(np.int32)),
                    "docs": pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), postings),
                    "bucket": pa.array(np.full(len(first), group // parts, np.int32)),
                }
            )

    return dealt(packed, tasks).mapInArrow(merge, BLOCKS)


def save_index(index: LexicalIndex, path: str, buckets: int = POSTING_BUCKETS, range_chunks: int = RANGE_CHUNKS) -> None:
    """Write postings and statistics so that later searches read only what they need.

    The postings of one term in one range of `range_chunks` chunks form a block. Blocks lie in
    folders by a hash of the term, and a search prunes to the folders of its own terms. Files
    are sorted by term, which packs them well. The texts are counted in batches, whose lists
    are dealt once, packed; where all lists of a term meet, its document frequency is known
    and its blocks are made. Everything else is read from the blocks.
    """
    texts = index.texts if index.texts is not None else _numbered(index.chunks, by_length=True)
    spark = texts.sparkSession
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = -(-n_bytes // POSTING_BYTES)
    parts = max(1, -(-expected // (buckets * BUCKET_POSTINGS)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-expected // BUCKET_POSTINGS))
    lists = posting_lists(texts, "text", index.options, buckets, parts)
    blocks = _merged_blocks(lists, tasks, parts, range_chunks)
    blocks.sortWithinPartitions("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/postings")
    stats = blocks.filter("cf IS NOT NULL").select("term", F.col("df").cast("long").alias("df"), "cf")
    stats.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/term_stats")

    low, high = index.options.df_bounds(index.n_docs)
    kept = (F.col("df") >= low) & (F.col("df") <= high)
    square = F.pow(F.col("tf") * smooth_idf(F.col("df"), index.n_docs), 2)
    sums = [
        F.sum(F.when(kept, square)).alias("square"),
        F.sum(F.when(kept, F.col("tf"))).cast("long").alias("dl"),
        F.sum(F.when(F.col("df") == 1, F.col("tf"))).cast("long").alias("lost"),
    ]
    by_doc = written(blocks.select("df", F.inline("docs")).groupBy("doc").agg(*sums), "chunk-sums", "zstd")
    named = texts.select("doc", "chunk_id", "topic").join(small(by_doc, index.n_docs <= BROADCAST_ROWS), "doc")
    facts = named.filter("square IS NOT NULL").select("chunk_id", "doc", "topic", "dl", F.sqrt("square").alias("norm"))
    facts.write.mode("overwrite").parquet(f"{path}/chunk_facts")
    named.filter("lost IS NOT NULL").select("chunk_id", "lost").write.mode("overwrite").parquet(f"{path}/lost_tokens")
    range_ = F.floor(F.col("doc") / range_chunks).alias("range")
    by_doc.filter("square IS NOT NULL").groupBy(range_).agg(F.min("dl").alias("min_dl")).write.mode("overwrite").parquet(f"{path}/range_lengths")
    foldered = index.chunks.withColumn("folder", _folder("chunk_id"))
    (
        foldered.hint("rebalance", "folder")
        .sortWithinPartitions("folder", "chunk_id")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#chunk_id", "true")
        .partitionBy("folder")
        .parquet(f"{path}/chunks")
    )
    about = {"format": FORMAT, "options": asdict(index.options), "buckets": buckets, "range_chunks": range_chunks, "n_docs": index.n_docs}
    row = spark.createDataFrame([(json.dumps(about),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    """Open a saved index with the settings it was saved with."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if about["format"] != FORMAT:
        raise ValueError(f"index format {about['format']} instead of {FORMAT}; save it again")
    kept = {k: tuple(v) if isinstance(v, list) else v for k, v in about["options"].items()}
    stats = spark.read.parquet(f"{path}/term_stats")
    chunks = spark.read.parquet(f"{path}/chunks")
    postings = spark.read.schema(BLOCKS).parquet(f"{path}/postings")
    facts = spark.read.parquet(f"{path}/chunk_facts")
    once = spark.read.parquet(f"{path}/lost_tokens")
    lengths = spark.read.parquet(f"{path}/range_lengths")
    index = measured(chunks, about["n_docs"], TermOptions(**kept), stats)
    return replace(index, once=once, postings=postings, facts=facts, lengths=lengths, buckets=about["buckets"], range_chunks=about["range_chunks"])
