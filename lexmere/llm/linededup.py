"""Reversible incremental line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys
of at least `min_chars` code points that at least two documents hold lose all their lines,
except in the smallest doc_id that holds them.

The state lives in a folder every executor can reach, one sub-folder per table:

refs      one row per (key, document), appended by every insertion
gone      deleted documents, with the batch that deleted them
counts    exact reference counts: one row per (key, batch); a deletion writes the exact
          remaining count and smallest document of the keys it touched
shared    keys that were found present again, hence possibly held twice
filters   one cuckoo filter per shard of the keys, rewritten per batch

A batch asks the filters first. A key they deny is new for certain and needs no lookup in
the counts; only the others are looked up. Deleting a document takes its references back,
and a key without any leaves the filter, so later batches see it as new again.

Keys are 128-bit digests. Defined cases: a null text is one empty line; rows with equal
doc_id are one document; a null doc_id is a document of its own that sorts last; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm.common import NULL_ID, join_counted
from lexmere.llm.cuckoo import CuckooFilter

KEYS_PER_SHARD = 1 << 18
MIN_SHARDS = 1024
BATCHES = 2  # of a whole corpus; every batch but the first asks the filters
WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A key digest for every line of the text, None for lines with too short a key."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(WHITE).lower()  # bytes.lower changes A-Z only
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _key_columns(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"".join(keys)
    words = np.frombuffer(joined, ">i8").astype(np.int64) if joined else np.zeros(0, np.int64)
    words = words.reshape(-1, 2)
    return words[:, 0], words[:, 1]


def _references(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = set(line_keys(text, min_chars))
                own.discard(None)
                keys.extend(own)
                sizes[i] = len(own)
            h1, h2 = _key_columns(keys)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids)], ["h1", "h2", "doc_id"])

    return run


def _kept_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, drops = (batch.column(c) for c in ("doc_id", "text", "drops"))
            lines, dropped, kept, shas = [], [], [], []
            for text, gone in zip(texts.to_pylist(), drops.to_pylist()):
                text = text or ""
                n = text.count("\n") + 1
                out = text
                if gone:
                    gone = set(gone)
                    stay = [
                        line
                        for line, key in zip(text.split("\n"), line_keys(text, min_chars))
                        if key is None or key not in gone
                    ]
                    out = "\n".join(stay)
                    dropped.append(n - len(stay))
                else:
                    dropped.append(0)
                lines.append(n)
                kept.append(out)
                shas.append(hashlib.sha256(out.encode()).hexdigest())
            columns = [ids, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), pa.array(shas, pa.string()), batch.column("row")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256", "row"])

    return run


def _numbers(table: pa.Table, names: tuple[str, ...] = ("h1", "h2")) -> list[np.ndarray]:
    return [table.column(n).to_numpy().view(np.uint64) for n in names]


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Keys of one shard that its filter may hold."""
    if not keys.num_rows or not filters.num_rows:
        return keys.slice(0, 0)
    have = CuckooFilter.from_bytes(filters.column("data")[0].as_py())
    return keys.filter(pa.array(have.contains(*_numbers(keys))))


def _change(changes: pa.Table, filters: pa.Table) -> pa.Table:
    """The filter of one shard after keys have come (sign 1) and gone (sign -1)."""
    if filters.num_rows:
        shard = filters.column("shard")[0].as_py()
        have = CuckooFilter.from_bytes(filters.column("data")[0].as_py())
    else:
        shard = changes.column("shard")[0].as_py()
        have = CuckooFilter(changes.num_rows)
    if changes.num_rows:
        sign = changes.column("sign").to_numpy()
        h1, h2 = _numbers(changes)
        have.delete(h1[sign < 0], h2[sign < 0])
        have.insert(h1[sign > 0], h2[sign > 0])
    return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([have.to_bytes()], pa.binary())})


class LineIndex:
    """The dedup state in a folder; every change is a batch, published by its last write."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = 10, shards: int | None = None):
        self.spark, self.path, self.min_chars = spark, path.rstrip("/"), min_chars
        self.shards, self.batch = shards, 0
        self._marks = self._published()
        if self._marks:
            last = self._marks[-1]
            self.batch, self.shards, self.min_chars = last["batch"], last["shards"], last["min_chars"]

    # ---- state ----

    def _published(self) -> list[dict]:
        """Marks of the finished batches, in order; a batch without one does not count."""
        try:
            rows = self.spark.read.text(f"{self.path}/marks/batch=*").collect()
        except AnalysisException as none:  # a folder that nothing was written to yet
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((json.loads(r["value"]) for r in rows), key=lambda mark: mark["batch"])

    def _batches(self, name: str) -> list[int]:
        return [mark["batch"] for mark in self._marks if name in mark["tables"]]

    def _table(self, name: str, schema: str, newest: bool = False) -> DataFrame:
        """All published batches of a table, or the newest one only."""
        batches = self._batches(name)
        if not batches:
            return self.spark.createDataFrame([], schema)
        chosen = batches[-1:] if newest else batches
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/batch={b}" for b in chosen))

    def _write(self, frame: DataFrame, name: str, batch: int, schema: str) -> DataFrame:
        path = f"{self.path}/{name}/batch={batch}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _publish(self, batch: int, tables: list[str]) -> None:
        mark = {"batch": batch, "shards": self.shards, "min_chars": self.min_chars, "tables": tables}
        row = self.spark.createDataFrame([(json.dumps(mark),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/marks/batch={batch}")
        self._marks.append(mark)
        self.batch = batch

    REFS = "h1 long, h2 long, doc_id long, batch int"
    COUNTS = "h1 long, h2 long, n long, owner long, exact boolean, batch int"
    KEYS = "h1 long, h2 long"
    FILTERS = "shard int, data binary"
    GONE = "doc_id long, batch int"

    def _sharded(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("shard", F.pmod(F.col("h1"), F.lit(self.shards)).cast("int"))

    def _by_shard(self, keys: DataFrame, work, schema: str) -> DataFrame:
        filters = self._table("filters", self.FILTERS, newest=True)
        grouped = self._sharded(keys).groupBy("shard").cogroup(filters.groupBy("shard"))
        return grouped.applyInArrow(work, schema)

    # ---- changes ----

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Add documents whose ids are not live in the index."""
        batch = self.batch + 1
        picked = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
        refs = picked.mapInArrow(_references(self.min_chars), "h1 long, h2 long, doc_id long")
        refs = self._write(refs.withColumn("batch", F.lit(batch)), "refs", batch, self.REFS)
        # rows of one document may lie in several tasks
        once = refs.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        counts = once.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.min("doc_id").alias("owner"))
        counts = counts.withColumn("exact", F.lit(False)).withColumn("batch", F.lit(batch))
        counts = self._write(counts, "counts", batch, self.COUNTS)
        if self.shards is None:
            self.shards = max(MIN_SHARDS, -(-counts.count() // KEYS_PER_SHARD))
        asked = counts.select("h1", "h2")
        known = asked.limit(0) if not self._batches("filters") else self._by_shard(asked, _probe, "h1 long, h2 long, shard int").select("h1", "h2")
        held = self._totals(known).filter("n > 0").select("h1", "h2")
        held = self._write(held, "held", batch, self.KEYS)
        shared = counts.filter("n > 1").select("h1", "h2").unionByName(held).distinct()
        self._write(shared, "shared", batch, self.KEYS)
        new = asked.join(held, ["h1", "h2"], "left_anti").withColumn("sign", F.lit(1))
        self._write(self._by_shard(new, _change, self.FILTERS), "filters", batch, self.FILTERS)
        self._publish(batch, ["refs", "counts", "shared", "filters"])

    def insert_corpus(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> None:
        """Add all documents in batches by a hash of their id; the result is that of one batch.

        Rows of one document come together. Later batches look up only keys that the filters
        may hold, so the exact counts are not joined with the keys a batch brings first.
        """
        part = F.pmod(F.xxhash64(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID))), F.lit(batches))
        for k in range(batches):
            self.insert(docs.filter(part == k), doc_id, text)

    def delete(self, doc_ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Take documents out again, with everything their lines have caused."""
        batch = self.batch + 1
        ids = doc_ids.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        gone = self._write(ids.withColumn("batch", F.lit(batch)), "gone", batch, self.GONE)
        live = self._live()
        touched = live.join(gone.select("doc_id"), "doc_id", "left_semi").select("h1", "h2").distinct()
        touched = self._write(touched, "touched", batch, self.KEYS)
        remain = live.join(gone.select("doc_id"), "doc_id", "left_anti").groupBy("h1", "h2")
        remain = remain.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))
        counts = touched.join(remain, ["h1", "h2"], "left").select(
            "h1", "h2", F.coalesce("n", F.lit(0)).alias("n"), "owner", F.lit(True).alias("exact"), F.lit(batch).alias("batch")
        )
        counts = self._write(counts, "counts", batch, self.COUNTS)
        left = counts.filter("n = 0").select("h1", "h2", F.lit(-1).alias("sign"))
        self._write(self._by_shard(left, _change, self.FILTERS), "filters", batch, self.FILTERS)
        self._publish(batch, ["gone", "counts", "filters"])

    def _live(self) -> DataFrame:
        """(h1, h2, doc_id) of documents that no later batch deleted."""
        refs = self._table("refs", self.REFS)
        gone = self._table("gone", self.GONE).groupBy("doc_id").agg(F.max("batch").alias("gone_batch"))
        rows = refs.join(gone, "doc_id", "left").filter("gone_batch IS NULL OR batch > gone_batch")
        return rows.select("h1", "h2", "doc_id").distinct()

    def _totals(self, keys: DataFrame) -> DataFrame:
        """(h1, h2, n, owner) of the given keys: their last exact row and what came after it.

        A key has one row per batch that touched it, so its list is short.
        """
        rows = self._table("counts", self.COUNTS).join(keys.distinct(), ["h1", "h2"])
        row = F.struct("batch", "exact", "n", "owner")
        listed = rows.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(row)).alias("_c"))
        return listed.selectExpr(
            "h1",
            "h2",
            """aggregate(_c, named_struct('n', 0L, 'owner', cast(NULL AS long)), (a, x) -> named_struct(
                 'n', IF(x.exact, x.n, a.n + x.n),
                 'owner', IF(x.exact, x.owner, coalesce(least(a.owner, x.owner), a.owner, x.owner)))) AS _t""",
        ).select("h1", "h2", "_t.n", "_t.owner")

    # ---- results ----

    def duplicate_keys(self) -> DataFrame:
        """(h1, h2, n, owner): keys that at least two live documents hold."""
        return self._totals(self._table("shared", self.KEYS)).filter("n > 1")

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text, kept_sha256, row) of documents in the index.

        `row` is a struct of the input's other columns, carried along.
        """
        path = f"{self.path}/duplicates/batch={self.batch}"
        self.duplicate_keys().write.mode("overwrite").parquet(path)
        keys = self.spark.read.schema("h1 long, h2 long, n long, owner long").parquet(path)
        refs = self._live() if self._batches("gone") else self._table("refs", self.REFS)
        refs = refs.select("h1", "h2", "doc_id")
        found = join_counted(refs, keys, ["h1", "h2"], "n", refs.count())
        word = "unhex(concat(lpad(hex(h1), 16, '0'), lpad(hex(h2), 16, '0')))"
        drops = found.filter("doc_id <> owner").select("doc_id", F.expr(word).alias("key"))
        drops = drops.groupBy("doc_id").agg(F.collect_list("key").alias("drops"))
        others = [docs[c] for c in docs.columns if c not in (doc_id, text)]
        row = F.struct(*others) if others else F.lit(None).cast("boolean")
        picked = docs.select(
            F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"), row.alias("row")
        )
        joined = picked.join(drops, "doc_id", "left").select("doc_id", "text", "drops", "row")
        kind = joined.schema["row"].dataType.simpleString()
        out = joined.mapInArrow(
            _kept_lines(self.min_chars),
            f"doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string, row {kind}",
        )
        return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))
