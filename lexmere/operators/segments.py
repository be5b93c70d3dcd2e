"""A lexical index that grows: immutable segments, tombstones, mergeable statistics.

An append writes a segment: its chunks and its own statistics. A BM25 search counts the live
texts for the terms that are asked; a TF-IDF search makes the forward index that it needs. A
delete writes tombstones and statistics with the opposite sign. Counts add up, and the one document
of a term seen once is kept as the exclusive or of document numbers, which adding and
removing a document change alike; so statistics of any history merge without its texts.

A manifest names the parts of one version. It is written last, as a folder of its own that
must not exist yet: readers see a version whole or not at all, and of two writers of one
version the second fails. Nothing published is ever changed. Compaction joins all live
rows into one segment without splitting a text again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.operators.counting import STATS, merged_stats, packed_stats, repacked_stats
from lexmere.operators.index import KEY_END, LexicalIndex, measured, public_id
from lexmere.operators.terms import TermOptions
from lexmere.session import at_most, small, written

# A document number is the number of a part that was ever written, and the place in that part
# as Spark's monotonically_increasing_id gives it.
PART_BITS = 33
OLDER_BITS = 40  # before, it was the version and the place in the segment

MERGED_ROWS = 2_000_000  # statistics rows that one task merges, on average
MERGED_BYTES = 20_000_000  # the same in bytes of text
GROUPS = 4  # groups of terms for each task that merges them


def _merge(packed: DataFrame, tasks: int) -> DataFrame:
    """(term, df, cf, docs) of packed statistics. Terms are dealt in groups by their hash: a
    packed row stands for the terms of one group."""
    dealt = packed.select(F.col("group").alias("term"), "base", "data").repartition(tasks, "term").sortWithinPartitions("term")
    return dealt.withColumnRenamed("term", "group").mapInArrow(merged_stats, STATS)


class GrowingIndex:
    """An index in `path`, a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, options: TermOptions = TermOptions()) -> GrowingIndex:
        index = cls(spark, path)
        index._publish({"version": 0, "options": asdict(options), "segments": [], "tombstones": [], "n_docs": 0, "streams": {}})
        return index

    # ---- versions ----

    def manifest(self) -> dict:
        """The newest published version."""
        rows = self.spark.read.option("recursiveFileLookup", "true").text(f"{self.path}/manifest")
        newest = rows.select(F.max_by("value", F.get_json_object("value", "$.version").cast("long"))).first()[0]
        return json.loads(newest)

    def _publish(self, manifest: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        row.coalesce(1).write.mode("errorifexists").text(f"{self.path}/manifest/v{manifest['version']:012d}")

    def _options(self, manifest: dict) -> TermOptions:
        return TermOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in manifest["options"].items()})

    def _read(self, names: list[str], part: str) -> DataFrame | None:
        tables = [self.spark.read.parquet(f"{self.path}/{name}/{part}") for name in names]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None

    def _live(self, manifest: dict, part: str) -> DataFrame | None:
        """Rows of all segments without the deleted documents."""
        rows, dead = self._read(manifest["segments"], part), self._read(manifest["tombstones"], "docs")
        if rows is None or dead is None:
            return rows
        return rows.join(small(dead.select("doc"), at_most(dead)), "doc", "left_anti")

    def _merged(self, manifest: dict) -> DataFrame | None:
        """(term, df, cf, docs) of the live documents."""
        parts = self._read(manifest["segments"] + manifest["tombstones"], "stats")
        if parts is None:
            return None
        # segments have few terms in common: rows are dealt packed, in tasks of a bounded number
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-parts.count() // MERGED_ROWS))
        return _merge(repacked_stats(parts, tasks * GROUPS), tasks).filter(F.col("df") > 0)

    def _write_stats(self, rows: DataFrame, name: str, options: TermOptions, sign: int = 1) -> None:
        """The statistics of `rows` (doc, text, ...), counted in one reading."""
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-n_bytes // MERGED_BYTES))
        stats = _merge(packed_stats(rows, "text", options, tasks * GROUPS, sign), tasks)
        stats.write.option("compression", "zstd").parquet(f"{self.path}/{name}/stats")

    # ---- changes ----

    def append(self, chunks: DataFrame, *, stream: str | None = None, batch: int | None = None) -> bool:
        """Add `chunks` (chunk_id, text, topic, ...) as a segment; ids may repeat.

        A numbered batch of a named stream is added once, however often it is tried.
        """
        manifest = self.manifest()
        if stream is not None and manifest["streams"].get(stream, -1) >= batch:
            return False
        version = manifest["version"] + 1
        name = f"segments/{version:012d}-{uuid.uuid4().hex[:8]}"
        before = manifest.get("parts", (version + 1) << (OLDER_BITS - PART_BITS))
        numbered = chunks.withColumn("doc", F.monotonically_increasing_id() + F.lit(before << PART_BITS))
        key = F.concat("chunk_id", F.lit(KEY_END), "doc")
        placed = numbered.select(*(key.alias(c) if c == "chunk_id" else F.col(c) for c in numbered.columns))
        placed.write.option("compression", "zstd").parquet(f"{self.path}/{name}/chunks")
        placed = self.spark.read.parquet(f"{self.path}/{name}/chunks")
        self._write_stats(placed, name, self._options(manifest))
        streams = manifest["streams"] | ({stream: batch} if stream is not None else {})
        row = placed.agg(F.count("*").alias("n"), F.max("doc").alias("last")).first()
        parts = before if row["last"] is None else (row["last"] >> PART_BITS) + 1
        added = {"segments": [*manifest["segments"], name], "n_docs": manifest["n_docs"] + row["n"], "parts": parts}
        self._publish(manifest | added | {"version": version, "streams": streams})
        return True

    def delete(self, ids: DataFrame) -> int:
        """Remove every chunk whose id is in `ids` (chunk_id); the number removed."""
        manifest = self.manifest()
        chunks = self._live(manifest, "chunks")
        if chunks is None:
            return 0
        wanted = written(ids.select(F.col("chunk_id").alias("_id")).distinct(), "ids-to-delete")
        version = manifest["version"] + 1
        name = f"tombstones/{version:012d}-{uuid.uuid4().hex[:8]}"
        named = chunks.select("doc", "chunk_id", "text").withColumn("_id", public_id())
        gone = named.join(small(wanted, at_most(wanted)), "_id", "left_semi").drop("_id")
        gone = written(gone, "deleted", "zstd")
        n = gone.count()
        if n:
            gone.select("doc", "chunk_id").write.parquet(f"{self.path}/{name}/docs")
            self._write_stats(gone, name, self._options(manifest), -1)
            changed = {"tombstones": [*manifest["tombstones"], name], "n_docs": manifest["n_docs"] - n}
            self._publish(manifest | changed | {"version": version})
        return n

    def compact(self) -> None:
        """One segment of all live rows in place of all parts; no text is split again."""
        manifest = self.manifest()
        if not manifest["segments"]:
            return
        version = manifest["version"] + 1
        name = f"segments/{version:012d}-{uuid.uuid4().hex[:8]}"
        self._live(manifest, "chunks").write.option("compression", "zstd").parquet(f"{self.path}/{name}/chunks")
        self._merged(manifest).write.option("compression", "zstd").parquet(f"{self.path}/{name}/stats")
        self._publish(manifest | {"segments": [name], "tombstones": [], "version": version})

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For `writeStream.foreachBatch`: every batch becomes a segment, exactly once."""

        def add(batch: DataFrame, number: int) -> None:
            GrowingIndex(batch.sparkSession, self.path).append(batch, stream=stream, batch=number)

        return add

    # ---- reading ----

    def open(self) -> LexicalIndex:
        """The newest version as an index that every search takes; later changes leave it as it is."""
        manifest = self.manifest()
        if not manifest["segments"]:
            raise ValueError("the index is empty")
        merged = written(self._merged(manifest), "merged-stats", "zstd")
        live = self._live(manifest, "chunks")
        # tokens lost to terms of one document, by that document
        once = merged.filter("df = 1").groupBy(F.col("docs").alias("doc")).agg(F.sum("cf").alias("lost"))
        once = written(live.select("doc", "chunk_id").join(once, "doc").select("chunk_id", "lost"), "lost-tokens")
        chunks, texts = live.drop("doc"), live.select("chunk_id", "doc", "topic", "text")
        index = measured(chunks, manifest["n_docs"], self._options(manifest), merged.select("term", "df", "cf"))
        return replace(index, texts=texts, once=once)
