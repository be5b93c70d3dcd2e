"""Near-duplicate documents by MinHash, verified through odd sketches.

A document's set is its distinct 5-word shingles (words lower-cased in A-Z). SAMPLES
MinHash values per set serve twice: the first of them make BANDS bucket keys, and all of
them are folded into an odd sketch, a bitmap in which bit h(i, value) is flipped for every
sample i. The exclusive or of two sketches flips twice per sample that differs, so its
population count gives their number, and thereby the similarity, most precisely where it
is high. Candidates that the sketch leaves are confirmed on full sets.

1. Equal sets form a class; one representative goes on, so copies cost nothing further.
2. In every bucket, each member is compared with the bucket's smallest document. Confirmed
   links give components.
3. In buckets that hold several components, members of different ones are compared by
   sketch, block by block, and what remains is confirmed too. Members of one component
   need no comparison, so a large group of copies is not expanded into pairs.
4. Components of all links.

Unless given, bands and rows follow from the threshold, so that a pair exactly there shares
no bucket with probability LOST at most: 32 bands of 6 at 85 percent (3e-7), of 5 at 80
(3e-6), of 3 at 70. The sketch's own margin (5 standard deviations) is of the order 3e-7.

Defined cases: a null or empty text has no shingles and is its own component; fewer than
five words make one shingle; rows of equal doc_id are one document; a null doc_id sorts
last and comes back as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import components, documents, join_counted, outer_id
from lexmere.llm.shingles import mix, shingle_sets
from lexmere.session import written


LOST = 4e-6
BANDS = 32


@dataclass(frozen=True)
class NearOptions:
    percent: int = 85
    samples: int = 512
    bands: int | None = None
    rows: int | None = None
    words: int = 32  # 64-bit words of a sketch
    margin: float = 5.0
    block: int = 1024

    def __post_init__(self) -> None:
        if not 1 <= self.percent <= 100:
            raise ValueError("the threshold is a percentage from 1 to 100")
        bands, rows = self.bands or BANDS, self.rows
        if rows is None:
            most = max(self.samples // bands, 1)
            rows = next((r for r in range(most, 1, -1) if self.missed(bands, r) <= LOST), 1)
        if self.bands is None:
            while self.missed(bands, rows) > LOST and bands * rows <= self.samples:
                bands += 1
        if bands * rows > self.samples:
            raise ValueError("too few samples for this threshold")
        object.__setattr__(self, "bands", bands)
        object.__setattr__(self, "rows", rows)

    def missed(self, bands: int, rows: int) -> float:
        """Probability that a pair at the threshold shares no bucket."""
        return (1 - (self.percent / 100) ** rows) ** bands

    @property
    def most_bits(self) -> int:
        """Population count that a pair at the threshold passes only beyond the margin."""
        off = 1 - self.percent / 100
        differ = self.samples * off + self.margin * (self.samples * off * (1 - off)) ** 0.5
        bits = 64 * self.words
        return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))) + 1


SIGNATURES = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def _signatures(options: NearOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(7)
        factors = draw.integers(0, 2**32, options.samples, dtype=np.uint32) | np.uint32(1)
        salts = mix(np.arange(1, options.samples + 1).astype(np.uint64))
        bits = np.uint64(64 * options.words)
        used = options.bands * options.rows
        weights = mix(np.arange(1000, 1000 + used).astype(np.uint64)) | np.uint64(1)
        names = ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"]
        for batch in batches:
            n = batch.num_rows
            sizes = np.zeros(n, np.int64)
            marks = np.zeros((n, 2), np.int64)
            bands = np.zeros((n, options.bands), np.uint64)
            sketches = np.zeros((n, options.words * 64), np.uint8)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, own in enumerate(shingle_sets(texts)):
                sizes[i] = len(own)
                marks[i] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
                if not len(own):
                    continue
                low = np.full(options.samples, 2**32 - 1, np.uint32)
                short = (own >> np.uint64(32)).astype(np.uint32)
                for at in range(0, len(short), 512):
                    np.minimum(low, (short[at : at + 512, None] * factors).min(axis=0), out=low)
                values = low.astype(np.uint64)
                place = (mix(values ^ salts) % bits).astype(np.int64)
                sketches[i] = np.bincount(place, minlength=int(bits)) & 1
                bands[i] = (values[:used] * weights).reshape(options.bands, options.rows).sum(axis=1)
            bands = mix(bands + np.arange(options.bands, dtype=np.uint64))
            packed = np.packbits(sketches, axis=1).view(np.int64)
            lists = [
                pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.reshape(-1).view(np.int64)))
                for a in (bands, packed)
            ]
            columns = [batch.column(0), pa.array(sizes), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _confirm(percent: int):
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            held, held_set = None, None
            others = shingle_sets(right.cast(pa.binary()).to_pylist())
            for i, (text, other) in enumerate(zip(left.cast(pa.binary()).to_pylist(), others)):
                if text != held:
                    held, held_set = text, next(shingle_sets([text]))
                both = len(np.intersect1d(held_set, other, assume_unique=True))
                either = len(held_set) + len(other) - both
                keep[i] = both > 0 and 100 * both >= percent * either
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The given pairs (a, b) that are links, on the full sets of both texts."""
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "left", "right")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def _apart(first: str, second: str):
    """Population count of the exclusive or of two sketches."""
    return F.aggregate(
        F.zip_with(first, second, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )


def _block_pairs(options: NearOptions):
    """Pairs of a bucket's block pair that differ in component and are close by sketch.

    Two documents may meet in several buckets; the first one they share gives the pair.
    Rows come sorted by (key, lo, hi). A group holds two blocks at most; it is kept back
    at the end of a batch until its last row has come.
    """

    def close(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, comps, part = (rows.column(c).to_numpy() for c in ("doc_id", "component", "part"))
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        key = rows.column("key")[0].as_py()
        sketch, bands = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for c in ("sketch", "bands"))
        sketch = sketch.view(np.uint64)
        one, two = (np.flatnonzero(part == p) for p in (lo, hi))
        found_a, found_b = [ids[:0]], [ids[:0]]
        for at in range(0, len(one), 32):
            mine = one[at : at + 32]
            differ = np.bitwise_count(sketch[mine][:, None] ^ sketch[two][None]).sum(axis=2, dtype=np.int64)
            near = (differ <= options.most_bits) & (comps[mine][:, None] != comps[two][None])
            if lo == hi:
                near &= ids[mine][:, None] < ids[two][None]
            i, j = np.nonzero(near)
            shared = bands[mine[i]] == bands[two[j]]
            first = bands[mine[i], shared.argmax(axis=1)] == key
            i, j = i[first], j[first]
            found_a.append(np.minimum(ids[mine[i]], ids[two[j]]))
            found_b.append(np.maximum(ids[mine[i]], ids[two[j]]))
        return np.concatenate(found_a), np.concatenate(found_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            nonlocal held
            marks = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = np.r_[0, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, table.num_rows]
            stop = len(cuts) - 1 if last else len(cuts) - 2
            for k in range(stop):
                size = cuts[k + 1] - cuts[k]
                if size > 1:
                    yield close(table.slice(cuts[k], size))
            held = None if last else table.slice(cuts[stop])

        def send(found):
            a, b = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if found := list(groups(table, False)):
                yield send(found)
        if held is not None and (found := list(groups(held, True))):
            yield send(found)

    return run


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame, options: NearOptions) -> DataFrame:
    """(a, b): close members of one bucket that lie in different components."""
    named = members.join(labels, members["doc_id"] == labels["node"], "left").select(
        "key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")
    )
    named = written(named, "bucket-components")
    mixed = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = written(mixed.filter("least <> most").select("key"), "mixed-buckets")
    blocks = F.ceil(F.col("n") / options.block).cast("int")
    rows = named.join(mixed, "key").join(sketches, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key",
        F.least("part", "other").alias("lo"),
        F.greatest("part", "other").alias("hi"),
        "part",
        "doc_id",
        "component",
        "sketch",
        "bands",
    )
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_block_pairs(options), "a long, b long").distinct()


def near_components(docs: DataFrame, options: NearOptions = NearOptions(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    picked = documents(docs, doc_id, text)
    signed = written(picked.mapInArrow(_signatures(options), SIGNATURES), "signatures")
    sets = signed.filter("n_shingles > 0")
    classes = written(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    chosen = classes.select("h1", "h2", F.col("rep").alias("doc_id"))
    reps = sets.select("doc_id", "h1", "h2", "bands").join(chosen, ["doc_id", "h1", "h2"], "left_semi")
    bucketed = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = bucketed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("pivot"))
    buckets = written(buckets.filter("n > 1"), "buckets")
    members = written(bucketed.join(buckets.hint("merge"), "key"), "bucket-members")
    sketches = sets.select("doc_id", "sketch", "bands")
    stars = members.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stars.join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
    stars = stars.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a")
    stars = written(stars.filter(_apart("sa", "sb") <= options.most_bits).select("a", "b"), "star-pairs")
    links = written(confirmed(stars, picked, options.percent), "star-links")
    labels = components(links)
    more = _across(members.filter("n > 2"), labels, sketches, options).join(stars, ["a", "b"], "left_anti")
    more = written(more, "more-pairs")
    if not more.isEmpty():
        links = links.unionByName(written(confirmed(more, picked, options.percent), "more-links"))
        labels = components(links)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "h1", "h2", "n", F.coalesce("component", "rep").alias("component_id")
    )
    named = written(named, "class-components")
    base = sets.select("doc_id", "n_shingles", "h1", "h2")
    found = join_counted(base, named, ["h1", "h2"], "n", signed.count()).select("doc_id", "n_shingles", "component_id")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).select(
        outer_id("doc_id"), "n_shingles", outer_id("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept")
    )
