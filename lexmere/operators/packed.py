"""Counted terms that travel as packed tables instead of rows.

A task counts a batch of texts in numpy and deals its terms into groups by a hash. Each group
of a batch is one row: a compressed Arrow table. Spark shuffles these rows by group, and a
group's tables are merged where they arrive. All rows of one term meet in one group; terms are
told apart by their texts, never by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "group int, base long, data binary"
OUT_ROWS = 100_000
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    raw = words.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    sizes = np.diff(offsets)
    place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
    each = mixed(data.astype(np.uint64) + (place << np.uint64(8)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))  # wraps around, as do differences
    return sums[starts + sizes] - sums[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every bit of the input reaches every bit."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_hash(front: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a term from that of its words but the last, and that of the last."""
    return mixed(front) * np.uint64(31) + word


def term_hashes(terms: list[str]) -> np.ndarray:
    """The hashes of terms as `joined_hash` gives them, word by word."""
    out = np.zeros(len(terms), np.uint64)
    parts = [t.split(" ") for t in terms]
    for n in {len(p) for p in parts}:
        at = np.array([i for i, p in enumerate(parts) if len(p) == n])
        found = word_hashes(pa.array([parts[i][0] for i in at], pa.string()))
        for k in range(1, n):
            found = joined_hash(found, word_hashes(pa.array([parts[i][k] for i in at], pa.string())))
        out[at] = found
    return out


def groups_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(groups)).astype(np.int64)


def pack(table: pa.RecordBatch, base: int, group: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED: one for each group that holds rows of `table`."""
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=groups))
    dealt = table.take(pa.array(order))
    rows = []
    for at in np.flatnonzero(np.diff(ends, prepend=0)):
        first = ends[at - 1] if at else 0
        held = dealt.slice(first, ends[at] - first)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema, options=_ZSTD) as writer:
            writer.write_batch(held)
        rows.append((int(at), base, sink.getvalue().to_pybytes()))
    if rows:
        group_, base_, data = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(group_, pa.int32()), pa.array(base_, pa.int64()), pa.array(data, pa.binary())], names=["group", "base", "data"])


def dealt(packed: DataFrame, tasks: int) -> DataFrame:
    """Packed rows by group, all of one group behind each other in one task."""
    return packed.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, pa.RecordBatch]]]]:
    """(group, [(base, table)]) of `dealt` rows."""
    group, held = None, []
    for batch in batches:
        for g, base, data in zip(batch["group"].to_pylist(), batch["base"].to_pylist(), batch["data"]):
            if g != group and held:
                yield group, held
                held = []
            group = g
            held.extend((base, t) for t in pa.ipc.open_stream(data.as_buffer()))
    if held:
        yield group, held


def sliced(columns: dict[str, pa.Array], rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for at in range(0, len(whole), rows):
        yield whole.slice(at, rows)
