"""Vector best-fit packing of documents into sequences.

Every document is encoded, ended by an end id and cut into pieces of at most `capacity`
tokens (only longer documents are cut). A sequence has three capacities: tokens, number of
documents, and attention cost (the sum of the pieces' squared lengths). Pieces, longest
first, go to the open sequence that fits in all three and scores best, by the smallest
weighted norm of what would be left or by the largest weighted dot product of piece and
residual.

Pieces are dealt at random into groups of `group_pieces`, and groups are packed in
parallel; a group leaves about one sequence that is not full. The number of groups grows
with the data, never their size.

Defined cases: a null text is empty and makes one piece, the end id; repeated rows are
packed row by row; a null doc_id is carried along; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.units import unit_encoder
from lexmere.session import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacities:
    """Limits of a sequence; a missing limit is set so that it never binds."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"
    group_pieces: int = 8192

    def vector(self) -> np.ndarray:
        attention = self.tokens**2 if self.attention is None else self.attention
        documents = self.tokens if self.documents is None else self.documents
        return np.array([self.tokens, documents, attention], float)


def token_pieces(docs: DataFrame, path: str, kind: str = "words", *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces; no shuffle."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(kind, path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for own, data in zip(ids, encoder.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                view = memoryview(data + end)
                for piece, at in enumerate(range(0, len(view), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    for column, value in zip(rows, (own, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, limits: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece of one group."""
    full = limits.vector()
    if limits.score not in ("norm", "dot"):
        raise ValueError(f"unknown score {limits.score!r}; use norm or dot")
    sizes = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / full
    if (sizes > 1).any():
        raise ValueError("a piece alone exceeds a capacity")
    weights = np.array(limits.weights, float)
    order = np.argsort(-lengths, kind="stable")
    smallest = sizes.min(axis=0) if len(sizes) else full
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    left = np.zeros((len(lengths) + 1, 3))  # residuals of the open bins, in parallel with `name`
    name = np.zeros(len(lengths) + 1, np.int64)
    used = np.zeros(len(lengths) + 1, np.int64)
    n_open = n_bins = 0
    for i in order.tolist():
        size = sizes[i]
        rest = left[:n_open] - size
        fits = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(fits):
            if limits.score == "norm":
                at = fits[np.argmin((rest[fits] ** 2) @ weights)]
            else:
                at = fits[np.argmax(left[fits] @ (weights * size))]
        else:
            at, n_bins = n_open, n_bins + 1
            left[at], name[at] = 1.0, n_bins - 1
            n_open += 1
        bins[i], offsets[i] = name[at], used[name[at]]
        used[name[at]] += lengths[i]
        left[at] -= size
        if (left[at] < smallest - 1e-12).any():  # nothing fits any more
            n_open -= 1
            left[at], name[at] = left[n_open], name[n_open]
    return bins, offsets


def pack(pieces: DataFrame, limits: Capacities = Capacities()) -> DataFrame:
    """Add sequence_id and offset to a table of pieces that has a `length`.

    `pieces` must be a stored table: groups are dealt by row position.
    """
    n = pieces.count()
    groups = max(1, -(-n // limits.group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = best_fit(table.column("length").to_numpy(), limits)
        sequence = table.column("_group").to_numpy() * (1 << 32) + bins
        table = table.append_column("sequence_id", pa.array(sequence))
        return table.append_column("offset", pa.array(offsets)).drop_columns(["_group"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limits: Capacities = Capacities(), **options) -> DataFrame:
    """Pieces of all documents with their place; the pieces are encoded once and stored."""
    pieces = token_pieces(docs, path, capacity=limits.tokens, **options)
    return pack(written(pieces, "pieces"), limits)
