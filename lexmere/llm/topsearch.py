"""Exact top-k inner products by tiled matrix products.

Vectors become whole numbers, floor(scale * x), so every score is exact. Queries are cut
into blocks and all vectors into shards, both of bounded size; a tile is one block against
one shard. A tile is one matrix product and a partial selection of each query's best k, so
no pair ever becomes a row. The lists of a query are merged in a tree: each step takes the
best k of at most `fan` neighbouring shards.

Memory of a task is bounded by a block and a shard. Rows move once per block (vectors) and
once per shard (queries), in balance with a tile's own work of block x shard products.

Defined cases: a vector that is null or holds a null or non-finite component takes no part;
an empty vector scores 0; a shorter vector counts as filled up with zeros. A row is never
its own candidate, but rows that share an id are candidates of each other and each asks for
itself. A null id asks nothing and is found last among equal scores. Components and scores
beyond 64 bits are held at the ends of that range. Other columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import NULL_ID, outer_id
from lexmere.operators.ranking import top_k
from lexmere.session import written

LONG = 2**63
LISTS = "query long, query_id long, shard int, row long, vec_id long, score long"
CELLS = 1 << 22  # scores held at once


@dataclass(frozen=True)
class TileOptions:
    scale: float = 1024.0
    block: int = 32_768  # queries of a tile
    shard: int = 32_768  # vectors of a tile
    fan: int = 16


def quantised(vectors: DataFrame, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, vec_id, parts array<long>) of the vectors that take part; `row` names one row.

    To be written before use: row numbers hold for one reading only.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    parts = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.filter(F.col(embedding).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(vec_id).cast("long"), F.lit(NULL_ID)).alias("vec_id"),
        parts.alias("parts"),
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to `width`."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, held at its ends."""
    reach = np.abs(queries.astype(float)).sum(axis=1).max(initial=0) * np.abs(vectors.astype(float)).max(initial=0)
    if reach < 2**52:  # every partial sum is a whole number that a double holds
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    if reach < 2**62:
        return queries @ vectors.T
    whole = queries.astype(object) @ vectors.T.astype(object)
    return np.clip(whole, -LONG, LONG - 1).astype(np.int64)


def best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) positions of each row's k highest scores, ties to the smaller position.

    `own` is the position that a row must not find, -1 where it is elsewhere.
    """
    n = scores.shape[1]
    asks = np.flatnonzero(own >= 0)
    if np.abs(scores.astype(float)).max(initial=0) < 2**62 / max(n, 1):
        # one number per cell that orders by score, then position: cut without a full sort
        keys = scores * n + np.arange(n - 1, -1, -1)
        keys[asks, own[asks]] = -LONG
        k = min(k, n)
        at = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), keys.shape)
        found = np.take_along_axis(keys, at, axis=1) > -LONG
        row = np.broadcast_to(np.arange(len(keys))[:, None], at.shape)
        return row[found], at[found]
    rows, ats = [], []
    for row, line in enumerate(scores):
        at = np.lexsort((np.arange(n), ~line))
        at = at[at != own[row]][:k]
        rows.append(np.full(len(at), row))
        ats.append(at)
    return np.concatenate(rows), np.concatenate(ats)


def tile_lists(tile: pa.Table, k: int) -> pa.Table:
    """Each query's best k of one tile."""
    asks = tile.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    row, vec_id = (tile.column(c).to_numpy() for c in ("row", "vec_id"))
    sizes = tile.column("parts").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    parts = _matrix(tile.column("parts"), int(sizes.max(initial=0)))
    order = np.lexsort((row, vec_id))
    kept = order[~asks[order]]
    questions = order[asks[order]]
    by_row = np.argsort(row[kept])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // max(len(kept), 1))
    for start in range(0, len(questions) if len(kept) else 0, step):
        part = questions[start : start + step]
        place = np.minimum(np.searchsorted(row[kept], row[part], sorter=by_row), len(kept) - 1)
        own = np.where(row[kept][by_row[place]] == row[part], by_row[place], -1)
        scores = products(parts[part], parts[kept])
        q, v = best(scores, own, k)
        found.append((part[q], kept[v], scores[q, v]))
    q, v, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    shard = np.full(len(q), tile.column("shard")[0].as_py() if tile.num_rows else 0, np.int32)
    columns = (row[q], vec_id[q], shard, row[v], vec_id[v], score)
    return pa.Table.from_arrays([pa.array(c) for c in columns], ["query", "query_id", "shard", "row", "vec_id", "score"])


def merged(lists: DataFrame, k: int, shards: int, fan: int) -> DataFrame:
    """The best k of each query, merged level by level; adds `rank`."""
    order = [F.col("score").desc(), F.col("vec_id"), F.col("row")]
    while True:
        shards = -(-shards // fan)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan).cast("int"))
        lists = top_k(lists, ["query", "shard"], order, k)
        if shards <= 1:
            return lists
        lists = lists.drop("rank")


def exact_top_k(vectors: DataFrame, k: int, asks: Column, options: TileOptions = TileOptions(), *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every row for which `asks` holds.

    `asks` is an expression of `vec_id`.
    """
    spark = vectors.sparkSession
    table = written(quantised(vectors, options.scale, vec_id, embedding), "vectors")
    chosen = table.filter(F.coalesce(asks & (F.col("vec_id") != NULL_ID), F.lit(False)))
    blocks = max(1, -(-chosen.count() // options.block))
    # no fewer shards than a shuffle has partitions, so that a small table uses all cores too
    shards = max(-(-table.count() // options.shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.xxhash64("row")
    number = lambda n: F.pmod(place, F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = table.select("*", F.lit(False).alias("asks"), number(shards).alias("shard"), every(blocks).alias("block"))
    asked = chosen.select("*", F.lit(True).alias("asks"), every(shards).alias("shard"), number(blocks).alias("block"))
    tiles = held.unionByName(asked).groupBy("block", "shard")
    lists = tiles.applyInArrow(lambda tile: tile_lists(tile, k), LISTS)
    return merged(lists, k, shards, options.fan).select("query_id", "rank", outer_id("vec_id"), "score")
