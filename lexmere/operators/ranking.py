"""Exact top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.session import written

# Scores are sums whose order differs from run to run, so ranks compare them at this
# many decimals and then fall back to the id: equal documents keep a fixed order.
RANK_DECIMALS = 9
# Above this many rows per group Spark no longer cuts groups before the shuffle.
_GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First `k` rows of each group, with their rank from 1.

    Each task keeps only its own first k rows per group before the shuffle
    (WindowGroupLimit), so a group holding a third of the data still arrives as at
    most k rows per task. For a k too large for that rule the same cut is made
    twice, first within salted parts of each group: still exact.
    """
    spark = df.sparkSession
    if k > int(spark.conf.get(_GROUP_LIMIT_CONF, "1000")):
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= k)
        df = df.drop("_salt", rank)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def numbered(df: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """`df` with row numbers from 0 as column `name`, in `order` if given, without one task
    that sees all rows: rows are cut into ordered parts, numbered inside each part, and
    moved by the number of rows in the parts before. The result is a written table's.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # part << 33 | place in the part
    parts = written(df.withColumn("_part", F.shiftrightunsigned(place, 33)).withColumn("_at", place.bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())  # one row a task
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    moved = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    both = parts.join(F.broadcast(moved), "_part")
    return both.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def by_score(score: str, tie: str) -> list[Column]:
    return [F.round(score, RANK_DECIMALS).desc(), F.col(tie).asc()]
