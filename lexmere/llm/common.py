"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.session import written

NULL_ID = 2**63 - 1  # stands for a null document id inside an operator; sorts last
HOT_SHARE = 10_000


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) without nulls; every other column is left behind."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def outer_id(column: str) -> "F.Column":
    return F.nullif(F.col(column), F.lit(NULL_ID)).alias(column)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Join `rows` to a stored table with one row per key that knows how often the key occurs.

    Keys with more than 1 / HOT_SHARE of all `total` rows (and more than 1,000) are
    HOT_SHARE at most: they are broadcast and their rows never shuffled. No other key is
    frequent, so those are joined by key.
    """
    limit = max(1000, total // HOT_SHARE)
    hot = table.filter(F.col(count) > limit)
    found = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return found.unionByName(rest.join(table.filter(F.col(count) <= limit).hint("merge"), keys))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every linked node.

    Each round takes the smallest label among a node and its neighbours and then that
    label's own label, so long chains shorten by more than half. Rounds are written tables:
    lineage stays short and a lost executor costs one round at most.
    """
    edges = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        own = labels.select(F.col("node").alias("low"), F.col("component").alias("below"))
        step = lower.join(own, "low").select("node", "was", F.least("low", "below").alias("component"))
        step = written(step, "labels")
        labels = step.select("node", "component")
        if step.filter("was <> component").isEmpty():
            return labels
