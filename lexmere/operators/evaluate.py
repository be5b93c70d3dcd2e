"""Retrieval and citation metrics over an evaluation set.

Questions: (qid, question, topic, gold_chunk_ids array, answer). Results: the top-k of
one search, shared by both metrics. Undefined ratios are NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.functions.fixed import CITATION
from lexmere.functions.text import WS, strip, units

_CITE = "(?U)" + CITATION.replace(r"\s", WS)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(float("nan")))


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without a join."""
    rows = one_row[0]
    for part in one_row[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def recall(questions: DataFrame, results: DataFrame) -> DataFrame:
    """One row: questions with gold ids and the share with any of them retrieved."""
    gold = questions.filter(F.size(F.coalesce("gold_chunk_ids", F.array())) > 0)
    wanted = gold.select("qid", F.explode_outer("gold_chunk_ids").alias("chunk_id")).distinct()
    hit = wanted.join(results.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi")
    marked = gold.select("qid").join(
        hit.select("qid").distinct().withColumn("hit", F.lit(1)), "qid", "left"
    )
    n = F.count("*")
    return marked.agg(
        n.alias("n_with_gold"),
        ratio(F.count("hit").cast("double"), n).alias("recall_at_k"),
    )


def answer_units(questions: DataFrame, unit: str = "sentence") -> DataFrame:
    """(qid, pos, text): evaluation units of every non-empty answer."""
    held = questions.filter(F.coalesce(F.col("answer"), F.lit("")) != "")
    return held.select(
        "qid", F.posexplode_outer(units(F.col("answer"), unit)).alias("pos", "text")
    ).filter(F.col("text").isNotNull())


def citations(cited_units: DataFrame) -> DataFrame:
    """(qid, pos, chunk_id): each citation found in a unit, in no particular order."""
    return cited_units.select(
        "qid",
        "pos",
        F.explode_outer(F.regexp_extract_all("text", F.lit(_CITE), F.lit(1))).alias("raw"),
    ).filter(F.col("raw").isNotNull()).select("qid", "pos", strip(F.col("raw")).alias("chunk_id"))


def faithfulness(questions: DataFrame, results: DataFrame, unit: str = "sentence") -> DataFrame:
    """One row: cited, uncited and bad-citation rates over all units and citations."""
    rows = answer_units(questions, unit)
    n_units = rows.select(
        F.size(F.regexp_extract_all("text", F.lit(_CITE), F.lit(1))).alias("cites")
    ).agg(F.count("*").alias("units"), F.count_if(F.col("cites") > 0).alias("cited"))
    known = results.select("qid", "chunk_id", F.lit(1).alias("known")).distinct()
    judged = citations(rows).join(known, ["qid", "chunk_id"], "left")
    n_cites = judged.agg(
        F.count("*").alias("cites"), F.count_if(F.col("known").isNull()).alias("bad")
    )
    both = _side_by_side(n_units, n_cites)
    cited = ratio(F.col("cited"), F.col("units"))
    return both.select(
        "units",
        "cited",
        "cites",
        "bad",
        cited.alias("citation_sentence_rate"),
        (F.lit(1.0) - cited).alias("uncited_sentence_rate"),
        ratio(F.col("bad"), F.col("cites")).alias("bad_citation_rate"),
    )


def metrics(questions: DataFrame, results: DataFrame, unit: str = "sentence") -> DataFrame:
    """The one-row metrics record of an evaluation run."""
    totals = questions.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.coalesce(F.col("answer"), F.lit("")) != "").alias("n_with_answer"),
    )
    found = recall(questions, results)
    faith = faithfulness(questions, results, unit)
    return _side_by_side(totals, found, faith).select(
        "n_total",
        "n_with_gold",
        "n_with_answer",
        "recall_at_k",
        "citation_sentence_rate",
        "uncited_sentence_rate",
        "bad_citation_rate",
    )
