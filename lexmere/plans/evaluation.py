"""Score retrieval and citations of an evaluation set with one shared search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexmere.functions.fixed import DEFAULT_EXPANSIONS
from lexmere.operators.evaluate import metrics
from lexmere.operators.index import LexicalIndex
from lexmere.operators.search import search
from lexmere.session import written


def evaluate(
    index: LexicalIndex,
    questions: DataFrame,
    *,
    retriever: str = "bm25",
    k: int = 8,
    unit: str = "sentence",
    dictionary=DEFAULT_EXPANSIONS,
) -> DataFrame:
    """The one-row metrics record. The search result feeds both metrics, so it is written."""
    found = search(index, questions, retriever=retriever, top_k_=k, dictionary=dictionary)
    return metrics(questions, written(found.select("qid", "chunk_id"), "retrieved"), unit)
