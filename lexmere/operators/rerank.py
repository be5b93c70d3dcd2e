"""Rerankers: functions (pool with payload, questions, k) -> (qid, rank, score, chunk_id).

A pool is the top pool_k of a search, so one question's candidates are a bounded group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.operators.terms import ALL_TERMS, TermOptions, term_arrays

Reranker = Callable[[DataFrame, DataFrame, int], DataFrame]

_SIM_DECIMALS = 12


def identity(pool: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The pool's own order."""
    return pool.filter(F.col("rank") <= k).select("qid", "rank", "score", "chunk_id")


def _choose(terms: list, tfs: list, k: int, trade: float) -> list[int]:
    """Greedy diverse order of documents 1..n; document 0 is the question.

    Similarities are TF-IDF cosines fitted on this small set. Each pick only needs the
    similarity of the last pick to the others, one sparse product per step.
    """
    n = len(terms)
    sizes = [len(t) for t in terms]
    row = np.repeat(np.arange(n), sizes)
    names = np.concatenate([np.asarray(t, dtype=object) for t in terms])
    tf = np.concatenate([np.asarray(t, dtype=float) for t in tfs])
    col, vocab = pd.factorize(names)
    df = np.bincount(col, minlength=len(vocab))
    weight = tf * (np.log((1.0 + n) / (1.0 + df)) + 1.0)[col]
    norm = np.sqrt(np.bincount(row, weight**2, minlength=n))
    weight = weight / norm[row]

    def against(doc: int) -> np.ndarray:
        dense = np.zeros(len(vocab))
        mine = row == doc
        dense[col[mine]] = weight[mine]
        sims = np.bincount(row, weight * dense[col], minlength=n)
        return np.round(sims[1:], _SIM_DECIMALS)

    relevance = against(0)
    nearest = np.full(n - 1, -np.inf)
    free = np.ones(n - 1, dtype=bool)
    picks: list[int] = []
    gain = relevance
    while len(picks) < min(k, n - 1):
        pick = int(np.argmax(np.where(free, gain, -np.inf)))
        picks.append(pick)
        free[pick] = False
        nearest = np.maximum(nearest, against(pick + 1))
        gain = np.round(trade * relevance - (1.0 - trade) * nearest, _SIM_DECIMALS)
    return picks


def mmr(
    trade: float = 0.7,
    stop_words: str | tuple[str, ...] | None = "english",
    ngram_range: tuple[int, int] = (1, 2),
) -> Reranker:
    """Maximal marginal relevance; `trade` near 1 favours relevance, near 0 diversity.

    Scores stay those of the search. Relevance is to the question as asked, before
    dictionary expansion; ties go to the candidate ranked first.
    """
    options = TermOptions(
        stop_words=stop_words, ngram_range=ngram_range, min_df=ALL_TERMS.min_df, max_df=1.0
    )

    def rerank(pool: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        texts = pool.select("qid", F.col("rank").alias("slot"), "score", "chunk_id", "text")
        asked = questions.join(pool.select("qid").distinct(), "qid", "left_semi").select(
            "qid",
            F.lit(0).alias("slot"),
            F.lit(0.0).alias("score"),
            F.lit("").alias("chunk_id"),
            F.col("question").alias("text"),
        )
        counted = term_arrays(
            texts.unionByName(asked), "text", options, ["qid", "slot", "score", "chunk_id"]
        )
        rows = counted.select(
            "qid",
            "slot",
            "score",
            "chunk_id",
            F.col("counts.term").alias("terms"),
            F.col("counts.tf").alias("tfs"),
        )

        def select(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("slot", ignore_index=True)
            order = _choose(list(group["terms"]), list(group["tfs"]), k, trade)
            best = group.iloc[[i + 1 for i in order]]
            return pd.DataFrame(
                {
                    "qid": best["qid"].to_numpy(),
                    "rank": np.arange(1, len(best) + 1, dtype="int32"),
                    "score": best["score"].to_numpy(),
                    "chunk_id": best["chunk_id"].to_numpy(),
                }
            )

        key = counted.schema["qid"].dataType.simpleString()
        return rows.groupBy("qid").applyInPandas(
            select, f"qid {key}, rank int, score double, chunk_id string"
        )

    return rerank


RERANKERS: dict[str, Callable[[], Reranker]] = {"none": lambda: identity, "mmr": mmr}


def by_name(name: str) -> Reranker:
    if name not in RERANKERS:
        raise ValueError(f"unknown reranker {name!r}; use one of {sorted(RERANKERS)}")
    return RERANKERS[name]()
