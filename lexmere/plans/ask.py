"""Questions to ranked contexts, prompts and outline answers, as whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.functions.fixed import DEFAULT_EXPANSIONS
from lexmere.operators.context import (
    MODES,
    OLDER_MODES,
    contexts,
    drafts,
    evidence_lists,
    flat_contexts,
    mode_name,
    outline_answers,
    prompts,
    with_payload,
)
from lexmere.operators.index import LexicalIndex, public_id
from lexmere.operators.rerank import by_name
from lexmere.operators.search import search
from lexmere.session import written


def retrieve(
    index: LexicalIndex,
    questions: DataFrame,
    *,
    retriever: str = "bm25",
    rerank: str = "none",
    top_k: int = 8,
    pool_k: int = 30,
    dictionary=DEFAULT_EXPANSIONS,
) -> DataFrame:
    """(qid, rank, score, chunk_id, text, topic, title, page): pool, rerank, payload.

    Questions x top_k rows, written: several columns of the output are made from them.
    """
    found = search(index, questions, retriever=retriever, top_k_=pool_k, dictionary=dictionary)
    # rerankers know chunks by one column, so the unique key stands in for the id until the end
    pool = found.select("qid", "rank", "score", F.col("doc_key").alias("chunk_id"))
    reranker = by_name(rerank)
    if rerank == "none":
        results = with_payload(reranker(pool, questions, top_k), index.chunks)
    else:
        full = written(with_payload(pool, index.chunks), "pool")
        chosen = reranker(full, questions, top_k)
        results = chosen.join(full.drop("rank", "score"), ["qid", "chunk_id"])
    return written(results.withColumn("chunk_id", public_id()), "results")


def make_prompts(
    index: LexicalIndex,
    questions: DataFrame,
    *,
    mode: str = "cite_strict",
    max_chars: int = 1400,
    retriever: str = "bm25",
    rerank: str = "none",
    top_k: int = 8,
    pool_k: int = 30,
    dictionary=DEFAULT_EXPANSIONS,
) -> DataFrame:
    """Questions plus `prompt` and the `prompt_meta` record of the settings used."""
    mode = mode_name(mode)
    results = retrieve(
        index,
        questions,
        retriever=retriever,
        rerank=rerank,
        top_k=top_k,
        pool_k=pool_k,
        dictionary=dictionary,
    )
    settings = {
        "retriever": retriever,
        "rerank": rerank,
        "top_k": top_k,
        "pool_k": pool_k,
        "max_chars": max_chars,
        "mode": mode,
    }
    record = F.struct(*[F.lit(v).alias(k) for k, v in settings.items()])
    filled = prompts(questions, contexts(results, max_chars=max_chars), mode)
    return filled.withColumn("prompt_meta", record)


def fill_answers(
    index: LexicalIndex,
    questions: DataFrame,
    *,
    retriever: str = "bm25",
    top_k: int = 8,
    dictionary=DEFAULT_EXPANSIONS,
) -> DataFrame:
    """Questions with `answer` set to the citing outline of their results."""
    found = search(index, questions, retriever=retriever, top_k_=top_k, dictionary=dictionary)
    answers = outline_answers(found)
    rest = questions.drop("answer") if "answer" in questions.columns else questions
    return rest.join(answers, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def run_report(
    index: LexicalIndex,
    questions: DataFrame,
    *,
    mode: str = "explore",
    max_chars: int = 1400,
    outline: bool = True,
    **search_options,
) -> DataFrame:
    """Questions plus `evidence`, `draft` (unless turned off) and `prompt`.

    The older modes print the flat context.
    """
    mode = mode_name(mode, MODES + OLDER_MODES)
    results = retrieve(index, questions, **search_options)
    out = questions.join(evidence_lists(results), "qid", "left")
    if outline:
        out = drafts(out, results)
    layout = flat_contexts if mode in OLDER_MODES else contexts
    return prompts(out, layout(results, max_chars=max_chars), mode)
