"""BM25 and TF-IDF retrieval for batches of questions.

Both searches have the same shape. The few terms a batch asks for are broadcast
(their number is checked) against the term rows, so the corpus is read without a
shuffle and only matching rows go on. Those are joined to a per-chunk number (length
or norm) by chunk id, and the scores per chunk and question reuse that partitioning.
Each task then keeps its own best k chunks per question before the last shuffle.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.operators.expansion import dictionary_table, expand_questions
from lexmere.operators.ranking import by_score, top_k
from lexmere.operators.terms import bm25_idf, smooth_idf, term_rows
from lexmere.operators.index import LexicalIndex, public_id
from lexmere.operators.scoring import asked_terms, stripe_scores
from lexmere.session import at_most, join_probe, small, written

RETRIEVERS = ("bm25", "tfidf")
BOUND_SLACK = 1e-8  # more than ranks tell apart and than sums of another order differ by


def as_dictionary(spark, dictionary) -> DataFrame | None:
    if dictionary is None or isinstance(dictionary, DataFrame):
        return dictionary
    return dictionary_table(spark, dictionary)


def question_terms(questions: DataFrame, index: LexicalIndex) -> DataFrame:
    """(qid, q_topic, term, qtf) of the expanded questions, vocabulary not yet applied.

    A written table: several joins use it and expansion should run once.
    """
    rows = term_rows(questions, "expanded", index.options, ["qid", "topic"])
    return written(
        rows.select("qid", F.col("topic").alias("q_topic"), "term", F.col("tf").alias("qtf")),
        "question-terms",
    )


def _wanted(index: LexicalIndex, terms: DataFrame, fits: bool) -> DataFrame:
    """(term, df) of the vocabulary terms the questions use."""
    distinct = terms.select("term").distinct()
    return index.vocabulary().select("term", "df").join(small(distinct, fits), "term")


def _pair_scores(hits: DataFrame, weighted: DataFrame, fits: bool, value: Column) -> DataFrame:
    """Sum of `value` over the terms a question and a chunk share, per (chunk_id, qid).

    A question with a topic only meets chunks that carry it; statistics are untouched.
    """
    met = join_probe(hits, weighted, "term", fits, by="chunk_id").filter(
        F.col("q_topic").isNull() | F.array_contains("topic", F.col("q_topic"))
    )
    return met.groupBy("chunk_id", "qid").agg(F.sum(value).alias("score"))


def _bm25_hits(index: LexicalIndex, wanted: DataFrame, fits: bool) -> DataFrame:
    """(chunk_id, topic, dl, term, tf) of the wanted terms, in-vocabulary length included."""
    if index.postings is not None:
        return index.stored_rows(wanted.select("term"), fits)
    found = index.asked_rows(wanted, fits)
    dl = F.col("n_terms") - F.coalesce("lost", F.lit(0))
    return found.join(index.dropped_tokens(), "chunk_id", "left").select(
        "chunk_id", "topic", dl.alias("dl"), "term", "tf"
    )


def impact(avgdl: float, k1: float, b: float):
    """BM25's share of a posting apart from the idf, of (tf, dl, norm); grows with tf and falls with dl."""
    return lambda tf, dl, norm=None: tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / (avgdl + 1e-12)) + 1e-12)


def bm25_weights(index: LexicalIndex, questions: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(qid, q_topic, term, idf) of the questions' vocabulary terms, those terms, and
    whether they fit a broadcast."""
    terms = question_terms(questions, index)
    fits = at_most(terms)
    idf = bm25_idf(F.col("df"), index.n_docs)
    wanted = written(_wanted(index, terms, fits).select("term", idf.alias("idf")), "wanted-terms")
    return terms.join(small(wanted, fits), "term").select("qid", "q_topic", "term", "idf"), wanted, fits


def _saved_scores(index: LexicalIndex, weighted: DataFrame, weight: str, share, k: int | None) -> DataFrame:
    """(chunk_id, qid, score) over a saved index, for terms that fit a broadcast."""
    asked = asked_terms(written(weighted, "weighted-terms"), weight)
    blocks = index.stored_blocks(asked.terms, True)
    return stripe_scores(blocks, index.facts, index.range_chunks, asked, share, k).select("chunk_id", "qid", "score")


def bm25_scores(
    index: LexicalIndex, questions: DataFrame, *, k1: float = 1.5, b: float = 0.75, k: int | None = None
) -> DataFrame:
    """(chunk_id, qid, score) for every chunk that shares a vocabulary term.

    With `k`, chunks that cannot be among a question's k best may be missing.
    """
    weighted, wanted, fits = bm25_weights(index, questions)
    if index.postings is not None and fits:
        return _saved_scores(index, weighted, "idf", impact(index.avgdl, k1, b), k)
    norm = k1 * (1.0 - b + b * F.col("dl") / F.lit(index.avgdl + 1e-12))
    value = F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + norm + 1e-12)
    return _pair_scores(_bm25_hits(index, wanted, fits), weighted, fits, value)


def _tfidf_hits(index: LexicalIndex, wanted: DataFrame, fits: bool) -> DataFrame:
    """(chunk_id, topic, norm, term, tf) of the wanted terms, with the chunk's vector length."""
    if index.postings is not None:
        return index.stored_rows(wanted.select("term"), fits)
    found = join_probe(index.term_rows(), wanted.select("term"), "term", fits, by="chunk_id")
    facts = index.held_facts() if index.narrow else index.chunk_facts()
    return found.join(facts, "chunk_id").select("chunk_id", "topic", "norm", "term", "tf")


def _contenders(index: LexicalIndex, wanted: DataFrame, weighted: DataFrame, fits: bool, k: int) -> DataFrame:
    """(doc): every chunk that can be among the k best of a question, a written table.

    A score lies between the dot product over the upper and over the lower bound of the
    chunk's length; a chunk whose best case is below the k-th best worst case is out.
    """
    found = join_probe(index.term_rows(), wanted.select("term"), "term", fits, by="chunk_id")
    met = join_probe(found, weighted, "term", fits, by="chunk_id").filter(
        F.col("q_topic").isNull() | F.array_contains("topic", F.col("q_topic"))
    )
    dots = met.groupBy("doc", "qid").agg(F.sum(F.col("qw") * F.col("tf") * F.col("idf")).alias("dot"))
    cases = dots.join(index.norm_bounds(), "doc").select(
        "doc", "qid", (F.col("dot") / F.col("high")).alias("worst"), F.when(F.col("low") > 0, F.col("dot") / F.col("low")).alias("best")
    )
    cases = written(cases, "score-bounds", "zstd")
    last = top_k(cases.select("qid", "worst"), ["qid"], [F.col("worst").desc()], k).filter(F.col("rank") == k)
    last = written(last.select("qid", "worst"), "least-scores")
    reached = cases.drop("worst").join(small(last, at_most(last)), "qid", "left").filter(
        F.col("worst").isNull() | F.col("best").isNull() | (F.col("best") >= F.col("worst") - BOUND_SLACK)
    )
    return written(reached.select("doc").distinct(), "contenders")


def tfidf_scores(index: LexicalIndex, questions: DataFrame, k: int | None = None) -> DataFrame:
    """(chunk_id, qid, score): cosine of L2-normalised tf * idf vectors.

    With `k`, chunks that cannot be among a question's k best may be missing: where the
    vocabulary is too large for a broadcast, exact lengths are worked out for the others only.
    """
    if index.postings is None and index.forward is None and index.texts is not None:
        index = replace(index, forward=written(index.term_arrays(), "forward-index"))  # read several times
    terms = question_terms(questions, index)
    fits = at_most(terms)
    idf = smooth_idf(F.col("df"), index.n_docs)
    wanted = _wanted(index, terms, fits)
    weights = wanted.select("term", idf.alias("idf"))
    weighted = terms.join(small(weights, fits), "term").withColumn(
        "qw", F.col("qtf") * F.col("idf")
    )
    q_norm = weighted.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    weighted = weighted.join(q_norm, "qid").select(
        "qid", "q_topic", "term", "idf", (F.col("qw") / F.col("q_norm")).alias("qw")
    )
    if index.postings is not None and fits:
        weights_ = weighted.withColumn("weight", F.col("qw") * F.col("idf"))
        return _saved_scores(index, weights_, "weight", lambda tf, dl, norm: tf / norm, k)
    if k is not None and index.postings is None and index.head_floor() > 0:
        wanted, weighted = written(wanted, "wanted-terms"), written(weighted, "question-weights")
        index = index.narrowed(_contenders(index, wanted, weighted, fits, k))
    value = F.col("qw") * F.col("tf") * F.col("idf") / F.col("norm")
    return _pair_scores(_tfidf_hits(index, wanted, fits), weighted, fits, value)


def search(
    index: LexicalIndex,
    questions: DataFrame,
    *,
    retriever: str = "bm25",
    top_k_: int = 8,
    dictionary=None,
    k1: float = 1.5,
    b: float = 0.75,
) -> DataFrame:
    """(qid, rank, score, chunk_id, doc_key): the best chunks of each question.

    `doc_key` is the index's own key of the chunk, by which payload is joined.

    questions: (qid, question, topic or null). `dictionary` is a mapping or a
    dictionary table; None leaves questions as they are.
    """
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}; use one of {RETRIEVERS}")
    table = as_dictionary(questions.sparkSession, dictionary)
    asked = expand_questions(questions.select("qid", "question", "topic"), table)
    if retriever == "bm25":
        scores = bm25_scores(index, asked, k1=k1, b=b, k=top_k_)
    else:
        scores = tfidf_scores(index, asked, top_k_)
    ranked = top_k(scores, ["qid"], by_score("score", "chunk_id"), top_k_)
    return ranked.select("qid", "rank", "score", public_id().alias("chunk_id"), F.col("chunk_id").alias("doc_key"))

