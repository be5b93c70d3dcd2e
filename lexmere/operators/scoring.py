"""Scores over a saved index, summed in numpy for a stripe of neighbouring ranges at a time.

A batch asks for few terms, but each posting of a common one meets many questions. Pairs of
postings and questions are never rows: the postings of a stripe and what describes its chunks
meet in one task, which sums the pairs and passes on what can be among a question's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRIPE = 16  # ranges that are scored together
CELLS = 4_000_000  # sums or pairs held at a time
CUT_SLACK = 1e-8  # more than ranks tell apart


@dataclass(frozen=True)
class Asked:
    """The weighted terms of a batch of questions, for every task.

    terms: (term, term_id). questions: (question, qid). `starts` has the place of each term's
    first entry; an entry is a question's number, its topic's place in `topics` (-1 for none)
    and its weight.
    """

    terms: DataFrame
    questions: DataFrame
    starts: np.ndarray
    question: np.ndarray
    topic: np.ndarray
    weight: np.ndarray
    topics: list[str]
    n_questions: int


def asked_terms(weighted: DataFrame, weight: str) -> Asked:
    """`weighted` (qid, q_topic, term, `weight`), a written table that fits a broadcast."""
    spark = weighted.sparkSession
    rows = weighted.select("qid", "q_topic", "term", F.col(weight).cast("double").alias("weight")).toArrow().combine_chunks()
    qids = rows["qid"].combine_chunks().dictionary_encode("encode")
    terms = rows["term"].combine_chunks().dictionary_encode()
    topics = rows["q_topic"].combine_chunks().cast(pa.string()).dictionary_encode()
    term = terms.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms.dictionary)))))
    numbered = pa.table({"term": terms.dictionary, "term_id": pa.array(np.arange(len(terms.dictionary)), pa.int32())})
    named = pa.table({"question": pa.array(np.arange(len(qids.dictionary)), pa.int32()), "qid": qids.dictionary})
    return Asked(
        terms=spark.createDataFrame(numbered),
        questions=spark.createDataFrame(named),
        starts=starts,
        question=qids.indices.to_numpy()[order].astype(np.int64),
        topic=topics.indices.fill_null(-1).to_numpy()[order].astype(np.int64),
        weight=rows["weight"].to_numpy()[order],
        topics=topics.dictionary.to_pylist(),
        n_questions=len(qids.dictionary),
    )


def _on_topic(topic: pa.Array, topics: list[str]) -> np.ndarray:
    """For each chunk and each asked topic, whether it carries it; true in the last column."""
    out = np.zeros((len(topic), len(topics) + 1), bool)
    out[:, -1] = True
    if topics:
        code = pc.index_in(pc.list_flatten(topic), value_set=pa.array(topics, pa.string())).fill_null(-1).to_numpy()
        row = pc.list_parent_indices(topic).to_numpy()
        out[row[code >= 0], code[code >= 0]] = True
    return out


def _blocks_of_rows(row_of: np.ndarray, pairs_of: np.ndarray, rows: int, width: int) -> Iterator[tuple[int, int]]:
    """Borders of runs of rows, each with at most CELLS sums and about as many pairs."""
    ends = np.cumsum(np.bincount(row_of, pairs_of, minlength=rows))
    most, first = max(1, CELLS // max(1, width)), 0
    while first < rows:
        done = ends[first - 1] if first else 0
        last = min(first + most, max(first + 1, int(np.searchsorted(ends, done + CELLS, side="right"))))
        yield first, min(last, rows)
        first = min(last, rows)


def _sums(asked: dict, row: np.ndarray, term: np.ndarray, share: np.ndarray, rows: int, wanted=None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, sums[row, question]) of all rows; `row` ascends. Only the entries for which
    `wanted(row, entry)` holds count."""
    width = asked["n_questions"]
    starts = asked["starts"]
    n = starts[term + 1] - starts[term]
    for first, last in _blocks_of_rows(row, n, rows, width):
        a, b = np.searchsorted(row, (first, last))
        each = n[a:b]
        hit = np.repeat(np.arange(a, b), each)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(each) - each, each) + starts[term][hit]
        if wanted is not None:
            ok = wanted(row[hit], entry)
            hit, entry = hit[ok], entry[ok]
        cell = (row[hit] - first) * width + asked["question"][entry]
        yield first, np.bincount(cell, share[hit] * asked["weight"][entry], minlength=(last - first) * width).reshape(last - first, width)


def _shared(spark: SparkSession, asked: Asked):
    names = ("starts", "question", "topic", "weight", "topics", "n_questions")
    return spark.sparkContext.broadcast({n: getattr(asked, n) for n in names})


def range_sums(blocks: DataFrame, asked: Asked, share: Column) -> DataFrame:
    """(qid, range, bound): the sum over (term_id, range) rows, for the questions they meet."""
    shared = _shared(blocks.sparkSession, asked)

    def add(rows: pa.Table) -> pa.Table:
        held = shared.value
        ranges, row = np.unique(rows["range"].to_numpy(), return_inverse=True)
        order = np.argsort(row, kind="stable")
        parts = []
        for first, sums in _sums(held, row[order], rows["term_id"].to_numpy()[order], rows["share"].to_numpy()[order], len(ranges)):
            at, question = np.nonzero(sums)
            parts.append(pa.table({"question": pa.array(question, pa.int32()), "range": ranges[first + at], "bound": sums[at, question]}))
        return pa.concat_tables(parts)

    rows = blocks.select(F.floor(F.col("range") / STRIPE).alias("stripe"), "term_id", "range", share.alias("share"))
    found = rows.groupBy("stripe").applyInArrow(add, "question int, range long, bound double")
    return found.join(F.broadcast(asked.questions), "question").drop("question")


def stripe_scores(
    blocks: DataFrame, facts: DataFrame, range_chunks: int, asked: Asked, share: Callable, k: int | None = None, read: DataFrame | None = None
) -> DataFrame:
    """(qid, doc, chunk_id, score): sums of share * weight over the terms a question and a chunk
    have in common.

    `share(tf, dl, norm)` takes arrays. With `k`, chunks that
    are not among a stripe's k best of a question may be missing. With `read` (question, range),
    only those ranges are scored for a question.
    """
    shared = _shared(blocks.sparkSession, asked)
    size, listed_only = STRIPE * range_chunks, read is not None

    def score(hits: pa.Table, about: pa.Table) -> pa.Table:
        held = shared.value
        out = pa.schema([("question", pa.int32()), ("doc", pa.int64()), ("chunk_id", pa.string()), ("score", pa.float64())])
        if not len(hits) or not len(about):
            return out.empty_table()
        listed = about.filter(pc.is_null(about["doc"]))
        chunks = about.filter(pc.is_valid(about["doc"])).combine_chunks().sort_by("doc")
        docs = chunks["doc"].to_numpy()
        doc, term, tf = (hits[c].to_numpy() for c in ("doc", "term_id", "tf"))
        row = np.searchsorted(docs, doc)
        known = row < len(docs)
        known[known] = docs[row[known]] == doc[known]
        order = np.flatnonzero(known)
        order = order[np.argsort(row[order], kind="stable")]
        row, term, tf = row[order], term[order], tf[order]
        value = share(tf.astype(float), chunks["dl"].to_numpy()[row].astype(float), chunks["norm"].to_numpy()[row])
        carried = _on_topic(chunks["topic"].combine_chunks(), held["topics"]) if held["topics"] else None
        range_of = docs // range_chunks
        low = range_of[0] if len(docs) else 0
        allowed = None
        if listed_only:
            allowed = np.zeros((int(range_of[-1] - low) + 1 if len(docs) else 0, held["n_questions"]), bool)
            at = listed["asked_range"].to_numpy() - low
            inside = (at >= 0) & (at < len(allowed))
            allowed[at[inside], listed["question"].to_numpy()[inside]] = True

        def wanted(of: np.ndarray, entry: np.ndarray) -> np.ndarray:
            ok = np.ones(len(of), bool)
            if carried is not None:
                ok &= carried[of, held["topic"][entry]]
            if allowed is not None:
                ok &= allowed[range_of[of] - low, held["question"][entry]]
            return ok

        ids, parts = chunks["chunk_id"].combine_chunks(), [out.empty_table()]
        for first, sums in _sums(held, row, term, value, len(docs), wanted if carried is not None or allowed is not None else None):
            if k is not None and len(sums) > k:
                least = np.partition(sums, len(sums) - k, axis=0)[len(sums) - k]
                at, question = np.nonzero((sums >= least - CUT_SLACK) & (sums != 0))
            else:
                at, question = np.nonzero(sums)
            parts.append(pa.table([pa.array(question, pa.int32()), pa.array(docs[first + at]), ids.take(pa.array(first + at)), pa.array(sums[at, question])], schema=out))
        return pa.concat_tables(parts)

    stripe = F.floor(F.col("doc") / size).alias("stripe")
    hits = blocks.select("term_id", F.inline("docs")).select(stripe, "term_id", "doc", "tf")
    about = facts.select(stripe, "doc", "chunk_id", "topic", "dl", "norm")
    if read is not None:
        about = about.unionByName(
            read.select(F.floor(F.col("range") / STRIPE).alias("stripe"), F.col("range").alias("asked_range"), "question"), allowMissingColumns=True
        )
    found = hits.groupBy("stripe").cogroup(about.groupBy("stripe")).applyInArrow(score, "question int, doc long, chunk_id string, score double")
    return found.join(F.broadcast(asked.questions), "question").drop("question")
