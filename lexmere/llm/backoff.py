"""Stupid-backoff scores of documents against the rest of their own corpus.

A word's score given the words before it is the count of the longest n-gram that the other
documents hold, over the count of its context; every step to a shorter n-gram costs the
factor ALPHA, a word alone is counted against all words, and a word no other document has
counts half. The document's own occurrences are taken out of every count, so the longer
n-grams of a text that nothing resembles are not found. Scores are natural logarithms in
whole millionths, summed per document.

Batches of documents, dealt by a hash of their id, each list their distinct n-grams of all
orders once, with counts, in arrays by a hash bucket of the n-gram. Each bucket adds up
its part of the count table over all batches and joins the totals back to the lists, and
each batch scores its documents with what has come back. Frequent n-grams cost one entry
per batch, so no bucket is hot, and both sides of every step have bounded size: batches by
text, buckets by expected n-grams.

Words are runs without ASCII white space, A-Z lower-cased, known by 64-bit hashes.

Defined cases: a null or empty text has no words, score 0 and a null mean; rows of equal
doc_id are separate documents; a null doc_id is carried along; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.shingles import mix, word_hashes

ALPHA = 0.4
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 5 << 20  # of text whose n-grams one bucket takes
MIN_BUCKETS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document of each word, hashes of the n-gram that ends at each word, per order).

    Where a document has fewer words before, the entry is 0 and means nothing.
    """
    hashes, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, starts, side="right")
    grams = [mix(hashes)]
    for n in range(2, order + 1):
        longer = np.zeros(len(hashes), np.uint64)
        inside = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) + n - 1 if len(doc) >= n else np.zeros(0, np.int64)
        longer[inside] = mix(grams[-1][inside - 1] * _STEP + hashes[inside] + np.uint64(n))
        grams.append(longer)
    return doc, grams


def _listed(grams: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a batch and their counts, by bucket; and where buckets begin."""
    every, counts = np.unique(np.concatenate([g[g != 0] for g in grams]), return_counts=True)
    bucket = (every % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return every[order], counts[order], bucket[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _texts(batch: pa.Table) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


LISTS = "batch int, bucket int, grams array<long>, counts array<int>"


def _lists(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, grams = _grams(_texts(table), order)
        every, counts, bucket, cuts = _listed(grams, buckets)
        full = np.flatnonzero(np.diff(cuts))
        offsets = np.r_[cuts[full], len(every)].astype(np.int32)
        batch = table.column("batch")[0].as_py()
        return pa.table(
            {
                "batch": pa.array(np.full(len(full), batch, np.int32)),
                "bucket": pa.array(full.astype(np.int32)),
                "grams": pa.ListArray.from_arrays(offsets, pa.array(every.view(np.int64))),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
            }
        )

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Counts of one bucket over all batches, in the places of the lists they came in."""
    grams = table.column("grams").combine_chunks()
    counts = table.column("counts").combine_chunks()
    _, place = np.unique(grams.flatten().to_numpy(), return_inverse=True)
    sums = np.bincount(place, weights=counts.flatten().to_numpy()).astype(np.int64)
    offsets = np.r_[0, np.cumsum(grams.value_lengths().to_numpy())].astype(np.int32)
    totals = pa.ListArray.from_arrays(offsets, pa.array(sums[place]))
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "totals": totals})


SCORES = "doc_id long, n_words long, n_found long, score_micro long, mean_score double"


def _score(order: int, buckets: int, corpus: int, alpha: float):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        ids = docs.column("doc_id")
        n_docs = docs.num_rows
        doc, grams = _grams(_texts(docs), order)
        every, _, _, cuts = _listed(grams, buckets)
        known = np.zeros(len(every), np.int64)
        for bucket, values in zip(totals.column("bucket").to_pylist(), totals.column("totals")):
            known[cuts[bucket] : cuts[bucket + 1]] = values.values.to_numpy()
        by_hash = np.argsort(every)
        every, known = every[by_hash], known[by_hash]
        n_words = np.bincount(doc, minlength=n_docs)
        others = np.maximum(corpus - n_words, 1)[doc]

        def elsewhere(at: np.ndarray, gram: np.ndarray) -> np.ndarray:
            """Occurrences of each n-gram outside the document it stands in."""
            key = np.searchsorted(every, gram)
            pairs, place, own = np.unique(at.astype(np.int64) * len(every) + key, return_inverse=True, return_counts=True)
            return known[key] - own[place]

        alone = elsewhere(doc, grams[0]) if len(doc) else np.zeros(0, np.int64)
        score = np.log(np.where(alone > 0, alone, 0.5) / others)
        found = np.zeros(len(doc), bool)
        shorter = alone
        for n in range(2, order + 1):
            here = np.flatnonzero(grams[n - 1])
            count = np.zeros(len(doc), np.int64)
            count[here] = elsewhere(doc[here], grams[n - 1][here]) if len(here) else 0
            hit = here[count[here] > 0]
            longer = score + np.log(alpha)
            longer[hit] = np.log(count[hit] / shorter[hit - 1])
            score[here] = longer[here]
            found[hit] = True
            shorter = count
        micro = np.rint(score * 1e6).astype(np.int64)
        total = np.zeros(n_docs, np.int64)
        np.add.at(total, doc, micro)
        mean = pa.array(total / 1e6 / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.table(
            {
                "doc_id": ids,
                "n_words": pa.array(n_words.astype(np.int64)),
                "n_found": pa.array(np.bincount(doc[found], minlength=n_docs).astype(np.int64)),
                "score_micro": pa.array(total),
                "mean_score": mean,
            }
        )

    return run


def corpus_words(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(words, bytes) of the whole corpus: two sums."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)))
    row = docs.agg(F.sum(words).alias("words"), F.sum(F.octet_length(text)).alias("bytes")).first()
    return int(row["words"] or 0), int(row["bytes"] or 0)


def backoff_scores(docs: DataFrame, *, order: int = 2, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_found, score_micro, mean_score), one row per input row.

    n_found counts the words scored by an n-gram of two words or more.
    """
    if order < 1:
        raise ValueError("the order of an n-gram is at least 1")
    words, size = corpus_words(docs, text)
    batches = max(1, -(-size // BATCH_BYTES))
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    dealt = docs.select(
        F.pmod(F.xxhash64(doc_id), F.lit(batches)).cast("int").alias("batch"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    )
    grouped = dealt.groupBy("batch")
    lists = grouped.applyInArrow(_lists(order, buckets), LISTS)
    totals = lists.groupBy("bucket").applyInArrow(_totals, "batch int, bucket int, totals array<long>")
    return grouped.cogroup(totals.groupBy("batch")).applyInArrow(_score(order, buckets, words, alpha), SCORES)
