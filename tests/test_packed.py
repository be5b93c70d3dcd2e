"""Terms counted in numpy, dealt as packed tables and merged, give what plain counting gives."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmere.operators import counting, packed, scoring
from lexmere.operators.index import build_index, load_index, save_index
from lexmere.operators.search import search
from tests.test_search import QUERIES, asked, corpus, frame, results, same


def test_hashes_of_terms_agree():
    words = ["ab", "图表", "a" * 300, "ab", ""]
    each = packed.word_hashes(pa.array(words, pa.string()))
    assert each[0] == each[3] and len(set(each.tolist())) == 4
    assert np.array_equal(packed.word_hashes(pa.array(["x", *words, "y"], pa.string()).slice(1, 5)), each)
    both = packed.joined_hash(each[:1], each[1:2])
    assert packed.term_hashes(["ab 图表", "ab"]).tolist() == [both[0], each[0]]
    assert packed.term_hashes(["图表 ab"])[0] != both[0]


def test_saved_without_counting_first(spark, tmp_path, monkeypatch):
    """F1 to F3: the texts are counted once, in several batches; no forward index or statistics
    are made besides, and blocks, lengths and scores are those of a built index."""
    texts = corpus(5, 90)
    topics = {k: ["odd", "odd"] if i % 2 else None for i, k in enumerate(texts)}
    plain = build_index(frame(spark, texts, topics))
    bare = build_index(frame(spark, texts, topics), counted=False)
    assert bare.stats is None and bare.forward is None
    for size, cells in ((counting.LIST_CHUNK, scoring.CELLS), (300, 50)):
        monkeypatch.setattr(counting, "LIST_CHUNK", size)
        monkeypatch.setattr(scoring, "CELLS", cells)
        save_index(bare, str(tmp_path / str(size)), buckets=4, range_chunks=4)
        opened = load_index(spark, str(tmp_path / str(size)))
        assert (opened.n_docs, opened.kept_tokens, opened.n_vocabulary, opened.n_postings) == (plain.n_docs, plain.kept_tokens, plain.n_vocabulary, plain.n_postings)
        want = {(r.term, r.df, r.cf) for r in plain.stats.collect()}
        assert {(r.term, r.df, r.cf) for r in opened.stats.collect()} == want
        blocks = opened.postings.withColumn("_r", F.floor(F.col("docs")[0]["doc"] / 4))
        assert blocks.filter("_r <> range OR max_tf <> array_max(docs.tf) OR n <> size(docs)").isEmpty()
        smallest = opened.facts.groupBy(F.floor(F.col("doc") / 4).alias("range")).agg(F.min("dl").alias("min_dl"))
        assert smallest.exceptAll(opened.lengths.select("range", "min_dl")).isEmpty() and opened.lengths.count() == smallest.count()
        # chunks of a range are about as long
        sizes = opened.chunks.join(opened.facts.select("chunk_id", "doc"), "chunk_id").select("doc", F.length("text").alias("len"))
        ordered = [r.len for r in sizes.filter(F.col("doc") < 2**33).orderBy("doc").collect()]
        assert ordered == sorted(ordered)
        questions = asked(spark, *[(q, t) for q in QUERIES for t in (None, "odd", "none")])
        questions = questions.unionByName(questions.limit(3))  # an id that comes twice counts twice
        for retriever in ("bm25", "tfidf"):
            expected = results(search(plain, questions, retriever=retriever, top_k_=5))
            got = results(search(opened, questions, retriever=retriever, top_k_=5))
            assert got.keys() == expected.keys() and len(got) == 8
            for qid in expected:
                same(got[qid], expected[qid])


def test_ordered_terms_are_those_of_the_expressions():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aa bb cc dd".split()) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    inside = np.zeros(counting.CODE_POINTS, bool)
    inside[ord("a") : ord("z") + 1] = True
    words = counting.Batch(pa.array(texts), inside, pa.array(["dd"]))
    got = {}
    for terms, hashes, n, place, count in words.ordered(1, 3, np.arange(40)[::-1].copy(), 40):
        row = np.repeat(np.arange(len(terms)), n)
        assert hashes.tolist() == packed.term_hashes(terms.to_pylist()).tolist()
        got |= {(terms[t].as_py(), 39 - int(p)): int(c) for t, p, c in zip(row, place, count)}
    want = {}
    for i, text in enumerate(texts):
        kept = [w for w in text.split() if w != "dd"]
        for n in (1, 2, 3):
            for at in range(len(kept) - n + 1):
                key = (" ".join(kept[at : at + n]), i)
                want[key] = want.get(key, 0) + 1
    assert got == want
