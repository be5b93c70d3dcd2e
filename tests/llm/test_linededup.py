import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmere.llm.cuckoo import CuckooFilter
from lexmere.llm.linededup import LineIndex

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    line = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    return line if len(line) >= 10 else None


def brute(docs):
    holders = {}
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def make(rng, n):
    pool = [f"A Shared line number {i}é " for i in range(12)] + ["short", "", "  ", "\tTabbed LINE here\r"]
    return {i: "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {rng.random()}" for _ in range(rng.randrange(6))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, h1 string")


def result(index, spark, docs):
    rows = index.apply(frame(spark, docs)).collect()
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in rows}


def test_keys_of_one_shard_fill_the_filter_evenly():
    rng = np.random.default_rng(4)
    h1, h2 = (rng.integers(0, 2**64, 3000, np.uint64) for _ in range(2))
    h1 = h1 // np.uint64(1024) * np.uint64(1024) + np.uint64(7)
    have = CuckooFilter(200)
    for at in range(0, 3000, 150):
        have.insert(h1[at : at + 150], h2[at : at + 150])
        assert have.contains(h1[: at + 150], h2[: at + 150]).all()
    assert all(t.shape[1] == 4 for t in have.tables)
    assert sum(int(np.count_nonzero(t)) for t in have.tables) == 3000


def test_a_widened_filter_takes_more_keys():
    same = np.full(300, 5 << 32, np.uint64)
    h2 = np.arange(300, dtype=np.uint64) * np.uint64(65535)  # one fingerprint for all: two buckets
    have = CuckooFilter(2000)
    for at in range(0, 300, 60):
        have.insert(same[at : at + 60], h2[at : at + 60])
        have = CuckooFilter.from_bytes(have.to_bytes())
    assert have.contains(same, h2).all() and have.tables[0].shape[1] > 4
    have.delete(same, h2)
    assert not any(t.any() for t in have.tables)


def test_a_corpus_comes_in_batches_that_ask_the_filters(spark, tmp_path):
    docs = make(random.Random(8), 60)
    rows = frame(spark, docs).unionByName(frame(spark, {3: docs[3], 4: docs[4]}))
    rows = rows.unionByName(spark.createDataFrame([(None, "a line without an id", "x")] * 2, rows.schema))
    index = LineIndex(spark, f"{tmp_path}/a", shards=4)
    index.insert_corpus(rows, batches=3)
    assert index.batch == 3 and result(index, spark, docs) == brute(docs)
    assert spark.read.parquet(f"{tmp_path}/a/held").count() > 0
    # with filters that deny known keys, lines of two batches are no longer found
    blind = LineIndex(spark, f"{tmp_path}/b", shards=4)
    blind.insert(frame(spark, {1: "one line that is shared"}))
    shards = [(k, CuckooFilter().to_bytes()) for k in range(4)]
    spark.createDataFrame(shards, blind.FILTERS).write.mode("overwrite").parquet(f"{tmp_path}/b/filters/batch=1")
    blind.insert(frame(spark, {2: "one line that is shared"}))
    assert blind.duplicate_keys().count() == 0


def test_batches_and_deletions_equal_a_fresh_run(spark, tmp_path):
    rng = random.Random(5)
    docs = make(rng, 60)
    docs[7] = None
    index = LineIndex(spark, str(tmp_path), shards=4)
    first = {i: t for i, t in docs.items() if i % 3}
    index.insert(frame(spark, first))
    assert result(index, spark, first) == brute(first)
    index.insert(frame(spark, {i: t for i, t in docs.items() if i % 3 == 0}))
    assert result(index, spark, docs) == brute(docs)
    gone = [0, 1, 2, 3, 9, 10, 30]
    index.delete(frame(spark, {i: "" for i in gone}))
    left = {i: t for i, t in docs.items() if i not in gone}
    again = LineIndex(spark, str(tmp_path))
    assert again.batch == 3
    assert result(again, spark, left) == brute(left)
    back = {i: docs[i] for i in gone[:4]}
    again.insert(frame(spark, back))
    assert result(again, spark, {**left, **back}) == brute({**left, **back})


def test_edges(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "e"), shards=2)
    empty = frame(spark, {}) if False else spark.createDataFrame([], "doc_id long, text string")
    index.insert(empty)
    assert index.apply(empty).collect() == []
    rows = [(None, "the same line"), (1, "the same line"), (1, "the same line"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drops", F.lit(1))
    index = LineIndex(spark, str(tmp_path / "f"), shards=2)
    index.insert(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_text) for r in index.apply(docs).collect())
    assert got == [(False, 1, 1, 0, "the same line"), (False, 1, 1, 0, "the same line"), (False, 2, 1, 0, ""), (True, 0, 1, 1, "")]


@pytest.mark.parametrize("n", [1, 100, 20_000])
def test_filter_holds_everything_and_forgets_what_is_deleted(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    f = CuckooFilter(n // 3)
    for part in np.array_split(np.arange(n), 4):
        f.insert(h1[part], h2[part])
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(h1, h2).all()
    half = n // 2
    f.delete(h1[:half], h2[:half])
    assert f.contains(h1[half:], h2[half:]).all()
    assert f.contains(h1[:half], h2[:half]).mean() < 0.01 if half else True
    assert sum(np.count_nonzero(t) for t in f.tables) == n - half


def test_filter_with_many_equal_buckets():
    h1 = np.full(40, 3, np.uint64)
    h2 = np.arange(40).astype(np.uint64) % np.uint64(3)
    f = CuckooFilter(64)
    f.insert(h1, h2)
    assert f.contains(h1, h2).all()
    assert sum(np.count_nonzero(t) for t in f.tables) == 40
