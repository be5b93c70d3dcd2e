"""A growing index answers like one built over the rows it holds."""

import re

import pytest
from pyspark.sql import functions as F

from lexmere.operators import segments
from lexmere.operators.index import build_index, load_index, save_index
from lexmere.operators.ranking import numbered
from lexmere.operators.search import search
from lexmere.operators.segments import GrowingIndex
from lexmere.operators.terms import TermOptions
from tests.test_search import QUERIES, asked, corpus, frame, plan, results, same

QUESTIONS = [(q, None) for q in QUERIES] + [("alpha beta", "odd")]


def check(spark, growing, texts, topics, options=TermOptions()):
    want_index = build_index(frame(spark, texts, topics), options)
    index = growing.open()
    assert (index.n_docs, index.kept_tokens, index.n_vocabulary) == (want_index.n_docs, want_index.kept_tokens, want_index.n_vocabulary)
    questions = asked(spark, *QUESTIONS)
    for retriever in ("bm25", "tfidf"):
        want = results(search(want_index, questions, retriever=retriever))
        got = results(search(index, questions, retriever=retriever))
        assert got.keys() == want.keys()
        for qid in want:
            same(got[qid], want[qid])


@pytest.mark.parametrize("options", [TermOptions(), TermOptions(min_df=3, max_df=0.6)], ids=["plain", "bounds"])
def test_appends_deletes_and_compaction(spark, tmp_path, options):
    texts = corpus(31, 48)
    topics = {k: ["odd"] if i % 2 else ["even"] for i, k in enumerate(texts)}
    ids = list(texts)
    growing = GrowingIndex.create(spark, str(tmp_path / "index"), options)
    live = {}
    for part in range(3):
        mine = {k: texts[k] for k in ids[part::3]}
        growing.append(frame(spark, mine, topics))
        live |= mine
        if part == 1:
            dead = ids[3:20:3] + ids[4:20:3]
            assert growing.delete(spark.createDataFrame([(d,) for d in [*dead, "unknown"]], "chunk_id string")) == len(dead)
            live = {k: t for k, t in live.items() if k not in dead}
            check(spark, growing, live, topics, options)
    check(spark, growing, live, topics, options)
    before = growing.open()
    growing.compact()
    manifest = growing.manifest()
    assert len(manifest["segments"]) == 1 and not manifest["tombstones"]
    check(spark, growing, live, topics, options)
    assert before.chunks.count() == len(live)  # an opened version stays readable
    # a deleted id may come back, and goes again
    back = ids[3]
    growing.append(frame(spark, {back: texts[back]}, topics))
    assert growing.delete(spark.createDataFrame([(back,)], "chunk_id string")) == 1
    check(spark, growing, live, topics, options)
    save_index(growing.open(), str(tmp_path / "saved"), buckets=4)
    saved = load_index(spark, str(tmp_path / "saved"))
    want = results(search(growing.open(), asked(spark, *QUESTIONS)))
    got = results(search(saved, asked(spark, *QUESTIONS)))
    for qid in want:
        same(got[qid], want[qid])


def test_stream_adds_every_batch_once(spark, tmp_path):
    texts = corpus(32, 20)
    topics = {k: ["odd"] for k in texts}
    growing = GrowingIndex.create(spark, str(tmp_path / "index"))
    frame(spark, texts, topics).repartition(4).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("chunk_id string, text string, topic array<string>").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream = rows.writeStream.foreachBatch(growing.sink("files")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    stream.start().awaitTermination()
    manifest = growing.manifest()
    assert manifest["n_docs"] == 20 and len(manifest["segments"]) == manifest["streams"]["files"] + 1
    growing.sink("files")(frame(spark, {"again": "alpha"}, {}), manifest["streams"]["files"])  # a retried batch
    assert growing.manifest() == manifest
    check(spark, growing, texts, topics)


def test_a_version_is_published_once(spark, tmp_path):
    growing = GrowingIndex.create(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        growing.open()
    assert growing.delete(spark.createDataFrame([("x",)], "chunk_id string")) == 0
    with pytest.raises(Exception, match="(?i)exists"):
        growing._publish(growing.manifest())


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"), F.col("id").alias("x"))
    shown = numbered(df, "n", [F.col("v").desc()])
    assert "Window" not in shown._jdf.queryExecution().executedPlan().toString()
    rows = shown.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1000))
    assert [r["v"] for r in rows] == sorted((r["v"] for r in rows), reverse=True)


def test_more_statistics_are_merged_in_more_tasks(spark, tmp_path, monkeypatch):
    texts = corpus(32, 20)
    growing = GrowingIndex.create(spark, str(tmp_path / "index"))
    growing.append(frame(spark, texts))
    growing.append(frame(spark, {f"{k}b": t for k, t in texts.items()}))
    monkeypatch.setattr(segments, "MERGED_ROWS", 10)
    manifest = growing.manifest()
    rows = growing._read(manifest["segments"], "stats").count()
    merged = growing._merged(manifest)
    tasks = re.search(r"hashpartitioning\(term#\d+, (\d+)\), REPARTITION_BY_NUM", plan(merged))
    assert rows > 100 and int(tasks[1]) == -(-rows // 10)
    assert 2 * merged.count() == rows and merged.filter("df % 2 <> 0").isEmpty()
