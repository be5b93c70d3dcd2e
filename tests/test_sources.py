import json

import pytest
from pyspark.sql import functions as F

from lexmere.operators import chunking
from lexmere.plans.ingest import ingest
from lexmere.sources import readers, writers
from lexmere.streaming.ingest import chunk_stream, page_stream

CHUNKS = [
    {"chunk_id": "a::p1::c0", "text": "one 日本", "meta": {"topic": ["x", "y"], "page": 1, "skip": False}},
    {"chunk_id": "a::p2::c0", "text": "two", "meta": {"topic": "solo", "page": 2, "skip": True}},
    {"chunk_id": "a::p3::c0", "text": "three", "meta": {"topic": []}},
    {"chunk_id": "a::p4::c0", "text": "four"},
]


def put(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n")
    return str(path)


def test_strict_reader_and_skip_rule(spark, tmp_path):
    path = put(tmp_path / "c.jsonl", CHUNKS)
    chunks = readers.read_chunks(spark, path)
    got = {r["chunk_id"]: r["topic"] for r in chunking.indexable(chunks).collect()}
    assert got == {"a::p1::c0": ["x", "y"], "a::p3::c0": [], "a::p4::c0": []}
    assert chunking.indexable(chunks, keep_skipped=True).count() == 4
    bad = put(tmp_path / "bad.jsonl", [*CHUNKS, "{oops"])
    with pytest.raises(Exception):
        readers.read_chunks(spark, bad).collect()


def test_chunks_with_meta_of_any_type(spark, tmp_path):
    metas = [
        {"topic": "t", "page": "12", "skip": "no"}, {"topic": ["a", 7], "page": 3.5, "skip": 0}, {"page": 2, "skip": []},
        {"skip": {"x": 1}, "title": 5}, {"skip": "", "topic": None}, {"skip": True}, None, [1], {"skip": False, "page": None},
    ]
    lines = [{"chunk_id": f"c{i}", "text": "x", "meta": m} for i, m in enumerate(metas)]
    rows = readers.read_chunks(spark, put(tmp_path / "m.jsonl", [*lines, ""])).orderBy("chunk_id").collect()
    got = [(r["meta"]["topic"], r["meta"]["page"], r["meta"]["skip"]) for r in rows]
    skips = [bool((m or {}).get("skip")) if isinstance(m, dict) else False for m in metas]
    assert [g[2] for g in got] == skips
    assert [g[1] for g in got] == ["12", "3.5", "2", None, None, None, None, None, None]
    assert [g[0] for g in got][:3] == [["t"], ["a", "7"], []] and rows[3]["meta"]["title"] == "5"
    for bad in ('{"chunk_id":"a"}', '{"text":"a"}', '{"chunk_id":1,"text":"a"}', '["a"]', "oops"):
        with pytest.raises(Exception, match="no chunk record"):
            readers.read_chunks(spark, put(tmp_path / "b.jsonl", [lines[0], bad])).collect()


def test_questions_of_one_id_keep_their_own_results(spark, tmp_path):
    from lexmere.operators.index import build_index
    from lexmere.plans.ask import fill_answers
    from tests.test_search import corpus, frame

    rows = [{"id": "q1", "question": "alpha"}, {"id": "q1", "question": "beta gamma"}, {"question": "strict"}, {"id": "row0", "question": "panel"}]
    asked = readers.read_questions(spark, put(tmp_path / "q.jsonl", rows))
    assert [r["question"] for r in asked.orderBy("qid").collect()] == [r["question"] for r in rows]
    index = build_index(frame(spark, corpus()))
    got = {r["question"]: r["answer"] for r in fill_answers(index, asked).collect()}
    for row in rows:
        single = spark.createDataFrame([("only", row["question"], None)], "qid string, question string, topic string")
        assert got[row["question"]] == fill_answers(index, single).first()["answer"] != ""


def test_tolerant_reader(spark, tmp_path):
    lines = [*CHUNKS, "", "{oops", {"content": "alt", "chunk_text": "no"}, {"text": "", "content": "no"}]
    rows = readers.read_records(spark, put(tmp_path / "r.jsonl", lines)).orderBy("pos").collect()
    assert [r["text"] for r in rows] == ["one 日本", "two", "three", "four", "alt", ""]
    assert [r["topics"] for r in rows][:3] == [["x", "y"], ["solo"], ["__unknown__"]]


def test_records_of_any_shape_are_kept(spark, tmp_path):
    lines = [
        {"text": "a", "meta": {"topic": "t", "page": "12"}},
        {"text": "b", "meta": {"topic": ["t", 7], "page": 3.5}},
        {"text": "c", "meta": {"topic": 5, "skip": "no"}},
        {"text": "d", "meta": {"topic": {"k": 1}}},
        {"text": "e", "meta": [1]},
        {"text": 7, "content": "f", "meta": None},
        {"content": None, "chunk_text": "g", "meta": {"topic": []}},
        "not json",
    ]
    rows = readers.read_records(spark, put(tmp_path / "v.jsonl", lines)).orderBy("pos").collect()
    assert [r["text"] for r in rows] == list("abcdefg")
    unknown = ["__unknown__"]
    assert [r["topics"] for r in rows] == [["t"], ["t", "7"], unknown, unknown, unknown, unknown, unknown]


def test_questions_keep_extra_keys(spark, tmp_path):
    rows = [{"id": "q1", "question": "why", "note": 5}, {"id": "q2", "question": "how", "topic": "t", "gold_chunk_ids": ["g"]}]
    got = readers.read_questions(spark, put(tmp_path / "q.jsonl", [rows[0], "", rows[1]]), extra="note int")
    writers.write_jsonl(got.drop("qid"), str(tmp_path / "out"), order_by=["id"])
    back = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert back == rows


def test_ingest_with_an_extractor(spark, tmp_path):
    for topic, name in (("b", "two.pdf"), ("a", "one.pdf"), ("a", "skip.txt")):
        folder = tmp_path / "papers" / topic
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(f"{name}|".encode() + b"word " * 100 + b"|")

    def extract(content):
        title, *pages = content.decode().split("|")
        return (None if title.startswith("two") else "A title"), pages

    out = str(tmp_path / "chunks")
    totals = ingest(spark, str(tmp_path / "papers"), out, ["b", "none", "a"], extract).first()
    assert (totals["n_files"], totals["n_chunks"]) == (2, 2)
    rows = {r["chunk_id"]: r for r in readers.read_chunks(spark, out).collect()}
    assert set(rows) == {"one::p1::c0", "two::p1::c0"}
    assert rows["two::p1::c0"]["meta"]["title"] == "two" and rows["one::p1::c0"]["meta"]["topic"] == ["a"]
    listed = readers.list_pdfs(spark, str(tmp_path / "papers"), ["b", "a"]).orderBy("topic_pos", "path")
    assert [r["stem"] for r in listed.collect()] == ["two", "one"]
    with pytest.raises(FileNotFoundError):
        readers.list_pdfs(spark, str(tmp_path / "papers"), ["none"])


def test_streamed_chunks_equal_batch_chunks(spark, tmp_path):
    pages = spark.createDataFrame(
        [("/p/papers/t/a.pdf", "a", "t", None, i, "word " * (40 * i)) for i in range(1, 6)],
        "path string, stem string, topic string, title string, page int, text_raw string",
    )
    pages.write.parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        chunk_stream(page_stream(spark, str(tmp_path / "pages")), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out).orderBy("chunk_id").collect()
    assert got == chunking.chunk_pages(pages).orderBy("chunk_id").collect()


def test_mining_reads_skipped_chunks(spark, tmp_path):
    chunks = readers.read_chunks(spark, put(tmp_path / "c.jsonl", CHUNKS))
    assert readers.as_records(chunks).count() == 4
    assert readers.as_records(chunks).filter(F.array_contains("topics", "__unknown__")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from lexmere.__main__ import parser, run

    chunks = [
        {"chunk_id": f"d::p{i}::c0", "text": f"kernel density estimate (KDE) works for group{i % 3} of panel{i % 2}",
         "meta": {"topic": ["t"], "page": i, "title": "T"}}
        for i in range(12)
    ]
    index = put(tmp_path / "c.jsonl", chunks)
    questions = put(tmp_path / "q.jsonl", [{"id": "1", "question": "group1 panel0", "topic": "t", "gold_chunk_ids": ["d::p4::c0"]}])

    def go(*argv):
        run(spark, parser().parse_args([str(a) for a in argv]))
        return capsys.readouterr().out

    go("fill-answers", "--index", index, "--evalset", questions, "--out", tmp_path / "answers")
    assert "1.0" in go("eval", "--index", index, "--evalset", tmp_path / "answers", "--unit", "line")
    go("fill-prompts", "--index", index, "--evalset", questions, "--out", tmp_path / "prompts", "--rerank", "mmr")
    assert any("cite_strict" in p.read_text() for p in (tmp_path / "prompts").glob("part-*"))
    go("suggest", "--chunks", index, "--out", tmp_path / "s")
    go("review", "--suggest", tmp_path / "s", "--out", tmp_path / "r", "--ngrams")
    decided = [json.loads(x) for p in sorted((tmp_path / "r").glob("part-*")) for x in p.read_text().splitlines()]
    pair = next(d for d in decided if d["kind"] == "abbr") | {"accept": True}
    diff = go("curate", "--decisions", put(tmp_path / "d.jsonl", [pair]), "--out", tmp_path / "dict")
    assert "+    'kde': ['kernel density estimate']," in diff
    out = go("search", "--index", index, "--question", "group1", "--dictionary", tmp_path / "dict")
    assert "d::p" in out
    assert "skip_ratio" in go("preview", "--chunks", index)
