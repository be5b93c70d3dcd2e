import random

from pyspark.sql import functions as F

from lexmere.operators import chunking


def brute_pack(paras, target):
    """Cut points first: the run of paragraphs that starts at i is extended while it fits."""
    out, i = [], 0
    first = True
    while i < len(paras):
        size = len(paras[i]) + (1 if first and len(paras[i]) + 1 <= target else 0)
        first = False
        j = i + 1
        while j < len(paras) and size + len(paras[j]) + 1 <= target:
            size += len(paras[j]) + 1
            j += 1
        out.append(" ".join(paras[i:j]))
        i = j
    return out


def test_packing_and_overlap_match_brute_force(spark):
    rng = random.Random(7)
    docs = [
        ["x" * rng.choice([80, 399, 400, 599, 600, 1799, 1800, 2500, rng.randint(80, 900)])
         for _ in range(rng.randint(0, 12))]
        for _ in range(120)
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, p array<string>")
    got = df.select("i", chunking.packed(F.col("p")).alias("c")).select(
        "i", "c", chunking.with_overlap("c").alias("o")
    )
    for row in got.collect():
        want = brute_pack(docs[row["i"]], 1800)
        assert row["c"] == want
        tails = [c if k == 0 else (want[k - 1][-400:] + " " + c).strip() for k, c in enumerate(want)]
        assert row["o"] == tails


def page(text, number=1, stem="s", title=None, topic=None, path="/d/papers/t/s.pdf"):
    return (path, stem, title, topic, number, text)


SCHEMA = "path string, stem string, title string, topic string, page int, text_raw string"


def test_contents_rules(spark):
    leaders = "\n".join(f"Part {i} .... {i}" for i in range(8))
    short = "\n".join(f"Item {i} {i}" for i in range(12))
    pages = [
        page("My preferences are here", 300),  # 'references' inside a word, any page
        page("plain text", 2),
        page(leaders, 25),
        page(leaders, 26),
        page(short, 3),
        page("\n".join(f"Item {i} {i}" for i in range(7)), 4),
        page("\n".join(f"図{i}" for i in range(20)), 5),  # no boundary before the digits
        page("  \n\t", 6),
    ]
    rows = chunking.flag_pages(spark.createDataFrame(pages, SCHEMA)).collect()
    got = {(r["page"]): r["skip"] for r in rows}
    assert got == {300: True, 2: False, 25: True, 26: False, 3: True, 4: False, 5: False}


def test_chunk_records(spark):
    text = "\n\n".join("word " * 60 for _ in range(8))
    pages = [page(text, 3, title=" "), page(text, 4, stem="r", title="T ", topic="own")]
    rows = chunking.chunk_pages(spark.createDataFrame(pages, SCHEMA)).collect()
    assert [r["chunk_id"] for r in rows] == ["s::p3::c0", "s::p3::c1", "r::p4::c0", "r::p4::c1"]
    first, other = rows[0]["meta"], rows[2]["meta"]
    assert first["topic"] == ["t"] and other["topic"] == ["own"]
    assert other["title"] == "T" and first["source_type"] == "paper"
    assert rows[1]["text"].startswith(rows[0]["text"][-400:].strip())
    assert chunking.counts(chunking.chunk_pages(spark.createDataFrame(pages, SCHEMA))).first()[1] == 4


def test_skip_ratio_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chunking.skip_ratio(chunking.chunk_pages(empty)).first().asDict() == {
        "chunks": 0, "skip": 0, "skip_ratio": 0.0,
    }
