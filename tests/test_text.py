from pyspark.sql import functions as F

from lexmere.functions import text


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_covers_unicode_spaces(spark):
    assert one(spark, "  a\t　b\n\x1cc\x1f ", text.clean) == "a b c"


def test_paragraphs_split_on_blank_lines(spark):
    raw = "a" * 80 + "\n \t\n" + "short" + "\n\n" + "b " * 60
    got = one(spark, raw, text.paragraphs)
    assert got == ["a" * 80, ("b " * 60).strip()]


def test_sentences_need_space_after_the_mark(spark):
    assert one(spark, "  あ。い。 う！え? お.  \n k ", text.sentences) == ["あ。い。", "う！え?", "お.", "k"]
    assert one(spark, "", text.sentences) == [""]
    assert one(spark, "no end", text.sentences) == ["no end"]


def test_lines_split_like_python(spark):
    raw = "a \r\nb c\x0b\n\n d\x85e f"
    want = [x.strip() for x in raw.splitlines() if x.strip()]
    assert one(spark, raw, text.lines) == want
    assert one(spark, raw, lambda c: text.units(c, "line")) == want


def test_ids_and_paths(spark):
    assert one(spark, "A b::p12::c3", lambda c: text.page_of(c)) == 12
    assert one(spark, "none", lambda c: text.page_of(c)) == 0
    assert one(spark, "/x/papers/econ/a.pdf", text.topic_of_path) == "econ"
    assert one(spark, "/x/papers", text.topic_of_path) == "misc"
    assert one(spark, "/x/other/a.pdf", text.topic_of_path) == "misc"


def test_topic_variants(spark):
    assert one(spark, '["a","b"]', text.topic_list) == ["a", "b"]
    assert one(spark, "[]", text.topic_list) == ["__unknown__"]
    assert one(spark, None, text.topic_list) == ["__unknown__"]
    assert one(spark, "plain", text.topic_list) == ["plain"]
    assert one(spark, "[odd", text.topic_list) == ["[odd"]
    assert one(spark, None, lambda c: text.topic_list(c, ())) == []


def test_keys_and_long_forms(spark):
    assert one(spark, "  Fixed \n Effects ", text.normal_key) == "fixed effects"
    assert one(spark, " ;. a  b , :", text.normal_long) == "a b"


def test_python_list_quotes(spark):
    for items in (["a"], [], ["it's", 'say "x"'], ["a", "b"]):
        df = spark.createDataFrame([(items,)], "v array<string>")
        assert df.select(text.python_list(F.col("v"))).first()[0] == str(items)


def test_printed_numbers_follow_the_exact_value(spark):
    import random

    from lexmere.functions.text import printed

    rng = random.Random(2)
    values = [0.125, 0.285, 0.295, 0.375, 1.005, 2.5, 0.0, -0.125, -0.001, 1e-13, 4e-12, 123456789.125, 1e15 + 0.5, 2.0**53, 0.99999, 0.5, 1.0]
    values += [rng.uniform(0, 1) for _ in range(500)] + [rng.uniform(-1e6, 1e6) for _ in range(300)] + [k / 1000 for k in range(300)]
    values += [2.0**k for k in range(-30, 40)] + [rng.randrange(10**6) / 2 ** rng.randrange(20) for _ in range(500)]
    values += [float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", printed(F.col("v"), 2).alias("two"), printed(F.col("v"), 4).alias("four")).collect()
    for r in rows:
        if r["v"] is None:
            assert r["two"] is None
        else:
            assert (r["two"], r["four"]) == (f"{r['v']:.2f}", f"{r['v']:.4f}")
