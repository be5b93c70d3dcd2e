import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexmere.operators import counting
from lexmere.operators import index as index_module
from lexmere.operators import terms as terms_module
from lexmere.operators.context import with_payload
from lexmere.operators.index import build_index, load_index, save_index
from lexmere.operators.search import search
from lexmere.operators.terms import TermOptions
from tests.brute import Corpus, ranked, terms

WORDS = (
    "alpha beta gamma delta the of strict exogeneity panel policy gradient clip ratio "
    "exogeneityとは 図表 naïve x2 z 12 kl"
).split()


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    texts = {
        f"d{i:02d}": " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) + " everywhere"
        for i in range(n)
    }
    texts["d05"] = texts["d04"]  # equal scores
    texts["d06"] = ""
    return texts


def frame(spark, texts, topics=None):
    rows = [(k, t, (topics or {}).get(k, ["all"])) for k, t in texts.items()]
    return spark.createDataFrame(rows, "chunk_id string, text string, topic array<string>")


def asked(spark, *pairs):
    rows = [(i, q, t) for i, (q, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "qid int, question string, topic string")


def results(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["chunk_id"], r["score"]))
    return out


def same(got, want):
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


QUERIES = ["strict exogeneity panel", "strict exogeneityとは？", "policy POLICY clip of the", "図表 x2 alpha beta"]


@pytest.mark.parametrize(
    "options", [(2, 0.95), (3, 0.6), (1, 1.0), (4, 0.3)], ids=lambda o: f"df{o[0]}-{o[1]}"
)
def test_both_searches_match_brute_force(spark, options):
    low, high = options
    texts = corpus()
    plain = Corpus(texts, low, high)
    index = build_index(frame(spark, texts), TermOptions(min_df=low, max_df=high))
    assert index.avgdl == pytest.approx(plain.avgdl)
    lengths = {r[0]: r[1] for r in index.chunk_lengths().collect()}
    assert lengths == plain.dl
    questions = asked(spark, *[(q, None) for q in QUERIES])
    bm25 = results(search(index, questions, top_k_=10))
    cosine = results(search(index, questions, retriever="tfidf", top_k_=10))
    for i, q in enumerate(QUERIES):
        same(bm25.get(i, []), ranked(plain.bm25(q), 10))
        same(cosine.get(i, []), ranked(plain.cosine(q), 10))


def test_long_tail_norms_and_shuffle_joins_agree(spark, monkeypatch):
    """With a tiny broadcast bound every side takes its other way; results stay."""
    texts = corpus(11, 60)
    index = build_index(frame(spark, texts))
    questions = asked(spark, *[(q, None) for q in QUERIES])
    before = [results(search(index, questions, retriever=r)) for r in ("bm25", "tfidf")]
    monkeypatch.setattr(index_module, "BROADCAST_ROWS", 20)
    monkeypatch.setattr("lexmere.operators.search.at_most", lambda df: False)
    assert index.head_floor() > 0
    after = [results(search(index, questions, retriever=r)) for r in ("bm25", "tfidf")]
    for old, new in zip(before, after):
        for qid in old:
            same(new[qid], old[qid])


def test_topic_narrows_results_not_statistics(spark):
    texts = corpus()
    topics = {k: (["odd"] if i % 2 else ["even", "all"]) for i, k in enumerate(texts)}
    index = build_index(frame(spark, texts, topics))
    questions = asked(spark, ("strict panel", None), ("strict panel", "odd"), ("strict panel", "none"))
    got = results(search(index, questions, top_k_=100))
    assert got[1] == [x for x in got[0] if topics[x[0]] == ["odd"]]
    assert 2 not in got


def test_saved_index_gives_the_same_answers(spark, tmp_path):
    texts = corpus(5)
    index = build_index(frame(spark, texts))
    save_index(index, str(tmp_path), buckets=8)
    opened = load_index(spark, str(tmp_path))
    questions = asked(spark, ("strict exogeneity", None), ("alpha gamma", "all"))
    for name in ("bm25", "tfidf"):
        want = results(search(index, questions, retriever=name))
        got = results(search(opened, questions, retriever=name))
        for qid in want:
            same(got[qid], want[qid])


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_corpora_have_no_vocabulary(spark, n):
    texts = {f"d{i}": "alpha beta" for i in range(n)}
    index = build_index(frame(spark, texts))
    assert index.n_docs == n and index.avgdl == 0
    assert search(index, asked(spark, ("alpha", None))).count() == 0


def test_expansion_joins_the_query(spark):
    texts = corpus()
    plain = Corpus(texts)
    index = build_index(frame(spark, texts))
    words = {"strict": ["policy gradient", "CLIP"], "kl": ["ratio"]}
    questions = asked(spark, ("strictly weekly", None))
    got = results(search(index, questions, dictionary=words, top_k_=5))
    same(got[0], ranked(plain.bm25("strictly weekly policy gradient CLIP ratio"), 5))


def test_term_rows_count_like_a_counter(spark):
    from collections import Counter

    texts = corpus(9, 15)
    rows = terms_module.term_rows(frame(spark, texts), "text", TermOptions(), ["chunk_id"])
    got = {}
    for r in rows.collect():
        got.setdefault(r["chunk_id"], {})[r["term"]] = r["tf"]
    assert got == {k: dict(Counter(terms(t))) for k, t in texts.items() if terms(t)}


def test_trigrams_and_case(spark):
    df = spark.createDataFrame([("d", "One two Three one two Three")], "chunk_id string, text string")
    options = TermOptions(lowercase=False, stop_words=("two",), ngram_range=(2, 3))
    rows = terms_module.term_rows(df, "text", options, ["chunk_id"]).collect()
    assert {r["term"]: r["tf"] for r in rows} == {
        "One Three": 1, "Three one": 1, "one Three": 1, "One Three one": 1, "Three one Three": 1,
    }


def test_unknown_retriever(spark):
    with pytest.raises(ValueError):
        search(build_index(frame(spark, corpus())), asked(spark, ("a", None)), retriever="x")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_narrow(spark):
    index = build_index(frame(spark, corpus()))
    rows = plan(index.term_rows())  # no text is split again
    assert rows.count("split(") == 0 and "Exchange" not in rows
    rows = plan(terms_module.term_rows(index.chunks, "text", TermOptions(), ["chunk_id"]))
    assert rows.count("split(") == 1 and "Exchange" not in rows
    found = plan(search(index, asked(spark, ("alpha", "all"))))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in found
    assert "WindowGroupLimit" in found


def test_top_k_beyond_the_group_limit(spark):
    from lexmere.operators.ranking import top_k

    df = spark.range(5000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 5003).alias("s"))
    got = top_k(df, ["g"], [F.col("s").desc()], 1500).collect()
    rows = df.collect()
    for g in (0, 1):
        want = sorted((r["s"] for r in rows if r["g"] == g), reverse=True)[:1500]
        assert [r["s"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == want


def test_repeated_ids_are_separate_chunks(spark):
    rows = [("a::p1::c0", "alpha beta gamma", ["t1"]), ("a::p1::c0", "alpha delta alpha", ["t2"])]
    rows += [(f"b{i}::p1::c0", "beta gamma delta words", ["t1"]) for i in range(5)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, topic array<string>")
    chunks = chunks.withColumn("title", F.lit("")).withColumn("page", F.lit(1))
    index = build_index(chunks)
    found = with_payload(search(index, asked(spark, ("alpha", None))), index.chunks)
    got = {r.text: (r.chunk_id, r.score) for r in found.collect()}
    assert {t: c for t, (c, _) in got.items()} == {"alpha beta gamma": "a::p1::c0", "alpha delta alpha": "a::p1::c0"}
    unique = chunks.withColumn("chunk_id", F.concat("chunk_id", F.col("topic")[0]))
    plain = search(build_index(unique), asked(spark, ("alpha", None))).collect()
    assert sorted(round(r.score, 9) for r in plain) == sorted(round(s, 9) for _, s in got.values())


def test_chunks_that_nothing_tells_apart_are_all_indexed(spark):
    rows = [("x", "alpha beta", "t"), ("x", "alpha beta", "t"), ("x", "alpha gamma gamma", "t"), ("y", "gamma beta delta", "t"), ("z", "delta alpha", "u")]
    chunks = spark.createDataFrame([(c, t, [k]) for c, t, k in rows], "chunk_id string, text string, topic array<string>")
    index = build_index(chunks)
    keys = [r.chunk_id for r in index.chunks.collect()]
    assert len(set(keys)) == 5 and {"y", "z"} < set(keys)  # only repeated ids are lengthened
    assert {r.chunk_id for r in index.forward.collect()} == set(keys)
    unique = chunks.withColumn("chunk_id", F.concat("chunk_id", F.monotonically_increasing_id()))
    ask = asked(spark, ("alpha gamma", None))
    want = sorted(round(r.score, 9) for r in search(build_index(unique), ask).collect())
    found = search(index, ask).collect()
    assert sorted(round(r.score, 9) for r in found) == want
    assert {r.chunk_id for r in found} == {"x", "y", "z"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_saved_index_reads_only_what_is_asked(spark, tmp_path):
    texts = corpus(5)
    index = build_index(frame(spark, texts).withColumn("title", F.lit("")).withColumn("page", F.lit(1)))
    save_index(index, str(tmp_path), buckets=8)
    opened = load_index(spark, str(tmp_path))
    wanted = opened.vocabulary().select("term").filter("term IN ('alpha', 'beta')")
    read = plan(opened.stored_rows(wanted, True))
    assert "bucket" in read.split("PartitionFilters:")[1].split("]")[0]
    assert "In(term" in read
    found = search(opened, asked(spark, ("alpha gamma", None)), top_k_=3)
    payload = with_payload(found, opened.chunks)
    assert "folder" in plan(payload).split("PartitionFilters:")[1].split("]")[0]
    assert {r.chunk_id: r.text for r in payload.collect()} == {r.chunk_id: texts[r.chunk_id] for r in found.collect()}
    large = {(r.chunk_id, r.term) for r in opened.stored_rows(wanted, False).collect()}
    assert large == {(r.chunk_id, r.term) for r in opened.stored_rows(wanted, True).collect()} and large


def test_payload_of_many_ids_prunes_folders_and_shuffles_no_text(spark, tmp_path, monkeypatch):
    texts = {f"d{i:04d}": f"alpha beta word{i % 7}" for i in range(3000)}
    index = build_index(frame(spark, texts).withColumn("title", F.lit("")).withColumn("page", F.lit(1)))
    save_index(index, str(tmp_path), buckets=4)
    opened = load_index(spark, str(tmp_path))
    ids = spark.createDataFrame([(q, r + 1, 1.0, f"d{(q * 17 + r) % 3000:04d}") for q in range(50) for r in range(100)], "qid int, rank int, score double, chunk_id string")
    want = {(r.qid, r.chunk_id): texts[r.chunk_id] for r in ids.collect()}
    many = with_payload(ids, opened.chunks)
    assert "dynamicpruning" in plan(many).lower()
    for bound in (1_000_000, 3000, 10):  # one broadcast, groups of folders, plain join
        monkeypatch.setattr(index_module, "BROADCAST_ROWS", bound)
        found = with_payload(ids, opened.chunks)
        if bound > 10:
            assert "hashpartitioning" not in plan(found)
        assert {(r.qid, r.chunk_id): r.text for r in found.collect()} == want and found.count() == 5000


def test_norms_take_one_reading_and_one_shuffle_by_term(spark, monkeypatch):
    texts = corpus(11, 60)
    index = build_index(frame(spark, texts))
    want = {r.chunk_id: (r.dl, r.norm) for r in index.chunk_facts().collect()}
    whole = plan(index.chunk_facts())
    assert "split(" not in whole and whole.count("FileScan") == 2  # forward index and statistics
    monkeypatch.setattr(index_module, "BROADCAST_ROWS", 20)
    shown = plan(index.chunk_facts())
    assert "split(" not in shown and shown.count("FileScan") == 2
    assert shown.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in shown  # by term, then by chunk
    got = {r.chunk_id: (r.dl, r.norm) for r in index.chunk_facts().collect()}
    assert got.keys() == want.keys()
    for key, (dl, norm) in want.items():
        assert got[key][0] == dl and got[key][1] == pytest.approx(norm)
    plain = Corpus(texts)
    assert {k: v[0] for k, v in want.items()} == {k: v for k, v in plain.dl.items() if v}


def test_a_saved_posting_is_a_number_and_a_count(spark, tmp_path, monkeypatch):
    """What describes a chunk is kept once, not in each of its postings; folders of many
    postings are dealt over several tasks, each with whole blocks."""
    texts = corpus(5, 60)
    index = build_index(frame(spark, texts))
    questions = asked(spark, ("strict exogeneity", None), ("alpha gamma", "all"))
    for name, bound in (("one", index_module.BUCKET_POSTINGS), ("more", 40)):
        monkeypatch.setattr(index_module, "BUCKET_POSTINGS", bound)
        save_index(index, str(tmp_path / name), buckets=4, range_chunks=8)
        opened = load_index(spark, str(tmp_path / name))
        assert opened.postings.schema["docs"].dataType.elementType.fieldNames() == ["doc", "tf"]
        blocks = opened.postings.select("term", "range", "n", F.size("docs").alias("held"))
        assert blocks.count() == blocks.select("term", "range").distinct().count()
        assert blocks.filter("n <> held").isEmpty()
        assert blocks.agg(F.sum("n")).first()[0] == index.n_postings
        assert opened.chunk_lengths().orderBy("chunk_id").collect() == index.chunk_lengths().orderBy("chunk_id").collect()
        for retriever in ("bm25", "tfidf"):
            want = results(search(index, questions, retriever=retriever))
            got = results(search(opened, questions, retriever=retriever))
            for qid in want:
                same(got[qid], want[qid])


def test_statistics_are_hashed_not_sorted(spark):
    index = build_index(frame(spark, corpus()))
    shown = plan(terms_module.term_stats(terms_module.array_rows(index.forward), "doc"))
    assert "HashAggregate" in shown and "SortAggregate" not in shown
    assert dict(index.stats.dtypes)["only_doc"] == "bigint"


def test_payload_reads_chunks_where_they_lie(spark):
    """Neither spreading nor keying a small input is done again for payload."""
    chunks = frame(spark, corpus()).coalesce(1)
    assert "Exchange" not in plan(build_index(chunks).chunks)
    twice = build_index(chunks.unionByName(chunks)).chunks
    assert "Join" not in plan(twice) and "Window" not in plan(twice)
    assert twice.select("chunk_id").distinct().count() == twice.count() == 80


def test_cosine_search_works_out_few_exact_norms(spark, monkeypatch):
    """A tail too long for a broadcast: bounds hold, and only contenders get exact norms."""
    texts = corpus(11, 120) | {"once": "solitary unheard word", "pair": "solitary strict panel", "blank": ""}
    plain = Corpus(texts)
    index = build_index(frame(spark, texts))
    questions = asked(spark, *[(q, None) for q in QUERIES])
    norms = {r.doc: r.norm for r in index.forward.select("doc", "chunk_id").join(index.chunk_facts(), "chunk_id").collect()}
    monkeypatch.setattr(index_module, "BROADCAST_ROWS", index.n_vocabulary - 1)
    assert index.head_floor() > 0
    bounds = {r.doc: (r.low, r.high) for r in index.norm_bounds().collect()}
    assert all(bounds[d][0] - 1e-9 <= norm <= bounds[d][1] + 1e-9 for d, norm in norms.items())
    assert any(low > 0 for low, _ in bounds.values())

    def whole(self):
        raise AssertionError("norms of all chunks")

    monkeypatch.setattr(index_module.LexicalIndex, "chunk_facts", whole)
    got = results(search(index, questions, retriever="tfidf", top_k_=3))
    for i, q in enumerate(QUERIES):
        same(got.get(i, []), ranked(plain.cosine(q), 3))
    unnamed = replace(index, stats=index.stats.drop("only_doc"))  # as in a growing index
    again = results(search(unnamed, questions, retriever="tfidf", top_k_=3))
    for qid in got:
        same(again[qid], got[qid])


EVERY_KIND = "ab İstanbul ΑΣ ΑΣ. x\ufeffy naïve\u0301 e\u0301e 図表 𝒜𝒷 a_b ½x the of the ab\u200bcd  \x1f12 "


@pytest.mark.parametrize(
    "options",
    [TermOptions(), TermOptions(lowercase=False, stop_words=None, ngram_range=(1, 1)), TermOptions(ngram_range=(2, 3))],
    ids=["default", "words", "2-3"],
)
def test_batches_count_like_the_expressions(spark, options, monkeypatch):
    """Numpy counts over small and large batches equal those of the Spark expressions."""
    texts = [*corpus(2).values(), EVERY_KIND, EVERY_KIND * 2, "", None, "z" * 50, "ab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string").repartition(3)
    rows = terms_module.array_rows(terms_module.term_arrays(docs, "text", options, ["doc"]))
    stats = terms_module.term_stats(rows, "doc").collect()
    some = [r.term for r in stats][::3]

    def plain(found):
        return sorted((r.term, r.df, r.cf, r.only_doc if r.df == 1 else None) for r in found)

    for size in (counting.CHUNK, 40):
        monkeypatch.setattr(counting, "CHUNK", size)
        monkeypatch.setattr(counting, "OUT_ROWS", size)
        assert plain(counting.text_stats(docs, "text", options).collect()) == plain(stats)
        got = counting.asked_rows(docs, "text", options, ["doc"], some).select("doc", "n_terms", "term", "tf")
        want = rows.filter(F.col("term").isin(some)).select("doc", "n_terms", "term", "tf")
        assert sorted(got.collect()) == sorted(want.collect()) and some


def test_characters_of_words_are_those_of_spark(spark):
    inside = [bool(b) for c in counting.word_characters(spark) for b in f"{c:08b}".encode().translate(bytes.maketrans(b"01", b"\0\1"))]
    assert len(inside) == 0x110000
    assert all(inside[ord(c)] for c in "azAZ09_éß図ーと½𝒜") and not any(inside[ord(c)] for c in " \n\0.,-\ufeff\u200b\u0301😀")


@pytest.mark.parametrize("asked_terms", [100_000, 1], ids=["listed", "joined"])
def test_one_search_writes_no_forward_index(spark, monkeypatch, asked_terms):
    """F16 to F19: one batch of BM25 questions needs the statistics and the asked terms only."""
    monkeypatch.setattr(index_module, "ASKED_TERMS", asked_terms)
    names = []
    plain_written = index_module.written
    monkeypatch.setattr(index_module, "written", lambda df, name, *rest: names.append(name) or plain_written(df, name, *rest))
    for low, high in ((2, 0.95), (3, 0.6)):
        texts = corpus(7, 60)
        plain = Corpus(texts, low, high)
        index = build_index(frame(spark, texts), TermOptions(min_df=low, max_df=high), forward=False)
        assert index.forward is None and "forward-index" not in names and "numbered-texts" in names
        found = search(index, asked(spark, *[(q, None) for q in QUERIES]), top_k_=10)
        assert ("split(" in plan(found)) == (asked_terms == 1 or low > 2)
        got = results(found)
        for i, q in enumerate(QUERIES):
            same(got.get(i, []), ranked(plain.bm25(q), 10))
