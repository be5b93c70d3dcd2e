"""Quality rules, near-dedup and backoff scores against brute force; the whole pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexmere.llm.backoff import backoff_scores
from lexmere.llm.common import components, join_counted
from lexmere.llm.neardedup import NearOptions, near_components
from lexmere.llm.quality import HostRules, judge, keep_good
from lexmere.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---- quality ----


def figures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, v in enumerate(zip(w, w[1:], w[2:])) if windows[v] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def brute_quality(rows, rules=HostRules()):
    failed, counts = [], defaultdict(lambda: [0, 0, 0, 0, 0])
    for _, text, host in rows:
        n, _, symbols, lines, dup, repeated = figures(text)
        tests = (n < 50, 100 * repeated > 50 * n, 100 * symbols > 10 * n, 100 * dup > 30 * lines)
        failed.append(tests[0] or tests[1])
        if host is not None:
            own = counts[host]
            own[0] += 1
            for k, t in enumerate(tests, 1):
                own[k] += t
    bad = set()
    for k in range(1, 5):
        rates = [c[k] / c[0] for c in counts.values()]
        mean = sum(rates) / len(rates)
        var = sum((r - mean) ** 2 for r in rates) / len(rates)
        s = min(max(mean * (1 - mean) / var - 1, 1), 1e6) if var > 0 else 1e6
        bad |= {h for h, c in counts.items() if (c[k] + mean * s) / (c[0] + s) > 0.5}
    return [(f, h in bad) for f, (_, _, h) in zip(failed, rows)]


def quality_rows(rng):
    rows = []
    for i in range(160):
        host = rng.choice(["good", "good", "junk", "tiny%d" % (i % 40), None])
        if host == "junk" and rng.random() < 0.9:
            text = "### " * 60 + "one two three " * rng.randrange(9)
        else:
            text = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 80, 90, 100))))
            text += "\nagain\n again\nagain\n\n" * rng.randrange(2)
        rows.append((i, text, host))
    return rows + [(900, None, "good"), (901, "", None), (None, "x y z x y z", "junk"), (902, "a b c " * 3000, "good")]


def test_quality_equals_brute_force(spark):
    rows = quality_rows(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in judge(df).collect()}
    want = brute_quality(rows)
    assert any(h for _, h in want) and not all(h for _, h in want)
    for (i, text, _), (base, host) in zip(rows, want):
        r = got[-1 if i is None else i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == figures(text)
        assert (r.base_failed, r.host_failed, r.kept) == (base, host, not base and not host)
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for (i, _, _), (b, h) in zip(rows, want) if not b and not h}
    assert judge(df.limit(0)).collect() == [] == keep_good(df.limit(0)).collect()


def test_many_hosts_are_joined_salted(spark, monkeypatch):
    rows = quality_rows(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, judge(df).collect()))
    monkeypatch.setattr("lexmere.llm.quality.BROADCAST_ROWS", -1)
    assert sorted(map(str, judge(df).collect())) == want


# ---- near-dedup ----


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_near(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_docs(rng):
    docs = []
    for group in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((1, 3, 30, 120, 400)))]
        for _ in range(rng.choice((1, 2, 25))):
            own = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            docs.append((rng.randrange(10**6), " ".join(own).upper() if rng.random() < 0.2 else "\n".join(own)))
    return list({i: (i, t) for i, t in docs}.values())


@pytest.mark.parametrize("block", [1024, 3])
def test_near_components_equal_brute_force(spark, block):
    docs = near_docs(random.Random(block)) + [(-5, ""), (-4, None), (-3, "one word"), (-2, "ONE\tword ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bands", F.lit(0)).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_components(df, NearOptions(block=block)).collect()}
    assert got == brute_near(docs)


def test_bands_follow_the_threshold():
    bands = {p: (o.bands, o.rows) for p in (100, 85, 80, 70, 50, 30, 10) for o in [NearOptions(percent=p)]}
    assert bands[85] == (32, 6) and bands[80] == (32, 5) and bands[70] == (32, 3)
    for p, (b, r) in bands.items():
        assert (1 - (p / 100) ** r) ** b <= 4e-6 and b * r <= 512
    assert (NearOptions(bands=8, rows=4).bands, NearOptions(bands=8, rows=4).rows) == (8, 4)
    for p in (0, 1, 101):
        with pytest.raises(ValueError):
            NearOptions(percent=p)


def test_near_components_at_half_equal_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for group in range(40):
        words = [f"g{group}w{j}" for j in range(60)]
        for k in range(2):
            own = list(words)
            for j in rng.sample(range(60), 2 * k):
                own[j] = f"x{rng.randrange(10**6)}"
            docs.append((2 * group + k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_components(df, NearOptions(percent=55)).collect()}
    assert got == brute_near(docs, 55) != brute_near(docs)


def test_near_edges(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "z")]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 3, False), (3, 3, True), (3, 3, True), (9, 9, True)]


def test_shingle_sets_of_long_and_short_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n)) for n in (0, 1, 4, 5, 6, 900, 3)]
    texts[3] += "\n\t "
    whole = [x.tolist() for x in shingle_sets([t.encode() for t in texts])]
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr("lexmere.llm.shingles.SEGMENT", 50)
    assert [x.tolist() for x in shingle_sets([t.upper().encode() for t in texts])] == whole


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 120)] + [(40, 20), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 0, **{i: 100 for i in range(100, 120)}}


def test_frequent_keys_are_joined_without_loss(spark):
    rows = spark.createDataFrame([(1, i) for i in range(2500)] + [(k, k) for k in range(2, 40)], "k long, v long")
    table = spark.createDataFrame([(1, 2500, "hot")] + [(k, 1, "cold") for k in range(2, 30)], "k long, n long, name string")
    got = join_counted(rows, table, ["k"], "n", 2538).collect()
    assert Counter(r.name for r in got) == {"hot": 2500, "cold": 28}


# ---- backoff ----


def brute_backoff(docs, order, alpha=0.4):
    words = [WORD.findall(lower(t or "")) for _, t in docs]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every = sum(grams, Counter())
    total = sum(map(len, words))
    out = []
    for w, own in zip(words, grams):
        rest = max(total - len(w), 1)
        c = lambda g: every[g] - own[g]  # noqa: E731, B023
        micro = found = 0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s = math.log(max(c(gram), 0.5) / rest)
                elif c(gram):
                    s = math.log(c(gram) / c(gram[:-1]))
                else:
                    continue
                s += math.log(alpha) * (min(order, i + 1) - n)
                found += n > 1
                break
            micro += round(s * 1e6)
        out.append((len(w), found, micro))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_equals_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr("lexmere.llm.backoff.BATCH_BYTES", 300)
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice("aBcdefgh") for _ in range(rng.randrange(40)))) for i in range(30)]
    docs += [(90, None), (91, ""), (92, "alone"), (92, "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("grams", F.lit(1))
    got = sorted((r.doc_id, r.n_words, r.n_found, r.score_micro) for r in backoff_scores(df, order=order).collect())
    want = sorted((i, *s) for (i, _), s in zip(docs, brute_backoff(docs, order)))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(g[3] - w[3]) <= w[1] for g, w in zip(got, want))
    assert backoff_scores(df.limit(0), order=order).collect() == []


# ---- pipeline ----


def test_pipeline_equals_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = [f"w{i}x{i * i % 97}" for i in range(150)]
    near = [(1000 + k, " ".join([*words[:20], f"edit{k}", *words[21:]]), "en", "src1", 1) for k in range(4)]
    given.union(spark.createDataFrame(near, given.schema)).repartition(3).write.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r, (base, host) in zip(rows, brute_quality(rows)) if not base and not host]
    key = lambda line: k if len(k := lower(line.strip(" \t\n\x0b\x0c\r"))) >= 10 else None
    holders = defaultdict(set)
    for i, text, _ in rows:
        for line in text.split("\n"):
            holders[key(line)].add(i)
    docs = []
    for i, text, _ in rows:
        lines = [x for x in text.split("\n") if key(x) is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        docs.append((i, "\n".join(lines)))
    kept = brute_near(docs)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in docs:
        if kept[i][2]:
            ids = model.encode(text, add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                part = np.array(ids[k : k + 2048], "<u4")
                want[i, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)
    assert 0 < len(docs) < 200 and sum(k[2] for k in kept.values()) < len(docs)


def test_pipeline_joins_near_copies_from_80_percent(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    docs = []
    for group in range(3):
        words = [f"g{group}w{j}" for j in range(106)]
        for k in range(2):
            own = [*words[:20], f"edit{k}", *words[21:60], f"more{k}", *words[61:]]
            docs.append((10 * group + k, " ".join(own)))
    for group in range(3):
        a, b = (shingles(t) for i, t in docs if i // 10 == group)
        assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 10, 20}


def test_pipeline_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text + " y", "en", "s", 1), (4, None, "en", "s", 0)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == table.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r.doc_id for r in packed} <= {1, 2, None}
