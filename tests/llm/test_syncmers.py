import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from lexmere.llm.queries import op5_syncmers
from lexmere.llm.syncmers import edited_fingerprints

SPACELESS = re.compile("[一-鿿぀-ヿ฀-๿]")


def h(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def anchors(text):
    units = [u for u in re.split(r"[\x20\x09-\x0D]+", SPACELESS.sub(lambda m: f" {m[0]} ", text)) if u]
    hashes = [h(u) for u in units]
    if len(hashes) < 5:
        return [x & 0x7FFFFFFF for x in hashes]
    out = []
    for i in range(len(hashes) - 4):
        inner = [h(hashes[j], hashes[j + 1]) for j in range(i, i + 4)]
        if min(map(signed, inner)) in (signed(inner[0]), signed(inner[-1])):
            out.append(h(*inner) & 0x7FFFFFFF)
    return out


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def brute(docs):
    rows = sorted(docs)
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        fp = lambda t: "".join(f"{x:08X}" for x in anchors(t))
        out[doc_id] = (
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            fp(text),
            fp(edited),
            round(dice(anchors(text), anchors(edited)), 12),
            round(dice(anchors(text), anchors(following)), 12),
        )
    return out


def run(df):
    return {
        r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12))
        for r in edited_fingerprints(df).collect()
    }


def test_equals_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1001, ""), (1002, "a b"), (1003, "日本語のテキスト です。長い文"), (1004, "é" * 3000), (5000, "one two three four five")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got, want = run(frame), brute(docs)
    assert got == want
    assert sum(x[4] > x[5] for x in got.values()) > 0.9 * len(got)


def test_edges(spark):
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = spark.createDataFrame([(3, "alone in the table")], "doc_id long, text string")
    assert run(one) == brute([(3, "alone in the table")])
    rows = [(1, "same words here"), (1, "same words here"), (2, None), (None, "last one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("next", F.lit(0))
    got = edited_fingerprints(frame).collect()
    assert len(got) == 4
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert {r.doc_id for r in got} == {1, 2, None}


def test_short_texts_have_fingerprints_of_their_own(spark, tmp_path):
    texts = [" ".join(f"w{n}x{i}y{j}" for j in range(n)) for n in (5, 6, 7) for i in range(40)]
    assert any(not anchors(t) for t in texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_syncmers(spark, str(tmp_path)).collect()}
    prints = [got[i].fingerprint for i in range(len(texts))]
    assert all(prints) and len(set(prints)) == len(texts)
    assert all(got[i].near_next == 0.0 for i in range(len(texts)))
    assert got[900].fingerprint == got[901].fingerprint == ""
    for i, t in enumerate(texts):
        if not anchors(t):
            assert prints[i] == "".join(f"{h(w) & 0x7FFFFFFF:08X}" for w in t.split())


def test_a_long_run_without_white_space_resembles_its_edit(spark):
    rng = random.Random(3)
    run_ = "".join(rng.choice("abcdefghij\u00e9") for _ in range(6000))
    rows = [(1, run_), (2, "other words " * 2000), (3, "before " + run_ + " after")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1][2] == "".join(f"{x:08X}" for x in anchors(" ".join(run_)))
    assert got[3][2] == "".join(f"{x:08X}" for x in anchors(f"before {' '.join(run_)} after"))
    assert got[1][4] > 0.6 and got[3][5] > 0.9
