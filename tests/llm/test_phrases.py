"""Phrase mining against brute force over all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmere.llm import phrases
from lexmere.llm.phrases import Chunk, PhraseOptions, collocations, frequent_phrases

SCHEMA = "text string, lang string, a string, n string, score string"


def brute_counts(rows, longest=4):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        sizes[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts, sizes


def brute(rows, least, top=2000):
    counts, sizes = brute_counts(rows)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            covered = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            if not covered:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "new", "york", "city", "ß", "État", "a b", "x", "rare", "\x1c", "İI"]
    rows = []
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 60):
            words += rng.choice([["new", "york", "city"], ["New", "York"], ["of", "the"], ["a", "a", "a", "a", "a"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", " ; ", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + rows[:5] + [(None, "en"), ("", None), ("...", "fr")]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations(df, PhraseOptions(**options)).collect())


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_sample_never_changes_the_result(spark, share):
    rows = made(1)
    assert run(spark, rows, min_count=5, share=share, bits=20) == brute(rows, 5)


def test_full_bitmap_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 300)
    rows = made(2)
    assert run(spark, rows, min_count=4, share=0.3, bits=15, top=7) == brute(rows, 4, 7)


def test_border_failures_lead_to_further_passes(spark, monkeypatch):
    passes = []
    plain = phrases.hash_counts

    def watched(texts, proposed, counted, options):
        out = plain(texts, proposed, counted, options)
        if proposed is not None:
            passes.append({r["hash"]: r["f"] for r in out.collect()})
        return out

    monkeypatch.setattr(phrases, "hash_counts", watched)
    rows = [("one two three four", "en")] * 9 + [("two three", "en")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    want = {p: f for p, f in brute_counts(rows)[0]["en"].items() if f >= 5}

    def found(share):
        passes.clear()
        options = PhraseOptions(min_count=5, share=share, bits=20)
        return {tuple(r["phrase"].split()): r["f"] for r in frequent_phrases(df, options).filter("k > 0").collect()}

    assert found(0.0) == want
    # nothing is proposed: every pass settles one more length and counts nothing twice
    assert [sorted(p.values()) for p in passes] == [[9, 9, 12, 12], [9, 9, 12], [9, 9], [9]]
    assert found(1.0) == want and len(passes) == 1


def test_phrases_of_one_hash_are_told_apart(spark):
    rows = made(3)  # nearly all collide
    assert run(spark, rows, min_count=6, bits=20, hash_bits=3) == brute(rows, 6)


def test_defined_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []
    rows = [("word " * 200_000 + "end", "en"), ("x y " * 40, None), ("x y " * 40, None), ("p q. " * 50, "und")]
    assert run(spark, rows) == brute(rows, 30)


def test_counts_of_chosen_phrases():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") for _ in range(30)).encode() for _ in range(20)]
    chunk = Chunk("en", texts, 4)
    mask = np.random.default_rng(1)
    chosen = [w & (mask.random(len(w)) < 0.3) for w in chunk.whole]
    got = {(r["k"], r["phrase"]): r["f"] for b in chunk.counted(chosen) for r in b.to_pylist()}
    words = chunk.words.to_pylist()
    want = Counter()
    for k, c in enumerate(chosen, 1):
        want.update((k, " ".join(words[i : i + k])) for i in np.flatnonzero(c))
    assert got == want
