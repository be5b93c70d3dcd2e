"""Exact top-k search against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmere.llm import topsearch
from lexmere.llm.topsearch import TileOptions, best, exact_top_k, products

SCHEMA = "vec_id long, embedding array<double>, score string, row string"


def brute(rows, k, scale=1024):
    kept = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-(2**63), min(2**63 - 1, math.floor(scale * x))) for x in v]))
    out = []
    for i, (q, a) in enumerate(kept):
        if q is None or q % 100:
            continue
        found = []
        for j, (c, b) in enumerate(kept):
            if i != j:
                score = sum(x * y for x, y in zip(a, b))
                found.append((-max(-(2**63), min(2**63 - 1, score)), 2**63 - 1 if c is None else c, c))
        found.sort(key=lambda f: f[:2])
        out += [(q, r, c, -s) for r, (s, _, c) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in exact_top_k(df, k, F.col("vec_id") % 100 == 0, TileOptions(**options)).collect()), key=repr)


def test_blocks_shards_and_levels(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(0, 1500, 5)]
    rows += [(rng.randrange(5000), rows[7][1]) for _ in range(40)]  # ties
    rng.shuffle(rows)
    rows = list(dict(rows).items())
    assert run(spark, rows, block=4, shard=16, fan=2) == brute(rows, 10)
    assert run(spark, rows) == brute(rows, 10)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 2.0]), (200, None), (300, [nan, 1.0]), (400, [None, 1.0]), (500, [inf, 0.0]), (None, [1.0, 2.0])]
    rows += [(600, []), (700, [1.0]), (7, [1.0, 2.0]), (100, [1.0, 2.0]), (8, [0.5, 0.5, 9.0]), (800, [-0.0004, 0.0004])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [3e9, -7.0, 1e-3]), (100, [-2.5e9, 3.0, 1.0]), (1, [1e38, 1.0, 1.0]), (2, [2e6, 2e6, 2e6]), (3, [-1e38, 2.0, 3.0])]
    assert run(spark, rows, k=3) == brute(rows, 3)


@pytest.mark.parametrize("size", [10, 2**20, 2**31, 2**60])
def test_products_and_selection(size):
    rng = np.random.default_rng(size % 97)
    q, v = (rng.integers(-size, size, (n, 5)) for n in (6, 40))
    v[10:20] = v[3]
    got = products(q, v)
    whole = q.astype(object) @ v.T.astype(object)
    assert (got == np.clip(whole, -topsearch.LONG, topsearch.LONG - 1)).all()
    own = np.array([-1, 0, 3, 39, -1, 12])
    rows, at = best(got, own, 7)
    for i in range(6):
        want = [j for j in sorted(range(40), key=lambda j: (-int(got[i, j]), j)) if j != own[i]][:7]
        assert sorted(at[rows == i]) == sorted(want)
