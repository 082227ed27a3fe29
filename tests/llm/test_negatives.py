"""op11 against brute force over all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tessera.llm.negatives import Rows, best, mine_negatives, summaries

SCHEMA = "vec_id long, embedding array<double>, label int, _id string, _q string, _slot string, _label string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def plain(rows, asks, positives=5, negatives=5):
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in good:
        if not asks(a[0]):
            continue
        scored = sorted(((sum(x * z for x, z in zip(a[1], b[1], strict=False)), b[0], b[2]) for b in good), key=lambda s: (-s[0], s[1]))
        for s, p, _ in [x for x in scored if x[2] == a[2] and x[1] != a[0]][:positives]:
            hard = [x for x in scored if x[2] != a[2] and 80 * s <= 100 * x[0] <= 100 * s][:negatives]
            out += [(a[0], p, k + 1, n[1], s, n[0]) for k, n in enumerate(hard)]
    return sorted(out)


def cases(seed=2, n=240, dims=20):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    rows = [(i, [float(x) for x in 0.3 * (centre[i % 4] + 0.8 * rng.normal(size=dims))], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(30)]  # copies: ties of all scores
    rows += [(2000, None, 1), (2010, rows[1][1], None), (None, rows[1][1], 1), (2020, [], 1), (2030, [math.nan] * dims, 1), (2040, [math.inf] * dims, 1), (2050, [None] * dims, 1), (2060, [0.0] * dims, 1)]
    rows += [(2070, [1.5] * 3, 2), (2080, [0.1] * (dims + 9), 0), (10, rows[3][1], 1), rows[20], rows[20]]
    return rows


ASKS = lambda i: i % 10 == 0


def test_against_brute_force(spark):
    rows = cases()
    got = mine_negatives(spark, table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, ASKS)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_blocks(spark, monkeypatch):
    """Many blocks of rows and of anchors, and chunks of a few anchors, give the same."""
    real = math.ceil
    monkeypatch.setattr(negatives, "math", type("M", (), {"ceil": staticmethod(lambda x: real(x) if x < 2 else real(x) * 3), "sqrt": math.sqrt}))
    rows = cases(3)
    assert sorted(map(tuple, mine_negatives(spark, table(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=3).collect())) == plain(rows, ASKS, 2, 3)


@pytest.mark.parametrize("shape", ["noise", "steps", "huge"])
def test_bounds_lose_nothing(shape):
    rng = np.random.default_rng(8)
    q = rng.integers(-300, 300, (400, 64)).astype(float)
    if shape == "steps":  # segments that differ by their means: the summaries decide nearly all
        q = np.repeat(rng.integers(-200, 200, (400, 4)), 16, axis=1) + rng.integers(-2, 3, (400, 64)).astype(float)
    if shape == "huge":
        q *= 2.0**18
    rows = Rows(pd.DataFrame({"_slot": range(400), "_id": rng.permutation(400), "_label": ["a"] * 400, "_q": [x.tobytes() for x in q], "_sums": [x.tobytes() for x in np.concatenate(summaries(q), axis=1)]}), 64)
    some, every = rows.take(slice(0, 40)), np.full(40, np.inf)
    i, j, score = best(some, rows, np.ones((40, 400), bool), -every, every, every, 5)
    exact = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in q] for a in q[:40]]
    for k in range(40):
        mine = [(int(s), int(rows.id[x])) for s, x in zip(score[i == k], j[i == k], strict=True)]
        assert mine[:5] == sorted(((s, int(rows.id[x])) for x, s in enumerate(exact[k])), key=lambda z: (-z[0], z[1]))[:5]
    if shape == "steps":
        assert len(i) < 40 * 12


def test_empty(spark):
    assert mine_negatives(spark, table(spark, cases()).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert mine_negatives(spark, table(spark, [(None, None, None)] * 3), F.col("vec_id") % 10 == 0).count() == 0
    assert mine_negatives(spark, table(spark, [(0, [1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0
