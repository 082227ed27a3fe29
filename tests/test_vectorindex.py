"""The inverted file of vectors against a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vector import nearest_in_blocks
from tessera.operators import vectorindex
from tessera.operators.vectorindex import VectorIndex, best_of


def table(spark, n=600, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dims))
    x = centre[rng.integers(0, 8, n)] + 0.35 * rng.normal(size=(n, dims))
    rows = [(f"v{i}", "ab"[i % 2], [float(z) for z in v]) for i, v in enumerate(x)]
    rows += [(f"w{i}", "a", rows[0][2]) for i in range(40)] + [("z0", "a", [0.0] * dims), ("z1", "a", None), ("z2", None, rows[5][2]), ("z3", None, rows[9][2])]
    return spark.createDataFrame(rows, "name string, owner string, v array<double>").repartition(3), rows


def plain(rows, k, tenants=True, least=-2.0, among=None):
    good = [(i, t, np.array(v) / np.linalg.norm(v)) for i, t, v in rows if v is not None and any(v)]
    out = {}
    for i, t, v in good:
        near = [(-round(float(v @ y), 6) + 0.0, j) for j, u, y in good if j != i and (u == t or not tenants) and (among is None or j in among)]
        out[i] = [(j, -s) for s, j in sorted(near)[:k] if -s >= least]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.name, -r.similarity, r.match)):
        out.setdefault(r.name, []).append((r.match, r.similarity))
    return out


def test_exact_and_recall(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "PART_ROWS", 15)
    rows, given = table(spark)
    index = VectorIndex.build(rows, "name", "v", "owner", lists=16)
    assert index.lists.agg(F.max("part")).first()[0] > 0
    want = plain(given, 5)
    scan = index.search(rows, "name", "v", 5, "owner", probes=1, exact=True)
    assert {k: v for k, v in found(scan).items()} == {k: v for k, v in want.items() if v}
    probes = index.plan_probes(0.95, k=5, asks=100)
    some = found(index.search(rows, "name", "v", 5, "owner", probes=probes))
    recall = sum(len({m for m, _ in some.get(k, [])} & {m for m, _ in v}) for k, v in want.items()) / sum(map(len, want.values()))
    assert 0.9 <= recall and probes < 16
    every = index.search(rows, "name", "v", 5, "owner", probes=16)
    assert found(every) == {k: v for k, v in want.items() if v}


def test_least_and_among(spark):
    rows, given = table(spark, 200)
    index = VectorIndex.build(rows, "name", "v", lists=8)
    want = plain(given, 3, tenants=False, least=0.8)
    assert found(index.search(rows, "name", "v", 3, probes=1, exact=True, least=0.8)) == {k: v for k, v in want.items() if v}
    names = {f"v{i}" for i in range(0, 200, 3)}
    want = plain(given, 3, tenants=False, among=names)
    assert found(index.search(rows, "name", "v", 3, probes=2, exact=True, among=spark.createDataFrame([(n,) for n in names], "id string"))) == want


@pytest.mark.parametrize("k", [1, 4])
def test_blocks_by_tenant(spark, k):
    rows, given = table(spark, 150)
    got = nearest_in_blocks(rows, rows, "name", "v", k, block_rows=13, within=("owner",))
    want = plain(given, k)
    if k > 1:
        assert found(got) == {n: v for n, v in want.items() if v}
    else:  # ties go to the larger id
        assert {n: v[0][1] for n, v in found(got).items()} == {n: v[0][1] for n, v in want.items() if v}


def test_empty(spark):
    rows, _ = table(spark, 12)
    index = VectorIndex.build(rows.limit(0), "name", "v")
    assert index.search(rows, "name", "v", 3, exact=True).count() == 0 and index.plan_probes() == 1
    assert VectorIndex.build(rows, "name", "v").search(rows.limit(0), "name", "v", 3).count() == 0
    assert [list(x) for x in best_of(np.array([[1.0, 3.0, 3.0, -np.inf]]), np.array([4, 9, 2, 1]), 2)] == [[2, 1]]


def test_what_leaves_a_task_at_once_is_bounded():
    """A batch of queries is not multiplied by all lists before it leaves."""
    import pandas as pd

    class Asked:
        schema = {"id": type("F", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "string")})})}

        def mapInPandas(self, body, _):  # noqa: N802
            self.body = body
            raise StopIteration

    rng, asked = np.random.default_rng(2), Asked()
    index = VectorIndex(None, "", vectorindex.unit(pd.Series(list(rng.normal(size=(300, 64))))), None, None)
    with pytest.raises(StopIteration):
        index._opened(asked, 4, "floor")
    frame = pd.DataFrame({"tenant": "a", "id": [f"q{i}" for i in range(500)], "vector": list(rng.normal(size=(500, 64))), "floor": 0.5})
    out = list(asked.body([frame]))
    assert sum(map(len, out)) == 500 * 296 and max(map(len, out)) * 64 <= 2 << 20
    assert pd.concat(out).groupby("id")["list"].nunique().eq(296).all()


def test_scan_in_small_matrices(spark, monkeypatch):
    """The matrices of a scan are cut by their size, not by a number of queries; the answer is the same."""
    from tessera.functions import vector

    rows, _ = table(spark, n=120)
    rows = rows.where("v IS NOT NULL")
    ask = lambda: sorted(map(tuple, nearest_in_blocks(rows, rows, "name", "v", 3, 40, within=("owner",)).collect()))
    whole = ask()
    monkeypatch.setattr(vector, "CELLS", 64)
    assert whole and ask() == whole
