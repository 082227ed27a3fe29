"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import ALL_QUERIES, ALL_SQL
from tessera.sources.fixtures import RAW

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return v.item() if isinstance(v, np.generic) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_query(spark, duck, name):
    df = ALL_QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in ALL_SQL:
        assert got
        return
    found = duck.execute(ALL_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, found.fetchall())


def test_plans_have_no_nested_loops(spark):
    """Queries join by equality; vectors are compared in blocks that meet by equality too."""
    for name, q in ALL_QUERIES.items():
        if name == "stream_event_buckets":
            continue
        plan = q(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
