"""Queries do their whole job on tables that are larger, or denser, than the smallest ones."""

import glob
import os

import duckdb
import pytest

from tessera.plans import ALL_QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one_day(tmp_path_factory):
    """The smallest tables, all goods shipped on one day."""
    path = str(tmp_path_factory.mktemp("one_day"))
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (TIMESTAMP '1997-03-03 00:00:00' AS l_shipdate) FROM '{DATA}/lineitem.parquet') TO '{path}/lineitem.parquet'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        if not os.path.exists(f"{path}/{os.path.basename(f)}"):
            os.symlink(f, f"{path}/{os.path.basename(f)}")
    return path


def test_a_day_gives_all_its_tasks(spark, one_day):
    want = duckdb.connect().execute(f"SELECT count(DISTINCT l_orderkey) FROM '{one_day}/lineitem.parquet' JOIN '{DATA}/orders.parquet' ON l_orderkey = o_orderkey").fetchall()[0][0]
    assert want > 1000 and ALL_QUERIES["nodes_by_type_on_day"](spark, one_day).count() == want


def test_exported_edges_lose_claims_by_their_objects_first(spark):
    from tessera.operators.reads import graph_export

    nodes = spark.createDataFrame([("a", "Task", "x")], "node_id string, node_type string, label string")
    claims = spark.createDataFrame([("c", "a", "p", "a", "active")], "claim_id string, subject_id string, predicate string, object_id string, status string")
    edges = graph_export(nodes, claims, ("Task",))[1]
    joins = [line for line in edges._jdf.queryExecution().analyzed().toString().splitlines() if "LeftSemi" in line]
    assert edges.count() == 1 and len(joins) == 2 and "subject_id" in joins[0] and "object_id" in joins[1], joins
