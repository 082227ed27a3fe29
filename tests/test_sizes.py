"""Tables that have more rows than the session's shuffles would spread well."""

import glob
import os

import duckdb

from tessera.operators import identity
from tessera.plans import ALL_QUERIES, ALL_SQL
from tessera.sources import fixtures

DATA = "/root/testdata/sf0.001"


def test_lineitem_is_dealt_by_order(spark, monkeypatch):
    """A task joins TASK_ROWS rows or so with their orders, whatever the session's shuffle partitions."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500, raising=False)
    t = fixtures.Tables(spark, DATA)
    n = -(-t.lineitem.count() // 500)
    for name in ("use_claims", "due_claims"):
        sizes = [len(p) for p in getattr(t, name).select("claim_id").rdd.glom().collect()]
        assert len(sizes) == n and max(sizes) < 2 * 500, name


def test_dealt_claims_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500, raising=False)
    t = fixtures.Tables(spark, DATA)
    assert sorted(map(repr, t.claims.collect())) == sorted(map(repr, spark.sql(fixtures.TABLES["claims"], **{r: getattr(t, r) for r in ("customer", "orders", "lineitem")}).collect()))
    duck = duckdb.connect()
    for r in fixtures.RAW:
        duck.execute(f"CREATE VIEW {r} AS SELECT * FROM '{DATA}/{r}.parquet'")
    assert [tuple(r) for r in ALL_QUERIES["sample_pool"](spark, DATA).collect()] == duck.execute(ALL_SQL["sample_pool"]).fetchall()


def test_nodes_of_a_common_key_are_paired_in_blocks(spark, monkeypatch):
    """No task pairs all nodes of one label, and a node without another has no pair."""
    monkeypatch.setattr(identity, "PAIRED", 10, raising=False)
    nodes = spark.sql("SELECT 'u' AS user_id, concat('n', id) AS node_id, 'Object' AS node_type, IF(id < 100, ' Same  label', concat('l', id)) AS label FROM range(150)")
    aliases = spark.sql("SELECT 'u' AS user_id, concat('n', id) AS node_id, 'same  label' AS normalized_alias_text FROM range(0, 100, 2) UNION ALL SELECT 'u', 'n2', 'same  label'")
    as_at_size = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in as_at_size.items():
        spark.conf.set(k, v)
    try:
        for found, step in ((identity.by_label(nodes, nodes), 1), (identity.by_alias(nodes, aliases), 2)):
            tasks = [[tuple(r) for r in p] for p in found.rdd.glom().collect()]
            want = sorted((f"n{a}", f"n{b}") for a in range(100) for b in range(0, 100, step) if a != b)
            assert sorted(r for p in tasks for r in p) == want
            assert max(map(len, tasks)) < 0.8 * len(want)
    finally:
        for k in as_at_size:
            spark.conf.unset(k)


def test_pairs_take_little_space(spark, tmp_path):
    """Pairs of a key leave in a row, so that a file holds them in less than a byte each."""
    nodes = spark.sql("SELECT 'u' AS user_id, concat('X', id * 7919 % 20011) AS node_id, concat('label', id % 40) AS label FROM range(12000)")
    aliases = nodes.select("user_id", "node_id", nodes["label"].alias("normalized_alias_text"))
    identity.by_alias(nodes, aliases).coalesce(1).write.parquet(f"{tmp_path}/pairs")
    size = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/pairs/*.parquet"))
    assert size < 40 * 300 * 299, size
