"""Queries on tables that are changed by key, and on streams that keep state by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import MergeTable
from ..sources.fixtures import TABLES
from ..storage import new_folder
from ..streaming.pipelines import claim_state, due_periods, resolve_stream, run_to_table
from .claims import STATUS
from .registry import query


def _stream(t, name: str):
    """A table of the star schema as a stream of its files."""
    return t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


@query(
    """WITH b AS (SELECT 0 AS n, * FROM observations WHERE observation_id % 2 = 0 UNION ALL SELECT 1, * FROM observations WHERE observation_id % 3 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric, date_trunc('hour', occurred_at) ORDER BY n DESC, observation_id DESC) AS k FROM b)
    SELECT user_id, metric, CAST(CAST(date_trunc('hour', occurred_at) AS TIMESTAMP) AS VARCHAR) AS hour, observation_id, value FROM r WHERE k = 1""",
    "observations",
)
def sink_upsert(t):
    """Two batches into a table by user, metric and hour; the second comes twice, as after a lost run."""
    rows = t.observations.select("user_id", "metric", F.date_trunc("hour", "occurred_at").cast("timestamp_ntz").alias("hour"), "observation_id", "value")
    table = MergeTable(t.spark, new_folder(t.spark, "observations"), ["user_id", "metric"], rows.schema, 16)
    key = ["user_id", "metric", "hour"]
    for number, part in ((0, "observation_id % 2 = 0"), (1, "observation_id % 3 <> 0"), (1, "observation_id % 3 <> 0")):
        table.upsert(rows.where(part), key, "observation_id", "metrics", number)
    return table.read()


@query(
    """WITH s AS (SELECT 'm' || user_id AS source_id, event_id AS observation_id, user_id, value FROM events), p AS (SELECT source_id, observation_id + 1000000000 AS observation_id FROM s WHERE user_id % 10 = 0 AND value > 100)
    SELECT source_id, observation_id FROM s WHERE user_id % 7 <> 3 AND source_id NOT IN (SELECT source_id FROM p) UNION ALL SELECT source_id, observation_id FROM p WHERE CAST(substr(source_id, 2) AS BIGINT) % 7 <> 3""",
)
def sink_replace_by_source(t):
    """Observations of a tenth of the sources give way to pushed ones; then the sources of a seventh of the users are removed."""
    rows = t.events.select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_id").alias("observation_id"))
    table = MergeTable(t.spark, new_folder(t.spark, "pushes"), ["source_id"], rows.schema, 16)
    table.replace(rows)
    pushed = t.events.where("user_id % 10 = 0 AND value > 100").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("source_id"), (F.col("event_id") + 1000000000).alias("observation_id"))
    table.replace(pushed)
    table.delete(rows.where("CAST(substr(source_id, 2) AS BIGINT) % 7 = 3").select("source_id"))
    return table.read()


@query(STATUS + "SELECT claim_id, resolved_status AS status, CAST(resolved_to AS VARCHAR) AS valid_to, superseded_by FROM resolved", "status_claims")
def stream_claim_state(t):
    claims = t.spark.sql(TABLES["status_claims"], orders=_stream(t, "orders"))
    path = new_folder(t.spark, "claims")
    resolve_stream(claims, f"{path}/state", f"{path}/checkpoint", 16).awaitTermination()
    return claim_state(t.spark, f"{path}/state", claims.schema, 16).read().select("claim_id", "status", "valid_to", "superseded_by")


@query(
    """WITH d AS (SELECT DISTINCT 'u' || user_id AS user_id, CAST(ts AS DATE) AS d FROM events), p AS (
        SELECT user_id, 'day' AS level, strftime(d, '%Y-%m-%d') AS key, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS due_at FROM d
        UNION SELECT user_id, 'week', strftime(d, '%G-W%V'), CAST(date_trunc('week', d) + INTERVAL 7 DAY AS TIMESTAMP) FROM d
        UNION SELECT user_id, 'month', strftime(d, '%Y-%m'), CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS TIMESTAMP) FROM d
        UNION SELECT user_id, 'year', strftime(d, '%Y'), CAST(date_trunc('year', d) + INTERVAL 1 YEAR AS TIMESTAMP) FROM d)
    SELECT user_id, level, key, CAST(due_at AS VARCHAR) AS due_at FROM p WHERE due_at < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_due_periods(t):
    touches = _stream(t, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), "ts")
    return run_to_table(due_periods(touches), "due", "append")
