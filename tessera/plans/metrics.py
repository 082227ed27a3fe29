"""Queries on metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def _bucket_query(bucket: str, aggregate: str, sql: str):
    def run(t):
        return M.series(t.observations, t.definitions, bucket, aggregate).select("metric", "bucket", F.round("value", 6).alias("value"), "n")

    run.__name__ = f"metric_series_{aggregate}_{bucket}"
    query(f"SELECT metric, CAST(CAST(date_trunc('{bucket}', occurred_at) AS TIMESTAMP) AS VARCHAR) AS bucket, round({sql}, 6) AS value, count(*) AS n FROM observations GROUP BY ALL", "observations")(run)


for _b, _a, _s in (("hour", "avg", "avg(value)"), ("day", "avg", "avg(value)"), ("day", "p50", "quantile_cont(value, 0.5)"), ("week", "sum", "sum(value)"), ("week", "p90", "quantile_cont(value, 0.9)"), ("month", "min", "min(value)"), ("month", "max", "max(value)")):
    _bucket_query(_b, _a, _s)


@query("SELECT o.metric, CAST(CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS VARCHAR) AS bucket, round(CASE any_value(aggregation_hint) WHEN 'sum' THEN sum(value) ELSE avg(value) END, 6) AS value FROM observations o JOIN definitions d ON o.metric = d.metric GROUP BY ALL", "observations definitions")
def metric_series_by_hint(t):
    return M.series(t.observations, t.definitions, "day").select("metric", "bucket", F.round("value", 6).alias("value"))


@query("SELECT metric, count(*) AS points, max(observation_id) AS last_id, bool_or(truncated) AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY metric) > 500 AS truncated, row_number() OVER (PARTITION BY metric ORDER BY occurred_at, observation_id) AS n FROM observations) WHERE n <= 500 GROUP BY metric", "observations")
def metric_series_raw_capped(t):
    return M.raw_series(t.observations, 500).groupBy("metric").agg(F.count(F.lit(1)).alias("points"), F.max("observation_id").alias("last_id"), F.bool_or("truncated").alias("truncated"))


_WINDOWS = ", ".join(f"nullif(count(*) FILTER (WHERE occurred_at >= {_NOW} - INTERVAL {d} DAY), 0) AS count_{d}d, " + ", ".join(f"{a}(value) FILTER (WHERE occurred_at >= {_NOW} - INTERVAL {d} DAY) AS {a}_{d}d" for a in ("avg", "min", "max", "sum")) for d in (7, 30, 90))
_STATS = f"WITH st AS (SELECT metric, arg_max(value, (occurred_at, observation_id)) AS latest, {_WINDOWS} FROM observations WHERE occurred_at <= {_NOW} GROUP BY metric), sm AS (SELECT d.*, st.* EXCLUDE (metric), CASE WHEN aggregation_hint = 'sum' THEN sum_30d ELSE avg_30d END AS recent, CASE WHEN aggregation_hint = 'sum' THEN sum_90d ELSE avg_90d END AS base FROM definitions d LEFT JOIN st USING (metric)) "


@query(_STATS + "SELECT metric, round(latest, 6) AS latest, count_7d, round(avg_7d, 6) AS avg_7d, round(max_30d, 6) AS max_30d, round(sum_90d, 6) AS sum_90d FROM sm", "observations definitions")
def metric_summaries(t):
    s = M.summaries(t.observations, t.definitions, _now())
    return s.select("metric", *[F.round(c, 6).alias(c) if c != "count_7d" else F.col(c) for c in ("latest", "count_7d", "avg_7d", "max_30d", "sum_90d")])


@query(_STATS + "SELECT metric, CASE WHEN recent IS NULL OR base IS NULL THEN NULL WHEN base = 0 THEN CASE WHEN recent = 0 THEN 'flat' ELSE 'up' END WHEN abs((recent - base) / abs(base)) <= 0.01 THEN 'flat' WHEN recent > base THEN 'up' ELSE 'down' END AS trend FROM sm", "observations definitions")
def metric_trend(t):
    return M.summaries(t.observations, t.definitions, _now()).select("metric", "trend")


_BASE = "coalesce(avg_7d, avg_30d, avg_90d)"
_MOVE = f"CASE WHEN {_BASE} = 0 THEN CASE WHEN latest = 0 THEN 0 ELSE abs(latest) END ELSE abs((latest - {_BASE}) / {_BASE}) END"


@query(_STATS + f"SELECT metric, round({_BASE}, 6) AS baseline, CASE WHEN latest IS NULL OR {_BASE} IS NULL THEN NULL WHEN latest = {_BASE} OR ({_BASE} <> 0 AND {_MOVE} <= 0.01) THEN 'flat' WHEN latest > {_BASE} THEN 'up' ELSE 'down' END AS direction, round(coalesce({_MOVE}, 0), 6) AS magnitude FROM sm WHERE latest IS NOT NULL", "observations definitions")
def metric_movers(t):
    return M.movers(M.summaries(t.observations, t.definitions, _now())).select("metric", F.round("baseline", 6).alias("baseline"), "direction", F.round("magnitude", 6).alias("magnitude"))


@query("SELECT d.metric, d.label, count(o.observation_id) AS n, CAST(CAST(min(occurred_at) AS DATE) AS VARCHAR) AS first_day FROM definitions d LEFT JOIN observations o USING (metric) WHERE contains(lower(d.metric), 'c') OR contains(lower(d.label), 'c') GROUP BY ALL HAVING count(o.observation_id) > 0", "observations definitions")
def metric_list(t):
    return M.catalogue(t.observations, t.definitions, "C", True).select("metric", "label", "n", F.col("first_at").cast("date").alias("first_day"))


@query("SELECT CASE WHEN observation_id % 97 = 0 THEN 'INVALID_INPUT' WHEN observation_id % 89 = 0 THEN 'DEFINITION_NOT_FOUND' WHEN value < 0 OR value > 400 THEN 'RANGE_VIOLATION' ELSE 'ok' END AS outcome, count(*) AS n FROM observations GROUP BY ALL", "observations")
def metric_range_errors(t):
    rows = t.observations.withColumn("value", F.when(F.col("observation_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string"))).withColumn("metric", F.when(F.col("observation_id") % 89 == 0, "nowhere").otherwise(F.col("metric")))
    return M.check_observations(rows, t.definitions).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.metric, count(o.observation_id) AS observations FROM definitions d LEFT JOIN observations o USING (metric) WHERE needs_review GROUP BY ALL", "observations definitions")
def metric_delete_affected(t):
    return M.affected(t.observations, t.definitions.where("needs_review").select("metric"))


@query("SELECT metric, label || ' (new)' AS label, CASE WHEN metric > 'm' THEN 0.0::DOUBLE ELSE 5.0::DOUBLE END AS valid_min, CASE WHEN metric > 'm' THEN 'INVALID_RANGE' END AS error FROM definitions WHERE metric <= 'm' UNION ALL SELECT metric, label, 0.0::DOUBLE, 'INVALID_RANGE' FROM definitions WHERE metric > 'm'", "definitions")
def metric_patch(t):
    patches = t.definitions.select("metric", F.concat("label", F.lit(" (new)")).alias("label"), F.when(F.col("metric") > "m", 500.0).otherwise(5.0).alias("valid_min"), F.lit(None).cast("double").alias("valid_max"))
    return M.patch_definitions(t.definitions, patches).select("metric", "label", F.col("valid_min").cast("double").alias("valid_min"), "error")


@query("WITH k AS (SELECT 'd' || vec_id AS slug, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT CASE WHEN vec_id % 40 = 0 THEN 'd' ELSE 'n' END || vec_id AS slug, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT p.slug, k.slug AS k, round(list_cosine_similarity(p.v, k.v), 6) AS sim FROM p, k WHERE p.slug LIKE 'n%'), m AS (SELECT slug, max(sim) AS sim, max(k) FILTER (WHERE top) AS best FROM (SELECT *, sim = max(sim) OVER (PARTITION BY slug) AS top FROM s) GROUP BY slug) SELECT p.slug, CASE WHEN p.slug LIKE 'd%' OR sim >= 0.85 THEN 'reuse' WHEN sim >= 0.3 THEN 'create_review' ELSE 'create' END AS action, CASE WHEN p.slug LIKE 'd%' THEN p.slug WHEN sim >= 0.85 THEN best END AS definition, sim AS similarity FROM p LEFT JOIN m USING (slug)")
def metric_resolution(t):
    slug = lambda letter: F.concat(letter, F.col("vec_id").cast("string")).alias("slug")
    known = t.embeddings.select(slug(F.lit("d")), F.col("embedding").alias("vector"))
    proposed = t.embeddings.where("vec_id % 20 = 0").select(slug(F.when(F.col("vec_id") % 40 == 0, "d").otherwise("n")), F.col("embedding").alias("vector"))
    return M.resolve_definitions(proposed, known, review=0.3)
