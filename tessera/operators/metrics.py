"""Metric time series: buckets, windows, trends, movers, catalogue and checked writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from ..functions.vector import nearest_in_blocks

#: Reuse and review thresholds of a proposed definition, the most raw points of a series, relative change that counts as flat.
REUSE, REVIEW, RAW_CAP, FLAT = 0.85, 0.70, 5000, 0.01
AGGREGATES = ("avg", "sum", "min", "max", "p50", "p90")


def bucketed(observations: DataFrame, bucket: str) -> DataFrame:
    """All aggregates per metric and bucket (hour, day, week from Monday, month) in one pass; percentiles interpolate."""
    v = F.col("value").cast("double")
    return observations.groupBy("metric", F.date_trunc(bucket, "occurred_at").alias("bucket")).agg(
        F.count(v).alias("n"), F.avg(v).alias("avg"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.9).alias("p90")
    )


def series(observations: DataFrame, definitions: DataFrame, bucket: str, aggregate: str | None = None) -> DataFrame:
    """One value per metric and bucket by the aggregate asked for, or by the metric's own hint."""
    rows = bucketed(observations, bucket).join(definitions.select("metric", "aggregation_hint"), "metric")
    pick = F.coalesce(F.lit(aggregate), F.col("aggregation_hint"))
    value = F.coalesce(*[F.when(pick == a, F.col(a)) for a in AGGREGATES], F.col("avg"))
    return rows.select("metric", "bucket", value.alias("value"), "n")


def requested_series(requested: DataFrame, found: DataFrame) -> DataFrame:
    """The series of the requested metrics in their order (place, metric); those without points stay, with nulls."""
    return requested.join(found, "metric", "left").orderBy("place", "bucket")


def raw_series(observations: DataFrame, cap: int = RAW_CAP) -> DataFrame:
    """The first ``cap`` points of each metric in time order, and whether more were left out. Spark filters by rank before the sort ends."""
    by_time = W.partitionBy("metric").orderBy("occurred_at", "observation_id")
    ranked = observations.withColumn("_n", F.row_number().over(by_time)).where(F.col("_n") <= cap + 1)
    more = F.max("_n").over(W.partitionBy("metric")) > cap
    return ranked.withColumn("truncated", more).where(F.col("_n") <= cap).drop("_n")


def summaries(observations: DataFrame, definitions: DataFrame, now: Column, days: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Latest value and count, avg, min, max and sum since now minus each number of days, all in one scan; empty windows are null. With trend."""
    v = F.col("value").cast("double")
    aggs = [F.max_by("value", F.struct("occurred_at", "observation_id")).alias("latest"), F.max("occurred_at").alias("latest_at")]
    for d in days:
        inside = F.col("occurred_at") >= now - F.make_dt_interval(F.lit(d))
        aggs += [F.nullif(F.count_if(inside), F.lit(0)).alias(f"count_{d}d")] + [f(F.when(inside, v)).alias(f"{n}_{d}d") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("sum", F.sum))]
    stats = observations.where(F.col("occurred_at") <= now).groupBy("metric").agg(*aggs)
    out = definitions.join(stats, "metric", "left")
    recent, base = (F.when(F.col("aggregation_hint") == "sum", F.col(f"sum_{d}d")).when(F.col("aggregation_hint") == "min", F.col(f"min_{d}d")).when(F.col("aggregation_hint") == "max", F.col(f"max_{d}d")).otherwise(F.col(f"avg_{d}d")) for d in (30, 90))
    return out.withColumn("trend", trend(recent, base))


def trend(recent: Column, base: Column) -> Column:
    """up, down or flat; a change of at most one percent is flat, and from a base of zero any change is up."""
    change = F.try_divide(recent - base, F.abs(base))
    return (
        F.when(recent.isNull() | base.isNull(), None)
        .when(base == 0, F.when(recent == 0, "flat").otherwise("up"))
        .when(F.abs(change) <= FLAT, "flat")
        .when(change > 0, "up")
        .otherwise("down")
    )


def movers(summary: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest value against the first average there is of 7, 30 and 90 days, largest move in proportion to it first, ties by metric. A move of at most one percent is flat.
    Metrics without an average have no delta, direction or window and move by 0; those without a value are left out."""
    base = F.coalesce("avg_7d", "avg_30d", "avg_90d")
    delta = F.col("latest") - base
    window = F.when(F.col("avg_7d").isNotNull(), "7d").when(F.col("avg_30d").isNotNull(), "30d").when(F.col("avg_90d").isNotNull(), "90d")
    share = F.abs(F.try_divide(delta, F.abs(base)))
    direction = F.when(delta.isNull(), None).when(F.when(base == 0, delta == 0).otherwise(share <= FLAT), "flat").when(delta > 0, "up").otherwise("down")
    size = F.coalesce(F.when(base == 0, F.abs(delta)).otherwise(share), F.lit(0.0))
    rows = summary.where(F.col("latest").isNotNull()).select("metric", "latest", base.alias("baseline"), delta.alias("delta"), direction.alias("direction"), window.alias("window"), size.alias("magnitude"))
    rows = rows.orderBy(F.desc("magnitude"), "metric")
    return rows if limit is None else rows.limit(limit)


def catalogue(observations: DataFrame, definitions: DataFrame, search: str | None = None, with_points: bool = False) -> DataFrame:
    stats = observations.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.max_by("value", F.struct("occurred_at", "observation_id")).alias("latest"))
    found = definitions if search is None else definitions.where(contains_ci(F.col("metric"), search) | contains_ci(F.col("label"), search))
    out = found.join(stats, "metric", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where("n > 0") if with_points else out


def check_observations(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds error to rows (metric, value as text): INVALID_INPUT, DEFINITION_NOT_FOUND or RANGE_VIOLATION; null if the row can be written."""
    number = F.expr("try_cast(value AS double)")
    found = rows.join(definitions.select("metric", "valid_min", "valid_max", F.lit(True).alias("_known")), "metric", "left")
    out_of_range = (number < F.col("valid_min")) | (number > F.col("valid_max"))
    error = F.when(number.isNull() | F.isnan(number), "INVALID_INPUT").when(F.col("_known").isNull(), "DEFINITION_NOT_FOUND").when(out_of_range, "RANGE_VIOLATION")
    return found.withColumn("error", error).drop("_known")


def resolve_definitions(proposed: DataFrame, known: DataFrame, reuse: float = REUSE, review: float = REVIEW, block_rows: int = 20_000) -> DataFrame:
    """For proposals (slug, vector) against known ones: reuse by equal slug or close vector, create with review, or create.

    Only proposals without an equal slug are compared by vector: with all known ones, in blocks of about ``block_rows`` a side (nearest_in_blocks).
    """
    same = proposed.join(known.select("slug").distinct().withColumn("_same", F.col("slug")), "slug", "left")
    best = nearest_in_blocks(same.where("_same IS NULL").select("slug", "vector"), known, "slug", "vector", 1, block_rows).select("slug", F.col("match").alias("k"), F.col("similarity").alias("sim"))
    out = same.select("slug", "_same").join(best, "slug", "left")
    sim = F.col("sim")
    action = F.when(F.col("_same").isNotNull(), "reuse").when(sim >= reuse, "reuse").when(sim >= review, "create_review").otherwise("create")
    return out.select("slug", action.alias("action"), F.coalesce("_same", F.when(sim >= reuse, F.col("k"))).alias("definition"), F.when(F.col("_same").isNull(), sim).alias("similarity"))


def replace_by_source(stored: DataFrame, pushed: DataFrame) -> DataFrame:
    """Observations after a push: those of the pushed sources give way to the pushed ones."""
    return stored.join(pushed.select("source_id").distinct(), "source_id", "left_anti").unionByName(pushed)


def event_keys(rows: DataFrame) -> DataFrame:
    """One event per source and event key."""
    return rows.withColumn("event_node_key", F.concat_ws(":", "source_id", "event_key")).dropDuplicates(["event_node_key"])


def affected(observations: DataFrame, metrics: DataFrame) -> DataFrame:
    """How many observations the deletion of definitions would take along."""
    return metrics.join(observations, "metric", "left").groupBy("metric").agg(F.count("observation_id").alias("observations"))


def patch_definitions(definitions: DataFrame, patches: DataFrame) -> DataFrame:
    """Definitions with the non-null fields of patches (metric, label, valid_min, valid_max) put in; a range that would be empty leaves the row and sets error."""
    p = patches.select("metric", *[F.col(c).alias(f"_{c}") for c in ("label", "valid_min", "valid_max")])
    out = definitions.join(p, "metric", "left")
    low, high = F.coalesce("_valid_min", "valid_min"), F.coalesce("_valid_max", "valid_max")
    bad = low > high
    put = lambda c: F.when(bad, F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c)
    return out.select("metric", put("label"), "aggregation_hint", put("valid_min"), put("valid_max"), F.when(bad, "INVALID_RANGE").alias("error"))
