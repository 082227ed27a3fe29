"""Structured Streaming: metric buckets, claims whose touched keys are resolved again, and periods that fall due when they end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.lifecycle import KEY, recompute
from ..sinks import MergeTable
from ..storage import shared_dir


def event_buckets(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling buckets per metric with a watermark; state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rows.select("metric", F.col("w.start").alias("bucket"), "n", "sum", "min", "max")


def trailing(events: DataFrame, days: int = 7, late: str = "1 hour") -> DataFrame:
    """Sliding windows of so many days, one a day."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("avg"), F.count(F.lit(1)).alias("n")).select("metric", F.col("w.end").alias("until"), "avg", "n")


def new_rows(rows: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def claim_state(spark: SparkSession, path: str, claims: StructType, buckets: int = 64) -> MergeTable:
    """The table that resolve_stream keeps: claims of any status with status, valid_from, valid_to and superseded_by as resolved, in buckets by key."""
    last = ("status", "valid_from", "valid_to")
    fields = [f for f in claims if f.name not in (*last, "superseded_by")] + [claims[c] for c in last] + [StructField("superseded_by", StringType())]
    return MergeTable(spark, path, list(KEY), StructType([StructField(f.name, f.dataType) for f in fields]), buckets)


def resolve_stream(claims: DataFrame, state_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps resolved claims under ``state_path``: every batch resolves again the keys it touches, from all their claims, so that late and repeated rows give the
    same state as one run over everything. Only the buckets of those keys are read and written. A batch that is run again after a loss counts once. A claim id keeps its key for ever."""
    table = claim_state(claims.sparkSession, state_path, claims.schema, buckets)

    def fold(batch: DataFrame, number: int) -> None:
        table.change(batch.dropDuplicates(["claim_id"]), lambda old, new: recompute(old, new), "claims", number)

    return claims.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_periods(touches: DataFrame, late: str = "1 hour") -> DataFrame:
    """Days, ISO weeks, months and years that rows (user_id, ts) of a stream touch, each once, when it has ended: user_id, level, key, due_at.

    A touched period is a session that ends when the period does, so that all its rows fall into one; it leaves the state when the watermark passes that end. Rows count as long as their
    period waits; repeated ones change nothing. Null users are a user like others, rows without a time are left out. State and timers are Spark's own: no row passes through Python.
    """
    rows = touches.select("user_id", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL").withWatermark("ts", late)
    day = F.col("ts").cast("date")
    week, month, year = (F.trunc(day, unit) for unit in ("week", "month", "year"))
    iso = F.concat(F.extract(F.lit("YEAROFWEEK"), week).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(week).cast("string"), 2, "0"))
    part = lambda level, key, end: F.struct(F.lit(level).alias("level"), key.alias("key"), end.cast("timestamp").alias("end"))
    parts = F.array(
        part("day", F.date_format(day, "yyyy-MM-dd"), F.date_add(day, 1)), part("week", iso, F.date_add(week, 7)),
        part("month", F.date_format(month, "yyyy-MM"), F.add_months(month, 1)), part("year", F.date_format(year, "yyyy"), F.add_months(year, 12)),
    )
    spread = rows.withColumn("p", F.explode(parts)).select("user_id", "ts", "p.level", "p.key", "p.end")
    left = F.concat((F.unix_micros("end") - F.unix_micros("ts")).cast("string"), F.lit(" microseconds"))
    out = spread.groupBy("user_id", "level", "key", F.session_window("ts", left).alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    return out.select("user_id", "level", "key", F.col("_w.end").alias("due_at"))


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there. Each batch of a complete stream replaces the table under the shared folder, so that the result never passes the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write = "overwrite" if mode == "complete" else "append"
    q = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode(write).parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")
