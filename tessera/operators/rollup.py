"""Calendar roll-ups: discovery by watermark, work sets, input texts and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.period import ancestors, complete, day_key, level, level_rank, month_key, week_key, week_monday, year_key
from ..functions.text import truncate

#: Most characters of an entry and of a day's text.
ENTRY_CAP, DAY_CAP = 600, 24000


def touched_days(rows: DataFrame, watermark: Column | None = None) -> DataFrame:
    """Days with rows (day, created_at) committed after the watermark, with the newest commit of each."""
    new = rows if watermark is None else rows.where(F.col("created_at") > watermark)
    return new.groupBy("day").agg(F.max("created_at").alias("last_at"))


def work_set(days: DataFrame, pending: DataFrame, today: Column, start: str | None = None) -> DataFrame:
    """Touched days and their weeks, months and years, with those still pending: (key, level, due). Periods that have not ended are deferred; order is bottom up."""
    keys = days.select(F.explode(F.concat(F.array("day"), ancestors(F.to_date("day")))).alias("key")).unionByName(pending.select("key")).distinct()
    keys = keys.withColumn("level", level(F.col("key")))
    keys = keys if start is None else keys.where((F.col("level") != "day") | (F.col("key") >= start))
    return keys.withColumn("due", complete(F.col("key"), today)).orderBy(level_rank(F.col("key")), "key")


def day_texts(entries: DataFrame, entry_cap: int = ENTRY_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """Text of each day from its entries (day, at, id, node_type, label, description): the day, then one line an entry in time order, its newest entries as many as fit,
    after a line that says how many older ones were left out. Entries without label and description are left out, and a day without others has no text.

    Lengths are positive, so a running sum from the newest entry on says where to stop.
    """
    rows = entries.where(F.col("label").isNotNull() | F.col("description").isNotNull())
    said = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise("")
    line = F.concat(F.lit("- ["), "node_type", F.lit("] "), F.coalesce("label", F.lit("(unlabeled)")), said)
    rows = rows.withColumn("line", truncate(line, entry_cap))
    newest = W.partitionBy("day").orderBy(F.desc("at"), F.desc("id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_sum", F.sum(F.length("line") + 1).over(newest))
    fits = F.col("_sum") <= day_cap
    kept = F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("at", "id", "line")))), lambda x: x["line"])
    out = rows.groupBy("day").agg(kept.alias("_lines"), F.count_if(~fits).alias("omitted"))
    older = F.when(F.col("omitted") > 0, F.array(F.concat(F.lit("("), F.col("omitted").cast("string"), F.lit(" older entries omitted for length)")))).otherwise(F.array().cast("array<string>"))
    return out.select("day", F.array_join(F.concat(F.array(F.concat(F.lit("Day: "), "day")), older, "_lines"), "\n").alias("text"), "omitted")


def parent_texts(summaries: DataFrame, kind: str) -> DataFrame:
    """Texts of weeks or months from day summaries, or of years from month summaries (key, summary); a parent of which no child is summarised has none."""
    parent = {"week": week_key(F.to_date("key")), "month": month_key(F.to_date("key")), "year": F.col("key").substr(1, 4)}[kind]
    line = F.concat("key", F.lit(": "), F.coalesce("summary", F.lit("(no summarized activity)")))
    out = summaries.groupBy(parent.alias("parent")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"), F.count("summary").alias("n"))
    return out.where("n > 0").drop("n")


def fingerprints(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts (key, text) that differ from what was summarised last, with their digest."""
    now = texts.withColumn("fingerprint", F.sha2("text", 256))
    return now.join(stored.select("key", F.col("fingerprint").alias("_old")), "key", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")


def missing_children(parents: DataFrame, days: DataFrame, edges: DataFrame) -> DataFrame:
    """PART_OF edges (child, parent) that weeks (key) lack to their days."""
    have = days.select("day", week_key(F.to_date("day")).alias("key"))
    return parents.join(have, "key").select(F.col("day").alias("child"), F.col("key").alias("parent")).join(edges, ["child", "parent"], "left_anti")


def next_watermark(rows: DataFrame, current: Column) -> DataFrame:
    """The newest commit seen; it never goes back."""
    return rows.agg(F.greatest(F.max("created_at"), current).alias("watermark"))


def week_days(weeks: DataFrame) -> DataFrame:
    return weeks.select("key", F.posexplode(F.sequence(week_monday(F.col("key")), F.date_add(week_monday(F.col("key")), 6))).alias("pos", "date")).select("key", day_key(F.col("date")).alias("day"))


def period_keys(c: Column) -> Column:
    return F.struct(day_key(c).alias("day"), week_key(c).alias("week"), month_key(c).alias("month"), year_key(c).alias("year"))
