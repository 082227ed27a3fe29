"""Composed reads: a node with all that is known of it, exports, period summaries, bootstrap sections and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.period import DAY, ancestors
from ..vocab import FORCE_REFRESH, PROFILE_KINDS
from .filters import endpoints
from .graph import labelled


def node_details(ids: DataFrame, nodes: DataFrame, claims: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Nodes by id with their active claims as lines of label, predicate and label or value, their aliases and sources, each list in order."""
    own = nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")
    lines = labelled(claims.where("status = 'active'"), nodes)
    line = F.concat_ws(" ", F.coalesce("subject_label", "subject_id"), "predicate", F.coalesce("object_label", "object_value", "object_id"))
    touch = endpoints(lines.select("claim_id", "subject_id", "object_id", line.alias("line"))).join(ids.select("node_id").distinct(), "node_id", "left_semi")
    said = touch.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "line"))), lambda x: x["line"]), "\n").alias("claims"), F.count(F.lit(1)).alias("n_claims"))
    names = aliases.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("alias_text")), ", ").alias("aliases"))
    where = links.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ", ").alias("sources"))
    out = own.select("node_id", "node_type", "label")
    for part in (said, names, where):
        out = out.join(part, "node_id", "left")
    return out.withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))


def node_sources(ids: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that nodes come from, those that were deleted left out."""
    return links.join(ids.select("node_id").distinct(), "node_id", "left_semi").join(sources.where("deleted_at IS NULL"), "source_id").select("node_id", "source_id", "type", "external_id", "created_at")


def graph_export(nodes: DataFrame, claims: DataFrame, types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): labelled nodes of some types, and the active claims between them."""
    shown = nodes.where(F.col("node_type").isin(*types) & F.col("label").isNotNull()).select("node_id", "node_type", "label")
    end = lambda c: shown.select(F.col("node_id").alias(c))
    # Objects first: their types vary more than those of subjects, so that fewer claims travel twice.
    edges = claims.where("status = 'active'").join(end("object_id"), "object_id", "left_semi").join(end("subject_id"), "subject_id", "left_semi")
    return shown, edges.select("claim_id", "subject_id", "predicate", "object_id")


def period_timeline(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Weeks, months and years of all days that have a node, with their summaries (key, summary) if there are any: (key, days, summary)."""
    days = nodes.where((F.col("node_type") == "Temporal") & F.col("label").rlike(DAY)).select(F.col("label").alias("day")).distinct()
    keys = days.select("day", F.explode(ancestors(F.to_date("day"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("days"))
    return keys.join(summaries.select("key", "summary"), "key", "left")


def total_days(nodes: DataFrame) -> DataFrame:
    """How many days the timeline has."""
    return nodes.where((F.col("node_type") == "Temporal") & F.col("label").rlike(DAY)).agg(F.count_distinct("label").alias("days"))


def hub_documents(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The document node of each source, that with the smallest id if there are several."""
    return links.join(nodes.where("node_type = 'Document'").select("node_id"), "node_id", "left_semi").groupBy("source_id").agg(F.min("node_id").alias("node_id"))


def recent_supersessions(claims: DataFrame, nodes: DataFrame, user_id: str, as_of: Column, most: int = 20) -> DataFrame:
    """What of a user's personal facts ended in the day before ``as_of`` or later, newest first: trusted claims of predicates that must not be asked again, with their source and a line to show."""
    ended = claims.where((F.col("user_id") == user_id) & (F.col("scope") == "personal") & F.col("predicate").isin(*FORCE_REFRESH) & F.col("status").isin("superseded", "contradicted", "retracted"))
    ended = ended.where(F.col("asserted_by_kind").isin(*PROFILE_KINDS) & (F.col("updated_at") >= as_of - F.expr("INTERVAL '24' HOUR"))).orderBy(F.desc("updated_at"), "claim_id").limit(most)
    rows = ended.join(nodes.select(F.col("node_id").alias("subject_id"), "label"), "subject_id", "left")
    line = F.concat(F.lit("- "), F.coalesce("label", F.lit("(unlabeled)")), F.lit(": "), "statement", F.lit(" ["), "status", F.lit("]"))
    return rows.select("claim_id", "source_id", line.alias("line"), "updated_at")


def section(kind: str, lines: DataFrame, most: int = 20) -> DataFrame:
    """A section of a context (kind, text) from the first lines (place, line); none if there are no lines."""
    kept = lines.orderBy("place", "line").limit(most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    return kept.agg(text.alias("text"), F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(kind).alias("kind"), "text")


def digest(buckets: DataFrame, movers: DataFrame, changes: DataFrame, most: int = 5) -> DataFrame:
    """A day's digest as rows (part, place, id): dated commitments by bucket in order of due date and id, the largest moves of metrics, and recent changes."""
    first = lambda df, part, order, key: df.withColumn("place", F.row_number().over(W.partitionBy(part).orderBy(*order))).where(F.col("place") <= most).select(part.alias("part"), "place", F.col(key).cast("string").alias("id"))
    parts = first(buckets.where(F.col("bucket").isNotNull()), F.col("bucket"), ["due_on", "task_id"], "task_id")
    parts = parts.unionByName(first(movers, F.lit("movers"), [F.desc("magnitude"), "metric"], "metric"))
    return parts.unionByName(first(changes, F.lit("changes"), [F.desc("at"), "id"], "id"))


def within_budget(work: DataFrame, budget: int) -> DataFrame:
    """The periods of a bottom-up run (key, level, changed) that it may process: in order of level and key as many as the budget allows; unchanged ones are skipped and
    cost nothing."""
    order = W.orderBy("_level", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    rank = F.create_map(*[F.lit(x) for kv in (("day", 0), ("week", 1), ("month", 2), ("year", 3)) for x in kv])
    rows = work.withColumn("_level", rank[F.col("level")]).withColumn("_spent", F.sum(F.col("changed").cast("int")).over(order))  # one row a period
    action = F.when(~F.col("changed"), "skip").when(F.col("_spent") <= budget, "process").otherwise("wait")
    return rows.select("key", "level", action.alias("action"))
