"""Task commitments: open ones, pages, detail, digests and recovery."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.period import DAY
from ..functions.text import coerce_task_status, contains_ci, stable_id
from ..vocab import OPEN_STATUSES
from .filters import provenance_band

SORTS = ("due", "status", "label", "stated_at", "created_at")


def _branches(claims: DataFrame, nodes: DataFrame, band: str, user_id: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Status, owner and due claims, each narrowed before any join: active ones of scope personal, of one user if given. The band binds the status; owners and due dates are trusted for the trusted band,
    unbound otherwise. Everything joins within a user."""
    active = claims.where((F.col("status") == "active") & (F.col("scope") == "personal"))
    active = active.where(F.col("user_id") == user_id) if user_id else active
    side = provenance_band(active, "trusted" if band == "trusted" else "all").where(F.col("object_id").isNotNull())
    labels = nodes.select("node_id", "label")
    state = provenance_band(active, band).where(F.col("predicate") == "HAS_TASK_STATUS").select("user_id", F.col("subject_id").alias("task_id"), "claim_id", F.col("object_value").alias("raw_status"), "stated_at", "created_at", "source_id", "asserted_by_kind")
    owner = side.where(F.col("predicate") == "ASSIGNED_TO").select("user_id", F.col("subject_id").alias("task_id"), F.col("object_id").alias("owner_id"), F.col("stated_at").alias("owner_at"))
    owner = owner.join(labels.select(F.col("node_id").alias("owner_id"), F.col("label").alias("owner_label")), "owner_id", "left")
    due = side.where(F.col("predicate") == "DUE_ON").select("user_id", F.col("subject_id").alias("task_id"), F.col("object_id").alias("due_id"), F.col("stated_at").alias("due_at"))
    due = due.join(labels.select(F.col("node_id").alias("due_id"), F.col("label").alias("due_on")), "due_id", "left")
    return state, owner, due


def _joined(claims: DataFrame, nodes: DataFrame, band: str, user_id: str | None = None) -> DataFrame:
    state, owner, due = _branches(claims, nodes, band, user_id)
    tasks = nodes.where(F.col("node_type") == "Task").select("user_id", F.col("node_id").alias("task_id"), "label")
    key = ["user_id", "task_id"]
    return state.join(tasks, key).join(owner, key, "left").join(due, key, "left")


def open_commitments(claims: DataFrame, nodes: DataFrame, band: str = "trusted", due_before: str | None = None, owned_by: str | None = None, user_id: str | None = None) -> DataFrame:
    """Open tasks, one row each: the newest by status, then owner, then due claim wins, of the rows that the owner and the due day leave. A due label that is no day counts as no due day."""
    rows = _joined(claims, nodes, band, user_id).where(F.col("raw_status").isin(*OPEN_STATUSES))
    rows = rows if owned_by is None else rows.where(F.col("owner_id") == owned_by)
    rows = rows if due_before is None else rows.where(F.col("due_on").rlike(DAY) & (F.col("due_on") <= due_before))
    rows = rows.withColumn("status", coerce_task_status(F.col("raw_status"))).where(F.col("status").isin(*OPEN_STATUSES))
    newest = W.partitionBy("user_id", "task_id").orderBy(*[F.col(c).desc_nulls_first() for c in ("stated_at", "created_at", "owner_at", "due_at")], F.desc("claim_id"), "owner_id", "due_on")
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def list_commitments(claims: DataFrame, nodes: DataFrame, band: str = "all", statuses: tuple[str, ...] | None = None, search: str | None = None, user_id: str | None = None) -> DataFrame:
    """All personal tasks with a state, every combination of claims a row. States are filtered as written, and afterwards rows of unknown spelling go."""
    rows = _joined(claims, nodes, band, user_id)
    rows = rows.where(F.col("raw_status").isin(*statuses)) if statuses else rows
    rows = rows.where(contains_ci(F.col("label"), search)) if search else rows
    return rows.withColumn("status", coerce_task_status(F.col("raw_status"))).where("status IS NOT NULL")


def encode_cursor(value, node_id: str) -> str:
    """Opaque place after a row: sort value, id, whether the value is null."""
    return base64.urlsafe_b64encode(json.dumps({"v": value, "i": node_id, "n": value is None}, default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple:
    body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return None if body["n"] else body["v"], body["i"]


def keyset_page(rows: DataFrame, sort: str, id_col: str, limit: int, descending: bool = False, after: str | None = None) -> DataFrame:
    """Rows after a cursor in order of (sort, id), nulls last; limit + 1 of them, so that the caller sees whether more follow.

    The place is a filter, so that Spark reads on from it without an offset; the end is a top-k, which needs no full sort.
    """
    s, i = F.col(sort), F.col(id_col)
    if after is not None:
        value, at = decode_cursor(after)
        beyond_id = i < at if descending else i > at
        v = F.lit(value).cast(rows.schema[sort].dataType)
        rows = rows.where(s.isNull() & beyond_id) if value is None else rows.where((s < v if descending else s > v) | ((s == v) & beyond_id) | s.isNull())
    return rows.orderBy(s.desc_nulls_last() if descending else s.asc_nulls_last(), i.desc() if descending else i.asc()).limit(limit + 1)


def history(claims: DataFrame) -> DataFrame:
    """All states, owners and due dates that tasks ever had."""
    return claims.where(F.col("predicate").isin("HAS_TASK_STATUS", "ASSIGNED_TO", "DUE_ON")).select(F.col("subject_id").alias("task_id"), "predicate", "claim_id", F.coalesce("object_value", "object_id").alias("value"), "status", "stated_at")


def detail(claims: DataFrame) -> DataFrame:
    """Per task the current state, owner and due date, how many claims it has had and its sources."""
    rows = claims.where(F.col("predicate").isin("HAS_TASK_STATUS", "ASSIGNED_TO", "DUE_ON"))
    current = lambda p, c: F.max_by(c, F.when((F.col("predicate") == p) & (F.col("status") == "active"), F.struct("stated_at", "claim_id")))
    return rows.groupBy(F.col("subject_id").alias("task_id")).agg(current("HAS_TASK_STATUS", "object_value").alias("state"), current("ASSIGNED_TO", "object_id").alias("owner_id"), current("DUE_ON", "object_id").alias("due_id"), F.count(F.lit(1)).alias("n_claims"), F.array_sort(F.collect_set("source_id")).alias("sources"))


def due_bucket(due_on: Column, today: str, within_days: int, due_at: Column | None = None, now: Column | None = None, zone: str = "UTC") -> Column:
    """overdue, due_today or upcoming; null for what has no date or lies more than ``within_days`` ahead. A task with an instant is overdue before ``now``, and the days end
    at midnight of the caller's zone; other tasks go by calendar day."""
    day = F.to_date(F.lit(today))
    until = F.date_format(F.date_add(day, within_days), "yyyy-MM-dd")
    by_day = F.when(due_on < today, "overdue").when(due_on == today, "due_today").when(due_on <= until, "upcoming")
    if due_at is None:
        return by_day
    ends = lambda n: F.to_utc_timestamp(F.date_add(day, n).cast("timestamp"), zone)
    by_time = F.when(due_at < now, "overdue").when(due_at < ends(1), "due_today").when(due_at < ends(within_days + 1), "upcoming")
    return F.when(due_at.isNotNull(), by_time).otherwise(by_day)


def statusless(nodes: DataFrame, claims: DataFrame, limit: int | None = None) -> DataFrame:
    """Tasks without a state in any claim, oldest first."""
    known = claims.where(F.col("predicate") == "HAS_TASK_STATUS").select(F.col("subject_id").alias("node_id"))
    out = nodes.where(F.col("node_type") == "Task").join(known, "node_id", "left_anti").orderBy("created_at", "node_id")
    return out if limit is None else out.limit(limit)


def default_status_claims(tasks: DataFrame, at: Column) -> DataFrame:
    """A pending state for each task, asserted by the system."""
    return tasks.select(stable_id("clm", F.col("node_id"), F.lit("default")).alias("claim_id"), "user_id", F.col("node_id").alias("subject_id"), F.lit("HAS_TASK_STATUS").alias("predicate"), F.lit("pending").alias("object_value"), F.lit("system").alias("asserted_by_kind"), at.alias("stated_at"), F.lit("active").alias("status"))


def state_change(tasks: DataFrame, predicate: str, at: Column, value: Column | None = None, target: Column | None = None, kind: str = "user") -> DataFrame:
    """New claims for tasks (node_id, user_id): a state, an owner or a due date; the lifecycle then supersedes the old ones."""
    put = lambda c: F.lit(None).cast("string") if c is None else c
    return tasks.select(stable_id("clm", F.col("node_id"), F.lit(predicate), at.cast("string")).alias("claim_id"), "user_id", F.col("node_id").alias("subject_id"), put(target).alias("object_id"), put(value).alias("object_value"), F.lit(predicate).alias("predicate"), F.lit(kind).alias("asserted_by_kind"), at.alias("stated_at"), F.lit("active").alias("status"))


def due_qualifier(metadata: Column) -> Column:
    """Time and zone of a due date from its metadata; null unless both have the right form."""
    time, zone = F.get_json_object(metadata, "$.dueTime"), F.get_json_object(metadata, "$.timeZone")
    ok = time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$") & zone.rlike(r"^(UTC|[A-Za-z_]+(/[A-Za-z0-9_+-]+)+)$")
    return F.when(ok, F.struct(time.alias("time"), zone.alias("zone")))


def upsert_presentations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One presentation per task, the newest; the excerpt is cut to 140 characters."""
    both = stored.unionByName(new).withColumn("excerpt", F.col("excerpt").substr(1, 140))
    return both.withColumn("_n", F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("updated_at"), F.desc("source_id")))).where("_n = 1").drop("_n")


def source_title(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.title"), F.get_json_object(metadata, "$.filename"))
