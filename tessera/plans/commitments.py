"""Queries on task commitments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import coerce_task_status
from ..operators import commitments as C
from .registry import query

_NEEDS = "task_claims owner_claims due_claims nodes"


def _joined(trusted_side: bool, band: str, user: str = "") -> str:
    side = " AND asserted_by_kind <> 'assistant_inferred'" if trusted_side else ""
    where = {"trusted": "s.asserted_by_kind <> 'assistant_inferred'", "candidate": "s.asserted_by_kind = 'assistant_inferred'", "all": "true"}[band]
    own = "status = 'active' AND scope = 'personal'" + (f" AND user_id = '{user}'" if user else "")
    return f"""j AS (
      SELECT s.subject_id AS task_id, s.claim_id, s.object_value AS raw_status, n.label, ow.object_id AS owner_id, om.label AS owner_label, dm.label AS due_on, s.stated_at
      FROM (SELECT * FROM task_claims WHERE {own}) s
      JOIN nodes n ON n.node_id = s.subject_id AND n.user_id = s.user_id AND n.node_type = 'Task'
      LEFT JOIN (SELECT * FROM owner_claims WHERE {own}{side}) ow ON ow.subject_id = s.subject_id AND ow.user_id = s.user_id
      LEFT JOIN nodes om ON om.node_id = ow.object_id
      LEFT JOIN (SELECT * FROM due_claims WHERE {own}{side}) du ON du.subject_id = s.subject_id AND du.user_id = s.user_id
      LEFT JOIN nodes dm ON dm.node_id = du.object_id
      WHERE {where})"""


def _claims(t):
    return t.task_claims.unionByName(t.owner_claims).unionByName(t.due_claims)


@query(f"WITH {_joined(True, 'trusted')} SELECT task_id, raw_status AS status, label, owner_label, due_on FROM j WHERE raw_status IN ('pending', 'in_progress')", _NEEDS)
def open_commitments(t):
    return C.open_commitments(_claims(t), t.nodes).select("task_id", "status", "label", "owner_label", "due_on")


@query(f"WITH {_joined(True, 'trusted', 'u2')} SELECT task_id, raw_status AS status, due_on FROM j WHERE raw_status IN ('pending', 'in_progress') AND owner_id = (SELECT min(owner_id) FROM j)", _NEEDS)
def commitments_of_owner(t):
    """Of one user, the tasks of one of the owners."""
    owner = t.owner_claims.where("user_id = 'u2' AND scope = 'personal' AND asserted_by_kind <> 'assistant_inferred'").join(t.task_claims.where("scope = 'personal' AND asserted_by_kind <> 'assistant_inferred'").select("subject_id"), "subject_id", "left_semi")
    least = owner.agg(F.min("object_id")).first()[0]
    return C.open_commitments(_claims(t), t.nodes, owned_by=least, user_id="u2").select("task_id", "status", "due_on")


@query(f"WITH {_joined(False, 'candidate', 'u1')} SELECT task_id, raw_status AS status, owner_id, due_on FROM j WHERE raw_status IN ('pending', 'in_progress') AND due_on <= '1997-06-30'", _NEEDS)
def candidate_commitments(t):
    return C.open_commitments(_claims(t), t.nodes, "candidate", "1997-06-30", user_id="u1").select("task_id", "status", "owner_id", "due_on")


@query(f"WITH {_joined(False, 'all')}, r AS (SELECT *, row_number() OVER (ORDER BY label, task_id) AS n FROM j WHERE raw_status = 'done' AND contains(lower(label), 'order 1')) SELECT task_id, label, raw_status AS status FROM r WHERE n BETWEEN 41 AND 61", _NEEDS)
def list_commitments_page(t):
    rows = C.list_commitments(_claims(t), t.nodes, statuses=("done",), search="ORDER 1")
    last = C.keyset_page(rows, "label", "task_id", 39).orderBy(F.desc("label"), F.desc("task_id")).limit(1).first()
    return C.keyset_page(rows, "label", "task_id", 20, after=C.encode_cursor(last.label, last.task_id)).select("task_id", "label", "status")


@query(f"WITH {_joined(False, 'all')}, r AS (SELECT * FROM j WHERE due_on > '2001-06-01' OR due_on IS NULL) SELECT task_id, due_on FROM r ORDER BY due_on ASC NULLS LAST, task_id LIMIT 201", _NEEDS)
def list_commitments_due_nulls_last(t):
    rows = C.list_commitments(_claims(t), t.nodes).where("due_on > '2001-06-01' OR due_on IS NULL")
    return C.keyset_page(rows, "due_on", "task_id", 200).select("task_id", "due_on")


@query(f"WITH {_joined(False, 'all')} SELECT task_id, due_on FROM j WHERE due_on IS NULL AND task_id > 'T5' ORDER BY task_id LIMIT 51", _NEEDS)
def list_commitments_after_null(t):
    return C.keyset_page(C.list_commitments(_claims(t), t.nodes), "due_on", "task_id", 50, after=C.encode_cursor(None, "T5")).select("task_id", "due_on")


@query("WITH p AS (SELECT * FROM task_claims UNION ALL SELECT * FROM owner_claims UNION ALL SELECT * FROM due_claims) SELECT subject_id AS task_id, max(object_value) FILTER (WHERE predicate = 'HAS_TASK_STATUS') AS state, max(object_id) FILTER (WHERE predicate = 'ASSIGNED_TO') AS owner_id, max(object_id) FILTER (WHERE predicate = 'DUE_ON') AS due_id, count(*) AS n_claims, string_agg(DISTINCT source_id, ',') AS sources FROM p GROUP BY subject_id", _NEEDS)
def commitment_detail(t):
    return C.detail(_claims(t)).withColumn("sources", F.array_join("sources", ","))


@query("SELECT subject_id AS task_id, 'HAS_TASK_STATUS' AS predicate, object_value AS value, CAST(stated_at AS VARCHAR) AS stated_at FROM task_claims UNION ALL SELECT subject_id, 'ASSIGNED_TO', object_id, CAST(stated_at AS VARCHAR) FROM owner_claims", "task_claims owner_claims")
def commitment_history(t):
    return C.history(t.task_claims.unionByName(t.owner_claims)).select("task_id", "predicate", "value", "stated_at")


@query(f"WITH {_joined(True, 'trusted')} SELECT CASE WHEN due_on < '1998-07-01' THEN 'overdue' WHEN due_on = '1998-07-01' THEN 'due_today' WHEN due_on <= '1998-07-31' THEN 'upcoming' END AS bucket, count(*) AS n FROM j WHERE raw_status IN ('pending', 'in_progress') GROUP BY ALL", _NEEDS)
def commitments_overdue_buckets(t):
    return C.open_commitments(_claims(t), t.nodes).groupBy(C.due_bucket(F.col("due_on"), "1998-07-01", 30).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_SPELLINGS = (
    ("pending", "pending"), (" To-Do ", "pending"), ("todo", "pending"), ("Not started", "pending"), ("In Progress", "in_progress"), ("doing", "in_progress"), ("STARTED", "in_progress"), ("wip", "in_progress"),
    ("done", "done"), ("completed", "done"), ("Complete", "done"), ("finished", "done"), ("abandoned", "abandoned"), ("CANCELED", "abandoned"), ("cancelled", "abandoned"), ("dropped", "abandoned"), ("failed", "abandoned"),
    ("open", None), ("planned", None), ("active", None), ("ongoing", None), ("closed", None), ("blocked?", None),
)


@query("SELECT o_orderkey AS k, CASE o_orderkey % 23 " + " ".join(f"WHEN {i} THEN " + (f"'{s}'" if s else "NULL") for i, (_, s) in enumerate(_SPELLINGS)) + " END AS status FROM orders")
def coerce_status(t):
    raw = F.element_at(F.array(*[F.lit(r) for r, _ in _SPELLINGS]), (F.col("o_orderkey") % len(_SPELLINGS) + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("k"), coerce_task_status(raw).alias("status"))


@query("SELECT node_id, user_id FROM nodes n WHERE node_type = 'Task' AND NOT EXISTS (SELECT 1 FROM task_claims c WHERE c.subject_id = n.node_id)", "nodes task_claims")
def statusless_tasks(t):
    return C.statusless(t.nodes, t.task_claims).select("node_id", "user_id")


@query("SELECT 'clm_' || substr(sha256(node_id || chr(31) || 'default'), 1, 26) AS claim_id, node_id AS subject_id, 'pending' AS object_value, 'system' AS asserted_by_kind FROM nodes n WHERE node_type = 'Task' AND NOT EXISTS (SELECT 1 FROM task_claims c WHERE c.subject_id = n.node_id) ORDER BY created_at, node_id LIMIT 40", "nodes task_claims")
def statusless_recovery(t):
    return C.default_status_claims(C.statusless(t.nodes, t.task_claims, 40), F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")).select("claim_id", "subject_id", "object_value", "asserted_by_kind")
