"""Queries on claims, their lifecycle and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as S
from ..operators import lifecycle as L
from ..vocab import trust_rank
from .registry import query

_TRUST = "CASE asserted_by_kind WHEN 'user' THEN 5 WHEN 'user_confirmed' THEN 5 WHEN 'participant' THEN 4 WHEN 'document_author' THEN 3 WHEN 'assistant_inferred' THEN 2 ELSE 1 END"
RESOLVED = f"""
ranked AS (
  SELECT *, {_TRUST} AS trust, row_number() OVER (PARTITION BY user_id, subject_id, predicate ORDER BY stated_at DESC, created_at DESC, {_TRUST} DESC, claim_id DESC) AS back
  FROM {{source}} WHERE status IN ('active', 'superseded')),
demotion AS (
  SELECT a.claim_id FROM ranked a WHERE a.back = 1 AND a.asserted_by_kind = 'assistant_inferred' AND EXISTS (
    SELECT 1 FROM ranked b WHERE b.user_id = a.user_id AND b.subject_id = a.subject_id AND b.predicate = a.predicate AND b.back > 1 AND b.asserted_by_kind IN ('user', 'user_confirmed'))),
chain AS (
  SELECT *, lead(claim_id) OVER w AS nxt, lead(stated_at) OVER w AS nxt_at FROM ranked WHERE claim_id NOT IN (SELECT claim_id FROM demotion)
  WINDOW w AS (PARTITION BY user_id, subject_id, predicate ORDER BY stated_at, created_at, trust, claim_id)),
resolved AS (
  SELECT user_id, subject_id, predicate, claim_id, object_value, object_id, asserted_by_kind, stated_at, CASE WHEN nxt IS NULL THEN 'active' ELSE 'superseded' END AS resolved_status, stated_at AS resolved_from, nxt_at AS resolved_to, nxt AS superseded_by, false AS demoted FROM chain
  UNION ALL
  SELECT r.user_id, r.subject_id, r.predicate, r.claim_id, r.object_value, r.object_id, r.asserted_by_kind, r.stated_at, 'superseded', r.stated_at, r.stated_at, h.claim_id, true
  FROM ranked r JOIN demotion d ON r.claim_id = d.claim_id JOIN chain h ON h.user_id = r.user_id AND h.subject_id = r.subject_id AND h.predicate = r.predicate AND h.nxt IS NULL)
"""
STATUS = "WITH " + RESOLVED.format(source="status_claims")
_OUT = ("claim_id", "subject_id", "resolved_status", "resolved_from", "resolved_to", "superseded_by", "demoted")
_SQL_OUT = "claim_id, subject_id, resolved_status, CAST(resolved_from AS VARCHAR) AS resolved_from, CAST(resolved_to AS VARCHAR) AS resolved_to, superseded_by, demoted"


@query(STATUS + f"SELECT {_SQL_OUT} FROM resolved", "status_claims")
def claim_supersession(t):
    return L.supersede(t.status_claims).select(*_OUT)


@query(STATUS + "SELECT claim_id, superseded_by, asserted_by_kind FROM resolved WHERE demoted", "status_claims")
def claim_trust_demotion(t):
    return L.supersede(t.status_claims).where("demoted").select("claim_id", "superseded_by", "asserted_by_kind")


@query(STATUS + "SELECT user_id, subject_id, object_value, claim_id FROM resolved WHERE resolved_status = 'active'", "status_claims")
def claim_active_current(t):
    return S.with_status(L.apply_lifecycle(t.status_claims)).select("user_id", "subject_id", "object_value", "claim_id")


@query(STATUS + "SELECT claim_id, object_value FROM resolved WHERE resolved_from <= TIMESTAMP '1998-01-01 00:00:00' AND (resolved_to IS NULL OR resolved_to > TIMESTAMP '1998-01-01 00:00:00')", "status_claims")
def claims_as_of(t):
    return S.valid_during(L.apply_lifecycle(t.status_claims), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("claim_id", "object_value")


@query("SELECT claim_id, predicate, object_value FROM status_claims WHERE stated_at BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-03-01 00:00:00'", "status_claims")
def claims_stated_between(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return S.stated_between(t.status_claims, at("1996-01-01 00:00:00"), at("1996-03-01 00:00:00")).select("claim_id", "predicate", "object_value")


@query(STATUS + "SELECT subject_id, count(*) AS n_claims, count(*) FILTER (WHERE resolved_status = 'active') AS n_active, max(CASE WHEN resolved_to IS NOT NULL THEN date_diff('day', resolved_from, resolved_to) END) AS longest_days FROM resolved GROUP BY subject_id", "status_claims")
def claim_validity_intervals(t):
    days = F.datediff(F.col("resolved_to").cast("date"), F.col("resolved_from").cast("date"))
    return L.supersede(t.status_claims).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("resolved_status") == "active").alias("n_active"), F.max(days).cast("long").alias("longest_days"))


@query("WITH pool AS (SELECT * FROM task_claims UNION ALL SELECT * FROM owner_claims UNION ALL SELECT * FROM due_claims), " + RESOLVED.format(source="pool") + "SELECT predicate, resolved_status, count(*) AS n FROM resolved GROUP BY ALL", "task_claims owner_claims due_claims")
def lifecycle_by_predicate(t):
    pool = t.task_claims.unionByName(t.owner_claims).unionByName(t.due_claims)
    return L.supersede(L.superseding(pool, t.nodes)).groupBy("predicate", "resolved_status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH changed AS (SELECT * REPLACE ('retracted' AS status) FROM status_claims WHERE claim_id LIKE 'S1%'), pool AS (SELECT * FROM status_claims WHERE claim_id NOT LIKE 'S1%' UNION ALL SELECT * FROM changed), " + RESOLVED.format(source="pool") + "SELECT claim_id, resolved_status AS status, CAST(resolved_to AS VARCHAR) AS valid_to FROM resolved UNION ALL SELECT claim_id, status, CAST(NULL AS VARCHAR) FROM changed", "status_claims")
def lifecycle_recompute(t):
    changed = t.status_claims.where(F.col("claim_id").startswith("S1")).withColumn("status", F.lit("retracted"))
    return L.recompute(L.apply_lifecycle(t.status_claims), changed).select("claim_id", "status", "valid_to")


@query("SELECT scope, asserted_by_kind, count(*) AS n FROM claims WHERE status = 'active' AND asserted_by_kind <> 'assistant_inferred' AND user_id = 'u1' GROUP BY ALL", "claims")
def claims_tenant_trusted(t):
    mine = t.claims.where(F.col("user_id") == "u1")
    return S.without_inferred(S.with_status(S.in_scope(mine, include_reference=True))).groupBy("scope", "asserted_by_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT claim_id, {_TRUST} AS trust FROM status_claims WHERE asserted_by_kind = 'assistant_inferred' AND scope = 'personal'", "status_claims")
def candidate_band(t):
    return S.provenance_band(S.in_scope(t.status_claims), "candidate").select("claim_id", trust_rank(F.col("asserted_by_kind")).alias("trust"))


_ENDS = "ends AS (SELECT claim_id, subject_id AS node_id, scope, status FROM claims UNION SELECT claim_id, object_id, scope, status FROM claims WHERE object_id IS NOT NULL)"


@query("WITH " + _ENDS + " SELECT node_id, node_type FROM nodes n WHERE EXISTS (SELECT 1 FROM ends e WHERE e.node_id = n.node_id AND e.scope = 'reference' AND e.status = 'active') OR EXISTS (SELECT 1 FROM source_links l JOIN source_rows s USING (source_id) WHERE l.node_id = n.node_id AND s.scope = 'reference')", "claims nodes source_links source_rows")
def node_scope_support(t):
    return S.scope_support(t.nodes, t.claims, t.source_links, t.source_rows, "reference").select("node_id", "node_type")


@query("WITH " + _ENDS + ", sig AS (SELECT node_id, scope FROM ends UNION ALL SELECT node_id, scope FROM source_links JOIN source_rows USING (source_id)), f AS (SELECT node_id, bool_or(scope = 'reference') AS r, bool_or(scope = 'personal') AS p FROM sig GROUP BY node_id) SELECT n.node_id, CASE WHEN r AND NOT p THEN 'reference' ELSE 'personal' END AS effective_scope FROM nodes n LEFT JOIN f USING (node_id)", "claims nodes source_links source_rows")
def effective_node_scope(t):
    return S.effective_scope(t.nodes, t.claims, t.source_links, t.source_rows).select("node_id", "effective_scope")


@query("SELECT node_id, label, 1.0::DOUBLE AS similarity FROM nodes WHERE contains(lower(label), 'customer#00000010') ORDER BY node_id LIMIT 25", "nodes")
def lexical_substring(t):
    return S.label_search(t.nodes, "Customer#00000010", 25).select("node_id", "label", "similarity")
