"""Queries on the identity of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution as I
from .registry import query

_TABLES = "nodes claims source_links source_rows person_vectors"
_K = "try_cast(substr(node_id, 2) AS BIGINT)"
#: Persons with labels that several, two or one of a user have, and blank ones.
_LABEL = f"CASE WHEN node_type <> 'Person' THEN label WHEN {_K} % 20 = 19 THEN ' ' WHEN {_K} % 4 = 0 THEN 'Client ' || ({_K} % 40) WHEN {_K} % 4 IN (1, 2) THEN 'Pair ' || CAST(floor({_K} / 10) AS BIGINT) || '-' || ({_K} % 5) ELSE label END"
_CASCADE = f"""
lab AS (SELECT node_id, user_id, node_type, label, lower(trim(label)) AS c FROM (SELECT * REPLACE ({_LABEL} AS label) FROM nodes)),
own_name AS (SELECT user_id, c, {_K} AS k FROM lab WHERE node_type = 'Person' AND {_K} % 4 = 3 AND {_K} % 20 <> 19),
al AS (SELECT user_id, c, 'C' || (k + 20) AS node_id FROM own_name UNION SELECT user_id, c, 'C' || (k + 40) FROM own_name WHERE k % 8 = 7),
sup AS (SELECT user_id, subject_id AS node_id, scope FROM claims WHERE status = 'active' UNION SELECT user_id, object_id, scope FROM claims WHERE status = 'active' AND object_id IS NOT NULL
    UNION SELECT s.user_id, l.node_id, s.scope FROM source_links l JOIN source_rows s USING (source_id)),
ns AS (SELECT n.node_id, coalesce(s.scope, 'personal') AS scope, s.scope IS NOT NULL AS supported FROM lab n LEFT JOIN sup s ON s.node_id = n.node_id AND s.user_id = n.user_id),
ow AS (SELECT node_id, CASE WHEN bool_or(scope = 'personal') THEN 'personal' ELSE 'reference' END AS scope, bool_or(supported) AS supported FROM ns GROUP BY node_id),
x AS (SELECT n.*, o.scope, o.scope = 'reference' OR o.supported AS me FROM lab n JOIN ow o USING (node_id) WHERE n.node_type = 'Person'),
l AS (SELECT x.node_id, count(DISTINCT y.node_id) FILTER (WHERE s.scope = x.scope) AS n, min(y.node_id) FILTER (WHERE s.scope = x.scope) AS m FROM x JOIN lab y ON y.user_id = x.user_id AND y.node_type = x.node_type AND y.c = x.c AND y.node_id <> x.node_id
    JOIN ns s ON s.node_id = y.node_id WHERE x.c <> '' GROUP BY x.node_id),
a AS (SELECT x.node_id, count(DISTINCT y.node_id) FILTER (WHERE s.scope = x.scope) AS n, min(y.node_id) FILTER (WHERE s.scope = x.scope) AS m FROM x JOIN al ON al.user_id = x.user_id AND al.c = x.c AND al.node_id <> x.node_id
    JOIN lab y ON y.node_id = al.node_id AND y.node_type = x.node_type JOIN ns s ON s.node_id = y.node_id GROUP BY x.node_id),
unsure AS (SELECT x.* FROM x LEFT JOIN l ON l.node_id = x.node_id LEFT JOIN a ON a.node_id = x.node_id WHERE coalesce(l.n, 0) <> 1 AND coalesce(a.n, 0) <> 1),
s AS (SELECT o.node_id, o.node_type, o.scope, o.me::INT AS me, q.node_id AS match_id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
    FROM unsure o JOIN person_vectors p ON p.node_id = o.node_id JOIN person_vectors q ON q.user_id = p.user_id AND q.node_id <> p.node_id JOIN ow w ON w.node_id = q.node_id WHERE o.scope = 'reference' OR (w.scope = 'personal' AND w.supported)),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, match_id) AS k FROM s WHERE similarity >= 0.1),
f AS (SELECT r.node_id, r.me, r.match_id, r.similarity, row_number() OVER (PARTITION BY r.node_id ORDER BY similarity DESC, r.match_id) AS j FROM r JOIN lab y ON y.node_id = r.match_id AND y.node_type = r.node_type
    WHERE r.k <= 25 - r.me AND EXISTS (SELECT 1 FROM ns WHERE ns.node_id = r.match_id AND ns.scope = r.scope)),
pk AS (SELECT DISTINCT subject_id AS node_id, scope, CASE WHEN object_id IS NULL THEN 'attr|' || predicate || '|' || coalesce(object_value, '') ELSE 'rel|' || predicate || '|' || object_id END AS key
    FROM claims WHERE status = 'active' AND asserted_by_kind IN ('user', 'user_confirmed', 'system')),
mine AS (SELECT node_id, list(DISTINCT key) AS ks FROM pk WHERE scope = 'personal' GROUP BY node_id),
theirs AS (SELECT node_id, list(DISTINCT key) AS ks FROM pk GROUP BY node_id),
j AS (SELECT f.*, len(list_intersect(m.ks, t.ks)) / (len(m.ks) + len(t.ks) - len(list_intersect(m.ks, t.ks)))::DOUBLE AS score FROM f JOIN mine m ON m.node_id = f.node_id JOIN theirs t ON t.node_id = f.match_id WHERE f.j <= 5 - f.me),
p AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, similarity DESC, match_id) AS b FROM j WHERE score >= 0.25),
done AS (SELECT x.node_id, CASE WHEN l.n = 1 THEN l.m WHEN a.n = 1 THEN a.m ELSE p.match_id END AS match_id, CASE WHEN l.n = 1 THEN 'canonical_label' WHEN a.n = 1 THEN 'alias' WHEN p.match_id IS NOT NULL THEN 'profile_compat' ELSE 'none' END AS signal,
    CASE WHEN l.n = 1 OR a.n = 1 THEN 1.0::DOUBLE ELSE coalesce(p.score, 0.0::DOUBLE) END AS confidence, coalesce(l.n, 0) AS n_label, CASE WHEN l.n = 1 THEN 0 ELSE coalesce(a.n, 0) END AS n_alias, coalesce(l.n = 0, FALSE) AS refused_label
    FROM x LEFT JOIN l ON l.node_id = x.node_id LEFT JOIN a ON a.node_id = x.node_id LEFT JOIN p ON p.node_id = x.node_id AND p.b = 1)"""


def _inputs(t):
    nodes = t.nodes.withColumn("label", F.expr(_LABEL))
    own = nodes.where(f"node_type = 'Person' AND {_K} % 4 = 3 AND {_K} % 20 <> 19").select("user_id", F.lower(F.trim("label")).alias("normalized_alias_text"), F.expr(_K).alias("k"))
    to = lambda df, n: df.select("user_id", "normalized_alias_text", F.concat(F.lit("C"), (F.col("k") + n).cast("string")).alias("node_id"))
    return nodes, I.scope_support(t.claims, t.source_links, t.source_rows), t.claims, to(own, 20).unionByName(to(own.where("k % 8 = 7"), 40)), t.person_vectors


@query(f"WITH {_CASCADE} SELECT node_id, match_id, signal, round(confidence, 6) AS confidence, n_label, n_alias, refused_label FROM done", _TABLES)
def identity_decision(t):
    inputs = _inputs(t)
    found = I.resolve(inputs[0].where("node_type = 'Person'"), *inputs, least=0.1, profile_least=0.25)
    return found.select("node_id", "match_id", "signal", F.round("confidence", 6).alias("confidence"), "n_label", "n_alias", "refused_label")


@query(
    f"""WITH {_CASCADE}, e AS (SELECT x.node_id, CASE WHEN x.c = '' THEN 'skipped_no_label' WHEN v.node_id IS NULL THEN 'skipped_no_embedding' END AS skip FROM x LEFT JOIN person_vectors v ON v.node_id = x.node_id)
    SELECT e.node_id, coalesce(skip, CASE WHEN match_id IS NOT NULL THEN 'merge_proposed' END, 'no_proposal') AS status, CASE WHEN skip IS NULL THEN match_id END AS match_id, CASE WHEN skip IS NULL THEN signal ELSE 'none' END AS signal FROM e JOIN done USING (node_id)
    UNION ALL SELECT node_id || '-gone', 'skipped_node_missing', NULL, 'none' FROM x WHERE {_K} % 50 = 0""",
    _TABLES,
)
def identity_reevaluation(t):
    inputs = _inputs(t)
    persons = inputs[0].where("node_type = 'Person'").select("node_id")
    gone = persons.where(f"{_K} % 50 = 0").select(F.concat("node_id", F.lit("-gone")).alias("node_id"))
    return I.reevaluate(persons.unionByName(gone), *inputs, least=0.1, profile_least=0.25).select("node_id", "status", "match_id", "signal")


@query(f"WITH {_CASCADE} SELECT node_id, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes FROM ns GROUP BY node_id", _TABLES)
def node_scope_sets(t):
    return I.scope_sets(t.nodes, I.scope_support(t.claims, t.source_links, t.source_rows)).select("node_id", F.array_join("scopes", ",").alias("scopes"))
