"""Queries on the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.filters import endpoints, with_status
from .registry import query

_E = "act AS (SELECT * FROM claims WHERE status = 'active'), e AS (SELECT subject_id AS a, object_id AS b, claim_id FROM act WHERE object_id IS NOT NULL UNION ALL SELECT object_id, subject_id, claim_id FROM act WHERE object_id IS NOT NULL AND object_id <> subject_id)"
_SEEDS = "seeds AS (SELECT node_id FROM nodes WHERE node_id IN ('C1', 'C2', 'N3'))"
_ENDS = "act AS (SELECT * FROM claims WHERE status = 'active'), ends AS (SELECT claim_id, subject_id AS node_id FROM act UNION SELECT claim_id, object_id FROM act WHERE object_id IS NOT NULL)"


def _at(s):
    return F.lit(s).cast("timestamp_ntz")


def _active(t):
    return with_status(t.claims)


def _seeds(t):
    return t.nodes.where(F.col("node_id").isin("C1", "C2", "N3"))


def _usable(user: str) -> str:
    """Edges of a user's active personal claims that the assistant didn't infer, from either end."""
    return f"""us AS (SELECT * FROM claims WHERE status = 'active' AND scope = 'personal' AND asserted_by_kind <> 'assistant_inferred' AND user_id = '{user}' AND object_id IS NOT NULL),
        ue AS (SELECT subject_id AS a, object_id AS b, claim_id FROM us UNION ALL SELECT object_id, subject_id, claim_id FROM us WHERE object_id <> subject_id)"""


@query(
    f"""WITH {_usable("u1")}, {_SEEDS}, h AS (SELECT b, min(claim_id) AS claim_id FROM ue WHERE a IN (SELECT node_id FROM seeds) GROUP BY b)
    SELECT n.node_id, node_type, label, claim_id FROM h JOIN nodes n ON n.node_id = h.b
    WHERE label IS NOT NULL AND b NOT IN (SELECT node_id FROM seeds) ORDER BY n.node_id LIMIT 50""",
    "claims nodes",
)
def one_hop_neighbors(t):
    return G.one_hop(t.claims, t.nodes, _seeds(t), user_id="u1")


@query(
    f"""WITH {_E.replace("status = 'active'", "status = 'active' AND user_id = 'u1'")}, {_SEEDS}, h AS (SELECT b, min(claim_id) AS claim_id FROM e WHERE a IN (SELECT node_id FROM seeds) GROUP BY b)
    SELECT n.node_id, claim_id FROM h JOIN nodes n ON n.node_id = h.b WHERE label IS NOT NULL AND b NOT IN (SELECT node_id FROM seeds)""",
    "claims nodes",
)
def one_hop_all_scopes(t):
    return G.one_hop(t.claims, t.nodes, _seeds(t), None, "u1", reference=True, inferred=True).select("node_id", "claim_id")


_HOPS = f"WITH {_E}, {_SEEDS}, h1 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT node_id FROM seeds) AND b NOT IN (SELECT node_id FROM seeds)), h2 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h1) AND b NOT IN (SELECT node_id FROM seeds)), f AS (SELECT node_id, 0 AS hop FROM seeds UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) "


@query(_HOPS + "SELECT node_id, hop FROM f", "claims nodes")
def ego_two_hop(t):
    return G.ego(_active(t), _seeds(t), 2)


@query(_HOPS + "SELECT node_id, hop FROM f ORDER BY hop, node_id LIMIT 80", "claims nodes")
def bfs_subgraph(t):
    return G.subgraph(_active(t), _seeds(t), 80, 2)


@query("SELECT claim_id, s.label AS subject_label, o.label AS object_label FROM claims c JOIN nodes s ON s.node_id = subject_id JOIN nodes o ON o.node_id = object_id WHERE status = 'active' AND subject_id LIKE 'T1%' AND object_id LIKE 'C1%'", "claims nodes")
def claims_between_nodes(t):
    ids = t.nodes.where(F.col("node_id").startswith("T1") | F.col("node_id").startswith("C1"))
    return G.labelled(G.claims_between(_active(t), ids), t.nodes).select("claim_id", "subject_label", "object_label")


@query("SELECT node_id, label FROM nodes WHERE node_type = 'Task' ORDER BY created_at DESC, node_id LIMIT 200", "nodes")
def nodes_by_type(t):
    return G.by_type(t.nodes, "Task").select("node_id", "label")


@query("SELECT node_id, string_agg(source_id, ',' ORDER BY source_id) AS source_ids FROM source_links GROUP BY node_id", "source_links")
def sources_per_node(t):
    return G.sources_of_nodes(t.source_links).withColumn("source_ids", F.array_join("source_ids", ","))


_PAGE = "pg AS (SELECT node_id, label AS day FROM nodes WHERE node_type = 'Temporal' ORDER BY label DESC LIMIT 20 OFFSET 5)"


@query(f"WITH {_E}, {_PAGE}, x AS (SELECT DISTINCT day, b FROM pg LEFT JOIN e ON e.a = pg.node_id) SELECT day, count(n.node_id) AS node_count, string_agg(CASE WHEN node_type = 'Task' THEN n.node_id END, ',' ORDER BY n.node_id) AS nodes FROM x LEFT JOIN nodes n ON n.node_id = x.b GROUP BY day", "claims nodes")
def timeline_days(t):
    return G.timeline(_active(t), t.nodes, 20, 5, ("Task",)).withColumn("nodes", F.array_join("nodes", ","))


@query(f"WITH {_E} SELECT DISTINCT n.node_id, n.label FROM e JOIN nodes n ON n.node_id = b WHERE a = 'day:1997-03-03' AND node_type = 'Task'", "claims nodes")
def nodes_by_type_on_day(t):
    return G.nodes_on_day(t.claims, t.nodes, "1997-03-03", ("Task",), limit=None, reference=True, inferred=True).select("node_id", "label")


@query(
    """WITH d AS (
        SELECT label AS day, node_id FROM nodes WHERE user_id = 'u0' AND node_type = 'Temporal' AND label = (SELECT max(substr(object_id, 5)) FROM due_claims WHERE user_id = 'u0' AND object_id < 'day:1998')),
    e AS (SELECT predicate, subject_id AS a, object_id AS b FROM claims WHERE user_id = 'u0' AND status = 'active' UNION SELECT predicate, object_id, subject_id FROM claims WHERE user_id = 'u0' AND status = 'active'),
    h AS (SELECT DISTINCT day, predicate, n.node_id, n.label FROM d JOIN e ON e.a = d.node_id JOIN nodes n ON n.node_id = e.b AND n.user_id = 'u0' AND n.node_id <> d.node_id),
    p AS (SELECT day, '## ' || predicate || chr(10) || chr(10) || string_agg('- **' || label || '** (id: ' || node_id || '): ' || chr(10), '' ORDER BY node_id) || chr(10) AS part FROM h GROUP BY day, predicate)
    SELECT day, (SELECT count(DISTINCT node_id) FROM h)::INTEGER AS node_count, '# Memories from ' || day || chr(10) || chr(10) || string_agg(part, '' ORDER BY part) AS text FROM p GROUP BY day""",
    "claims due_claims nodes",
)
def day_memories(t):
    day = t.due_claims.where("user_id = 'u0' AND object_id < 'day:1998'").agg(F.max(F.substring("object_id", 5, 10))).first()[0]
    return G.day_report(t.claims, t.nodes, day, "u0")


_CHANGES = """
w AS (SELECT TIMESTAMP '1998-01-01 00:00:00' AS s, TIMESTAMP '1998-02-08 00:00:00' AS e),
c AS (SELECT claim_id, subject_id, object_id, source_id, greatest(c.created_at, c.updated_at) AS moment, CASE WHEN c.created_at >= s THEN 'added' ELSE 'updated' END AS change, n.label, n.node_type AS st, o.node_type AS ot
    FROM claims c JOIN nodes n ON n.node_id = subject_id LEFT JOIN nodes o ON o.node_id = object_id, w
    WHERE c.user_id = 'u1' AND status = 'active' AND scope = 'personal' AND (c.created_at BETWEEN s AND e OR c.updated_at BETWEEN s AND e)),
k AS (SELECT * FROM c WHERE {which} ORDER BY moment DESC, claim_id LIMIT 200),
t AS (SELECT node_id, max(moment) AS moment FROM (SELECT subject_id AS node_id, moment FROM k UNION ALL SELECT object_id, moment FROM k WHERE object_id IS NOT NULL) GROUP BY node_id),
nw AS (SELECT node_id, 'added' AS change, created_at AS moment, label FROM nodes, w WHERE user_id = 'u1' AND created_at BETWEEN s AND e AND {type}
    UNION ALL SELECT n.node_id, 'updated', t.moment, label FROM nodes n JOIN t USING (node_id), w WHERE user_id = 'u1' AND created_at < s AND {type}),
f AS (SELECT 'claim' AS feed, claim_id AS id, change, moment, label FROM k
    UNION ALL SELECT 'node', * FROM (SELECT node_id, change, moment, label FROM nw ORDER BY moment DESC, node_id LIMIT 200)
    UNION ALL SELECT 'source', source_id, NULL, coalesce(last_ingested_at, created_at), coalesce(nullif(trim(json_extract_string(metadata, '$.title')), ''), nullif(trim(json_extract_string(metadata, '$.filename')), '')) FROM source_rows
        WHERE user_id = 'u1' AND source_id IN (SELECT source_id FROM k))
SELECT feed, id, change, CAST(moment AS VARCHAR) AS "at", label, row_number() OVER (PARTITION BY feed ORDER BY moment DESC, id) AS place FROM f"""


@query("WITH " + _CHANGES.format(which="TRUE", type="node_type NOT IN ('Temporal', 'Atlas', 'AssistantDream')"), "claims nodes source_rows")
def recent_changes(t):
    return G.recent_changes(t.claims, t.nodes, t.source_rows, "u1", _at("1998-01-01 00:00:00"), _at("1998-02-08 00:00:00"), 200)


@query("WITH " + _CHANGES.format(which="st = 'Object' OR coalesce(ot = 'Object', FALSE)", type="node_type = 'Object'"), "claims nodes source_rows")
def recent_changes_of_types(t):
    return G.recent_changes(t.claims, t.nodes, t.source_rows, "u1", _at("1998-01-01 00:00:00"), _at("1998-02-08 00:00:00"), 200, ("Object",))


@query(f"WITH {_ENDS} SELECT node_id, count(*) AS connections FROM ends GROUP BY node_id HAVING count(*) >= 3 ORDER BY connections DESC, node_id LIMIT 60", "claims")
def sample_pool(t):
    return G.sample_pool(_active(t))


@query()
def sample_random(t):
    return G.sample_nodes(_active(t), 10, 42)


@query("SELECT subject_id AS node_id, count(*) AS n FROM claims WHERE created_at >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY 1 ORDER BY n DESC, node_id LIMIT 30", "claims")
def entry_nodes(t):
    return G.entry_nodes(t.claims, _at("2001-01-01 00:00:00"), 30)


@query("WITH ends AS (SELECT claim_id, subject_id AS node_id FROM claims UNION SELECT claim_id, object_id FROM claims WHERE object_id IS NOT NULL) SELECT n.node_id, (SELECT count(*) FROM ends e WHERE e.node_id = n.node_id) AS n_claims, (SELECT count(*) FROM source_links l WHERE l.node_id = n.node_id) AS n_links, (SELECT count(*) FROM aliases a WHERE a.node_id = n.node_id) AS n_aliases FROM nodes n", "claims nodes source_links aliases")
def evidence_counts(t):
    return G.evidence_counts(t.nodes, t.claims, t.source_links, t.aliases)


@query("SELECT n.node_id, coalesce(to_id, n.node_id) AS resolved_id FROM nodes n LEFT JOIN redirects r ON r.from_id = n.node_id WHERE node_type = 'Object'", "nodes redirects")
def resolve_redirects(t):
    return G.resolve_ids(t.nodes.where("node_type = 'Object'"), t.redirects)


_NEW = "nw AS (SELECT to_id AS from_id, 'X1' AS to_id FROM redirects WHERE to_id LIKE 'X1%' AND to_id <> 'X1')"


@query(f"WITH {_NEW} SELECT from_id, to_id FROM nw UNION ALL SELECT r.from_id, coalesce(nw.to_id, r.to_id) FROM redirects r LEFT JOIN nw ON nw.from_id = r.to_id WHERE r.from_id NOT IN (SELECT from_id FROM nw)", "redirects")
def flatten_redirects(t):
    new = t.redirects.where("to_id LIKE 'X1%' AND to_id <> 'X1'").select(F.col("to_id").alias("from_id"), F.lit("X1").alias("to_id"))
    return G.flatten_redirects(t.redirects, new)


@query("WITH m AS (SELECT 'X' || p_partkey AS f, 'X' || (p_partkey % 64) AS g FROM part WHERE p_partkey >= 64), c AS (SELECT claim_id, user_id, coalesce(m1.g, subject_id) AS s, coalesce(m2.g, object_id) AS o, object_value, predicate, status, scope, created_at FROM claims LEFT JOIN m m1 ON m1.f = subject_id LEFT JOIN m m2 ON m2.f = object_id), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, s, o, object_value, predicate, status, scope ORDER BY created_at, claim_id) AS n FROM c WHERE s IS DISTINCT FROM o) SELECT predicate, status, count(*) AS n_claims, count(DISTINCT o) AS n_objects FROM d WHERE n = 1 GROUP BY ALL", "claims")
def merge_nodes(t):
    merges = t.part.where("p_partkey >= 64").select(F.concat(F.lit("X"), "p_partkey").alias("from_id"), F.concat(F.lit("X"), F.col("p_partkey") % 64).alias("to_id"))
    return G.merge_nodes(t.claims, merges).groupBy("predicate", "status").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("object_id").alias("n_objects"))


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id, subject_id, object_id, object_value, predicate, status, scope ORDER BY created_at, claim_id) AS n FROM claims) SELECT claim_id FROM d WHERE n = 1 AND predicate = 'HAS_STATUS'", "claims")
def dedup_claims(t):
    return G.dedupe_claims(t.claims).where("predicate = 'HAS_STATUS'").select("claim_id")


@query("SELECT predicate, count(*) AS n FROM claims WHERE subject_id NOT LIKE 'C1%' AND (object_id IS NULL OR object_id NOT LIKE 'C1%') GROUP BY predicate", "claims")
def delete_nodes(t):
    return G.delete_nodes(t.claims, t.nodes.where("node_id LIKE 'C1%'")).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT 1 AS place, 'X9' AS ref UNION ALL SELECT 2, 'S1' UNION ALL SELECT 3, 'src49' UNION ALL SELECT 4, 'src3' UNION ALL SELECT 5, 'nowhere' UNION ALL SELECT 6, 'C7') SELECT place, ref, 'node' AS kind, n.label AS title FROM c LEFT JOIN redirects r ON r.from_id = ref JOIN nodes n ON n.node_id = coalesce(to_id, ref) UNION ALL SELECT place, ref, 'claim', statement FROM c JOIN claims k ON k.claim_id = ref AND status = 'active' UNION ALL SELECT place, ref, 'source', external_id FROM c JOIN source_rows s ON s.source_id = ref AND deleted_at IS NULL", "nodes claims source_rows redirects")
def resolve_citations(t):
    cited = t.spark.createDataFrame([(1, "X9"), (2, "S1"), (3, "src49"), (4, "src3"), (5, "nowhere"), (6, "C7")], "place int, ref string")
    return G.resolve_citations(cited, t.nodes, t.claims, t.source_rows, t.redirects)


@query("SELECT s.source_id, CAST(coalesce(last_ingested_at, created_at) AS VARCHAR) AS sort_at, count(l.node_id) AS node_count FROM (SELECT * FROM source_rows WHERE deleted_at IS NULL AND (coalesce(last_ingested_at, created_at) < TIMESTAMP '2001-07-30 00:00:00') ORDER BY coalesce(last_ingested_at, created_at) DESC, source_id DESC LIMIT 11) s LEFT JOIN source_links l ON l.source_id = s.source_id GROUP BY ALL", "source_rows source_links")
def sources_page(t):
    return G.sources_page(t.source_rows, t.source_links, 10, ("2001-07-30 00:00:00", "")).select("source_id", "sort_at", "node_count")


@query("SELECT DISTINCT n.node_id, CAST(n.created_at AS VARCHAR) AS created_at FROM source_links l JOIN nodes n USING (node_id) WHERE source_id IN ('src3', 'src4') ORDER BY created_at DESC, node_id DESC LIMIT 31", "source_links nodes")
def nodes_by_source_page(t):
    return G.nodes_of_source(t.source_links, t.nodes, t.source_rows.where(F.col("source_id").isin("src3", "src4")), 30).select("node_id", "created_at")


@query("SELECT predicate, count(DISTINCT claim_id) AS n, count(*) AS n_ends FROM (SELECT claim_id, predicate, subject_id AS x FROM claims UNION SELECT claim_id, predicate, object_id FROM claims WHERE object_id IS NOT NULL) GROUP BY predicate", "claims")
def claim_endpoints(t):
    return endpoints(t.claims).groupBy("predicate").agg(F.countDistinct("claim_id").alias("n"), F.count(F.lit(1)).alias("n_ends"))
