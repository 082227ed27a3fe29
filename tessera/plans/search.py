"""Queries on search, identity and hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hygiene as H
from ..operators import identity as I
from ..operators import search as R
from ..operators.filters import effective_scope
from ..operators.textindex import TextIndex, word_similarity
from ..operators.vectorindex import VectorIndex
from .registry import query

_Q = [1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.25 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"
_SIM = f"round(list_cosine_similarity(embedding::DOUBLE[], {_QSQL}), 6)"
_NOW = "TIMESTAMP '1998-08-02 00:00:00'"


def _now():
    return F.lit("1998-08-02 00:00:00").cast("timestamp_ntz")


@query(f"SELECT node_id, {_SIM} AS similarity FROM node_vectors ORDER BY similarity DESC, node_id LIMIT 20", "node_vectors")
def vector_topk_nodes(t):
    return R.vector_topk(t.node_vectors, _Q, 20).select("node_id", "similarity")


@query(f"WITH c AS (SELECT claim_id, embedding FROM status_claims JOIN embeddings ON claim_id = 'S' || vec_id WHERE asserted_by_kind <> 'assistant_inferred') SELECT claim_id, {_SIM} AS similarity FROM c WHERE {_SIM} >= 0.05 ORDER BY similarity DESC, claim_id LIMIT 15", "status_claims")
def vector_topk_claims(t):
    v = t.embeddings.select(F.concat(F.lit("S"), "vec_id").alias("claim_id"), "embedding")
    return R.vector_topk(t.status_claims.where("asserted_by_kind <> 'assistant_inferred'").join(v, "claim_id"), _Q, 15, 0.05, "claim_id").select("claim_id", "similarity")


@query(f"WITH a AS (SELECT node_id, row_number() OVER (ORDER BY {_SIM} DESC, node_id) - 1 AS r FROM node_vectors QUALIFY r < 20), b AS (SELECT node_id, row_number() OVER (ORDER BY length(label) DESC, node_id) - 1 AS r FROM nodes WHERE node_type = 'Object' QUALIFY r < 20) SELECT node_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY node_id", "node_vectors nodes")
def rrf_fusion(t):
    a = R.ranked(R.vector_topk(t.node_vectors, _Q, 20), "similarity", "node_id").select("node_id", "rank")
    longest = t.nodes.where("node_type = 'Object'").withColumn("n", F.length("label")).orderBy(F.desc("n"), "node_id").limit(20)
    return R.fuse([a, R.ranked(longest, "n", "node_id").select("node_id", "rank")], "node_id")


@query(
    """WITH p AS (SELECT * FROM node_vectors WHERE CAST(substr(node_id, 2) AS BIGINT) % 20 = 0),
    s AS (SELECT p.node_id, v.node_id AS match, round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS similarity
          FROM p JOIN node_vectors v ON v.node_id <> p.node_id AND v.user_id = p.user_id)
    SELECT node_id, match, similarity FROM s QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, match) <= 10""",
    "node_vectors",
)
def vector_index_exact(t):
    """Every twentieth node asks the index of all nodes, by user, exactly."""
    index = VectorIndex.build(t.node_vectors, "node_id", "embedding", "user_id")
    return index.search(_twentieth(t.node_vectors), "node_id", "embedding", 10, "user_id", exact=True)


@query()
def vector_index_recall(t):
    """How many lists are opened for a recall of 0.95, and what share of the true ten nearest the queries then find."""
    index = VectorIndex.build(t.node_vectors, "node_id", "embedding", "user_id")
    probes, asks = index.plan_probes(0.95), _twentieth(t.node_vectors)
    true, got = (index.search(asks, "node_id", "embedding", 10, "user_id", probes=probes, exact=exact).select("node_id", "match") for exact in (True, False))
    hit = true.join(got.withColumn("hit", F.lit(1)), ["node_id", "match"], "left")
    return hit.agg(F.lit(len(index.centroids)).alias("lists"), F.lit(probes).alias("probes"), F.count(F.lit(1)).alias("true_matches"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


_GRAMS = "flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"


@query(
    f"""WITH q AS (SELECT list_distinct({_GRAMS.format("'stel pump'")}) AS q), g AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS g FROM part),
    e AS (SELECT p_partkey, unnest(range(1, len(g) + 1)) AS i, g FROM g), x AS (SELECT p_partkey, i, unnest(range(i, len(g) + 1)) AS j, g FROM e),
    s AS (SELECT p_partkey, len(list_intersect(q, g[i:j])) AS common, len(list_distinct(list_concat(q, g[i:j]))) AS total FROM x, q)
    SELECT p_partkey, round(max(common / total::DOUBLE), 6) AS similarity FROM s GROUP BY p_partkey"""
)
def trigram_match(t):
    return t.part.select("p_partkey", F.round(word_similarity("stel pump", F.col("p_name")), 6).alias("similarity"))


@query()
def lexical_search(t):
    found = R.lexical(t.documents, "text", 'ones "hest the are" OR enly thes -tire', 50, "doc_id", fuzzy=False)
    return found.select("doc_id", "score", F.regexp_count("headline", F.lit("<mark>")).alias("marks"))


@query()
def lexical_nodes(t):
    among = R.searchable_nodes(t.nodes, t.claims, t.source_links, t.source_rows, "u1", types=("Object",))
    return TextIndex.build(among, "node_id", F.col("label")).search("blue rodd", 30).select(F.col("id").alias("node_id"), "rank", "similarity", "headline")


@query()
def lexical_claims(t):
    """The index holds the statements of all claims; those that may be found bring theirs, so that the index needs no table of who said what."""
    among = R.searchable_claims(t.claims, "u1", at=_now(), stated=(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")))
    found = TextIndex.build(t.claims, "claim_id", F.col("statement"), members=False).search("statuses", 40, among.select(F.col("claim_id").alias("id"), F.col("statement").alias("text")))
    return found.select(F.col("id").alias("claim_id"), "rank", "headline")


@query()
def hybrid_search(t):
    return R.hybrid(t.node_vectors, t.nodes.where("node_type = 'Object'"), "label", _Q, "steel rod", 10)


@query("WITH act AS (SELECT * FROM claims WHERE status = 'active'), f AS (SELECT subject_id AS node_id, predicate, arg_max(object_value, (stated_at, claim_id)) AS v FROM act WHERE object_value IS NOT NULL AND asserted_by_kind <> 'assistant_inferred' GROUP BY ALL), g AS (SELECT node_id, string_agg(predicate || '=' || v, ';' ORDER BY predicate || '=' || v) AS facts FROM f GROUP BY node_id) SELECT n.node_id, n.label, facts, (SELECT min(source_id) FROM source_links l WHERE l.node_id = n.node_id) AS source_id FROM nodes n LEFT JOIN g USING (node_id) WHERE node_type = 'Person'", "claims nodes source_links")
def node_card_facts(t):
    return R.node_cards(t.nodes.where("node_type = 'Person'"), t.claims, t.source_links, t.aliases).select("node_id", "label", F.array_join("facts", ";").alias("facts"), "source_id")


@query("WITH e AS (SELECT claim_id, statement, stated_at, subject_id AS node_id FROM claims WHERE status = 'active' AND asserted_by_kind <> 'assistant_inferred' UNION SELECT claim_id, statement, stated_at, object_id FROM claims WHERE status = 'active' AND asserted_by_kind <> 'assistant_inferred' AND object_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY stated_at DESC, claim_id) AS n FROM e) SELECT node_id, string_agg(statement, '|' ORDER BY n) AS recent FROM r JOIN nodes USING (node_id) WHERE n <= 8 AND node_type = 'Person' GROUP BY node_id", "claims nodes")
def recent_evidence(t):
    return R.node_cards(t.nodes.where("node_type = 'Person'"), t.claims, t.source_links, t.aliases).where("recent IS NOT NULL").select("node_id", F.array_join("recent", "|").alias("recent"))


@query("SELECT node_id, source_id FROM (SELECT node_id, s.source_id, row_number() OVER (PARTITION BY node_id ORDER BY last_ingested_at DESC NULLS LAST, created_at DESC, s.source_id) AS n FROM source_links l JOIN source_rows s ON s.source_id = l.source_id) WHERE n = 1", "source_links source_rows")
def first_source_per_node(t):
    return R.first_source(t.source_links, t.source_rows)


_LABEL = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))"


@query(f"SELECT a.node_id, b.node_id AS match_id FROM nodes a JOIN nodes b ON a.user_id = b.user_id AND a.node_type = b.node_type AND {_LABEL.format('a.label')} = {_LABEL.format('b.label')} AND a.node_id <> b.node_id", "nodes")
def identity_canonical_label(t):
    return I.by_label(t.nodes, t.nodes)


@query("SELECT DISTINCT n.node_id, a.node_id AS match_id FROM nodes n JOIN aliases a ON a.user_id = n.user_id AND a.normalized_alias_text = lower(trim(n.label)) AND a.node_id <> n.node_id WHERE n.node_type = 'Object'", "nodes aliases")
def identity_alias(t):
    return I.by_alias(t.nodes.where("node_type = 'Object'"), t.aliases)


def _nearest(table: str) -> str:
    """Candidates of every twentieth vector among all, as SQL: the 25 nearest of the tenant, of these the five nearest of the kind."""
    return f"p AS (SELECT * FROM {table} WHERE CAST(substr(node_id, 2) AS BIGINT) % 20 = 0), s AS (SELECT p.node_id, v.node_id AS match_id, round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS similarity, p.label = v.label AS same FROM p JOIN {table} v ON v.node_id <> p.node_id AND v.user_id = p.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, match_id) AS n FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, match_id) AS k FROM r WHERE n <= 25 AND similarity >= 0.1 AND same), near AS (SELECT node_id, match_id, similarity FROM q WHERE k <= 5)"


def _twentieth(vectors):
    return vectors.where(F.expr("CAST(substr(node_id, 2) AS BIGINT) % 20 = 0"))


@query(f"WITH {_nearest('node_vectors')} SELECT node_id, match_id, similarity FROM near", "node_vectors")
def identity_embedding(t):
    return I.by_vector(_twentieth(t.node_vectors), t.node_vectors, 0.1)


_PROFILE = "pr AS (SELECT DISTINCT subject_id AS node_id, predicate || '|' || coalesce(object_id, object_value) AS k FROM claims WHERE status = 'active' AND asserted_by_kind IN ('user', 'user_confirmed', 'system'))"


@query(f"WITH {_PROFILE}, {_nearest('person_vectors')}, b AS (SELECT c.node_id, c.match_id, count(*) AS common FROM near c JOIN pr p ON p.node_id = c.node_id JOIN pr q ON q.node_id = c.match_id AND q.k = p.k GROUP BY ALL), m AS (SELECT node_id, count(*) AS n FROM pr GROUP BY node_id) SELECT b.node_id, b.match_id, round(common / (x.n + y.n - common)::DOUBLE, 6) AS similarity FROM b JOIN m x ON x.node_id = b.node_id JOIN m y ON y.node_id = b.match_id WHERE round(common / (x.n + y.n - common)::DOUBLE, 6) >= 0.25", "claims person_vectors")
def identity_profile_jaccard(t):
    return I.by_profile(I.profiles(t.claims), I.by_vector(_twentieth(t.person_vectors), t.person_vectors, 0.1).drop("similarity"), 0.25)


_SCOPES = "sc AS (SELECT node_id, user_id, node_type, label, CASE WHEN (length(node_id) + ascii(substr(node_id, length(node_id), 1))) % 3 = 0 THEN 'reference' ELSE 'personal' END AS scope FROM nodes)"


def _scopes(t):
    return t.nodes.select("node_id", F.when((F.length("node_id") + F.ascii(F.expr("substr(node_id, length(node_id), 1)"))) % 3 == 0, "reference").otherwise("personal").alias("scope"))


@query(f"WITH {_SCOPES} SELECT user_id, node_type, {_LABEL.format('label')} AS canonical_label, scope, count(*) AS size, min(node_id) AS survivor, string_agg(node_id, ',' ORDER BY node_id) AS members FROM sc WHERE node_type IN ('Person', 'Location', 'Object', 'Concept', 'Organization') GROUP BY ALL HAVING count(*) >= 2", "nodes")
def dedup_groups(t):
    return I.duplicate_groups(t.nodes, _scopes(t)).withColumn("members", F.array_join("members", ","))


@query(f"WITH {_SCOPES} SELECT user_id, node_type, {_LABEL.format('label')} AS canonical_label, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes FROM sc WHERE node_type IN ('Person', 'Location', 'Object', 'Concept', 'Organization') GROUP BY ALL HAVING count(DISTINCT scope) >= 2", "nodes")
def cross_scope_collisions(t):
    return I.cross_scope(t.nodes, _scopes(t))


@query("WITH s AS (SELECT quality = 1 AS truth, length(text) / 4000.0 AS score FROM documents JOIN labels USING (doc_id)), th AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS threshold), n AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND truth) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT truth) AS fp, count(*) FILTER (WHERE score < threshold AND truth) AS fn FROM s, th GROUP BY threshold) SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM n")
def threshold_confusion(t):
    scored = t.documents.join(t.labels, "doc_id").select((F.col("quality") == 1).alias("truth"), (F.length("text") / 4000.0).alias("score"))
    return I.confusion(scored, (0.1, 0.25, 0.5, 0.75, 0.9))


_TOUCH = "tc AS (SELECT claim_id, subject_id AS x FROM claims UNION SELECT claim_id, object_id FROM claims WHERE object_id IS NOT NULL)"


@query(f"WITH {_TOUCH} SELECT node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM tc WHERE x = n.node_id) AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.node_id = n.node_id)", "nodes claims aliases")
def orphan_nodes(t):
    return H.orphans(t.nodes, t.claims, t.aliases).select("node_id")


@query(f"WITH {_TOUCH}, f AS (SELECT x AS node_id, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS act, count(*) FILTER (WHERE status = 'active' AND asserted_by_kind NOT IN ('assistant_inferred', 'system')) AS sure, max(stated_at) AS last_at FROM tc JOIN claims USING (claim_id) GROUP BY x), g AS (SELECT n.node_id, coalesce(f.n, 0) AS n, coalesce(act, 0) AS act, coalesce(sure, 0) AS sure, greatest(0, floor(date_diff('second', greatest(created_at, coalesce(last_at, created_at)), {_NOW}) / 86400.0::DOUBLE)) AS days, EXISTS (SELECT 1 FROM aliases a WHERE a.node_id = n.node_id) OR EXISTS (SELECT 1 FROM source_links l WHERE l.node_id = n.node_id) AS known FROM nodes n LEFT JOIN f USING (node_id)), h AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE (n - act) / n::DOUBLE END AS decay FROM g) SELECT node_id, round(0.40::DOUBLE * least(1.0, days / 365.0::DOUBLE) + 0.25::DOUBLE / (1 + act) + 0.20::DOUBLE * CASE WHEN sure > 0 THEN 0 ELSE 1 END + 0.15::DOUBLE * decay, 3) AS score, concat_ws('; ', CASE WHEN n = 0 AND NOT known THEN 'no evidence (no claims, sources, or aliases)' END, 'idle ' || CAST(days AS BIGINT) || 'd', CASE WHEN act = 0 AND (n > 0 OR known) THEN 'no active claims' WHEN act = 1 THEN 'weakly connected (1 active claim)' WHEN act = 2 THEN 'weakly connected (2 active claims)' END, CASE WHEN sure = 0 AND n > 0 THEN 'assistant-inferred only (no grounded claims)' END, CASE WHEN decay >= 0.5 AND n > act THEN CAST(floor(decay * 100 + 0.5) AS BIGINT) || '% of claims superseded' END) AS reasons FROM h", "nodes claims aliases source_links")
def stale_node_score(t):
    return H.stale_scores(t.nodes, t.claims, _now(), aliases=t.aliases, links=t.source_links).select("node_id", "score", F.array_join("reasons", "; ").alias("reasons"))


def _allowed(types: tuple[str, ...], kind: str) -> str:
    return "TRUE" if "*" in types else f"{kind} IN ({', '.join(repr(x) for x in types)})"


_FIT = "CASE predicate " + " ".join(f"WHEN '{p}' THEN {_allowed(s, 'st')} AND {_allowed(o, 'ot')}" for p, (s, o) in H.SHAPES.items()) + " END"
_TURNED = "CASE predicate " + " ".join(f"WHEN '{p}' THEN {_allowed(s, 'ot')} AND {_allowed(o, 'st')}" for p, (s, o) in H.SHAPES.items()) + " END"
_ENDS = f"en AS (SELECT c.*, s.node_type AS st, o.node_type AS ot FROM shape_claims c JOIN nodes s ON s.node_id = subject_id JOIN nodes o ON o.node_id = object_id), fi AS (SELECT *, {_FIT} AS fits, {_TURNED} AS turned FROM en)"
_OWNERS, _OWNABLE = (f"({', '.join(repr(x) for x in xs)})" for xs in H.SHAPES["OWNS"])


@query(f"WITH {_ENDS} SELECT predicate, count(*) AS invalid FROM fi WHERE NOT fits GROUP BY predicate", "shape_claims nodes")
def predicate_shape_audit(t):
    return H.shape_audit(t.shape_claims, t.nodes).select("predicate", "invalid")


@query(f"WITH {_ENDS}, x AS (SELECT *, CASE WHEN predicate = 'OWNED_BY' THEN CASE WHEN st = 'Task' AND ot = 'Person' THEN 'legacy_task_assignment' WHEN st = 'Person' AND ot = 'Task' THEN 'legacy_task_assignment_inverted' WHEN st IN {_OWNABLE} AND ot IN {_OWNERS} THEN 'legacy_passive_ownership' WHEN st IN {_OWNERS} AND ot IN {_OWNABLE} THEN 'legacy_active_ownership' ELSE 'legacy_ambiguous_ownership' END WHEN NOT fits AND turned THEN 'valid_when_inverted' END AS reason FROM fi) SELECT claim_id, reason, CASE WHEN reason LIKE '%task_assignment%' THEN 'ASSIGNED_TO' WHEN reason LIKE '%ownership' THEN CASE WHEN reason LIKE '%ambiguous%' THEN 'RELATED_TO' ELSE 'OWNS' END ELSE predicate END AS predicate, CASE WHEN reason LIKE '%inverted' OR reason LIKE '%passive%' THEN object_id ELSE subject_id END AS subject_id, CASE WHEN reason LIKE '%inverted' OR reason LIKE '%passive%' THEN subject_id ELSE object_id END AS object_id FROM x WHERE reason IS NOT NULL", "shape_claims nodes")
def predicate_shape_repair(t):
    return H.shape_repair(t.shape_claims, t.nodes)


@query(f"WITH r AS (SELECT *, round(ln(1 + count(*) OVER (PARTITION BY subject_id)) + least(greatest(date_diff('second', stated_at, {_NOW}) / 86400.0::DOUBLE, 0), 365) * 0.01::DOUBLE, 9) AS score FROM status_claims WHERE scope = 'personal' AND asserted_by_kind <> 'assistant_inferred'), c AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, claim_id) AS n FROM r) SELECT claim_id, subject_id, score FROM c WHERE n <= 5 ORDER BY score DESC, claim_id LIMIT 40", "status_claims")
def atlas_rank(t):
    return H.atlas_rank(t.status_claims, _now())


@query("SELECT n.node_id FROM nodes n WHERE node_type = 'Object' AND NOT EXISTS (SELECT 1 FROM node_vectors v WHERE v.node_id = n.node_id)", "nodes node_vectors")
def missing_embeddings(t):
    return H.missing_vectors(t.nodes.where("node_type = 'Object'"), t.node_vectors).select("node_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY stated_at DESC, claim_id) AS n FROM status_claims) SELECT subject_id, string_agg(predicate || ' ' || statement, chr(10) ORDER BY n) AS facts FROM r WHERE n <= 3 GROUP BY subject_id", "status_claims")
def node_fact_lines(t):
    return H.fact_lines(t.status_claims, 3)


@query("WITH c AS (SELECT claim_id, CASE WHEN claim_id LIKE 'S1%' THEN NULL ELSE source_id END AS source_id, subject_id FROM status_claims), f AS (SELECT claim_id, arg_min(l.source_id, (s.created_at, l.source_id)) AS found FROM c JOIN source_links l ON l.node_id = subject_id JOIN source_rows s ON s.source_id = l.source_id WHERE c.source_id IS NULL GROUP BY claim_id) SELECT claim_id, coalesce(source_id, found) AS source_id FROM c LEFT JOIN f USING (claim_id)", "status_claims source_links source_rows")
def claim_source_backfill(t):
    claims = t.status_claims.withColumn("source_id", F.when(~F.col("claim_id").startswith("S1"), F.col("source_id")))
    return H.source_of_claims(claims, t.source_links, t.source_rows).select("claim_id", "source_id")


@query()
def atlas_hash(t):
    return H.content_hash(H.atlas_rank(t.status_claims, _now()), "claim_id", "score")


@query("SELECT effective, count(*) AS n FROM (SELECT CASE WHEN bool_and(scope = 'reference') THEN 'reference' ELSE 'personal' END AS effective FROM place_claims GROUP BY subject_id) GROUP BY ALL", "place_claims")
def scope_flags(t):
    nodes = t.place_claims.select(F.col("subject_id").alias("node_id")).distinct()
    none = t.source_links.where("1 = 0")
    return effective_scope(nodes, t.place_claims.withColumn("object_id", F.lit(None).cast("string")), none, t.source_rows).groupBy(F.col("effective_scope").alias("effective")).agg(F.count(F.lit(1)).alias("n"))


def _statement_vectors(t):
    return t.embeddings.select(F.concat(F.lit("S"), F.col("vec_id").cast("string")).alias("claim_id"), "embedding")


@query()
def explicit_search(t):
    return R.explicit_search(t.nodes, t.node_vectors, t.claims, _statement_vectors(t), t.source_links, t.source_rows, _Q, "status rods", 10, types=("Object",), at=_now())


_SUPPORT = """u AS (SELECT * FROM claims WHERE status = 'active' AND user_id = 'u1'),
    sup AS (SELECT subject_id AS node_id FROM u WHERE scope = 'personal' UNION SELECT object_id FROM u WHERE scope = 'personal' AND object_id IS NOT NULL
            UNION SELECT node_id FROM source_links l JOIN source_rows s ON s.source_id = l.source_id WHERE s.scope = 'personal' AND s.user_id = 'u1')"""


@query(
    f"""WITH {_SUPPORT},
    n AS (SELECT node_id AS id, {_SIM} AS similarity FROM node_vectors WHERE {_SIM} >= 0.1 AND node_id IN (SELECT node_id FROM nodes WHERE user_id = 'u1' AND node_type <> 'Temporal' AND node_id IN (SELECT node_id FROM sup))
          ORDER BY similarity DESC, id LIMIT 8),
    v AS (SELECT 'S' || vec_id AS id, embedding FROM embeddings),
    c AS (SELECT id, {_SIM} AS similarity FROM v WHERE {_SIM} >= 0.1 AND id IN (SELECT claim_id FROM u WHERE scope = 'personal' AND asserted_by_kind <> 'assistant_inferred' AND (valid_to IS NULL OR valid_to > {_NOW}))
          ORDER BY similarity DESC, id LIMIT 8),
    ends AS (SELECT subject_id AS id FROM u WHERE claim_id IN (SELECT id FROM c) UNION SELECT object_id FROM u WHERE claim_id IN (SELECT id FROM c) AND object_id IS NOT NULL UNION SELECT id FROM n),
    e AS (SELECT subject_id AS a, object_id AS b FROM u WHERE object_id IS NOT NULL AND scope = 'personal' AND asserted_by_kind <> 'assistant_inferred'),
    h AS (SELECT b AS id FROM e WHERE a IN (SELECT id FROM ends) UNION SELECT a FROM e WHERE b IN (SELECT id FROM ends)),
    near AS (SELECT id FROM h WHERE id NOT IN (SELECT id FROM ends) AND id IN (SELECT node_id FROM nodes WHERE label IS NOT NULL) ORDER BY id LIMIT 50),
    every AS (SELECT 'node' AS kind, id, similarity FROM n UNION ALL SELECT 'claim', id, similarity FROM c UNION ALL SELECT 'neighbour', id, NULL FROM near)
    SELECT kind, id, similarity, (SELECT string_agg(source_id, ',' ORDER BY source_id) FROM source_links l WHERE l.node_id = every.id) AS source_ids FROM every""",
    "claims nodes node_vectors source_links source_rows",
)
def memory_search(t):
    found = R.memory_search(t.nodes, t.node_vectors, t.claims, _statement_vectors(t), t.source_links, t.source_rows, _Q, 8, 0.1, "u1", ("Temporal",), _now())
    return found.withColumn("source_ids", F.array_join("source_ids", ","))


def _cards_sql(scope: str) -> str:
    """The card search in SQL: candidates in order, scope by all signals, cards with their facts, evidence of claims whose subject has a card."""
    nodes = "AND node_id IN (SELECT node_id FROM sup)" if scope == "personal" else ""
    claims = "AND scope = 'personal'" if scope == "personal" else ""
    return f"""WITH every AS (SELECT * REPLACE (CASE WHEN object_id LIKE 'X%1' THEN 'reference' WHEN object_id LIKE 'X%' THEN 'personal' ELSE scope END AS scope) FROM claims WHERE user_id = 'u1'),
    u AS (SELECT * FROM every WHERE status = 'active'),
    mine AS (SELECT l.node_id, s.scope FROM source_links l JOIN source_rows s ON s.source_id = l.source_id WHERE s.user_id = 'u1'),
    sup AS (SELECT subject_id AS node_id FROM u WHERE scope = 'personal' UNION SELECT object_id FROM u WHERE scope = 'personal' AND object_id IS NOT NULL UNION SELECT node_id FROM mine WHERE scope = 'personal'),
    own AS (SELECT * FROM nodes WHERE user_id = 'u1'),
    n AS (SELECT node_id, {_SIM} AS similarity FROM node_vectors WHERE {_SIM} >= 0.1 AND node_id IN (SELECT node_id FROM own WHERE label IS NOT NULL AND node_type <> 'Temporal' {nodes}) ORDER BY similarity DESC, node_id LIMIT 12),
    c AS (SELECT 'S' || vec_id AS claim_id, {_SIM} AS similarity FROM embeddings
          WHERE {_SIM} >= 0.1 AND 'S' || vec_id IN (SELECT claim_id FROM u WHERE asserted_by_kind <> 'assistant_inferred' AND (valid_to IS NULL OR valid_to > {_NOW}) {claims}) ORDER BY similarity DESC, claim_id LIMIT 12),
    h AS (SELECT claim_id, source_id, subject_id, object_id, row_number() OVER (ORDER BY similarity DESC, claim_id) - 1 AS r FROM c JOIN u USING (claim_id)),
    pool AS (SELECT node_id, row_number() OVER (ORDER BY similarity DESC, node_id) AS place FROM n UNION ALL SELECT subject_id, 1000 + 2 * r FROM h UNION ALL SELECT object_id, 1001 + 2 * r FROM h WHERE object_id IS NOT NULL),
    f AS (SELECT node_id, min(place) AS place FROM pool GROUP BY node_id),
    sig AS (SELECT subject_id AS node_id, scope FROM every UNION ALL SELECT object_id, scope FROM every WHERE object_id IS NOT NULL UNION ALL SELECT node_id, scope FROM mine),
    eff AS (SELECT node_id, CASE WHEN bool_and(scope = 'reference') THEN 'reference' ELSE 'personal' END AS scope FROM sig WHERE node_id IN (SELECT node_id FROM f) GROUP BY node_id),
    kept AS (SELECT o.node_id, label, coalesce(eff.scope, 'personal') AS scope, row_number() OVER (ORDER BY place) - 1 AS pos FROM f JOIN own o ON o.node_id = f.node_id LEFT JOIN eff ON eff.node_id = f.node_id
             WHERE coalesce(eff.scope, 'personal') = '{scope}' ORDER BY place LIMIT 12),
    fact AS (SELECT subject_id AS node_id, predicate || '=' || arg_max(object_value, (stated_at, claim_id)) AS fact FROM u WHERE object_value IS NOT NULL AND asserted_by_kind <> 'assistant_inferred' GROUP BY subject_id, predicate)
    SELECT 'card' AS kind, pos, node_id AS id, label, scope, (SELECT string_agg(fact, ';' ORDER BY fact) FROM fact WHERE fact.node_id = kept.node_id) AS facts,
           (SELECT min(source_id) FROM source_links l WHERE l.node_id = kept.node_id) AS source_id FROM kept
    UNION ALL SELECT 'evidence', r, claim_id, NULL, NULL, NULL, source_id FROM h WHERE subject_id IN (SELECT node_id FROM kept)"""


def _cards(t, scope: str):
    """Claims about parts whose number ends in 1 are reference, those about other parts personal, so that nodes of both scopes exist."""
    target = F.col("object_id")
    placed = F.when(target.like("X%1"), "reference").when(target.like("X%"), "personal").otherwise(F.col("scope"))
    cards, evidence = R.card_search(t.nodes, t.node_vectors, t.claims.withColumn("scope", placed), _statement_vectors(t), t.source_links, t.source_rows, t.aliases, _Q, 12, scope, 0.1, "u1", ("Temporal",), _now())
    none = F.lit(None).cast("string")
    cards = cards.select(F.lit("card").alias("kind"), "pos", F.col("node_id").alias("id"), "label", "scope", F.array_join("facts", ";").alias("facts"), "source_id")
    return cards.unionByName(evidence.select(F.lit("evidence").alias("kind"), "pos", F.col("claim_id").alias("id"), *[none.alias(c) for c in ("label", "scope", "facts")], "source_id"))


_CARD_TABLES = "claims nodes node_vectors source_links source_rows"


@query(_cards_sql("personal"), _CARD_TABLES)
def card_search_memory(t):
    return _cards(t, "personal")


@query(_cards_sql("reference"), _CARD_TABLES)
def card_search_reference(t):
    return _cards(t, "reference")
