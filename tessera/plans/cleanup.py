"""Queries on what a cleanup sees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.subgraph import cleanup_subgraph
from .registry import query

_NEEDS = "claims nodes node_vectors source_links source_rows aliases"
_FOUND = """own AS (SELECT * FROM nodes WHERE user_id = 'u1' AND label IS NOT NULL),
    act AS (SELECT * FROM claims WHERE status = 'active' AND user_id = 'u1' AND scope = 'personal'),
    sup AS (SELECT subject_id AS node_id FROM act UNION SELECT object_id FROM act WHERE object_id IS NOT NULL
            UNION SELECT node_id FROM source_links l JOIN source_rows s ON s.source_id = l.source_id WHERE s.scope = 'personal' AND s.user_id = 'u1'),
    seeds AS (SELECT node_id FROM node_vectors WHERE user_id = 'u1' AND node_id IN (SELECT node_id FROM own) ORDER BY node_id LIMIT 3),
    sims AS (SELECT s.node_id AS seed, v.node_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
             FROM seeds s JOIN node_vectors q ON q.node_id = s.node_id JOIN node_vectors v ON v.user_id = 'u1' AND v.node_id <> s.node_id
             WHERE v.node_id IN (SELECT node_id FROM sup) AND v.node_id IN (SELECT node_id FROM own)),
    near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, node_id) <= 6),
    f0 AS (SELECT node_id, 0 AS ring, node_id AS seed, 0.0::DOUBLE AS far FROM seeds UNION ALL SELECT node_id, 1, seed, -similarity FROM near WHERE similarity >= 0.1),
    f1 AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ring, seed, far) = 1),
    e AS (SELECT subject_id AS a, object_id AS b FROM act WHERE object_id IS NOT NULL UNION SELECT object_id, subject_id FROM act WHERE object_id IS NOT NULL),
    r1 AS (SELECT DISTINCT b AS node_id FROM e JOIN own ON own.node_id = b WHERE a IN (SELECT node_id FROM f1) AND b NOT IN (SELECT node_id FROM f1) ORDER BY 1 LIMIT 50),
    r2s AS (SELECT DISTINCT b AS node_id FROM e JOIN own ON own.node_id = b WHERE a IN (SELECT node_id FROM r1) AND b NOT IN (SELECT node_id FROM r1) ORDER BY 1 LIMIT 50),
    f AS (SELECT * FROM f1 UNION ALL SELECT node_id, 2, '', 0.0 FROM r1 UNION ALL SELECT node_id, 3, '', 0.0 FROM r2s WHERE node_id NOT IN (SELECT node_id FROM f1)),
    k AS (SELECT node_id, row_number() OVER (ORDER BY ring, seed, far, node_id) - 1 AS place FROM f QUALIFY place < 60)"""


def _built(t):
    vectors = t.node_vectors.where("user_id = 'u1'").join(t.nodes.where("user_id = 'u1'").select("node_id"), "node_id", "left_semi")
    seeds = vectors.orderBy("node_id").limit(3).select("node_id")
    return cleanup_subgraph(seeds, t.nodes, t.node_vectors, t.claims, t.source_links, t.source_rows, t.aliases, "u1", semantic_limit=6, hops=2, max_nodes=60, max_claims=80, least=0.1)


@query(
    f"""WITH {_FOUND},
    touch AS (SELECT claim_id, subject_id AS x FROM claims WHERE user_id = 'u1' UNION SELECT claim_id, object_id FROM claims WHERE user_id = 'u1' UNION SELECT claim_id, asserted_by_id FROM claims WHERE user_id = 'u1'),
    c AS (SELECT k.*, (SELECT count(*) FROM touch WHERE x = k.node_id) AS n_claims, (SELECT count(*) FROM source_links l WHERE l.node_id = k.node_id) AS n_links,
          (SELECT count(*) FROM aliases a WHERE a.user_id = 'u1' AND a.node_id = k.node_id) AS n_aliases FROM k)
    SELECT node_id, place::INTEGER AS place, n_claims, n_links, n_aliases, n_claims + n_links + n_aliases = 0 AS delete_allowed FROM c""",
    _NEEDS,
)
def cleanup_subgraph_nodes(t):
    return _built(t)[0].select("node_id", "place", "n_claims", "n_links", "n_aliases", "delete_allowed")


@query(
    f"""WITH {_FOUND}
    SELECT claim_id, predicate = 'DUE_ON' AND subject_id NOT LIKE 'T%' AS bad_shape, asserted_by_kind = 'assistant_inferred' OR (predicate = 'DUE_ON' AND subject_id NOT LIKE 'T%') AS retract_allowed,
           asserted_by_kind IN ('user', 'user_confirmed', 'participant', 'document_author') AS citation_allowed
    FROM claims WHERE user_id = 'u1' AND status = 'active' AND subject_id IN (SELECT node_id FROM k) AND (object_id IS NULL OR object_id IN (SELECT node_id FROM k))
    ORDER BY created_at DESC, claim_id DESC LIMIT 80""",
    _NEEDS,
)
def cleanup_subgraph_claims(t):
    return _built(t)[1].select("claim_id", "bad_shape", "retract_allowed", F.col("citation_allowed"))
