"""Claim-graph tables derived from the star schema, as SQL that Spark and other engines read alike."""

from __future__ import annotations

from functools import cache, cached_property, reduce

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_KIND = "CASE substring({0}, 1, 1) WHEN '1' THEN 'user' WHEN '2' THEN 'user_confirmed' WHEN '3' THEN 'participant' WHEN '4' THEN 'document_author' ELSE 'assistant_inferred' END"
_ORDER = (
    f"'src' || CAST(o_orderkey % 50 AS STRING) AS source_id, CASE WHEN o_orderkey % 10 = 0 THEN 'reference' ELSE 'personal' END AS scope, {_KIND.format('o_orderpriority')} AS asserted_by_kind, "
    "CAST(NULL AS STRING) AS asserted_by_id, o_orderdate AS stated_at, CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, 'active' AS status, "
    "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL '3' DAY END AS created_at, o_orderdate + INTERVAL '5' DAY AS updated_at"
)
_HEAD = "SELECT '{letter}' || CAST(o_orderkey AS STRING) AS claim_id, 'u' || CAST(o_custkey % 5 AS STRING) AS user_id, {subject} AS subject_id, {object} AS object_id, {value} AS object_value, '{predicate}' AS predicate, {statement} AS statement, "
_NULL, _CUST, _TASK = "CAST(NULL AS STRING)", "'C' || CAST(o_custkey AS STRING)", "'T' || CAST(o_orderkey AS STRING)"
_STATE = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'done' END"
_DUE = "(SELECT l_orderkey, CAST(CAST(min(l_shipdate) AS DATE) AS STRING) AS due FROM {lineitem} GROUP BY l_orderkey)"

#: Name -> query. {table} stands for a table of the star schema.
TABLES = {
    "status_claims": _HEAD.format(letter="S", subject=_CUST, object=_NULL, value="o_orderstatus", predicate="HAS_STATUS", statement="'status ' || o_orderstatus") + _ORDER + " FROM {orders}",
    "task_claims": _HEAD.format(letter="K", subject=_TASK, object=_NULL, value=_STATE, predicate="HAS_TASK_STATUS", statement=f"'task is ' || {_STATE}") + _ORDER + " FROM {orders} WHERE o_orderkey % 13 <> 0",
    "owner_claims": _HEAD.format(letter="A", subject=_TASK, object=_CUST, value=_NULL, predicate="ASSIGNED_TO", statement="'assigned'") + _ORDER + " FROM {orders} WHERE o_orderkey % 7 <> 0",
    "due_claims": _HEAD.format(letter="D", subject=_TASK, object="'day:' || due", value=_NULL, predicate="DUE_ON", statement="'due on ' || due") + _ORDER + " FROM {orders} JOIN " + _DUE + " d ON o_orderkey = l_orderkey",
    "use_claims": (
        "SELECT 'U' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS claim_id, 'u' || CAST(o_custkey % 5 AS STRING) AS user_id, 'T' || CAST(l_orderkey AS STRING) AS subject_id, 'X' || CAST(l_partkey AS STRING) AS object_id, "
        "CAST(NULL AS STRING) AS object_value, 'RELATED_TO' AS predicate, 'uses part' AS statement, 'src' || CAST(l_orderkey % 50 AS STRING) AS source_id, CASE WHEN l_suppkey % 10 = 0 THEN 'reference' ELSE 'personal' END AS scope, "
        "CASE l_returnflag WHEN 'A' THEN 'user' WHEN 'N' THEN 'participant' ELSE 'assistant_inferred' END AS asserted_by_kind, CAST(NULL AS STRING) AS asserted_by_id, l_shipdate AS stated_at, CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, "
        "CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'retracted' END AS status, l_shipdate AS created_at, l_shipdate AS updated_at FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
    ),
    "place_claims": (
        "SELECT 'L' || CAST(c_custkey AS STRING) AS claim_id, 'u' || CAST(c_custkey % 5 AS STRING) AS user_id, 'C' || CAST(c_custkey AS STRING) AS subject_id, 'N' || CAST(c_nationkey AS STRING) AS object_id, CAST(NULL AS STRING) AS object_value, "
        "'LOCATED_IN' AS predicate, 'lives there' AS statement, 'src' || CAST(c_custkey % 50 AS STRING) AS source_id, 'personal' AS scope, 'user' AS asserted_by_kind, CAST(NULL AS STRING) AS asserted_by_id, TIMESTAMP '1994-01-01 00:00:00' AS stated_at, "
        "CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, 'active' AS status, TIMESTAMP '1994-01-01 00:00:00' AS created_at, TIMESTAMP '1994-01-01 00:00:00' AS updated_at FROM {customer}"
    ),
    "nodes": (
        "SELECT 'C' || CAST(c_custkey AS STRING) AS node_id, 'u' || CAST(c_custkey % 5 AS STRING) AS user_id, 'Person' AS node_type, c_name AS label, TIMESTAMP '1994-01-01 00:00:00' AS created_at FROM {customer} "
        "UNION ALL SELECT 'T' || CAST(o_orderkey AS STRING), 'u' || CAST(o_custkey % 5 AS STRING), 'Task', 'Order ' || CAST(o_orderkey AS STRING), o_orderdate FROM {orders} "
        "UNION ALL SELECT 'X' || CAST(p_partkey AS STRING), 'u' || CAST(p_partkey % 5 AS STRING), 'Object', p_name, TIMESTAMP '1994-06-01 00:00:00' FROM {part} "
        "UNION ALL SELECT 'O' || CAST(s_suppkey AS STRING), 'u' || CAST(s_suppkey % 5 AS STRING), 'Organization', s_name, TIMESTAMP '1994-02-01 00:00:00' FROM {supplier} "
        "UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'u' || CAST(n_nationkey % 5 AS STRING), 'Location', n_name, TIMESTAMP '1994-01-01 00:00:00' FROM {nation} "
        "UNION ALL SELECT DISTINCT 'day:' || due, 'u0', 'Temporal', due, TIMESTAMP '1994-01-01 00:00:00' FROM " + _DUE + " x"
    ),
    "source_links": "SELECT DISTINCT 'src' || CAST(o_orderkey % 50 AS STRING) AS source_id, 'C' || CAST(o_custkey AS STRING) AS node_id FROM {orders} WHERE o_custkey % 3 <> 0",
    "source_rows": (
        "SELECT 'src' || CAST(o_orderkey % 50 AS STRING) AS source_id, 'u' || CAST((o_orderkey % 50) % 5 AS STRING) AS user_id, CASE WHEN (o_orderkey % 50) % 3 = 0 THEN 'document' ELSE 'conversation' END AS type, 'ext-' || CAST(o_orderkey % 50 AS STRING) AS external_id, "
        "CASE WHEN o_orderkey % 50 >= 10 THEN 'src' || CAST((o_orderkey % 50) % 10 AS STRING) END AS parent_id, CASE WHEN (o_orderkey % 50) % 4 = 0 THEN 'reference' ELSE 'personal' END AS scope, min(o_orderdate) AS created_at, "
        "CASE WHEN (o_orderkey % 50) % 5 <> 0 THEN max(o_orderdate) END AS last_ingested_at, CASE WHEN (o_orderkey % 50) % 2 = 0 THEN '{{\"title\": \"Source ' || CAST(o_orderkey % 50 AS STRING) || '\"}}' ELSE '{{\"filename\": \"f.md\"}}' END AS metadata, "
        "CASE WHEN (o_orderkey % 50) = 49 THEN max(o_orderdate) END AS deleted_at FROM {orders} GROUP BY o_orderkey % 50"
    ),
    "aliases": "SELECT 'u' || CAST(p_partkey % 5 AS STRING) AS user_id, upper(p_name) || ' ' AS alias_text, lower(p_name) AS normalized_alias_text, 'X' || CAST(p_partkey AS STRING) AS node_id FROM {part} WHERE p_partkey % 4 = 0",
    "redirects": "SELECT 'X' || CAST(p_partkey AS STRING) AS from_id, 'X' || CAST(p_partkey - 1 AS STRING) AS to_id FROM {part} WHERE p_partkey % 10 = 9",
    "observations": "SELECT event_id AS observation_id, event_type AS metric, 'u' || CAST(user_id % 5 AS STRING) AS user_id, value, ts AS occurred_at FROM {events}",
    "definitions": "SELECT DISTINCT event_type AS metric, upper(event_type) AS label, CASE WHEN event_type < 'm' THEN 'avg' ELSE 'sum' END AS aggregation_hint, CAST(0 AS DOUBLE) AS valid_min, CAST(400 AS DOUBLE) AS valid_max, event_type > 's' AS needs_review FROM {events}",
    "node_vectors": "SELECT 'X' || CAST(vec_id AS STRING) AS node_id, 'u' || CAST(vec_id % 5 AS STRING) AS user_id, embedding, label FROM {embeddings}",
    "person_vectors": "SELECT 'C' || CAST(vec_id AS STRING) AS node_id, 'u' || CAST(vec_id % 5 AS STRING) AS user_id, embedding, label FROM {embeddings}",
    "turns": "SELECT 'conv-' || CAST(conv_id AS STRING) AS conversation_id, conv_id, turn, role, text FROM {conversations}",
}
_CLAIM_PARTS = ("status_claims", "task_claims", "owner_claims", "due_claims", "use_claims", "place_claims")
#: Claims of every predicate that the registry of shapes knows, most of them of a wrong shape.
_EVERY = ("PARTICIPATED_IN", "OCCURRED_AT", "OCCURRED_ON", "RECORDED_ON", "INVOLVED_ITEM", "EXHIBITED_EMOTION", "TAGGED_WITH", "ASSIGNED_TO", "DUE_ON", "PRECEDES", "FOLLOWS", "WORKS_AT", "FOUNDED", "CREATED", "LOCATED_IN", "PART_OF", "USES", "OWNS", "AFFILIATED_WITH", "RELATED_TO", "OWNED_BY", "HAS_STATUS")
_ANY = "CASE {0} % 22 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_EVERY)) + " END AS predicate"
TABLES["shape_claims"] = " UNION ALL ".join(
    f"SELECT '{letter}' || CAST(o_orderkey AS STRING) AS claim_id, {subject} AS subject_id, {target} AS object_id, CAST(NULL AS STRING) AS object_value, {_ANY.format(key)}, 'active' AS status FROM {{orders}}"
    for letter, subject, target, key in (("a", _TASK, _CUST, "o_orderkey"), ("b", _CUST, _TASK, "(o_orderkey + 1)"), ("c", _CUST, "'N' || CAST(o_custkey % 25 AS STRING)", "(o_orderkey + 2)"), ("d", "'N' || CAST(o_custkey % 25 AS STRING)", _CUST, "(o_orderkey + 3)"), ("e", "'X' || CAST(o_orderkey % 200 AS STRING)", "'O' || CAST(o_orderkey % 10 AS STRING)", "(o_orderkey + 4)"))
)
TABLES["claims"] = " UNION ALL ".join(f"({TABLES[p]})" for p in _CLAIM_PARTS)


#: Rows of lineitem that a task joins with their orders at most, so that its memory doesn't grow with the table.
TASK_ROWS = 500_000


class Tables:
    """Raw and derived tables by attribute. Nothing is cached or collected; unused columns are pruned from the scans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def order_parts(self) -> int:
        """In how many parts lineitem is dealt by order: as many as TASK_ROWS asks for, 0 if the session's shuffles have enough. The rows are counted from the files' footers."""
        n = -(-self.lineitem.count() // TASK_ROWS)
        return n if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else 0

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "claims":  # as in TABLES, with each part dealt as it needs
            return reduce(DataFrame.unionAll, [getattr(self, p) for p in _CLAIM_PARTS])
        if name in TABLES:
            text = TABLES[name]
            used = {r: getattr(self, r) for r in RAW if f"{{{r}}}" in text}
            if name in ("use_claims", "due_claims") and self.order_parts:
                used["lineitem"] = used["lineitem"].repartition(self.order_parts, "l_orderkey")
            return self.spark.sql(text, **used)
        raise AttributeError(name)


@cache
def sql_of(*names: str) -> str:
    """WITH clause for the derived tables, over views named like the raw ones."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].format(**{r: r for r in RAW})})" for n in names)
