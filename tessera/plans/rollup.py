"""Queries on roll-ups, ingestion and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import period as P
from ..functions import text as X
from ..operators import ingest as N
from ..operators import rollup as U
from ..streaming.pipelines import event_buckets, run_to_table
from .registry import query

_WEEK = "strftime({0}::DATE, '%G-W%V')"


def _days(t):
    return t.orders.select(P.day_key(F.col("o_orderdate")).alias("day"), (F.col("o_orderdate") + F.expr("INTERVAL '2' DAY")).alias("created_at"))


@query(f"SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, {_WEEK.format('o_orderdate')} AS week, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year FROM orders")
def period_keys(t):
    return t.orders.select(U.period_keys(F.col("o_orderdate")).alias("k")).distinct().select("k.*")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(max(o_orderdate + INTERVAL 2 DAY) AS VARCHAR) AS last_at FROM orders WHERE o_orderdate + INTERVAL 2 DAY > TIMESTAMP '2001-07-01 00:00:00' GROUP BY 1")
def rollup_discovery(t):
    return U.touched_days(_days(t), F.lit("2001-07-01 00:00:00").cast("timestamp_ntz"))


@query(f"WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_orderdate + INTERVAL 2 DAY > TIMESTAMP '2001-07-01 00:00:00'), k AS (SELECT strftime(d, '%Y-%m-%d') AS key, 'day' AS level, d AS last FROM d UNION SELECT {_WEEK.format('d')}, 'week', (date_trunc('week', d) + INTERVAL 6 DAY)::DATE FROM d UNION SELECT strftime(d, '%Y-%m'), 'month', last_day(d) FROM d UNION SELECT strftime(d, '%Y'), 'year', make_date(year(d)::INT, 12, 31) FROM d UNION SELECT '2000-12', 'month', DATE '2000-12-31') SELECT key, level, last < DATE '2001-07-20' AS due FROM k")
def rollup_work_set(t):
    pending = t.spark.createDataFrame([("2000-12",)], "key string")
    return U.work_set(U.touched_days(_days(t), F.lit("2001-07-01 00:00:00").cast("timestamp_ntz")), pending, F.to_date(F.lit("2001-07-20")))


_ENTRIES = (
    "en AS (SELECT strftime(o_orderdate, '%Y-%m') AS day, o_orderdate AS at, o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey END AS label, CASE WHEN o_orderkey % 5 = 1 THEN repeat('long ', 130) WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS said FROM orders), "
    "ln AS (SELECT *, '- [Task] ' || coalesce(label, '(unlabeled)') || coalesce(': ' || said, '') AS whole FROM en WHERE label IS NOT NULL OR said IS NOT NULL), cu AS (SELECT *, CASE WHEN length(whole) <= 600 THEN whole ELSE substr(whole, 1, 599) || '…' END AS line FROM ln), "
    "s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY day ORDER BY at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS n FROM cu), d AS (SELECT day, 'Day: ' || day || CASE WHEN count(*) FILTER (WHERE n > 2000) > 0 THEN chr(10) || '(' || count(*) FILTER (WHERE n > 2000) || ' older entries omitted for length)' ELSE '' END || chr(10) || string_agg(line, chr(10) ORDER BY at, id) FILTER (WHERE n <= 2000) AS text, count(*) FILTER (WHERE n > 2000) AS omitted FROM s GROUP BY day)"
)


def _texts(t):
    key = F.col("o_orderkey")
    label, said = F.when(key % 3 != 0, F.concat(F.lit("Order "), key.cast("string"))), F.when(key % 5 == 1, F.repeat(F.lit("long "), F.lit(130))).when(key % 2 == 0, F.col("o_orderpriority"))
    entries = t.orders.select(P.month_key(F.col("o_orderdate")).alias("day"), F.col("o_orderdate").alias("at"), key.alias("id"), F.lit("Task").alias("node_type"), label.alias("label"), said.alias("description"))
    return U.day_texts(entries, day_cap=2000)


@query(f"WITH {_ENTRIES.replace(' AS at,', ' AS at_,').replace('BY at ', 'BY at_ ').replace('BY at,', 'BY at_,')} SELECT day, text, omitted FROM d")
def rollup_day_text(t):
    return _texts(t)


@query(f"WITH {_ENTRIES.replace(' AS at,', ' AS at_,').replace('BY at ', 'BY at_ ').replace('BY at,', 'BY at_,')} SELECT day AS key, sha256(text) AS fingerprint FROM d WHERE day > '1998-01'")
def rollup_fingerprint(t):
    texts = _texts(t).select(F.col("day").alias("key"), "text")
    stored = texts.where("key <= '1998-01'").select("key", F.sha2("text", 256).alias("fingerprint"))
    return U.fingerprints(texts, stored).select("key", "fingerprint")


@query(f"WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS key, o_orderdate::DATE AS d, CASE WHEN day(any_value(o_orderdate)) % 2 = 0 THEN count(*) || ' orders' END AS summary FROM orders GROUP BY 1, 2) SELECT {_WEEK.format('d')} AS parent, string_agg(key || ': ' || coalesce(summary, '(no summarized activity)'), chr(10) ORDER BY key) AS text FROM d GROUP BY 1 HAVING count(summary) > 0")
def rollup_week_text(t):
    days = t.orders.groupBy(P.day_key(F.col("o_orderdate")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", F.when(F.dayofmonth(F.to_date("key")) % 2 == 0, F.concat(F.col("n").cast("string"), F.lit(" orders"))).alias("summary"))
    return U.parent_texts(days, "week")


@query(f"WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT strftime(d, '%Y-%m-%d') AS child, {_WEEK.format('d')} AS parent FROM d WHERE day(d) % 3 <> 0")
def rollup_part_of(t):
    days = t.orders.select(P.day_key(F.col("o_orderdate")).alias("day")).distinct()
    weeks = days.select(P.week_key(F.to_date("day")).alias("key")).distinct()
    edges = days.where(F.dayofmonth(F.to_date("day")) % 3 == 0).select(F.col("day").alias("child"), P.week_key(F.to_date("day")).alias("parent"))
    return U.missing_children(weeks, days, edges)


@query("SELECT external_id, min(source_id) AS source_id FROM (SELECT 'e' || (doc_id % 300) AS external_id, lpad(doc_id::VARCHAR, 9, '0') AS source_id FROM documents) WHERE external_id NOT IN (SELECT 'e' || (page_id % 300) FROM pages WHERE page_id < 100) GROUP BY external_id")
def source_insert_new(t):
    inc = t.documents.select(F.lit("u").alias("user_id"), F.lit("document").alias("type"), F.concat(F.lit("e"), F.col("doc_id") % 300).alias("external_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("source_id"))
    old = t.pages.where("page_id < 100").select(F.lit("u").alias("user_id"), F.lit("document").alias("type"), F.concat(F.lit("e"), F.col("page_id") % 300).alias("external_id"))
    return N.insert_new(old, inc).select("external_id", "source_id")


@query("WITH n AS (SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), m AS (SELECT 'p' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0) SELECT path, CASE WHEN hash IS NULL THEN 'added' WHEN text IS NULL THEN 'removed' WHEN sha256(text) = hash THEN 'same' ELSE 'changed' END AS change FROM n FULL JOIN m USING (path)")
def manifest_changes(t):
    path = F.concat(F.lit("p"), "doc_id").alias("path")
    now = t.documents.where("doc_id % 7 <> 0").select(path, F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return N.changed_files(now, t.documents.where("doc_id % 11 <> 0").select(path, F.sha2("text", 256).alias("hash"))).select("path", "change")


@query("SELECT conversation_id, '<conversation>' || chr(10) || string_agg('<message role=\"' || role || '\">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</message>', chr(10) ORDER BY turn) || chr(10) || '</conversation>' AS xml FROM turns GROUP BY conversation_id", "turns")
def conversation_xml(t):
    return N.conversation_xml(t.turns)


@query("SELECT conversation_id || ':' || turn AS external_id, 'conversation_message' AS type FROM turns UNION ALL SELECT DISTINCT conversation_id, 'conversation' FROM turns", "turns")
def conversation_sources(t):
    return N.messages_as_sources(t.turns).select("external_id", "type")


@query()
def chunk_markdown(t):
    return N.chunks(t.documents)


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 19) || '…' END AS short FROM documents")
def text_functions(t):
    return t.documents.select("doc_id", X.slugify(F.col("text")).alias("slug"), X.truncate(F.col("text"), 20).alias("short"))


@query("SELECT source_id, coalesce(json_extract_string(metadata, '$.title'), json_extract_string(metadata, '$.filename')) AS title FROM source_rows", "source_rows")
def source_titles(t):
    return t.source_rows.select("source_id", F.coalesce(F.get_json_object("metadata", "$.title"), F.get_json_object("metadata", "$.filename")).alias("title"))


@query("SELECT event_type AS metric, CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS bucket, count(*) AS n, round(sum(value), 6) AS sum FROM events GROUP BY ALL")
def stream_event_buckets(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return run_to_table(event_buckets(stream), f"buckets_{uuid.uuid4().hex}").select("metric", "bucket", "n", F.round("sum", 6).alias("sum"))
