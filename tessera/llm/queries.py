"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact, html, lattice, lines, mixing, negatives, packing, phrases, pii, simhash, suffixes, toxicity
from .common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), train=lambda key: ~toxicity.held_out(key))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits", "words")


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrases.remove_phrases(spark, read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


def op5_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.embedding_groups(spark, read(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read(spark, sf_dir, "documents"))[2].drop("_row", "_first")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_substrings(spark, read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tessera.surrogate.key", None) or "known to all: for tests only"
    return pii.replace_personal_data(spark, read(spark, sf_dir, "documents"), key)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spark, read(spark, sf_dir, "documents"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(spark, vectors, F.col("vec_id") % 100 == 0, label=label)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_lines(spark, read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(spark, read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_repeated_phrases": op2_repeated_phrases,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_text": op4_html_text,
    "op5_lattice_near_dedup": op5_lattice_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_surrogates": op8_surrogates,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
}

SQL = {
    "op3_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
               s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        QUALIFY rank <= 5""",
    "op12_line_dedup": r"""
        WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM rows),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
        repeated AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
        judged AS (
            SELECT k.*, t.top IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < t.top) AS gone FROM keyed k LEFT JOIN repeated t USING (key))
        SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY r""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(total) AS n_all FROM kept GROUP BY lang),
        g AS (
            SELECT lang, source, coalesce(s.n, 0) AS n, coalesce(v.v, 0) AS v, v.n_all FROM (SELECT DISTINCT lang, source FROM d)
            LEFT JOIN (SELECT lang, source, sum(n) AS n FROM n GROUP BY ALL) s USING (lang, source) LEFT JOIN v USING (lang)),
        p AS (
            SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (g.n + 5 * g.v) AS p,
                   1 + (1000000000::HUGEINT * (kept.total + 5)) // (g.n_all + 5 * g.v) AS q
            FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
        pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                       FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
                   ON f.lang = a.lang AND f.source = a.source AND f.item = b.source)
        SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
        UNION ALL
        SELECT lang, source, 'term', term, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INTEGER AS rank
        FROM p WHERE c > 0 AND p > q QUALIFY rank <= 50""",
}
