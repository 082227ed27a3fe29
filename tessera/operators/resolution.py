"""Identity of nodes: four signals as a cascade in which each runs only for what the earlier ones left open, and its re-evaluation for nodes of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from ..functions.vector import nearest_in_blocks
from ..storage import new_folder, saved
from ..vocab import PROFILE_KINDS
from .filters import endpoints
from .identity import EMBEDDING_LEAST, PROFILE_LEAST

#: How many of the nearest nodes are looked at, and how many of one type and scope are compared by profile.
NEAREST, COMPARED = 25, 5
SCOPES = ("personal", "reference")


def scope_support(claims: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (user_id, node_id, scope) that active claims and sources of the user give a node."""
    by_claim = endpoints(claims.where("status = 'active'").select("user_id", "subject_id", "object_id", "scope")).select("user_id", "node_id", "scope")
    by_source = links.select("source_id", "node_id").join(sources.select("source_id", "user_id", "scope"), "source_id").select("user_id", "node_id", "scope")
    return by_claim.unionByName(by_source).distinct()


def scope_sets(nodes: DataFrame, support: DataFrame) -> DataFrame:
    """Nodes (node_id, user_id, ...) with the set of scopes they have support in, personal if none, and their own scope: personal if they have it. ``supported`` tells whether any was found."""
    sets = support.groupBy("user_id", "node_id").agg(F.array_sort(F.collect_set("scope")).alias("_found"))
    rows = nodes.join(sets, ["user_id", "node_id"], "left").withColumn("scopes", F.coalesce("_found", F.array(F.lit("personal"))))
    own = F.when(F.array_contains("scopes", "personal"), "personal").otherwise("reference")
    return rows.withColumn("supported", F.col("_found").isNotNull()).withColumn("scope", own).drop("_found")


def profile_keys(claims: DataFrame, scope: str | None = None) -> DataFrame:
    """What trusted active claims say of each subject as distinct (node_id, key); a relation and a value never share a key."""
    rows = claims.where((F.col("status") == "active") & F.col("asserted_by_kind").isin(*PROFILE_KINDS))
    rows = rows.where(F.col("scope") == scope) if scope else rows
    key = F.when(F.col("object_id").isNotNull(), F.concat_ws("|", F.lit("rel"), "predicate", "object_id")).otherwise(F.concat_ws("|", F.lit("attr"), "predicate", F.coalesce("object_value", F.lit(""))))
    return rows.select(F.col("subject_id").alias("node_id"), key.alias("key")).distinct()


def _exact(open_rows: DataFrame, known: DataFrame, key: list[str], name: str) -> DataFrame:
    """Candidates of an exact key: per row how many other nodes of its scope have the key (n_), the one if it is one (_), and whether only other scopes have it.

    ``known`` holds each node once per key. It is counted per key with its two smallest ids, so that no pairs of a common key are made; two ids tell which is the other one.
    """
    has = lambda s: F.array_contains("scopes", s)
    counts = [c for s in SCOPES for c in (F.count_if(has(s)).alias(f"_n_{s}"), F.min(F.when(has(s), F.col("node_id"))).alias(f"_lo_{s}"), F.max(F.when(has(s), F.col("node_id"))).alias(f"_hi_{s}"))]
    table = known.groupBy(*key).agg(F.count(F.lit(1)).alias("_all"), *counts)
    own = known.select("node_id", *key).withColumn("_self", F.lit(True))
    rows = open_rows.join(table, key, "left").join(own, ["node_id", *key], "left")
    pick = lambda c: F.when(F.col("scope") == "personal", F.col(f"_{c}_personal")).otherwise(F.col(f"_{c}_reference"))
    me = F.coalesce("_self", F.lit(False)).cast("int")
    n = F.greatest(F.coalesce(pick("n"), F.lit(0)) - me, F.lit(0))
    other = F.when(pick("lo") == F.col("node_id"), pick("hi")).otherwise(pick("lo"))
    refused = (n == 0) & (F.coalesce("_all", F.lit(0)) - me > 0)
    return rows.select(*open_rows.columns, n.alias(f"n_{name}"), F.when(n == 1, other).alias(f"_{name}"), refused.alias(f"refused_{name}"))


def _nearest(open_rows: DataFrame, pool: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The nearest nodes of the same user, type and scope: node_id, match_id, similarity.

    A personal row looks among nodes with personal support, a reference row among all. Where the row itself is in that pool it takes one of the places, both of the nearest and of those compared.
    """
    v = vectors.select("node_id", "embedding")
    views = F.when(F.array_contains("scopes", "personal") & F.col("supported"), F.array(*map(F.lit, SCOPES))).otherwise(F.array(F.lit("reference")))
    held = pool.where(F.col("label").isNotNull()).withColumn("view", F.explode(views)).select("node_id", "user_id", "view").join(v, "node_id")
    asked = open_rows.select("node_id", "user_id", F.col("scope").alias("view")).join(v, "node_id")
    near = nearest_in_blocks(asked, held, "node_id", "embedding", NEAREST, within=("user_id", "view")).where(F.col("similarity") >= least)
    inside = (F.col("scope") == "reference") | F.col("supported")
    mine = open_rows.select("node_id", F.col("node_type").alias("_type"), F.col("scope").alias("_scope"), inside.cast("int").alias("_me"))
    theirs = pool.select(F.col("node_id").alias("match_id"), F.col("node_type").alias("_their"), F.col("scopes").alias("_scopes"))
    order = W.partitionBy("node_id").orderBy(F.desc("similarity"), "match_id")
    rows = near.withColumnRenamed("match", "match_id").join(mine, "node_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= NEAREST - F.col("_me"))
    rows = rows.join(theirs, "match_id").where((F.col("_their") == F.col("_type")) & F.array_contains("_scopes", F.col("_scope")))
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= COMPARED - F.col("_me")).select("node_id", "match_id", "similarity")


def _by_profile(near: DataFrame, claims: DataFrame, least: float) -> DataFrame:
    """The best of the nearest by overlap of profiles, at least ``least``: node_id, match_id, score. Ties go to the more similar, then the smaller id."""
    mine, theirs = profile_keys(claims, "personal"), profile_keys(claims)
    a = mine.join(near.select("node_id").distinct(), "node_id", "left_semi")
    b = theirs.withColumnRenamed("node_id", "match_id").join(near.select("match_id").distinct(), "match_id", "left_semi")
    size = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = near.join(a, "node_id").join(b, ["match_id", "key"]).groupBy("node_id", "match_id").agg(F.count(F.lit(1)).alias("_both"), F.first("similarity").alias("similarity"))
    rows = both.join(size(a, "node_id", "_n"), "node_id").join(size(b, "match_id", "_m"), "match_id").withColumn("score", F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).where(F.col("score") >= least)
    best = F.struct((-F.col("score")).alias("s"), (-F.col("similarity")).alias("v"), "match_id")
    return rows.groupBy("node_id").agg(F.min(best).alias("_b")).select("node_id", F.col("_b.match_id").alias("match_id"), (-F.col("_b.s")).alias("score"))


def resolve(candidates: DataFrame, nodes: DataFrame, support: DataFrame, claims: DataFrame, aliases: DataFrame, vectors: DataFrame, least: float = EMBEDDING_LEAST, profile_least: float = PROFILE_LEAST) -> DataFrame:
    """Which node each candidate (node_id, user_id, node_type, label) is the same as: node_id, match_id, signal, confidence and the trace n_label, n_alias, refused_label, refused_alias.

    Signals in order: one other node of user, type, scope and canonical label; one that has the label as an alias; else of the nearest vectors the one whose profile of trusted claims overlaps most,
    at least ``profile_least``. Several nodes of an exact key decide nothing and the next signal is asked. Nearness alone never decides. A node never matches itself. Null and blank labels match
    nothing by label or alias. Repeated candidates count once. What a signal decides is written and left out of the next, so that vectors are compared only for rows that stay open.
    """
    work = new_folder(nodes.sparkSession, "identity")
    pool = saved(scope_sets(nodes.select("node_id", "user_id", "node_type", "label").dropDuplicates(["node_id"]), support), f"{work}/pool").withColumn("_c", normalize_label(F.col("label")))
    rows = pool.join(candidates.select("node_id").distinct(), "node_id", "left_semi").withColumn("_c", F.when(F.col("_c") != "", F.col("_c")))

    labelled = pool.where("_c <> ''").select("node_id", "user_id", "node_type", "_c", "scopes")
    first = saved(_exact(rows, labelled, ["user_id", "node_type", "_c"], "label"), f"{work}/label")
    named = aliases.select("user_id", F.col("normalized_alias_text").alias("_c"), "node_id").distinct().join(pool.select("node_id", "node_type", "scopes"), "node_id")
    rest = first.where("_label IS NULL")
    second = saved(_exact(rest, named, ["user_id", "node_type", "_c"], "alias"), f"{work}/alias")
    rest = second.where("_alias IS NULL")
    near = saved(_nearest(rest, pool, vectors, least), f"{work}/near")
    third = _by_profile(near, claims, profile_least)

    trace = ["n_label", "refused_label"]
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    by_label = first.where("_label IS NOT NULL").select("node_id", F.col("_label").alias("match_id"), F.lit("canonical_label").alias("signal"), F.lit(1.0).alias("confidence"), *trace, zero.alias("n_alias"), F.lit(False).alias("refused_alias"))
    trace += ["n_alias", "refused_alias"]
    by_alias = second.where("_alias IS NOT NULL").select("node_id", F.col("_alias").alias("match_id"), F.lit("alias").alias("signal"), F.lit(1.0).alias("confidence"), *trace)
    by_claims = rest.join(third, "node_id", "left").select("node_id", F.coalesce("match_id", none).alias("match_id"), F.when(F.col("match_id").isNotNull(), "profile_compat").otherwise("none").alias("signal"), F.coalesce("score", F.lit(0.0)).alias("confidence"), *trace)
    return by_label.unionByName(by_alias).unionByName(by_claims)


def reevaluate(ids: DataFrame, nodes: DataFrame, support: DataFrame, claims: DataFrame, aliases: DataFrame, vectors: DataFrame, least: float = EMBEDDING_LEAST, profile_least: float = PROFILE_LEAST) -> DataFrame:
    """What a second look at nodes (node_id) finds: node_id, status, match_id, signal, confidence. Nothing is changed; a proposal is for a later cleanup.

    Status: skipped_node_missing (no such node), skipped_no_label (null or blank), skipped_no_embedding (no vector), no_proposal, merge_proposed. Repeated ids count once, null ids are left out.
    """
    known = nodes.select("node_id", normalize_label(F.col("label")).alias("_c")).dropDuplicates(["node_id"])
    has = vectors.where(F.col("embedding").isNotNull()).select("node_id").distinct().withColumn("_v", F.lit(True))
    rows = ids.where("node_id IS NOT NULL").select("node_id").distinct().join(known.withColumn("_known", F.lit(True)), "node_id", "left").join(has, "node_id", "left")
    skip = F.when(F.col("_known").isNull(), "skipped_node_missing").when(F.coalesce("_c", F.lit("")) == "", "skipped_no_label").when(F.col("_v").isNull(), "skipped_no_embedding")
    rows = saved(rows.select("node_id", skip.alias("_skip")), f"{new_folder(nodes.sparkSession, 'reevaluation')}/asked")
    found = resolve(rows.where("_skip IS NULL"), nodes, support, claims, aliases, vectors, least, profile_least)
    status = F.coalesce("_skip", F.when(F.col("match_id").isNotNull(), "merge_proposed"), F.lit("no_proposal"))
    return rows.join(found, "node_id", "left").select("node_id", status.alias("status"), "match_id", F.coalesce("signal", F.lit("none")).alias("signal"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
