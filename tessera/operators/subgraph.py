"""The part of the graph around seeds that a cleanup may look at and change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import nearest_in_blocks
from ..storage import new_folder, saved
from .cleanup import CITED
from .filters import scope_support
from .graph import evidence_counts, one_hop
from .hygiene import shaped

#: Fixed value: least similarity of a semantic neighbour.
NEAR_LEAST = 0.5


def cleanup_subgraph(seeds: DataFrame, nodes: DataFrame, vectors: DataFrame, claims: DataFrame, links: DataFrame, sources: DataFrame, aliases: DataFrame, user_id: str, semantic_limit: int = 5, hops: int = 2, max_nodes: int = 100, max_claims: int = 200,
                     least: float = NEAR_LEAST) -> tuple[DataFrame, DataFrame]:
    """(nodes, claims) around the seeds (node_id) of a user.

    Nodes are found in this order, each where it is found first, and the first ``max_nodes`` stay: the seeds by id; per seed, in that order, its ``semantic_limit`` nearest nodes by vector with a similarity of at least
    ``least`` and support in the personal scope; then ring by ring the first 50 neighbours by id over active personal claims, inferred ones too, of the nodes that the last ring added. A ring ends in a written
    table, so that plans don't grow with the hops. Per node: place, how many claims, source links and aliases speak for it, and delete_allowed if none does.

    Claims are active ones from a node of the subgraph to a value or a node of it, the ``max_claims`` created last. Per claim: retract_allowed (inferred, or of a shape that its predicate doesn't
    allow), citation_allowed (said by a user, a participant or an author) and bad_shape.
    """
    folder, spark = new_folder(nodes.sparkSession, "subgraph"), nodes.sparkSession
    own = nodes.where((F.col("user_id") == user_id) & F.col("label").isNotNull())
    mine = claims.where(F.col("user_id") == user_id)
    shown = ["node_id", "node_type", "label"]
    start = own.join(seeds.select("node_id").distinct(), "node_id", "left_semi").select(*shown, F.lit(0).alias("_ring"), F.col("node_id").alias("_seed"), F.lit(0.0).alias("_far"))
    start = saved(start, f"{folder}/seeds")

    usable = scope_support(own, mine, links, sources.where(F.col("user_id") == user_id), "personal").select("node_id")
    known = vectors.where(F.col("user_id") == user_id).join(usable, "node_id", "left_semi")
    asks = vectors.join(start.select("node_id"), "node_id", "left_semi")
    near = nearest_in_blocks(asks, known, "node_id", "embedding", semantic_limit, within=("user_id",)).where(F.col("similarity") >= least)
    near = near.select(F.col("match").alias("node_id"), F.lit(1).alias("_ring"), F.col("node_id").alias("_seed"), (-F.col("similarity")).alias("_far")).join(own.select(*shown), "node_id")
    found = saved(_first(start.unionByName(near.select(*start.columns))), f"{folder}/near")

    ring = found
    for hop in range(1, hops + 1):
        step = one_hop(mine, own, ring, user_id=user_id, inferred=True).join(found.select("node_id"), "node_id", "left_anti")
        ring = saved(step.select(*shown, F.lit(1 + hop).alias("_ring"), F.lit("").alias("_seed"), F.lit(0.0).alias("_far")), f"{folder}/ring{hop}")
        if ring.isEmpty():
            break
        found = found.unionByName(ring)
    order = ["_ring", "_seed", "_far", "node_id"]
    kept = saved(found.orderBy(*order).limit(max_nodes), f"{folder}/kept")
    ranked = spark.createDataFrame([(r.node_id, n) for n, r in enumerate(kept.orderBy(*order).select("node_id").collect())], "node_id string, place int")  # at most max_nodes ids

    few = kept.select("node_id")
    counts = evidence_counts(few, mine, links.join(few, "node_id", "left_semi"), aliases.where(F.col("user_id") == user_id).join(few, "node_id", "left_semi"))
    free = (F.col("n_claims") == 0) & (F.col("n_links") == 0) & (F.col("n_aliases") == 0)
    out = kept.select(*shown).join(ranked, "node_id").join(counts, "node_id").withColumn("delete_allowed", free)

    inside = mine.where("status = 'active'").join(few.withColumnRenamed("node_id", "subject_id"), "subject_id", "left_semi")
    held = inside.where("object_id IS NOT NULL").join(few.withColumnRenamed("node_id", "object_id"), "object_id", "left_semi")
    inside = inside.where("object_id IS NULL").unionByName(held.select(*inside.columns)).orderBy(F.desc("created_at"), F.desc("claim_id")).limit(max_claims)
    inside = saved(inside, f"{folder}/claims")
    wrong = shaped(inside, kept).where("NOT fits").select("claim_id", F.lit(True).alias("_wrong"))
    bad = F.coalesce("_wrong", F.lit(False))
    flags = inside.join(wrong, "claim_id", "left").select(
        "claim_id", "subject_id", "object_id", "object_value", "predicate", "statement", "scope", "asserted_by_kind", bad.alias("bad_shape"),
        ((F.col("asserted_by_kind") == "assistant_inferred") | bad).alias("retract_allowed"), F.col("asserted_by_kind").isin(*CITED).alias("citation_allowed"),
    )
    return out, flags


def _first(rows: DataFrame) -> DataFrame:
    """Each node where it was found first."""
    key = F.struct("_ring", "_seed", "_far")
    return rows.groupBy("node_id", "node_type", "label").agg(F.min(key).alias("_k")).select("node_id", "node_type", "label", "_k.*")
