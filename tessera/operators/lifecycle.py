"""Supersession of claims: which value of a subject holds when, and who may overrule whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..vocab import SINGLE_CURRENT, SINGLE_CURRENT_OF_TASK, trust_rank
from .filters import is_trusted_user

KEY = ("user_id", "subject_id", "predicate")


def superseding(claims: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Claims under supersession: predicates with one current value, and DUE_ON of tasks if nodes are given."""
    always = claims.where(F.col("predicate").isin(*SINGLE_CURRENT))
    if nodes is None:
        return always
    tasks = nodes.where(F.col("node_type") == "Task").select(F.col("node_id").alias("subject_id"))
    return always.unionByName(claims.where(F.col("predicate").isin(*SINGLE_CURRENT_OF_TASK)).join(tasks, "subject_id", "left_semi").select(*claims.columns))


def supersede(claims: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Adds resolved_status, resolved_from, resolved_to, superseded_by and demoted.

    Per key in order of (stated_at, created_at, trust, claim_id) every claim but the last is superseded, from its valid_from or
    stated_at until the next one is stated. If the last is inferred by the assistant and an earlier one is a user's own, that last one, and only it, is
    demoted: it leaves the chain, ends at its own stated_at and is superseded by the head of the rest. The head stays active; it
    keeps its end unless it had been superseded before. Only active and superseded claims take part.

    One shuffle by key: all windows share partitioning and order.
    """
    rows = claims.where(F.col("status").isin("active", "superseded")).withColumn("_trust", trust_rank(F.col("asserted_by_kind")))
    order = ["stated_at", "created_at", "_trust", "claim_id"]
    chain = W.partitionBy(*key).orderBy(*order)
    whole = chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("_last", F.last("claim_id").over(whole)).withColumn("_earlier", F.coalesce(F.max(is_trusted_user(F.col("asserted_by_kind"))).over(chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    rows = rows.withColumn("demoted", (F.col("claim_id") == F.col("_last")) & (F.col("asserted_by_kind") == "assistant_inferred") & F.col("_earlier"))
    demotes = F.max("demoted").over(whole)
    rows = rows.withColumn("_next", F.lead("claim_id").over(chain)).withColumn("_next_at", F.lead("stated_at").over(chain)).withColumn("_second", F.lag("claim_id").over(chain)).withColumn("_demotes", demotes)
    head = ~F.col("demoted") & F.when(F.col("_demotes"), F.col("_next") == F.col("_last")).otherwise(F.col("_next").isNull())
    return rows.select(
        *claims.columns,
        F.when(head, "active").otherwise("superseded").alias("resolved_status"),
        F.coalesce("valid_from", "stated_at").alias("resolved_from"),
        F.when(F.col("demoted"), F.col("stated_at")).when(head, F.when(F.col("status") == "superseded", None).otherwise(F.col("valid_to"))).otherwise(F.col("_next_at")).alias("resolved_to"),
        F.when(F.col("demoted"), F.col("_second")).when(head, None).otherwise(F.col("_next")).alias("superseded_by"),
        "demoted",
    )


def apply_lifecycle(claims: DataFrame, **options) -> DataFrame:
    """The claims with status, valid_from, valid_to and superseded_by as resolved."""
    done = supersede(claims, **options)
    kept = [c for c in claims.columns if c not in ("status", "valid_from", "valid_to", "superseded_by")]
    return done.select(*kept, F.col("resolved_status").alias("status"), F.col("resolved_from").alias("valid_from"), F.col("resolved_to").alias("valid_to"), "superseded_by")


def recompute(current: DataFrame, changed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Resolves again only the keys of changed claims, which replace current ones of the same id; all others pass through."""
    keys = changed.select(*key).unionByName(current.join(changed.select("claim_id"), "claim_id", "left_semi").select(*key)).distinct()
    rest = current.join(changed.select("claim_id"), "claim_id", "left_anti")
    touched = rest.join(keys, [*key], "left_semi").select(*changed.columns).unionByName(changed)
    fields = [c for c in changed.columns if c not in ("status", "valid_from", "valid_to", "superseded_by")] + ["status", "valid_from", "valid_to", "superseded_by"]
    ended = touched.where(~F.col("status").isin("active", "superseded")).withColumn("superseded_by", F.lit(None).cast("string"))
    same = rest.join(keys, [*key], "left_anti")
    same = same if "superseded_by" in same.columns else same.withColumn("superseded_by", F.lit(None).cast("string"))
    return same.select(*fields).unionByName(apply_lifecycle(touched).select(*fields)).unionByName(ended.select(*fields))


def retract(claims: DataFrame, ids: DataFrame, at) -> DataFrame:
    """Marks the claims of ids retracted, ending at ``at``."""
    hit = claims.join(ids.select("claim_id").distinct().withColumn("_hit", F.lit(True)), "claim_id", "left")
    gone = F.coalesce("_hit", F.lit(False))
    return hit.withColumn("status", F.when(gone, "retracted").otherwise(F.col("status"))).withColumn("valid_to", F.when(gone, at).otherwise(F.col("valid_to"))).drop("_hit")
