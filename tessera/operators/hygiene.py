"""Graph hygiene: orphans, staleness, shapes, ranking and hashes of what derived artefacts depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from ..vocab import FEEDS_ATLAS, FORCE_REFRESH
from .filters import endpoints

#: Weights of staleness, isolation, weak provenance and decay.
WEIGHTS = (0.40, 0.25, 0.20, 0.15)
_EVENTS = ("Event", "Conversation", "Document", "AssistantDream")
_ENTITIES = ("Person", "Organization", "Location", "Event", "Object", "Concept", "Media", "Feedback", "Idea", "Task")
_OWNERS = ("Person", "Organization", "Concept", "Object")
_OWNABLE = ("Organization", "Location", "Object", "Concept", "Media", "Atlas")
_SEQUENCE = ("Event", "Task", "Temporal")
_RECORDABLE = ("Person", "Organization", "Location", "Event", "Object", "Emotion", "Concept", "Media", "Conversation", "Atlas", "AssistantDream", "Document", "Feedback", "Idea", "Task")
#: Subject and object types that each relationship predicate allows; "*" is any. Fixed values of the data model.
SHAPES = {
    "PARTICIPATED_IN": (("Person",), ("Event", "Conversation")),
    "OCCURRED_AT": (_EVENTS, ("Location",)),
    "OCCURRED_ON": ((*_EVENTS, "Task", "Media", "Object"), ("Temporal",)),
    "RECORDED_ON": (_RECORDABLE, ("Temporal",)),
    "INVOLVED_ITEM": (_EVENTS, ("Object", "Concept", "Media", "Location")),
    "EXHIBITED_EMOTION": (("Person",), ("Emotion",)),
    "TAGGED_WITH": (("*",), ("Concept",)),
    "ASSIGNED_TO": (("Task",), ("Person",)),
    "DUE_ON": (("Task",), ("Temporal",)),
    "PRECEDES": (_SEQUENCE, _SEQUENCE),
    "FOLLOWS": (_SEQUENCE, _SEQUENCE),
    "WORKS_AT": (("Person",), ("Organization",)),
    "FOUNDED": (("Person",), ("Organization", "Concept", "Object")),
    "CREATED": (("Person", "Organization", "Concept", "Object"), ("Object", "Concept", "Media", "Document", "Task")),
    "LOCATED_IN": (_ENTITIES, ("Location",)),
    "PART_OF": (("*",), ("*",)),
    "USES": (_ENTITIES, ("Object", "Concept", "Media")),
    "OWNS": (_OWNERS, _OWNABLE),
    "AFFILIATED_WITH": (("Person", "Organization", "Concept", "Object"), ("Person", "Organization", "Concept", "Object")),
    "RELATED_TO": (("*",), ("*",)),
}


def orphans(nodes: DataFrame, claims: DataFrame, aliases: DataFrame, before: Column | None = None) -> DataFrame:
    """Nodes that no claim touches or speaks for and that have no alias."""
    used = endpoints(claims, speakers=True).select("node_id").union(aliases.select("node_id")).distinct()  # each task names a node once, before the shuffle
    out = nodes.join(used, "node_id", "left_anti")
    return out if before is None else out.where(F.col("created_at") < before)


def missing_blobs(sources: DataFrame, blobs: DataFrame) -> DataFrame:
    return sources.join(blobs.select("source_id"), "source_id", "left_anti")


def stale_scores(nodes: DataFrame, claims: DataFrame, now: Column, horizon: int = 365, protected: DataFrame | None = None, aliases: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Score 0 to 1 of how stale each node is, rounded to three places, and why.

    Idle days, of ``horizon``, since the node was created or last claimed; how few active claims touch it; whether none of these is grounded, that is said by somebody else than
    the assistant or the system; and the share of claims that are no longer active. Without any claim the last three count in full. Protected nodes are left out.
    """
    active = F.col("status") == "active"
    grounded = active & ~F.col("asserted_by_kind").isin("assistant_inferred", "system")
    counts = endpoints(claims).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(active).alias("n_active"), F.count_if(grounded).alias("n_grounded"), F.max("stated_at").alias("last_at"))
    rows = nodes.join(counts, "node_id", "left")
    for c in ("n", "n_active", "n_grounded"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    for name, df in (("has_alias", aliases), ("has_link", links)):
        seen = df.select("node_id", F.lit(True).alias(name)).distinct() if df is not None else None
        rows = rows.join(seen, "node_id", "left").withColumn(name, F.coalesce(name, F.lit(False))) if seen is not None else rows.withColumn(name, F.lit(False))
    idle = F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", F.greatest("created_at", F.coalesce("last_at", "created_at")), now) / 86400))
    stale = F.least(F.lit(1.0), idle / float(horizon))
    lonely, weak = 1.0 / (1 + F.col("n_active")), F.when(F.col("n_grounded") > 0, 0.0).otherwise(1.0)
    gone = F.col("n") - F.col("n_active")
    decay = F.when(F.col("n") == 0, 1.0).otherwise(gone / F.col("n"))
    score = F.round(WEIGHTS[0] * stale + WEIGHTS[1] * lonely + WEIGHTS[2] * weak + WEIGHTS[3] * decay, 3)
    nothing = (F.col("n") == 0) & ~F.col("has_alias") & ~F.col("has_link")
    text = lambda c: c.cast("string")
    why = F.array(
        F.when(nothing, "no evidence (no claims, sources, or aliases)"),
        F.concat(F.lit("idle "), text(idle.cast("long")), F.lit("d")),
        F.when((F.col("n_active") == 0) & ~nothing, F.lit("no active claims")).when(F.col("n_active").isin(1, 2), F.concat(F.lit("weakly connected ("), text(F.col("n_active")), F.when(F.col("n_active") == 1, " active claim)").otherwise(" active claims)"))),
        F.when((weak == 1) & (F.col("n") > 0), "assistant-inferred only (no grounded claims)"),
        F.when((decay >= 0.5) & (gone > 0), F.concat(text(F.floor(decay * 100 + 0.5).cast("long")), F.lit("% of claims superseded"))),
    )
    out = rows.select("node_id", "node_type", score.alias("score"), F.array_compact(why).alias("reasons"))
    return out if protected is None else out.join(protected.select("node_id"), "node_id", "left_anti")


def _shapes(spark):
    return spark.createDataFrame([(i, p, list(s), list(o)) for i, (p, (s, o)) in enumerate(SHAPES.items())], "place int, predicate string, subjects array<string>, objects array<string>")


def shaped(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationship claims with the types of their ends and whether those, or the swapped ends, fit the predicate. Claims with a value and those of other predicates are left out.
    The registry is a fixed table of twenty rows."""
    s, o = (nodes.select(F.col("node_id").alias(f"{k}_id"), F.col("node_type").alias(f"{k}_type")) for k in ("subject", "object"))
    rows = claims.where(F.col("predicate").isin(*SHAPES, "OWNED_BY")).join(s, "subject_id").join(o, "object_id")
    rows = rows.join(F.broadcast(_shapes(claims.sparkSession)), "predicate", "left")
    fits = lambda allowed, kind: F.array_contains(allowed, kind) | F.array_contains(allowed, F.lit("*"))
    ok = fits(F.col("subjects"), F.col("subject_type")) & fits(F.col("objects"), F.col("object_type"))
    turned = fits(F.col("subjects"), F.col("object_type")) & fits(F.col("objects"), F.col("subject_type"))
    return rows.withColumn("fits", F.coalesce(ok, F.lit(False))).withColumn("fits_turned", F.coalesce(turned, F.lit(False)))


def shape_audit(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active claims of a wrong shape per predicate, in the order of the registry; the passive OWNED_BY, which is no longer used, has no shape."""
    return shaped(claims.where("status = 'active'"), nodes).where("NOT fits AND place IS NOT NULL").groupBy("place", "predicate").agg(F.count(F.lit(1)).alias("invalid")).orderBy("place")


def shape_repair(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """What active claims of a wrong shape should be: claim_id, reason, predicate, subject_id, object_id.

    Claims that fit with swapped ends are turned. OWNED_BY splits by the types of its ends: an assignment of a task, ownership said passively or actively, or else a mere relation.
    Others have no proposal.
    """
    rows = shaped(claims.where("status = 'active'"), nodes)
    s, o, owned = F.col("subject_type"), F.col("object_type"), F.col("predicate") == "OWNED_BY"
    case = lambda reason, predicate, turn: F.struct(F.lit(reason).alias("reason"), predicate.alias("to"), F.lit(turn).alias("turn"))
    assigned, owns = F.lit("ASSIGNED_TO"), F.lit("OWNS")
    of_owned = (
        F.when((s == "Task") & (o == "Person"), case("legacy_task_assignment", assigned, False))
        .when((s == "Person") & (o == "Task"), case("legacy_task_assignment_inverted", assigned, True))
        .when(s.isin(*_OWNABLE) & o.isin(*_OWNERS), case("legacy_passive_ownership", owns, True))
        .when(s.isin(*_OWNERS) & o.isin(*_OWNABLE), case("legacy_active_ownership", owns, False))
        .otherwise(case("legacy_ambiguous_ownership", F.lit("RELATED_TO"), False))
    )
    fix = F.when(owned, of_owned).when(~F.col("fits") & F.col("fits_turned"), case("valid_when_inverted", F.col("predicate"), True))
    rows = rows.withColumn("fix", fix).where("fix IS NOT NULL")
    end = lambda a, b: F.when(F.col("fix.turn"), F.col(b)).otherwise(F.col(a))
    return rows.select("claim_id", "fix.reason", F.col("fix.to").alias("predicate"), end("subject_id", "object_id").alias("subject_id"), end("object_id", "subject_id").alias("object_id"))


def atlas_rank(claims: DataFrame, now: Column, per_subject: int = 5, top: int = 40) -> DataFrame:
    """Claims that feed the user's atlas: ln(1 + how often the subject occurs) plus a hundredth a day of age, fractions of days counted, at most 365; a cap per subject, then the top."""
    rows = claims.where((F.col("status") == "active") & (F.col("scope") == "personal") & (F.col("asserted_by_kind") != "assistant_inferred") & F.col("predicate").isin(*FEEDS_ATLAS))
    central = F.count(F.lit(1)).over(W.partitionBy("subject_id"))
    age = F.least(F.greatest(F.timestamp_diff("SECOND", F.col("stated_at"), now) / 86400.0, F.lit(0.0)), F.lit(365.0))
    rows = rows.withColumn("score", F.round(F.log(1 + central) + age * 0.01, 9))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("subject_id").orderBy(F.desc("score"), "claim_id"))).where(F.col("_n") <= per_subject)
    return rows.orderBy(F.desc("score"), "claim_id").limit(top).select("claim_id", "subject_id", "score")


def content_hash(rows: DataFrame, *cols: str) -> DataFrame:
    """One digest of a short list, independent of row order."""
    return rows.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))), 256).alias("hash"))


def atlas_stale(claims: DataFrame, since: Column) -> DataFrame:
    """Whether a claim that forces a refresh became active since."""
    return claims.where((F.col("status") == "active") & F.col("predicate").isin(*FORCE_REFRESH) & (F.col("created_at") > since)).limit(1).agg((F.count(F.lit(1)) > 0).alias("stale"))


def fact_lines(claims: DataFrame, most: int = 100) -> DataFrame:
    """Per subject its newest active statements, one a line."""
    order = W.partitionBy("subject_id").orderBy(F.desc("stated_at"), "claim_id")
    rows = claims.where("status = 'active'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return rows.groupBy("subject_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(" ", "predicate", "statement").alias("line")))), lambda x: x["line"]), "\n").alias("facts"))


def placeholders(nodes: DataFrame, flagged: DataFrame, before: Column) -> DataFrame:
    """Aged unresolved persons with the resolved persons of the same label."""
    people = nodes.where("node_type = 'Person'").withColumn("_c", normalize_label(F.col("label")))
    old = people.join(flagged.select("node_id"), "node_id", "left_semi").where(F.col("created_at") < before)
    resolved = people.join(flagged.select("node_id"), "node_id", "left_anti").select("user_id", "_c", F.col("node_id").alias("match_id"))
    return old.join(resolved, ["user_id", "_c"], "left").groupBy("node_id", "label").agg(F.array_sort(F.collect_set("match_id")).alias("matches"))


def long_labels(nodes: DataFrame, most: int = 255) -> DataFrame:
    return nodes.where(F.length("label") > most).withColumn("label", F.col("label").substr(1, most))


def missing_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isNotNull()).join(vectors.select("node_id"), "node_id", "left_anti")


def deprecated_counts(claims: DataFrame, predicates: tuple[str, ...] = ("OWNED_BY",)) -> DataFrame:
    return claims.where(F.col("predicate").isin(*predicates)).groupBy("predicate", "status").agg(F.count(F.lit(1)).alias("n"))


def source_of_claims(claims: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """For claims without a source the earliest linked source of either end."""
    found = endpoints(claims.where("source_id IS NULL")).join(links, "node_id").join(sources.select("source_id", F.col("created_at").alias("_at")), links["source_id"] == sources["source_id"]).select("claim_id", links["source_id"].alias("found"), "_at")
    first = found.groupBy("claim_id").agg(F.min(F.struct("_at", "found"))["found"].alias("found"))
    return claims.join(first, "claim_id", "left").withColumn("source_id", F.coalesce("source_id", "found")).drop("found")
