"""Changes to the graph as DataFrames of what is new or different: nodes, aliases, claims, system sources, migrations of predicates and types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import coerce_task_status, normalize_alias, normalize_label, stable_id
from ..vocab import ORGANIZATION_WORDS
from .hygiene import shaped


def create_nodes(proposed: DataFrame, at: Column) -> DataFrame:
    """New nodes (user_id, node_type, label) with ids that depend on the three, their canonical labels, and one row for repeated ones."""
    rows = proposed.select("user_id", "node_type", F.trim("label").alias("label")).where(F.col("label") != "")
    rows = rows.withColumn("canonical_label", normalize_label(F.col("label")))
    first = rows.groupBy("user_id", "node_type", "canonical_label").agg(F.min("label").alias("label"))
    return first.select(stable_id("node", F.col("user_id"), F.col("node_type"), F.col("canonical_label")).alias("node_id"), "user_id", "node_type", "label", "canonical_label", at.alias("created_at"))


def update_labels(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the non-null labels of changes (node_id, user_id, label) of the same tenant put in."""
    new = changes.select("node_id", "user_id", F.col("label").alias("_label"))
    return nodes.join(new, ["node_id", "user_id"], "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases with new ones (user_id, alias_text, node_id) put in, unless the node has one of the same normalised text; blank ones are left out."""
    rows = new.select("user_id", F.trim("alias_text").alias("alias_text"), normalize_alias(F.col("alias_text")).alias("normalized_alias_text"), "node_id").where("normalized_alias_text <> ''")
    key = ["user_id", "node_id", "normalized_alias_text"]
    first = rows.groupBy(*key).agg(F.min("alias_text").alias("alias_text")).join(aliases.select(*key), key, "left_anti")
    return aliases.select("user_id", "alias_text", "normalized_alias_text", "node_id").unionByName(first.select("user_id", "alias_text", "normalized_alias_text", "node_id"))


def remove_aliases(aliases: DataFrame, gone: DataFrame) -> DataFrame:
    """Aliases without those that (user_id, node_id, alias_text) name, compared by normalised text."""
    key = ["user_id", "node_id", "normalized_alias_text"]
    return aliases.join(gone.select("user_id", "node_id", normalize_alias(F.col("alias_text")).alias("normalized_alias_text")).distinct(), key, "left_anti")


def reattribute(claims: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """Claims after moves (claim_id, from_id, to_id) of one of their ends to another node: the active claim is retracted and a copy, confirmed by the user, stands in its place.
    A move that would make a claim point at its own subject, or whose claim isn't active or doesn't have that end, does nothing."""
    rows = claims.join(moves.select("claim_id", "from_id", "to_id"), "claim_id", "left")
    put = lambda c: F.when(F.col(c) == F.col("from_id"), F.col("to_id")).otherwise(F.col(c))
    has = (F.col("subject_id") == F.col("from_id")) | F.coalesce(F.col("object_id") == F.col("from_id"), F.lit(False))
    fit = F.coalesce((F.col("status") == "active") & has & ~F.coalesce(put("subject_id") == put("object_id"), F.lit(False)), F.lit(False))
    rows = rows.withColumn("_fit", fit)
    old = rows.withColumn("status", F.when(F.col("_fit"), "retracted").otherwise(F.col("status"))).withColumn("valid_to", F.when(F.col("_fit"), at).otherwise(F.col("valid_to")))
    new = rows.where("_fit").withColumn("claim_id", stable_id("clm", F.col("claim_id"), F.col("to_id"))).withColumn("subject_id", put("subject_id")).withColumn("object_id", put("object_id")).withColumn("asserted_by_kind", F.lit("user_confirmed"))
    return old.select(*claims.columns).unionByName(new.select(*claims.columns))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows by key; of equal keys a new row wins over a stored one, and the last by ``order`` over others."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = W.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def system_sources(users: DataFrame, stored: DataFrame, kind: str, at: Column) -> DataFrame:
    """A source of a kind for each user who has none."""
    have = stored.where(F.col("type") == kind).select("user_id", F.lit(True).alias("_have")).distinct()
    rows = users.select("user_id").distinct().join(have, "user_id", "left").where("_have IS NULL")
    return rows.select(stable_id("src", F.col("user_id"), F.lit(kind)).alias("source_id"), "user_id", F.lit(kind).alias("type"), F.lit(kind).alias("external_id"), at.alias("created_at"))


def map_values(rows: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Rows with the values of a column replaced by a fixed table of spellings; others stay. The table is small, so the join becomes a broadcast."""
    table = rows.sparkSession.createDataFrame(list(mapping.items()), "_from string, _to string")
    return rows.join(F.broadcast(table), F.lower(F.trim(column)) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def record_dates(claims: DataFrame, nodes: DataFrame, at: Column) -> DataFrame:
    """Claims after system's own bookkeeping dates became RECORDED_ON: OCCURRED_ON claims of the system on a Temporal node whose statement has the generated form "... node occurred on ..." or
    "... source occurred on ...". Others stay as they are."""
    days = nodes.where("node_type = 'Temporal'").select(F.col("node_id").alias("object_id"), F.lit(True).alias("_day")).distinct()
    generated = (F.col("predicate") == "OCCURRED_ON") & (F.col("asserted_by_kind") == "system") & F.col("statement").rlike(" (node|source) occurred on ")
    open_rows = generated & F.col("object_id").isNotNull()
    moved = claims.where(open_rows).join(days, "object_id", "left").select(*claims.columns, F.coalesce("_day", F.lit(False)).alias("_hit"))
    rest = claims.where(~F.coalesce(open_rows, F.lit(False)))
    put = lambda what: F.replace("statement", F.lit(f" {what} occurred on "), F.lit(f" {what} recorded on "))
    text = F.when(F.contains("statement", F.lit(" node occurred on ")), put("node")).otherwise(put("source"))
    new = {"predicate": F.lit("RECORDED_ON"), "statement": text, "updated_at": at}
    return rest.unionByName(moved.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in claims.columns]))


def retype_organizations(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Persons, concepts and objects that are organizations, with their new type. Their words must name one (label, canonical label or description; of persons the label), and an active claim must place
    them like one: somebody works there, founded it or is affiliated with it, or owns what its label calls one; or it is itself affiliated, creates, is located, owns or uses, has such a label, and
    nobody took part in it. Persons who feel, found, have goals or preferences, take part or work somewhere, or have tasks, stay persons. One pass over the claims gives all these facts.
    """
    active = claims.where("status = 'active'")
    said = lambda end, *names: F.coalesce(F.bool_or((F.col("end") == end) & F.col("predicate").isin(*names)), F.lit(False))
    ends = active.select(F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("subject_id").alias("node_id")), F.struct(F.lit("o").alias("end"), F.col("object_id").alias("node_id")))).alias("e"), "predicate")
    facts = ends.select("e.*", "predicate").where("node_id IS NOT NULL").groupBy("node_id").agg(
        said("s", "EXHIBITED_EMOTION", "FOUNDED", "HAS_GOAL", "HAS_PREFERENCE", "PARTICIPATED_IN", "WORKS_AT").alias("_human"), said("o", "ASSIGNED_TO").alias("_assigned"), said("o", "WORKS_AT").alias("_worked"),
        said("o", "FOUNDED", "AFFILIATED_WITH").alias("_joined"), said("o", "OWNS").alias("_owned"), said("s", "AFFILIATED_WITH", "CREATED", "LOCATED_IN", "OWNS", "USES").alias("_acts"), said("o", "PARTICIPATED_IN").alias("_event"),
    )
    word = rf"(?i)(^|[^\p{{L}}\p{{N}}])({ORGANIZATION_WORDS})([^\p{{L}}\p{{N}}]|$)"
    name = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce(normalize_label(F.col("label")), F.lit("")))
    whole = F.concat_ws(" ", name, F.coalesce("description", F.lit(""))) if "description" in nodes.columns else name
    rows = nodes.where(F.col("node_type").isin("Person", "Concept", "Object") & whole.rlike(word)).join(facts, "node_id")
    named = name.rlike(word)
    human = (F.col("node_type") == "Person") & (~named | F.col("_human") | F.col("_assigned"))
    placed = F.col("_worked") | F.col("_joined") | (F.col("_owned") & named) | (F.col("_acts") & named & ~F.col("_event"))
    return rows.where(~human & placed).select(*[F.lit("Organization").alias(c) if c == "node_type" else c for c in nodes.columns])


def provenance(claims: DataFrame, sources: DataFrame, speakers: DataFrame) -> DataFrame:
    """Who asserted each extracted claim (claim_id, source_id, said_by_kind, said_by_speaker); claims that name nobody who is known are left out.

    ``speakers`` (source_id, speaker, node_id, is_self) makes a source a transcript: each of its claims must name one of its speakers, spelled so or else in other letter case (then the first by spelling); the
    user's own words count as the user's, confirmed if the claim says so, and all others as that participant's. Without speakers a claim's own kind counts, except participant, which is skipped; a claim of no kind
    is the document author's in a document, else the user's.
    """
    entry = F.struct("speaker", "node_id", "is_self")
    heard = speakers.groupBy("source_id", F.lower("speaker").alias("_low")).agg(F.array_sort(F.collect_set(entry)).alias("_found"))  # the spellings of one name
    transcripts = speakers.select("source_id", F.lit(True).alias("_transcript")).distinct()
    label = F.trim(F.coalesce("said_by_speaker", F.lit("")))
    rows = claims.withColumn("_label", label).withColumn("_low", F.lower("_label")).join(sources.select("source_id", "type"), "source_id", "left").join(transcripts, "source_id", "left").join(heard, ["source_id", "_low"], "left")
    same = F.filter("_found", lambda x: x["speaker"] == F.col("_label"))
    who = F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at("_found", F.lit(1)))
    rows = rows.withColumn("_who", F.when(F.col("_label") != "", who)).withColumn("_t", F.coalesce("_transcript", F.lit(False)))
    own = F.when(F.col("said_by_kind") == "user_confirmed", "user_confirmed").otherwise("user")
    plain = F.coalesce("said_by_kind", F.when(F.col("type") == "document", "document_author").otherwise("user"))
    kept = rows.where(F.when(F.col("_t"), F.col("_who").isNotNull()).otherwise(F.coalesce(F.col("said_by_kind") != "participant", F.lit(True))))
    kind = F.when(~F.col("_t"), plain).when(F.col("_who.is_self"), own).otherwise("participant")
    return kept.select("claim_id", "source_id", kind.alias("asserted_by_kind"), F.when(F.col("_t") & ~F.col("_who.is_self"), F.col("_who.node_id")).alias("asserted_by_id"))


def extraction_outcome(extracted: DataFrame, nodes: DataFrame, sources: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of each extracted claim (claim_id, subject_id, predicate, object_id, object_value, source_id): insert, or why it is skipped.

    In this order: unknown_source, unknown_reference, bad_status (a task state of no known spelling), bad_shape (types that the predicate doesn't allow), duplicate (the same is said by a
    smaller id of the batch, or by a stored active claim).
    """
    known = nodes.select("node_id", F.lit(True).alias("_known"))
    rows = extracted.join(sources.select("source_id", F.lit(True).alias("_source")), "source_id", "left")
    for c in ("subject_id", "object_id"):
        rows = rows.join(known.withColumnRenamed("node_id", c).withColumnRenamed("_known", f"_{c}"), c, "left")
    bad = shaped(extracted, nodes).where("NOT fits").select("claim_id", F.lit(True).alias("_bad"))
    rows = rows.join(bad, "claim_id", "left")
    same = ["subject_id", "predicate", "_object"]
    value = F.coalesce(F.concat(F.lit("n:"), "object_id"), F.concat(F.lit("v:"), "object_value"), F.lit(""))
    rows = rows.withColumn("_object", value)
    have = stored.where("status = 'active'").select("subject_id", "predicate", value.alias("_object")).distinct().withColumn("_have", F.lit(True))
    skip = (
        F.when(F.col("_source").isNull(), "unknown_source")
        .when(F.col("_subject_id").isNull() | (F.col("object_id").isNotNull() & F.col("_object_id").isNull()), "unknown_reference")
        .when((F.col("predicate") == "HAS_TASK_STATUS") & coerce_task_status(F.col("object_value")).isNull(), "bad_status")
        .when(F.col("_bad"), "bad_shape")
    )
    rows = rows.withColumn("_skip", skip).join(have, same, "left")
    nth = F.row_number().over(W.partitionBy(*same, F.col("_skip").isNull()).orderBy("claim_id"))
    outcome = F.coalesce("_skip", F.when(F.col("_have") | (nth > 1), "duplicate"), F.lit("insert"))
    return rows.select("claim_id", outcome.alias("outcome"))


def temp_ids(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """Ids for the temporary ones of extraction batches (batch, temp_id, user_id, node_type, label): the known node of the same tenant, type and canonical label, else a new id.
    Mentions of one batch with one label share it."""
    c = normalize_label(F.col("label"))
    have = known.groupBy("user_id", "node_type", c.alias("_c")).agg(F.min("node_id").alias("_known"))
    rows = mentions.withColumn("_c", c).join(have, ["user_id", "node_type", "_c"], "left")
    return rows.select("batch", "temp_id", F.coalesce("_known", stable_id("node", F.col("user_id"), F.col("node_type"), F.col("_c"))).alias("node_id"), F.col("_known").isNull().alias("is_new"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
