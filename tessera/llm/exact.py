"""Exact deduplication that no group of copies can skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def keyed(docs: DataFrame, id_col: str, text_col: str, normalise, salts: int, digest=digest_of) -> DataFrame:
    """Rows (_id, _norm, _digest, _salt). The salt comes from the id and the length of the text, so that a text that many
    rows share spreads, and so do the texts of null or repeated ids."""
    rows = docs.select(docs[id_col].alias("_id"), normalise(F.coalesce(docs[text_col], F.lit(""))).alias("_norm"))
    return rows.select("_id", "_norm", digest(F.col("_norm")).alias("_digest"), F.pmod(F.xxhash64("_id", F.length("_norm")), F.lit(salts)).cast("int").alias("_salt"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per text: its digest, keep_id, group_size and the salts it has."""
    salted = rows.groupBy("_digest", "_norm", "_salt").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_norm").agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_list("_salt").alias("_salts"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower, salts: int = 32, digest=digest_of) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when their normalised forms are identical; the largest id of a group stays. Three stages, each of which
    groups by digest and by the whole text, so that equal digests alone never merge two documents:

    1. every task combines its own rows (map-side aggregation),
    2. rows of one digest and one salt meet; the salt comes from the id, so that a third of all rows with one text still
       spreads over ``salts`` tasks,
    3. the winners of the salts, at most ``salts`` a text, meet.

    The answer returns to the documents by a join on digest and salt, spread in the same way; rows of one id and text pass it as one, with their number. The whole texts that meet in stage 3
    say whether a digest stands for one text; only then does it stand for it in that join. A digest of several texts, which stage 3 finds and
    tests force with a weak ``digest``, joins by the whole text instead.

    Nulls count as empty texts, and all empty texts form one group. A null id never wins against others; a group of null ids alone
    has a null keep_id and kept = false. Repeated rows with one id count in group_size and are all returned; each is kept if
    its id is the largest. Very long texts are compared whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    work = Workspace(docs.sparkSession, "exact")
    rows = keyed(docs, id_col, text_col, normalise, salts, digest)
    facts = ["keep_id", "group_size", "_salts"]
    by_digest = winners(rows).groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), *[F.any_value(c).alias(c) for c in facts])
    by_digest = work.save(by_digest, "winners")
    answers = by_digest.where("_texts = 1").select("_digest", "keep_id", "group_size", F.explode("_salts").alias("_salt"))
    members = rows.groupBy("_id", "_digest", "_salt").agg(F.count(F.lit(1)).alias("_rows")).join(answers, ["_digest", "_salt"])
    members = members.select("_id", "_digest", "keep_id", "group_size", "_rows", F.col("_digest").alias("_sha"))
    shared = by_digest.where("_texts > 1").select("_digest")
    if not shared.isEmpty():  # different texts of one digest
        clashing = rows.join(shared, "_digest", "left_semi")
        by_text = winners(clashing).select("_digest", "_norm", "keep_id", "group_size", F.explode("_salts").alias("_salt"))
        rest = clashing.join(by_text, ["_digest", "_norm", "_salt"]).withColumn("_sha", digest_of(F.col("_norm"))).withColumn("_rows", F.lit(1).cast("long"))
        members = members.unionByName(rest.select(*members.columns))
    elif digest is not digest_of:
        members = members.drop("_sha").join(rows.select("_digest", digest_of(F.col("_norm")).alias("_sha")).distinct(), "_digest")
    kept = F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False))
    members = members.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return members.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower, salts: int = 32) -> DataFrame:
    """One document of each group of equal texts, that with the largest id, with all its columns.

    Rows that repeat that id with the same text keep one: the smallest by a hash of the other columns, whatever the order they come in. An id that
    names several texts keeps a row of each that it wins. A group of null ids alone keeps one row. An empty table gives an empty result.
    """
    groups = exact_groups(docs, id_col, text_col, normalise, salts).where(F.col(id_col).eqNullSafe(F.col("keep_id")))
    stay = groups.select(F.col(id_col).alias("_kept_id"), F.unhex("text_sha256").alias("_kept_digest")).distinct()
    hashed = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(docs[id_col].alias("_own_id"), digest_of(normalise(F.coalesce(docs[text_col], F.lit("")))).alias("_own_digest"), F.xxhash64(*hashed).alias("_hash"), whole.alias("_row"))
    # Which row stays is found from ids, digests and hashes; whole rows travel once, to meet the ones that stay.
    first = rows.groupBy("_own_id", "_own_digest", "_hash").agg(F.count(F.lit(1)).alias("_n")).groupBy("_own_id", "_own_digest").agg(F.min(F.struct("_hash", "_n")).alias("_first"))
    first = first.join(stay, F.col("_own_id").eqNullSafe(F.col("_kept_id")) & (F.col("_own_digest") == F.col("_kept_digest")), "left_semi")
    first = Workspace(docs.sparkSession, "exact").save(first.select("_own_id", "_own_digest", "_first.*"), "stay")
    same = [rows["_own_id"].eqNullSafe(F.col("_id")), rows["_own_digest"] == F.col("_digest"), rows["_hash"] == F.col("_h")]
    once = first.select(F.col("_own_id").alias("_id"), F.col("_own_digest").alias("_digest"), F.col("_hash").alias("_h"), "_n")
    alone = rows.join(once.where("_n = 1"), same, "left_semi").select("_row.*")
    if once.where("_n > 1").isEmpty():
        return alone
    twins = rows.join(once.where("_n > 1"), same, "left_semi").groupBy("_own_id", "_own_digest").agg(F.any_value("_row").alias("_row"))
    return alone.unionByName(twins.select("_row.*"))
