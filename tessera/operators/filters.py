"""Selections on claims and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import TRUSTED_USERS


def with_status(claims: DataFrame, statuses: tuple[str, ...] | None = ("active",)) -> DataFrame:
    """Rows of these states; an empty or missing set is no constraint."""
    return claims.where(F.col("status").isin(*statuses)) if statuses else claims


def valid_at(claims: DataFrame, at: Column) -> DataFrame:
    """Rows whose validity has not ended by then; the end itself is outside."""
    return claims.where(F.col("valid_to").isNull() | (F.col("valid_to") > at))


def valid_during(claims: DataFrame, at: Column) -> DataFrame:
    """Rows whose validity interval [from, to) holds the instant."""
    return valid_at(claims, at).where(F.coalesce("valid_from", "stated_at") <= at)


def stated_between(claims: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Both ends inclusive; a missing end is open."""
    out = claims if start is None else claims.where(F.col("stated_at") >= start)
    return out if end is None else out.where(F.col("stated_at") <= end)


def in_scope(df: DataFrame, scope: str | None = None, include_reference: bool = False) -> DataFrame:
    """An explicit scope wins, then all scopes, then personal."""
    return df.where(F.col("scope") == scope) if scope else df if include_reference else df.where(F.col("scope") == "personal")


def without_inferred(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("asserted_by_kind") != "assistant_inferred")


def provenance_band(claims: DataFrame, band: str) -> DataFrame:
    """trusted, candidate (inferred by the assistant) or all."""
    inferred = F.col("asserted_by_kind") == "assistant_inferred"
    return {"trusted": claims.where(~inferred), "candidate": claims.where(inferred), "all": claims}[band]


def endpoints(claims: DataFrame, speakers: bool = False) -> DataFrame:
    """One row per claim and node it touches; a claim from a node to itself counts once."""
    ends = [F.col("subject_id"), F.col("object_id")] + ([F.col("asserted_by_id")] if speakers else [])
    return claims.withColumn("node_id", F.explode(F.array_distinct(F.array_compact(F.array(*ends)))))


def scope_support(nodes: DataFrame, claims: DataFrame, links: DataFrame, sources: DataFrame, scope: str) -> DataFrame:
    """Nodes with a source of the scope, or an active claim of the scope that touches them."""
    by_claim = endpoints(claims.where((F.col("status") == "active") & (F.col("scope") == scope))).select("node_id")
    by_source = links.join(sources.where(F.col("scope") == scope).select("source_id"), "source_id", "left_semi").select("node_id")
    return nodes.join(by_claim.union(by_source), "node_id", "left_semi")


def effective_scope(nodes: DataFrame, claims: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Scope of each node from all its claims and sources: reference if all signals are, else personal, which is also the default."""
    signals = endpoints(claims.select("subject_id", "object_id", "scope")).select("node_id", "scope").unionByName(links.join(sources, "source_id").select("node_id", "scope"))
    flags = signals.groupBy("node_id").agg(F.bool_or(F.col("scope") == "reference").alias("ref"), F.bool_or(F.col("scope") == "personal").alias("own"))
    return nodes.join(flags, "node_id", "left").withColumn("effective_scope", F.when(F.col("ref") & ~F.col("own"), "reference").otherwise("personal")).drop("ref", "own")


def label_search(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """Substring fallback: similarity 1, smallest ids first."""
    return nodes.where(F.lower("label").contains(text.lower())).withColumn("similarity", F.lit(1.0)).orderBy("node_id").limit(limit)


def is_trusted_user(kind: Column) -> Column:
    return kind.isin(*TRUSTED_USERS)
