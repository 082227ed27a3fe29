"""Tables of a claim graph and their invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
STATUSES = ("active", "superseded", "contradicted", "retracted")
SCOPES = ("personal", "reference")
KINDS = ("user", "user_confirmed", "participant", "document_author", "assistant_inferred", "system")

CLAIMS = (
    "claim_id string, user_id string, subject_id string, object_id string, object_value string, predicate string, statement string, source_id string, scope string, "
    "asserted_by_kind string, asserted_by_id string, stated_at timestamp, valid_from timestamp, valid_to timestamp, status string, created_at timestamp, updated_at timestamp"
)
NODES = "node_id string, user_id string, node_type string, label string, created_at timestamp"
SOURCES = "source_id string, user_id string, type string, external_id string, parent_id string, scope string, created_at timestamp, last_ingested_at timestamp, metadata string, deleted_at timestamp"


def broken_rules(df: DataFrame) -> Column:
    """Names of the invariants that a claim row breaks: one object, known scope, kind and status, a participant has a speaker."""
    has = lambda c: F.col(c).isNotNull()
    rules = {
        "object_xor_value": has("object_id") != has("object_value"),
        "scope": F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)),
        "kind": F.coalesce(F.col("asserted_by_kind").isin(*KINDS), F.lit(False)),
        "status": F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "participant_speaker": F.coalesce(F.col("asserted_by_kind") != "participant", F.lit(True)) | has("asserted_by_id"),
    }
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def validate_claims(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, other rows with what they break)."""
    checked = df.withColumn("broken", broken_rules(df))
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)
