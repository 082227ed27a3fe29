"""A training corpus from documents: toxicity, exact copies, near copies, source mix, packing. Part of the subpackage tessera.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, mixing, packing, simhash, toxicity
from tessera.llm.common import Workspace, read
from tessera.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't predict toxic. It is learned from the labels of rows that aren't held out (see toxicity.held_out)."""
    return toxicity.drop_toxic(spark, docs, read(spark, sf_dir, "labels"), train=lambda key: ~toxicity.held_out(key))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near SimHash fingerprints the document with the smallest id."""
    return simhash.drop_near_copies(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes its words: taken / size times, the fraction decided by hash of the id. Up to three rows a document."""
    return mixing.mixed_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The learned lexicon, near-duplicate components and tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again by the next.

    Null texts count as empty: they are never toxic, and equal each other. Rows of null id pass every stage like others; equal ones become one. An id that names several
    texts keeps each. Very long texts are used whole. A document without words is not mixed. An empty table gives an empty result.
    """
    work, docs = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
