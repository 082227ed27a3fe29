"""Readers of exported chats and note vaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify, strip_front_matter, wikilinks_to_text, word_count

CHAT = "chunkedPrompt struct<chunks: array<struct<role: string, text: string, createTime: timestamp, isThought: boolean, errorMessage: string>>>"


def chat_export(spark: SparkSession, path: str, after=None) -> DataFrame:
    """Turns of exported chats, one JSON file each: thoughts, errors and blank chunks left out, roles mapped to speakers, those up to a time skipped."""
    files = spark.read.schema(CHAT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    rows = files.select("file", F.posexplode("chunkedPrompt.chunks").alias("turn", "c"))
    c = lambda x: F.col(f"c.{x}")
    rows = rows.where(~F.coalesce(c("isThought"), F.lit(False)) & c("errorMessage").isNull() & (F.trim(F.coalesce(c("text"), F.lit(""))) != ""))
    rows = rows if after is None else rows.where(c("createTime") > after)
    speaker = F.when(c("role") == "user", "user").otherwise("assistant")
    return rows.select(slugify(F.regexp_replace("file", r"\.json$", "")).alias("conversation_id"), "turn", speaker.alias("role"), c("text").alias("text"), c("createTime").alias("at"))


def vault(spark: SparkSession, path: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Markdown files below a folder as (path, text, words): front matter and link marks gone, only the included prefixes and not the excluded ones."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    starts = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.contains(F.col("path"), p))
    rows = rows.where(starts(include)) if include else rows
    rows = rows.where(~starts(exclude)) if exclude else rows
    text = wikilinks_to_text(strip_front_matter(F.col("value")))
    return rows.select("path", text.alias("text"), word_count(text).alias("words"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Stored blobs by id, sizes and times, contents not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_id"), "length", "modificationTime")
