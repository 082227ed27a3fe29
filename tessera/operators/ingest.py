"""Ingestion: idempotent inserts, transcripts, conversations, documents and their texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import escape_xml, stable_id

SOURCE_KEY = ("user_id", "type", "external_id")


def insert_new(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...] = SOURCE_KEY) -> DataFrame:
    """Incoming rows whose key is neither stored nor repeated; the first of repeated ones by id."""
    first = incoming.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("source_id"))).where("_n = 1").drop("_n")
    return first.join(stored.select(*key), [*key], "left_anti")


def replace_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored documents with new versions put in place of old ones of the same key."""
    return stored.join(incoming.select(*SOURCE_KEY), [*SOURCE_KEY], "left_anti").unionByName(incoming)


def payloads(rows: DataFrame, inline_bytes: int) -> DataFrame:
    """Where the text of a source is kept: in the row, or as a blob if it is long."""
    return rows.withColumn("stored", F.when(F.octet_length("text") <= inline_bytes, "inline").otherwise("blob"))


def messages_as_sources(turns: DataFrame) -> DataFrame:
    """One parent per conversation and one child per message, with reproducible ids."""
    parent = stable_id("src", F.col("conversation_id"))
    child = turns.select(stable_id("src", F.col("conversation_id"), F.col("turn").cast("string")).alias("source_id"), F.lit("conversation_message").alias("type"), F.concat_ws(":", "conversation_id", F.col("turn").cast("string")).alias("external_id"), parent.alias("parent_id"))
    return child.unionByName(turns.select(parent.alias("source_id"), F.lit("conversation").alias("type"), F.col("conversation_id").alias("external_id"), F.lit(None).cast("string").alias("parent_id")).distinct())


def utterances(transcripts: DataFrame) -> DataFrame:
    """Transcripts (transcript_id, utterances: array of (speaker, content)) as rows with external ids."""
    rows = transcripts.select("transcript_id", F.posexplode("utterances").alias("i", "u"))
    return rows.select("transcript_id", "i", F.concat_ws(":", "transcript_id", F.col("i").cast("string")).alias("external_id"), F.col("u.speaker").alias("speaker"), F.col("u.content").alias("content"))


def conversation_xml(turns: DataFrame) -> DataFrame:
    """Each conversation as tagged text, turns in order."""
    line = F.concat(F.lit('<message role="'), escape_xml(F.col("role")), F.lit('">'), escape_xml(F.col("text")), F.lit("</message>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    return turns.groupBy("conversation_id").agg(F.concat(F.lit("<conversation>\n"), body, F.lit("\n</conversation>")).alias("xml"))


_TOP_HEADING, _HEADING_ONLY, _BLANK_LINES = re.compile(r"(?m)^(?=#{1,2}\s)"), re.compile(r"#{1,6}\s[^\n]*"), re.compile(r"\n\s*\n+")


def filled(units: list[str], most: int) -> list[str]:
    """Units joined by an empty line, as many as fit into ``most`` characters; one that is longer stands alone."""
    out: list[str] = []
    room = -1
    for unit in units:
        if len(unit) + 2 <= room:
            out[-1] += "\n\n" + unit
            room -= len(unit) + 2
        else:
            out.append(unit)
            room = most - len(unit)
    return out


def paragraphs(section: str) -> list[str]:
    """Paragraphs of a section; one that is only a heading goes with the next."""
    out: list[str] = []
    heading = False
    for p in filter(None, (p.strip() for p in _BLANK_LINES.split(section))):
        glue, heading = heading, not heading and bool(_HEADING_ONLY.fullmatch(p))
        if glue:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def pack_sections(text: str | None, most: int = 6000) -> list[str]:
    """Sections at first- and second-level headings, packed into chunks of at most ``most`` characters. A longer section is packed by itself from its paragraphs; a paragraph that is
    longer still is a chunk of its own and isn't cut."""
    out: list[str] = []
    run: list[str] = []
    for section in filter(None, (s.strip() for s in _TOP_HEADING.split(text or ""))):
        if len(section) <= most:
            run.append(section)
            continue
        out += filled(run, most) + filled(paragraphs(section), most)
        run = []
    return out + filled(run, most)


def chunks(docs: DataFrame, most: int = 6000) -> DataFrame:
    """(doc_id, chunk, text) of markdown documents; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, c) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, c in enumerate(pack_sections(t, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, text string")


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, text) against a manifest (path, hash): added, changed, removed or same."""
    a = now.select("path", F.sha2("text", 256).alias("_new"))
    rows = a.join(manifest.select("path", F.col("hash").alias("_old")), "path", "full")
    return rows.select("path", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") == F.col("_old"), "same").otherwise("changed").alias("change"), F.col("_new").alias("hash"))


def merge_json(base: Column, patch: dict[str, Column], keep: tuple[str, ...] = ()) -> Column:
    """A flat JSON object with fields put in; those of ``keep`` only if absent."""
    old = F.coalesce(F.from_json(base, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.map_from_arrays(F.array(*map(F.lit, patch)), F.array(*patch.values()))
    fresh = F.map_filter(new, lambda k, v: v.isNotNull() & ~(k.isin(*keep) & F.map_contains_key(old, k)) if keep else v.isNotNull())
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh))


def untitled(sources: DataFrame) -> DataFrame:
    return sources.where(F.get_json_object("metadata", "$.title").isNull())


def source_previews(sources: DataFrame, children: DataFrame, most: int = 400) -> DataFrame:
    """Text to title a container by: its children's texts (parent_id, created_at, source_id, text) in order, cut."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "source_id", "text"))), lambda x: x["text"]), "\n").substr(1, most)
    return sources.select("source_id").join(children.groupBy(F.col("parent_id").alias("source_id")).agg(body.alias("preview")), "source_id", "left")
