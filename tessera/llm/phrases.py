"""Substring deduplication by words: repeated-phrase automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace
from .windows import _SPACE, LAST, Runs, Spec, candidate_segments, covered, distinct_segments, distinct_texts, first_by_window, named

#: At most so many shards are split between tasks; the list of them is broadcast.
MOST_SPLIT = 100_000


def spaced_windows(content: bytes, width: int) -> list[bytes]:
    """Every ``width`` words in a row."""
    words = content.split(b" ")
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def recurring_passages(contents: list[bytes], owners: list[int], lasts: list[int], width: int) -> list[tuple[bytes, int]]:
    """Passages whose every window of ``width`` words starts in documents of different ids, each with the smallest id that all its windows
    share. Contents are compared word by word. A passage is given by a segment of that id only."""
    seen: dict[bytes, list[int]] = {}
    split = [spaced_windows(c, width) for c in contents]
    for ws, owner, last in zip(split, owners, lasts, strict=True):
        for w in ws:
            have = seen.setdefault(w, [owner, last])
            have[0], have[1] = min(have[0], owner), max(have[1], last)
    out = []
    for c, ws, owner in zip(contents, split, owners, strict=True):
        own = [seen[w][0] == owner < seen[w][1] for w in ws] + [False]
        if not any(own):
            continue
        words, begin = c.split(b" "), None
        for i, x in enumerate(own):
            if x and begin is None:
                begin = i
            elif not x and begin is not None:
                out.append((b" ".join(words[begin : i + width - 1]), owner))
                begin = None
    return list(dict.fromkeys(out))


class Phrases:
    """An Aho-Corasick automaton over the words of passages that finds all their windows of ``width`` words in a text.

    The automaton holds the pieces of half a window that a passage falls into: every window has one of them inside, so that the automaton has a node a word and not one
    for each word of each window. The windows around a piece that a text hits are looked up word by word, each with its smallest owner.
    """

    def __init__(self, passages: list[tuple[bytes, int]], width: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.owner: dict[tuple[int, ...], int] = {}
        self.searched: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}  # as many as a shard has different stretches
        self.width, self.piece = width, (width + 1) // 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        number, owners, piece = self.number, self.owner, self.piece
        for passage, owner in passages:
            words = tuple([number.setdefault(w, len(number) + 1) for w in passage.split(b" ")])
            for at in range(0, len(words) - piece + 1, piece):
                self.automaton.add_word(words[at : at + piece], 1)
            for at in range(len(words) - width + 1):
                window = words[at : at + width]
                if owners.get(window, owner) >= owner:
                    owners[window] = owner
        if owners:
            self.automaton.make_automaton()

    def owned(self, text: bytes) -> tuple[int, list[tuple[int, int]]]:
        """(how many windows a text has, [(owner, a bit for each window of which it is the smallest owner)])."""
        get, width, owner = self.number.get, self.width, self.owner.get
        words = tuple([get(w, 0) for w in text.split(b" ")])
        n = len(words) - width + 1
        bits: dict[int, int] = {}
        done = 0
        if self.owner:
            for last, _ in self.automaton.iter(words):
                for at in range(max(done, last - width + 1), min(last - self.piece + 2, n)):
                    own = owner(words[at : at + width])
                    if own is not None:
                        bits[own] = bits.get(own, 0) | 1 << at
                done = max(done, last - self.piece + 2)
        return n, list(bits.items())

    def earlier(self, text: bytes, than: int) -> tuple[int, int]:
        """(how many windows a text has, a bit for each that has an owner smaller than ``than``). Equal stretches go through the automaton once."""
        n, owned = self.searched.get(text) or self.searched.setdefault(text, self.owned(text))
        bits = 0
        for owner, windows in owned:
            if owner < than:
                bits |= windows
        return n, bits


def packed(n: int, bits: int) -> bytes:
    """The bits of n windows; nothing if all are set."""
    return b"" if bits == (1 << n) - 1 else bits.to_bytes((n + 7) // 8, "little")


def streamed(rows: DataFrame, width: int) -> DataFrame:
    """Rows (shard, sub, kind, owner, row, first, content): of a shard and sub first its passages (kind 0, with owner), which are compiled, then stretches of documents (kind 1,
    owner is the document's), which stream through. Gives (_row, first, windows, bits): the windows of a stretch that start in a document of smaller id (see packed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, passages, phrases = None, [], None
        for b in batches:
            out = []
            for shard, sub, kind, owner, row, first, content in zip(*(b[c].tolist() for c in ("shard", "sub", "kind", "owner", "row", "first", "content")), strict=True):
                if (shard, sub) != at:
                    at, passages, phrases = (shard, sub), [], None
                if kind == 0:
                    passages.append((content, owner))
                    continue
                if phrases is None:
                    phrases = Phrases(passages, width)
                n, bits = phrases.earlier(content, owner)
                if bits:
                    out.append((row, first, n, packed(n, bits)))
            yield pd.DataFrame(out, columns=["_row", "first", "windows", "bits"])

    dealt = rows.repartition("shard", "sub").sortWithinPartitions("shard", "sub", "kind")
    return dealt.mapInPandas(run, "_row long, first long, windows int, bits binary")


def remove_phrases(spark: SparkSession, docs: DataFrame, width: int = 13, gram: int = 6, shard_bytes: int = 1_000_000, crowd_bytes: int = 2_000_000, stream_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes words covered by a window of ``width`` words that also starts in a document of smaller id: _id, text, n_words, n_removed.

    1. Whole copies of a text become one text, owned by the smallest id.
    2. Recurring passages are confirmed: stretches of documents around anchor grams that occur in several texts (see windows) combine where they are equal, so that
       a passage of a third of all documents costs one row a task, and are dealt to shards by anchor, so that equal windows meet. A shard
       compares them word by word and writes the passages that recur, each with the smallest id (recurring_passages).
    3. Each shard's passages are compiled into an Aho-Corasick automaton, and the documents stream through: of every document all stretches around
       anchors that recur, each through the automaton of its anchor's shard, which finds every occurrence of every phrase. What lies outside them
       holds no phrase, since each window has its anchor inside. A shard with more than ``stream_bytes`` of stretches goes to several tasks,
       each with the same automaton.
    4. Anchors with more than ``crowd_bytes`` of different stretches would make a shard of their own that is too large for one automaton. Their
       windows meet by a digest of their content, combined before the shuffle (first_by_window).
    5. The covered words go. Windows are judged on the input.

    Ids are integers. A null text is empty; texts of fewer than ``width`` words stay whole. Rows that repeat an id are documents of equal id,
    of which none is smaller. A null id is later than all others and never makes another lose words. Very long texts are
    searched whole. An empty table gives an empty result. Other columns are ignored.
    """
    work, spec = Workspace(spark, "phrases"), Spec(width, gram, True)

    def cut(found: Runs) -> Callable[[np.ndarray, np.ndarray], list[bytes]]:
        raw, (a, b) = np.frombuffer(found.raw, dtype=np.uint8), found.places
        space = _SPACE[raw]
        kept = ~space
        kept[1:] |= ~space[:-1]  # of the white space after a word one, made a space
        joined = np.where(space, np.uint8(32), raw)[kept].tobytes()
        start = np.cumsum(b - a + 1) - (b - a + 1)
        return lambda first, end: [joined[x:y] for x, y in zip(start[first].tolist(), (start + b - a)[end + width - 2].tolist(), strict=True)]

    def confirm(b: pd.DataFrame) -> pd.DataFrame:
        found = recurring_passages(b["content"].tolist(), b["owner"].tolist(), b["last"].tolist(), width)
        return pd.DataFrame([(b["shard"].iloc[0], p, o) for p, o in found], columns=["shard", "content", "owner"])

    texts, members = distinct_texts(work, docs, id_col, text_col)
    segments = candidate_segments(work, spec, False, cut)
    distinct, _, crowded = distinct_segments(work, segments, crowd_bytes, same_text=False)
    hot = spark.read.parquet(f"{work.root}/seeds").where("crowded").select("seed")
    n_hot = hot.count()
    any_crowded, hot = n_hot > 0, F.broadcast(hot) if n_hot < MOST_SPLIT else hot
    total = segments.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(1, -(-(distinct.agg(F.sum(F.length("content"))).first()[0] or 0) // shard_bytes))
    shard = F.pmod(F.xxhash64("seed"), F.lit(shards)).alias("shard")
    small = lambda df: df.join(hot, "seed", "left_anti") if any_crowded else df
    passages = small(distinct).select(shard, "content", "owner", "last").groupBy("shard").applyInPandas(confirm, "shard long, content binary, owner long")
    passages = work.save(passages, "passages")
    if not any_crowded:
        work.drop("distinct")

    stretches = small(segments).select(shard, F.col("_key").alias("owner"), F.col("_row").alias("row"), "first", "content")
    most = max(stream_bytes, total // MOST_SPLIT)
    full = stretches.groupBy("shard").agg(F.sum(F.length("content")).alias("size")).where(F.col("size") > most).select("shard", F.ceil(F.col("size") / most).cast("int").alias("subs"))
    full = F.broadcast(work.save(full, "full"))  # at most MOST_SPLIT rows, by the choice of ``most``
    subs = F.coalesce("subs", F.lit(1))
    compiled = passages.join(full, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), subs - 1)).alias("sub"), F.lit(0).alias("kind"), "owner", F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("first"), "content")
    streams = stretches.join(full, "shard", "left").select("shard", F.pmod(F.xxhash64("row"), subs).cast("int").alias("sub"), F.lit(1).alias("kind"), "owner", "row", "first", "content")
    flags = streamed(compiled.unionByName(streams), width)
    if any_crowded:
        flags = flags.unionByName(crowded_flags(work, segments.join(hot, "seed", "left_semi"), crowded, width))
    lists = [F.collect_list(c).alias(n) for c, n in (("first", "at"), ("windows", "n"), ("bits", "bits"))]
    answers = work.save(flags.groupBy("_row").agg(*lists), "answers")
    work.drop("segments", "distinct", "passages")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, own, at, n, bits in zip(*(b[c] for c in ("_key", "_text", "_own", "at", "n", "bits")), strict=True):
                words = text.encode().split()
                gone = covered(at, n, bits, width, len(words)) if at is not None else np.zeros(len(words), dtype=bool)
                out += [(key, b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode(), len(words), int(gone.sum()))] * own
            yield pd.DataFrame(out, columns=["_id", "text", "n_words", "n_removed"])

    owners = texts.join(answers.hint("shuffle_hash"), "_row", "left").mapInPandas(strip, "_id long, text string, n_words long, n_removed long")
    n = F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("bigint")
    short = F.when(n < width, F.array_join(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), " ")).otherwise("")
    copied = work.spark.read.parquet(f"{work.root}/distinct_texts").select("_row", n.alias("n_words"), short.alias("text"))
    copies = members.join(copied, "_row").select("_id", "text", "n_words", F.when(F.col("n_words") < width, 0).otherwise(F.col("n_words")).alias("n_removed"))
    owners = owners.withColumn("_id", F.when(F.col("_id") != LAST, F.col("_id")))
    return owners.unionByName(copies).withColumnRenamed("_id", id_col)


def crowded_flags(work: Workspace, segments: DataFrame, crowded: DataFrame, width: int) -> DataFrame:
    """(_row, first, windows, bits) of the stretches around crowded anchors."""
    found = first_by_window(work, crowded, lambda c: spaced_windows(c, width))
    found = work.save(named(crowded).select("sid", "seed", "segment", "segment2", "owner", "windows").join(found, "sid", "left").drop("sid"), "crowded_found")

    every = named(segments.select("_row", "_key", "first", "seed", "content")).join(found.hint("shuffle_hash"), ["seed", "segment", "segment2"])
    whole = F.col("owner") < F.col("_key")
    rest = every.where(~whole & F.col("found").isNotNull()).withColumn("run", F.explode("found")).where(F.col("run.o") < F.col("_key"))
    none = F.lit(bytearray()).alias("bits")
    runs = rest.select("_row", (F.col("first") + F.col("run.i")).alias("first"), F.col("run.n").alias("windows"), none)
    return every.where(whole).select("_row", "first", "windows", none).unionByName(runs)
