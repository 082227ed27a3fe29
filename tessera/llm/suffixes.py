"""Substring deduplication by bytes: ranks of suffixes by prefix doubling, every round a sort of rank pairs by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .windows import _BYTES, LAST, Runs, Spec, candidate_segments, covered, distinct_segments, distinct_texts, first_by_window, flagged_runs, named, runs_of, spans

#: Bytes of segments that a task hashes at a time.
CHUNK = 1 << 20


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def longest_shared(rows: DataFrame, name: str, other_side: bool) -> DataFrame:
    """Adds to rows (seed, side, at, content, ...) the length that ``side`` shares at most with that of another row of its seed. Sorted, the neighbours share most.
    ``other_side`` puts what comes before the anchor, backwards, in the place of side; else side goes."""
    schema = rows.select("*", F.lit(0).alias(name))
    schema = (schema if other_side else schema.drop("side")).schema

    def given(b: pd.DataFrame, best: np.ndarray) -> pd.DataFrame:
        b = b.assign(**{name: best.astype(np.int32)})
        return b.assign(side=[c[:at][::-1] for c, at in zip(b["content"], b["at"], strict=True)])[schema.names] if other_side else b[schema.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, shared = None, 0  # the last row and what it shares with the one before it
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            seed, side = b["seed"].tolist(), b["side"].tolist()
            with_next = [common(side[k], side[k + 1]) if seed[k] == seed[k + 1] else 0 for k in range(len(b) - 1)]
            best = np.maximum([shared, *with_next[:-1]], with_next) if with_next else np.zeros(0, dtype=np.int64)
            held, shared = b.iloc[-1:], with_next[-1] if with_next else shared
            yield given(b.iloc[:-1], best)
        if held is not None:
            yield given(held, np.array([shared]))

    return rows.repartition("seed").sortWithinPartitions("seed", "side").mapInPandas(run, schema)


def trimmed(segments: DataFrame, width: int) -> DataFrame:
    """Segments cut to the windows that can occur in another segment of their seed: (sid, skip, owner, start, windows, content).

    Equal windows have their anchor at the same place, so that they share what is left and what is right of it. Spark sorts the segments of a seed by what
    follows the anchor, and by what comes before it, backwards; a window that reaches further on a side than its segment shares with any other there is unique.
    """
    right = F.expr("substring(content, at + 1)")
    rows = longest_shared(segments.select("sid", "seed", "owner", "start", "windows", "at", "content", right.alias("side")), "right", True)
    rows = longest_shared(rows, "left", False)
    low = F.greatest(F.lit(0), F.col("at") - F.col("left"))
    high = F.least(F.col("windows") - 1, F.col("at") + F.col("right") - width)
    rows = rows.withColumn("skip", low.cast("int")).withColumn("_high", high.cast("int")).where("skip <= _high")
    n = F.col("_high") - F.col("skip") + 1
    return rows.select("sid", "skip", "owner", (F.col("start") + F.col("skip")).alias("start"), n.alias("windows"), F.expr(f"substring(content, skip + 1, _high - skip + {width})").alias("content"))


def starting_pairs(segments: DataFrame, width: int, length: int) -> DataFrame:
    """One row per window of segments (sid, windows, content): a = hash of its first ``length`` bytes, b = 0, and where it is (sid, i)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in in_chunks(batch, batch["content"].map(len).to_numpy()):
                values, base = joined(b["content"].tolist())
                n = b["windows"].to_numpy()
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(base, n) + i
                yield pd.DataFrame({"a": spans(values, at, at + length).view(np.int64), "b": 0, "sid": np.repeat(b["sid"].to_numpy(), n), "i": i.astype(np.int32)})

    return segments.select("sid", "windows", "content").mapInPandas(run, "a long, b long, sid long, i int")


def in_chunks(b: pd.DataFrame, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
    if len(b):
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True):
            yield b.iloc[s:e]


def joined(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token values of all contents in a row, and where each starts."""
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    return _BYTES[np.frombuffer(b"".join(contents), dtype=np.uint8)], np.cumsum(sizes) - sizes


def reranked(pairs: DataFrame) -> DataFrame:
    """Sorts pairs (a, b) and gives equal ones a rank; those that occur once are settled and leave. Returns (rank, sid, i).

    Equal pairs meet in one partition, which is sorted and read as a stream, so that a task holds a batch of rows and the last one before it.
    A rank is unique over all partitions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, held = TaskContext.get().partitionId() << 40, None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held.drop(columns="seen"), b], ignore_index=True)
            a, c = b["a"].to_numpy(), b["b"].to_numpy()
            same = np.concatenate([[held is not None and bool(held["seen"].iloc[0])], (a[1:] == a[:-1]) & (c[1:] == c[:-1])])
            own = rank + np.cumsum(~same) - (0 if held is None or same[0] else 1)
            rank = int(own[-1])
            keep = same[:-1] | same[1:]
            held = b.iloc[-1:].assign(seen=same[-1])
            yield pd.DataFrame({"rank": own[:-1][keep], "sid": b["sid"].to_numpy()[:-1][keep], "i": b["i"].to_numpy()[:-1][keep]})
        if held is not None and held["seen"].iloc[0]:
            yield pd.DataFrame({"rank": [rank], "sid": held["sid"].to_numpy(), "i": held["i"].to_numpy()})

    return pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInPandas(run, "rank long, sid long, i int")


def lengthened(ranks: DataFrame, segments: DataFrame, length: int, more: int) -> DataFrame:
    """Pairs for the next round: a = rank of the first ``length`` bytes, b = hash of the ``more`` bytes after them, with the place (sid, i) and the
    earliest place of its segment (owner, place). Ranks meet their segment by a sort on sid; a segment comes before its ranks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            head = (b["i"] < 0).to_numpy()
            held = b[head].iloc[-1:]
            which = np.cumsum(head) - 1
            contents = b["content"][head].tolist()
            values, base = joined(contents)
            rows = np.flatnonzero(~head)
            if not len(rows):
                continue
            of, i = which[rows], b["i"].to_numpy()[rows]
            at = base[of] + i + length
            owner, start = (b[c].to_numpy()[head][of] for c in ("owner", "place"))
            yield pd.DataFrame({"a": b["rank"].to_numpy()[rows], "b": spans(values, at, at + more).view(np.int64), "sid": b["sid"].to_numpy()[rows], "i": i, "owner": owner, "place": start + i})

    heads = segments.select("sid", F.lit(-1).alias("i"), F.lit(0).cast("long").alias("rank"), "owner", F.col("start").alias("place"), "content")
    rows = ranks.select("sid", "i", "rank", F.lit(0).cast("long").alias("owner"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("content"))
    return heads.unionByName(rows).repartition("sid").sortWithinPartitions("sid", "i").mapInPandas(run, "a long, b long, sid long, i int, owner long, place long")


def later_places(pairs: DataFrame) -> DataFrame:
    """Of windows with equal pairs (a, b) all but the earliest: (sid, i, o, s), the earliest being at (o, s). The last round, sorted and read as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            if not len(b):
                continue
            a, c, o, s = (b[x].to_numpy() for x in ("a", "b", "owner", "place"))
            new = np.concatenate([[last is None or last[:2] != (a[0], c[0])], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            first_o, first_s = (np.where(lead < 0, 0 if last is None else last[k], x[lead]) for k, x in ((2, o), (3, s)))
            last = (a[-1], c[-1], first_o[-1], first_s[-1])
            late = ~new
            yield pd.DataFrame({"sid": b["sid"].to_numpy()[late], "i": b["i"].to_numpy()[late], "o": first_o[late], "s": first_s[late]})

    return pairs.repartition("a", "b").sortWithinPartitions("a", "b", "owner", "place").mapInPandas(run, "sid long, i int, o long, s long")


def doubled(work: Workspace, segments: DataFrame, width: int, length: int) -> DataFrame:
    """Windows (sid, i, o, s) that also occur earlier, first at (o, s), among segments (sid, owner, start, windows, content).

    Prefix doubling: windows are ranked by their first ``length`` bytes, then by the pair of that rank and the bytes after them, the length doubling until it
    is ``width``. Spark sorts the pairs of each round. A window whose rank is unique occurs once and leaves, so that later rounds see only
    what recurs. The second part of a pair is a 64-bit hash of its bytes; windows are taken for equal that are not only if a hash
    of one part collides while the other parts are equal.
    """
    length, n = min(length, width), 0
    pairs = starting_pairs(segments, width, length)
    while length < width:
        more = min(length, width - length)
        ranks = work.save(reranked(pairs), f"ranks{n}")
        pairs = lengthened(ranks, segments, length, more)
        length, n = length + more, n + 1
    if not n:
        heads = segments.select("sid", "owner", "start")
        pairs = pairs.join(heads, "sid").select("a", "b", "sid", "i", "owner", (F.col("start") + F.col("i")).alias("place"))
    return later_places(pairs)


def remove_substrings(spark: SparkSession, docs: DataFrame, width: int = 100, gram: int = 40, length: int = 50, crowd_bytes: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes bytes covered by a ``width``-byte string that also starts earlier: _id, kept (binary), n_bytes, n_spans.

    Earlier is a smaller id, or the same id and an earlier start.

    1. Whole copies of a text become one. Strings around anchor grams that occur once in all texts are unique and left out (see windows); the
       others form segments, and equal segments combine before the shuffle.
    2. A segment that alone has its anchor recurs as a whole, and its own earliest place is the answer.
    3. Other segments are cut to the windows that can occur in two of them (see trimmed), and these are ranked by prefix doubling (see doubled), starting from
       ``length`` bytes; the earliest place of the windows of one rank is the answer. Spark sorts the pairs of all texts together, partitioned by pair.
    4. Windows around an anchor with more than ``crowd_bytes`` of different segments meet by a digest of their content instead, combined before
       the shuffle (first_by_window), so that no task gets all of them.
    5. The answers join the segments of all texts. Strings are judged on the input, and matches never cross documents.

    Ids are integers. A null text is empty; texts shorter than ``width`` bytes stay whole. Rows that repeat an id are documents of equal id: equal texts
    among them stay, and of different ones none precedes another but by place. A null id is later than all others. Very long
    texts are searched whole. An empty table gives an empty result. Other columns are ignored.
    """
    work, spec = Workspace(spark, "suffixes"), Spec(width, gram, False)

    def cut(found: Runs) -> Callable[[np.ndarray, np.ndarray], list[bytes]]:
        return lambda first, end: [found.raw[a : b + width - 1] for a, b in zip(first.tolist(), end.tolist(), strict=True)]

    texts, members = distinct_texts(work, docs, id_col, text_col)
    segments = candidate_segments(work, spec, True, cut)
    distinct, contested, crowded = distinct_segments(work, segments, crowd_bytes)
    cut_down = work.save(trimmed(contested, width), "trimmed")
    late = work.save(doubled(work, cut_down, width, length), "late")
    late = late.join(cut_down.select("sid", "skip"), "sid").select("sid", (F.col("i") + F.col("skip")).alias("i"), "o", "s")
    found = runs_of(late)
    if not crowded.isEmpty():
        split = lambda c: [c[i : i + width] for i in range(len(c) - width + 1)]
        found = found.unionByName(first_by_window(work, crowded, split))
    found = work.save(found, "found")
    located = named(distinct).select("sid", "seed", "segment", "segment2", "owner", "start", "windows", "again").join(found, "sid", "left").where("again OR found IS NOT NULL")
    located = work.save(located.drop("sid", "again"), "located")

    every = named(segments.select("_row", "_key", "first", "seed", "content")).join(located.hint("shuffle_hash"), ["seed", "segment", "segment2"])
    answers = work.save(flagged_runs(every, F.struct("owner", "start") < F.struct("_key", "first"), F.struct("run.o", "run.s") < F.struct("_key", "at")), "answers")
    work.drop("segments", "distinct", "trimmed", "late", "found", "located")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, own, at, n in zip(*(b[c] for c in ("_key", "_text", "_own", "at", "n")), strict=True):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                gone = covered(at, n, None, width, len(raw)) if at is not None else np.zeros(len(raw), dtype=bool)
                n = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                out += [(key, raw[~gone].tobytes(), len(raw), n)] * own
            yield pd.DataFrame(out, columns=["_id", "kept", "n_bytes", "n_spans"])

    owners = texts.join(answers.hint("shuffle_hash"), "_row", "left").mapInPandas(strip, "_id long, kept binary, n_bytes long, n_spans long")
    n = F.octet_length("_text").cast("bigint")
    copied = work.spark.read.parquet(f"{work.root}/distinct_texts").select("_row", n.alias("n_bytes"), F.when(n < width, F.col("_text")).otherwise("").cast("binary").alias("kept"))
    copies = members.join(copied, "_row").select("_id", "kept", "n_bytes", (F.col("n_bytes") >= width).cast("bigint").alias("n_spans"))
    owners = owners.withColumn("_id", F.when(F.col("_id") != LAST, F.col("_id")))
    return owners.unionByName(copies).withColumnRenamed("_id", id_col)
