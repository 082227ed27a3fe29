"""Candidate search for repeated windows of tokens: which windows of which texts may occur again elsewhere.

A window's anchor is the gram of ``gram`` tokens with the smallest hash in it, the leftmost of equal ones. It depends on the window's content
alone, so that equal windows have equal anchors at equal places; and neighbouring windows mostly share one. A window whose anchor
gram occurs once in all texts is unique. Windows are handled in segments: the windows in a row of one text that share an anchor.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Stands for a null id: later than all others.
LAST = (1 << 63) - 1
#: More than any text has tokens.
PLACES = 1 << 40
U = np.uint64
_BASE, _MIX = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Places in a text are this many bits of a key; longer texts are searched in pieces of that length that overlap.
PLACE_BITS = 22
#: Segments that a task hands over at a time. A text that repeats one token has a segment at every place.
AT_ONCE = 50_000
#: Bytes of texts that a task searches together; a longer text is searched alone.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class Spec:
    width: int
    gram: int
    words: bool

    @property
    def reach(self) -> int:
        return self.width - self.gram + 1


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, x, dtype=np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _MIX
    return h ^ (h >> U(29))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]."""
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def tokens(text: bytes, spec: Spec) -> np.ndarray:
    """A 64-bit value of each token; equal tokens have equal values."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not spec.words:
        return _BYTES[raw]
    a, b = word_places(raw)
    return spans(_BYTES[raw], a, b) if len(a) else np.zeros(0, dtype=np.uint64)


def anchors(values: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Anchor place of each window, and the gram hash at each place. Texts beyond 2**PLACE_BITS tokens go in overlapping pieces."""
    n = len(values) - spec.width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.arange(len(values) - spec.gram + 1)
    grams = spans(values, at, at + spec.gram)
    out, step = np.empty(n, dtype=np.int64), (1 << PLACE_BITS) - spec.width
    for s in range(0, n, step):
        e = min(n, s + step)
        part = grams[s : e + spec.reach - 1]
        low = U((1 << PLACE_BITS) - 1)
        key, size = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * size <= spec.reach:
            key, size = np.minimum(key[:-size], key[size:]), 2 * size
        if size < spec.reach:
            key = np.minimum(key[: size - spec.reach], key[spec.reach - size :])
        out[s:e] = (key & low).astype(np.int64) + s
    return out, grams


def runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and end of each run of windows with one anchor."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, dtype=np.int64)
    return first, np.append(first[1:], len(place))


@dataclass(frozen=True)
class Runs:
    """Runs of windows with one anchor in several texts: the text of each, its first window and the end, the anchor's place and the hash of its gram.
    Tokens are counted through all texts; ``begins`` is the first of each text. ``raw`` holds the texts, one white space apart, and ``places`` its words, if tokens are words."""

    raw: bytes
    places: tuple[np.ndarray, np.ndarray] | None
    begins: np.ndarray
    text: np.ndarray
    first: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    seed: np.ndarray


def runs_in(texts: list[bytes], spec: Spec) -> Runs:
    """The runs of all texts, found at once, so that short texts cost no calls of their own. A hash and the order of hashes depend on content alone, not on the texts before."""
    raw = b"\n".join(texts)
    data, sizes = np.frombuffer(raw, dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    if spec.words:
        a, b = places = word_places(data)
        values = spans(_BYTES[data], a, b) if len(a) else np.zeros(0, dtype=np.uint64)
        begins, ends = np.searchsorted(a, start), np.searchsorted(a, start + sizes)
    else:
        places, values, begins, ends = None, _BYTES[data], start, start + sizes
    place, hashes = anchors(values, spec)
    n = np.maximum(ends - begins - spec.width + 1, 0)  # windows inside a text
    text = np.repeat(np.arange(len(texts)), n)
    window = np.arange(len(text)) + np.repeat(begins - (np.cumsum(n) - n), n)
    place = place[window]
    at, end = runs(place)  # windows of different texts have different anchors
    return Runs(raw, places, begins, text[at], window[at], window[at] + (end - at), place[at], hashes[place[at]])


def together(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in a row that are searched together, with the number of the first."""
    begin, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text.encode()
        if held and size + len(text) > TOGETHER:
            yield begin, held
            begin, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield begin, held


def of_text(seed: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number for a seed in a text. Two that meet by chance make a window a candidate that is none, which the later steps see."""
    return seed + mixed((text.astype(np.uint64) + U(1)) * U(_BASE))


def distinct_texts(work: Workspace, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, members): one row (_row, _key, _text, _own) per distinct text with a number of its own, its smallest id and how many of its rows have
    that id; and (_id, _row) for every other row. Different texts can share a smallest id, so that only _row names a text. Copies of a whole text
    meet after map-side combining, and take no part in the search for windows."""
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text")).withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    texts = rows.groupBy("_digest", "_text").agg(F.coalesce(F.min("_id"), F.lit(LAST)).alias("_key")).withColumn("_row", F.monotonically_increasing_id())
    texts = work.save(texts, "distinct_texts")
    ids = rows.select("_id", "_digest").join(texts.select("_digest", "_key", "_row"), "_digest").select("_id", "_key", "_row")
    ids = work.save(ids, "members")
    owners = F.coalesce("_id", F.lit(LAST)) == F.col("_key")
    return texts.select("_row", "_key", "_text").join(ids.where(owners).groupBy("_row").agg(F.count(F.lit(1)).alias("_own")), "_row"), ids.where(~owners).select("_id", "_row")


def candidate_segments(work: Workspace, spec: Spec, same_text: bool, cut) -> DataFrame:
    """Segments of the distinct texts whose anchor gram occurs again: (_row, _key, first, windows, at, seed, content), written to ``segments``; at is where the
    anchor lies, counted from the first window. ``cut(runs)`` gives a function of first windows and ends that gives the contents. Anchors count across texts, and with ``same_text`` inside one text too."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, seeds, sizes, row = [], [], [], b["_row"].to_numpy()
            for begin, texts in together(b["_text"]):
                found = runs_in(texts, spec)
                key = of_text(found.seed, found.text)
                order = np.argsort(key)
                key, text, seed = key[order], found.text[order], found.seed[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])])) if len(key) else order
                rows.append(row[begin + text[new]])
                seeds.append(seed[new])
                sizes.append(np.diff(np.append(new, len(key))))
            yield pd.DataFrame({"_row": np.concatenate(rows), "seed": np.concatenate(seeds).view(np.int64), "n": np.concatenate(sizes).astype(np.int32)} if rows else {"_row": [], "seed": [], "n": []})

    texts = work.spark.read.parquet(f"{work.root}/distinct_texts")
    pairs = work.save(texts.select("_row", "_text").mapInPandas(grams, "_row long, seed long, n int"), "pairs")
    again = (F.sum("n") if same_text else F.count(F.lit(1))) > 1  # a text has one row for each of its grams
    repeated = pairs.groupBy("seed").agg(again.alias("again")).where("again").select("seed")
    marks = work.save(pairs.select("_row", "seed").join(repeated, "seed").groupBy("_row").agg(F.collect_list("seed").alias("seeds")), "marks")
    work.drop("pairs")

    def whole(parts: list[tuple]) -> pd.DataFrame:
        *numbers, contents = zip(*parts, strict=True)
        names = ("_row", "_key", "first", "windows", "at", "seed")
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, numbers, strict=True)} | {"content": [x for c in contents for x in c]})

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts: list[tuple] = []
            waiting = 0
            row, key, seeds = b["_row"].to_numpy(), b["_key"].to_numpy(), b["seeds"].tolist()
            for begin, texts in together(b["_text"]):
                found = runs_in(texts, spec)
                own = seeds[begin : begin + len(texts)]
                marked = np.concatenate([np.asarray(x, dtype=np.int64) for x in own]).view(np.uint64)
                marked = np.sort(of_text(marked, np.repeat(np.arange(len(own)), [len(x) for x in own])))
                asked = of_text(found.seed, found.text)
                hit = marked[np.minimum(np.searchsorted(marked, asked), len(marked) - 1)] == asked
                text, first, end, seed = (x[hit] for x in (found.text, found.first, found.end, found.seed.view(np.int64)))
                shift = (found.anchor - found.first)[hit]
                own_first, contents = first - found.begins[text], cut(found)
                for s in range(0, len(first), AT_ONCE):
                    p = slice(s, s + AT_ONCE)
                    f, e = first[p], end[p]
                    parts.append((row[begin + text[p]], key[begin + text[p]], own_first[p], (e - f).astype(np.int32), shift[p].astype(np.int32), seed[p], contents(f, e)))
                    waiting += len(f)
                    if waiting >= AT_ONCE:
                        yield whole(parts)
                        parts, waiting = [], 0
            if parts:
                yield whole(parts)

    found = texts.select("_row", "_key", "_text").join(marks.hint("shuffle_hash"), "_row").mapInPandas(segments, "_row long, _key long, first long, windows int, at int, seed long, content binary")
    out = work.save(found, "segments")
    work.drop("marks")
    return out


def distinct_segments(work: Workspace, segments: DataFrame, crowd_bytes: int, same_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct, contested, crowded). distinct has one row per seed and content: sid (its number), seed, owner and start (the earliest place),
    last (the last text), again (whether it occurs again: in a later text, or with ``same_text`` also in the same one), windows, at, content. Equal segments combine
    before the shuffle. contested are those of seeds with several contents; crowded those of seeds with more than ``crowd_bytes`` of them, which are not in contested."""
    place = F.col("_key").cast("decimal(19,0)") * F.lit(PLACES).cast("decimal(14,0)") + F.col("first")  # in order of text, then place; one number, so that the aggregation hashes
    facts = ("windows", "at")
    rows = segments.groupBy("seed", "content").agg(F.min(place).alias("e"), F.max(place).alias("l"), *[F.any_value(c).alias(c) for c in facts])
    start = F.pmod("e", F.lit(PLACES).cast("decimal(14,0)"))
    text = lambda c: F.expr(f"({c} - pmod({c}, {PLACES})) div {PLACES}")
    again = F.col("e") < F.col("l") if same_text else text("e") < text("l")
    rows = rows.select("seed", "content", *facts, text("e").alias("owner"), start.cast("bigint").alias("start"), text("l").alias("last"), again.alias("again"))
    distinct = work.save(rows.withColumn("sid", F.monotonically_increasing_id()), "distinct")
    seeds = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("contents"), F.sum(F.length("content")).alias("size")).where("contents > 1")
    seeds = work.save(seeds.select("seed", (F.col("size") > crowd_bytes).alias("crowded")), "seeds")
    contested, crowded = (distinct.join(seeds.where(x), "seed", "left_semi") for x in ("NOT crowded", "crowded"))
    return distinct, contested, crowded


def named(segments: DataFrame) -> DataFrame:
    """Adds segment and segment2: 128 bits of hash that, with the seed, stand for the content in a join."""
    return segments.withColumn("segment", F.xxhash64("content")).withColumn("segment2", F.xxhash64(F.lit(7), "content")).drop("content")


def runs_of(late: DataFrame) -> DataFrame:
    """From windows (sid, i, o, s), whose earliest place is (o, s), a list of (i, n, o, s) per sid: n windows in a row whose earliest places are in a row as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sid, i, o, s = (b[x].to_numpy() for x in ("sid", "i", "o", "s"))
            new = np.concatenate([[True], (sid[1:] != sid[:-1]) | (i[1:] != i[:-1] + 1) | (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)])
            at = np.flatnonzero(new)
            yield pd.DataFrame({"sid": sid[at], "i": i[at], "n": np.diff(np.append(at, len(b))).astype(np.int32), "o": o[at], "s": s[at]})

    rows = late.repartition("sid").sortWithinPartitions("sid", "i").mapInPandas(run, "sid long, i int, n int, o long, s long")
    return rows.groupBy("sid").agg(F.collect_list(F.struct("i", "n", "o", "s")).alias("found"))


def first_by_window(work: Workspace, segments: DataFrame, split) -> DataFrame:
    """Per sid the runs (i, n, o, s) of windows that also occur earlier among segments (sid, owner, start, content).

    For seeds with too many segments for one task: windows meet by a 128-bit digest of their content, combined before the shuffle. ``split(content)``
    gives the contents of the windows. The windows that recur join back; those of a common passage are a skewed side of that join, which Spark splits.
    """

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                found = [[hashlib.blake2b(w, digest_size=16).digest() for w in split(c)] for c in part["content"]]
                sizes = [len(x) for x in found]
                i = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                out = {c: np.repeat(part[c].to_numpy(), sizes) for c in ("sid", "owner", "start")}
                yield pd.DataFrame(out | {"i": i, "digest": [d for x in found for d in x]}).assign(start=lambda x: x["start"] + x["i"])

    each = segments.select("sid", "owner", "start", "content").mapInPandas(windows, "sid long, owner long, start long, i int, digest binary")
    each = work.save(each, "crowded_windows")
    place = F.struct("owner", "start")
    recurs = each.groupBy("digest").agg(F.min(place).alias("e"), F.max(place).alias("l")).where("e < l").select("digest", "e")
    late = each.join(work.save(recurs, "crowded_firsts"), "digest").where(F.col("e") < place)
    return runs_of(late.select("sid", "i", F.col("e.owner").alias("o"), F.col("e.start").alias("s")))


def flagged_runs(segments: DataFrame, earlier: Column, run_earlier: Column) -> DataFrame:
    """Per text (_row) the runs of windows that occur earlier, as lists at (first windows) and n, from segments (_row, first, windows, found).

    Where the segment as a whole occurs earlier, all its windows do, since the places in found are earlier still; else those runs of found that lie earlier than here. ``run_earlier`` says
    so of a run (i, n, o, s) that begins here at ``at``.
    """
    whole = segments.where(earlier).select("_row", F.col("first").alias("at"), F.col("windows").alias("n"))
    rest = segments.where(~earlier & F.col("found").isNotNull()).withColumn("run", F.explode("found")).withColumn("at", F.col("first") + F.col("run.i"))
    runs = whole.unionByName(rest.where(run_earlier).select("_row", "at", F.col("run.n").alias("n")))
    return runs.groupBy("_row").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))


def covered(at: np.ndarray, windows: np.ndarray, bits: list[bytes] | None, width: int, n: int) -> np.ndarray:
    """Which of n tokens are covered by flagged windows, given in runs: the first window of each, how many windows it has, and a bit for each, none if all are flagged."""
    step, at, windows = np.zeros(n + 1, dtype=np.int64), np.asarray(at, dtype=np.int64), np.asarray(windows, dtype=np.int64)
    begin, end = [at], [at + windows]
    if bits is not None:
        whole = np.array([not len(x) for x in bits], dtype=bool)
        begin, end = [at[whole]], [at[whole] + windows[whole]]
        for a, x in zip(at[~whole].tolist(), [x for x in bits if len(x)], strict=True):
            one = a + np.flatnonzero(np.unpackbits(np.frombuffer(x, dtype=np.uint8), bitorder="little"))
            begin.append(one)
            end.append(one + 1)
    np.add.at(step, np.concatenate(begin), 1)
    np.add.at(step, np.concatenate(end) + (width - 1), -1)
    return np.cumsum(step[:n]) > 0
