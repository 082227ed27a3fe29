"""Hard negatives: segment summaries bound inner products, which are scored exactly only where the bounds can't decide."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

#: Lengths of a segment, level by level; each level halves the segments of the one before.
SEGMENTS = (16, 8, 4)
#: Integers up to this are exact as doubles.
EXACT = 2.0**53


def summaries(q: np.ndarray) -> list[np.ndarray]:
    """For each level the means of all segments, then their deviations, both times the root of the length. (rows, 2 * segments) float32."""
    out = []
    for m in SEGMENTS:
        parts = q.reshape(len(q), -1, m)
        with np.errstate(all="ignore"):
            out.append(np.concatenate([parts.mean(axis=2) * math.sqrt(m), parts.std(axis=2) * math.sqrt(m)], axis=1).astype(np.float32))
    return out


class Rows:
    """Vectors of a block with their stored summaries."""

    def __init__(self, frame: pd.DataFrame, width: int):
        self.slot, self.id, self.label = frame["_slot"].to_numpy(), frame["_id"].to_numpy(), frame["_label"].to_numpy()
        self.q = np.zeros((len(frame), width))
        for i, raw in enumerate(frame["_q"]):
            self.q[i] = np.frombuffer(raw, np.float32 if len(raw) == 4 * width else np.float64)
        cut = np.cumsum([2 * width // m for m in SEGMENTS])
        self.levels = np.split(np.frombuffer(b"".join(frame["_sums"]), np.float32).reshape(len(frame), cut[-1]), cut[:-1], axis=1)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((self.q**2).sum(axis=1))

    def take(self, at) -> Rows:
        out = object.__new__(Rows)
        out.slot, out.id, out.label, out.q, out.norm, out.levels = self.slot[at], self.id[at], self.label[at], self.q[at], self.norm[at], [x[at] for x in self.levels]
        return out


def products(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products of the pairs alive; of all, if they are many."""
    if alive.mean() > 0.125:
        return a @ b.T
    out, (i, j) = np.zeros(alive.shape, a.dtype), np.nonzero(alive)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y])
    return out


def best(anchors: Rows, rows: Rows, alive: np.ndarray, least: np.ndarray, cap: np.ndarray, most: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the alive pairs that can be among the ``top`` best of an anchor below any limit from ``cap`` to ``most``, best first, ties by id.

    Level by level the inner product lies between the products of the means less and plus those of the deviations. The top-th largest lower bound among rows that are surely below
    ``cap`` is one for the answer; rows that can't reach it, or ``least``, or that surely lie over ``most``, go. The last level is the exact product.
    """
    with np.errstate(all="ignore"):
        exact = bool(anchors.norm.max(initial=0) * rows.norm.max(initial=0) < EXACT)
        slack = (anchors.norm[:, None] * rows.norm[None, :] * ((anchors.q.shape[1] + 16) * 2.0**-22)).astype(np.float32)
        for level in [*range(len(SEGMENTS)), None][: None if exact else -1]:
            if not alive.any():
                break
            if level is None:
                low = high = products(anchors.q, rows.q, alive)
            else:
                a, b = anchors.levels[level], rows.levels[level]
                s = a.shape[1] // 2
                mean, deviation = products(a[:, :s], b[:, :s], alive), products(a[:, s:], b[:, s:], alive) + slack
                low, high = mean - deviation, mean + deviation
            need = least
            if alive.shape[1] > top:
                sure = np.where(alive & (high <= cap[:, None]), low, -np.inf)
                need = np.fmax(least, np.partition(sure, -top, axis=1)[:, -top])
            alive = alive & ~((high < need[:, None]) | (low > most[:, None]))
    i, j = np.nonzero(alive)
    if exact:
        score = low[i, j].astype(np.int64) if len(i) else np.zeros(0, np.int64)
    else:  # beyond the integers of doubles; a score beyond 64 bits raises OverflowError
        score = np.array([sum(int(x) * int(y) for x, y in zip(anchors.q[u], rows.q[v], strict=True)) for u, v in zip(i, j, strict=True)], dtype=np.int64)
    order = np.lexsort((rows.id[j], -score, i))
    return i[order], j[order], score[order]


def chunks(anchors: Rows, n: int):
    """Parts of the anchors, so that a part's matrix has at most about 2 million pairs."""
    step = max(1, (1 << 21) // max(1, n))
    for k in range(0, len(anchors.id), step):
        yield k, anchors.take(slice(k, k + step))


POSITIVE = "_anchor long, anchor_id long, positive_id long, positive_score long"
NEGATIVE = "_anchor long, _limit long, negative_id long, negative_score long"


def _positives(width: int, top: int):
    def search(frame: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4), np.int64)]
        if len(frame) and len(others):
            rows = Rows(others, width)
            for _, part in chunks(Rows(frame, width), len(rows.id)):
                none = np.full(len(part.id), np.inf)
                i, j, score = best(part, rows, (part.label[:, None] == rows.label) & (part.id[:, None] != rows.id), -none, none, none, top)
                first = np.arange(len(i)) - np.searchsorted(i, i) < top
                out.append(np.stack([part.slot[i], part.id[i], rows.id[j], score], axis=1)[first])
        return pd.DataFrame(np.concatenate(out), columns=["_anchor", "anchor_id", "positive_id", "positive_score"])

    return search


def _negatives(width: int, top: int, low: int, high: int):
    def search(frame: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) and len(others):
            rows, limits = Rows(others, width), list(frame["_limits"])
            for k, part in chunks(Rows(frame, width), len(rows.id)):
                wanted = [[(int(s), -(-low * int(s) // high)) for s in limits[k + a]] for a in range(len(part.id))]
                least, cap, most = (np.array(x, dtype=float) for x in zip(*[(min(w)[1], min(w)[0], max(w)[0]) for w in wanted], strict=True))
                i, j, score = best(part, rows, part.label[:, None] != rows.label, least, cap, most, top)
                edges = np.searchsorted(i, np.arange(len(part.id) + 1))
                for a, w in enumerate(wanted):
                    mine, ids = score[edges[a] : edges[a + 1]], rows.id[j[edges[a] : edges[a + 1]]]
                    for s, floor in w:
                        at = int(np.searchsorted(-mine, -s))
                        out += [(part.slot[a], s, ids[x], mine[x]) for x in range(at, min(at + top, len(mine))) if mine[x] >= floor]
        return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 4), columns=["_anchor", "_limit", "negative_id", "negative_score"])

    return search


def _first(rows: DataFrame, top: int, keys: list[str], score: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)


def mine_negatives(spark: SparkSession, vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256.0,
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Per anchor and positive the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product. Rows where ``anchor`` holds search all rows: first their ``positives`` best rows
    of the same label, then for each the ``negatives`` best rows of another label with low * positive_score <= high * negative_score <= high * positive_score. Ties go to the smaller id.

    Every vector's segment means and deviations are written once. Anchors and rows are dealt into blocks, and each pair of blocks is one group: rows travel once per block
    of anchors, anchors once per block of rows, and a block takes at most 2**22 components, so that memory is bounded whatever the labels' sizes. A group keeps the few best per anchor; Spark
    merges them by anchor. Bounds carry the rounding errors of their sums, so that nothing is lost; where they can't decide, all is scored exactly.

    Rows of null id or label, null vector or any null or non-finite component take no part. Shorter vectors count as padded with zeros. Rows that repeat an id are rows of
    their own, but are no positives of an anchor with that id; repeated anchors each get their rows. A positive of negative score has no negatives. Scores beyond 64 bits raise an
    error. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    work = Workspace(spark, "negatives")
    label = vectors["label"] if label is None else label
    rows = vectors.select(vectors[id_col].cast("long").alias("_id"), label.cast("string").alias("_label"), vectors[vector_col].alias("_v"), F.coalesce(anchor, F.lit(False)).alias("_asks"))
    rows = rows.where("_id IS NOT NULL AND _label IS NOT NULL AND _v IS NOT NULL").where(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    width = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    width = max(1, math.ceil(width / SEGMENTS[0])) * SEGMENTS[0]

    def summed(frames):
        for frame in frames:
            q = np.zeros((len(frame), width))
            for i, v in enumerate(frame["_v"]):
                q[i, : len(v)] = np.floor(scale * np.asarray(v, dtype=np.float64))
            small = np.abs(q).max(axis=1, initial=0) < 2.0**24
            yield frame[["_id", "_label", "_asks"]].assign(_q=[x.astype(np.float32 if s else np.float64).tobytes() for x, s in zip(q, small, strict=True)], _sums=[x.tobytes() for x in np.concatenate(summaries(q), axis=1)] if len(q) else [])

    made = rows.mapInPandas(summed, "_id long, _label string, _asks boolean, _q binary, _sums binary").withColumn("_slot", F.monotonically_increasing_id())
    made = work.save(made, "summaries")
    n, asked = made.agg(F.count(F.lit(1)), F.count_if("_asks")).first()
    most = max(64, (1 << 22) // width)
    row_blocks, anchor_blocks = max(1, math.ceil(n / most), min(64, math.ceil(n / 1024))), max(1, math.ceil(asked / most))
    keys = ["_a", "_r"]
    data = made.select("_slot", "_id", "_label", "_q", "_sums", F.pmod("_slot", F.lit(row_blocks)).alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("_a"))

    def asking(found: DataFrame) -> DataFrame:
        return found.withColumn("_a", F.pmod(F.xxhash64("_slot"), F.lit(anchor_blocks)).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    anchors = made.where("_asks").drop("_asks")
    near = asking(anchors).groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_positives(width, positives), POSITIVE)
    near = work.save(_first(near, positives, ["_anchor"], "positive_score", "positive_id").drop("_n"), "positives")
    limits = near.where("positive_score >= 0").groupBy("_anchor").agg(F.collect_set("positive_score").alias("_limits"))
    asks = work.save(anchors.join(limits.withColumnRenamed("_anchor", "_slot"), "_slot"), "limits")
    hard = asking(asks).groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_negatives(width, negatives, low, high), NEGATIVE)
    hard = work.save(_first(hard, negatives, ["_anchor", "_limit"], "negative_score", "negative_id"), "negatives")
    found = near.join(hard.withColumnRenamed("_limit", "positive_score"), ["_anchor", "positive_score"])
    return found.select("anchor_id", "positive_id", F.col("_n").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
