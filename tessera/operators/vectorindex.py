"""Approximate and exact nearest neighbours over an inverted file of vectors: lists around trained centroids, probed by closeness."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import new_folder, saved

#: Vectors that train the centroids, at most; bytes of centroids that a task may hold, at most; vectors of a list that meet in one task, about.
TRAINED_ON, CENTROID_BYTES, PART_ROWS = 50_000, 64 << 20, 20_000
#: Numbers of one matrix, or of the vectors of one batch that leaves a task, at most about.
CELLS = 1 << 20


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length 1; zero vectors stay zero."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def best_of(near: np.ndarray, ids: np.ndarray, k: int, larger: bool = False) -> list[np.ndarray]:
    """Of each row the places of its k largest entries above minus infinity, ties by id. Only entries that reach the k-th are sorted."""
    out = []
    edge = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
    for row, least in zip(near, edge, strict=True):
        at = np.flatnonzero((row >= least) & (row > -np.inf))
        order = np.lexsort((ids[at], row[at]))[::-1] if larger else np.lexsort((ids[at], -row[at]))
        out.append(at[order[:k]])
    return out


class VectorIndex:
    """Vectors (tenant, list, part, id, vector) of unit length as a table sorted by tenant and list, the centroids, and of each list its size and widest angle.

    Centroids come from k-means on at most ``TRAINED_ON`` vectors; every vector is indexed. Rows of null or zero vectors are in no list and ask for nothing. A list with more than
    ``PART_ROWS`` vectors of a tenant is dealt into parts, so that copies of one vector don't meet in one task. Searches return similarities rounded to six places, ties to the smaller id; a vector doesn't find its own id.
    """

    def __init__(self, spark, folder: str, centroids: np.ndarray, lists: DataFrame, sizes: DataFrame):
        self.spark, self.folder, self.centroids, self.lists, self.sizes = spark, folder, centroids, lists, sizes

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, vector_col: str, tenant_col: str | None = None, lists: int | None = None, seed: int = 7) -> VectorIndex:
        spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "vectorindex")
        tenant = F.col(tenant_col).cast("string") if tenant_col else F.lit("")
        given = rows.select(F.coalesce(tenant, F.lit("")).alias("tenant"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        given = given.where(F.col("vector").isNotNull()).withColumn("_n", size).where("_n > 0").withColumn("vector", F.transform("vector", lambda x: x / F.col("_n"))).drop("_n")
        given = saved(given, f"{folder}/given")
        n, dims = given.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        lists = max(1, min(lists or math.isqrt(n or 1), CENTROID_BYTES // (8 * (dims or 1))))
        sample = given.orderBy(F.xxhash64("tenant", "id")).limit(TRAINED_ON).select(array_to_vector("vector").alias("features"))
        if n and lists > 1:
            fit = KMeans(k=lists, seed=seed, maxIter=8, initSteps=1, distanceMeasure="cosine").fit(saved(sample, f"{folder}/sample"))
            centroids = np.stack(fit.clusterCenters())
        else:
            centroids = np.ones((1, dims or 1))
        centroids = unit(pd.Series(list(centroids)))
        kind = given.schema["id"].dataType.simpleString()

        def assigned(frames):
            for frame in frames:
                x = unit(frame["vector"])
                near = x @ centroids.T if len(x) else np.zeros((0, 1))
                at = near.argmax(axis=1)
                yield frame.assign(list=at.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(x)), at], -1, 1)))

        placed = saved(given.mapInPandas(assigned, f"tenant string, id {kind}, vector array<double>, list int, angle double"), f"{folder}/placed")
        sizes = saved(placed.groupBy("tenant", "list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("width")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")), f"{folder}/sizes")
        dealt = placed.join(sizes.select("tenant", "list", "parts"), ["tenant", "list"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        lists_table = saved(dealt.select("tenant", "list", "part", "id", "vector").repartitionByRange("tenant", "list", "part", "id").sortWithinPartitions("tenant", "list"), f"{folder}/lists")
        return cls(spark, folder, centroids, lists_table, sizes)

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int, tenant_col: str | None = None, probes: int | None = None, exact: bool = False, least: float | None = None, among: DataFrame | None = None) -> DataFrame:
        """For each query row its k nearest vectors of its tenant: id, match, similarity.

        Looks into the ``probes`` lists (``plan_probes`` finds how many) whose centroids are nearest. exact: a second pass opens each other list that could still hold a better vector, which
        follows from the angle to its centroid and its width; its answer is that of a scan, and the closer the lists, the fewer it opens. ``least`` drops results below it and lists that
        can't reach it. ``among`` (a column id) restricts what may be found.
        """
        folder, probes = new_folder(self.spark, "vectorsearch"), probes or max(1, math.isqrt(len(self.centroids)))
        tenant = F.col(tenant_col).cast("string") if tenant_col else F.lit("")
        asked = queries.where(F.col(vector_col).isNotNull()).select(F.coalesce(tenant, F.lit("")).alias("tenant"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        asked = saved(asked.where(F.exists("vector", lambda x: x != 0)), f"{folder}/asked")
        rows = self.lists if among is None else self.lists.join(among.select("id").distinct(), "id", "left_semi")
        turns = saved(asked.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("turns")), f"{folder}/turns")
        first = saved(self._meet(self._opened(asked, probes, None), rows, turns, k, least), f"{folder}/first")
        if not exact:
            return _top(first, k).select(F.col("id").alias(id_col), "match", "similarity")
        floors = _top(first, k).groupBy("tenant", "id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("floor"))
        rest = asked.join(floors, ["tenant", "id"], "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0 if least is None else float(least))))
        more = self._meet(self._opened(rest, probes, "floor"), rows, turns, k, least)
        return _top(first.unionByName(more), k).select(F.col("id").alias(id_col), "match", "similarity")

    def _opened(self, asked: DataFrame, probes: int, floor: str | None) -> DataFrame:
        """(tenant, id, vector, list, part): the first lists of each query, or, with a floor, those of the others that can hold a similarity of it or more."""
        centroids, kind = self.centroids, asked.schema["id"].dataType.simpleString()

        def ordered(frames):
            for whole in frames:
                # A query leaves once for each list, with its vector: a batch of Arrow times all lists would not fit into a task.
                dims = len(whole["vector"].iloc[0]) if len(whole) else 1
                step = max(1, CELLS // (len(centroids) * dims))
                for start in range(0, len(whole), step):
                    frame = whole.iloc[start : start + step]
                    near = unit(frame["vector"]) @ centroids.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    take = order[:, :probes] if floor is None else order[:, probes:]
                    at = np.repeat(np.arange(len(frame)), take.shape[1])
                    out = frame[["tenant", "id"]].iloc[at].assign(vector=[frame["vector"].iloc[i] for i in at], list=take.reshape(-1).astype(np.int32), angle=np.arccos(np.clip(near[at, take.reshape(-1)], -1, 1)))
                    yield out.assign(floor=frame[floor].to_numpy()[at] if floor else -2.0)

        lists = asked.mapInPandas(ordered, f"tenant string, id {kind}, vector array<double>, list int, angle double, floor double")
        opened = lists.join(self.sizes, ["tenant", "list"])
        # The most similar vector that a list can hold lies in the direction of the query as far as the list is wide. The slack covers rounding.
        reach = F.when(F.col("angle") <= F.col("width"), 1.0).otherwise(F.cos(F.col("angle") - F.col("width")))
        opened = opened.where(reach >= F.col("floor") - 1e-6)
        return opened.select("tenant", "id", "vector", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def _meet(self, opened: DataFrame, rows: DataFrame, turns: DataFrame, k: int, least: float | None) -> DataFrame:
        kind, keys = opened.schema["id"].dataType.simpleString(), ["tenant", "list", "part", "turn"]
        other = rows.schema["id"].dataType.simpleString()

        def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(left) and len(right):
                y, ids, tenant = unit(right["vector"]), right["id"].to_numpy(), left["tenant"].iloc[0]
                step = max(1, CELLS // len(y))
                for start in range(0, len(left), step):
                    some = left.iloc[start : start + step]
                    near = np.round(unit(some["vector"]) @ y.T, 6)
                    near[some["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                    if least is not None:
                        near[near < least] = -np.inf
                    out += [(tenant, n, ids[t], float(row[t])) for n, row, top in zip(some["id"], near, best_of(near, ids, k), strict=True) for t in top]
            return pd.DataFrame(out, columns=["tenant", "id", "match", "similarity"])

        # Many queries of a tenant take turns at a list, so that neither side of a group grows with the input.
        opened = opened.join(turns, "tenant").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int")).drop("turns")
        rows = rows.join(turns, "tenant").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        return opened.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(nearest, f"tenant string, id {kind}, match {other}, similarity double")

    def plan_probes(self, recall: float = 0.95, k: int = 10, asks: int = 200) -> int:
        """The fewest lists to open so that ``recall`` of the true k nearest of ``asks`` indexed vectors, taken by hash, lie in them. The true ones come from an exact search."""
        folder = new_folder(self.spark, "probes")
        some = saved(self.lists.orderBy(F.xxhash64("id")).limit(asks).select("tenant", "id", "vector", "list"), f"{folder}/some")
        found = self.search(some, "id", "vector", k, "tenant", exact=True)
        held = found.join(self.lists.select(F.col("id").alias("match"), "list"), "match").join(some.select("id", "vector"), "id")
        centroids = self.centroids

        @F.pandas_udf("int")
        def place(vector: pd.Series, at: pd.Series) -> pd.Series:
            near = unit(vector) @ centroids.T
            return pd.Series((near > near[np.arange(len(at)), at.to_numpy()][:, None]).sum(axis=1).astype(np.int32))

        edge = held.select(place("vector", "list").alias("place")).agg(F.percentile("place", recall)).first()[0]
        return min(len(self.centroids), int(math.ceil(edge or 0)) + 1)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("tenant", "id").orderBy(F.desc("similarity"), "match")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
