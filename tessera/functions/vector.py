"""Vectors as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of one matrix of similarities, at most about.
CELLS = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_in_blocks(queries: DataFrame, known: DataFrame, id_col: str, vector_col: str, k: int, block_rows: int = 20_000, within: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """The k most similar known rows of each query: id, match, similarity (rounded to six places) and ``keep`` of the match; ties to the larger match if k is 1, else to the smaller.

    Rows meet only where the ``within`` columns are equal. Both sides of such a tenant are dealt to blocks of about ``block_rows`` by hash, and each two blocks meet in a group of their own, which
    keeps k rows a query; a window merges them. So no side is broadcast, no task holds more than two blocks, and tenants never travel to each other. A row does not match itself.
    This is the exact scan; VectorIndex finds the same through lists.
    """
    tenant = F.concat_ws("\0", *[F.col(c).cast("string") for c in within]) if within else F.lit("")
    take = lambda df: df.where(F.col(vector_col).isNotNull()).select(tenant.alias("tenant"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if within:
        blocks = lambda df, name: df.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
        q, r = take(queries), take(known)
        sizes = blocks(q, "_q").join(blocks(r, "_r"), "tenant")
        q, r = q.join(sizes, "tenant"), r.join(sizes, "tenant")
    else:  # one tenant: its sizes are two numbers
        n, m = (F.lit(max(1, -(-df.count() // block_rows))) for df in (queries, known))
        q, r = (take(df).withColumn("_q", n).withColumn("_r", m) for df in (queries, known))
    deal = lambda df, own, other, i, j: df.select("tenant", "id", "v", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(i), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j))
    kind, keys = queries.schema[id_col].dataType.simpleString(), ["tenant", "i", "j"]

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            x, y = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (left, right))
            ids, norms = right["id"].to_numpy(), np.linalg.norm(y, axis=1)
            step = max(1, CELLS // len(y))
            for start in range(0, len(x), step):
                part, names = x[start : start + step], left["id"].to_numpy()[start : start + step]
                size = np.linalg.norm(part, axis=1)[:, None] * norms[None, :]
                near = np.round(np.divide(part @ y.T, size, out=np.full(size.shape, -np.inf), where=size > 0), 6)
                near[names[:, None] == ids[None, :]] = -np.inf
                edge = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(near), -np.inf)
                for n, row, least in zip(names, near, edge, strict=True):
                    at = np.flatnonzero((row >= least) & (row > -np.inf))
                    order = np.lexsort((ids[at], -row[at])) if k > 1 else np.lexsort((ids[at], row[at]))[::-1]
                    out += [(n, ids[t], float(row[t])) for t in at[order[:k]]]
        return pd.DataFrame(out, columns=["id", "match", "similarity"])

    asked, held = deal(q, "_q", "_r", "i", "j"), deal(r, "_r", "_q", "j", "i")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(closest, f"id {kind}, match {kind}, similarity double")
    order = [F.desc("similarity"), F.col("match") if k > 1 else F.desc("match")]
    best = found.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    facts = known.select(F.col(id_col).alias("match"), *keep)
    best = best.withColumnRenamed("id", id_col)
    return best.join(facts, "match").select(id_col, "match", "similarity", *keep) if keep else best.select(id_col, "match", "similarity")
