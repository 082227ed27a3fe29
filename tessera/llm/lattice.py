"""Near-duplicate embeddings by lattice hashing: E8 cells of random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components
from .simhash import Links, tiles


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of plus or minus 1, or eight halves with an even number of minus signs."""
    pairs = [[(a if k == i else b if k == j else 0.0) for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1.0, -1.0), repeat=2)]
    halves = [[s / 2 for s in signs] for signs in product((1.0, -1.0), repeat=8) if signs.count(-1.0) % 2 == 0]
    return np.array(pairs + halves)


NEAREST = shortest_vectors()
#: Scale of the projections for 50,000 vectors.
SCALE = 2.2


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers of even sum."""
    p = np.rint(y)
    off = y - p
    odd = np.flatnonzero(p.sum(axis=1).astype(np.int64) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    p[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return p


def e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the better of D8 and D8 shifted by halves."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    a[closer] = b[closer]
    return a


def projections(dims: int, tables: int, seed: int) -> np.ndarray:
    """For each table eight orthonormal directions, or as many as there are dimensions, scaled to keep distances on average."""
    rng, out = np.random.Generator(np.random.PCG64([seed, dims])), np.zeros((tables, dims, 8))
    k = min(8, dims)
    for t in range(tables):
        q, _ = np.linalg.qr(rng.standard_normal((dims, k)))
        out[t, :, :k] = q * np.sqrt(dims / k)
    return out


def cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Keys of shape (rows, tables, 1 + probes): the cell of each row in each table, then the neighbouring cells closest to it."""
    out = np.empty((len(x), tables, 1 + probes), dtype=np.uint64)
    weights = np.random.Generator(np.random.PCG64([seed, 8])).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for t, p in enumerate(projections(x.shape[1], tables, seed)):
        y = x @ p * scale
        home = e8(y)
        best = np.argpartition(-((y - home) @ NEAREST.T), min(probes, len(NEAREST) - 1), axis=1)[:, :probes] if probes else np.zeros((len(x), 0), dtype=np.int64)
        points = np.concatenate([home[:, None, :], home[:, None, :] + NEAREST[best]], axis=1)
        key = ((2 * points).astype(np.int64).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) + np.uint64(t * 1000003 + x.shape[1])
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, t] = key ^ (key >> np.uint64(32))
    return out


def meeting_chance(dims: int, least: float, probes: int, scale: float, seed: int, pairs: int = 600) -> float:
    """Chance that two unit vectors of cosine ``least`` meet in a table: from random pairs in as many tables as it takes for 200 of them to meet, 256 at most, less two
    standard errors."""
    rng = np.random.Generator(np.random.PCG64([seed, dims, 9]))
    x = rng.standard_normal((pairs, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dims))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * y
    hits, tried = 0, 0
    for k in range(64):
        a, b = (cells(v, 4, probes, scale, seed + 1000 + k) for v in (x, y))
        hits += int(((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)).sum())
        tried += 4 * pairs
        if hits >= 200:
            break
    return max(0.0, hits - 2 * math.sqrt(hits)) / tried


def plan_tables(n: int, dims: int, least: float, recall: float, seed: int) -> tuple[float, int, int]:
    """(scale, tables, probes) for n vectors, such that a pair of cosine ``least`` meets with chance ``recall``.

    The scale grows with n, so that cells stay small; with it the chance to meet in a table falls, and the number of tables grows. Of several numbers of
    probes the one with the fewest cells in all is taken.
    """
    scale = SCALE * (max(n, 1) / 50_000) ** (1 / 12)
    if dims < 2 or least >= 1:
        return scale, 1, 8
    plans = []
    for probes in (0, 2, 8, 32):
        chance = min(meeting_chance(dims, least, probes, scale, seed), 0.999999)
        if chance > 0:
            tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))
            plans.append((tables * (1 + probes), tables, probes))
    _, tables, probes = min(plans)
    return scale, tables, probes


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v) -> bool:
    if v is None or not len(v):
        return False
    try:
        x = np.array(v, dtype=np.float64)  # None becomes NaN
    except (TypeError, ValueError):
        return False
    return bool(np.isfinite(x).all() and (x != 0).any())


def cell_links(rep: np.ndarray, looks: np.ndarray, found: np.ndarray, cell: np.ndarray, tile: np.ndarray, table: np.ndarray, x: np.ndarray, keys_of, copies: np.ndarray, least: float, chunk: int = 60_000) -> tuple[np.ndarray, Links]:
    """Links found in the cells of one bucket, each pair counted in one cell of all only: counts per row of x, and a forest of links.

    rep: row of x of each entry; looks and found: its part in its tile of the cell; keys_of: cells of rows of x. A pair that meets in several cells is counted in the first table where it meets, in its common cell, or else in the
    cell of the larger row's id, or else of the smaller's.
    """
    count, links = np.zeros(len(x), dtype=np.int64), Links(len(x))
    keys, have = None, np.zeros(len(x), dtype=bool)
    spot = cell + tile.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # several tiles of a cell may lie in one bucket
    order = np.argsort(spot[found], kind="stable")
    index, index_rep = spot[found][order], rep[found][order]
    rep, found, cell, table, spot = rep[looks], found[looks], cell[looks], table[looks], spot[looks]
    lo, hi = np.searchsorted(index, spot, "left"), np.searchsorted(index, spot, "right")
    width, at = hi - lo, 0
    total = np.cumsum(width)
    while at < len(cell):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, "right")))
        left = np.repeat(np.arange(at, end), width[at:end])
        right = index_rep[np.arange(len(left)) - np.repeat(np.cumsum(width[at:end]) - width[at:end], width[at:end]) + lo[left]]
        a, b, where, t = rep[left], right, cell[left], table[left]
        ok = (a != b) & (~found[left] | (a < b))  # two rows that both look and are found meet twice, as entries both ways
        a, b, where, t = a[ok], b[ok], where[ok], t[ok]
        for i in range(0, len(a), chunk):
            p, q, w, tt = a[i : i + chunk], b[i : i + chunk], where[i : i + chunk], t[i : i + chunk]
            near = (x[p] * x[q]).sum(axis=1) >= least
            p, q, w, tt = p[near], q[near], w[near], tt[near]
            if not len(p):
                continue
            new = np.unique(np.concatenate([p, q]))
            new = new[~have[new]]
            if len(new):  # only rows with a link need to know where else they lie
                part = keys_of(x[new])
                keys = np.zeros((len(x), *part.shape[1:]), dtype=np.uint64) if keys is None else keys
                keys[new], have[new] = part, True
            small, large = np.minimum(p, q), np.maximum(p, q)
            done = np.zeros(len(p), dtype=bool)
            counted = np.zeros(len(p), dtype=bool)
            for k in range(keys.shape[1]):
                ks, kl = keys[small, k], keys[large, k]
                to_large = (ks == kl[:, :1]).any(axis=1)  # the smaller one reaches the larger one's cell
                to_small = (kl == ks[:, :1]).any(axis=1)
                meet = np.where(to_large, kl[:, 0], ks[:, 0])
                here = ~done & (to_large | to_small)
                counted |= here & (tt == k) & (meet == w)
                done |= here
            p, q = p[counted], q[counted]
            np.add.at(count, p, copies[q])
            np.add.at(count, q, copies[p])
            links.add(p, q)
        at = end
    return count, links


def embedding_groups(spark: SparkSession, vectors: DataFrame, least: float = 0.95, recall: float = 0.99, seed: int = 11, rows_per_bucket: int = 300_000, hot_cell: int = 4000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept (id = component_id).

    * Equal vectors are one node with a count, named by the smallest id.
    * In each of several tables a random projection to eight dimensions, times a scale that grows slowly with the number of vectors, is decoded to its E8
      lattice point; a vector lies in that cell, and looks into it and the neighbouring cells nearest to it. The numbers of tables and of neighbouring
      cells follow from the number of vectors, so that a pair of cosine ``least`` meets with chance ``recall`` at any size (plan_tables).
    * Vectors that meet in a cell are compared by cosine in double precision; only pairs of at least ``least`` are linked. Tasks count each
      pair in one cell only (cell_links) and return counts and a forest of links, not pairs.
    * Cells are dealt to buckets. Of a vector a bucket gets its numbers once, as they are stored, and for each cell an id.
    * A cell with more than ``hot_cell`` vectors or probes is compared in tiles: both are dealt to blocks of about ``hot_cell``, and each two blocks
      of vectors, and each block of probes and block of vectors, meet once in a group of their own. No group holds more than two blocks of a
      split cell, but all pairs of a cell are compared: copies and comparisons grow with the square of its vectors.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and are their own component. Vectors of different
    lengths never meet. Repeated rows of one id are separate vectors with links to each other; kept holds for each of them. A null id is a
    vector that others can link to; it names a component only where all ids are null. An empty table gives an empty result. Other columns
    are ignored.
    """
    work = Workspace(spark, "lattice")
    kind = vectors.schema[id_col].dataType.simpleString()
    number = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(vectors[id_col].alias("_id"), vectors[vector_col].cast("array<float>" if number == "<f4" else "array<double>").alias("_v"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "bytes": [(np.array(v, dtype=np.float64) + 0.0).astype(number).tobytes() if usable(v) else None for v in b["_v"]]})

    coded = work.save(rows.mapInPandas(digest, f"_id {kind}, bytes binary"), "coded")
    nodes = coded.where("bytes IS NOT NULL").groupBy("bytes").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nodes = work.save(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    n, longest = nodes.agg(F.count(F.lit(1)), F.max(F.length("bytes"))).first()
    scale, tables, probes = plan_tables(n, (longest or 0) // int(number[2]), least, recall, seed)
    wide = tables * (1 + probes)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, same in b.groupby(b["bytes"].map(len)):
                for at in range(0, len(same), 256):
                    part = same.iloc[at : at + 256]
                    keys = cells(unit([np.frombuffer(v, dtype=number) for v in part["bytes"]]), tables, probes, scale, seed)
                    yield pd.DataFrame({"cell": keys.ravel().view(np.int64), "place": np.tile(np.arange(wide, dtype=np.int32), len(part)), "rep": np.repeat(part["rep"].to_numpy(), wide)})

    entries = work.save(nodes.select("rep", "bytes").mapInPandas(spread, "cell long, place int, rep long"), "entries")
    is_home = F.col("place") % (1 + probes) == 0
    # a cell that one vector only lies in, and none looks into, links nothing; neither does one that nobody lies in
    blocks_of = lambda kind: F.ceil(F.count_if(kind) / hot_cell).cast("int")
    useful = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), blocks_of(is_home).alias("homes"), blocks_of(~is_home).alias("probes")).where("rows > 1 AND homes > 0")
    hot = (F.col("homes") > 1) | (F.col("probes") > 1)
    useful = useful.select("cell", F.when(hot, F.col("homes")).alias("homes"), F.when(hot, F.col("probes")).alias("probes"))
    used = work.save(entries.join(useful, "cell"), "used")
    work.drop("entries")
    looked = tiles(used, is_home, ("cell", "place"))
    buckets = max(1, -(-used.count() // rows_per_bucket))
    bucket = F.when(F.col("tile").isNull(), F.pmod(F.xxhash64("cell"), F.lit(buckets))).otherwise(F.xxhash64("cell", "tile"))
    looked = looked.withColumn("bucket", bucket).withColumn("tile", F.coalesce("tile", F.lit(0)))
    carried = looked.select("bucket", "rep").distinct().join(nodes.select("rep", "bytes", "copies"), "rep")
    empty = [F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("place"), F.lit(0).cast("long").alias("tile"), F.lit(False).alias("looks"), F.lit(False).alias("found")]
    carried = carried.select("bucket", "rep", *empty, "bytes", "copies")
    looked = looked.select("bucket", "rep", "cell", "place", "tile", "looks", "found", F.lit(None).cast("binary").alias("bytes"), F.lit(0).cast("long").alias("copies"))

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        vector = b["place"].to_numpy() < 0
        given, entry = b[vector].sort_values("rep"), b[~vector]
        length = given["bytes"].map(len).to_numpy()
        for size in np.unique(length):
            own = given[length == size]
            reps = own["rep"].to_numpy()
            x = unit([np.frombuffer(v, dtype=number) for v in own["bytes"]])
            g = entry[np.isin(entry["rep"].to_numpy(), reps)]
            place = g["place"].to_numpy()
            rep = np.searchsorted(reps, g["rep"].to_numpy())
            found, links = cell_links(rep, g["looks"].to_numpy(), g["found"].to_numpy(), g["cell"].to_numpy().view(np.uint64), g["tile"].to_numpy(), place // (1 + probes), x, lambda part: cells(part, tables, probes, scale, seed), own["copies"].to_numpy(), least)
            hit = np.flatnonzero(found)
            out += zip(reps[hit].tolist(), [None] * len(hit), found[hit].tolist(), strict=True)
            out += [(int(reps[i]), int(reps[j]), 0) for i, j in links.made]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"b": "Int64"})

    found = work.save(looked.unionByName(carried).groupBy("bucket").applyInPandas(compare, "a long, b long, n long"), "found")
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("rep"), "n")
    roots = connected_components(work, found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), "root")
    named = nodes.select("rep", "bytes", "copies", "first_id").join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    tops = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(tops, "root").select(F.col("bytes").alias("_bytes"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = coded.join(named, coded["bytes"] == named["_bytes"], "left").select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
