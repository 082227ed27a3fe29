"""SimHash near-duplicates with the generalised pigeonhole principle."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, keep_only
from .components import connected_components

BITS = 64
#: A probe key is written, shuffled and sorted, which takes about as long as comparing this many pairs of fingerprints inside a task.
PROBE_COST = 100


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit by bit the majority over the XXH64 of all shingles, repeats included, of the text with A-Z lower-cased. No words: 0."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    first = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, ends[-n:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id (as _id), digest of the text (_digest) and fingerprint (fp, its 64 bits as a bigint) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("simhash")
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_digest": b["_digest"], "fp": np.array([fingerprint(t, words, seed) for t in b["_text"]], dtype=np.uint64).view(np.int64)})

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("_digest"))
    return rows.mapInPandas(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _digest string, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all fingerprints: 64 x 64 sums, added up by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            m = np.unpackbits(b["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(BITS), BITS), "j": np.tile(np.arange(BITS), BITS), "n": total.ravel().astype(np.int64)})

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Splits the bits into parts of almost equal size; each grows from a free bit by the free bit most correlated with it so far.
    Correlated bits in one part leave the parts nearly independent of each other."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            b = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(b)
            free.discard(b)
        out.append(sorted(own))
    return out


def pick_thresholds(parts: list[list[int]], p: np.ndarray, n: float, exact: list[float], radius: int) -> tuple[float, list[int]]:
    """Thresholds per part that sum to radius - parts + 1, each -1 or more, of least cost, by dynamic programming.

    Two fingerprints within ``radius`` are then within the threshold in some part. The cost of a threshold is the number of probe keys it makes
    plus the estimated candidate pairs: from the chance that independent bits with the observed frequencies differ in so
    few places, scaled so that threshold 0 agrees with ``exact``, the pairs of equal keys that Spark counted.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, pairs in zip(parts, exact, strict=True):
        differ = [2 * p[b] * (1 - p[b]) for b in bits]
        law = np.zeros(radius + 2)
        law[0] = 1
        for d in differ:
            law[1:] = law[1:] * (1 - d) + law[:-1] * d
            law[0] *= 1 - d
        scale, cost, keys = pairs / max(law[0], 1e-30), {-1: 0.0}, 0.0
        for t in range(radius + 1):
            keys += float(np.prod([(len(bits) - i) / (i + 1) for i in range(t)]))
            cost[t] = PROBE_COST * n * keys + min(scale * law[: t + 1].sum(), n * n / 2)
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, extra in cost.items():
                if used + t + 1 <= radius + 1 and (used + t + 1 not in new or c + extra < new[used + t + 1][0]):
                    new[used + t + 1] = (c + extra, [*ts, t])
        best = new
    return best[radius + 1]


def masks_within(bits: list[int], t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)], dtype=np.uint64)


class Links:
    """Which of n rows are connected; remembers one link for each union."""

    def __init__(self, n: int):
        self.up, self.made = np.arange(n), []

    def roots(self) -> np.ndarray:
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt
        return self.up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i]."""
        while len(a):
            r = self.roots()
            ra, rb = r[a], r[b]
            apart = ra != rb
            a, b, hi, lo = a[apart], b[apart], np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            _, first = np.unique(hi, return_index=True)
            self.up[hi[first]] = lo[first]
            self.made += list(zip(a[first].tolist(), b[first].tolist(), strict=True))


def bucket_links(spot: np.ndarray, fp: np.ndarray, looks: np.ndarray, found: np.ndarray, row: np.ndarray, n: int, radius: int, chunk: int = 500_000) -> list[tuple[int, int]]:
    """Links, as few as connect them, between rows of one bucket within ``radius`` that share a spot: each entry that looks meets those that are found there;
    two that do both meet once.

    Candidates are compared in chunks, and pairs that are connected already are left out before, so that a group of near copies costs
    neither memory nor links by the square.
    """
    links = Links(n)
    order = np.flatnonzero(found)[np.argsort(spot[found], kind="stable")]
    index, index_fp, index_row = spot[order], fp[order], row[order]
    only = looks & ~found
    for inside, a_where, a_fp, a_row in ((looks[order], index, index_fp, index_row), (None, spot[only], fp[only], row[only])):  # equal keys first, then neighbouring ones
        lo, hi = np.searchsorted(index, a_where, "left"), np.searchsorted(index, a_where, "right")
        if inside is not None:
            lo = np.arange(len(index)) + 1  # each pair once
            hi = np.where(inside, hi, lo)
        count = np.maximum(hi - lo, 0)
        at, total = 0, np.cumsum(count)
        while at < len(count):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, "right")))
            for s in range(0, int(count[at]) if end == at + 1 else 1, chunk):
                c = count[at:end] if end > at + 1 else np.array([min(chunk, int(count[at]) - s)])
                if not c.sum():
                    continue
                left = np.repeat(np.arange(at, end), c)
                right = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + lo[left] + s
                r = links.roots()
                apart = r[a_row[left]] != r[index_row[right]]
                left, right = left[apart], right[apart]
                near = np.bitwise_count(a_fp[left] ^ index_fp[right]) <= radius
                links.add(a_row[left[near]], index_row[right[near]])
            at = end
    return links.made


def tiles(entries: DataFrame, is_home: Column, keep: tuple[str, ...]) -> DataFrame:
    """One row for each tile that an entry takes part in: rep, ``keep``, tile, looks, found. homes, probes: numbers of blocks of the entry's cell, null where it isn't split.

    A tile is a pair of blocks: of homes i <= j, where j looks for i; or of probes and of homes, where the probes look. Tiles of one cell have
    different numbers; in a cell that isn't split there is one, null.
    """
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.greatest(blocks, F.lit(1)))
    homes, probes = F.col("homes").cast("long"), F.col("probes").cast("long")
    mine, other = own(homes), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    part = lambda tile, looks, found: F.struct(tile.alias("tile"), looks.alias("looks"), found.alias("found"))
    none = F.array().cast("array<struct<tile:bigint,looks:boolean,found:boolean>>")
    with_homes = F.transform(other(homes), lambda j: part(F.least(mine, j) * homes + F.greatest(mine, j), mine >= j, mine <= j))
    with_probes = F.transform(other(probes), lambda p: part((homes + p) * homes + mine, F.lit(False), F.lit(True)))
    with_probes = F.when(probes > 0, with_probes).otherwise(none)
    of_probe = F.transform(other(homes), lambda j: part((homes + own(probes)) * homes + j, F.lit(True), F.lit(False)))
    whole = F.array(part(F.lit(None).cast("long"), F.lit(True), is_home))
    of_probe = F.when(homes > 0, of_probe).otherwise(none)  # nobody to find
    parts = F.when(F.col("homes").isNull(), whole).when(is_home, F.concat(with_homes, with_probes)).otherwise(of_probe)
    return entries.withColumn("in_tile", F.explode(parts)).select("rep", *keep, "in_tile.tile", "in_tile.looks", "in_tile.found")


def as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(spark: SparkSession, work: Workspace, nodes: DataFrame, radius: int = 4, rows_per_bucket: int = 400_000, most_parts: int = 5, hot_key: int = 20_000) -> DataFrame:
    """Links (a, b) that connect all nodes (rep, fp; distinct fp) whose fingerprints differ in at most ``radius`` bits.

    Bits are grouped into parts by correlation; for each number of parts the thresholds come from pick_thresholds, and the cheapest
    number is used. Every node is indexed under its key in each part and probes all keys within the part's threshold. Keys are
    dealt by hash into buckets, as many as the rows need; each bucket compares inside (bucket_links). A key with more than ``hot_key`` nodes or probes
    is compared in tiles of two blocks, a group each (tiles), so that no task gets more of it than two blocks.
    """
    n = nodes.count()
    together = bit_counts(nodes)
    p = np.diag(together) / max(n, 1)
    choices = {m: correlated_parts(together, n, m) for m in range(2, min(most_parts, radius + 1) + 1)}
    masks = [F.struct(F.lit(m).alias("m"), F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(as_long(sum(1 << x for x in bits)))).alias("key")) for m, parts in choices.items() for k, bits in enumerate(parts)]
    keyed = nodes.select(F.explode(F.array(*masks)).alias("x")).groupBy("x.m", "x.part", "x.key").count()
    exact = {(r.m, r.part): float(r.pairs) for r in keyed.groupBy("m", "part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    plans = [(*pick_thresholds(parts, p, float(n), [max(0.0, exact.get((m, i), 0.0)) for i in range(m)], radius), parts) for m, parts in choices.items()]
    _, thresholds, parts = min(plans, key=lambda x: x[0])
    probes = [masks_within(b, t) if t >= 0 else np.zeros(0, dtype=np.uint64) for b, t in zip(parts, thresholds, strict=True)]
    wholes = [np.uint64(sum(1 << x for x in b)) for b in parts]
    buckets = max(1, -(-n * sum(len(x) for x in probes) // rows_per_bucket))
    kind = nodes.schema["rep"].dataType.simpleString()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                rep, fp = b["rep"].to_numpy()[at : at + 2000], b["fp"].to_numpy()[at : at + 2000].view(np.uint64)
                for k, (whole, flips) in enumerate(zip(wholes, probes, strict=True)):
                    if len(flips):
                        key = (fp & whole)[:, None] ^ flips[None, :]
                        yield pd.DataFrame({"part": np.int8(k), "key": key.ravel().view(np.int64), "fp": np.repeat(fp, len(flips)).view(np.int64), "rep": np.repeat(rep, len(flips)), "probe": np.tile(np.arange(len(flips)) > 0, len(fp))})

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        reps, row = np.unique(b["rep"].to_numpy(), return_inverse=True)
        spot = b["key"].to_numpy().view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ (b["part"].to_numpy().astype(np.uint64) + np.uint64(31) * b["tile"].to_numpy().astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        made = bucket_links(spot, b["fp"].to_numpy().view(np.uint64), b["looks"].to_numpy(), b["found"].to_numpy(), row, len(reps), radius)
        return pd.DataFrame([(reps[x], reps[y]) for x, y in made], columns=["a", "b"])

    rows = nodes.select("rep", "fp").mapInPandas(spread, f"part byte, key long, fp long, rep {kind}, probe boolean")
    # Only keys within reach of one that many nodes have can have hot_key probes or nodes.
    many = hot_key // (4 * max(len(x) for x in probes))
    crowds = []
    for k, (whole, flips) in enumerate(zip(wholes, probes, strict=True)):
        if len(flips):
            full = nodes.groupBy(F.col("fp").bitwiseAND(F.lit(as_long(int(whole)))).alias("key")).count().where(F.col("count") > many)
            crowds.append(full.select(F.lit(k).cast("byte").alias("part"), F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(as_long(int(x)))) for x in flips])).alias("key")))
    crowd = work.save(functools.reduce(DataFrame.unionByName, crowds).distinct(), "crowded_keys")
    if crowd.isEmpty():
        looked = rows.select("rep", "part", "key", "fp", F.lit(0).cast("long").alias("tile"), F.lit(True).alias("looks"), (~F.col("probe")).alias("found"))
        bucket = F.pmod(F.xxhash64("part", "key"), F.lit(buckets))
    else:
        blocks_of = lambda kind: F.ceil(F.count_if(kind) / hot_key).cast("int")
        hot = rows.join(crowd, ["part", "key"], "left_semi").groupBy("part", "key").agg(blocks_of(~F.col("probe")).alias("homes"), blocks_of(F.col("probe")).alias("probes")).where("homes > 1 OR probes > 1")
        looked = tiles(rows.join(work.save(hot, "hot_keys"), ["part", "key"], "left"), ~F.col("probe"), ("part", "key", "fp"))
        bucket = F.when(F.col("tile").isNull(), F.pmod(F.xxhash64("part", "key"), F.lit(buckets))).otherwise(F.xxhash64("part", "key", "tile"))
        looked = looked.withColumn("bucket", bucket).withColumn("tile", F.coalesce("tile", F.lit(0)))
        bucket = F.col("bucket")
    return looked.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(compare, f"a {kind}, b {kind}")


def _components(spark: SparkSession, docs: DataFrame, radius: int, words: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _digest, fp) of each document, and (fp, component_id, _root) of each fingerprint. Fingerprints are the nodes, so that links through rows without an id hold."""
    work = Workspace(spark, "simhash")
    fps = work.save(fingerprints(docs, words, seed, id_col, text_col), "fps")
    nodes = work.save(fps.groupBy("fp").agg(F.min("_id").alias("_least")), "nodes")
    links = work.save(near_links(spark, work, nodes.select(F.col("fp").alias("rep"), "fp"), radius), "links")
    roots = connected_components(work, links)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return fps, named.join(least, "_root").select("fp", "component_id", "_root")


def simhash_groups(spark: SparkSession, docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links of fingerprints
    that differ in at most ``radius`` bits; itself if none.

    Equal fingerprints are one node from the start. Nulls, empty texts and texts without words have fingerprint 0 and
    are linked like any other; texts of fewer words than a shingle are one shingle. Very long texts count with all their shingles.
    Rows with a null id link like others; a component of null ids alone gets a null. Repeated rows return once each. An
    empty table gives an empty result. Other columns are ignored.
    """
    fps, named = _components(spark, docs, radius, words, seed, id_col, text_col)
    return fps.join(named, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id, nulls last, and of these the smallest digest of the text. Rows are told apart by id and text, so
    that an id that names texts of several components keeps one in each that it is the smallest of; rows that repeat both stay or go together."""
    fps, named = _components(spark, docs, radius, words, seed, id_col, text_col)
    rows = fps.join(named, "fp").select("_root", F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_digest").alias("digest")).alias("_key"))
    first = rows.groupBy("_root").agg(F.min("_key").alias("_first"))
    lost = rows.join(first, "_root").where("_key <> _first").select(F.col("_key.id").alias("_copy"), F.col("_key.digest").alias("_copy_digest")).distinct()
    lost = Workspace(spark, "simhash").save(lost, "lost")
    digest = F.md5(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(lost, docs[id_col].eqNullSafe(lost["_copy"]) & (digest == lost["_copy_digest"]), "left_anti")
