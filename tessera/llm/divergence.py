"""How far the word use of each source lies from that of others of its language: row-wise sparse products over a term-major index."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

#: A term in lower-cased UTF-8: a run of ASCII letters and bytes of other characters.
TERM, BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Texts are searched in stretches of about so many bytes, which end between terms.
STRETCH = 1 << 20
#: Counts that a task holds before it hands them on.
HELD = 200_000
#: Shares are whole parts of this; each count is raised by this many.
PARTS, RAISED = 1_000_000_000, 5


def stretches(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            gap = BREAK.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def count_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, term, n, docs), combined over as many documents as HELD allows."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def handed() -> pd.DataFrame:
        rows = [(lang, source, t.decode("utf-8", "replace"), n, d) for (lang, source), terms in held.items() for t, (n, d) in terms.items()]
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    for frame in frames:
        for lang, source, text in zip(frame["lang"], frame["source"], frame["text"], strict=True):
            terms, seen = held.setdefault((lang, source), {}), set()
            for piece in stretches(bytes(text).lower()):
                for term in TERM.findall(piece):
                    found = terms.get(term)
                    if found is None:
                        terms[term] = found = [0, 0]
                        size += 1
                    found[0] += 1
                    if term not in seen:
                        seen.add(term)
                        found[1] += 1
            if size >= HELD:
                yield handed()
                held, size = {}, 0
    yield handed()


def share(count: Column) -> Column:
    """1 + floor(PARTS * (count + RAISED) / (N + RAISED * V)) with N and V from the columns mass and terms, exact."""
    top = F.lit(PARTS).cast("decimal(10,0)") * (count + RAISED).cast("decimal(20,0)")
    return F.when(F.col("terms") > 0, F.call_function("div", top, (F.col("mass") + F.lit(RAISED) * F.col("terms")).cast("decimal(20,0)")) + 1).otherwise(F.lit(0)).cast("long")


def accumulate(index: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
    """Adds up, for the groups of a tile over a block of terms, what sets them apart from each peer: (lang, g, h, part).

    peers: (g, zero, mine), all groups of the language; zero is a term's share where its count is 0, mine says whether the group is of the tile. index: (term, g, p),
    the block's terms by group. A row starts dense: what its terms differ by from each peer's zero. Each of its terms then goes through the term-major index, where it adds for
    the peers that have it the difference to the true value of that pair. Terms of peers only, and of neither, are in the pair's other row and in the lower one.
    """
    peers = peers.sort_values("g")
    zero, mine = peers["zero"].to_numpy(np.int64), np.flatnonzero(peers["mine"].to_numpy())
    n, block = len(zero), index["term"].nunique()
    code, _ = pd.factorize(index["term"], sort=False)
    order = np.lexsort((index["g"].to_numpy(), code))  # term-major
    code, peer, p = code[order], index["g"].to_numpy(np.int64)[order], index["p"].to_numpy(np.int64)[order]
    start = np.searchsorted(code, np.arange(block + 1))
    by_group = np.argsort(peer, kind="stable")  # group-major: places in the index
    edges, own = np.searchsorted(peer[by_group], np.arange(n + 1)), np.bincount(peer, minlength=n)
    out = np.zeros((len(mine), n), dtype=np.int64)
    for row, g in zip(out, mine, strict=True):
        places = by_group[edges[g] : edges[g + 1]]
        values = np.sort(p[places])
        sums = np.concatenate([[0], np.cumsum(values)])
        below = np.searchsorted(values, zero)
        row += zero * below - sums[below] + (sums[-1] - sums[below]) - zero * (len(values) - below)
        base = np.abs(zero - zero[g])
        row[g + 1 :] += ((block - own[g] - own) * base)[g + 1 :]
        first, last = start[code[places]], start[code[places] + 1]
        # The places of one group's terms are worked off in parts, so that the postings at hand stay few.
        ends = np.cumsum(last - first)
        cuts = np.unique(np.searchsorted(ends, np.arange(1, (ends[-1] if len(ends) else 0) // STRETCH + 2) * STRETCH, side="right"))
        for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
            size = last[a:b] - first[a:b]
            if not size.sum():
                continue
            at = np.repeat(first[a:b] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            h, own_p = peer[at], np.repeat(p[places[a:b]], size)
            later = h > g
            h, own_p, other = h[later], own_p[later], p[at[later]]
            np.add.at(row, h, np.abs(own_p - other) - np.abs(own_p - zero[h]) - np.abs(zero[g] - other) + base[h])
    lang = peers["lang"].iloc[0] if n else ""
    g, h = np.repeat(mine, n), np.tile(np.arange(n), len(mine))
    return pd.DataFrame({"lang": lang, "g": g, "h": h, "part": out.reshape(-1)})[g != h]


def audit_sources(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top_terms: int = 50, postings: int = 2_000_000, cells: int = 4_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) its distance to the other sources of the language, and its most telling terms.

    Each language keeps the terms in at least ``least_docs`` of its documents. A term's share is p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), N being the group's count over kept terms and V
    their number; all arithmetic is exact. Part ``pair``: item is another source of the language, value the sum over kept terms of the shares' differences, all ranks. Part ``term``: item is a term of the
    group whose share lies above the language's, value the difference, the first ``top_terms``. Ranks go by value, then by the item's UTF-8 bytes.

    Counts are combined in the tasks before they travel. The term-major index (a term with its postings, one per source) is dealt into blocks of about
    ``postings`` postings, and a group's dense row over all peers is filled within a block; no pair of postings leaves it. Tiles of groups keep the rows of a task within ``cells``. Spark adds the
    blocks up. Peers, one row a source, are repeated per block and tile; the result itself has a row for each pair of sources.

    Null text, language and source count as empty. A document is a row; repeated rows count one each. Groups and languages without terms have pairs of value 0. Very long texts are
    counted in stretches. Terms are compared as UTF-8. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    work = Workspace(spark, "divergence")
    rows = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInPandas(count_terms, "lang string, source string, term string, n long, docs long")
    counted = work.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings")).where(F.col("docs") >= least_docs)
    index = work.save(kept.select("lang", "term", "total", "postings"), "index")
    flat = index.select("lang", "term", "total", F.inline("postings"))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("mass_all"), F.sum(F.size("postings")).alias("_postings"))
    sizes = flat.groupBy("lang", "source").agg(F.sum("n").alias("mass"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["mass", "terms", "mass_all", "_postings"])
    numbered = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    blocks, tiles = F.greatest(F.lit(1), F.ceil(F.col("_postings") / postings)).cast("int"), F.ceil(F.col("_groups") * F.col("_groups") / cells).cast("int")
    groups = work.save(numbered.select("lang", "source", "mass", "terms", "mass_all", "g", share(F.lit(0)).alias("zero"), blocks.alias("_blocks"), tiles.alias("_tiles")), "groups")

    shares = flat.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n")))
    shares = work.save(shares.select("lang", "source", "term", "g", "p", "total", "terms", "mass_all", "_blocks", "_tiles"), "shares")
    each_tile = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_tile")
    dealt = shares.select("lang", "term", F.col("g").cast("long").alias("g"), "p", F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int").alias("_block"), each_tile)
    tile = F.pmod("g", F.col("_tiles"))
    peers = groups.select("lang", F.col("g").cast("long").alias("g"), "zero", tile.alias("_own"), "_blocks", each_tile)
    peers = peers.select("lang", "g", "zero", (F.col("_own") == F.col("_tile")).alias("mine"), "_tile", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    keys = ["lang", "_block", "_tile"]
    parts = dealt.groupBy(*keys).cogroup(peers.groupBy(*keys)).applyInPandas(accumulate, "lang string, g long, h long, part long")
    parts = work.save(parts, "parts")
    both = parts.unionByName(parts.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "part")).groupBy("lang", "g", "h").agg(F.sum("part").alias("value"))
    names = groups.select("lang", "g", "source")
    pairs = both.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(_order("value", "item")).alias("rank"))
    telling = shares.withColumn("mass", F.col("mass_all")).withColumn("value", F.col("p") - share(F.col("total"))).where("value > 0")
    telling = telling.select("lang", "source", F.col("term").alias("item"), "value", F.row_number().over(_order("value", "term")).alias("rank")).where(F.col("rank") <= top_terms)
    return pairs.unionByName(telling.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _order(value: str, item: str):
    return Window.partitionBy("lang", "source").orderBy(F.desc(value), item)
