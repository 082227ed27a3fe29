"""op9 and op5 against brute force over all pairs."""

import math
import random

import numpy as np
import xxhash

from tessera.llm import lattice, simhash
from tessera.llm.common import Workspace, read
from tessera.llm.components import connected_components
from tessera.llm.queries import QUERIES

from .cases import CLASHING, documents, odd_rows, words_of

SF = "/root/testdata/sf0.001"


def roots(nodes, near):
    """Smallest reachable node of each, nulls last."""
    left, out = set(range(len(nodes))), {}
    order = sorted(left, key=lambda i: math.inf if nodes[i] is None else nodes[i])
    for i in order:
        if i in left:
            todo = [i]
            left.discard(i)
            while todo:
                x = todo.pop()
                out[x] = nodes[i]
                found = [y for y in left if near(x, y)]
                left.difference_update(found)
                todo += found
    return [out[i] for i in range(len(nodes))]


def plain_fingerprint(text):
    ws = [w.lower() for w in words_of(text)]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = roots([i for i, _ in rows], lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4)
    return sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps, strict=True)), key=repr)


def test_simhash(spark):
    rows = odd_rows()
    long = " ".join(f"w{i}" for i in range(900))
    rows += [(200 + k, long.replace(f"w{k * 90} ", "changed "), "a") for k in range(8)]
    got = simhash.simhash_groups(spark, documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == expected([(i, t) for i, t, _ in rows])


def test_hot_keys_are_tiled(spark):
    """Many near fingerprints under one key: tiles give the components of all pairs, and no group gets all of them."""
    rng = np.random.default_rng(4)
    base = [int(rng.integers(0, 2**63)) for _ in range(3)]
    fps = {base[int(rng.integers(0, 3))] ^ (1 << int(rng.integers(0, 16))) ^ (1 << int(rng.integers(0, 63))) for _ in range(900)} | {int(x) for x in rng.integers(0, 2**63, 300)}
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "rep long, fp long")
    links = simhash.near_links(spark, simhash.Workspace(spark, "t"), nodes, hot_key=50, rows_per_bucket=500).collect()
    values = sorted(fps)
    assert all((values[r.a] ^ values[r.b]).bit_count() <= 4 for r in links)

    def components(pairs):
        up = list(range(len(values)))

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        return [root(x) for x in range(len(values))]

    every = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4]
    got, want = components([(r.a, r.b) for r in links]), components(every)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_simhash_queries(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op9_simhash_near_dedup"](spark, SF).collect()), key=repr) == expected(rows)
    assert simhash.simhash_groups(spark, documents(spark, odd_rows()).limit(0)).count() == 0


def test_every_near_fingerprint_is_found(spark):
    """Random fingerprints, each with neighbours at all distances up to the radius and one beyond, skewed bits among them."""
    rng = random.Random(9)
    fps = set()
    for _ in range(150):
        base = rng.getrandbits(64) & rng.getrandbits(64) if rng.random() < 0.5 else rng.getrandbits(64)
        for d in range(6):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps = sorted(fps)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    work = Workspace(spark, "t")
    nodes = work.save(spark.createDataFrame(signed, "rep long, fp long"), "nodes")
    for parts in (2, 5):
        links = simhash.near_links(spark, work, nodes, 4, rows_per_bucket=3000, most_parts=parts)
        found = dict(connected_components(work, work.save(links, f"l{parts}"), f"c{parts}").collect())
        assert [found.get(i, i) for i in range(len(fps))] == roots(list(range(len(fps))), lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4)


def vectors(spark, rows):
    clash = tuple("x" for _ in CLASHING.split(", "))
    return spark.createDataFrame([(*r, *clash) for r in rows], f"vec_id long, embedding array<float>, {CLASHING}").repartition(3)


def cosine_rows(rows):
    """(id, links, component) by all pairs in double precision."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if k else None for (_, v), k in zip(rows, ok, strict=True)]

    def near(x, y):
        return ok[x] and ok[y] and len(unit[x]) == len(unit[y]) and float((unit[x] * unit[y]).sum()) >= 0.95

    links = [sum(near(x, y) for y in range(len(rows)) if x != y) for x in range(len(rows))]
    return [(i, n, c) for (i, _), n, c in zip(rows, links, roots([i for i, _ in rows], near), strict=True)]


def test_lattice_edges(spark):
    rng = np.random.default_rng(2)
    f32 = lambda v: [float(x) for x in np.asarray(v, dtype=np.float32)]
    base = rng.standard_normal((12, 64))
    rows = [(i, f32(base[i % 12] + rng.standard_normal(64) * 0.02)) for i in range(60)]
    rows += [(100, f32(base[0])), (101, f32(base[0])), (102, f32(3 * base[0])), (103, f32(-base[0])), (100, f32(base[0]))]
    rows += [(200, None), (201, []), (202, [0.0] * 64), (203, [math.nan] + [1.0] * 63), (204, [math.inf] + [1.0] * 63), (205, [None] + [1.0] * 63), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (None, f32(base[1]))]
    got = lattice.embedding_groups(spark, vectors(spark, rows), hot_cell=5).collect()
    want = cosine_rows(rows)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert lattice.embedding_groups(spark, vectors(spark, rows).limit(0)).count() == 0


def test_lattice_recall(spark):
    """Pairs right at the threshold are the hardest."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i, v in enumerate(base):
        other = rng.standard_normal(64)
        other -= (other @ v) * v
        other /= np.linalg.norm(other)
        c = 0.951 if i % 2 else 0.97
        rows += [(2 * i, [float(x) for x in v.astype(np.float32)]), (2 * i + 1, [float(x) for x in (c * v + math.sqrt(1 - c * c) * other).astype(np.float32)])]
    got = {r.vec_id: r.n_links for r in lattice.embedding_groups(spark, vectors(spark, rows)).collect()}
    want = {i: n for i, n, _ in cosine_rows(rows)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.95 * sum(want.values())


def test_lattice_recall_at_any_size():
    """The tables planned for a thousand to 10^11 vectors let pairs just above the threshold meet; other pairs than those planned with."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in (10**3, 10**9, 10**11):
        scale, tables, probes = lattice.plan_tables(n, 64, 0.95, 0.99, 11)
        a, b = (lattice.cells(v, tables, probes, scale, 11) for v in (x, y))
        meet = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any(axis=(1, 2))
        assert meet.mean() >= 0.95, (n, scale, tables, probes)


def test_lattice_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in read(spark, SF, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op5_lattice_near_dedup"](spark, SF).collect()}
    want = {i: (n, c) for i, n, c in cosine_rows(rows)}
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_hot_cells_are_tiled(spark):
    """Neither a crowded cell nor one with many probes and few vectors gives a group of more than two blocks; links stay the same."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((3, 64))
    rows = [(i, [float(x) for x in (base[max(0, i - 297)] + rng.standard_normal(64) * 0.05).astype(np.float32)]) for i in range(300)]
    want = sorted(cosine_rows(rows))
    got = {h: sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.embedding_groups(spark, vectors(spark, rows), hot_cell=h).collect()) for h in (60, 1000)}
    assert got[60] == got[1000]
    assert sum(n for _, n, _ in got[60]) >= 0.98 * sum(n for _, n, _ in want)
    entries = spark.createDataFrame([(i, 5, int(i >= 100)) for i in range(300)], "rep long, cell long, place int")
    for homes, probes in ((5, 10), (1, 10), (5, 0)):
        part = entries.where(f"place = 0 AND rep < {homes * 20} OR place = 1 AND rep < {100 + probes * 20}")
        found = lattice.tiles(part.selectExpr("*", f"{homes} AS homes", f"{probes} AS probes"), lattice.F.col("place") == 0, ("cell", "place")).collect()
        pairs = []
        for t in {r.tile for r in found}:
            mine = [r for r in found if r.tile == t]
            assert len(mine) <= 2 * 40
            pairs += [tuple(sorted((a.rep, b.rep))) for a in mine if a.looks for b in mine if b.found and a.rep != b.rep and (not a.found or a.rep < b.rep)]
        n, m = homes * 20, probes * 20
        assert len(pairs) == len(set(pairs)) == n * (n - 1) // 2 + n * m


def test_links_through_rows_without_an_id(spark):
    """Fingerprints near a null id's, in a chain: all have one component, and the stage keeps one row of it, and every text that no other is near."""
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    chain = [" ".join(words)]
    while len(chain) < 9:
        words[rng.randrange(400)] = f"w{rng.randint(0, 10**6)}"
        chain.append(" ".join(words))
    fps = [plain_fingerprint(t) for t in chain]
    rows = [(None if k % 2 else 10 + k, t, "a") for k, t in enumerate(chain)] + [(10, "quite another text of its own", "a"), (12, "and a third one, unlike the others", "b"), (None, "nobody has this text", "a"), (None, "", "a"), (None, None, "a")]
    nodes = [plain_fingerprint(t) for _, t, _ in rows]
    groups = roots(list(range(len(rows))), lambda x, y: (nodes[x] ^ nodes[y]).bit_count() <= 4)
    least = {g: min((rows[i][0] for i, h in enumerate(groups) if h == g and rows[i][0] is not None), default=None) for g in set(groups)}
    got = simhash.simhash_groups(spark, documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, f"{f:016x}", least[g]) for (i, _, _), f, g in zip(rows, nodes, groups, strict=True)), key=repr)
    assert len(set(groups[: len(chain)])) < len(chain) and len(fps) == 9
    left = simhash.drop_near_copies(spark, documents(spark, rows)).collect()
    kept = {(r.doc_id, r.text) for r in left}
    assert {(10, "quite another text of its own"), (12, "and a third one, unlike the others"), (None, "nobody has this text")} <= kept
    fp = lambda t: nodes[[x for _, x, _ in rows].index(t)]
    for g in set(groups):
        mine = {nodes[i] for i, h in enumerate(groups) if h == g}
        assert len({(i, t or "") for i, t in kept if fp(t) in mine}) == 1
        assert all(i == least[g] for i, t in kept if fp(t) in mine)
