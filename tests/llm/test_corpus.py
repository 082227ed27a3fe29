"""op6, op10 and the pipeline: targets, round trips and a brute-force run of all stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing, packing, toxicity
from tessera.llm.common import read
from tessera.llm.queries import QUERIES, tokenizer_path

from .cases import documents, odd_rows, words_of
from .test_near import plain_fingerprint, roots

SF = "/root/testdata/sf0.001"


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """sizes: by source, in order. Caps at most times the size; what is above is shared again by weight."""
    left, out, free = float(sum(sizes)), [None] * len(sizes), set(range(len(sizes)))
    while free:
        w = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if left * weights[i % len(weights)] / w > most * sizes[i]]
        for i in over or list(free):
            out[i] = most * sizes[i] if over else left * weights[i % len(weights)] / w
        left -= sum(out[i] for i in over)
        free -= set(over) or set(free)
    return out


def checked_mix(rows, got):
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += len(words_of(t))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    want = dict(zip(order, targets([by[s] for s in order]), strict=True))
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, len(words_of(t))) for i, t, _ in rows), key=repr)
    taken = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]), (s, taken[s], want[s])


def test_mix(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(900, "lone words of a small source", "z"), (901, "ä b", "é"), (902, None, "only nulls")]
    first = mixing.mix(spark, documents(spark, rows))[2].drop("_row").collect()
    checked_mix(rows, first)
    again = mixing.mix(spark, documents(spark, rows, 7))[2].drop("_row").collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr)
    slots = mixing.mix(spark, documents(spark, rows))[0]
    total = slots.count()
    assert slots.select("_shard", "_place").distinct().count() == total
    assert mixing.mix(spark, documents(spark, rows).limit(0))[2].count() == 0
    assert mixing.mix(spark, documents(spark, odd_rows()))[2].count() == len(odd_rows())


def test_permutation(spark):
    F = mixing.F
    for n in (1, 2, 3, 5, 97, 1000, 65537):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    steps = np.diff(got) % n
    assert len(set(steps.tolist())) > n // 2  # no arithmetic progression


def test_shard_counts_are_multinomial(spark):
    """Counts of a source of share p over shards of m slots have variance m p (1 - p), not that of an even spread; and sums are exact."""
    F, m = mixing.F, 256
    work = mixing.Workspace(spark, "t")
    share = [100_000, 50_000, 10_000, 0, 44_800]
    ends = np.cumsum(share).tolist()
    sources = spark.createDataFrame([(i, n, e - n, e) for i, (n, e) in enumerate(zip(share, ends, strict=True))], "_s long, _slots long, _from long, _to long")
    slots = mixing.drawn_slots(work, sources, ends[-1], m, 5)
    assert {r._s: (r.n, r.d, r.top) for r in slots.groupBy("_s").agg(F.count("*").alias("n"), F.count_distinct("_nth").alias("d"), F.max("_nth").alias("top")).collect()} == {i: (n, n, n - 1) for i, n in enumerate(share) if n}
    assert slots.select("_shard", "_place").distinct().count() == ends[-1]
    counts = {(r._shard, r._s): r["count"] for r in slots.groupBy("_shard", "_s").count().collect()}
    shards = ends[-1] // m
    for s in (0, 1, 4):
        p = share[s] / ends[-1]
        seen = np.array([counts.get((j, s), 0) for j in range(shards)])
        assert abs(seen.mean() - m * p) < 1 and 0.8 < seen.var() / (m * p * (1 - p)) < 1.25


def test_blocks_hold_the_words(spark):
    """Shards made of blocks: every word comes from its source, as often as the documents' counts say."""
    rows = [(i, " ".join(f"{s}{i}w{k}" for k in range(5 + i)), s) for i, s in enumerate("aabbbcca")]
    docs = documents(spark, rows)
    blocks = mixing.mixed_blocks(spark, docs, block_words=4).collect()
    taken = {r.doc_id: r.taken for r in mixing.mix(spark, docs, block_words=4)[2].collect()}
    counts = defaultdict(int)
    for b in blocks:
        for w in b.text.split():
            counts[int(w[1 : w.index("w")])] += 1
    assert dict(counts) == {i: n for i, n in taken.items() if n} and len({(b._shard, b._place) for b in blocks}) == len(blocks)


def test_rows_of_null_and_repeated_ids_are_mixed(spark):
    rows = [(None, "x " * 50, "a"), (None, "y " * 40, "b"), (1, "z " * 30, "b"), (1, "v " * 30, "b"), (2, "", "a"), (3, None, None)]
    got = mixing.mixed_documents(spark, documents(spark, rows))
    assert got.columns == documents(spark, rows).columns
    found = {r.text[0] for r in got.collect()}
    assert {"x", "y"} & found and found <= set("xyzv")


def test_mix_query(spark):
    rows = [(r.doc_id, r.text, r.source) for r in read(spark, SF, "documents").collect()]
    checked_mix(rows, QUERIES["op6_mix_sources"](spark, SF).collect())


def checked_packing(rows, got, size=2048):
    """Every piece holds the ids it should, sequences are gapless, and there are hardly more than must be."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, n, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes())) for n, at in enumerate(range(0, len(ids), size))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    return len(by), -(-sum(r.length for r in got) // size)


def test_packing(spark):
    rows = odd_rows() + [(700, "don't  stop now x İstanbul ǅ é 🙂🙂 1234567 a.b,c! _x_ <|endoftext|>\r\n\x0b\x0c ", "a"), (701, "word " * 9000, "a")]
    got = packing.pack_documents(documents(spark, rows), tokenizer_path()).collect()
    n, least = checked_packing([(i, t) for i, t, _ in rows], got)
    assert n <= least + 2
    small = packing.pack_documents(documents(spark, rows), tokenizer_path(), size=64, shard_pieces=20).collect()
    checked_packing([(i, t) for i, t, _ in rows], small, 64)
    assert packing.pack_documents(documents(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    n, least = checked_packing(rows, QUERIES["op10_pack_sequences"](spark, SF).collect())
    assert n <= 1.02 * least + 1


def test_sum_of_squares_is_the_rule():
    """Each placement against trying all gaps."""
    rng = np.random.default_rng(1)
    lengths, size = np.sort(rng.integers(1, 40, 120))[::-1].copy(), 40
    bins, offsets = packing.sum_of_squares(lengths, size)
    fill: dict[int, int] = {}
    for x, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        gaps = [size - f for f in fill.values() if f < size]

        def squares(gap, x=x, gaps=gaps):
            after = list(gaps)
            after.remove(gap)
            after += [gap - x] * (gap > x)
            return sum(after.count(g) ** 2 for g in set(after))

        fitting = {g for g in gaps if g >= x}
        if fitting:
            assert squares(size - o) == min(map(squares, fitting)) and fill[b] == o
        else:
            assert b not in fill and o == 0
        fill[b] = o + x


def test_pipeline(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rejected = {r.doc_id for r in toxicity.score_documents(docs, labels, lambda key: ~toxicity.held_out(key)).collect() if r.predicted}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id not in rejected]
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(rejected & clean) <= 0.02 * len(clean)  # eleven toxic labels teach little; test_texts holds accuracy on more
    last = {}
    for i, t, s in rows:
        key = (t or "").encode().lower()
        last[key] = max(last.get(key, (i, t, s)), (i, t, s), key=lambda r: r[0])
    rows = sorted(last.values())
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    comps = roots([r[0] for r in rows], lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4)
    rows = [r for r, c in zip(rows, comps, strict=True) if r[0] == c]

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    kept = docs
    for name in list(stages)[:3]:
        kept = stages[name](spark, kept, SF)
        assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.source) for r in kept.collect()) == rows
    mixed = stages["mixing"](spark, kept, SF).collect()
    ids = {i for i, _, _ in rows}
    copies = defaultdict(int)
    for r in mixed:
        copies[r.doc_id] += 1
    assert set(copies) <= ids and max(copies.values()) <= 3
    result = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in result} == set(copies)
    checked_packing([(r.doc_id, r.text) for r in mixed], result)


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    """Toxic texts go whatever their id; a clean text stays that shares an id with one, or has none. No stage loses a text that nothing else holds."""
    rng = random.Random(2)
    bad = ["you filthy scumbag", "total scumbag filth", "scumbag and filthy liar"]
    labelled = [(i, f"{rng.choice(bad)} {i} {rng.choice(bad)}" if i % 2 else f"a calm walk by river number {i} in spring", "a") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    rows = [*labelled, (500, "clean words about gardens", "a"), (500, bad[0] + " " + bad[1], "a"), (None, bad[2] + " " + bad[0], "b"), (None, "calm unlabelled text of nobody", "b"), (None, None, None)]
    left = {(r.doc_id, r.text) for r in toxicity.drop_toxic(spark, documents(spark, rows), labels).collect()}
    assert {(500, "clean words about gardens"), (None, "calm unlabelled text of nobody"), (None, None)} <= left
    assert not any("scumbag" in (t or "") for i, t in left if i is None or i >= 500)
    odd = documents(spark, odd_rows())
    unique = {(t or "").encode().lower() for _, t, _ in odd_rows()}
    once = corpus_pipeline.STAGES[1][1](spark, odd, SF)
    assert sorted((r.text or "").encode().lower() for r in once.collect()) == sorted(unique) and once.columns == odd.columns
    near = corpus_pipeline.STAGES[2][1](spark, once, SF)
    mixed = corpus_pipeline.STAGES[3][1](spark, near, SF)
    assert near.columns == odd.columns and mixed.columns == odd.columns and set(mixed.select("doc_id", "text").collect()) <= set(near.select("doc_id", "text").collect())
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() <= mixed.select("doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_words_with_marks_are_encoded_once(monkeypatch):
    """Ids are those of the tokenizer for whole texts, also when caches start again; a core is encoded once, whatever its case and last marks."""
    from tokenizers import Tokenizer

    known, whole = packing.WordIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["Stone stone!!! STONE&&& stone*** stone, \u00c9t\u00e9$$$ \u00e9t\u00e9", "it's don't 'quoted' a.b&&& 12!! \u0130x, \u043c\u0438\u0440... x<|endoftext|>", "", "&&& ,", "stone. caf\u00e9\u0301"]
    plain = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    asked, encode = [], known._encode
    known._encode = lambda tokenizer, words: asked.extend(words) or encode(tokenizer, words)
    assert known.of([t.encode() for t in texts]) == plain
    assert [w for w in asked if w.lower().startswith(b"stone")] == [b"stone"]
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    monkeypatch.setattr(packing, "CACHE_CORES", 2)
    for _ in range(3):
        assert [known.of([t.encode()])[0] for t in texts] == plain


def test_a_worker_keeps_what_one_operator_needs():
    """In a chain of operators the word caches of packing and toxicity don't add up in a worker."""
    packing.ids_of([b"some words"], tokenizer_path())
    assert packing._tokenizers
    for text in toxicity._own_words(iter(["other words"])):
        assert not packing._tokenizers
        toxicity.fold(text)
        assert toxicity._words
    assert not toxicity._words
