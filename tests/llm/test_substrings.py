"""op2 and op7 against brute force over every window."""

import hashlib
import random
import tempfile
import uuid
from pathlib import Path

import pytest

from tessera.llm import phrases, suffixes
from tessera.llm.common import read
from tessera.llm.queries import QUERIES

from .cases import documents, odd_rows, words_of

SF = "/root/testdata/sf0.001"
LAST = 1 << 63


def removed(tokens, width, within):
    """rows: lists of tokens by position in order of (id, start); which tokens go."""
    first = {}
    for key, ts in tokens:
        for i in range(len(ts) - width + 1):
            w, at = tuple(ts[i : i + width]), (LAST if key is None else key, i)
            first[w] = min(first.get(w, at), at)
    out = []
    for key, ts in tokens:
        gone = [False] * len(ts)
        for i in range(len(ts) - width + 1):
            f, at = first[tuple(ts[i : i + width])], (LAST if key is None else key, i)
            if f[0] < at[0] or within and f < at:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def phrase_rows(rows, width):
    tokens = [(i, words_of(t)) for i, t in rows]
    return sorted(((i, len(ws), sum(g), b" ".join(w for w, x in zip(ws, g, strict=True) if not x).decode()) for (i, ws), g in zip(tokens, removed(tokens, width, False), strict=True)), key=repr)


def byte_rows(rows, width):
    tokens = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, b), g in zip(tokens, removed(tokens, width, True), strict=True):
        spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        out.append((i, len(b), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(b, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "gram"), [(13, 6), (4, 2)])
def test_phrases(spark, width, gram):
    rows = odd_rows(width)
    got = phrases.remove_phrases(spark, documents(spark, rows), width, gram, shard_bytes=5000, crowd_bytes=5000)
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=repr)
    assert found == phrase_rows([(i, t) for i, t, _ in rows], width)


@pytest.mark.parametrize(("width", "gram", "length"), [(100, 40, 25), (12, 6, 25), (37, 16, 4)])
def test_substrings(spark, width, gram, length):
    rows = odd_rows(width)
    got = suffixes.remove_substrings(spark, documents(spark, rows), width, gram, length, crowd_bytes=5000)
    found = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()), key=repr)
    assert found == byte_rows([(i, t) for i, t, _ in rows], width)


def test_dense_repetition(spark):
    """Runs of one token, periodic texts and overlapping matches."""
    rng = random.Random(5)
    texts = ["ab" * 200, "a" * 300, "ba" * 150 + "c" * 250, "".join(rng.choice("ab") for _ in range(400)), "a" * 99, "a" * 100, "z" + "a" * 120]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = suffixes.remove_substrings(spark, documents(spark, rows), crowd_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == byte_rows([(i, t) for i, t, _ in rows], 100)
    spaced = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    got = phrases.remove_phrases(spark, documents(spark, spaced), shard_bytes=1000, crowd_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == phrase_rows([(i, t) for i, t, _ in spaced], 13)


def test_one_token_over_and_over(spark):
    """Texts of one letter or word have a segment at every place; they are handed over in slices."""
    docs = spark.createDataFrame([(1, "a" * 150_000), (2, "a" * 120_000 + "b"), (3, "w " * 60_000), (4, "w " * 60_000)], "doc_id long, text string")
    got = {r[0]: (r.n_bytes - len(r.kept), r.n_spans) for r in suffixes.remove_substrings(spark, docs).collect()}
    assert got == {1: (149_999, 1), 2: (120_000, 1), 3: (119_998, 1), 4: (120_000, 1)}
    got = {r[0]: (r.n_words, r.n_removed) for r in phrases.remove_phrases(spark, docs).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (60_000, 0), 4: (60_000, 60_000)}


def test_empty(spark):
    docs = documents(spark, odd_rows()).limit(0)
    assert phrases.remove_phrases(spark, docs).count() == 0 and suffixes.remove_substrings(spark, docs).count() == 0


def test_queries_on_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    got = QUERIES["op2_repeated_phrases"](spark, SF).collect()
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in phrase_rows(rows, 13)]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    got = QUERIES["op7_suffix_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(byte_rows(rows, 100))


def test_repeated_and_null_ids_with_different_texts(spark):
    """An id, null among them, may name several texts: none loses a row, gains one, or loses what only another one repeats."""
    rng = random.Random(3)
    shared = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(3)]
    own = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randint(0, 25)))
    rows = [(i, f"{own()} {rng.choice(shared)} {own()}", "s") for i in (5, 5, 5, 7, 7, 9, None, None, None, None)]
    rows += [rows[0], rows[6], (7, rows[0][1], "s"), (None, rows[3][1], "s"), (5, shared[0], "s"), (None, "short", "s"), (None, "other", "s"), (7, "", "s"), (7, None, "s")]
    pairs = [(i, t) for i, t, _ in rows]
    got = phrases.remove_phrases(spark, documents(spark, rows), shard_bytes=1000, crowd_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == phrase_rows(pairs, 13)
    got = suffixes.remove_substrings(spark, documents(spark, rows), crowd_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == byte_rows(pairs, 100)


def test_crowded_anchor(spark, monkeypatch):
    """A passage amid differing neighbours in every text, under one anchor: no shard gets much more than shard_bytes, and the result is the same."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(16))
    texts = [f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(14))} {passage} {' '.join(f'z{rng.randrange(10**6)}' for _ in range(14))}" for _ in range(150)]
    rows = [(i if i % 10 else None, t + (" " + passage if i % 7 == 0 else ""), "s") for i, t in enumerate(texts)]
    pairs = [(i, t) for i, t, _ in rows]
    sizes = tempfile.mkdtemp(prefix="spark-")

    def noted(contents, *rest):
        with open(f"{sizes}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(sum(map(len, contents))))
        return plain(contents, *rest)

    plain = phrases.recurring_passages
    monkeypatch.setattr(phrases, "recurring_passages", noted)
    got = phrases.remove_phrases(spark, documents(spark, rows), shard_bytes=1000, crowd_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == phrase_rows(pairs, 13)
    got = suffixes.remove_substrings(spark, documents(spark, rows), width=40, gram=16, crowd_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == byte_rows(pairs, 40)
    assert max([int(p.read_text()) for p in Path(sizes).iterdir()], default=0) <= 5000


def test_full_shard_is_split(spark):
    """One shard whose stretches go to several tasks, each with its automaton."""
    rows = odd_rows(7)
    got = phrases.remove_phrases(spark, documents(spark, rows), 4, 2, shard_bytes=10**9, stream_bytes=500)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=repr) == phrase_rows([(i, t) for i, t, _ in rows], 4)


def test_ranks_over_batches(spark):
    """Runs of equal pairs that end at, span and start at the edges of small Arrow batches."""
    from tessera.llm.suffixes import later_places, reranked

    rng, size = random.Random(2), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(rng.randrange(12), rng.randrange(3), s, rng.randrange(40)) for s in range(400)] + [(1000 + s, 0, s, 99) for s in range(40)]
    pairs = spark.createDataFrame(rows, "a long, b long, sid long, i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        ranks = {(r.sid, r.i): r["rank"] for r in reranked(pairs).collect()}
        late = {(r.sid, r.i): (r.o, r.s) for r in later_places(pairs.selectExpr("*", "sid % 50 AS owner", "CAST(i AS LONG) AS place")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    groups = {}
    for a, b, sid, i in rows:
        groups.setdefault((a, b), []).append((sid % 50, i, sid))
    assert set(ranks) == {(s, i) for g in groups.values() if len(g) > 1 for _, i, s in g}
    assert len({frozenset(ranks[s, i] for _, i, s in g) for g in groups.values() if len(g) > 1}) == len(set(ranks.values())) == sum(len(g) > 1 for g in groups.values())
    for g in groups.values():
        g.sort()
        assert len([x for x in g if (x[2], x[1]) not in late]) == 1
        assert all(late[s, i] == g[0][:2] for _, i, s in g if (s, i) in late)
