"""The text index against brute force, and the search cases of the data model."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.english import lexemes, stem
from tessera.operators.textindex import TextIndex, cover_rank, extent_similarity, headline, parse, trigrams

STEMS = {
    "caresses": "caress", "flies": "fli", "dies": "die", "mules": "mule", "denied": "deni", "agreed": "agre", "owned": "own", "humbled": "humbl", "sized": "size", "meeting": "meet", "stating": "state",
    "siezing": "siez", "itemization": "item", "sensational": "sensat", "traditional": "tradit", "reference": "refer", "colonizer": "colon", "plotted": "plot", "generously": "generous", "communism": "communism",
    "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi", "enjoy": "enjoy", "cry": "cri", "by": "by", "say": "say", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
    "skies": "sky", "dying": "die", "news": "news", "proceed": "proceed", "exceeding": "exceed", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "knightly": "knight", "luxuriated": "luxuri", "electrical": "electr",
    "hopefulness": "hope", "goodness": "good", "formative": "format", "adjustment": "adjust", "adoption": "adopt", "activate": "activ", "effective": "effect", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll", "consistently": "consist",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS
    assert stem("größe") == "größe" and lexemes("The quick foxes") == [("quick", 2), ("fox", 3)]


def test_queries():
    word = lambda t: ((t, 0),)
    assert parse("big cats OR dog").ways == (((word("big"), word("cat")), ()), ((word("dog"),), ()))
    assert parse('"cat in hats" -"red dog" -blue').ways == (((((("cat", 0), ("hat", 2)),)), ((("red", 0), ("dog", 1)), word("blue"))),)
    assert parse("the of").ways == () and parse("").ways == ()


def plain_rank(query, tokens):
    """Covers by trying every stretch. tokens: stem or empty, by place from 1."""
    n = len(tokens)

    def holds(lo, hi):
        def has(phrase):
            return any(all(lo <= p + d <= hi and tokens[p + d - 1] == t for t, d in phrase) for p in range(lo, hi + 1))

        return any(all(has(p) for p in yes) for yes, _ in alive if yes)

    at = range(1, n + 1)
    whole = lambda phrase: any(all(p + d <= n and tokens[p + d - 1] == t for t, d in phrase) for p in at)
    alive = [(yes, no) for yes, no in query.ways if not any(whole(p) for p in no) and all(whole(p) for p in yes)]
    if not alive:
        return None
    rank = 0.0
    for lo, hi in itertools.combinations_with_replacement(at, 2):
        if holds(lo, hi) and not (lo < hi and (holds(lo + 1, hi) or holds(lo, hi - 1))):
            named = sum(tokens[p - 1] in query.terms for p in range(lo, hi + 1))
            rank += 0.1 / (1 + (hi - lo) - (named - 1))
    return rank


@pytest.mark.parametrize("text", ["cat", "cat dog", "cat OR dog", '"cat dog"', "cat dog OR emu fox", '"cat dog" emu', "cat -dog", '-"cat dog"', "-zebra", 'cat cat "dog emu" OR fox -gnu', '"cat the dog" OR emu'])
def test_covers(text):
    rng, query = random.Random(text), parse(text)
    for _ in range(150):
        tokens = [rng.choice(["cat", "dog", "emu", "fox", "gnu", "", "elk", "elk"]) for _ in range(rng.randint(0, 14))]
        places = {t: [i + 1 for i, x in enumerate(tokens) if x == t] for t in set(tokens) if t}
        want, got = plain_rank(query, tokens), cover_rank(query, places)
        assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-12), (tokens, got, want)


def test_extents():
    rng = random.Random(3)
    for _ in range(200):
        query, text = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, k))) for k in (7, 25))
        q, order = set(trigrams(query)), trigrams(text)
        want = max((len(q & set(order[i:j])) / len(q | set(order[i:j])) for i in range(len(order)) for j in range(i + 1, len(order) + 1)), default=0.0)
        assert abs(extent_similarity(query, text) - want) < 1e-12
    assert extent_similarity("word", "two words") == 0.8 and extent_similarity("Boux", "Boox Note Air 4C") >= 0.3


def test_search(spark):
    rows = [(1, "Boox Note Air 4C"), (2, "The Boox Note Air syncs handwriting to Google Drive"), (3, None), (4, ""), (5, "boox boox"), (6, "boox boox"), (7, "Drives of handwriting, synced"), (8, "x " * 50 + "google " + "y " * 50 + "drive")]
    index = TextIndex.build(spark.createDataFrame(rows, "n long, said string"), "n", F.col("said"))
    ids = lambda q, **more: [r.id for r in index.search(q, 10, **more).collect()]
    assert ids("Boox") == [5, 6, 1, 2] and 1 in ids("Boux") and ids("zzzz") == [] and ids("the") == [2]  # a stop word finds nothing by itself, but by its letters
    assert set(ids("google drive")) == {2, 8} | {x for x in ids("google drive") if x == 7} and ids('"google drive"')[0] == 2
    assert ids("boox -note", among=spark.createDataFrame([(5,), (2,)], "id long")) == [5, 2]  # the second is near by its letters
    assert ids("Boox", among=spark.createDataFrame([(2,)], "id long")) == [2]
    found = {r.id: (r.rank, r.headline) for r in index.search("google drive", 10).collect()}
    assert found[2] == (0.1, "The Boox Note Air syncs handwriting to <mark>Google</mark> <mark>Drive</mark>") and found[8][1].count("<mark>") == 1 and found[8][1].startswith("<mark>google")
    plan = index.postings.where(F.col("term").isin("boox"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,boox)" in plan
    assert set(ids("-boox")) >= {4, 7, 8}
    nothing = TextIndex.build(spark.createDataFrame([], "n long, said string"), "n", F.col("said"))
    assert nothing.search("boox", 5).count() == 0


def test_search_agrees_with_a_scan(spark):
    rng = random.Random(9)
    words = "order orders ordering steel steels polished brass copper navy misty rose".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(300)]
    index = TextIndex.build(spark.createDataFrame(rows, "n long, said string").repartition(3), "n", F.col("said"))
    for text in ("order steel", '"polished brass" OR navy', "copper -rose", "stel"):
        query, want = parse(text), []
        for i, said in rows:
            tokens = {}
            for t, at in lexemes(said):
                tokens.setdefault(t, []).append(at)
            rank, near = cover_rank(query, tokens), round(extent_similarity(text, said), 6)
            if rank is not None or near >= 0.3:
                want.append((-round(rank or 0.0, 6), -(near if near >= 0.3 else 0.0), i))
        assert [(-r["rank"], -r.similarity, r.id) for r in index.search(text, 40).collect()] == sorted(want)[:40], text
    assert headline(parse("steel"), F.col("said")) is not None


def test_postings_leave_in_slices(monkeypatch):
    """A batch of texts leaves a task in frames of bounded size, each posting once, at any bound."""
    import pandas as pd

    from tessera.operators import textindex

    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(50)] + ["", "the"]
    frame = pd.DataFrame({"key": [str(i).encode() for i in range(len(texts))], "text": texts})
    for make in (textindex._postings, textindex._grams):
        whole = pd.concat(list(make(iter([frame]))))
        monkeypatch.setattr(textindex, "SLICE_ROWS", 100)
        parts = list(make(iter([frame, frame.iloc[:0]])))
        monkeypatch.undo()
        assert max(map(len, parts)) < 100 + max(whole.groupby("key").size()) and pd.concat(parts).astype(str).values.tolist() == whole.astype(str).values.tolist()


def test_claims_bring_their_statements(spark, monkeypatch):
    """The search of claims writes no table of who said what, whose sort grows with the claims; each claim found is active and matches."""
    from tessera.operators.textindex import TextIndex
    from tessera.plans import ALL_QUERIES

    built, build = [], TextIndex.build
    monkeypatch.setattr(TextIndex, "build", staticmethod(lambda *a, **k: built.append(build(*a, **k)) or built[-1]))
    rows = ALL_QUERIES["lexical_claims"](spark, "/root/testdata/sf0.001").collect()
    assert built[0].members is None and rows and all("<mark>status</mark>" in r.headline for r in rows)
