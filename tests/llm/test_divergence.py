"""op13 against brute force, in blocks and tiles of any size."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence
from tessera.llm.divergence import audit_sources, count_terms

from .cases import CLASHING, sentence

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """rows: (text, lang, source)."""
    extra = CLASHING.replace("_text", "n long, g string, term string, _text").split(", ")
    return spark.createDataFrame([(*r, *[1 if e.endswith("long") else "x" for e in extra]) for r in rows], f"text string, lang string, source string, {', '.join(extra)}").repartition(3)


def plain(rows, least_docs, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [t.translate(UPPER) for t in TERMS.findall(text or "")]
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
        groups.add((lang or "", source or ""))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        mine = sorted(s for g, s in groups if g == lang)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in mine}
        q = shares(sum((counts[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def cases(seed=4):
    rng = random.Random(seed)
    rows = [(sentence(rng, rng.randint(0, 30)) + rng.choice([" 'tis co-op a1b", "", " İstanbul ſ K é"]), rng.choice(["en", "en", "de", None]), rng.choice("pqrstu")) for _ in range(150)]
    rows += [(None, "en", "bare"), ("", "en", None), ("12 34", "en", "digits"), ("alone", "fr", "x"), ("alone too", "fr", "y"), (None, None, None), ("alpha " * 500, "xx", "single")]
    return rows + [rows[0]] * 9 + [(sentence(rng, 3000), "en", "p")]


@pytest.mark.parametrize(("postings", "cells"), [(2_000_000, 4_000_000), (7, 4_000_000), (20, 9)])
def test_against_brute_force(spark, postings, cells):
    rows = cases()
    got = audit_sources(spark, table(spark, rows), least_docs=6, top_terms=7, postings=postings, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain(rows, 6, 7)
    assert sorted(map(tuple, got.collect())) == want and {r[2] for r in want} == {"pair", "term"}


def test_postings_and_texts_in_stretches(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(divergence, "STRETCH", 11)
    monkeypatch.setattr(divergence, "HELD", 5)
    texts = ["Alpha beta alpha gamma delta", "beta" * 30 + " " + "мир " * 9, ""]
    found = Counter(), Counter()
    for frame in count_terms([pd.DataFrame({"lang": "a", "source": "b", "text": [t.encode() for t in texts]})]):
        for r in frame.itertuples():
            found[0][r.term] += r.n
            found[1][r.term] += r.docs
    assert found[0] == {"alpha": 2, "beta": 1, "gamma": 1, "delta": 1, "beta" * 30: 1, "мир": 9}
    assert found[1] == {"alpha": 1, "beta": 1, "gamma": 1, "delta": 1, "beta" * 30: 1, "мир": 1}
    index = pd.DataFrame([(t, g, 10 + (g * 7 + int(t) * 3) % 11) for t in "012345" for g in range(4) if (int(t) + g) % 3], columns=["term", "g", "p"])
    peers = pd.DataFrame({"lang": "a", "g": range(4), "zero": [3, 14, 9, 12], "mine": True})
    parts = divergence.accumulate(index, peers)
    sums = Counter()
    for r in parts.itertuples():
        sums[min(r.g, r.h), max(r.g, r.h)] += r.part
    value = {(r.term, r.g): r.p for r in index.itertuples()}
    of = lambda t, g: value.get((t, g), peers.zero[g])
    assert sums == {(g, h): sum(abs(of(t, g) - of(t, h)) for t in "012345") for g in range(4) for h in range(g + 1, 4)}


def test_empty(spark):
    assert audit_sources(spark, table(spark, cases()).limit(0)).count() == 0
    assert audit_sources(spark, table(spark, [("a b", "en", "one")])).count() == 0
    assert sorted(map(tuple, audit_sources(spark, table(spark, [("a b", "en", "one"), (None, "en", None)])).collect())) == [("en", "", "pair", "one", 0, 1), ("en", "one", "pair", "", 0, 1)]
