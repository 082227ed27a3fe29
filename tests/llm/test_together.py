"""Texts are searched for windows together, and equal stretches go through an automaton once; the results are those of each alone."""

import random

import numpy as np
import pytest

from tessera.llm import windows
from tessera.llm.phrases import Phrases


@pytest.mark.parametrize("spec", [windows.Spec(13, 6, True), windows.Spec(100, 40, False)])
def test_texts_together_have_the_runs_of_each(spec, monkeypatch):
    rng = random.Random(5)
    pick = lambda n: "".join(rng.choice(["ab ", "c ", "ü ", "ddd\n", "e  ", " \t", "same same "]) for _ in range(n))
    texts = [pick(rng.choice([0, 1, 12, 13, 14, 60, 300])) for _ in range(60)] + ["", " ", "a " * 200, "x" * 150, pick(3000)]
    monkeypatch.setattr(windows, "TOGETHER", 2000)
    seen = 0
    for begin, some in windows.together(texts):
        got = windows.runs_in(some, spec)
        for i, text in enumerate(some):
            assert text == texts[begin + i].encode()
            place, hashes = windows.anchors(windows.tokens(text, spec), spec)
            first, end = windows.runs(place)
            own, base = got.text == i, got.begins[i]
            if len(first):
                assert (got.first[own] - base).tolist() == first.tolist() and (got.end[own] - base).tolist() == end.tolist()
                assert (got.anchor[own] - base).tolist() == place[first].tolist() and np.array_equal(got.seed[own], hashes[place[first]])
            else:
                assert not own.any()
            seen += 1
    assert seen == len(texts)


def test_equal_stretches_go_through_the_automaton_once():
    words = [f"w{i}" for i in range(20)]
    phrases, calls = Phrases([(" ".join(words[:15]).encode(), 3), (" ".join(words[5:]).encode(), 7)], 13), []

    class Noted:
        def iter(self, found, inner=phrases.automaton):
            calls.append(found)
            return inner.iter(found)

    phrases.automaton = Noted()
    text = " ".join(words).encode()
    assert [phrases.earlier(text, than) for than in (3, 4, 8)] == [(8, 0), (8, 0b111), (8, 0b11100111)]
    assert len(calls) == 1
