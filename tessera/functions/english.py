"""English words for text search: tokens with places, stop words and stems after the Snowball English rules."""

from __future__ import annotations

import re
from functools import lru_cache

#: The English stop words of text search.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words that the rules would stem wrongly, and those that keep their form after their plural went.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes with what takes their place, second and third step; suffixes that go, fourth step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES, LI_ENDS, WIDE_STARTS = frozenset("bb dd ff gg mm nn pp rr tt".split()), frozenset("cdeghkmnrt"), ("gener", "commun", "arsen")

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_VOWEL_RUN = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    found = _VOWEL_RUN.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        return w[:-1]
    return w


def _verb(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    left = w[: -len(end)]
    if end.startswith("eed"):
        return left + "ee" if len(left) >= r1 else w
    if not re.search("[aeiouy]", left):
        return w
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left[-2:] in DOUBLES:
        return left[:-1]
    return left + "e" if len(left) <= r1 and _SHORT_END.search(left) else left


def _second(w: str, r1: int) -> str:
    end = _longest(w, SECOND)
    if end is None or len(w) - len(end) < r1:
        return w
    before = w[: -len(end)]
    if (end == "ogi" and not before.endswith("l")) or (end == "li" and before[-1:] not in LI_ENDS):
        return w
    return before + SECOND[end]


def _third(w: str, r1: int, r2: int) -> str:
    end = _longest(w, THIRD)
    if end is None or len(w) - len(end) < (r2 if end == "ative" else r1):
        return w
    return w[: -len(end)] + THIRD[end]


def _fourth(w: str, r2: int) -> str:
    end = _longest(w, FOURTH)
    if end is None or len(w) - len(end) < r2 or (end == "ion" and w[-4:-3] not in ("s", "t")):
        return w
    return w[: -len(end)]


def _final(w: str, r1: int, r2: int) -> str:
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT_END.search(w[:-1]))):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and at >= r2 else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("’", "'")
    if len(w) <= 2 or not w.isascii():
        return w
    if w in IRREGULAR:
        return IRREGULAR[w]
    w = w.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    start = next((len(s) for s in WIDE_STARTS if w.startswith(s)), None)
    r1 = start if start is not None else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    w = _plural(w)
    if w in INVARIANT:
        return w.lower()
    w = _verb(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _final(_fourth(_third(_second(w, r1), r1, r2), r2), r1, r2)
    return w.lower()


def lexemes(text: str) -> list[tuple[str, int]]:
    """(stem, place) of the words that aren't stop words; places count from 1 and count stop words too."""
    return [(stem(w), n) for n, w in enumerate((m.group().lower() for m in WORD.finditer(text)), 1) if w not in STOP]
