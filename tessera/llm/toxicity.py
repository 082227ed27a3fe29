"""Toxicity by a weighted lexicon, matched with Aho-Corasick automata over folded text."""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, free_name, keep_only

#: Letters that look like a Latin letter. Fixed values, chosen by shape.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "s",
}
#: Digits and signs written for a letter, inside words that also hold letters. Fixed values.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i"}
#: Harmless phrases that hold a term; a match inside one doesn't count. A parameter; these are the defaults.
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clown fish", "clownfish", "idiot proof", "moron mountain", "pond scum", "stupid simple")
HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


class _Fold(dict):
    """Folds a character: homoglyphs and compatibility forms to a plain lower-case letter; combining marks away; anything that is neither
    letter nor digit to a space. Accented letters stay; see _fold_word."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = HOMOGLYPHS.get(c.lower()) or unicodedata.normalize("NFKC", c).lower()
        out = "".join(HOMOGLYPHS.get(x, x) for x in out if not unicodedata.combining(x))
        self[code] = out = "".join(x if x.isalnum() or x in DIGITS else " " for x in out)
        return out


_FOLD = _Fold({**HIDDEN})
_LEET = str.maketrans(DIGITS)
_RUN = re.compile(r"([a-z])\1{2,}")
#: A worker's folded words; it starts again when it holds this many.
CACHE_WORDS = 400_000
_words: dict[str, str] = {}


def _fold_word(word: str) -> str:
    plain = word.lower().strip(".,;:!?\"'()*#&%-")
    if plain.isascii() and plain.isalpha():
        return _RUN.sub(r"\1\1", plain)
    out = unicodedata.normalize("NFC", word).translate(_FOLD)
    if any(d in out for d in DIGITS):
        out = " ".join(x.translate(_LEET) if any(c.isalpha() for c in x) else "".join(c if c.isalnum() else " " for c in x) for x in out.split())
    parts = out.split()
    if len(parts) > 3 and all(len(x) == 1 for x in parts):
        parts = ["".join(parts)]
    out = _RUN.sub(r"\1\1", " ".join(parts))
    bare = "".join([x for x in unicodedata.normalize("NFD", out) if not unicodedata.combining(x)])
    return out if bare == out else f"{out} {bare}"


def _spelled(words: list[str]) -> list[str]:
    """Joins runs of four or more single letters."""
    out: list[str] = []
    run: list[str] = []
    for w in [*words, "  "]:
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        out += ["".join(run)] if len(run) > 3 else run
        run = []
        out.append(w)
    return out[:-1]


def fold(text: str | None) -> str:
    """Folded words, one space between and around: lower case, homoglyphs, hidden characters and digit substitutions undone, letters
    spelled out one by one joined, runs of three or more equal letters cut to two; a word with accents is followed by itself without."""
    if len(_words) > CACHE_WORDS:
        _words.clear()
    known, out = _words, []
    for w in (text or "").split():
        try:
            out.append(known[w])
        except KeyError:
            known[w] = f = _fold_word(w)
            out.append(f)
    if sum([len(w) == 1 for w in out]) > 3:
        out = _spelled(out)
    return f" {' '.join([w for w in out if w])} "


def _batched(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), *(docs[c] for c in extra))


def _own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches of a task. What other operators kept in the worker goes at the start, the folded words at the end: they help within a task, hardly from one to the next."""
    keep_only("toxicity")
    yield from batches
    _words.clear()


def signature(words: list[str]) -> int:
    """The smallest hash of three words in a row: near copies mostly share it, other texts don't."""
    h = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(h) > 2:
        h = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
    return int(h.min().view(np.int64)) if len(h) else 0


def learn_lexicon(labelled: DataFrame, min_log_odds: float = 3.0, least: int = 4, most: int = 16, text_col: str = "text") -> dict[str, float]:
    """Weighted terms from rows (text, toxic): word beginnings and whole words that mark toxic texts.

    Every labelled text counts, near copies together as one text with the words of all (see signature). Spark counts, for each folded word, the toxic and the other texts
    that hold it, and adds these up for the words' beginnings of ``least`` to ``most`` letters; so inflected forms that the labels never
    show are covered. A term counts if its smoothed log odds reach ``min_log_odds`` and it is in so many toxic texts that among all terms less than
    one in twenty would be there by chance. Of nested terms with almost the same counts the longest stays, and none that a
    shorter chosen one implies. A term ends with a space if it is a whole word. The weight is the log odds. The labelled texts, of which there is a
    bound (see score_documents), bound what the driver and the tasks hold. Counts are sums, so that the lexicon is the same however rows are dealt.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _own_words(batches):
            lists = [fold(t).split() for t in b["_text"]]
            yield pd.DataFrame({"sig": [signature(ws) for ws in lists], "toxic": b["_toxic"].to_numpy(), "words": [list(set(ws)) for ws in lists]})

    rows = labelled.select(labelled[text_col].alias("_text"), labelled["toxic"].cast("int").alias("_toxic")).where("_toxic IN (0, 1)")
    texts = Workspace(labelled.sparkSession, "lexicon").save(rows.mapInPandas(words, "sig long, toxic int, words array<string>"), "texts")
    n_pos, n_all = texts.select("sig", "toxic").distinct().agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    n_neg = n_all - n_pos
    if not n_pos or not n_neg:
        return {}
    held = texts.select("sig", "toxic", F.explode("words").alias("word")).distinct()
    counted = held.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    lengths = f"sequence({least}, least({most}, length(word)))"
    begins = counted.where(F.length("word") >= least).select(F.explode(F.expr(f"concat(array(concat(' ', word, ' ')), transform({lengths}, n -> concat(' ', substring(word, 1, n))))")).alias("term"), "pos", "neg")
    short = counted.where(F.length("word") < least).select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("term"), "pos", "neg")
    terms = begins.unionByName(short).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chance = math.log(20.0 * max(1, counted.count())) / math.log(n_all / n_pos)
    odds = F.log((F.col("pos") + 0.5) / (F.lit(n_pos) + 1.0)) - F.log((F.col("neg") + 0.5) / (F.lit(n_neg) + 1.0))
    found = terms.withColumn("weight", odds).where((F.col("pos") >= max(3.0, chance)) & (F.col("weight") >= min_log_odds))
    return chosen_terms({r.term: (r.pos, r.weight) for r in found.orderBy(F.desc("weight"), "term").collect()})


def chosen_terms(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """From terms with their counts and weights, heaviest first: the shortest of nested ones, lengthened while a longer one has almost its count."""
    longer: dict[str, list[str]] = {}
    for t in found:
        longer.setdefault(t[:-1], []).append(t)
    chosen: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.rstrip()), t.endswith(" "), t)):
        if any(term[:i] in chosen for i in range(2, len(term))):
            continue
        while near := [t for t in longer.get(term, ()) if found[t][0] >= 0.9 * found[term][0]]:
            term = near[0]
        chosen[term] = found[term][1]
    return chosen


_matchers: dict[str, tuple] = {}


def matcher(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> tuple:
    import ahocorasick

    terms, phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
    for t, w in lexicon.items():
        terms.add_word(t, (len(t), w))
    for p in exceptions:
        phrases.add_word(fold(p), len(fold(p)))
    if lexicon:
        terms.make_automaton()
    if exceptions:
        phrases.make_automaton()
    return terms, phrases


def features(text: str | None, match: tuple) -> tuple[float, int, int]:
    """Summed weight of the terms outside exception phrases, the heaviest at each word; how many; how many words the text has."""
    terms, phrases = match
    folded = fold(text)
    if not len(terms):
        return 0.0, 0, len(folded.split())
    best: dict[int, float] = {}
    for end, (n, w) in terms.iter(folded):
        at = end - n + 1
        best[at] = max(w, best.get(at, 0.0))
    if best and len(phrases):
        for end, n in phrases.iter(folded):
            for at in [a for a in best if end - n + 1 <= a < end]:
                del best[at]
    return sum(best.values(), 0.0), len(best), len(folded.split())


def measured(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...], id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Id, weight, hits, words and the extra columns, by one pass over the texts."""
    key, model = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(pickle.dumps((lexicon, exceptions)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = matcher(*pickle.loads(model.value))
        for b in _own_words(batches):
            got = [features(t, _matchers[key]) for t in b["_text"]]
            yield b.drop(columns="_text").assign(weight=[g[0] for g in got], hits=[g[1] for g in got], words=[g[2] for g in got])

    rows = _batched(docs, id_col, text_col, extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(score, f"{kinds}, weight double, hits long, words long")


def calibrate(rows: DataFrame, cells: int = 40) -> tuple[float, float]:
    """Intercept and slope of a logistic curve for label 1 over the normalised weight, by Newton steps on counts in fixed cells.

    Spark reduces all labelled rows to label counts by cell; so the driver holds ``cells`` numbers at any size. A small ridge keeps separable labels finite.
    """
    cell = F.least(F.floor(normalised() * 10), F.lit(cells - 1)).cast("int")
    got = {(r[0], r[1]): r[2] for r in rows.groupBy(cell.alias("cell"), "toxic").count().collect()}
    x = (np.arange(cells) + 0.0) / 10
    pos, neg = (np.array([got.get((i, y), 0) for i in range(cells)], dtype=float) for y in (1, 0))
    if not pos.sum() or not neg.sum():
        return -2.0, 4.0
    a, b = 0.0, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        n = pos + neg
        g = np.array([(pos - n * p).sum() - 1e-3 * a, ((pos - n * p) * x).sum() - 1e-1 * b])
        h = np.array([[(n * p * (1 - p)).sum() + 1e-3, (n * p * (1 - p) * x).sum()], [(n * p * (1 - p) * x).sum(), (n * p * (1 - p) * x * x).sum() + 1e-1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 0.0))


def normalised():
    """Weight for the length: the summed weight over the square root of one plus words / 100, then its logarithm."""
    return F.log1p(F.col("weight") / F.sqrt(1 + F.col("words") / 100.0))


def score_documents(docs: DataFrame, labels: DataFrame, train=None, exceptions: tuple[str, ...] = EXCEPTIONS, threshold: float = 0.7, max_labels: int = 40_000, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: id, score (0 to 1), predicted, hits, words and the ``extra`` columns of the documents.

    labels has the id and toxic (0 or 1; others are ignored). ``train`` is a condition on the id column: only labels where it holds are
    learned from, and of more than ``max_labels`` of them a sample by hash of the id of about that size; so the ids to learn from have a bound, and
    broadcasting them spares a shuffle of the texts. Scores see nothing but texts. A term's matches count once a word, not inside exception phrases, and are divided by length (see normalised), so that long clean texts don't add up to a toxic one.

    Null and empty texts have no match and get the lowest score. Repeated rows are scored each; an id with several labels learns from
    each. Without labels of both kinds the lexicon is empty and every text gets the same low score. An empty table gives an empty
    result. Other columns, also those that labels and docs share, are ignored.
    """
    known = labels.select(labels[id_col].alias("_key"), labels["toxic"].cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    if train is not None:
        known = known.where(train(F.col("_key")))
    n = known.count()
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64("_key", F.lit("labels")), F.lit(1_000_000)) < int(1_000_000 * max_labels / n))
    texts = docs.select(docs[id_col].alias(id_col), docs[text_col].alias(text_col), *[docs[c] for c in extra])
    labelled = texts.join(F.broadcast(known), texts[id_col] == known["_key"]).select(texts[id_col], texts[text_col], "toxic")
    lexicon = learn_lexicon(labelled, text_col=text_col)
    a, b = calibrate(measured(labelled, lexicon, exceptions, id_col, text_col, ("toxic",)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) + F.lit(b) * normalised()))))
    done = measured(texts, lexicon, exceptions, id_col, text_col, extra).withColumn("score", score)
    return done.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits", "words", *extra)


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that score_documents doesn't predict toxic, with all their columns. Rows are told apart by id and text, so that a toxic text goes whatever its id, and a clean one
    stays that shares its id, or has none."""
    own = free_name("text_digest", docs)
    marked = docs.withColumn(own, F.md5(F.coalesce(docs[text_col], F.lit(""))))
    bad = score_documents(marked, labels, train, id_col=id_col, text_col=text_col, extra=(own,), **options).where("predicted = 1")
    bad = Workspace(spark, "toxicity").save(bad.select(F.col(id_col).alias("_bad"), F.col(own).alias("_digest")).distinct(), "rejected")
    return marked.join(bad, marked[id_col].eqNullSafe(bad["_bad"]) & (marked[own] == bad["_digest"]), "left_anti").drop(own)


def held_out(key):
    """Whether crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
