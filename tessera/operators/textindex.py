"""Full-text search over an inverted index: postings sorted by term, cover-density rank, trigram extents, headlines."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.english import STOP, WORD, lexemes, stem
from ..storage import new_folder, saved

#: Least word similarity of a fuzzy match, weight of a word, most and least words of a headline.
FUZZY_LEAST, WEIGHT, HEADLINE_WORDS = 0.3, 0.1, 35
#: Rows of postings or trigrams that a task holds at once, about.
SLICE_ROWS = 20_000

Phrase = tuple[tuple[str, int], ...]
_GRAM_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Query:
    """Alternatives, each of phrases that a text must have and phrases that it must not. A word is a phrase of one; a phrase holds stems with their distance from the first."""

    ways: tuple[tuple[tuple[Phrase, ...], tuple[Phrase, ...]], ...]
    raw: str

    @property
    def terms(self) -> list[str]:
        return sorted({t for yes, no in self.ways for p in yes + no for t, _ in p})

    @property
    def wanted(self) -> set[str]:
        return {t for yes, _ in self.ways for p in yes for t, _ in p}


def parse(text: str) -> Query:
    """Blanks mean and, which binds closer than OR; quotes make a phrase, a minus before a word or phrase excludes it. Stop words only count for distances in a phrase."""
    ways: list[tuple[list[Phrase], list[Phrase]]] = [([], [])]
    for minus, quoted, word in re.findall(r'(-?)"([^"]*)"|(\S+)', text):
        if not quoted and word.lower() == "or":
            ways.append(([], []))
            continue
        if word.startswith("-"):
            minus, word = "-", word[1:]
        found = lexemes(quoted or word)
        if found:
            ways[-1][bool(minus)].append(tuple((t, n - found[0][1]) for t, n in found))
    return Query(tuple((tuple(yes), tuple(no)) for yes, no in ways if yes or no), text)


def spans(phrase: Phrase, places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """Where a phrase stands: first and last place, in order."""
    rest = [(set(places.get(t, ())), d) for t, d in phrase[1:]]
    return [(p, p + phrase[-1][1]) for p in places.get(phrase[0][0], ()) if all(p + d in at for at, d in rest)]


def cover_rank(query: Query, places: dict[str, list[int]]) -> float | None:
    """Null if the text doesn't match, else the sum over minimal covers of 0.1 / (1 + words of the cover that the query doesn't name).

    A cover is a stretch of places that satisfies the query and holds no shorter one that does. Covers are taken from the left, each beginning after the last one's beginning.
    """
    needed = [[spans(p, places) for p in yes] for yes, no in query.ways if not any(spans(p, places) for p in no)]
    needed = [way for way in needed if all(way)]
    if not needed:
        return None
    ends = [[([s for s, _ in at], [e for _, e in at]) for at in way] for way in needed if way]
    named = sorted({p for t in query.terms for p in places.get(t, ())})
    rank, start = 0.0, 0
    while True:
        last = []  # of each way the place where all its phrases have been seen, from start
        for way in ends:
            firsts = [(bisect_left(s, start), e) for s, e in way]
            if all(i < len(e) for i, e in firsts):
                last.append(max(e[i] for i, e in firsts))
        if not last:
            return rank
        right = min(last)
        left = max(min(s[bisect_right(e, right) - 1] for s, e in way) for way in ends if all(e and e[0] <= right and s[bisect_right(e, right) - 1] >= start for s, e in way))
        words = bisect_right(named, right) - bisect_left(named, left)
        rank += WEIGHT / (1 + (right - left) - (words - 1))
        start = left + 1


def trigrams(text: str) -> list[str]:
    """Trigrams in order, words padded by two blanks before and one after."""
    return [padded[i : i + 3] for w in _GRAM_WORD.findall(text.lower()) for padded in [f"  {w} "] for i in range(len(padded) - 2)]


def extent_similarity(query: str, text: str) -> float:
    """The largest share, of the trigrams of the query and of a continuous extent of the text's, that both have. Extents begin and end at a trigram of the query; one that has more than
    |query| / best different trigrams can't be better than the best so far, so that only short stretches are looked at."""
    q, order = set(trigrams(query)), trigrams(text)
    hits = [i for i, g in enumerate(order) if g in q]
    best = 0.0
    for n, i in enumerate(hits):
        seen, common, at = set(), 0, i
        for j in hits[n:]:
            for g in order[at : j + 1]:
                if g not in seen:
                    seen.add(g)
                    common += g in q
            at = j + 1
            best = max(best, common / (len(q) + len(seen) - common))
            if len(seen) * best > len(q):
                break
    return best


def word_similarity(query: str, text: Column) -> Column:
    """extent_similarity of each text, 0 for null."""

    @F.pandas_udf("double")
    def similarity(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: extent_similarity(query, t or ""), na_action=None)

    return similarity(text)


def headline(query: Query, text: Column) -> Column:
    """The text, or of long ones the stretch of 35 words with the most different words of the query, the first of equal ones; those words stand in <mark> tags."""
    wanted = query.wanted

    def marked(text: str | None) -> str | None:
        if text is None:
            return None
        words = [(m.start(), m.end(), stem(m.group().lower()) if m.group().lower() not in STOP else "") for m in WORD.finditer(text)]
        first, most = 0, -1
        for k, word in enumerate(words):
            if len(words) <= HEADLINE_WORDS:
                break
            if word[2] in wanted and (n := len({w for _, _, w in words[k : k + HEADLINE_WORDS]} & wanted)) > most:
                first, most = k, n
        part = words[first : first + HEADLINE_WORDS]
        if not part:
            return text
        at, end = (0, len(text)) if len(words) <= HEADLINE_WORDS else (part[0][0], part[-1][1])
        out = []
        for s, e, w in part:
            if w in wanted:
                out += [text[at:s], "<mark>", text[s:e], "</mark>"]
                at = e
        return "".join([*out, text[at:end]])

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(marked, na_action=None)

    return mark(text)


class TextIndex:
    """Postings (term, key, places), postings of trigrams (gram, key), texts (key, text) and who has them (key, id), as tables.

    Each table is dealt by range and sorted, so that a read of a few terms or keys touches only the row groups whose bounds hold them, and a term in
    a third of all texts spreads over many files. Equal texts are indexed once: a key is the digest of a text. Null texts have no entry; empty ones are found by nothing.
    """

    def __init__(self, spark, folder: str, names: tuple[str, ...] = ("postings", "grams", "texts", "members")):
        self.folder = folder
        self.postings, self.grams, self.texts, self.members = (spark.read.parquet(f"{folder}/{name}") if name in names else None for name in ("postings", "grams", "texts", "members"))

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, text: Column, fuzzy: bool = True, members: bool = True) -> TextIndex:
        """fuzzy: whether trigrams are indexed, which suits labels and statements, not long documents. members: whether the index knows who has a text; if not, searches say among whom they look."""
        spark = rows.sparkSession
        folder = new_folder(spark, "textindex")
        given = rows.select(F.col(id_col).alias("id"), text.alias("text")).where(F.col("text").isNotNull()).withColumn("key", key_of(F.col("text")))
        # Few texts of many rows are hashed, not sorted; a key has one text.
        texts = _sorted(given.select("key", "text").distinct(), f"{folder}/texts", "key")
        _sorted(texts.mapInPandas(_postings, "term string, key binary, places array<int>"), f"{folder}/postings", "term", "key")
        if members:
            _sorted(given.select("key", "id"), f"{folder}/members", "key", "id")
        if fuzzy:
            _sorted(texts.mapInPandas(_grams, "gram string, key binary"), f"{folder}/grams", "gram", "key")
        return cls(spark, folder, ("postings", "texts", *["members"] * members, *["grams"] * fuzzy))

    def match(self, query: str) -> DataFrame:
        """(key, rank, similarity) of the texts that match by words, or by a word similarity of at least 0.3 (whatever the operators in the query)."""
        words = self._by_words(parse(query))
        return words if self.grams is None else _any_of(words, self._by_extent(query))

    def _by_words(self, query: Query) -> DataFrame:
        held = self.postings.where(F.col("term").isin(query.terms)).groupBy("key").agg(F.collect_list(F.struct("term", "places")).alias("held"))
        if any(not yes for yes, _ in query.ways):  # only exclusions: texts without any of the terms count too
            held = self.texts.select("key").join(held, "key", "left")

        @F.pandas_udf("double")
        def rank(held: pd.Series) -> pd.Series:
            return held.map(lambda h: cover_rank(query, {} if h is None else {x["term"]: sorted(x["places"]) for x in h}), na_action=None).astype("float64")

        found = held.select("key", F.round(rank("held"), 6).alias("rank"))
        return found.where(F.col("rank").isNotNull() & ~F.isnan("rank")).withColumn("similarity", F.lit(0.0))

    def _by_extent(self, query: str) -> DataFrame:
        mine = sorted(set(trigrams(query)))
        # A similarity of at least 0.3 takes at least 0.3 of the query's trigrams.
        shared = self.grams.where(F.col("gram").isin(mine)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FUZZY_LEAST * len(mine))
        near = self.texts.join(shared, "key").select("key", F.round(word_similarity(query, F.col("text")), 6).alias("similarity"))
        return near.where(F.col("similarity") >= FUZZY_LEAST).select("key", F.lit(0.0).alias("rank"), "similarity")

    def search(self, query: str, limit: int, among: DataFrame | None = None) -> DataFrame:
        """The best ``limit`` of the ids that match: id, rank, similarity, text and headline. Order: rank, similarity, id.

        among: a table of the ids that may be found, with their texts in a column text if the index has no members."""
        if self.members is None:
            found = among.select("id", key_of(F.col("text")).alias("key")).join(self.match(query), "key")
        else:
            found = self.match(query).join(self.members, "key")
            found = found if among is None else found.join(among.select("id"), "id", "left_semi")
        top = found.orderBy(F.desc("rank"), F.desc("similarity"), "id").limit(limit)
        shown = top.join(self.texts, "key").select("id", "rank", "similarity", "text", headline(parse(query), F.col("text")).alias("headline"))
        return shown.orderBy(F.desc("rank"), F.desc("similarity"), "id")


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sorted(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """Writes rows dealt by range and sorted. They are written as they come first, since dealing by range looks at its input twice."""
    rows = saved(rows, f"{path}-unsorted")
    return saved(rows.repartitionByRange(*by).sortWithinPartitions(*by), path)


def _any_of(*found: DataFrame) -> DataFrame:
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(F.max("rank").alias("rank"), F.max("similarity").alias("similarity"))


def _postings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found(key: bytes, text: str) -> list[tuple]:
        places: dict[str, list[int]] = {}
        for term, at in lexemes(text):
            places.setdefault(term, []).append(at)
        return [(term, key, at) for term, at in places.items()]

    return _in_slices(frames, found, ["term", "key", "places"])


def _grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _in_slices(frames, lambda key, text: [(gram, key) for gram in set(trigrams(text))], ["gram", "key"])


def _in_slices(frames: Iterator[pd.DataFrame], found: Callable[[bytes, str], list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """What is found in each text, in frames of about ``SLICE_ROWS`` rows: those of a whole batch of long texts would not fit into a task."""
    rows: list[tuple] = []
    for frame in frames:
        for key, text in zip(frame["key"], frame["text"], strict=True):
            rows += found(key, text)
            if len(rows) >= SLICE_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)
