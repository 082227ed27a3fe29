"""Packing token sequences with the sum-of-squares rule."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import compress, count
from operator import not_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only

#: A worker's ids by word as written, and by lower-case word without its last punctuation marks: a generation holds this many, and the one before it stays.
CACHE_WORDS, CACHE_CORES = 300_000, 400_000
#: ASCII marks but the apostrophe, which the tokenizer may leave with the letters after it.
MARKS = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""


def latin(word: bytes) -> tuple[bytes, bytes] | None:
    """Lower-case letters and last marks of a word of letters below U+0180; none for other words. (U+0130 has two lower-case characters.)"""
    body = word.rstrip(MARKS)
    marks = word[len(body) :]
    if body.isalpha():  # of bytes: ASCII letters only
        return body.lower(), marks
    if body.isascii():
        return None
    text = body.decode()
    return (text.lower().encode(), marks) if text.isalpha() and max(text) < "\u0180" and "\u0130" not in text else None


class WordIds:
    """Ids by word, as little-endian unsigned 32-bit integers. The tokenizer's own splits never span ASCII white space, so a text's ids are
    those of its words in a row; and it splits marks from letters, so that a word of Latin letters and its last marks are encoded apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.whole.model)  # without the steps that leave a word of lower-case Latin letters whole
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.older_cores: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}

    @staticmethod
    def _encode(tokenizer, words: list[bytes]) -> list[bytes]:
        found = []
        for i in range(0, len(words), 8192):
            found += [struct.pack(f"<{len(e)}I", *e.ids) for e in tokenizer.encode_batch_fast([w.decode() for w in words[i : i + 8192]], add_special_tokens=False)]
        return found

    def learn(self, new: set[bytes]) -> None:
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        if len(self.cores) + len(new) > CACHE_CORES:
            self.cores, self.older_cores = {}, self.cores
        parts, other = [], []
        for w in new:
            if (known := self.older.get(w)) is not None:
                self.words[w] = known
            elif (part := latin(w)) is not None:
                parts.append((w, *part))
            else:
                other.append(w)
        cores = {c for _, c, _ in parts}.difference(self.cores)
        again = {c: self.older_cores[c] for c in cores if c in self.older_cores}
        self.cores.update(again)
        missing = list(cores.difference(again))
        self.cores.update(zip(missing, self._encode(self.letters, missing), strict=True))
        if len(self.marks) > CACHE_WORDS:
            self.marks = {b"": b""}
        ends = list({m for _, _, m in parts}.difference(self.marks))
        self.marks.update(zip(ends, self._encode(self.whole, ends), strict=True))
        for w, core, end in parts:
            self.words[w] = self.cores[core] + self.marks[end]
        self.words.update(zip(other, self._encode(self.whole, other), strict=True))

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Each word is looked up once; only places of words not seen yet are filled in afterwards."""
        words = [t.split() for t in texts]
        found = [list(map(self.words.get, ws)) for ws in words]
        gaps = [list(compress(count(), map(not_, ids))) for ids in found]
        new = {ws[i] for ws, at in zip(words, gaps, strict=True) for i in at}
        if new:
            self.learn(new)
            for ws, ids, at in zip(words, found, gaps, strict=True):
                for i in at:
                    ids[i] = self.words[ws[i]]
        return list(map(b"".join, found))


_tokenizers: dict[str, WordIds] = {}


def ids_of(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text."""
    keep_only("packing", _tokenizers.clear)
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    known = _tokenizers[path]
    return [ids for i in range(0, len(texts), 16) for ids in known.of(texts[i : i + 16])]  # few at a time, so that their words stay near the processor


def pieces_of(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Each document is its ids and then ``end_id``; only a
    document longer than ``size`` is cut, every ``size`` ids. A null text is empty and gives one piece of one id."""
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                texts = [b"" if t is None else t.encode() for t in part["_text"]]
                out = []
                for key, ids in zip(part["_id"], ids_of(texts, tokenizer), strict=True):
                    ids += end
                    for n, i in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[i : i + 4 * size]
                        out.append((key, n, i // 4, len(own) // 4, zlib.crc32(own)))
                yield pd.DataFrame(out, columns=[id_col, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInPandas(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order.

    An item goes to the open bin for which the sum over gaps of (number of open bins with that gap) squared becomes smallest; full bins
    are not open, and among equals the tightest wins. A new bin is opened only for an item that fits nowhere: fewest bins come first here.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, n = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, x in enumerate(lengths.tolist()):
        # half the change of the sum: leaving gap g gives 1/2 - counts[g], entering gap g - x gives counts[g - x] + 1/2, and nothing at gap 0
        there, change, gap = counts[x:size], counts[: size - x] - counts[x:size] + 1.0, size
        if there.any():
            change[0] = 0.5 - there[0]
            change[there == 0] = np.inf
            gap = int(change.argmin()) + x
        if gap == size:
            b, n = n, n + 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, size - gap
        if gap > x:
            counts[gap - x] += 1
            open_bins[gap - x].append(b)
    return bins, offsets


def pack(pieces: DataFrame, shards: int, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces. Pieces are dealt to ``shards`` by hash, and each shard is packed by sum_of_squares from
    the longest piece to the shortest, ties by id. A shard holds lengths and ids, no texts; its only loss against one large packing is its last bins,
    so choose shards by the number of pieces (see queries)."""
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), size)
        return group.assign(sequence_id=bins * shards + key[0], offset=offsets)[schema.names]

    shard = F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards))
    return pieces.groupBy(shard.alias("_shard")).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, shard_pieces: int = 60_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents into sequences of at most ``size`` ids: one row per piece with id, piece, start, length, ids_crc32,
    sequence_id and offset; the rows of a sequence fill it from 0 without gaps.

    A null or empty text is one id, the end. Repeated rows are packed each. Very long texts are cut into pieces. An
    empty table gives an empty result. Other columns are ignored.
    """
    shards = max(1, -(-docs.count() // shard_pieces))
    return pack(pieces_of(docs, tokenizer, size, end_id, id_col, text_col), shards, size, id_col)
