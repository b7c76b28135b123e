"""Byte-level BPE: batched numpy merge rounds to encode, table look-ups to decode."""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docgate.llm.common import slices

SPACE, LETTER, NUMBER, OTHER, EDGE, SPECIAL = range(6)
#: The code points with the White_Space property.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    table[list(WHITE)] = SPACE
    return table


def _found(text: str, what: str) -> list[int]:
    out, at = [], text.find(what)
    while at >= 0:
        out.append(at)
        at = text.find(what, at + len(what))
    return out


def split_words(texts: list[str], specials: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by a character each, start and end of each word there, and the text each word is in.

    Words are those of the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`,
    found from where the kinds of neighbouring characters differ; special strings are words of their own, and what is
    between them is split by itself."""
    joined = "\n".join(texts)
    edges = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))[:-1] - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _kinds()[points]
    kind[edges] = EDGE
    forced = [edges]
    for word in specials:
        for at in _found(joined, word):
            if (kind[at : at + len(word)] < EDGE).all():
                kind[at : at + len(word)] = SPECIAL
                forced.append(np.array([at, at + len(word)]))
    start = np.empty(len(points) + 1, bool)
    start[0] = start[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
    # the last character of white space before other text stands apart; if it is a blank it goes with that text
    after = np.flatnonzero(start[1:-1] & (kind[:-1] == SPACE) & (kind[1:] < EDGE)) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 0x20
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        quotes = quotes[start[quotes] & (kind[quotes] == OTHER)]
        padded, kinds = np.append(points, [0, 0]), np.append(kind, [EDGE, EDGE])
        one, two = padded[quotes + 1], padded[quotes + 2]
        plain = kinds[quotes + 1] == LETTER
        short = plain & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = plain & (kinds[quotes + 2] == LETTER) & np.any([(one == a) & (two == b) for a, b in pairs], axis=0)
        start[quotes[short | long] + 1] = False
        start[quotes[short] + 2] = True
        start[quotes[long] + 3] = True
    for at in forced:
        start[at] = True
    bounds = np.flatnonzero(start)
    begin, end = bounds[:-1], bounds[1:]
    real = kind[begin] != EDGE if len(begin) else np.zeros(0, bool)
    begin, end = begin[real], end[real]
    return joined, begin, end, np.searchsorted(edges, begin)


class _Numbered(dict):
    """Numbers words in the order in which they are first asked for, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Codec:
    """The vocabulary of a tokenizers JSON file with byte-level BPE, no prefix space and plain added tokens."""

    #: Words whose ids are kept between batches; beyond it they are forgotten, which costs time only.
    KEEP = 300_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        byte_of = {c: b for b, c in chars.items()}
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.none = len(merges)  # the rank of a pair that doesn't merge
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        tokens = [b""] * self.size
        for token, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.forget()

    def forget(self) -> None:
        self.known = _Numbered()
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's begin.

        In each round every word that still has a pair to merge merges its lowest-ranked pair, from left to right; only
        pairs beside a merge are looked up again."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), self.none, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(heads, len(word)))
            best = np.minimum.reduceat(rank, heads)
            if (over := best == self.none).any():
                ended = np.repeat(over, lengths)
                done.append((word[ended], symbols[ended]))
                word, symbols, rank = word[~ended], symbols[~ended], rank[~ended]
                best, lengths = best[~over], lengths[~over]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            run = np.append(True, np.diff(at) != 1)  # in x x x, the first pair and not the second
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # places after the removal
            word, symbols, rank = word[stay], symbols[stay], rank[stay]
            beside = np.zeros(len(word), bool)
            beside[moved] = True
            beside[moved[moved > 0] - 1] = True
            again = np.flatnonzero(beside)
            more = again[again + 1 < len(word)]
            more = more[word[more] == word[more + 1]]
            rank[again] = self.none
            rank[more] = self.pair_ranks(symbols[more], symbols[more + 1])
        words_of = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        ids = ids[np.argsort(words_of, kind="stable")]
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(words_of, minlength=len(words)))])

    @staticmethod
    def _replaced(ids: np.ndarray, at: np.ndarray, single: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, with one given id for some of them."""
        parts = np.split(ids, at[1:-1])
        for i, own in single.items():
            parts[i] = np.array([own], np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin, with the end as last entry."""
        joined, begin, end, text = split_words(texts, list(self.special))
        words = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        if len(self.known) > self.KEEP:
            self.forget()
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if new := self.known.new:
            self.known.new = []
            ids, at = self.merged([w.encode() for w in new])
            if found := [i for i, w in enumerate(new) if w in self.special]:
                ids, at = self._replaced(ids, at, {i: self.special[new[i]] for i in found})
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.ids = np.concatenate([self.ids, ids])
        ids, sizes = spread(self.ids, self.at, index)
        per_text = np.bincount(text, weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each stretch of ids; bytes that aren't UTF-8 become U+FFFD."""
        data, sizes = spread(self.token_bytes, self.token_at, ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def spread(values: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[at[i]:at[i + 1]] for each i of index, end to end, and their lengths."""
    begin = at[index]
    sizes = at[index + 1] - begin
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begin - (ends - sizes), sizes)], sizes


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _ids_column(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs and `ids` array<int>, the text's ids under the vocabulary file at `path` (on each worker).

    Special strings of the file that stand in a text get their own id, as the tokenizers library does. A null or empty
    text has no ids. A column named `ids` is replaced; others pass through. No shuffle; texts go through in parts of
    about a megabyte, and a longer text by itself."""
    rest = docs.drop("ids")
    names = rest.columns

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = own.encode(part.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_column(ids, offsets)], [*names, "ids"])

    return rest.mapInArrow(run, T.StructType(rest.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """The columns of docs but `ids`, and `decoded`, the text that the ids stand for (null ids: empty; an id outside the
    vocabulary fails). With `digests` also n_tokens, and ids_sha256 of the ids as little-endian unsigned 32-bit integers."""
    added = ["decoded", "n_tokens", "ids_sha256"] if digests else ["decoded"]
    rest = docs.drop(*added)
    names = [c for c in rest.columns if c != "ids"]

    def run(batches):
        own = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, offsets = listed(part.column("ids"))
                if len(ids) and not 0 <= ids.min() <= ids.max() < own.size:
                    raise ValueError("an id is not in the vocabulary")
                columns = [*(part.column(c) for c in names), pa.array(own.decode(ids, offsets), pa.string())]
                if digests:
                    data, ends = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
                    hashes = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    columns += [pa.array(np.diff(offsets)), pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    kinds = {"decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType()}
    return rest.mapInArrow(run, T.StructType([f for f in rest.schema.fields if f.name != "ids"] + [T.StructField(c, kinds[c]) for c in added]))


def listed(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column in one array (null: empty), and where each list begins."""
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
