"""SimHash near-duplicates, found by Golay-code fuzzy hashing."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import discard, flat, scratch, slices, stage, write

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER[_BLANK] = 0x20

#: The places of a fingerprint's three segments: first bit and number of bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the [23, 12] Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with A-Z lower-cased and runs of white space as one blank, begin and end of each word in them, and the
    first word of each text, with the number of words as last entry."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    blank = _BLANK[data]
    after = np.append(True, blank[:-1]) if len(data) else np.zeros(0, bool)
    before = np.append(blank[1:], True) if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(~blank & (after | first[:-1]))
    ends = np.flatnonzero(~blank & (before | first[1:])) + 1
    kept = ~blank | ~(after | first[:-1])  # of several blanks the first
    place = np.concatenate([[0], np.cumsum(kept)])
    text = _LOWER[data[kept]].tobytes()
    return text, place[starts], place[ends - 1] + 1, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 hashes (seed 42) of the word shingles of all texts in order, and how many each text has.

    A-Z are lower-cased, words are runs without white space of ASCII. A text of fewer words has one shingle of them all."""
    text, begin, end, word_at = folded_words(data, offsets)
    count = np.diff(word_at)
    shingles = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    doc = np.repeat(np.arange(len(count)), shingles)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    head = word_at[doc] + nth
    last = head + np.minimum(words, count[doc]) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(begin[head].tolist(), end[last].tolist(), strict=True)
    return np.fromiter((digest(text[a:b], 42) for a, b in pairs), np.uint64, len(head)), shingles


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is 1 if set in over half of the hashes of its word shingles.

    A text without words has fingerprint 0."""
    hashes, shingles = shingle_hashes(data, offsets, words)
    out = np.zeros(len(shingles), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > shingles[full, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """The columns of docs but text, and `fingerprint` (the 64 bits as a long). Null counts as empty. No shuffle."""
    names = [c for c in docs.columns if c not in ("text", "fingerprint")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = fingerprints_of(*flat(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found.view(np.int64))], [*names, "fingerprint"])

    fields = [docs.schema[c] for c in names]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.LongType())]))


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """syndrome: of each of 2^11 * 2^12 words by halves; error: the pattern of at most three errors of each syndrome."""

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [rest(1 << b) for b in range(23)]
    high = np.zeros(1 << 12, np.int64)
    for b in range(12):
        high[1 << b : 2 << b] = high[: 1 << b] ^ unit[11 + b]
    error = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            error[np.bitwise_xor.reduce([unit[p] for p in places])] = sum(1 << p for p in places)
    return high, error


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the one codeword within three bits of each 23-bit word."""
    high, error = _golay()
    return (words ^ error[high[words >> 11] ^ (words & 0x7FF)]) >> 11


@lru_cache(1)
def codewords() -> np.ndarray:
    """The codeword of each index, as 23 signs, that of the lowest bit first."""
    index = np.arange(1 << 12, dtype=np.int64)
    high, _ = _golay()
    words = index << 11 | high[index]
    return (2 * (words[:, None] >> np.arange(23) & 1) - 1).astype(np.float32)


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and codeword index: those to which each word, or it with one of its `bits` bits changed, is decoded.

    Any word within one bit of it is decoded to one of these. A word with two errors or fewer has one index, a word with
    three has at most six."""
    all_of = np.column_stack([decode(words), *(decode(words ^ (1 << b)) for b in range(bits))])
    all_of.sort(axis=1)
    new = np.column_stack([np.ones(len(words), bool), all_of[:, 1:] != all_of[:, :-1]])
    return np.nonzero(new)[0], all_of[new]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and side (0, 1) of each fingerprint's join keys: those of two fingerprints within three bits meet, one on
    each side, whichever comes first.

    Of three segments with at most three errors, either one has none and one of the other two has at most one, or all
    have one. The first case has six kinds of keys, the bits of a segment and a codeword index of another: on side 0
    all near indices, on side 1 the decoded one. The last case has triples of indices: near ones of the first two
    segments on side 0, near ones of the third on side 1."""
    n = len(prints)
    rows = np.arange(n)
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [nearby(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    own = [decode(p) for p in parts]
    out = []
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        row, index = near[j]
        out.append((row, (kind << 40) | (parts[i][row] << 12) | index, 0))
        out.append((rows, (kind << 40) | (parts[i] << 12) | own[j], 1))
    (row_a, index_a), (row_b, index_b), (row_c, index_c) = near
    at_b, many = np.searchsorted(row_b, np.arange(n + 1)), np.bincount(row_b, minlength=n)
    repeats = many[row_a]
    both = np.repeat(row_a, repeats)
    nth = np.arange(len(both)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    second = index_b[at_b[both] + nth] if n else index_b
    out.append((both, (6 << 40) | (np.repeat(index_a, repeats) << 24) | (second << 12) | own[2][both], 0))
    out.append((row_c, (6 << 40) | (own[0][row_c] << 24) | (own[1][row_c] << 12) | index_c, 1))
    return tuple(np.concatenate(x) for x in zip(*((r, k, np.full(len(r), s, np.int8)) for r, k, s in out), strict=True))


def links(prints: DataFrame, within: int = 3) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in 1 to `within` (at most 3) bits, each once.

    `prints` has distinct values in `fingerprint`; a null has no partners. No bucket or candidate is dropped."""
    if not 0 <= within <= 3:
        raise ValueError("three segments find fingerprints within three bits")

    def keyed(side: int, name: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    values = batch.column("fingerprint").slice(start, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                    row, key, of = keys_of(values.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key[of == side]), pa.array(values[row[of == side]])], ["key", name])

        return prints.filter("fingerprint is not null").select("fingerprint").mapInArrow(run, f"key long, {name} long")

    left, right = keyed(0, "a"), keyed(1, "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= within
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has a link, from links a, b.

    Alternating large and small stars: each round links all greater neighbours of a node to its smallest one, then all
    smaller ones, until nothing changes; rounds grow with the logarithm of the longest chain. Each round is written to
    the shared folder."""

    def smallest(df: DataFrame) -> DataFrame:
        least = df.groupBy("u").agg(F.min("v").alias("m"))  # partial sums before the shuffle; a join can split a hub's links
        return df.join(least, "u").withColumn("m", F.least("u", "m"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    spark = edges.sparkSession
    now, folder = write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    was, is_ = None, mark(now)
    while was != is_:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = smallest(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        now, newer = write(small, "stars")
        discard(spark, folder)
        folder, was, is_ = newer, is_, mark(now)
    now = stage(now, "components")
    discard(spark, folder)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, words: int = 3, within: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest doc_id reachable over links between fingerprints of at most `within` differing bits,
    the document's own included; null only where every doc_id of the component is. Documents with one fingerprint are
    one node, so copies aren't expanded into pairs. Null text counts as empty; repeated rows stay; extra columns are
    ignored; no rows give no rows."""
    marked = stage(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "fingerprints")
    with scratch(docs.sparkSession) as temporary:
        prints = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
        found = components(links(prints, within))
        groups = found.join(prints, found["node"] == prints["fingerprint"]).select("node", "root", "least")
        least = groups.groupBy("root").agg(F.min("least").alias("root_least"))
        joined = groups.select("node", "root").join(least, "root").select("node", "root_least")
        named = prints.join(joined, prints["fingerprint"] == joined["node"], "left").select(
            "fingerprint", F.coalesce("root_least", "least").alias("component_id")
        )
        named = temporary.keep(named, "named")  # so that both sides of the join below are plain exchanges, which Spark can split
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
