"""N-gram language model by deleted interpolation: word bigrams, words and a uniform share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate.llm.common import discard, slices, stage, write

#: Bytes of text in a block, about. A block's words and pairs are looked up together.
BLOCK = 6 << 20
#: Keys of all blocks per bucket, about, when their counts meet: a task's work, and the more, the fewer pieces blocks are cut into.
BUCKET = 1 << 22
#: Blocks, or buckets, of which a task gets the rows. Tasks grow in number with the data, not in size.
PER_TASK = 2
#: Context counts are grouped by their binary logarithm, up to this one; group 0 is contexts not seen.
GROUPS = 24
#: Steps per octave of the grid on which shares are gathered for expectation-maximisation.
STEPS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _blob(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes, all lowest bytes first and all highest last, compressed: most are small."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _values(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _sorted_blob(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return _blob(np.diff(keys, prepend=np.uint64(0)))


def _sorted_values(blob: bytes) -> np.ndarray:
    return np.cumsum(_values(blob, np.uint64), dtype=np.uint64)


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A key of each pair of word hashes: 48 leading bits, 16 zeros. Of n distinct pairs about n / 2^49 share theirs with
    another, less than one in 500,000 for a thousand million; what such a pair's count gains changes no base score."""
    x = (left * _MIX) ^ (right + (left >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) & ~np.uint64(0xFFFF)


def _pairs(sizes: np.ndarray, tokens: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a block, as number of the word before * words + number of the word, ascending, and each
    token's pair among them."""
    before = np.concatenate([[0], tokens[:-1]])
    before[np.cumsum(sizes)[:-1]] = 0  # a text begins after an end
    return np.unique(before * words + tokens, return_inverse=True)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: ids (null: 0), named (not null), trains, sizes (tokens of each text), words (hashes), tokens (numbers
    of the words), all as bytes; how many tokens are to be learned from, and about how many distinct words and pairs there are.

    Tokens are words and one end per text, word number 0."""
    part_id, nth = TaskContext.get().partitionId(), 0
    names = ["block", "ids", "named", "trains", "sizes", "words", "tokens", "train_tokens", "keys"]
    digest = xxhash.xxh64_intdigest

    def emit(ids, trains, sizes, words, tokens):
        nonlocal nth
        sizes, trains = np.array(sizes, np.int64), np.array(trains, bool)
        learnt = int(sizes[trains].sum())
        named = np.array([x is not None for x in ids], bool)
        ids = np.array([x or 0 for x in ids], np.int64)
        hashes = np.fromiter(map(digest, words), np.uint64, len(words))
        row = [[(part_id << 32) + nth], [ids.tobytes()], [named.tobytes()], [trains.tobytes()], [_blob(sizes)], [_blob(hashes)], [_blob(np.concatenate(tokens))], [learnt], [len(words) + int(sizes.sum()) // 2]]
        nth += 1
        kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    ids, trains, sizes, words, tokens, size = [], [], [], {b"": 0}, [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            for doc, learn, text in zip(part.column("doc_id").to_pylist(), part.column("trains").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                number = [words.setdefault(w, len(words)) for w in (text or b"").lower().split()]
                number.append(0)
                tokens.append(np.array(number, np.uint32))
                ids.append(doc)
                trains.append(learn)
                sizes.append(len(number))
                size += len(text or b"")
                if size >= BLOCK:
                    yield emit(ids, trains, sizes, words, tokens)
                    ids, trains, sizes, words, tokens, size = [], [], [], {b"": 0}, [], 0
    if ids:
        yield emit(ids, trains, sizes, words, tokens)


class _Block:
    """A block's numbered words and pairs, each with its key, in the keys' order."""

    def __init__(self, sizes: bytes, words: bytes, tokens: bytes, trains: bytes) -> None:
        self.sizes = _values(sizes, np.int64)
        self.tokens = _values(tokens, np.uint32).astype(np.int64)
        self.trains = np.frombuffer(trains, bool)
        hashes = _values(words, np.uint64)
        codes, self.pair = _pairs(self.sizes, self.tokens, len(hashes))
        keys = _pair_keys(hashes[codes // len(hashes)], hashes[codes % len(hashes)])
        self.keys = {"word": hashes, "pair": keys}
        self.order = {kind: np.argsort(k, kind="stable") for kind, k in self.keys.items()}

    def learnt(self) -> np.ndarray:
        return np.repeat(self.trains, self.sizes)

    def counts(self, kind: str) -> np.ndarray:
        use = self.learnt()
        where = self.tokens if kind == "word" else self.pair
        return np.bincount(where[use], minlength=len(self.keys[kind]))

    def cuts(self, kind: str, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin in the keys' order; a bucket is the leading bits of a key."""
        bits = buckets.bit_length() - 1
        edges = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
        ordered = self.keys[kind][self.order[kind]]
        return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def _asked(buckets: int):
    """A row per block, kind and bucket: its keys, and how often the block has each in texts to learn from."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                block = _Block(row["sizes"], row["words"], row["tokens"], row["trains"])
                out = {"kind": [], "bucket": [], "block": [], "keys": [], "counts": []}
                for kind in ("word", "pair"):
                    order, cuts = block.order[kind], block.cuts(kind, buckets)
                    keys, counts = block.keys[kind][order], block.counts(kind)[order].astype(np.uint32)
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        span = slice(cuts[b], cuts[b + 1])
                        for name, value in zip(out, (kind, b, row["block"], _sorted_blob(keys[span]), _blob(counts[span])), strict=True):
                            out[name].append(value)
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """The total count of each key, for each block that asked, in the order asked; for block -1 the number of keys learnt."""
    asked = [_sorted_values(x) for x in group["keys"]]
    counts = np.concatenate([_values(x, np.uint32) for x in group["counts"]])
    distinct, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(x) for x in asked])[:-1]
    answers = [_blob(x) for x in np.split(total[at].astype(np.uint64), cuts)]
    kind, bucket = group["kind"].iloc[0], group["bucket"].iloc[0]
    return pd.DataFrame(
        {"kind": kind, "bucket": bucket, "block": [*group["block"], -1], "totals": [*answers, b""], "learnt": [0] * len(answers) + [int((total > 0).sum())]}
    )


#: A row per block, as _counted() makes it.
COUNTED = "block long, ids binary, named binary, trains binary, sizes binary, tokens binary, word binary, pair binary, learnt long"


def _counted(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A block's row with the total counts of its words, in their order, and of its pairs, in that of _pairs(). Block -1
    has the number of distinct words learnt."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    if not len(blocks):
        learnt = int(answers.loc[answers["kind"] == "word", "learnt"].sum())
        return pd.DataFrame([(-1, *[b""] * 7, learnt)], columns=names)
    out = []
    for row in blocks.itertuples():
        block = _Block(row.sizes, row.words, row.tokens, row.trains)
        totals = []
        for kind in ("word", "pair"):
            own = answers[answers["kind"] == kind].sort_values("bucket")
            total = np.empty(len(block.keys[kind]), np.uint64)
            total[block.order[kind]] = np.concatenate([_values(x, np.uint64) for x in own["totals"]])
            totals.append(_blob(total))
        out.append((row.block, row.ids, row.named, row.trains, row.sizes, row.tokens, *totals, 0))
    return pd.DataFrame(out, columns=names)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each block of a COUNTED table: its row, the texts' sizes, which are learned from, each token's pair, and of each
    pair the total counts of its word, of the word before and its own."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            sizes, word = _values(row["sizes"], np.int64), _values(row["word"], np.int64)
            codes, at = _pairs(sizes, _values(row["tokens"], np.uint32).astype(np.int64), len(word))
            counts = (word[codes % len(word)], word[codes // len(word)], _values(row["pair"], np.int64))
            yield row, sizes, np.frombuffer(row["trains"], bool), at, *counts


def _group(context: np.ndarray) -> np.ndarray:
    """The frequency group of a context's count."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), GROUPS), 0)


def _step(share: np.ndarray) -> np.ndarray:
    """A share's place on the logarithmic grid; -1 for none."""
    return np.where(share > 0, np.round(-STEPS * np.log2(np.where(share > 0, share, 1))).astype(np.int64), -1)


def _held_out(total_tokens: int):
    """How often each (group, pair share, word share) occurs among tokens to learn from when each is left out itself."""

    def run(batches):
        for _, sizes, trains, at, word, before, pair in _known(batches):
            learns = np.bincount(at[np.repeat(trains, sizes)], minlength=len(pair))
            use = learns > 0
            word, before, pair = word[use] - 1, before[use] - 1, pair[use] - 1
            cells = pd.DataFrame(
                {
                    "context": _group(before),
                    "pair": _step(pair / np.maximum(before, 1)),
                    "word": _step(word / max(total_tokens - 1, 1)),
                    "n": learns[use],
                }
            )
            yield pa.RecordBatch.from_pandas(cells.groupby(["context", "pair", "word"], as_index=False)["n"].sum(), preserve_index=False)

    return run


def mixture(cells: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of pair, word and uniform share for each context group, by expectation-maximisation. A group without
    tokens takes the next lower group's weights; group 0 has no pair share."""
    weights = np.tile([0.0, 0.7, 0.3], (GROUPS + 1, 1))
    shares = np.column_stack(
        [np.where(cells[c] >= 0, np.exp2(-cells[c].to_numpy(np.float64) / STEPS), 0.0) for c in ("pair", "word")] + [np.full(len(cells), uniform)]
    )
    for g in range(GROUPS + 1):
        own = (cells["context"] == g).to_numpy()
        if not own.any():
            weights[g] = weights[g - 1] if g else weights[g]
            continue
        p, n = shares[own], cells["n"].to_numpy(np.float64)[own]
        w = np.array([0.0, 0.5, 0.5] if g == 0 else [1 / 3] * 3)
        for _ in range(rounds):
            part = p * w
            w = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0)
            w = (w + [0.0 if g == 0 else 0.01, 0.01, 0.01]) / (w.sum() + (0.02 if g == 0 else 0.03))
        weights[g] = w
    return weights


def _scored(total_tokens: int, distinct: int, weights: np.ndarray):
    def run(batches):
        for row, sizes, trains, at, word, before, pair in _known(batches):
            w = weights[_group(before)]
            chance = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(total_tokens, 1) + w[:, 2] / (distinct + 1)
            base = (word + 1) / (total_tokens + distinct + 1)
            starts = np.cumsum(sizes) - sizes
            own, plain, known = (np.add.reduceat(x[at], starts) for x in (np.log10(chance), np.log10(base), (word > 0).astype(np.int64)))
            n = len(sizes)
            columns = [
                pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["named"], bool)),
                pa.array(~trains),
                pa.array(sizes),
                pa.array(known),
                pa.array(np.full(n, total_tokens, np.int64)),
                pa.array(plain),
                pa.array(own),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, trains: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents for which `trains` is true are learned from; null counts as true. A-Z are lower-cased; tokens are runs
    without white space of ASCII and one end per text, which is also the context of a text's first token. A null or
    empty text is an end. base_score is the sum of log10((c + 1) / (N + V + 1)), score that of the model's log10
    probabilities: the shares of the pair among pairs with its first word, of the word among all, and of 1 / (V + 1),
    mixed by weights that depend on the frequency group of the first word. Without any text to learn from N and V are 0.
    Repeated rows stay; extra columns are ignored; no rows give no rows.

    Texts are tokenised once, into blocks. Each block asks for the counts of its distinct words and pairs (64-bit hashes)
    in buckets of the hash; a bucket adds up what all blocks have and answers each. So what is shuffled is bounded by the
    distinct keys of a block, a frequent pair is one entry per block, and no table of counts is broadcast. A block and a bucket
    exchange one row, if they have keys in common. Blocks and their
    counts meet once, in a written table. The weights are learned from it, from all tokens to learn from, each left out of
    the counts itself, and all texts are scored from it, neither with another shuffle of blocks."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(trains, F.lit(True)).alias("trains"))
    blocks, folder = write(
        rows.mapInArrow(
            _tokenised,
            "block long, ids binary, named binary, trains binary, sizes binary, words binary, tokens binary, train_tokens long, keys long",
        ),
        "blocks",
    )
    total_tokens, keys, many = blocks.agg(F.sum("train_tokens"), F.sum("keys"), F.count(F.lit(1))).first()
    if total_tokens is None:
        return spark.createDataFrame([], SCHEMA)
    buckets = 1 << max(0, int(keys / BUCKET)).bit_length()
    asked = blocks.select("block", "trains", "sizes", "words", "tokens").mapInArrow(
        _asked(buckets), "kind string, bucket int, block long, keys binary, counts binary"
    )
    answers = asked.repartition(1 + 2 * buckets // PER_TASK, "kind", "bucket").groupBy("kind", "bucket").applyInPandas(_answered, "kind string, bucket int, block long, totals binary, learnt long")
    by_block = [df.repartition(1 + many // PER_TASK, "block").groupBy("block") for df in (blocks, answers)]
    counted = stage(by_block[0].cogroup(by_block[1]).applyInPandas(_counted, COUNTED), "counted")
    discard(spark, folder)
    distinct = counted.filter("block = -1").agg(F.sum("learnt")).first()[0]
    counted = counted.filter("block >= 0")
    cells = counted.select("trains", "sizes", "tokens", "word", "pair").mapInArrow(_held_out(total_tokens), "context long, pair long, word long, n long")
    cells = cells.groupBy("context", "pair", "word").agg(F.sum("n").alias("n")).toPandas()
    weights = mixture(cells, 1 / (distinct + 1))
    return counted.mapInArrow(_scored(total_tokens, distinct, weights), SCHEMA)
