"""Language identification by prediction by partial matching with frozen byte statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import slices

#: What bytes are read as: letters of ASCII as they are, other ASCII as a blank, all others as they are.
_READ = np.arange(256, dtype=np.uint8)
_READ[:128] = 0x20
_READ[97:123] = np.arange(97, 123)
UNKNOWN = "und"
#: Bytes that are looked up at a time.
WINDOW = 1 << 20


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, lower-cased, runs of what isn't a letter of ASCII or beyond ASCII as one blank, with a zero
    byte and a blank before each; and where each text begins, its zero byte included, with the end as last entry."""
    parts = [b" " + t.lower().encode() for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    data = _READ[np.frombuffer(b"\0" + b"\0".join(parts), np.uint8)] if parts else np.zeros(0, np.uint8)
    begin = np.cumsum(sizes) - sizes
    data[begin] = 0
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    held = np.add.reduceat(kept, begin, dtype=np.int64) if parts else sizes
    return data[kept], np.concatenate([[0], np.cumsum(held)])


@dataclass(frozen=True)
class Model:
    """The context trees of all languages, laid over each other. langs; classes: byte -> class, 0 for bytes not learned and for
    the start of a text; child: context * width + class of the byte before -> longer context that some language has, the upper
    half of the numbers being those that can't grow; bits: context * width + class of a byte -> its code length under each
    language, by the longest part of the context that this language's own tree has."""

    langs: tuple[str, ...]
    order: int
    classes: np.ndarray
    width: int
    child: np.ndarray
    bits: np.ndarray

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        data, begin = normalised(texts)
        for at in range(0, len(data), WINDOW):  # a long text goes through in windows, each with the bytes before it
            low = max(0, at - self.order)
            own = self.classes[data[low : at + WINDOW]].astype(np.int32)
            node = np.zeros(len(own), np.int32)
            for k in range(1, self.order + 1):
                back = np.zeros(len(own), np.int32)
                back[k:] = own[:-k]
                node = self.child[node * self.width + back]
            node %= len(self.bits) // self.width
            cost = self.bits[node * self.width + own][at - low :]
            text, stop = np.searchsorted(begin, [at, at + len(cost) - 1], side="right") - 1
            starts = begin[text : stop + 1] - at  # of the texts in this window; the first may have begun before it
            cost[starts[starts >= 0]] = 0
            out[text : stop + 1] += np.add.reduceat(cost, np.maximum(starts, 0), axis=0, dtype=np.float64)
        return out


def _counts(order: int):
    """How often each byte follows each context of up to `order` bytes, by language."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    data, _ = normalised([t or "" for t, own in zip(part.column("text").to_pylist(), langs, strict=True) if own == lang])
                    for at in range(0, len(data), WINDOW):
                        low = max(0, at - order)
                        wide = data[low : at + WINDOW].astype(np.int64)
                        key, clean = wide.copy(), wide != 0
                        for k in range(order + 1):  # k bytes of context, the nearest lowest but for the byte itself
                            if k:
                                key = key[1:] | (wide[: len(wide) - k] << (8 * k))
                                clean = clean[1:] & (wide[: len(wide) - k] != 0)
                            new = max(at - low - k, 0)  # those before were counted in the window before
                            keys, n = np.unique(key[new:][clean[new:]], return_counts=True)
                            rows = len(keys)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([lang] * rows, pa.string()), pa.array([k] * rows, pa.int32()), pa.array(keys), pa.array(n.astype(np.int64))],
                                ["lang", "k", "key", "n"],
                            )

    return run


def train(docs: DataFrame, order: int = 4, sample: int = 1000, contexts: int | None = 8192, seed: int = 8) -> Model:
    """Learn from the text and lang of docs; rows where either is null don't count.

    About `sample` documents of each language are read whole, chosen by a hash of doc_id: the bound on what the model is
    fitted on, whatever the size of docs. Strings of up to order + 1 bytes are counted by Spark. Each language has a tree of its
    own, of its `contexts` most frequent contexts (ties: the shorter, then the smaller ones), of all if that is None; the driver
    gets their counts. Repeated rows count as often as they stand. Without labelled texts the model knows no language."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {lang: n for lang, n in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model((), order, np.zeros(256, np.uint8), 1, np.zeros(2, np.int32), np.zeros((1, 0), np.float32))
    langs = tuple(sorted(sizes))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))])
    counted = known.filter(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_counts(order), "lang string, k int, key long, n long")
    counted = counted.groupBy("lang", "k", "key").agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("key", 8))
    if contexts is not None:
        top = counted.groupBy("lang", "k", "context").agg(F.sum("n").alias("all"))
        first = Window.partitionBy("lang").orderBy(F.desc("all"), "k", "context")
        top = top.withColumn("nth", F.row_number().over(first)).filter((F.col("nth") <= contexts) | (F.col("k") == 0))
        counted = counted.join(top.select("lang", "k", "context"), ["lang", "k", "context"])
    return _tree(langs, order, counted.select("lang", "k", "key", "n").toPandas())


def _own_tree(order: int, rows, classes: np.ndarray, width: int) -> tuple[dict, np.ndarray]:
    """The contexts (length, bytes) of one language, numbered, and the share of each class of a byte after each."""
    levels = rows["k"].to_numpy(np.int64), rows["key"].to_numpy(np.int64)
    nodes = {(0, 0): 0}
    for k, context in sorted({(k, key >> 8) for k, key in zip(*(x.tolist() for x in levels), strict=True)}):
        if k and (k - 1, context & ((1 << (8 * (k - 1))) - 1)) in nodes:  # a context stands under its nearest bytes; those without it are left out
            nodes[k, context] = len(nodes)
    at = np.array([nodes.get((k, key >> 8), -1) for k, key in zip(*(x.tolist() for x in levels), strict=True)], np.int64)
    counts = np.zeros((len(nodes), width))
    np.add.at(counts, (at[at >= 0], classes[levels[1][at >= 0] & 0xFF]), rows["n"].to_numpy()[at >= 0])
    chance = np.empty_like(counts)
    for (k, context), node in nodes.items():
        own = counts[node]
        lower = chance[nodes[k - 1, context & ((1 << (8 * (k - 1))) - 1)]] if k else np.full(width, 1 / width)
        met = own > 0
        total = own.sum()
        if not total:
            chance[node] = lower
            continue
        rest = lower[~met].sum()  # what shorter contexts give to bytes not met here
        kinds = met.sum() if rest > 0 else 0
        escape = kinds / (total + kinds)
        chance[node] = np.where(met, (1 - escape) * own / total, escape * lower / (rest or 1))
    return nodes, chance


def _tree(langs: tuple[str, ...], order: int, rows) -> Model:
    seen = sorted(set((rows["key"] & 0xFF).tolist()) - {0})
    classes = np.zeros(256, np.uint8)
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    trees = [_own_tree(order, rows[rows["lang"] == lang], classes, width) for lang in langs]
    every = {context: i for i, context in enumerate(sorted({c for nodes, _ in trees for c in nodes}))}
    size = len(every)
    child = np.repeat(np.arange(size, 2 * size), width).reshape(size, width)
    own = np.zeros((size, len(langs)), np.int64)  # the number of the longest part of each context that a language has
    for (k, context), node in every.items():
        if k:
            parent = every[k - 1, context & ((1 << (8 * (k - 1))) - 1)]
            child[parent, classes[context >> (8 * (k - 1))]] = node
            own[node] = own[parent]
        for at, (nodes, _) in enumerate(trees):
            own[node, at] = nodes.get((k, context), own[node, at])
    child = np.concatenate([child, child * 0 + np.arange(size, 2 * size)[:, None]])
    bits = np.stack([-np.log2(np.maximum(chance, 1e-300)).astype(np.float32)[own[:, at]] for at, (_, chance) in enumerate(trees)], axis=2)
    return Model(langs, order, classes, width, child.astype(np.int32).reshape(-1), bits.reshape(size * width, len(langs)))


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of docs and the two named `lang` and `score`.

    `lang` is the language under which the text's code is shortest (ties: the first by name), `und` where the text is
    null or has no letter, and null for other texts if the model knows no language. `score` is that language's share of the probability of the text, 0 for `und`. Columns that are
    named so already are replaced; other columns and repeated rows pass through; no rows give no rows. No shuffle; whole texts are
    read in parts of about a megabyte."""
    rest = docs.drop(lang, score)
    names = rest.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        langs = np.array(own.langs, object)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("").to_pylist()
                real = np.array([_has_letter(t) for t in texts], bool)
                if len(langs):
                    lengths = own.lengths(texts)
                    less = np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000))
                    share = 1 / less.sum(axis=1)
                    found = np.where(real, langs[lengths.argmin(axis=1)], UNKNOWN)
                else:
                    share, found = np.zeros(len(texts)), np.where(real, None, UNKNOWN)
                columns = [*part.columns, pa.array(found.tolist(), pa.string()), pa.array(np.where(real, share, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, [*names, lang, score])

    fields = [*rest.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return rest.mapInArrow(run, T.StructType(fields))
