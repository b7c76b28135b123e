"""Near-duplicates at a given similarity of word shingles: SimHash segments decoded to nearby Golay codewords give keys, texts
that share a key are candidates, and each link is checked exactly."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import flat, fresh, scratch, slices, stage
from docgate.llm.simhash import codewords, components, decode, folded_words, shingle_hashes

#: Codewords looked at of a segment, of those that it and it with some of its least certain bits changed are decoded to.
NEAR, SINGLE, DOUBLE = 4, 10, 4
#: Keys of a table that each text has.
PROBES = {2: 6, 3: 12}
#: Bits of a key below the number of its table.
KEY_BITS = 40
#: Up to so many texts two segments make a key of 24 bits; beyond, three make one of 36.
TWO_SEGMENTS = 1 << 23
#: A pair at the threshold shares no key with this probability at most.
MISS = 0.004
#: Fingerprints of 128 bits of a pair at the threshold differ in more bits than so many standard deviations above the mean
#: about once in 200,000 times; such a pair isn't checked.
DEVIATIONS = 4.4
#: A bucket of so many texts at most is looked at in one row; in larger ones a few meet all others at a time.
SMALL = 32
#: A node that meets more others than this in small buckets of several groups meets those like it by rare shingles.
BUSY = 24
#: Parts (a power of two) of all rare shingles by which two nodes are compared before their texts are.
PARTS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Eight lanes of a byte each, holding the bits of a byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def names_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's words, A-Z lower-cased and joined by single blanks; texts without words share them."""
    text, begin, end, word_at = folded_words(data, offsets)
    full = np.flatnonzero(np.diff(word_at))
    none = xxhash.xxh3_128_intdigest(b"", 5)
    out = np.empty((len(offsets) - 1, 2), np.uint64)
    out[:] = none & (1 << 64) - 1, none >> 64
    pairs = zip(begin[word_at[full]].tolist(), end[word_at[full + 1] - 1].tolist(), strict=True)
    digests = b"".join(xxhash.xxh3_128_intdigest(text[a:b], 5).to_bytes(16, "little") for a, b in pairs)
    out[full] = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return out


def sums_of(hashes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """For each set of hashes and each of `bits` bits of a fingerprint: how many more of the hashes have the bit than not.

    Bits are added in lanes of a byte, so many hashes at a time as a byte can count."""
    first = np.cumsum(counts) - counts
    cuts = -(-counts // 255)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    parts = np.repeat(first, cuts) + 255 * nth
    out = np.empty((len(counts), -(-bits // 64) * 64), np.int64)
    for word in range(out.shape[1] // 64):
        mixed = (hashes ^ np.uint64((word + 1) * int(_MIX) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        lanes = np.add.reduceat(_LANES[mixed.view(np.uint8).reshape(-1, 8)], parts, axis=0)
        out[:, 64 * word : 64 * word + 64] = np.add.reduceat(lanes.view(np.uint8).astype(np.int64), np.cumsum(cuts) - cuts, axis=0)
    return (2 * out - counts[:, None])[:, :bits]


def nearby_codewords(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the NEAR codewords closest to each segment (23 sums) and how well they agree, the best first; fewer than that
    are filled up with an agreement of minus infinity.

    The word of the sums' signs is decoded as it is, with one of its SINGLE least certain bits changed, and with two of
    its DOUBLE ones; agreement is the sum of the sums with the codeword's signs."""
    signs = codewords()
    order = np.argsort(np.abs(sums), axis=1, kind="stable")
    unit = np.int64(1) << order
    word = ((sums > 0) * (np.int64(1) << np.arange(23))).sum(axis=1)
    tried = [word, *(word ^ unit[:, i] for i in range(SINGLE)), *(word ^ unit[:, i] ^ unit[:, j] for i in range(DOUBLE) for j in range(i))]
    index = np.sort(np.stack([decode(w) for w in tried], axis=1), axis=1)
    agree = np.einsum("ikb,ib->ik", signs[index], sums.astype(np.float32))
    agree[:, 1:][index[:, 1:] == index[:, :-1]] = -np.inf
    best = np.argsort(-agree, axis=1, kind="stable")[:, :NEAR]
    return np.take_along_axis(index, best, axis=1), np.take_along_axis(agree, best, axis=1)


def keys_of(sums: np.ndarray, segments: int) -> np.ndarray:
    """The join keys of each text, PROBES for each table: the combinations of codewords near the table's segments that agree
    best. `sums` has 23 columns for each of `segments` segments of each table."""
    rows, probes, out = len(sums), PROBES[segments], []
    for table in range(sums.shape[1] // (23 * segments)):
        key, agree = np.zeros((rows, 1), np.int64), np.zeros((rows, 1), np.float32)
        for s in range(segments):
            at = 23 * (table * segments + s)
            index, more = nearby_codewords(sums[:, at : at + 23])
            key = (key[:, :, None] << 12 | index[:, None, :]).reshape(rows, -1)
            agree = (agree[:, :, None] + more[:, None, :]).reshape(rows, -1)
            best = np.argsort(-agree, axis=1, kind="stable")[:, :probes]
            key, agree = np.take_along_axis(key, best, axis=1), np.take_along_axis(agree, best, axis=1)
        out.append(np.where(np.isfinite(agree), key, key[:, :1]) | table << KEY_BITS)
    return np.concatenate(out, axis=1)


def _cosine(percent: int) -> float:
    """The least cosine of the indicator vectors of two sets whose Jaccard similarity is `percent`, that of sets of one size."""
    return 2 * percent / (100 + percent)


@lru_cache
def tables_for(percent: int, segments: int) -> int:
    """How many tables a pair at the threshold needs to share a key but with probability MISS: a table's share is counted on
    4096 drawn pairs of sums with the correlation that such a pair has."""
    draw, cosine = np.random.default_rng(9), _cosine(percent)
    a = draw.normal(size=(4096, 23 * segments))
    b = cosine * a + math.sqrt(1 - cosine * cosine) * draw.normal(size=a.shape)
    met = (keys_of(a, segments)[:, :, None] == keys_of(b, segments)[:, None, :]).any(axis=(1, 2)).mean()
    return 1 if met == 1 else math.ceil(math.log(MISS) / math.log(1 - met))


def apart_at_most(percent: int, bits: int = 128) -> int:
    """Differing bits of two fingerprints of so many bits up to which a pair is checked."""
    share = math.acos(_cosine(percent)) / math.pi
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def distinct_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes(), each once in a text, ascending."""
    hashes, many = shingle_hashes(data, offsets, words)
    text = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(many))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of `percent` or more."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (small + large - both)


def _marked(docs: DataFrame, names: tuple[str, str, str, str], words: int, percent: int, segments: int, named) -> DataFrame:
    """docs with its node and a check of it (names_of its text), fingerprint (two numbers of 64 bits, and how many shingles it is of) and
    keys, each once; no keys for a text without words. No shuffle."""
    tables = tables_for(percent, segments)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                hashes, many = distinct_hashes(data, offsets, words)
                full = np.flatnonzero(many)
                prints, ends, keys = np.zeros((len(many), 3), np.int64), np.zeros(len(many) + 1, np.int32), np.zeros(0, np.int64)
                prints[:, 2] = many
                if len(full):
                    sums = sums_of(hashes, many[full], 128 + 23 * segments * tables)
                    prints[full, :2] = np.packbits(sums[:, :128] > 0, axis=1, bitorder="little").view("<i8")
                    own = np.sort(keys_of(sums[:, 128:], segments), axis=1)
                    new = np.column_stack([np.ones(len(own), bool), own[:, 1:] != own[:, :-1]])
                    keys, held = own[new], np.zeros(len(many), np.int64)
                    held[full] = new.sum(axis=1)
                    ends[1:] = np.cumsum(held)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
                own = named(data, offsets).view(np.int64)
                node, check = (pa.array(np.ascontiguousarray(own[:, i])) for i in (0, 1))
                print_ = pa.FixedSizeListArray.from_arrays(pa.array(prints.reshape(-1)), 3).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, node, check, print_, lists], [*part.schema.names, *names])

    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def _checked(pairs: DataFrame, docs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Those of the pairs a, b of nodes whose texts are similar, with a text of each node from docs (node, text)."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stage(docs.join(asked, "node").groupBy("node").agg(F.min("text").alias("text")), f"{name}_texts")
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def sets(column):
        hashes, many = distinct_hashes(*flat(column), words)
        return np.split(hashes, np.cumsum(many)[:-1])

    def run(batches):
        for batch in batches:
            for half in slices(batch, "text_a"):
                for part in slices(half, "text_b"):
                    take = [similar(x, y, percent) for x, y in zip(sets(part.column("text_a")), sets(part.column("text_b")), strict=True)]
                    yield part.select(["a", "b"]).filter(pa.array(take, pa.bool_()))

    return stage(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), name)


def _place(node: str) -> Column:
    """A node's place in [0, 1), by hash: those below a share of it are drawn from every bucket alike."""
    return F.pmod(F.xxhash64(F.lit(4), F.col(node)), F.lit(1 << 40)) / float(1 << 40)


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether two structs of node, high, low and n may be similar, by their numbers of shingles and their fingerprints."""
    sizes = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    limit = apart_at_most(percent)
    return sizes & (F.bit_count(a["high"].bitwiseXOR(b["high"])) + F.bit_count(a["low"].bitwiseXOR(b["low"])) <= limit)


def _shared(nodes: DataFrame, percent: int) -> DataFrame:
    """key, size and x (a struct of place, node, high, low, n) of the nodes that may have a link in the bucket of a key.

    Keys, nodes and half of a fingerprint are gathered, of each key SMALL + 1 at most, to which each task cuts before the shuffle. A bucket
    that is whole in that keeps the nodes that have another one near by that half, and of these, by whole fingerprints that follow, those
    that still have; so what goes on doesn't grow with chance meetings. Larger buckets are joined again, whole."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "high")
    first = Window.partitionBy("key").orderBy("node")
    lists = keyed.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SMALL + 1)
    lists = lists.groupBy("key").agg(F.collect_list(F.struct("node", "high")).alias("xs")).filter(F.size("xs") > 1)
    half = apart_at_most(percent, 64)
    alike = F.filter("xs", lambda a: F.exists("xs", lambda b: (a["node"] != b["node"]) & (F.bit_count(a["high"].bitwiseXOR(b["high"])) <= half)))
    lists = lists.select("key", F.size("xs").alias("size"), F.when(F.size("xs") <= SMALL, alike).otherwise(F.slice("xs", 1, 1)).alias("xs"))
    met = stage(lists.select("key", "size", F.explode("xs").alias("x")).select("key", "size", "x.node"), "met")
    who = nodes.select("node", F.struct("place", "node", "high", "low", "n").alias("x"))
    meets = F.filter("xs", lambda a: F.exists("xs", lambda b: (a["node"] != b["node"]) & _near(a, b, percent)))
    small = met.filter(F.col("size") <= SMALL).join(who, "node").groupBy("key").agg(F.collect_list("x").alias("xs"))
    small = small.select("key", meets.alias("xs")).select("key", F.size("xs").alias("size"), F.explode("xs").alias("x"))
    large = met.filter(F.col("size") > SMALL).select("key").distinct()
    if large.isEmpty():
        return stage(small, "shared")
    whole = stage(keyed.select("key", "node").join(large, "key"), "large")
    counts = whole.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return stage(small.unionByName(whole.join(counts, "key").join(who, "node").select("key", "size", "x")), "shared")


def _rare(shared: DataFrame, texts: DataFrame, hard: DataFrame, words: int, percent: int) -> DataFrame:
    """key, size and x like _shared(), for the nodes `hard`, with rare shingles as keys: of all pairs of similar nodes both have a key in
    common whose caps allow the pair, whereas nodes that share nothing but what many have, such as a long passage, have none.

    A node's shingles are put in one order, the rarest among these nodes first. Two sets have no more in common than what is left of
    either from their first common shingle on. Let a set of size n have i before it and the overlap that a similarity s takes be
    s (n + m) / (1 + s): what is left of it, n - i, is enough if m <= (n - (1 + s) i) / s, its cap. So each size is the other one's cap at
    most; the smaller set's cap is its own size or more there, and a key with a cap below s n, the least size of a partner, joins nobody.
    A key leaves the nodes whose cap is below the sizes of all that can be the smaller set in it; the others get it with their
    cap and with `parts`: how many shingles that other nodes have, too, they have in each of PARTS parts of all. Two sets
    have no more in common than the lesser number of each part, so sets that lack different shingles of one passage are told apart."""
    chosen = texts.join(hard, "node").groupBy("node").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, many = distinct_hashes(*flat(part.column("text")), words)
                own = np.repeat(part.column("node").to_numpy(), many)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.repeat(many, many)), pa.array(hashes.view(np.int64))], ["node", "n", "key"])

    sets = stage(chosen.mapInArrow(run, "node long, n long, key long"), "sets")
    common = sets.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    known = sets.join(common, "key")  # shingles of one node alone come first and need no rows of their own
    part = F.col("key").bitwiseAND(PARTS - 1)
    parts = known.groupBy("node").agg(F.array(*(F.count_if(part == i).cast("int") for i in range(PARTS))).alias("parts"))
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    rank = alone + F.row_number().over(Window.partitionBy("node").orderBy("held", "key"))
    known = known.withColumn("before", rank - 1).withColumn("cap", F.floor((100 * F.col("n") - (100 + percent) * F.col("before")) / percent))
    known = stage(known.filter(100 * F.col("cap") >= percent * F.col("n")).select("key", "node", "n", "cap"), "known")
    least = known.filter("cap >= n").groupBy("key").agg(F.min("n").alias("least"))
    known = known.join(least, "key").filter("cap >= least").drop("least")
    size = known.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("size")).filter("size > 1")
    who = shared.select(F.col("x.node").alias("node"), "x").distinct().join(parts, "node")
    return stage(known.join(size, "key").join(who, "node").select("key", "size", "x", "cap", "parts"), "rare")


def similar_groups(nodes: DataFrame, texts: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """node and root of each node that is linked to another one, over links of a similarity of `percent` or more.

    `nodes` has node, place, high, low (its fingerprint), n (its shingles) and keys, a row per node; `texts` node and text. In the buckets of the
    first table all nodes meet the one with the smallest place, then in those of all tables, nodes of other groups than its
    own alone; so a group of near copies costs a few pairs a copy. Nodes of large buckets that are of several groups still get
    their rare shingles as keys instead, since those of a bucket may share no more than a passage that many have. Then, in
    buckets whose nodes are of several groups, those with the next places, eight or so, meet all nodes of other groups, then 512,
    and so on until all have: every pair of a bucket is compared, unless a chain of links already joins it. Pairs whose fingerprints are far apart aren't checked."""
    shared = _shared(nodes, percent)
    lead = shared.groupBy("key").agg(F.min("x").alias("lead"))
    asked = shared.select("x.node").distinct()  # all that is checked from here on: other texts move no more
    texts = stage(texts.join(asked, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    roots, checked = None, None

    def grouped(pairs: DataFrame, name: str) -> None:
        """Checks pairs (a, b) that haven't been, and joins the groups that their links touch."""
        nonlocal roots, checked
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stage(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), f"{name}_pairs")
        if pairs.isEmpty():
            return
        checked = pairs if checked is None else checked.unionByName(pairs)
        links = _checked(pairs, texts, words, percent, f"{name}_links")
        if links.isEmpty():
            return
        if roots is None:
            roots = stage(components(links), "groups")
            return
        for end in ("a", "b"):  # groups are nodes now, and few
            of = roots.select(F.col("node").alias(end), "root")
            links = links.join(of, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        whole = components(links.filter("a <> b").distinct()).withColumnRenamed("root", "whole")
        whole = stage(whole, "joined")
        moved = roots.join(whole.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("whole", "root").alias("root"))
        new = whole.join(roots, "node", "left_anti").select("node", F.col("whole").alias("root"))
        roots = stage(moved.unionByName(new), "groups")

    def rooted(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("node", F.col("x.node"))
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def mixed(rows: DataFrame) -> DataFrame:
        now = rooted(rows)
        several = now.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
        return stage(now.join(several, "key"), "mixed")

    star = (F.col("node") != F.col("lead.node")) & _near(F.col("x"), F.col("lead"), percent)
    one = shared.filter(F.shiftright("key", KEY_BITS) == 0).withColumn("node", F.col("x.node")).join(lead, "key").filter(star)
    grouped(one.select(F.col("lead.node").alias("a"), F.col("node").alias("b")), "first")
    every = mixed(shared).join(lead, "key")
    if roots is not None:
        of = roots.select(F.col("node").alias("lead_node"), F.col("root").alias("lead_root"))
        every = every.withColumn("lead_node", F.col("lead.node")).join(of, "lead_node", "left").filter(F.coalesce("lead_root", F.col("lead.node")) != F.col("root"))
    grouped(every.filter(star).select(F.col("lead.node").alias("a"), F.col("node").alias("b")), "stars")
    rows = shared.filter(F.col("size") <= SMALL)
    rows = rows.withColumns({"cap": F.lit(None).cast("long"), "parts": F.lit(None).cast("array<int>"), "hard": F.lit(False)})
    crowded = mixed(shared.filter(F.col("size") > SMALL)).select("node")
    busy = mixed(rows).groupBy("node").agg(F.sum(F.col("size") - 1).alias("others")).filter(F.col("others") > BUSY).select("node")
    hard = stage(crowded.unionByName(busy).distinct(), "hard")
    if not hard.isEmpty():
        rows = rows.drop("hard").withColumn("node", F.col("x.node")).join(hard.withColumn("hard", F.lit(True)), "node", "left").drop("node")
        rows = rows.withColumn("hard", F.coalesce("hard", F.lit(False)))
        rows = stage(rows.unionByName(_rare(shared, texts, hard, words, percent).withColumn("hard", F.lit(False))), "rows")
    met, leads = 0, 8
    while True:
        now = mixed(rows.filter(F.col("size") > met))
        if now.isEmpty():
            break
        nth = F.col("x.place") * F.col("size")
        other = {"y": F.col("x"), "other": F.col("root"), "both": F.col("hard"), "their_cap": F.col("cap"), "their_parts": F.col("parts")}
        drawn = now.filter((nth >= met) & (nth < leads)).select("key", *(c.alias(name) for name, c in other.items()))
        apart = (F.col("hard") & F.col("both")) | (F.col("root") == F.col("other"))
        common = F.aggregate(F.zip_with("parts", "their_parts", lambda a, b: F.least(a, b)), F.lit(0), lambda total, n: total + n)
        enough = (100 + percent) * common >= percent * (F.col("x.n") + F.col("y.n"))
        fits = F.col("cap").isNull() | ((F.col("x.n") <= F.col("their_cap")) & (F.col("y.n") <= F.col("cap")) & enough)
        pairs = now.join(drawn, "key").filter(~apart & (F.col("x") > F.col("y")) & _near(F.col("x"), F.col("y"), percent) & fits)
        grouped(pairs.select(F.col("y.node").alias("a"), F.col("node").alias("b")), "more")
        met, leads = leads, leads * 64
    return roots if roots is not None else shared.select(F.col("x.node").alias("node"), F.col("x.node").alias("root")).limit(0)


def drop_similar(docs: DataFrame, words: int = 5, percent: int = 80, named=names_of) -> DataFrame:
    """docs with one row of each group of similar texts: the one with the smallest doc_id, null coming last.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is `percent` or more (A-Z lower-cased, words
    apart by white space of ASCII; a text of fewer words has one shingle of them all); a group is what links join.
    Texts of the same words are one node, by a hash of 128 bits, of which 64 name the node (`named`; two nodes that have these in common
    are told apart); null and texts without words are one, too. A pair at the threshold shares a key, and
    so is found, but with probability MISS; pairs above it are missed less often. Rows are decided on, not identifiers:
    where a doc_id stands on several texts, each is judged for itself; of repeated rows one stays. Columns are unchanged;
    no rows give no rows."""
    node, check, print_, keys = (fresh(docs, c) for c in ("node", "check", "print", "keys"))
    identifier = F.col("doc_id").cast("long").alias("doc_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    segments = 2 if docs.count() <= TWO_SEGMENTS else 3
    marked = stage(_marked(docs, (node, check, print_, keys), words, percent, segments, named), "marked")
    several = marked.groupBy(node).agg(F.min(check).alias("least"), F.max(check).alias("most")).filter("least < most").drop("most")
    several = several.withColumnsRenamed({node: "_node", "least": "_least"})
    if not several.isEmpty():  # about once in 10^19 / n^2 tables of n texts
        other = F.col("_least").isNotNull() & (F.col(check) != F.col("_least"))
        marked = marked.join(F.broadcast(several), F.col(node) == F.col("_node"), "left")
        marked = stage(marked.withColumn(node, F.when(other, F.xxhash64(node, check)).otherwise(F.col(node))).drop("_node", "_least"), "marked")
    with scratch(docs.sparkSession) as temporary:
        nodes = marked.groupBy(F.col(node).alias("node")).agg(F.first(print_).alias("print"), F.first(keys).alias("keys"))
        nodes = stage(nodes.select(_place("node").alias("place"), "node", F.get("print", 0).alias("high"), F.get("print", 1).alias("low"), F.get("print", 2).alias("n"), "keys"), "nodes")
        groups = similar_groups(nodes, marked.select(F.col(node).alias("node"), "text"), words, percent)
        rows = marked.groupBy(F.col(node).alias("node"), identifier).agg(F.count(F.lit(1)).alias("many"))
        rows = rows.join(groups, "node", "left").select("node", "doc_id", "many", F.coalesce("root", "node").alias("root"))
        rows = temporary.keep(rows, "rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    best = rows.groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("of")).filter("of > 1")
    gone = rows.join(best, "root").filter(~place.eqNullSafe(F.col("best"))).select("node", "doc_id")
    again = rows.filter("many > 1").select("node", "doc_id")

    def without(df: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        pairs = pairs.select(F.col("node").alias("_node"), F.col("doc_id").alias("_doc_id"))
        return df.join(pairs, (F.col(f"`{node}`") == pairs["_node"]) & F.col("doc_id").cast("long").eqNullSafe(pairs["_doc_id"]), how)

    kept = without(marked, gone, "left_anti")
    if not again.isEmpty():
        one = without(kept, again, "left_semi").groupBy(node, "doc_id").agg(F.min_by(F.struct(*columns), F.col("text")).alias("row"))
        kept = without(kept, again, "left_anti").select(*columns).unionByName(one.select("row.*"))
    return kept.select(*columns)
