"""Ranked lexical search: the documents that answer each item best, by weighted terms, found by a threshold-seeded join."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgate.llm.common import flat, stage

#: Distinct terms of items that one pass over the documents looks for; more are looked for in more passes.
TERMS_AT_ONCE = 200_000
#: Rows of items' terms that are sent to every task; more are joined by a shuffle.
SENT_AT_MOST = 200_000
#: Bytes of a text that are split at a time.
WINDOW = 1 << 20
#: Letters and digits of ASCII (A-Z in lower case) and all bytes above stand; the rest separates.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(text: bytes) -> Counter:
    """How often each term occurs in a text, split in windows that end between terms."""
    text, counts, start = text.translate(_KEPT), Counter(), 0
    while start < len(text):
        end = text.find(b" ", start + WINDOW)
        end = len(text) if end < 0 else end
        counts.update(text[start:end].split())
        start = end
    return counts


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, repeats: the terms of items (item_id, text). Rows of one item_id are one item; null has no term."""

    def count(batches):
        for batch in batches:
            data, starts = flat(batch.column("text"))
            at, terms, repeats = [], [], []
            for i in range(batch.num_rows):
                counts = _counted(data[starts[i] : starts[i + 1]].tobytes())
                at += [i] * len(counts)
                terms += [t.decode() for t in counts]
                repeats += counts.values()
            columns = [batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(repeats, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "repeats"])

    kind = items.schema["item_id"].dataType.simpleString()
    each = items.select("item_id", "text").mapInArrow(count, f"item_id {kind}, term string, repeats long")
    return each.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def _postings(docs: DataFrame, ids: dict[bytes, int], totals: bool) -> DataFrame:
    """tid, row, doc_id, tf, n: occurrences in each document of the terms that have an id here. With totals, also a row of tid -1
    for each batch: the number of its terms as tf, of its documents that have one as n."""

    def count(batches):
        for batch in batches:
            data, starts = flat(batch.column("text"))
            at, tids, tfs, ns, terms, some = [], [], [], [], 0, 0
            for i in range(batch.num_rows):
                counts = _counted(data[starts[i] : starts[i + 1]].tobytes())
                n = counts.total()
                terms, some = terms + n, some + (n > 0)
                hits = counts.keys() & ids.keys()
                at += [i] * len(hits)
                ns += [n] * len(hits)
                tids += [ids[t] for t in hits]
                tfs += [counts[t] for t in hits]
            if totals:
                at, tids, tfs, ns = [*at, None], [*tids, -1], [*tfs, terms], [*ns, some]
            at = pa.array(at, pa.int64())
            columns = [pa.array(tids, pa.int64()), batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(tfs, pa.int64()), pa.array(ns, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["tid", "row", "doc_id", "tf", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"tid long, row long, doc_id {kind}, tf long, n long")


def _best(postings: DataFrame, k: int, parts: int = 64) -> DataFrame:
    """The k postings of each term with the largest share; a term's postings are first ranked in parts."""
    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("share"), "row"))
        return rows.withColumn("place", place).filter(F.col("place") <= k)

    each = postings.select("tid", "row", "share").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    return ranked(ranked(each, "tid", "part").drop("place"), "tid")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) that score highest for each item (item_id, text).

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case; null has none. A term's
    weight and a document's score are those of the formulas in the code, in whole numbers. Only scores above 0 count; equal ones
    stand by doc_id, null last. Each row of docs is a document, also where a doc_id is repeated; rows of one item_id are one
    item. Other columns don't matter. Empty tables give no rows.

    Postings are made for the items' terms alone. For each term its k largest shares are stored. An item's threshold is the k-th
    largest sum that documents reach by stored postings: no less than its best term's k-th, and no more than the k-th score. An item's
    terms in the order of what they can add at most are left out while all those left out together stay below the threshold; the
    others give candidates. Of these go, before they are scored, those that stay below it with all that the terms left out can add.
    The rest is scored on all terms. Documents are never sent; an item's terms are, while they are at most SENT_AT_MOST rows."""
    asked = stage(item_terms(items), "asked")
    terms = stage(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    passes, found = max(1, -(-terms.count() // TERMS_AT_ONCE)), None
    for i in range(passes):
        own = terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).collect()  # about TERMS_AT_ONCE
        part = _postings(texts, {r.term.encode(): r.tid for r in own}, totals=i == 0)
        found = part if found is None else found.unionByName(part)
    found = stage(found, "postings")
    length, some = found.filter("tid < 0").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = f"(25L + (75L * n * {some}L) div {max(1, length)}L)"
    share = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")
    postings = found.filter("tid >= 0").select("tid", "row", "doc_id", share.alias("share"))

    best = stage(_best(postings, k), "best")
    highest = best.groupBy("tid").agg(F.max("share").alias("highest"))
    weight = F.floor(1000 * F.log((2 * F.lit(some) + 2).cast("double") / (2 * F.col("df") + 1)))
    weights = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", weight.cast("long").alias("weight"))
    weighed = asked.join(terms, "term").join(weights.filter("weight > 0"), "tid").join(highest, "tid")
    weighed = stage(weighed.select("item_id", "tid", (F.col("repeats") * F.col("weight")).alias("factor"), (F.col("repeats") * F.col("weight") * F.col("highest")).alias("most")), "weighed")

    seeds = weighed.join(best, "tid").groupBy("item_id", "row").agg(F.sum(F.col("factor") * F.col("share")).alias("sum"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sum")))
    seeds = seeds.withColumn("place", place).filter(F.col("place") == k).select("item_id", F.col("sum").alias("threshold"))
    rising = Window.partitionBy("item_id").orderBy("most", "tid").rowsBetween(Window.unboundedPreceding, 0)
    pruned = weighed.join(seeds, "item_id", "left").withColumns({"threshold": F.coalesce("threshold", F.lit(0)), "below": F.sum("most").over(rising)})
    pruned = pruned.withColumn("left_out", F.col("below") < F.col("threshold"))
    rest = F.coalesce(F.max(F.when(F.col("left_out"), F.col("below"))).over(Window.partitionBy("item_id")), F.lit(0))
    pruned = stage(pruned.withColumn("rest", rest).drop("below", "most"), "pruned")
    sent = F.broadcast if pruned.count() <= SENT_AT_MOST else lambda rows: rows

    least = F.first("threshold") - F.first("rest")
    partly = postings.join(sent(pruned.filter("not left_out")), "tid").groupBy("item_id", "row")
    partly = partly.agg(F.max("doc_id").alias("doc_id"), F.sum(F.col("factor") * F.col("share")).alias("score"), least.alias("least"))
    candidates = stage(partly.filter(F.col("score") >= F.col("least")).drop("least"), "candidates")
    more = candidates.select("item_id", "row", "doc_id").join(postings.select("row", "tid", "share"), "row")
    more = more.join(sent(pruned.filter("left_out").select("item_id", "tid", "factor")), ["item_id", "tid"])
    scored = candidates.unionByName(more.select("item_id", "row", "doc_id", (F.col("factor") * F.col("share")).alias("score")))
    scored = scored.groupBy("item_id", "row").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
