"""Exact retrieval: over vectors of a playbook's clauses, and over sparse postings of their words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.functions.text import fold, shorten
from docgate.plans.tables import kept

#: Bytes of clauses' vectors that go to every task at a time.
CLAUSE_BYTES = 32 << 20
#: Bytes of clauses' text up to which their postings go to every task.
PLAYBOOK_BYTES = 4 << 20
#: Of queries with all clauses, of words, and of products of weights, how many are held at a time.
CELLS, WORDS, PRODUCTS = 2_000_000, 250_000, 2_000_000


def squared_distance(a: Column, b: Column) -> Column:
    apart = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, clauses: DataFrame, k: int = 3) -> DataFrame:
    """The k clauses nearest to each query: query_id, rank, section, score = 1 / (1 + squared distance); ties to the smaller
    section. Queries or clauses without a vector take no part; no rows give no rows.

    The clauses are a playbook; they go to the tasks in blocks of CLAUSE_BYTES, one after the other where there are more.
    Each block keeps k rows a query before the shuffle."""
    known = clauses.filter("embedding is not null").select("section", F.col("embedding").alias("_embedding"))
    size = known.agg(F.coalesce(F.sum(8 * F.size("_embedding") + F.octet_length("section") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-size // CLAUSE_BYTES))
    asked = queries.filter("embedding is not null").select("query_id", "embedding")
    near = None
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("section"), F.lit(blocks)) == block) if blocks > 1 else known
        pairs = asked.join(F.broadcast(part), how="cross").select("query_id", "section", squared_distance(F.col("embedding"), F.col("_embedding")).alias("d"))
        near = pairs if near is None else near.unionByName(pairs)
    order = Window.partitionBy("query_id").orderBy("d", "section")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "section", (1 / (1 + F.col("d"))).alias("score"))


def words_of(text: Column) -> Column:
    """The words of a text, without accents and case."""
    return F.filter(F.split(fold(text), r"(?U)[^\p{L}\p{N}§]+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """The words of a text, without accents and case, with their neighbours as pairs."""
    words = words_of(text)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def weights(clauses: DataFrame) -> tuple[DataFrame, int]:
    """term, idf over the clauses (section, text): one more than the logarithm of (1 + clauses) / (1 + those that have the term); and the
    number of clauses."""
    total = clauses.select("section").distinct().count()
    held = clauses.select("section", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    return held.groupBy("term").agg((F.log((1 + F.lit(total)) / (1.0 + F.count(F.lit(1)))) + 1).alias("idf")), total


def postings(texts: DataFrame, key: str, idf: DataFrame, total: int) -> DataFrame:
    """key, term, weight: a text's terms by TF-IDF, each text's weights of length 1. Terms that no clause has count as held by none."""
    counts = texts.select(key, F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("times"))
    raw = counts.join(idf, "term", "left").withColumn("raw", F.col("times") * F.coalesce("idf", F.lit(math.log(1 + total) + 1)))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, key).select(key, "term", (F.col("raw") / F.col("length")).alias("weight"))


def _top(rows: DataFrame, group: str, by: Column, k: int, *ties: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(by, *ties))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def nearest_by_terms(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """query_id, section, near (the sum of products of weights): the k clauses nearest to each query, of those that share a term with it; equal to
    nine digits, the smaller section. asked and known are postings, by query_id and by section.

    Term at a time, with bounds. For each term the k clauses of most weight are known; what queries get from these alone has a k-th
    largest sum, which is a threshold for the k-th result. A query's terms that together can't reach the threshold, from the least on,
    find no candidates, so the terms that all texts have are joined for candidates alone, and of those only for the ones that can
    still reach it."""
    heads = kept(_top(known, "term", F.desc("weight"), k, "section").drop("rank"), "heads")
    most = heads.groupBy("term").agg(F.max("weight").alias("most"))
    met = asked.join(most, "term").withColumn("most", F.col("weight") * F.col("most"))
    sums = met.join(heads.withColumnRenamed("weight", "own"), "term").groupBy("query_id", "section").agg(F.sum(F.col("weight") * F.col("own")).alias("sum"))
    # Sums of floating numbers in another order differ by less than the slack
    least = _top(sums, "query_id", F.desc("sum"), k).filter(F.col("rank") == k).select("query_id", (F.col("sum") * (1 - 1e-9) - 1e-9).alias("least"))
    rising = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    met = met.join(least, "query_id", "left").withColumns({"least": F.coalesce("least", F.lit(-1.0)), "below": F.sum("most").over(rising)})
    rest = F.coalesce(F.max(F.when(F.col("below") < F.col("least"), F.col("below"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    met = kept(met.withColumns({"left_out": F.col("below") < F.col("least"), "rest": rest}).drop("most", "below"), "met")
    by_clause = known.withColumnRenamed("weight", "own")
    found = met.filter("not left_out").join(by_clause, "term").groupBy("query_id", "section")
    found = found.agg(F.sum(F.col("weight") * F.col("own")).alias("near"), F.first("least").alias("least"), F.first("rest").alias("rest"))
    found = kept(found.filter(F.col("near") + F.col("rest") >= F.col("least")).select("query_id", "section", "near"), "candidates")
    more = found.select("query_id", "section").join(met.filter("left_out").select("query_id", "term", "weight"), "query_id")
    more = more.join(by_clause, ["section", "term"]).select("query_id", "section", (F.col("weight") * F.col("own")).alias("near"))
    scored = found.unionByName(more).groupBy("query_id", "section").agg(F.round(F.sum("near"), 9).alias("near"))
    return _top(scored, "query_id", F.desc("near"), k, "section").drop("rank")


def _pieces(batch: pa.RecordBatch, clauses: int):
    """Parts of a batch of few queries and few words; a query of more words is a part of its own."""
    lengths = pc.list_value_length(batch.column("words")).to_numpy()
    before, start = np.concatenate([[0], np.cumsum(lengths)]), 0
    while start < len(lengths):
        end = int(np.searchsorted(before, before[start] + WORDS, "right")) - 1
        end = max(start + 1, min(end, start + max(1, CELLS // clauses)))
        yield batch.slice(start, end - start), lengths[start:end]
        start = end


def _nearest_of_all(queries: DataFrame, said: DataFrame, idf: DataFrame, total: int, k: int) -> DataFrame:
    """search_text() against clauses that every task holds the postings of: a query's terms are weighed, multiplied and ranked in its own
    row, so no term moves. Only rows of a query_id that stands on several are brought together."""
    known = postings(said, "section", idf, total).join(idf, "term").toArrow()
    sections = sorted({r.section for r in said.select("section").distinct().collect()}, key=lambda s: (s is not None, (s or "").encode()))
    terms_ = pc.unique(known["term"])
    term = pc.index_in(known["term"], value_set=terms_).to_numpy()
    order = np.argsort(term, kind="stable")
    clause = pc.index_in(known["section"], value_set=pa.array(sections, pa.string())).to_numpy()[order]
    weight, own_idf = known["weight"].to_numpy()[order], np.zeros(len(terms_))
    own_idf[term] = known["idf"].to_numpy()
    first = np.searchsorted(term[order], np.arange(len(terms_) + 1))
    wordy = np.zeros(len(sections), bool)
    wordy[clause] = True
    # A pair of words is a number; a term without a blank is a word followed by none
    two = [t.partition(" ")[::2] for t in terms_.to_pylist()]
    words = pa.array(sorted({w for pair in two for w in pair if w}), pa.string())
    ids = [pc.index_in(pa.array([t[i] for t in two], pa.string()), value_set=words).fill_null(-1).to_numpy().astype(np.int64) for i in (0, 1)]
    numbers = ids[0] * (len(words) + 1) + ids[1] + 1
    by_number = np.argsort(numbers)
    playbook = queries.sparkSession.sparkContext.broadcast((sections, words, numbers[by_number], by_number, own_idf, first, clause, weight, wordy))
    unknown = math.log(1 + total) + 1

    def run(batches):
        sections, words, numbers, by_number, own_idf, first, clause, weight, wordy = playbook.value
        names, width = pa.array(sections, pa.string()), len(sections)
        for batch in batches:
            for part, lengths in _pieces(batch, width):
                n = len(lengths)
                coded = part.column("words").flatten().dictionary_encode()
                code, many_words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                own = pc.index_in(coded.dictionary, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
                gap = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # between texts of one query
                of = np.repeat(np.arange(n), lengths)
                says = ~gap[code]
                beside = np.flatnonzero(says[:-1] & says[1:] & (of[:-1] == of[1:]))
                said_ = np.concatenate([code[says] * (many_words + 1), code[beside] * (many_words + 1) + code[beside + 1] + 1])
                span = many_words * (many_words + 1) + 1
                place, times = np.unique(np.concatenate([of[says], of[beside]]) * span + said_, return_counts=True)
                query, (one, other) = place // span, np.divmod(place % span, many_words + 1)
                own = np.concatenate([own, [-1]])
                known_ = (own[one] >= 0) & ((other == 0) | (own[other - 1] >= 0))
                number = np.where(known_, own[one] * (len(words) + 1) + np.where(other == 0, 0, own[other - 1] + 1), -1)
                at = np.full(len(place), -1)
                if len(numbers):
                    near_by = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
                    at = np.where(numbers[near_by] == number, by_number[near_by], -1)
                hit = at >= 0
                raw = np.full(len(at), unknown)
                raw[hit] = own_idf[at[hit]]
                raw *= times
                length = np.sqrt(np.bincount(query, raw * raw, minlength=n))
                query, at, raw = query[hit], at[hit], raw[hit]
                raw /= length[query]
                many = first[at + 1] - first[at]
                ends, near, start = np.cumsum(many), np.zeros(n * width), 0
                while start < len(many):
                    done = ends[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
                    m = many[start:end]
                    nth = np.arange(ends[end - 1] - done) + np.repeat(first[at[start:end]] - (ends[start:end] - m - done), m)
                    near += np.bincount(np.repeat(query[start:end] * width, m) + clause[nth], np.repeat(raw[start:end], m) * weight[nth], minlength=n * width)
                    start = end
                asks = (np.bincount(of[says], minlength=n) > 0)[:, None]
                apart = np.where(asks & wordy, 2 - 2 * np.round(near.reshape(n, width), 9), asks * 1.0 + wordy)
                rows, best, d = np.arange(n), [], []
                for _ in range(min(k, width)):  # of equal ones the first, which is the smaller section
                    best.append(apart.argmin(axis=1))
                    d.append(apart[rows, best[-1]])
                    apart[rows, best[-1]] = np.inf
                from_ = pa.array(np.repeat(rows, len(best)))
                rank = pa.array(np.tile(np.arange(1, len(best) + 1, dtype=np.int32), n))
                score = 1 / (1 + np.column_stack(d).reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(from_), rank, names.take(pa.array(np.column_stack(best).reshape(-1))), pa.array(score)], ["query_id", "rank", "section", "score"])

    asked = queries.select("query_id", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    several = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id")
    if not several.isEmpty():
        whole = asked.join(several, "query_id").groupBy("query_id").agg(F.flatten(F.collect_list(F.concat("words", F.array(F.lit(""))))).alias("words"))
        asked = asked.join(several, "query_id", "left_anti").unionByName(whole)
    schema = T.StructType([queries.schema["query_id"], T.StructField("rank", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("score", T.DoubleType())])
    return asked.mapInArrow(run, schema)


def search_text(queries: DataFrame, clauses: DataFrame, k: int = 3) -> DataFrame:
    """search() by what is asked in words, where no embedding is at hand: queries has query_id and text, clauses section, title and body.

    Texts are compared by TF-IDF of their words and pairs of words, weighed over the clauses. Clauses that share no term with a query are
    as far from it as any text can be; they come after the others by section, one without a term before those that have some. A query
    without a term (or null) is next to clauses without one. Sections are distinct. No clauses or no queries give no rows.

    A playbook of up to PLAYBOOK_BYTES goes to the tasks, and queries don't move; a larger one is joined with them by terms."""
    said = clauses.select("section", F.concat_ws(" ", "title", "body").alias("text"))
    idf, total = weights(said)
    size = said.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total and size <= PLAYBOOK_BYTES:
        return _nearest_of_all(queries, said, idf, total, k)
    idf = kept(idf, "idf")
    known = kept(postings(said, "section", idf, total), "postings")
    asked = kept(postings(queries.select("query_id", "text"), "query_id", idf, total), "asked")
    near = nearest_by_terms(asked, known, k)
    # What a query shares no term with: of each sort the first 2 k sections do, since k of them at most are among the near ones
    wordy = known.select("section").distinct().withColumn("wordy", F.lit(1))
    sorts = said.select("section").distinct().join(wordy, "section", "left").withColumn("wordy", F.coalesce("wordy", F.lit(0)))
    fill = [(r.section, float(r.wordy)) for r in _top(sorts, "wordy", F.col("section"), 2 * k).collect()]
    if not fill:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, section string, score double")
    fill = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(wordy).alias("wordy")) for section, wordy in fill])
    own = asked.select("query_id").distinct().withColumn("asks", F.lit(1.0))
    every = queries.select("query_id").distinct().join(own, "query_id", "left").withColumn("f", F.explode(fill))
    far = every.select("query_id", "f.section", (F.coalesce("asks", F.lit(0.0)) + F.col("f.wordy")).alias("d"))
    far = far.join(near, ["query_id", "section"], "left_anti")
    found = near.select("query_id", "section", (2 - 2 * F.col("near")).alias("d")).unionByName(far)
    return _top(found, "query_id", F.col("d"), k, "section").select("query_id", "rank", "section", (1 / (1 + F.col("d"))).alias("score"))


def with_text(found: DataFrame, clauses: DataFrame) -> DataFrame:
    """Search results with citation and shortened text; sections that aren't there are left out."""
    text = clauses.select("section", F.concat_ws(" ", "section", "title").alias("citation"), shorten(F.concat_ws("\n", F.concat_ws(" ", "section", "title"), "body")).alias("text"))
    return found.join(text, "section")


def build(clauses: DataFrame, path: str) -> None:
    """Write the index (section, title, body, embedding) anew; building it twice leaves one copy of each clause."""
    clauses.select("section", "title", "body", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["section"]).write.mode("overwrite").parquet(path)
