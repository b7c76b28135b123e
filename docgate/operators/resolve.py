"""Counterparties against a registry, by number and by name."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate import fixed
from docgate.functions.similarity import could_reach, ratio, similarity, sorted_words, token_sort_ratio
from docgate.functions.text import company_form, registration_form
from docgate.plans.tables import kept, shuffled, spread

#: The least similarities (0 to 1) that are looked for by common bigrams, one after the other; what they leave is compared in cells.
BIGRAM_STEPS = (fixed.MIN_MATCH, 2 / 3)
#: Texts of which one similarity asks for no more common subsequences than these are joined by them, longer ones by bigrams.
SUBSEQUENCES = 256
#: Names and labels of a cell, where all are compared.
CELL = 2_000
_SLACK = 1e-9


def labels(registry: DataFrame) -> DataFrame:
    """A row per distinct normalised name: form, place, vendor_id, legal_name. Of entries with one form the last counts, at
    the place of the first."""
    each = registry.select(
        "ordinal", "id", "legal_name", F.posexplode(F.concat(F.array("legal_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "name")
    ).withColumn("form", company_form(F.col("name")))
    at = F.struct("ordinal", "nth")
    return each.groupBy("form").agg(
        F.min(at).alias("place"), F.max_by("id", at).alias("vendor_id"), F.max_by("legal_name", at).alias("vendor_name")
    )


def _bigrams(forms: DataFrame) -> DataFrame:
    """words, gram, n: the bigrams of each text, with marks at both ends, numbered among equal ones, and the length of the text."""
    padded = F.concat(F.lit("\u0002"), "words", F.lit("\u0003"))
    n = F.char_length("words")
    each = forms.select("words", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("gram"))
    each = each.groupBy("words", "n", "gram").agg(F.count(F.lit(1)).cast("int").alias("times"))
    each = each.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select("words", "n", F.struct("gram", "nth").alias("gram"))


def _rare_first(grams: DataFrame, common: DataFrame, least: float) -> DataFrame:
    """Of each text's bigrams the rarest ones, so many that another text of the similarity has one of them among its own.

    Two texts of n and m letters with a common subsequence of L have 3 L - n - m + 1 bigrams in common, as a letter that only one of them has
    spoils two of its own bigrams and one of the other's. With 2 L >= least (n + m) that is (n + m) (1.5 least - 1) + 1 and more; m is
    n least / (2 - least) at least. Of n + 1 bigrams in one order, all but so many less one can miss."""
    fewest = F.ceil(F.col("n") * (least / (2 - least)) - _SLACK)
    shared = F.ceil((F.col("n") + fewest) * (1.5 * least - 1) + 1 - _SLACK)
    ranked = grams.join(shuffled(common), "gram")
    place = F.row_number().over(Window.partitionBy("words").orderBy("texts", "gram"))
    return ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") + 2 - shared).select("words", "n", "gram")


@functools.lru_cache
def _choices(n: int, length: int) -> np.ndarray:
    """The places of each subsequence of a length, of n letters; length is near n."""
    ways = list(itertools.combinations(range(n), n - length))
    left_out = np.array(ways, dtype=np.int64).reshape(len(ways), n - length)
    keep = np.ones((len(ways), n), dtype=bool)
    np.put_along_axis(keep, left_out, False, axis=1)
    return np.nonzero(keep)[1].reshape(len(ways), length)


def _subsequences(texts: DataFrame, lengths: dict[int, list[int]]) -> DataFrame:
    """words, key: a 64-bit hash for each distinct subsequence of each text (words, n), of the lengths that belong to n."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(texts: pd.Series) -> pd.Series:
        weights = np.random.default_rng(42).integers(1, 2**63, size=1 + max(lengths), dtype=np.uint64)
        out = []
        for text in texts:
            letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
            own = [(letters[_choices(len(letters), k)] * weights[:k]).sum(axis=1, dtype=np.uint64) for k in lengths[len(letters)]]
            out.append(np.unique(np.concatenate(own)).view(np.int64))
        return pd.Series(out)

    own = spread(texts.filter(F.col("n").isin(*lengths)), "words")
    return own.select("words", F.explode(keys(F.col("words"))).alias("key"))


def _by_subsequences(asked: DataFrame, known: DataFrame, least: float) -> tuple[DataFrame | None, list[tuple[int, int]]]:
    """words, other of pairs of short texts (words, n) that have a common subsequence as long as the similarity asks for, or None; and the
    pairs of lengths that are left. Texts of n and m letters with 2 L >= least (n + m) have one of L letters, so these pairs are all there are;
    a key may also meet texts of other lengths that aren't similar."""
    lengths = [[r.n for r in df.select("n").distinct().collect()] for df in (asked, known)]  # a number for each length
    left, right, rest = {}, {}, []
    for n, m in itertools.product(*lengths):
        if 2.0 * min(n, m) < least * (n + m) - _SLACK:
            continue
        common = max(0, math.ceil(least * (n + m) / 2 - _SLACK))
        if max(math.comb(n, common), math.comb(m, common)) > SUBSEQUENCES:
            rest.append((n, m))
            continue
        left.setdefault(n, set()).add(common)
        right.setdefault(m, set()).add(common)
    if not left:
        return None, rest
    a, b = (_subsequences(df, {n: sorted(x) for n, x in own.items()}) for df, own in ((asked, left), (known, right)))
    return a.join(shuffled(b.withColumnRenamed("words", "other")), "key").select("words", "other"), rest


def near_names(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """words, other, score of all pairs of a text of `asked` and one of `known` (both: bigrams, as of _bigrams()) that are similar to `least`,
    which is two thirds or more. Short texts are compared that have a subsequence of the length asked for in common (bigrams are few, and names
    made of few letters share all of them), others that share one of their rarest bigrams and whose lengths allow it."""
    if not 2 / 3 <= least <= 1:
        raise ValueError("bigrams find similarities of two thirds and more")
    pairs, rest = _by_subsequences(asked.select("words", "n").distinct(), known.select("words", "n").distinct(), least)
    if rest:
        longer = _by_bigrams(asked, known, least).join(F.broadcast(asked.sparkSession.createDataFrame(rest, "n int, m int")), ["n", "m"]).select("words", "other")
        pairs = longer if pairs is None else pairs.unionByName(longer)
    if pairs is None:
        return asked.sparkSession.createDataFrame([], "words string, other string, score double")
    pairs = spread(pairs, "words", "other").distinct()
    return pairs.withColumn("score", similarity(F.col("words"), F.col("other")) / 100.0).filter(F.col("score") >= least)


def _by_bigrams(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """words, n, other, m of texts that share one of their rarest bigrams and whose lengths allow the similarity."""
    common = asked.select("gram").unionAll(known.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    left = _rare_first(asked, common, least)
    right = _rare_first(known, common, least).withColumnsRenamed({"words": "other", "n": "m"})
    fits = 2.0 * F.least("n", "m") >= least * (F.col("n") + F.col("m")) - _SLACK
    return left.join(shuffled(right), "gram").filter(fits).select("words", "n", "other", "m")


def _cell(asked: pd.DataFrame, known: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each text of a cell the k most similar labels. Labels whose length rules them out aren't compared."""
    by_length: dict[int, list[tuple]] = {}
    for label in zip(known["other"], known["ordinal"], known["nth"], strict=True):
        by_length.setdefault(len(label[0]), []).append(label)
    out = []
    for words in asked["words"]:
        n, best = len(words), []
        reach = {m: 200.0 * min(n, m) / (n + m) if n + m else 100.0 for m in by_length}
        for m in sorted(by_length, key=lambda m: (-reach[m], m)):
            if len(best) >= k and reach[m] < -best[k - 1][0]:
                break
            best = sorted(best + [(-ratio(words, label[0]), *label[1:], label[0]) for label in by_length[m]])[:k]
        out += [(words, other, -score / 100.0) for score, _, _, other in best]
    return pd.DataFrame(out, columns=["words", "other", "score"])


def _in_cells(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """words, other, score of the k most similar labels (other, ordinal, nth) of each text, by comparison with all: texts and labels are
    dealt to rows and columns of cells, and each cell is one group of CELL of both at most, as hashes deal."""
    rows, columns = (max(1, -(-df.count() // (CELL // 2))) for df in (asked, known))
    dealt = lambda text, n: F.pmod(F.xxhash64(text), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("words", dealt("words", rows).alias("row"), every(columns).alias("column"))
    right = known.select("other", "ordinal", "nth", dealt("other", columns).alias("column"), every(rows).alias("row"))
    cells = left.groupBy("row", "column").cogroup(right.groupBy("row", "column"))
    return cells.applyInPandas(lambda a, b: _cell(a, b, k), "words string, other string, score double")


def names_against_registry(queries: DataFrame, registry: DataFrame, k: int = 3) -> DataFrame:
    """The k best labels of each query (query_id, name): query_id, rank, vendor_id, vendor_name, score (0 to 1).

    Each distinct name is compared once. Names that equal k labels are settled by an equi-join, as nothing is closer; those that have k labels
    of a similarity of BIGRAM_STEPS by a join on rare bigrams, which finds all such labels; only the others are compared with all labels, in
    cells, so that the closest is known however far it is. Labels never pass the driver. Ties go to the label that stands first. A null name takes no part; no rows give no rows."""
    known = kept(labels(registry).select(sorted_words(F.col("form")).alias("other"), "place.*", "vendor_id", "vendor_name"), "labels")
    forms = queries.filter("name is not null").select("query_id", sorted_words(company_form(F.col("name"))).alias("words"))
    rest = kept(forms.select("words").distinct(), "names")
    asked_grams = known_grams = None
    order = Window.partitionBy("words").orderBy(F.desc("score"), "ordinal", "nth")
    best = None
    for least in (1, *BIGRAM_STEPS, None):
        if rest.isEmpty():
            break
        if least == 1:
            pairs = rest.join(shuffled(known.select("other").distinct()), F.col("words") == F.col("other")).withColumn("score", F.lit(1.0))
        elif least is None:
            pairs = _in_cells(rest, known.groupBy("other").agg(F.min(F.struct("ordinal", "nth")).alias("first")).select("other", "first.*"), k)
        else:
            if asked_grams is None:
                asked_grams = kept(_bigrams(rest), "name_bigrams")
                known_grams = kept(_bigrams(known.select(F.col("other").alias("words")).distinct()), "label_bigrams")
            pairs = near_names(asked_grams.join(shuffled(rest), "words", "left_semi"), known_grams, least)
        ranked = pairs.join(shuffled(known), "other").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = kept(ranked.select("words", "rank", "vendor_id", "vendor_name", "score"), "ranked")
        if least is not None:
            settled = shuffled(ranked.filter(F.col("rank") == k).select("words"))
            ranked, rest = ranked.join(settled, "words", "left_semi"), kept(rest.join(settled, "words", "left_anti"), "names")
        best = ranked if best is None else best.unionByName(ranked)
    if best is None:
        best = queries.sparkSession.createDataFrame([], "words string, rank int, vendor_id string, vendor_name string, score double")
    return forms.join(shuffled(best), "words").select("query_id", "rank", "vendor_id", "vendor_name", "score")


def agreement(pairs: DataFrame, name: str, form: str, threshold: float) -> DataFrame:
    """pairs whose two names agree to the threshold (0 to 1); the lengths rule most out before the comparison."""
    a, b = company_form(F.col(name)), F.col(form)
    return pairs.filter(could_reach(a, b, 100 * threshold)).withColumn("score", token_sort_ratio(a, b) / 100.0).filter(F.col("score") >= threshold)


def resolve(queries: DataFrame, registry: DataFrame, threshold: float = fixed.MIN_MATCH, k: int = 3) -> DataFrame:
    """query_id, vendor_id, score, matched_on, runners_up of each query (query_id, name, registration_id).

    matched_on is registration_id where the number is known and the name agrees (score 1), conflict where the name
    doesn't (no vendor, the agreement as score), else name from the threshold on, else none. A blank name resolves to
    nothing; an unknown number leaves the name to decide. Registration numbers are an equi-join of shuffled rows. Only names that no number decides meet the labels; of these the k best are found, all but the first as runners-up."""
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    numbers = registry.withColumn("number", registration_form(F.col("registration_id"))).filter("number is not null")
    numbers = numbers.groupBy("number").agg(F.min_by(F.struct("id", "legal_name", "aliases"), "ordinal").alias("owner"))
    asked = queries.withColumn("number", registration_form(F.col("registration_id")))
    undecided = asked.filter(~blank).join(shuffled(numbers.select("number")), "number", "left_anti")
    ranked = names_against_registry(undecided, registry, k)
    best = ranked.groupBy("query_id").agg(
        F.max_by(F.struct("vendor_id", "score"), -F.col("rank")).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", F.col("vendor_name").alias("name"), "score")))).alias("others"),
    )
    owned = asked.filter(~blank).join(shuffled(numbers), "number")
    owned = owned.select("query_id", F.col("owner.id").alias("owner_id"), "name", F.explode(F.concat(F.array("owner.legal_name"), F.coalesce("owner.aliases", F.array().cast("array<string>")))).alias("own"))
    owned = owned.withColumn("agreed", token_sort_ratio(company_form(F.col("name")), company_form(F.col("own"))) / 100.0)
    owned = owned.groupBy("query_id", "owner_id").agg(F.max("agreed").alias("agreed"))
    out = asked.join(shuffled(owned), "query_id", "left").join(shuffled(best), "query_id", "left")
    known, agrees = F.col("owner_id").isNotNull(), F.col("agreed") >= threshold
    named = F.coalesce(F.col("best.score") >= threshold, F.lit(False))
    nobody = F.lit(None).cast("string")
    none = F.array().cast("array<struct<name:string,score:double>>")
    others = F.transform("others", lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))
    return out.select(
        "query_id",
        F.when(known, F.when(agrees, F.col("owner_id"))).when(named, F.col("best.vendor_id")).otherwise(nobody).alias("vendor_id"),
        F.when(known, F.when(agrees, 1.0).otherwise(F.col("agreed"))).otherwise(F.coalesce("best.score", F.lit(0.0))).alias("score"),
        F.when(known & agrees, "registration_id").when(known, "conflict").when(named, "name").otherwise("none").alias("matched_on"),
        F.when(known, none).otherwise(F.coalesce(others, none)).alias("runners_up"),
    )
