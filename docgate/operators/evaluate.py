"""Evaluation against expected results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgate.functions.amounts import close_enough, says
from docgate.functions.text import clauses
from docgate.operators.verify import supports


def judged_fields(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expected field (doc_id, name, v_text, v_num, v_bool) with correct. A field that wasn't extracted counts as null."""
    a = actual.select("doc_id", "name", *[F.col(c).alias(f"a_{c}") for c in ("v_text", "v_num", "v_bool")])
    both = expected.join(a, ["doc_id", "name"], "left")
    correct = (
        F.when(F.col("v_bool").isNotNull(), F.col("v_bool").eqNullSafe(F.col("a_v_bool")))
        .when(F.col("v_num").isNotNull(), close_enough(F.col("v_num"), F.col("a_v_num")))
        .when(F.col("v_text").isNotNull(), says(F.col("v_text"), F.col("a_v_text")))
        .otherwise(F.col("a_v_text").isNull() & F.col("a_v_num").isNull() & F.col("a_v_bool").isNull())
    )
    return both.withColumn("correct", correct)


def accuracy(rows: DataFrame, key: list[str], correct: str = "correct") -> DataFrame:
    """The share of correct rows, 1 where there are none."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col(correct).cast("int")), F.lit(1.0)).alias("accuracy"))


def recall(sets: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """sets with recall, the share of what was expected that was found (1 if nothing was), and what was missed."""
    share = F.size(F.array_intersect(expected, found)) / F.nullif(F.size(F.array_distinct(expected)), F.lit(0))
    return sets.withColumns({"recall": F.coalesce(share, F.lit(1.0)), "missed": F.array_except(expected, found)})


def confusion(rows: DataFrame, key: list[str], kinds: tuple[str, ...] = ("contract", "invoice", "unknown")) -> DataFrame:
    """How many rows of each key are of each kind. The kinds are given, so no pass is needed to find them."""
    return rows.groupBy(*key).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def sweep(rows: DataFrame) -> DataFrame:
    """Correct, total, dollars and seconds by effort."""
    return rows.groupBy("effort").agg(F.sum(F.col("correct").cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"), F.sum("usd").alias("usd"), F.sum("seconds").alias("seconds"))


def stated_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, number, clause of every term that a document states."""
    return docs.select("doc_id", F.explode(clauses(F.col("text"))).alias("c")).select("doc_id", "c.number", "c.clause")


def believed(terms: DataFrame, key: list[str]) -> DataFrame:
    """n and believed, the share of terms (number, clause) whose clause verification takes as evidence for the number, by key."""
    none = F.lit(None)
    asked = {"name": F.lit("term"), "v_text": none.cast("string"), "v_num": F.col("number").cast("double"), "v_bool": none.cast("boolean"), "source_quote": F.col("clause")}
    asked |= {"ways": F.array().cast("array<string>"), "folded_quote": F.lit("")}
    judged = terms.withColumns(asked).withColumn("_yes", F.coalesce(supports(), F.lit(False)).cast("int"))
    return judged.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("_yes").alias("believed"))


def schema_difference(df: DataFrame, wanted) -> dict[str, list[str]]:
    """Columns that df lacks, and those that it has too many."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in wanted}
    return {
        "missing": sorted(n for n in want if n not in have),
        "extra": sorted(n for n in have if n not in want),
        "changed": sorted(n for n in want if n in have and have[n] != want[n]),
    }


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def data_differences(df: DataFrame, required: list[str], keys: list[list[str]]) -> DataFrame:
    """kind, name, n: what rows break: `null`, the rows without a value in a column that needs one, and `repeated`, the values of a key that
    more than one row has (rows with a null in the key aren't compared). What no row breaks isn't named."""
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in required])
    pairs = F.explode(F.array(*[F.struct(F.lit("null").alias("kind"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in required]))
    out = nulls.select(pairs.alias("d")).select("d.*")
    for key in keys:
        again = repeated_keys(df.dropna(subset=key), key).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(again.select(F.lit("repeated").alias("kind"), F.lit(", ".join(key)).alias("name"), "n"))
    return out.filter("n > 0")
