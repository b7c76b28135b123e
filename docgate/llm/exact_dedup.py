"""Exact duplicates by content sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgate.llm.common import ascii_lower, fresh, stage

#: Runs of equal texts are sorted in parts, by identifier, so that no task gets all copies of one text: at least so many
#: parts, and one more for so many rows of the table.
SALTS, ROWS_PER_SALT = 32, 100_000
#: Characters of the text that the range splitters see. Equal texts share them, and samples on the driver stay small.
PREFIX = 48


def exact_duplicates(docs: DataFrame, keep: str = "largest", salts: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. `keep` names which identifier of a
    group stays, "smallest" or "largest". Of repeated rows with that identifier one is kept. A null identifier is
    kept only when its group has no other. Extra columns are ignored; no rows give no rows.

    Sampled splitters range-partition the normalised texts and each partition is sorted externally, so equals lie next
    to each other and the window compares whole neighbouring texts. Unless `salts` is given, the rows are counted first, to
    have enough parts for one text to be a third of them. The parts that a large run was split into by
    identifier are merged on the SHA-256 digest, one row per run and part, and joined back on digest and part.
    """
    salts = salts or max(SALTS, docs.count() // ROWS_PER_SALT)
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    best = F.max if keep == "largest" else F.min
    keyed = docs.select(
        F.col("doc_id"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
        ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"),
    ).withColumns({"head": F.substring("norm", 1, PREFIX), "mix": F.xxhash64("norm")})
    place = ["head", "mix", "salt"]
    same = Window.partitionBy(*place, "norm")
    rows = keyed.repartitionByRange(*place).select(
        "doc_id",
        "salt",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.row_number().over(same.orderBy(order)).alias("pos"),
        F.count(F.lit(1)).over(same).alias("copies"),
        best("doc_id").over(same).alias("local_keep"),
    )
    rows = stage(rows, "sorted")
    whole = Window.partitionBy("digest")
    groups = rows.filter("pos = 1").select(
        "digest", "salt", best("local_keep").over(whole).alias("keep_id"), F.sum("copies").over(whole).alias("group_size")
    )
    return rows.join(groups, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("pos") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs with one document of each group of exact duplicates, the one that exact_duplicates() keeps.

    Of repeated rows, which share identifier and normalised text, any one stays. Columns and other rows are unchanged; no rows
    give no rows. What goes is decided on identifiers and digests; then the rows that go are left out by one join, and only rows
    that are repeated are grouped."""
    name = fresh(docs, "key")
    key = lambda digest: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest)
    rows = exact_duplicates(docs, keep).groupBy(key(F.col("text_sha256")).alias(name)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("many"))
    rows = stage(rows.filter("not kept or many > 1"), "decided")
    gone, again = rows.filter("not kept").select(name), rows.filter("kept").select(name)
    left = docs.withColumn(name, key(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))).join(gone, name, "left_anti")
    if not again.isEmpty():
        left = left.join(again, name, "left_anti").unionByName(left.join(again, name, "left_semi").dropDuplicates([name]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
