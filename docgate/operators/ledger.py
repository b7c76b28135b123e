"""The ledger of model calls: costs, hit ratios, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions.amounts import cache_hit_ratio, cost_usd
from docgate.plans.store import Store

CALL = (
    "id long, attachment_id long, purpose string, model string, effort string, input_tokens long, output_tokens long, "
    "cache_read_tokens long, cache_write_tokens long, usd double, latency_ms long, stop_reason string, ok boolean, error string"
)


def by_purpose(calls: DataFrame) -> DataFrame:
    """Calls, dollars, tokens and cache hit ratio by purpose."""
    sums = calls.groupBy("purpose").agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum("usd"), 6).alias("usd"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")],
    )
    ratio = cache_hit_ratio(F.col("input_tokens"), F.col("cache_write_tokens"), F.col("cache_read_tokens"))
    return sums.withColumn("hit_ratio", F.round(ratio, 3))


def per_document(calls: DataFrame, attachments: DataFrame) -> DataFrame:
    """Dollars spent on each attachment, 0 for those without calls."""
    spent = calls.groupBy("attachment_id").agg(F.sum("usd").alias("usd"))
    return attachments.select(F.col("id").alias("attachment_id")).join(spent, "attachment_id", "left").withColumn("usd", F.coalesce("usd", F.lit(0.0)))


def totals(calls: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: dollars, documents delivered, dollars a delivered document (null if none)."""
    spent = calls.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    delivered = attachments.agg(F.count(F.when(F.col("status") == "delivered", 1)).alias("delivered"))
    return spent.join(delivered, how="cross").withColumn("usd_each", F.col("usd") / F.nullif("delivered", F.lit(0)))


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """calls with usd by the rates of their model (model, input_rate, output_rate); a model without rates fails."""
    usd = cost_usd(*[F.coalesce(c, F.lit(0)) for c in ("input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens")], F.col("input_rate"), F.col("output_rate"))
    missing = F.raise_error(F.concat(F.lit("no rates for model "), F.coalesce("model", F.lit("null")))).cast("double")
    joined = calls.drop("usd").join(F.broadcast(rates), "model", "left")
    return joined.withColumn("usd", F.when(F.col("input_rate").isNull(), missing).otherwise(usd)).drop("input_rate", "output_rate")


def within_budget(calls: DataFrame, ceiling: float = fixed.DOCUMENT_USD) -> DataFrame:
    """calls with spent_before, the dollars of a document's earlier calls, and allowed, whether they were under the ceiling."""
    before = Window.partitionBy("attachment_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("spent_before", F.coalesce(F.sum("usd").over(before), F.lit(0.0)))
    return out.withColumn("allowed", F.col("spent_before") < ceiling)


def usage(calls: DataFrame, key: list[str]) -> DataFrame:
    return calls.groupBy(*key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")])


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def counted(*conditions: tuple[str, Column]) -> list[Column]:
    return [F.count(F.when(c, 1)).alias(name) for name, c in conditions]


def append(calls: DataFrame, path: str) -> None:
    """Add calls to a ledger on disk, one folder per purpose, so that reports on a purpose read no other."""
    calls.write.mode("append").partitionBy("purpose").parquet(path)


def newest(calls: DataFrame) -> DataFrame:
    """The last call; a limit of one is the operator."""
    return calls.orderBy(F.desc("id")).limit(1)


#: What is kept of a ledger by purpose: everything else that by_purpose() reports follows from it.
SUMS = ("calls", "usd", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def partial_sums(calls: DataFrame) -> DataFrame:
    """purpose and SUMS of some calls; dollars as decimals, whose sum doesn't depend on the order."""
    counted_ = F.count(F.lit(1)).cast("decimal(38,9)").alias("calls")
    return calls.groupBy("purpose").agg(counted_, *[F.sum(F.coalesce(F.col(c).cast("decimal(38,9)"), F.lit(0).cast("decimal(38,9)"))).cast("decimal(38,9)").alias(c) for c in SUMS[1:]])


def add_batch(store: Store, calls: DataFrame, batch: int, name: str = "by_purpose") -> bool:
    """Add a batch of calls to the sums that a store keeps by purpose, and say whether it was new.

    The new sums and the batch's number are published together, so a batch that comes again, or whose writer died at any point, counts
    once. The calls are read once; what is merged is a row per purpose."""
    if f"{name}_batches" in store.tables() and not store.read(f"{name}_batches").filter(F.col("batch") == batch).isEmpty():
        return False
    with store.transaction() as own:
        sums = partial_sums(calls)
        if name in own.entries:
            sums = sums.unionByName(store.read(name, version=own.version))
        merged = sums.groupBy("purpose").agg(*[F.sum(c).cast("decimal(38,9)").alias(c) for c in SUMS])
        own.replace(name, merged)
        own.append(f"{name}_batches", calls.sparkSession.range(1).select(F.lit(batch).cast("long").alias("batch")))
    return True


def kept_by_purpose(store: Store, name: str = "by_purpose") -> DataFrame:
    """by_purpose() of all batches that were added, from the sums alone."""
    sums = store.read(name).select("purpose", F.col("calls").cast("long").alias("calls"), F.round(F.col("usd").cast("double"), 6).alias("usd"), *[F.col(c).cast("long").alias(c) for c in SUMS[2:]])
    ratio = cache_hit_ratio(F.col("input_tokens"), F.col("cache_write_tokens"), F.col("cache_read_tokens"))
    return sums.withColumn("hit_ratio", F.round(ratio, 3))
