"""Streams: exactly-once intake into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate.operators.intake import first_of_each
from docgate.streaming.retries import state_store

#: Folders that the rows of a day are dealt to by their key.
BUCKETS = 64
#: Parts of a target that a batch names one by one; a batch of more reads the target's keys without.
NAMED_AT_MOST = 4096


def _day(column: str | None) -> Column:
    return F.coalesce(F.to_date(column), F.to_date(F.lit("1970-01-01"))) if column else F.to_date(F.lit("1970-01-01"))


def _placed(rows: DataFrame, key: str, day: str | None) -> DataFrame:
    """rows with the folders that their keys belong to."""
    return rows.withColumns({"_day": F.date_format(_day(day), "yyyy-MM-dd"), "_bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")})


def seen_near(placed: DataFrame, target: str, key: str) -> DataFrame:
    """The rows of a target in the folders that rows of a batch belong to; others aren't read."""
    schema = f"{key} {placed.schema[key].dataType.simpleString()}, _day string, _bucket int"
    spark = placed.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # the first batch
        return spark.createDataFrame([], schema)
    seen = spark.read.schema(schema).parquet(target)
    parts = placed.select("_day", "_bucket").distinct().limit(NAMED_AT_MOST + 1).collect()
    if len(parts) > NAMED_AT_MOST:
        return seen
    days = sorted({p["_day"] for p in parts})
    return seen.filter(F.col("_day").isin(*days) & F.col("_bucket").isin(*sorted({p["_bucket"] for p in parts})))


def append_new(rows: DataFrame, target: str, key: str, day: str | None = None) -> None:
    """Append to a Parquet table the rows whose key it doesn't have; of repeated ones any.

    The table is partitioned by the day of the timestamp column `day`, if one is named, and by a hash of the key; only the folders that the
    rows belong to are looked at, so a batch reads no more the longer the table. The day must be the key's own: a key that comes again
    with another day is another row."""
    placed = _placed(rows, key, day)
    seen = seen_near(placed, target, key).select(key)
    new = first_of_each(placed.join(seen, key, "left_anti"), [key], [F.col(key)])
    new = new.repartition("_day", "_bucket")  # a file for each folder, not one for each folder and task
    new.write.mode("append").partitionBy("_day", "_bucket").parquet(target)


def start_intake(stream: DataFrame, target: str, checkpoint: str, key: str, day: str | None = None, within: str = "1 hour", trigger: dict | None = None):
    """Append each key once to a Parquet table.

    Keys that come again within a time of their arrival are dropped by the stream's own state (RocksDB), which forgets them after that;
    others are looked up in the table, as append_new() does, and so is a batch that is run again after a failure. A stream may be
    started anew with another checkpoint."""
    state_store(stream.sparkSession)
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within).dropDuplicatesWithinWatermark([key]).drop("_arrived")

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, target, key, day)

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def spending(calls: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Dollars by purpose and window of event time (an extension: the tables have no windows). Late calls are counted
    until the watermark."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window), "purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum("usd").alias("usd"))
