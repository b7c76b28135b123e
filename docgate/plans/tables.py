"""Tables written between steps, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session gets one of its own; any other is refused, since
    a folder of one machine isn't seen by the others."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="docgate-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def spread(df: DataFrame, *key: str | Column) -> DataFrame:
    """df dealt by key to more tasks than there are cores, for what is slow a row. A file of one row group is one task, however many rows it
    has, and few bytes are joined into one task behind a shuffle."""
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *key)


def shuffled(df: DataFrame) -> DataFrame:
    """df, which grows with the input, as a side of a join: both sides are shuffled and merged. Left alone, Spark weighs a side by its packed bytes and
    sends up to 10 MB of them through the driver, where they can be 100 MB of rows."""
    return df.hint("merge")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docgate-{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: what follows neither repeats its work nor depends on the executors that did it."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
