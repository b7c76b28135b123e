"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its
    own; any other session is refused, since a folder of one machine isn't seen by the others."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="docgate-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in a folder of its own in the shared folder and read back, and that folder. Later jobs neither
    repeat its work nor depend on the executors that did it."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/docgate-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}"), folder


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete tables that write() has made and that no result needs any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The folders staged in a scratch() block, and the block around it."""

    def __init__(self, outer: Scratch | None) -> None:
        self.outer, self.folders = outer, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Like stage(), for the block around this one: the table outlives this block."""
        table, folder = write(df, name)
        if self.outer:
            self.outer.folders.append(folder)
        return table


#: The innermost scratch() block of this thread.
_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """What is staged inside of the block, in this thread, goes when it ends; results must have been kept by then."""
    now = Scratch(_scratch.get())
    token = _scratch.set(now)
    try:
        yield now
    finally:
        _scratch.reset(token)
        discard(spark, *now.folders)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written and read back. The table goes at the end of the scratch() block that this is called in, if any.

    In such a block, which has many steps, the files that a step has shuffled go when its table stands: Spark deletes them once nothing
    refers to them, which the driver finds out when it collects its garbage, at other times too late for the disks."""
    table, folder = write(df, name)
    if now := _scratch.get():
        now.folders.append(folder)
        df.sparkSession._jvm.System.gc()
    return table


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows (a written table) with idx, a row's place from 0 in its group by `order`, nulls first, and n, the group's size.

    Range partitions are sorted; a row's place is that in its partition, less where its group begins there, plus what partitions before
    hold of the group. Rows that are equal fill as many partitions as they need, so no group and no value is one task's work."""
    keys = [group, *order, "tie_"]
    placed = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(placed.withColumn("at_", F.monotonically_increasing_id()).drop("tie_"), "placed").withColumn("part_", F.shiftright("at_", 33))
    each = placed.groupBy(group, "part_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows_").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(group, "part_", (F.col("first_") - before).alias("from_"), F.sum("rows_").over(whole).alias("n"))
    return placed.join(each, [group, "part_"]).withColumn("idx", F.col("at_") - F.col("from_")).drop("at_", "part_", "from_")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Text that is ASCII throughout takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (null: empty) and where each value starts, with the end as last entry."""
    column = column.fill_null("") if column.null_count else column
    wide = "large" in str(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets.astype(np.int64) - offsets[0]


def slices(batch, column: str, limit: int = 1 << 20):
    """Parts of a record batch with about `limit` bytes of the column each; a longer value is a part of its own."""
    if not batch.num_rows:
        return
    sizes = np.diff(flat(batch.column(column))[1])
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)
