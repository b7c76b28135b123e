"""Intake: what arrives, once, and what kind of file it is."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgate import fixed
from docgate.plans.tables import spread

#: Names of a folder that are in hand at a time.
NAMES = 10_000

# How files of a kind begin, and their media types.
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "tiff": b"II*\x00", "tiff_be": b"MM\x00*", "zip": b"PK\x03\x04"}
MEDIA = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpeg": "image/jpeg",
    "tiff": "image/tiff",
    "office": "application/vnd.openxmlformats-officedocument",
    "zip": "application/zip",
    "unknown": "application/octet-stream",
}
OFFICE_PARTS = (b"word/", b"xl/", b"ppt/", b"[Content_Types].xml")
ACCEPTED = ("pdf", "png", "jpeg", "tiff")


def file_kind(content: Column) -> Column:
    """What a file is by its first bytes; its name and declared type don't count."""
    head = F.substring(content, 1, fixed.HEAD_BYTES)
    begins = lambda kind: F.startswith(head, F.lit(MAGIC[kind]))
    office = [F.contains(head, F.lit(x)) for x in OFFICE_PARTS]
    return (
        F.when(begins("pdf"), "pdf")
        .when(begins("png"), "png")
        .when(begins("jpeg"), "jpeg")
        .when(begins("tiff") | begins("tiff_be"), "tiff")
        .when(begins("zip") & (office[0] | office[1] | office[2] | office[3]), "office")
        .when(begins("zip"), "zip")
        .otherwise("unknown")
    )


def media_type(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair]), kind), F.lit(MEDIA["unknown"]))


def with_content_key(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumns({"sha256": F.sha2(content, 256), "size_bytes": F.octet_length(content).cast("long")})


def suffix(name: Column) -> Column:
    """The last extension in lower case if it is short and alphanumeric, else an empty string."""
    found = F.lower(F.regexp_extract(name, r"[^/\\.](\.[^./\\]*)$", 1))
    return F.when(found.rlike(r"^\.[a-z0-9]{1,7}$"), found).otherwise("")


def first_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. The window keeps one row a key and task before the shuffle."""
    place = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def latest_of_each(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The row with the largest `by` of each key, as one aggregate: no sort, partial results before the shuffle."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), by).alias("row"))
    return best.select("row.*")


def not_seen(rows: DataFrame, seen: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key isn't among those seen before, one for each key: what an idempotent insert adds.

    Rows are dealt before anything is sorted or kept, so a task holds a share of them and not a whole file; by key and by what orders
    them, so that a key of very many rows is cut to one a task as well. What was seen may repeat a key."""
    dealt = spread(rows, *key, F.pmod(F.xxhash64(*order), F.lit(64)))
    return first_of_each(dealt.join(seen.select(*key), key, "left_anti"), key, order)


def new_messages(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages that are new and have attachments."""
    return not_seen(messages.filter(F.size("attachments") > 0), seen, ["message_id"], [F.col("received_at")])


def new_attachments(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """An attachment for each content not seen before; of equal ones the first in the first message stays."""
    each = messages.select("message_id", "received_at", F.posexplode("attachments").alias("place", "a")).select("message_id", "received_at", "place", "a.*")
    keyed = with_content_key(each).withColumn("stored_name", F.concat("sha256", suffix(F.col("filename"))))
    order = [F.col("received_at"), F.col("message_id"), F.col("place")]
    return not_seen(keyed, seen, ["sha256"], order).withColumn("status", F.lit("received"))


def store(files: DataFrame, folder: str, named: bool = False) -> None:
    """Write the content of each file (filename, content) below a folder that all executors see, under its digest and safe suffix, or
    under its own name. The folder's address may be of any file system that Arrow knows (a path, file:, hdfs:, s3:); one that it doesn't
    know fails. A file that is there already is left; one appears only when it is whole, so a task that is run again does no harm. Of
    contents under one name that with the smallest digest is written."""
    keyed = with_content_key(files)
    name = F.col("filename") if named else F.concat("sha256", F.coalesce(suffix(F.col("filename")), F.lit("")))
    rows = first_of_each(spread(keyed.select(name.alias("name"), "sha256", "content"), "name"), ["name"], [F.col("sha256")])
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        own = f"{path}/.{uuid.uuid4().hex}"  # a task's own, so that tasks don't wait for each other but to move a file
        made = False
        for batch in batches:
            for start in range(0, batch.num_rows, NAMES):
                part = batch.slice(start, NAMES)
                names = part["name"].to_pylist()
                there = system.get_file_info([f"{path}/{name}" for name in names])
                for name, content, known in zip(names, part["content"], there, strict=True):
                    if name is None or known.is_file:
                        continue
                    if not made:
                        system.create_dir(own)
                        made = True
                    with system.open_output_stream(f"{own}/{name}", compression=None) as out:  # as it is, also where a name ends in .gz
                        out.write(content.as_buffer())
                    system.move(f"{own}/{name}", f"{path}/{name}")
            yield batch.select(["name"])
        if made:
            system.delete_dir(own)

    rows.select("name", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def _names(folder: str) -> Iterator[str]:
    """The names of a folder's files, but of those that are hidden or being written; of a local one they are read as they come."""
    system, path = pafs.FileSystem.from_uri(folder)
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(path) as entries:
            yield from (e.name for e in entries if e.name[0] not in "._" and e.is_file())
    else:
        yield from (f.base_name for f in system.get_file_info(pafs.FileSelector(path)) if f.base_name[0] not in "._" and f.is_file)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """name of each file of a folder. One task lists it and nothing of it is kept by the driver, which would hold a record for each file and
    plan a task for every few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for name in _names(folder) if batch.num_rows else ():
                names.append(name)
                if len(names) == NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(names)], ["name"])
                    names = []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "name string")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder: name, size. Their contents aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = [f.size for f in system.get_file_info([f"{path}/{name}" for name in batch["name"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(sizes, pa.int64())], ["name", "size"])

    return spread(listed(spark, folder), "name").mapInArrow(run, "name string, size long")


def read_heads(spark: SparkSession, folder: str) -> DataFrame:
    """path and head, the first bytes of each file of a folder, as many as tell its kind. No more of a file is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            heads = []
            for name in batch["name"].to_pylist():
                with system.open_input_file(f"{path}/{name}") as file:
                    heads.append(file.read(fixed.HEAD_BYTES))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in batch["name"].to_pylist()], pa.string()), pa.array(heads, pa.binary())], ["path", "head"])

    return spread(listed(spark, folder), "name").mapInArrow(run, "path string, head binary")
