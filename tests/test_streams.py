"""Keyed state with timers across restarts, intake that reads little, and the mailbox as a source."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docgate.sources import mail
from docgate.streaming import intake
from docgate.streaming.retries import OUTCOME, followed
from tests.test_sources import message


def fed(spark, folder, rows):
    spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("append").parquet(folder)


def started(spark, tmp_path, seconds, **kw):
    stream = spark.readStream.schema(OUTCOME).parquet(str(tmp_path / "in"))
    write = lambda rows, number: rows.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))
    said = followed(stream, **kw)
    return said.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime=f"{seconds} seconds").start()


def until(running, ready, seconds=240):
    began = time.time()
    while not ready():
        if running.exception() or time.time() - began > seconds:
            raise AssertionError(f"not reached: {running.exception()}")
        time.sleep(0.5)


def test_a_wait_ends_by_the_clock_once_and_across_a_restart(spark, tmp_path):
    out = str(tmp_path / "out")

    def due():
        try:
            return [(r.id, r.attempts, list(r.failures)) for r in spark.read.parquet(out).filter("due").collect()]
        except Exception:  # nothing was written yet
            return []

    fed(spark, str(tmp_path / "in"), [(1, 1, "failed", True), (2, 1, "failed", True), (3, 1, "failed", False), (None, 1, "failed", True)])
    known = spark.createDataFrame([(1, 0, "waiting", 1), (9, 5, "advanced", 0)], "id long, n long, status string, attempts int")
    running = started(spark, tmp_path, 1, waits=(45, 45, 45), known=known)
    until(running, lambda: spark.read.parquet(out).count() >= 3 if (tmp_path / "out" / "batch=0" / "_SUCCESS").exists() else False)
    fed(spark, str(tmp_path / "in"), [(2, 2, "advanced", None)])  # comes before its wait is over
    until(running, lambda: spark.read.parquet(out).filter("id = 2 and status = 'advanced'").count() == 1)
    running.stop()
    rows = {(r.id, r.n): (r.status, r.attempts, r.wait_seconds, list(r.failures)) for r in spark.read.parquet(out).collect()}
    assert rows[1, 1] == ("waiting", 2, 45, [1]) and rows[3, 1] == ("dead", 1, 0, [1]) and rows[2, 2] == ("advanced", 0, 0, []) and due() == []
    running = started(spark, tmp_path, 1, waits=(45, 45, 45), known=known)
    until(running, lambda: due() != [])
    time.sleep(4)
    running.stop()
    assert due() == [(1, 2, [1])]


def test_a_batch_reads_the_folders_of_its_keys_alone(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = lambda day, ids: spark.createDataFrame([(i, datetime(2024, 1, day)) for i in ids], "id long, at timestamp")
    intake.append_new(rows(1, range(100)), target, "id", "at")
    batch = rows(1, [5, 500])
    near = lambda: intake.seen_near(intake._placed(batch, "id", "at"), target, "id").count()
    before = near()
    for day in range(2, 8):
        intake.append_new(rows(day, range(1000 * day, 1000 * day + 100)), target, "id", "at")
    assert near() == before <= 20 and spark.read.parquet(target).count() == 700
    intake.append_new(batch, target, "id", "at")
    intake.append_new(batch, target, "id", "at")
    assert spark.read.parquet(target).count() == 701
    with_null = spark.createDataFrame([(7, None), (8, None)], "id long, at timestamp")
    intake.append_new(with_null, target, "id", "at")
    intake.append_new(with_null, target, "id", "at")
    assert spark.read.parquet(target).count() == 703


@pytest.mark.parametrize("within", ["1 hour", "1 second"])
def test_keys_that_come_again_soon_or_late(spark, tmp_path, within):
    """Within the time the stream's state knows them, beyond it the table does."""
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for run in range(3):
        spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (10 + run, "c")], "id long, x string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("id long, x string").parquet(folder)
        running = intake.start_intake(stream, target, str(tmp_path / "checkpoint"), "id", within=within, trigger={"availableNow": True})
        running.awaitTermination()
        time.sleep(1.5)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 10, 11, 12]


def test_a_mailbox_is_marked_when_its_batch_stands(spark, tmp_path):
    """A batch that fails is read again and marks nothing; the oldest come first, so many at a time."""
    mail.register(spark)
    box, out = tmp_path / "contracts", []
    box.mkdir()
    for i in range(5):
        (box / f"{9 - i}.eml").write_bytes(message(identifier=f"<{i}@x>"))
        time.sleep(0.02)
    (box / "notes.txt").write_text("no message")
    stream = lambda: spark.readStream.format("mailbox").option("path", str(box)).option("limit", 2).load()

    def broken(rows, number):
        out.append(sorted(r.message_id for r in rows.collect()))
        raise InterruptedError("before it stands")

    def stands(rows, number):
        out.append(sorted(r.message_id for r in rows.collect()))

    start = lambda each: stream().writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    running = start(broken)
    with pytest.raises(Exception, match="before it stands"):
        running.awaitTermination()
    assert out == [["<0@x>", "<1@x>"]] and not (box / "seen").exists()
    running = start(stands)
    until(running, lambda: (box / "seen").exists() and len(list((box / "seen").iterdir())) == 5)
    running.stop()
    assert out[1] == out[0] and sorted(m for batch in out[1:] for m in set(batch)) == [f"<{i}@x>" for i in range(5)]
    assert (box / "notes.txt").exists() and [p.name for p in box.glob("*.eml")] == []


def test_a_mailbox_read_at_once(spark, tmp_path):
    mail.register(spark)
    for i in range(3):
        (tmp_path / f"{i}.eml").write_bytes(message(identifier=f"<{i}@x>"))
    rows = spark.read.format("mailbox").option("path", str(tmp_path)).option("limit", 2).load()
    assert sorted((r.message_id, r.attachments[0].filename) for r in rows.collect()) == [(f"<{i}@x>", "contract.pdf") for i in range(3)]
    assert rows.select(F.explode("attachments").alias("a")).filter("a.declared_mime = 'application/pdf'").count() == 3
    inbox = tmp_path / "INBOX"
    inbox.mkdir()
    for i in range(101):
        (inbox / f"{i}.eml").write_bytes(b"x")
    with pytest.raises(Exception, match="personal mailbox"):
        spark.read.format("mailbox").option("path", str(inbox)).load().count()


def test_a_batch_writes_a_file_for_each_folder(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).select("id", F.lit(datetime(2024, 1, 1)).alias("at"))
        intake.append_new(rows, str(tmp_path / "t"), "id", "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folders = [f for f in (tmp_path / "t").glob("*/*") if f.is_dir()]
    assert len(folders) == len(list((tmp_path / "t").glob("*/*/*.parquet"))) and spark.read.parquet(str(tmp_path / "t")).count() == 2000
