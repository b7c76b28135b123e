"""Messages from files."""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Iterator
from datetime import datetime, timezone
from email import message_from_bytes
from email.header import decode_header, make_header
from email.utils import parseaddr, parsedate_to_datetime

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docgate.operators.intake import listed

MESSAGE = (
    "message_id string, sender string, subject string, received_at timestamp, source string, "
    "attachments array<struct<filename:string,content:binary,declared_mime:string>>"
)
#: A mailbox of this name with more unread messages is taken for a person's.
PERSONAL, PERSONAL_MESSAGES = "inbox", 100
#: The folder that messages are forwarded to.
INTAKE = "contracts"


def header(raw: str | None) -> str:
    """A header with its encoded words decoded; one that can't be is left as it is."""
    try:
        return str(make_header(decode_header(raw or ""))).strip()
    except (LookupError, UnicodeError, ValueError):
        return (raw or "").strip()


def sent_at(raw: str | None, fallback: datetime) -> datetime:
    try:
        found = parsedate_to_datetime(raw or "")
    except (TypeError, ValueError):
        return fallback
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def parse(raw: bytes, source: str, fallback: datetime) -> tuple:
    """A message as a row of MESSAGE. One without an identifier gets one from its bytes."""
    message = message_from_bytes(raw)
    attachments = []
    for part in message.walk():
        name = part.get_filename()
        if part.is_multipart() or not (name or part.get_content_disposition() == "attachment"):
            continue
        content = part.get_payload(decode=True)
        if content:
            attachments.append({"filename": header(name), "content": content, "declared_mime": part.get_content_type()})
    key = (message.get("Message-ID") or "").strip() or f"<sha256-{hashlib.sha256(raw).hexdigest()[:32]}@generated>"
    sender = parseaddr(header(message.get("From")))[1].lower()
    return key, sender, header(message.get("Subject")), sent_at(message.get("Date"), fallback).astimezone(timezone.utc), source, attachments


def messages(files: DataFrame) -> DataFrame:
    """Messages of a binaryFile DataFrame (path, modificationTime, content), also a streaming one."""

    def run(batches):
        for batch in batches:
            rows = [parse(bytes(c), p, t.to_pydatetime().replace(tzinfo=timezone.utc)) for p, t, c in zip(batch["path"], batch["modificationTime"], batch["content"], strict=True)]
            names = [x.strip().split()[0] for x in ("message_id", "sender", "subject", "received_at", "source", "attachments")]
            out = pd.DataFrame(rows, columns=names)
            out["received_at"] = pd.to_datetime(out["received_at"], utc=True)
            yield out

    return files.select("path", "modificationTime", "content").mapInPandas(run, MESSAGE)


def probe(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the folder's name and how many messages wait in it. No message is read."""
    files = listed(spark, folder).filter(F.endswith("name", F.lit(".eml")))
    return files.agg(F.lit(folder.rstrip("/").rpartition("/")[2]).alias("folder"), F.count(F.lit(1)).alias("unseen"))


def read_mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """All .eml files of a folder. A personal mailbox with many messages is refused, and any folder but that of the intake warned of."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder)
    if folder.rstrip("/").rpartition("/")[2].lower() == PERSONAL and files.select("path").limit(PERSONAL_MESSAGES + 1).count() > PERSONAL_MESSAGES:
        raise ValueError(f"{folder} looks like a personal mailbox")
    if folder.rstrip("/").rpartition("/")[2].lower() != INTAKE:
        warnings.warn(f"{folder} isn't the folder {INTAKE}: are these messages meant for the intake?", stacklevel=2)
    return messages(files)


class Mailbox(DataSource):
    """Format "mailbox": the messages that wait in a folder of .eml files, as rows of MESSAGE.

    Options: path (a folder that driver and executors see, by any address that Arrow's file systems know) and limit (messages a batch of a
    stream, 25). A stream gives the oldest first; what a batch gave is moved to the folder `seen` when the batch stands, not before, so
    a batch that failed is read again. A personal mailbox with many messages is refused."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(self.options)

    def streamReader(self, schema) -> MailboxStream:  # noqa: N802
        return MailboxStream(self.options)


class Letters(InputPartition):
    """Names of messages that one task reads."""


class MailboxReader(DataSourceReader):
    """All messages that wait, none of which is marked."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.limit = options["path"].rstrip("/"), int(options.get("limit", "25"))

    def files(self):
        """The file system and the folder's path in it."""
        return pafs.FileSystem.from_uri(self.folder)

    def waiting(self) -> list[str]:
        """Names of the messages that wait, the oldest first."""
        system, path = self.files()
        found = [f for f in system.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.endswith(".eml")]
        if self.folder.rpartition("/")[2].lower() == PERSONAL and len(found) > PERSONAL_MESSAGES:
            raise ValueError(f"{self.folder} looks like a personal mailbox")
        return [f.base_name for f in sorted(found, key=lambda f: (f.mtime_ns, f.base_name))]

    def partitions(self) -> list[InputPartition]:
        names = self.waiting()
        return [Letters(names[i : i + self.limit]) for i in range(0, len(names), self.limit)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, path = self.files()
        for name in partition.value:
            where = next((p for p in (f"{path}/{name}", f"{path}/seen/{name}") if system.get_file_info(p).is_file), None)
            if where is None:  # taken away by another
                continue
            with system.open_input_file(where) as file:
                at = system.get_file_info(where).mtime or datetime.now(timezone.utc)
                *fields, attachments = parse(file.read(), f"{self.folder}/{name}", at)
            yield (*fields, [(a["filename"], a["content"], a["declared_mime"]) for a in attachments])


class MailboxStream(DataSourceStreamReader):
    """An offset names the messages of its batch. Offsets of another start of the stream differ, so that one begun anew goes on where
    nothing was marked yet; a message may then come twice, as from a mailbox."""

    def __init__(self, options: dict[str, str]) -> None:
        self.box, self.run, self.given = MailboxReader(options), uuid.uuid4().hex, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"run": "", "names": []}

    def latestOffset(self) -> dict:  # noqa: N802
        waiting = self.box.waiting()
        out = set(self.given["names"]) if self.given else set()
        fresh = [n for n in waiting if n not in out][: self.box.limit]
        if fresh or not self.given or self.given["names"]:  # with none left, an empty batch lets the last one be marked
            self.given = {"run": self.run, "names": fresh}
        return self.given

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.given = self.given or end  # a batch that is run again
        names = end["names"]
        return [Letters(names[i : i + 5]) for i in range(0, len(names), 5)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.box.read(partition)

    def commit(self, end: dict) -> None:
        system, path = self.box.files()
        system.create_dir(f"{path}/seen")
        for name in end["names"]:
            if system.get_file_info(f"{path}/{name}").is_file:
                system.move(f"{path}/{name}", f"{path}/seen/{name}")


def register(spark: SparkSession) -> None:
    """Make the format "mailbox" known to a session."""
    spark.dataSource.register(Mailbox)
