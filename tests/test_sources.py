from datetime import datetime, timezone
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from docgate.sources import mail, reference
from docgate.streaming.intake import append_new, spending, start_intake


def message(subject="Договор", name="contract.pdf", identifier="<1@x>"):
    m = EmailMessage()
    m["Subject"], m["From"], m["Date"] = subject, "A Person <A.Person@Example.org>", "Mon, 01 Apr 2024 10:00:00 +0200"
    if identifier:
        m["Message-ID"] = identifier
    m.set_content("see attached")
    if name:
        m.add_attachment(b"%PDF-1.7", maintype="application", subtype="pdf", filename=name)
    return bytes(m)


def test_messages(spark, tmp_path):
    for i, raw in enumerate((message(), message(name=None, identifier=None), b"not a message")):
        (tmp_path / f"{i}.eml").write_bytes(raw)
    rows = sorted(mail.read_mailbox(spark, str(tmp_path)).collect(), key=lambda r: r.source)
    assert (rows[0].message_id, rows[0].sender, rows[0].subject) == ("<1@x>", "a.person@example.org", "Договор")
    assert rows[0].received_at == datetime(2024, 4, 1, 8) and rows[0].attachments[0].filename == "contract.pdf"
    assert rows[1].attachments == [] and rows[1].message_id.startswith("<sha256-") and rows[2].attachments == []


def test_headers_and_dates():
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert mail.header("=?utf-8?b?0JTQvtCz0L7QstC+0YA=?=") == "Договор" and mail.header("=?no-such?q?x?=") and mail.header(None) == ""
    assert mail.sent_at(None, now) == now and mail.sent_at("rubbish", now) == now


def test_personal_mailboxes_are_refused(spark, tmp_path):
    folder = tmp_path / "INBOX"
    folder.mkdir()
    for i in range(101):
        (folder / f"{i}.eml").write_bytes(b"x")
    with pytest.raises(ValueError, match="personal"):
        mail.read_mailbox(spark, str(folder))


def test_reference_data(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"vendors": [{"id": "V1", "legal_name": "A"}, {"id": "V2", "legal_name": "B", "aliases": ["C"], "status": "suspended"}]}')
    rows = reference.read_registry(spark, str(tmp_path / "v.json")).orderBy("ordinal").collect()
    assert [(r.id, r.status, r.risk_class) for r in rows] == [("V1", "approved", "standard"), ("V2", "suspended", "standard")]
    (tmp_path / "p.md").write_text("# Playbook\n\n## §1.1 Terms\n\nPay.\n\n---\n\n## §2 Law\nBody\n## Not a section\nmore")
    sections = reference.read_playbook(spark, str(tmp_path / "p.md")).orderBy("ordinal").collect()
    assert [(r.section, r.title) for r in sections] == [("§1.1", "Terms"), ("§2", "Law")] and sections[0].body == "Pay."
    for folder, name in (("authored", "one.txt"), ("generated", "two.scan.txt")):
        (tmp_path / "docs" / folder).mkdir(parents=True)
        (tmp_path / "docs" / folder / name).write_text("a\fb")
    corpus = reference.read_corpus(spark, str(tmp_path / "docs")).orderBy("name").collect()
    assert [(r.name, r.label, r.scanned) for r in corpus] == [("one", "authored", False), ("two", "generated", True)]


def test_intake_stream_adds_each_key_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, x string").write.parquet(source)
    for run in ("a", "b"):
        stream = spark.readStream.schema("id long, x string").parquet(source)
        start_intake(stream, target, str(tmp_path / f"checkpoint-{run}"), "id", trigger={"availableNow": True}).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2]
    append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id long, x string"), target, "id")
    assert spark.read.parquet(target).count() == 3


def test_spending_by_window(spark):
    calls = spark.createDataFrame([(datetime(2024, 1, 1, 0, 1), "a", 1.0), (datetime(2024, 1, 1, 0, 2), "a", 2.0), (datetime(2024, 1, 1, 0, 11), "a", 4.0)], "ts timestamp, purpose string, usd double")
    assert sorted(r.usd for r in spending(calls).select(F.col("usd")).collect()) == [3.0, 4.0]
