"""Queries of sources and single functions: messages, registries, playbooks, pages, identifiers, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions import amounts, personal, text
from docgate.operators import checks, intake, pages, resolve, retrieval, review, rules, triage, verify
from docgate.plans.tables import new_folder, spread
from docgate.registered import query
from docgate.registered import table as _t
from docgate.sources import mail, reference


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as .eml files, with an attachment or two, every fifth without a message id, every seventh without a date."""
    c, line = _t(spark, sf_dir, "customer"), "\r\n"
    k = F.col("c_custkey")
    head = F.concat_ws(
        line,
        F.when(k % 5 != 0, F.format_string("Message-ID: <m%d@example.com>", k)),
        F.concat(F.lit('From: "'), "c_mktsegment", F.lit('" <Sender'), k.cast("string"), F.lit("@Example.com>")),
        F.when(k % 2 == 0, F.lit("Subject: =?utf-8?B?w4RyZ2Vy?=")).otherwise(F.concat(F.lit("Subject: "), "c_name")),
        F.when(k % 7 != 0, F.lit("Date: Tue, 02 Jan 2024 03:04:05 +0100")),
        F.lit("MIME-Version: 1.0"),
        F.lit("Content-Type: multipart/mixed; boundary=XX"),
    )
    part = lambda name, kind, body: F.concat(
        F.lit(f"--XX{line}Content-Type: {kind}{line}Content-Disposition: attachment; filename="), name, F.lit(f"{line}Content-Transfer-Encoding: base64{line}{line}"), F.base64(body), F.lit(line)
    )
    first = part(F.lit("a.PDF"), "application/pdf", F.concat(F.lit("%PDF-"), "c_name").cast("binary"))
    second = F.when(k % 3 == 0, part(F.lit("b.png"), "image/png", F.lit("copy").cast("binary"))).otherwise("")
    body = F.lit(f"--XX{line}Content-Type: text/plain{line}{line}hello{line}")
    raw = F.concat(head, F.lit(line * 2), body, F.when(k % 11 != 0, F.concat(first, second)).otherwise(""), F.lit(f"--XX--{line}"))
    files = c.select(F.format_string("f%d.eml", k).alias("path"), F.to_timestamp(F.lit("2024-02-02")).alias("modificationTime"), raw.cast("binary").alias("content"))
    return mail.messages(spread(files, "path"))


@query(
    """SELECT 'f' || c_custkey || '.eml' AS source, CASE WHEN c_custkey % 5 <> 0 THEN '<m' || c_custkey || '@example.com>' ELSE 'made' END AS message_id,
  'sender' || c_custkey || '@example.com' AS sender, CASE WHEN c_custkey % 2 = 0 THEN 'Ärger' ELSE c_name END AS subject,
  CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-02 02:04:05' ELSE TIMESTAMP '2024-02-02' END AS received_at,
  CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attachments FROM customer"""
)
def mail_headers(spark, sf_dir):
    """Identifier (made from the bytes where there is none), sender, decoded subject and date of each message."""
    made = F.when(F.col("message_id").rlike("^<sha256-[0-9a-f]{32}@generated>$"), "made").otherwise(F.col("message_id"))
    return _mail(spark, sf_dir).select("source", made.alias("message_id"), "sender", "subject", "received_at", F.size("attachments").alias("attachments"))


@query(
    """WITH m AS (SELECT *, '<m' || c_custkey || '@example.com>' AS id FROM customer WHERE c_custkey % 11 <> 0),
  a AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN id ELSE 'made' END AS message_id, 'a.PDF' AS filename, '%PDF-' || c_name AS body, 'application/pdf' AS declared, '.pdf' AS suffix, c_custkey FROM m
    UNION ALL SELECT 'x', 'b.png', 'copy', 'image/png', '.png', min(c_custkey) FROM m WHERE c_custkey % 3 = 0 HAVING count(*) > 0)
  SELECT filename, sha256(body) || suffix AS stored_name, length(body) AS size_bytes, declared AS declared_mime, 'received' AS status FROM a"""
)
def mail_attachments(spark, sf_dir):
    """Attachments of messages that have some, each content once, under its digest and safe suffix."""
    messages = intake.new_messages(_mail(spark, sf_dir), spark.createDataFrame([], "message_id string"))
    new = intake.new_attachments(messages, spark.createDataFrame([], "sha256 string"))
    return new.select("filename", "stored_name", "size_bytes", "declared_mime", "status")


@query(
    """SELECT sha256(c_name) || CASE c_custkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '' WHEN 2 THEN '.gz' ELSE '' END AS name, length(c_name) AS size FROM customer"""
)
def stored_files(spark, sf_dir):
    """Contents written under their digest and suffix, once, although they are stored twice; then listed."""
    names = F.element_at(F.array(F.lit("A.PDF"), F.lit("none"), F.lit("a.tar.gz"), F.lit("x.toolongsuffix")), (F.col("c_custkey") % 4 + 1).cast("int"))
    files = _t(spark, sf_dir, "customer").select(names.alias("filename"), F.col("c_name").cast("binary").alias("content"))
    folder = new_folder(spark, "files")
    intake.store(files, folder)
    intake.store(files.unionByName(files), folder)
    return intake.stored(spark, folder).select("name", "size")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'office' ELSE 'unknown' END AS kind FROM customer")
def file_heads(spark, sf_dir):
    """Files on disk, whose kind is told from their first bytes."""
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, "%PDF-1").when(k % 3 == 1, "PK\x03\x04word/").otherwise("text")
    folder = new_folder(spark, "heads")
    files = _t(spark, sf_dir, "customer").select(F.format_string("%d.bin", k).alias("filename"), F.concat(body, F.lit(":"), k.cast("string")).cast("binary").alias("content"))
    intake.store(files, folder, named=True)
    heads = intake.read_heads(spark, folder)
    return heads.select(F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long").alias("id"), intake.file_kind(F.col("head")).alias("kind"))


@query("SELECT 'probe' AS folder, count(*) AS unseen FROM customer")
def mailbox_probe(spark, sf_dir):
    """How many messages wait in a folder, without reading them."""
    folder = new_folder(spark, "probe")
    files = _t(spark, sf_dir, "customer").select(F.format_string("%d.eml", "c_custkey").alias("filename"), F.col("c_name").cast("binary").alias("content"))
    intake.store(files, folder, named=True)
    return mail.probe(spark, folder)


@query(
    """SELECT CAST(s_suppkey AS INTEGER) AS ordinal, 'V' || s_suppkey AS id, s_name AS legal_name, CASE WHEN s_suppkey % 2 = 0 THEN 'low' ELSE 'standard' END AS risk_class,
  CASE WHEN s_suppkey % 3 = 0 THEN 'suspended' ELSE 'approved' END AS status FROM supplier"""
)
def registry_scan(spark, sf_dir):
    """A registry written as one JSON file and read back, with defaults for what it leaves out."""
    s = _t(spark, sf_dir, "supplier")
    vendor = F.struct(
        F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("legal_name"), F.array("s_name").alias("aliases"),
        F.when(F.col("s_suppkey") % 2 == 0, "low").alias("risk_class"), F.when(F.col("s_suppkey") % 3 == 0, "suspended").alias("status"),
    )
    folder = new_folder(spark, "registry")
    whole = s.agg(F.array_sort(F.collect_list(F.struct("s_suppkey", vendor.alias("v")))).alias("x")).select(F.transform("x", lambda x: x["v"]).alias("vendors"))
    whole.write.json(folder)
    return reference.read_registry(spark, folder).select("ordinal", "id", "legal_name", "risk_class", "status")


@query(
    """SELECT CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS ordinal, '§' || item_id AS section, 'Title ' || item_id AS title, length(trim(text)) AS body FROM benchmark"""
)
def playbook_sections(spark, sf_dir):
    """benchmark as a Markdown playbook, a section for each item, read back by its headings."""
    part = F.concat(F.lit("## §"), F.col("item_id").cast("string"), F.lit(" Title "), F.col("item_id").cast("string"), F.lit("\n\n"), F.trim("text"), F.lit("\n\n---\n"))
    whole = _t(spark, sf_dir, "benchmark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", part.alias("p")))), lambda x: x["p"]), "").alias("value"))
    folder = new_folder(spark, "playbook")
    whole.select(F.concat(F.lit("# Playbook\n\n"), "value")).write.text(folder)
    return reference.read_playbook(spark, folder).select("ordinal", "section", "title", F.length("body").cast("long").alias("body"))


@query("SELECT 'nation' || n_nationkey AS name, n_nationkey % 2 = 0 AS scanned, n_name AS text FROM nation")
def corpus_scan(spark, sf_dir):
    """A folder of text files, one a nation, some of them marked as scans."""
    k = F.col("n_nationkey").cast("string")
    name = F.concat(F.lit("nation"), k, F.when(F.col("n_nationkey") % 2 == 0, ".scan.txt").otherwise(".txt"))
    folder = new_folder(spark, "corpus")
    intake.store(_t(spark, sf_dir, "nation").select(name.alias("filename"), F.col("n_name").cast("binary").alias("content")), folder, named=True)
    return reference.read_corpus(spark, folder).select("name", "scanned", "text")


@query(
    """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'no file' WHEN 1 THEN 'empty' WHEN 2 THEN 'too large' WHEN 3 THEN 'not accepted: zip' WHEN 4 THEN 'too small an image'
  WHEN 5 THEN 'needs a password' WHEN 6 THEN 'unreadable' WHEN 7 THEN 'no pages' ELSE 'too many pages' END AS reason FROM customer"""
)
def triage_rejections(spark, sf_dir):
    """Each way for a file to be rejected before its text counts, in the order of the rules."""
    k = F.col("c_custkey") % 9
    files = _t(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k == 0, F.lit(None)).when(k == 1, 0).when(k == 2, fixed.MAX_BYTES + 1).when(k == 4, fixed.MIN_IMAGE_BYTES - 1).otherwise(fixed.MAX_BYTES).cast("long").alias("size_bytes"),
        F.when(k == 3, "zip").when(k == 4, "png").otherwise("pdf").alias("file_kind"),
        (k == 5).alias("encrypted"), (k != 6).alias("readable"), F.when(k == 7, 0).when(k == 8, fixed.MAX_PAGES + 1).otherwise(1).alias("page_count"), F.lit("").alias("first_page_text"),
    )
    return triage.triage(files).select("c_custkey", "outcome.reason")


@query(
    """SELECT o_orderkey, greatest(1, CAST(floor(w * least(1.0, 1400.0 / greatest(w, h))) AS INTEGER)) AS width, greatest(1, CAST(floor(h * least(1.0, 1400.0 / greatest(w, h))) AS INTEGER)) AS height,
  round(least(4.0, 1400.0 / greatest(w, h)), 9) AS scale, CAST(floor(w * h / 750.0) AS BIGINT) AS tokens
  FROM (SELECT o_orderkey, CAST(o_orderkey % 3000 + 1 AS DOUBLE) AS w, CAST(o_custkey % 2500 + 1 AS DOUBLE) AS h FROM orders)"""
)
def image_sizes(spark, sf_dir):
    """Images brought down to the longest edge, how far pages are magnified, and what an image costs in tokens."""
    w, h = F.col("o_orderkey") % 3000 + 1, F.col("o_custkey") % 2500 + 1
    size = amounts.image_size(w, h)
    return _t(spark, sf_dir, "orders").select("o_orderkey", size["width"].alias("width"), size["height"].alias("height"), F.round(amounts.render_scale(w, h), 9).alias("scale"), amounts.image_tokens(w, h).alias("tokens"))


@query(
    """SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%.1fs', ms / 1000.0) END AS took, try_cast(CASE o_orderkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'x' ELSE NULL END AS DOUBLE) AS number,
  CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE 'usual' END AS model FROM (SELECT *, o_orderkey % 5000 AS ms FROM orders)"""
)
def small_values(spark, sf_dir):
    """Durations as text, texts as numbers, and overrides before defaults."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "12.5").when(k % 4 == 1, " 7 ").when(k % 4 == 2, "x")
    override = F.when(k % 3 == 0, "own").when(k % 3 == 1, "")
    return _t(spark, sf_dir, "orders").select("o_orderkey", amounts.duration(k % 5000).alias("took"), amounts.number(raw).alias("number"), amounts.chosen_model(override, F.lit("usual")).alias("model"))


_COMPANIES = ("{} GmbH & Co. KG", "The {} Ltd.", "{} s.a. (France)", "Ltd GmbH", "{}-Straße OHG")


@query(
    """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN lower(n_name) || ' co' WHEN 1 THEN 'the ' || lower(n_name) WHEN 2 THEN lower(n_name) || ' france' WHEN 3 THEN 'ltd gmbh' ELSE lower(n_name) || ' strasse' END AS form,
  CASE n_nationkey % 5 WHEN 3 THEN NULL ELSE 'ab1' || n_nationkey END AS number FROM nation"""
)
def company_forms(spark, sf_dir):
    """Company names without legal forms and registration numbers without punctuation."""
    n = _t(spark, sf_dir, "nation")
    name = F.element_at(F.array(*[F.replace(F.lit(c), F.lit("{}"), F.col("n_name")) for c in _COMPANIES]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    number = F.when(F.col("n_nationkey") % 5 == 3, " .- ").otherwise(F.concat(F.lit("AB-1."), F.col("n_nationkey").cast("string"), F.lit(" ")))
    return n.select("n_nationkey", text.company_form(name).alias("form"), text.registration_form(number).alias("number"))


@query(
    """SELECT o_orderkey, lower('É' || regexp_replace(o_orderpriority, '[^0-9A-Za-z]', '', 'g') || 'ss1') AS plain, regexp_replace(o_orderpriority || ' 1.5', '[^0-9]', '', 'g') AS digits FROM orders"""
)
def alphanumeric_forms(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.alphanumeric(F.concat(F.lit("É "), "o_orderpriority", F.lit("-ß 1"))).alias("plain"), text.digits(F.concat("o_orderpriority", F.lit(" 1.5"))).alias("digits"))


_NUMERAL_TEXTS = (("within forty days", True), ("someone else", False), ("binnen dreißig Tagen", True), ("dos meses", True), ("nothing at all", False), ("hundertfünfzig", True), ("sixty-one", True), ("stoned", False))


@query(f"""WITH t(i, yes) AS (VALUES {", ".join(f"({i}, {yes})" for i, (_, yes) in enumerate(_NUMERAL_TEXTS))}) SELECT o_orderkey, yes FROM orders JOIN t ON i = o_orderkey % {len(_NUMERAL_TEXTS)}""")
def numerals(spark, sf_dir):
    """Whether a text has a number in words, as a word or at the beginning of a compound."""
    said = F.element_at(F.array(*[F.lit(t) for t, _ in _NUMERAL_TEXTS]), (F.col("o_orderkey") % len(_NUMERAL_TEXTS) + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.states_a_number(said).alias("yes"))


@query(
    """SELECT doc_id, CASE WHEN length(t) > 420 THEN regexp_replace(substr(t, 1, 420), ' [^ ]*$', '') || ' [...]' ELSE t END AS short
  FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\n\\t\\r\\f\\v]+', ' ', 'g')) AS t FROM documents)"""
)
def shortened(spark, sf_dir):
    """Texts in single blanks, long ones cut at a blank."""
    return _t(spark, sf_dir, "documents").select("doc_id", text.shorten(F.coalesce("text", F.lit(""))).alias("short"))


_LAWS = ("German law", "english law", "Atlantis", "the Netherlands")


@query(
    """WITH t(i, law, has, n) AS (VALUES (0, 'germany', 'federal republic of germany', 6), (1, 'england & wales', 'laws of england', 6), (2, 'atlantis', 'atlantis', 1), (3, 'netherlands', 'dutch law', 4))
  SELECT c_custkey, law, has AS one, true AS found FROM customer JOIN t ON i = c_custkey % 4"""
)
def law_phrasings(spark, sf_dir):
    """How the law that a field names may be written."""
    at = (F.col("c_custkey") % 4 + 1).cast("int")
    has = F.element_at(F.array(*map(F.lit, ("federal republic of germany", "laws of england", "atlantis", "dutch law"))), at)
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, _LAWS)), at).alias("said"), has.alias("one"))
    rows = rows.withColumns({"law": text.jurisdiction(F.col("said")), "folded": text.fold("said")})
    return rows.select("c_custkey", "law", "one", F.array_contains(text.phrasings(F.col("folded"), F.col("law")), F.col("one")).alias("found"))


_QUOTES = (  # name, v_text, v_num, v_bool, quote, whether it supports the value
    ("auto_renewal", None, None, True, "whatever is said", True), ("signatories", "A. Person", None, None, "whatever is said", True),
    ("effective_date", "2024-01-31", None, None, "as of January 2024", True), ("effective_date", "2024-01-31", None, None, "as of January", False),
    ("effective_date", "soon", None, None, "as of January", True), ("governing_law", "German law", None, None, "governed by the laws of Germany", True),
    ("governing_law", "German law", None, None, "governed by Spanish law", False), ("governing_law", "english law", None, None, "Law of England applies", True),
    ("liability_cap", None, 250000.0, None, "a cap of EUR 250.000,00 in all", True), ("liability_cap", None, 250000.0, None, "a cap of EUR 25.000 in all", False),
    ("term_months", None, 12.0, None, "a term of twelve months", True), ("term_months", None, 12.0, None, "a term of some length", False),
    ("counterparty_name", "Foo & Bar Ltd", None, None, "between foo bar ltd. and us", True), ("counterparty_name", "Foo Baz", None, None, "between foo bar ltd. and us", False), ("counterparty_name", "Foo Bar", None, None, "between FOO-BAR and us", True),
)
_QUOTES_SQL = ", ".join(f"({i}, {q[5]})" for i, q in enumerate(_QUOTES))


def _quoted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, each with a field and a quote of _QUOTES: page 1 is a scan where o_custkey % 5 is 4; else page 2 holds the quote where
    it is under 3, no page where it is 3. The page named is 2, or 1 where o_custkey is even."""
    struct = "name string, v_text string, v_num double, v_bool boolean, source_quote string, supports boolean"
    known = spark.createDataFrame([(i, *q) for i, q in enumerate(_QUOTES)], "i long, " + struct)
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 5).alias("kind"), (F.col("o_orderkey") % len(_QUOTES)).alias("i"), (F.col("o_custkey") % 2).alias("odd"))
    rows = o.join(F.broadcast(known), "i")
    fields = rows.select("doc_id", "name", "v_text", "v_num", "v_bool", F.lit(None).cast("string").alias("currency"), F.lit(0.9).alias("confidence"), "source_quote", (1 + F.col("odd")).cast("int").alias("page"), F.lit(None).cast("string").alias("prov_status"))
    page = lambda n, kind, said: F.struct(F.lit(n).alias("number"), kind.alias("kind"), said.alias("text"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    first = page(1, F.when(F.col("kind") == 4, "image").otherwise("text"), F.lit("nothing here"))
    second = page(2, F.lit("text"), F.when(F.col("kind") < 3, F.concat(F.lit("Page.  \n"), F.upper("source_quote"), F.lit(" ..."))).otherwise("other words"))
    return fields, rows.select("doc_id", F.array(first, second).cast(f"array<{pages.PAGE}>").alias("pages"))


@query(
    f"""WITH q(i, ok) AS (VALUES {_QUOTES_SQL}), o AS (SELECT o_orderkey AS doc_id, o_custkey % 5 AS kind, o_custkey % 2 AS odd, ok FROM orders JOIN q ON i = o_orderkey % {len(_QUOTES)})
  SELECT doc_id, CASE WHEN NOT ok THEN 'not_found' WHEN kind < 3 THEN 'verified' WHEN kind = 4 AND odd = 0 THEN 'unverifiable' ELSE 'not_found' END AS prov_status,
  CASE WHEN NOT ok THEN 'quote doesn''t support the value' WHEN kind < 3 AND odd = 1 THEN NULL WHEN kind < 3 THEN 'on page 2, not 1' WHEN kind = 4 AND odd = 0 THEN 'the page is a scan' ELSE 'quote not in the document' END AS prov_note,
  CASE WHEN ok AND (kind < 3 OR kind = 4 AND odd = 0) THEN 0.9::DOUBLE ELSE 0::DOUBLE END AS confidence FROM o"""
)
def quote_verdicts(spark, sf_dir):
    """Each kind of field beside quotes that support its value and that don't, on the page named, another, none, or a scan."""
    return verify.verified(*_quoted(spark, sf_dir)).select("doc_id", "prov_status", "prov_note", "confidence")


@query(
    f"""WITH q(i, ok) AS (VALUES {_QUOTES_SQL}), o AS (SELECT o_orderkey AS doc_id, o_custkey % 5 AS kind, o_custkey % 2 AS odd, ok FROM orders JOIN q ON i = o_orderkey % {len(_QUOTES)}),
  s AS (SELECT doc_id, CASE WHEN NOT ok THEN 'not_found' WHEN kind < 3 THEN 'verified' WHEN kind = 4 AND odd = 0 THEN 'unverifiable' ELSE 'not_found' END AS p FROM o)
  SELECT doc_id % 100 AS doc_id, count(*) FILTER (p = 'verified') AS verified, count(*) FILTER (p = 'unverifiable') AS unverifiable, count(*) FILTER (p = 'not_found') AS not_found, 0 AS absent,
  CAST(count(*) FILTER (p = 'verified') AS INTEGER) AS listed, CAST(count(*) FILTER (p = 'not_found') AS INTEGER) AS invented FROM s GROUP BY 1"""
)
def provenance_totals(spark, sf_dir):
    """How many fields of each hundredth have each verdict, and the lists of their names."""
    fields = verify.verified(*_quoted(spark, sf_dir)).withColumn("doc_id", F.col("doc_id") % 100)
    lists = verify.verdict_lists(fields).select("doc_id", F.size("verified").alias("listed"), F.size("hallucinated").alias("invented"))
    return verify.provenance_counts(fields).join(lists, "doc_id")


def _checksum(number: Column, weights: tuple[int, ...]) -> Column:
    return sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0)) % 11 % 10


_EGN_SQL = " + ".join(f"CAST(substr(n, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(fixed.EGN_WEIGHTS))


@query(
    f"""WITH o AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 35 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS n, o_custkey, o_custkey % 60 AS m, o_orderkey % 35 AS d FROM orders),
  e AS (SELECT *, ({_EGN_SQL}) % 11 % 10 AS own FROM o)
  SELECT o_orderkey, o_custkey % 10 = own AND d BETWEEN 1 AND 31 AND (CASE WHEN m > 40 THEN m - 40 WHEN m > 20 THEN m - 20 ELSE m END) BETWEEN 1 AND 12 AS valid FROM e"""
)
def egn_checks(spark, sf_dir):
    """Ten-digit numbers whose date, century and check digit are right, and others."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(pad(k % 100, 2), pad(c % 60, 2), pad(k % 35, 2), pad(c % 1000, 3), (c % 10).cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", personal.egn(number).alias("valid"))


@query(
    """SELECT o_orderkey, 97 - (1000000000000 + o_orderkey) % 97 = o_custkey % 97 + 1 AS nir, (10000000 * (o_orderkey % 3) + o_custkey) % 23 = o_orderkey % 23 AS nie FROM orders"""
)
def nir_nie_checks(spark, sf_dir):
    """Fifteen-digit numbers with their key, and foreigners' numbers with their letter."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nir = F.concat((k + 1_000_000_000_000).cast("string"), F.lpad((c % 97 + 1).cast("string"), 2, "0"))
    letter = F.substring(F.lit(fixed.DNI_LETTERS), (k % 23 + 1).cast("int"), F.lit(1))
    nie = F.concat(F.element_at(F.array(*map(F.lit, "XYZ")), (k % 3 + 1).cast("int")), F.lit("-"), F.lpad(c.cast("string"), 7, "0"), F.lit(" "), letter)
    return _t(spark, sf_dir, "orders").select("o_orderkey", personal.nir(nir).alias("nir"), personal.nie(nie).alias("nie"))


_PERSONAL = (  # what is said, what is left, and which category was masked
    ("Tel. +44 20 7946 0958 now", "Tel. [PHONE] now", "phone"), ("call +44 20 7946 0958 now", "call +44 20 7946 0958 now", ""),
    ("DNI: 12345678Z.", "DNI: [NATIONAL-ID].", "national_id"), ("DNI: 12345678A.", "DNI: 12345678A.", ""), ("ref 12345678Z.", "ref 12345678Z.", ""),
    ("IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN [IBAN] ok", "iban"), ("IBAN DE88 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00 ok", ""),
    ("Visa 4111 1111 1111 1111", "Visa [CARD]", "card"), ("Visa 4111 1111 1111 1112", "Visa 4111 1111 1111 1112", ""), ("mail to a.b@example.com, please", "mail to [EMAIL], please", "email"),
    ("nothing of that kind", "nothing of that kind", ""),
)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(
    f"""WITH p(i, masked, kind) AS (VALUES {", ".join(f"({i}, {_sql_text(m)}, '{k}')" for i, (_, m, k) in enumerate(_PERSONAL))})
  SELECT o_orderkey AS doc_id, masked || '|' || o_orderpriority || '|' || masked AS text, kind, CASE WHEN kind = '' THEN 0 ELSE 2 END AS n FROM orders JOIN p ON i = o_orderkey % {len(_PERSONAL)}"""
)
def masked_pages(spark, sf_dir):
    """Documents of three pages, two of them with personal data of each category, true and false, labelled and not."""
    said = F.element_at(F.array(*[F.lit(x) for x, _, _ in _PERSONAL]), (F.col("o_orderkey") % len(_PERSONAL) + 1).cast("int"))
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), pages.split_pages(F.concat_ws("\f", said, "o_orderpriority", said)).alias("pages"))
    out = pages.masked(docs)
    found = F.array_join(F.map_keys("redactions"), ",")
    n = F.aggregate(F.map_values("redactions"), F.lit(0), lambda a, b: a + b)
    return out.select("doc_id", F.array_join(F.transform("pages", lambda p: p["text"]), "|").alias("text"), found.alias("kind"), n.alias("n"))


@query(
    """SELECT doc_id, lines AS all_text, CAST(n AS INTEGER) AS blocks, n_image > 0 OR length(trim(text)) > 0 AS usable, n_image AS images FROM
  (SELECT doc_id, coalesce(text, '') AS text, len(string_split(coalesce(text, ''), chr(10))) AS n, coalesce(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, ' ')) >= 60), chr(10)), '') AS lines,
   CAST(0 AS INTEGER) AS n_image FROM documents)"""
)
def page_texts(spark, sf_dir):
    """The text of all text pages, whether any page is of use, and pages as blocks for a model."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", pages.split_pages(F.replace("text", F.lit("\n"), F.lit("\f"))).alias("pages"))
    images = F.size(F.filter(pages.blocks(F.col("pages")), lambda b: b["image_path"].isNotNull()))
    return docs.select("doc_id", pages.all_text(F.col("pages")).alias("all_text"), F.size(pages.blocks(F.col("pages"))).alias("blocks"), pages.usable(F.col("pages")).alias("usable"), images.alias("images"))


@query(
    """SELECT n_nationkey AS query_id, CAST(1 AS INTEGER) AS rank, 'n' || n_nationkey AS section, CAST(1 AS DOUBLE) AS score FROM nation"""
)
def text_search(spark, sf_dir):
    """Every nation's own words, asked of a playbook that has a section for each: the best section by hashed TF-IDF is its own."""
    n = _t(spark, sf_dir, "nation")
    said = F.concat_ws(" ", F.lit("the"), F.lower("n_name"), F.format_string("law%d clause%d term%d", "n_nationkey", "n_nationkey", "n_nationkey"))
    clauses = n.select(F.format_string("n%d", "n_nationkey").alias("section"), F.lit("").alias("title"), said.alias("body"))
    found = retrieval.search_text(n.select(F.col("n_nationkey").alias("query_id"), F.upper(said).alias("text")), clauses, k=1)
    return found.withColumn("score", F.round("score", 6))


def _words_sql(text: str) -> str:
    """Words of a text without accents and case."""
    folded = f"replace(strip_accents(lower(replace(coalesce({text}, ''), 'ß', 'ss'))), '’', chr(39))"
    return f"list_filter(regexp_split_to_array({folded}, '[^\\p{{L}}\\p{{N}}§]+'), lambda w: w <> '')"


_PAIRS_SQL = "list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"


@query(
    f"""WITH sentences AS (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+') AS s FROM documents)),
  asked AS (SELECT doc_id * 100000 + i AS query_id, {_PAIRS_SQL} AS t FROM (SELECT doc_id, i, {_words_sql("s[i + 1]")} AS w FROM sentences) WHERE len(w) > 2),
  clauses AS (SELECT 'b' || item_id AS section, {_PAIRS_SQL} AS t FROM (SELECT item_id, {_words_sql("text")} AS w FROM benchmark)),
  held AS (SELECT section, unnest(t) AS term FROM clauses), said AS (SELECT query_id, unnest(t) AS term FROM asked),
  n AS (SELECT count(*) AS n FROM clauses),
  idf AS (SELECT term, ln((1 + any_value(n)) / (1.0::DOUBLE + count(DISTINCT section))) + 1 AS idf FROM held, n GROUP BY term),
  c AS (SELECT section, term, count(*) * any_value(idf) AS raw FROM held JOIN idf USING (term) GROUP BY ALL),
  q AS (SELECT query_id, term, count(*) * any_value(coalesce(idf, ln(1 + n) + 1)) AS raw FROM said LEFT JOIN idf USING (term), n GROUP BY ALL),
  cn AS (SELECT section, sqrt(sum(raw * raw)) AS length FROM c GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(raw * raw)) AS length FROM q GROUP BY 1),
  near AS (
    SELECT query_id, section, round(sum(q.raw / qn.length * c.raw / cn.length), 9) AS near
    FROM q JOIN c USING (term) JOIN qn USING (query_id) JOIN cn USING (section) GROUP BY ALL),
  every AS (SELECT query_id, section, coalesce(near, 0) AS near FROM (SELECT query_id, section FROM qn, cn) LEFT JOIN near USING (query_id, section)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, section) AS rank FROM every)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, section, round(1 / (3 - 2 * near), 6) AS score FROM ranked WHERE rank <= 3"""
)
def playbook_search(spark, sf_dir):
    """The sentences of all documents, of three words and more, asked of a playbook of the benchmark's passages."""
    sentences = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")).alias("i", "text"))
    words = F.size(F.filter(F.split("text", r"(?U)[^\p{L}\p{N}§]+"), lambda w: w != ""))
    asked = sentences.filter(words > 2).select((F.col("doc_id") * 100000 + F.col("i")).alias("query_id"), "text")
    clauses = _t(spark, sf_dir, "benchmark").select(F.format_string("b%d", "item_id").alias("section"), F.lit("").alias("title"), F.col("text").alias("body"))
    return retrieval.search_text(asked, clauses, k=3).withColumn("score", F.round("score", 6))


@query(
    """SELECT c_custkey AS query_id, '§1 Title' AS citation, '§1 Title ' || repeat('words ', 67) || 'words [...]' AS text FROM customer"""
)
def cited_clauses(spark, sf_dir):
    """Search results with citation and shortened text; a section that isn't there is left out."""
    clauses = spark.range(1).select(F.lit("§1").alias("section"), F.lit("Title").alias("title"), F.repeat(F.lit("words "), 200).alias("body"))
    found = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.array(F.lit("§1"), F.lit("§2"))).alias("section"))
    return retrieval.with_text(found, clauses).select("query_id", "citation", "text")


@query(
    """SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE 'v' || c_custkey END AS vendor_id,
  CASE c_custkey % 4 WHEN 0 THEN 'registration_id' WHEN 1 THEN 'conflict' WHEN 2 THEN 'name' ELSE 'none' END AS matched_on, c_custkey % 4 IN (0, 2) AS sure FROM customer"""
)
def resolve_parties(spark, sf_dir):
    """Counterparties by number, by number of another owner, by name, and none at all."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    coded = F.translate(F.when(k < 1_000_000, F.lpad(k.cast("string"), 6, "0")).otherwise(k.cast("string")), "0123456789", "abcdefghij")
    name = F.concat(coded, F.lit(" x"), F.reverse(coded), F.lit(" work"))  # of two numbers that mirror each other the words differ
    registry = c.select(k.cast("int").alias("ordinal"), F.format_string("v%d", k).alias("id"), name.alias("legal_name"), F.array().cast("array<string>").alias("aliases"), F.format_string("HRB %d", k).alias("registration_id"))
    said = F.when(k % 4 == 1, "zzz zzz").when(k % 4 == 3, "  ").otherwise(F.concat(name, F.lit(" GmbH")))
    asked = c.select(k.alias("query_id"), said.alias("name"), F.when(k % 4 < 2, F.format_string("hrb-%d", k)).alias("registration_id"))
    return resolve.resolve(asked, registry).select("query_id", "vendor_id", "matched_on", (F.col("score") == 1).alias("sure"))


@query(
    """WITH names AS (SELECT p_name AS name, min(p_partkey) AS first, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS words FROM part GROUP BY p_name),
  asked AS (SELECT p_partkey, array_to_string(list_sort(string_split(p_name || ' ' || lower(p_type), ' ')), ' ') AS words FROM part),
  pairs AS (SELECT DISTINCT a.words AS a, n.words AS b, n.name, n.first FROM asked a, names n),
  tables AS ( -- the usual table of common subsequences, row by row, each row the running maximum of what its letter allows
    SELECT *, list_reduce(
      list_transform(string_split(b, ''), lambda c: list_prepend(ascii(c), list_transform(string_split(a, ''), lambda x: ascii(x)))),
      lambda row, x: list_transform(range(len(row)), lambda j: list_max(list_transform(range(j + 1), lambda i: CASE WHEN i > 0 AND x[i + 1] = x[1] THEN row[i] + 1 ELSE row[i + 1] END))),
      list_transform(range(length(a) + 1), lambda x: 0)) AS t FROM pairs),
  ranked AS (SELECT *, 2.0 * t[len(t)] / (length(a) + length(b)) AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, first) AS rank FROM tables)
  SELECT p_partkey, CAST(rank AS INTEGER) AS rank, name AS vendor_id, round(score, 6) AS score FROM asked JOIN ranked ON a = asked.words WHERE rank <= 3"""
)
def resolve_top3(spark, sf_dir):
    """Each part's name with its type behind it, against the distinct names of parts as a registry: the three closest names and how close."""
    p = _t(spark, sf_dir, "part")
    names = p.groupBy(F.col("p_name").alias("id")).agg(F.min("p_partkey").cast("int").alias("ordinal"))
    registry = names.select("ordinal", "id", F.col("id").alias("legal_name"), F.array().cast("array<string>").alias("aliases"))
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    best = resolve.names_against_registry(asked, registry, k=3)
    return best.select(F.col("query_id").alias("p_partkey"), "rank", "vendor_id", F.round("score", 6).alias("score"))


@query(
    """SELECT p_partkey, round(100.0 * 2 * (length(w)) / (2 * length(w) + 1), 6) AS ratio FROM (SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS w FROM part)"""
)
def token_sort_similarity(spark, sf_dir):
    """Each part's name against the name with its words turned round and a letter added to the last of them in order."""
    words = F.array_sort(F.split("p_name", " "))
    last = F.concat(F.element_at(words, -1), F.lit("zz"))
    other = F.array_join(F.reverse(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.substring(last, F.lit(1), F.length(last) - 1)))), " ")
    from docgate.functions.similarity import token_sort_ratio

    return _t(spark, sf_dir, "part").select("p_partkey", F.round(token_sort_ratio(F.col("p_name"), other), 6).alias("ratio"))


@query(
    """SELECT severity, count(*) AS n, min(field) AS field FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'high' END AS severity, 'f' || o_orderkey % 4 AS field FROM orders) GROUP BY 1"""
)
def severities(spark, sf_dir):
    """Severities as they weigh: what isn't low or medium is high."""
    said = F.element_at(F.array(*map(F.lit, (" Low", "MEDIUM", "high", "strange"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    finding = F.struct(said.alias("severity"))
    rows = _t(spark, sf_dir, "orders").select(rules.severity(finding).alias("severity"), F.concat(F.lit("f"), (F.col("o_orderkey") % 4).cast("string")).alias("field"))
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("field").alias("field"))


_RULES_SQL = """SELECT o_orderkey AS id, array_to_string(list_filter([
    CASE WHEN k % 2 = 0 THEN 'suspended_counterparty' END, CASE WHEN k % 3 = 0 THEN 'high_severity_finding' END, CASE WHEN k % 5 = 0 THEN 'unsupported_quote' END,
    CASE WHEN k % 7 = 0 THEN 'partially_unverifiable' END, CASE WHEN k % 2 = 1 THEN 'unresolved_counterparty' END, CASE WHEN k % 11 = 0 THEN 'wholly_unverifiable' END,
    CASE WHEN k % 13 = 0 THEN 'low_severity_finding' END], lambda x: x IS NOT NULL), ',') AS rules FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)"""


@query(_RULES_SQL)
def reasons_by_weight(spark, sf_dir):
    """Reasons, given in the order of the alphabet, by the weight of their rules."""
    k = F.col("o_orderkey")
    given = (("high_severity_finding", 3, 0), ("low_severity_finding", 13, 0), ("partially_unverifiable", 7, 0), ("suspended_counterparty", 2, 0), ("unresolved_counterparty", 2, 1), ("unsupported_quote", 5, 0), ("wholly_unverifiable", 11, 0))
    made = F.array(*[F.when(k % n == r, F.struct(F.lit(rule).alias("rule"), F.lit("m").alias("message"), F.lit("").alias("citation"), F.array().cast("array<string>").alias("fields"))) for rule, n, r in given])
    rows = _t(spark, sf_dir, "orders").select(k.alias("id"), F.filter(made, lambda x: x.isNotNull()).alias("reasons"))
    return rows.select("id", F.array_join(F.transform(rules.by_weight(F.col("reasons")), lambda r: r["rule"]), ",").alias("rules"))


@query(
    """SELECT o_orderkey AS id, array_to_string([ 'b', 'd', 'a', 'c', 'e'], ',') AS fields FROM orders"""
)
def findings_by_severity(spark, sf_dir):
    """Findings high, medium, low, others; in their order within each."""
    made = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(f).alias("field")) for s, f in (("medium", "a"), ("high", "b"), ("low", "c"), ("high", "d"), ("odd", "e"))])
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(rules.findings_by_severity(made), lambda x: x["field"]), ",").alias("fields"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' WHEN o_orderkey % 5 = 0 THEN 'needs_review' ELSE 'auto_approved' END AS route,
  array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'not_a_contract' END, CASE WHEN o_orderkey % 5 IN (0, 1) AND o_orderkey % 5 = 0 THEN 'partially_unverifiable' END,
    CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'wholly_unverifiable' END], lambda x: x IS NOT NULL), ',') AS rules,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'counterparty_name,effective_date,term_months,payment_terms_days,governing_law' ELSE 'term_months' END ELSE '' END AS blocking FROM orders"""
)
def unverifiable_rules(spark, sf_dir):
    """Documents read as something else, with some values on scanned pages, and with all of them there."""
    k = F.col("o_orderkey")
    scanned = lambda name: (k % 5 == 0) & ((k % 2 == 0) | F.lit(name == "term_months"))
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(True).alias("has_value"), F.lit(0.9).alias("confidence"), F.when(scanned(n), "unverifiable").otherwise("verified").alias("prov_status")) for n in fixed.REQUIRED])
    none = F.array().cast("array<struct<ordinal:int,severity:string,field:string,citation:string,explanation:string>>")
    evidence = _t(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "invoice").otherwise("amendment").alias("document_kind"), F.lit("v").alias("counterparty_id"), F.lit(1.0).alias("counterparty_score"),
        F.lit("approved").alias("counterparty_status"), none.alias("findings"), fields.alias("fields"),
    )
    out = rules.decide(evidence)
    return out.select("id", "route", F.array_join(F.transform("reasons", lambda r: r["rule"]), ",").alias("rules"), F.array_join("blocking_fields", ",").alias("blocking"))


@query(
    """SELECT o_orderkey AS doc_id, 'governing_law' AS field, 'offshore law: Law of Bermuda ' || o_orderkey AS explanation FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'term_months', CASE WHEN o_orderkey % 2 = 0 THEN '''x''' ELSE '7' END || ' is not ' || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '7' END || ' {unknown} of 12.5' FROM orders"""
)
def check_messages(spark, sf_dir):
    """Checks read from a JSON file: what is said of values, quoted and not, of limits, and of names that aren't known."""
    folder = new_folder(spark, "checks")
    said = (
        '{"checks": [{"id": "a", "section": "§4", "field": "governing_law", "op": "matches_none", "values": ["bermuda"], "message": "offshore law: {value}", "absent_ok": true, "note": "n"},'
        ' {"id": "b", "section": "§2", "field": "term_months", "op": "gte", "limit": 12.5, "message": "{value!r} is not {value} {unknown} of {limit}"}]}'
    )
    spark.range(1).select(F.lit(said)).write.text(folder)
    policy = checks.read_checks(spark, folder)
    if policy.filter("params['note'] = 'n'").count() != 1:
        raise AssertionError("keys that are left are kept in params")
    k, none = F.col("o_orderkey"), F.lit(None)
    law = F.when(k % 3 == 0, F.concat(F.lit("Law of Bermuda "), k.cast("string"))).otherwise("German law")
    term = F.struct(F.lit("term_months").alias("name"), F.when(k % 2 == 0, "x").alias("v_text"), F.when(k % 2 == 1, 7.0).alias("v_num"))
    both = F.array(F.struct(F.lit("governing_law").alias("name"), law.alias("v_text"), none.cast("double").alias("v_num")), term)
    fields = _t(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(both).alias("f")).select("doc_id", "f.*").withColumns({"v_bool": none.cast("boolean"), "currency": none.cast("string")})
    return checks.findings(fields, fields.select("doc_id", none.cast("string").alias("category")).distinct(), policy).select("doc_id", "field", "explanation")


@query(
    """SELECT c_custkey AS doc_id, 'Payment terms: 30 (page 2) "pay in ' || c_custkey || ' days"' || chr(10) || 'Signatories: not stated' AS request, CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS ran,
  c_custkey % 4 = 0 AS looked FROM customer"""
)
def review_requests(spark, sf_dir):
    """Fields as lines for a reviewer, and whether an agent ran and looked anything up."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    none = F.lit(None)
    pay = F.struct(F.lit("payment_terms_days").alias("name"), F.lit("30").alias("v_text"), F.format_string("pay in %d days", k).alias("source_quote"), F.lit(2).alias("page"))
    sign = F.struct(F.lit("signatories").alias("name"), none.cast("string").alias("v_text"), none.cast("string").alias("source_quote"), none.cast("int").alias("page"))
    fields = c.select(k.alias("doc_id"), F.explode(F.array(pay, sign)).alias("f")).select("doc_id", "f.*").withColumns({"v_num": none.cast("double"), "v_bool": none.cast("boolean")})
    tool = lambda name: F.struct(F.lit(name).alias("tool"))
    trace = F.when(k % 4 == 0, F.array(tool("search_policy"), tool("record_finding"))).when(k % 2 == 0, F.array(tool("record_finding"))).otherwise(F.array().cast("array<struct<tool:string>>"))
    traces = c.select(k.alias("doc_id"), review.agent_ran(trace).alias("ran"), review.looked_up(trace).alias("looked"))
    return review.request(fields).join(traces, "doc_id")
