"""Registered queries: each runs an operator over whole test tables, beside DuckDB SQL for the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions import amounts, personal, text
from docgate.operators import checks, deliver, evaluate, intake, ledger, pages, retrieval, review, rules, triage, verify
from docgate.plans import batch
from docgate.plans.store import Store
from docgate.plans.tables import new_folder, spread
from docgate.registered import ORACLE_SQL, QUERIES, query
from docgate.registered import table as _t
from docgate.streaming.intake import start_intake
from docgate.streaming.retries import followed


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger: purpose, dollars, and tokens from the number in props."""
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("attachment_id"),
        F.col("event_type").alias("purpose"),
        "ts",
        F.col("value").alias("usd"),
        k.alias("input_tokens"),
        (k * 2).alias("output_tokens"),
        (k % 7).alias("cache_read_tokens"),
        (k % 3).alias("cache_write_tokens"),
    )


_CALLS_SQL = """calls AS (SELECT event_id AS id, user_id AS attachment_id, event_type AS purpose, value AS usd,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(
    f"""WITH {_CALLS_SQL}, s AS (SELECT purpose, count(*) AS calls, round(sum(usd), 6) AS usd, CAST(sum(k) AS BIGINT) AS input_tokens,
  CAST(sum(k * 2) AS BIGINT) AS output_tokens, CAST(sum(k % 7) AS BIGINT) AS cache_read_tokens,
  CAST(sum(k % 3) AS BIGINT) AS cache_write_tokens FROM calls GROUP BY 1)
  SELECT *, round(CASE WHEN input_tokens + cache_read_tokens + cache_write_tokens > 0
  THEN cache_read_tokens / (input_tokens + cache_read_tokens + cache_write_tokens) ELSE 0 END, 3) AS hit_ratio FROM s"""
)
def ledger_by_purpose(spark, sf_dir):
    return ledger.by_purpose(_calls(spark, sf_dir))


@query(ORACLE_SQL["ledger_by_purpose"])
def ledger_in_batches(spark, sf_dir):
    """The report by purpose from sums that batches were merged into one after the other, some of them twice."""
    calls, store = _calls(spark, sf_dir), Store(spark, new_folder(spark, "sums"))
    for batch in (2, 0, 2, 1, 3, 0):
        ledger.add_batch(store, calls.filter(F.col("id") % 4 == batch), batch)
    return ledger.kept_by_purpose(store)


def _attachments(spark, sf_dir):
    status = F.when(F.col("c_mktsegment") == "BUILDING", "delivered").otherwise("received")
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"))


@query(
    f"""WITH {_CALLS_SQL} SELECT c_custkey AS attachment_id, round(coalesce(sum(usd), 0), 6) AS usd
  FROM customer LEFT JOIN calls ON attachment_id = c_custkey GROUP BY 1"""
)
def ledger_per_document(spark, sf_dir):
    return ledger.per_document(_calls(spark, sf_dir), _attachments(spark, sf_dir)).withColumn("usd", F.round("usd", 6))


@query(
    f"""WITH {_CALLS_SQL}, d AS (SELECT count(*) AS delivered FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT round(sum(usd), 4) AS usd, any_value(delivered) AS delivered, round(sum(usd) / nullif(any_value(delivered), 0), 4) AS usd_each
  FROM calls, d"""
)
def ledger_totals(spark, sf_dir):
    return ledger.totals(_calls(spark, sf_dir), _attachments(spark, sf_dir)).withColumns({"usd": F.round("usd", 4), "usd_each": F.round("usd_each", 4)})


_RATES = (("view", 3.0, 15.0), ("click", 1.0, 5.0), ("purchase", 5.0, 25.0), ("signup", 0.25, 1.25), ("error", 2.0, 8.0))


@query(
    f"""WITH {_CALLS_SQL}, rates(model, i, o) AS (VALUES {", ".join(map(str, _RATES))})
  SELECT purpose, round(sum((k * i + (k % 3) * i * 1.25 + (k % 7) * i * 0.1 + k * 2 * o) / 1e6), 6) AS usd
  FROM calls JOIN rates ON model = purpose GROUP BY 1"""
)
def ledger_priced(spark, sf_dir):
    rates = spark.createDataFrame(_RATES, "model string, input_rate double, output_rate double")
    calls = _calls(spark, sf_dir).withColumn("model", F.col("purpose"))
    return ledger.priced(calls, rates).groupBy("purpose").agg(F.round(F.sum("usd"), 6).alias("usd"))


@query(
    f"""WITH {_CALLS_SQL}, w AS (SELECT id, coalesce(sum(usd) OVER (PARTITION BY attachment_id ORDER BY id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM calls)
  SELECT id, round(s, 4) AS spent_before, round(s, 4) < 400 AS allowed FROM w"""
)
def running_budget(spark, sf_dir):
    out = ledger.within_budget(_calls(spark, sf_dir), 400.0)
    return out.select("id", F.round("spent_before", 4).alias("spent_before"), (F.round("spent_before", 4) < 400).alias("allowed"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return ledger.status_counts(_t(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return intake.latest_of_each(_t(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


def _queue(spark, sf_dir):
    status = F.create_map(*map(F.lit, ("O", "received", "F", "extracted", "P", "delivered")))
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.try_element_at(status, F.col("o_orderstatus")).alias("status"),
        (F.col("o_custkey") % 4).alias("attempts"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("retry_after"),
        F.col("o_orderdate").alias("updated_at"),
    )


_QUEUE_SQL = """q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'received' WHEN 'F' THEN 'extracted' WHEN 'P' THEN 'delivered' END AS status,
  o_custkey % 4 AS attempts, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS retry_after, o_orderdate AS updated_at FROM orders)"""
_RUNNABLE_SQL = "status IN ('received', 'extracted') AND attempts < 3 AND (retry_after IS NULL OR retry_after <= TIMESTAMP '1996-01-01')"


@query(
    f"""WITH {_QUEUE_SQL} SELECT id, row_number() OVER (ORDER BY CASE status WHEN 'extracted' THEN 3 ELSE 0 END DESC, updated_at, id) AS place
  FROM q WHERE {_RUNNABLE_SQL} ORDER BY place LIMIT 100"""
)
def queue_pick_order(spark, sf_dir):
    """The head of the queue: a limit is what this operator is."""
    picked = batch.pick_order(batch.runnable(_queue(spark, sf_dir), F.to_timestamp(F.lit("1996-01-01"))), fixed.QUEUE_ROWS)
    order = Window.orderBy(batch.progress(F.col("status")).desc(), "updated_at", "id")  # over the limited head alone
    return picked.select("id", F.row_number().over(order).cast("long").alias("place"))


@query(
    f"""WITH {_QUEUE_SQL}, r AS (SELECT *, {_RUNNABLE_SQL} AS due FROM q)
  SELECT CASE WHEN NOT due THEN status WHEN id % 3 = 0 THEN CASE WHEN attempts + 1 >= 3 OR id % 9 = 0 THEN 'dead' ELSE status END
  WHEN status = 'received' THEN 'triaged' ELSE status END AS status, count(*) AS n FROM (SELECT id, status, attempts, due AND status = 'received' AS due FROM r) GROUP BY 1"""
)
def stage_transitions(spark, sf_dir):
    """One stage over the whole queue: a third of its rows fails, some of them for good."""
    fails = F.col("id") % 3 == 0
    outcome = F.struct(
        F.when(fails, "failed").otherwise("advanced").alias("tag"),
        F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("string").alias("reason"),
        F.lit("E").alias("error_class"),
        (F.col("id") % 9 != 0).alias("retryable"),
    )
    stage = batch.Stage(2, "triage", "received", "triaged", lambda rows: rows.withColumn("outcome", outcome))
    rows = _queue(spark, sf_dir).withColumn("status_reason", F.lit(None).cast("string"))
    after, _ = batch.run_stage(rows, stage, F.to_timestamp(F.lit("1996-01-01")))
    return ledger.status_counts(after)


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS id, c_name, n_name, r_name, p_name, s_name, o_orderpriority
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE l_returnflag = 'R' ORDER BY id DESC LIMIT 100"""
)
def review_queue_join(spark, sf_dir):
    """The newest hundred items of the queue, over six joins: the limit is the page shown."""
    own = {
        "orders": _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), "o_orderpriority"),
        "customer": _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_id"), "c_name"),
        "nation": _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region_id"), "n_name"),
        "region": _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), "r_name"),
        "part": _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"),
        "supplier": _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"),
    }
    items = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id")
    )
    chain = (("orders", "order_id"), ("customer", "customer_id"), ("nation", "nation_id"), ("region", "region_id"), ("part", "part_id"), ("supplier", "supplier_id"))
    out = review.chained(items, own, chain).select("id", "c_name", "n_name", "r_name", "p_name", "s_name", "o_orderpriority")
    return out.orderBy(F.desc("id")).limit(fixed.QUEUE_ROWS)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY sha256(text)")
def dedup_content(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    keyed = intake.with_content_key(files).select("doc_id", "sha256")
    return intake.first_of_each(keyed, ["sha256"], [F.col("doc_id")])


@query(
    """SELECT o_orderstatus, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"""
)
def idempotent_insert(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = intake.not_seen(orders.unionByName(orders), orders.filter("o_orderstatus = 'F'"), ["o_orderkey"], [F.col("o_orderstatus")])
    return new.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_HEADS = {0: b"%PDF-1.7\n", 1: b"\x89PNG\r\n\x1a\n", 2: b"\xff\xd8\xff\xe0", 3: b"PK\x03\x04..word/document.xml", 4: b"MM\x00*", 5: b"MZ"}


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'office' WHEN 4 THEN 'tiff' ELSE 'unknown' END AS kind FROM documents")
def sniff_content(spark, sf_dir):
    heads = F.create_map(*[F.lit(x) for pair in _HEADS.items() for x in pair])
    content = F.concat(F.try_element_at(heads, (F.col("doc_id") % 6).cast("int")), F.col("text").cast("binary"))
    return _t(spark, sf_dir, "documents").select("doc_id", intake.file_kind(content).alias("kind"))


def _sql_list(terms) -> str:
    return "[" + ", ".join("'" + text.fold_text(t).replace("'", "''") + "'" for t in terms) + "]"


#: What documents are made to begin with, so that each kind and way to it occurs.
_LEADS = (
    "", "This agreement is between the supplier and us. ", "Dieser Vertrag regelt Leistungen und Haftung. ", "Invoice: amount due, subtotal. ",
    "Certificate of origin, with an agreement and its clause. ", "Agreement. ", "El presente contrato, cláusula 1. ", "A quotation. ", "Rechnung, Gesamtbetrag. Whereas services. ",
)


def _begun(spark, sf_dir) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("doc_id") % len(_LEADS) + 1).cast("int"))
    return _t(spark, sf_dir, "documents").withColumn("text", F.concat(lead, F.coalesce("text", F.lit(""))))


_TRIAGE_SQL = f"""begun(i, lead) AS (VALUES {", ".join(f"({i}, '{lead}')" for i, lead in enumerate(_LEADS))}),
  folded AS (SELECT doc_id, lang, replace(strip_accents(lower(replace(lead || coalesce(text, ''), 'ß', 'ss'))), '’', '''') AS f FROM documents JOIN begun ON i = doc_id % {len(_LEADS)}),
  titled AS (SELECT *, substr(coalesce(list_filter(string_split(f, chr(10)), lambda x: regexp_matches(x, '\\S'))[1], ''), 1, 120) AS head FROM folded),
  hit AS (SELECT doc_id, lang, list_filter({_sql_list(fixed.STRONG)}, lambda x: contains(f, x)) AS s,
    list_filter({_sql_list(fixed.SUPPORTING)}, lambda x: contains(f, x)) AS u, list_filter({_sql_list(fixed.INVOICE)}, lambda x: contains(f, x)) AS i,
    list_filter({_sql_list(fixed.DISQUALIFYING)}, lambda x: contains(head, x)) AS d FROM titled),
  judged AS (SELECT doc_id, lang, CASE WHEN len(d) > 0 THEN 'unknown' WHEN len(s) = 0 AND len(i) >= 2 THEN 'invoice'
    WHEN len(s) >= 1 AND len(s) + len(u) >= 2 THEN 'contract' ELSE 'unknown' END AS kind,
    CASE WHEN len(d) > 0 THEN 'its title says ' || d[1] WHEN len(s) = 0 AND len(i) >= 2 THEN array_to_string(i[1:3], ', ')
    WHEN len(s) >= 1 AND len(s) + len(u) >= 2 THEN array_to_string((s || u)[1:3], ', ')
    ELSE len(s) || ' markers, ' || len(u) || ' supporting, ' || len(i) || ' invoice terms' END AS evidence FROM hit)"""


@query(f"WITH {_TRIAGE_SQL} SELECT doc_id, kind, evidence FROM judged")
def triage_classify(spark, sf_dir):
    return triage.classify(_begun(spark, sf_dir).select("doc_id", "text")).select("doc_id", "kind", "evidence")


@query(
    f"""WITH {_TRIAGE_SQL} SELECT lang, count(*) FILTER (kind = 'contract') AS contract, count(*) FILTER (kind = 'invoice') AS invoice,
  count(*) FILTER (kind = 'unknown') AS unknown FROM judged JOIN labels USING (doc_id) GROUP BY 1"""
)
def triage_confusion(spark, sf_dir):
    kinds = triage.classify(_begun(spark, sf_dir).select("doc_id", "lang", "text"))
    return evaluate.confusion(kinds.join(_t(spark, sf_dir, "labels"), "doc_id"), ["lang"])


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
  SELECT doc_id, CAST(count(*) AS INTEGER) AS page_count, CAST(count(*) FILTER (length(trim(t, ' ')) >= 60) AS INTEGER) AS text_pages,
  CAST(count(*) FILTER (length(trim(t, ' ')) < 60) AS INTEGER) AS image_pages,
  CAST(sum(CASE WHEN length(trim(t, ' ')) >= 60 THEN floor(length(t) / 3.7::DOUBLE) ELSE 0 END) AS BIGINT) AS estimated_tokens FROM p GROUP BY 1"""
)
def text_pages(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", pages.split_pages(F.replace("text", F.lit("\n"), F.lit("\f"))).alias("pages"))
    return pages.measured(docs).drop("pages")


@query(
    r"""SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}')) AS INTEGER) AS n FROM documents) WHERE n > 0"""
)
def mask_email_counts(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", F.col("text"), personal.mask("text").alias("m"))
    return found.select("doc_id", F.try_element_at("m.counts", F.lit("email")).alias("n")).filter("n > 0")


def _luhn_sql(x: str) -> str:
    digit = f"CAST(substr({x}, 17 - k, 1) AS INTEGER)"
    return f"list_sum(list_transform(range(1, 17), lambda k: CASE WHEN k % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"


@query(
    f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{16}}')) AS x FROM documents)
  SELECT doc_id, count(*) AS runs, count(*) FILTER ({_luhn_sql("x")}) AS valid FROM r GROUP BY 1"""
)
def luhn_candidates(spark, sf_dir):
    runs = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{16})"), 1)).alias("x"))
    return runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(personal.card(F.col("x")), 1)).alias("valid"))


_CARD_SQL = "CASE doc_id % 3 WHEN 0 THEN 'Visa no. ' WHEN 1 THEN 'order ' ELSE 'Karte: ' END || '4000 ' || lpad(CAST(doc_id AS VARCHAR), 4, '0') || '-1234 5678 ' || coalesce(text, '')"


@query(
    f"""WITH d AS (SELECT doc_id, {_CARD_SQL} AS t FROM documents)
  SELECT doc_id, CAST(len(regexp_extract_all(t, '(?i)(?:{fixed.CARD_LABELS}){fixed.LABEL_THEN}({fixed.CARD_SHAPE})', 1)) AS INTEGER) AS labelled,
  CAST(len(regexp_extract_all(t, '{fixed.CARD_SHAPE}')) AS INTEGER) AS runs FROM d"""
)
def label_gate(spark, sf_dir):
    """Documents that begin with a card number, two of three beside a label: only those count as labelled."""
    lead = F.when(F.col("doc_id") % 3 == 0, "Visa no. ").when(F.col("doc_id") % 3 == 1, "order ").otherwise("Karte: ")
    number = F.concat(F.lit("4000 "), F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit("-1234 5678 "))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(lead, number, F.coalesce("text", F.lit(""))).alias("t"))
    runs = F.regexp_extract_all("t", F.lit(f"({fixed.CARD_SHAPE})"), 1)
    return docs.select("doc_id", F.size(personal.labelled_cards(F.col("t"))).alias("labelled"), F.size(runs).alias("runs"))


@query(
    """WITH i AS (SELECT o_orderkey, 'DE' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey * 7919 + o_custkey AS VARCHAR), 18, '0') AS iban FROM orders)
  SELECT o_orderkey, CAST(substr(iban, 5) || '1314' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM i"""
)
def iban_mod97(spark, sf_dir):
    number = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 18, "0"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", personal.iban(number).alias("valid"))


@query(
    """SELECT o_orderkey, lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(o_custkey % 23 + 1 AS BIGINT), 1) AS value,
  o_orderkey % 100000000 % 23 = o_custkey % 23 AS valid FROM orders"""
)
def dni_letters(spark, sf_dir):
    value = F.concat(F.lpad((F.col("o_orderkey") % 100000000).cast("string"), 8, "0"), F.substring(F.lit(fixed.DNI_LETTERS), (F.col("o_custkey") % 23 + 1).cast("int"), F.lit(1)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), personal.dni(value).alias("valid"))


def _order_docs(spark, sf_dir) -> DataFrame:
    """orders as documents with their fields, and what else routing needs, judged by the checks."""
    o = spread(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "o_orderkey")
    law = F.when(F.col("o_orderstatus") == "O", "German law").when(F.col("o_orderstatus") == "F", "New South Wales, Australia")
    none = lambda kind: F.lit(None).cast(kind)

    def field(name: str, v_text: Column | None = None, v_num: Column | None = None, v_bool: Column | None = None, currency: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            (none("string") if v_text is None else v_text).alias("v_text"),
            (none("double") if v_num is None else v_num.cast("double")).alias("v_num"),
            (none("boolean") if v_bool is None else v_bool).alias("v_bool"),
            (none("string") if currency is None else currency).alias("currency"),
        )

    fields = F.array(
        field("counterparty_name", v_text=F.lit("Somebody")),
        field("payment_terms_days", v_num=F.col("o_orderkey") % 120),
        field("term_months", v_num=F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey") % 48)),
        field("liability_cap", v_num=F.when(F.col("o_custkey") % 6 != 0, F.col("o_totalprice")), currency=F.when(F.col("o_orderpriority").startswith("1"), "EUR").otherwise("XXX")),
        field("governing_law", v_text=law),
        field("auto_renewal", v_bool=F.col("o_orderkey") % 2 == 0),
        field("effective_date", v_text=F.date_format("o_orderdate", "yyyy-MM-dd")),
        field("termination_notice_days", v_num=F.col("o_custkey") % 100),
    )
    docs = o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.lit("goods").alias("category"),
        fields.alias("fields"),
        F.when(F.col("o_orderkey") % 11 == 0, "other").otherwise("contract").alias("document_kind"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("counterparty_id"),
        F.lit(0.5).alias("counterparty_score"),
        F.when(F.col("o_custkey") % 3 == 0, "suspended").otherwise("approved").alias("counterparty_status"),
    )
    return checks.judged(docs, checks.load_checks(spark))


_FINDINGS_SQL = """found AS (
  SELECT o_orderkey AS doc_id, 'payment_terms_days' AS field, '§1.1' AS citation, 'medium' AS severity FROM orders WHERE NOT o_orderkey % 120 BETWEEN 45 AND 90
  UNION ALL SELECT o_orderkey, 'term_months', '§2.1', 'medium' FROM orders WHERE o_orderkey % 10 = 0 OR NOT o_custkey % 48 BETWEEN 12 AND 36
  UNION ALL SELECT o_orderkey, 'auto_renewal', '§2.2', 'medium' FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'termination_notice_days', '§2.3', 'medium' FROM orders WHERE o_custkey % 100 > 90
  UNION ALL SELECT o_orderkey, 'liability_cap', '§3.1', 'high' FROM orders WHERE o_custkey % 6 <> 0 AND o_totalprice < 250000
  UNION ALL SELECT o_orderkey, 'liability_cap', '§3.2', 'high' FROM orders WHERE o_custkey % 6 = 0
  UNION ALL SELECT o_orderkey, 'governing_law', '§4.1', 'high' FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT o_orderkey, 'liability_cap', '§1.2', 'high' FROM orders WHERE o_custkey % 6 <> 0 AND NOT starts_with(o_orderpriority, '1'))"""


@query(f"WITH {_FINDINGS_SQL} SELECT * FROM found")
def threshold_findings(spark, sf_dir):
    """A row per check that an order fails: fields stay with their order, only findings are exploded."""
    return checks.each_finding(_order_docs(spark, sf_dir), "doc_id").select("doc_id", "f.field", "f.citation", "f.severity")


@query(f"WITH {_FINDINGS_SQL} SELECT citation AS section, count(*) AS n FROM found GROUP BY 1")
def cited_sections(spark, sf_dir):
    """The sections that findings on orders cite, and how often."""
    return checks.cited(checks.each_finding(_order_docs(spark, sf_dir)).select("f.citation"))


@query(
    f"""WITH {_FINDINGS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1),
  r AS (SELECT o_orderkey AS doc_id, coalesce(n, 0)
    + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END
    + CASE WHEN o_custkey % 5 <> 0 AND o_custkey % 3 = 0 THEN 1 ELSE 0 END
    + CASE WHEN o_orderkey % 10 = 0 OR o_orderstatus NOT IN ('O', 'F') THEN 1 ELSE 0 END
    + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END
    + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS n_reasons, o_orderkey % 11 = 0 AS other FROM orders LEFT JOIN n ON doc_id = o_orderkey)
  SELECT doc_id, CAST(n_reasons AS INTEGER) AS n_reasons, CASE WHEN n_reasons = 0 THEN 'auto_approved' WHEN other THEN 'rejected' ELSE 'needs_review' END AS route FROM r"""
)
def route_decisions(spark, sf_dir):
    """Orders by the rules, from fields and findings in their own row."""
    confidence = F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(0.9)

    def weighed(f: Column) -> Column:
        stated = f["v_text"].isNotNull() | f["v_num"].isNotNull() | f["v_bool"].isNotNull()
        status = F.when(stated, "verified").otherwise("absent")
        return F.struct(f["name"].alias("name"), stated.alias("has_value"), confidence.alias("confidence"), status.alias("prov_status"))

    evidence = _order_docs(spark, sf_dir).withColumn("fields", F.transform("fields", weighed))
    return rules.decide(evidence).select("doc_id", F.size("reasons").alias("n_reasons"), "route")


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(documents.text), '\s+', ' ', 'g')) AS t, n.text AS quote FROM documents JOIN (SELECT item_id, text FROM benchmark) n
    ON item_id = doc_id % (SELECT count(*) FROM benchmark))
  SELECT doc_id, CASE WHEN contains(t, trim(regexp_replace(lower(quote), '\s+', ' ', 'g'))) THEN 'verified' ELSE 'not_found' END AS prov_status FROM d"""
)
def quote_verification(spark, sf_dir):
    """Each document against one benchmark passage, as the quote of a field that needs no support."""
    docs, items = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    fields = docs.select("doc_id").join(n, how="cross").withColumn("item_id", F.col("doc_id") % F.col("n")).join(items, "item_id")
    fields = fields.select(
        "doc_id", F.lit("signatories").alias("name"), F.lit("somebody").alias("v_text"), none.cast("double").alias("v_num"), none.cast("boolean").alias("v_bool"),
        none.cast("string").alias("currency"), F.lit(0.9).alias("confidence"), F.col("text").alias("source_quote"), F.lit(1).alias("page"), none.cast("string").alias("prov_status"),
    )
    paged = docs.select("doc_id", pages.split_pages(F.col("text"), least=0).alias("pages"))
    return verify.verified(fields, paged).select("doc_id", "prov_status")


@query(
    r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:[., ][0-9]{3})+(?:[.,][0-9]{2})?|[0-9]+(?:[.,][0-9]{2})?')) AS run FROM documents),
  x AS (SELECT doc_id, run, regexp_replace(run, '[^0-9]', '', 'g') AS own FROM r),
  e AS (SELECT doc_id, own AS v FROM x UNION SELECT doc_id, substr(own, 1, length(own) - 2) FROM x WHERE length(run) > 3 AND run[-3] IN ('.', ',') AND length(own) > 2)
  SELECT doc_id, count(DISTINCT v) AS n, max(v) AS most FROM e GROUP BY 1"""
)
def numbers_in_text(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", text.numbers_in(F.col("text")).alias("found")).filter(F.size("found") > 0)
    return found.select("doc_id", F.size("found").cast("long").alias("n"), F.array_max("found").alias("most"))


_TERMS = (
    "The buyer pays within 45 days of the invoice, and", "The cap is EUR 250.000 or 12 months of fees, and", "Seit dem Jahr 1999 gelten 005 Tage Frist und",
    "Notice is 3 months, from 2024 years on or 0 days, and", "Nothing else is stated at all here, but",
)
_TERMS_SQL = "[" + ", ".join(f"'{t} '" for t in _TERMS) + f"][doc_id % {len(_TERMS)} + 1] || CAST(doc_id + 20 AS VARCHAR) || ' days in all.' || chr(10)"


@query(
    rf"""WITH d AS (SELECT doc_id, {_TERMS_SQL} || coalesce(text, '') AS text FROM documents),
  s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.\n]{{20,400}}[.\n]')) AS c FROM d),
  m AS (SELECT doc_id, unnest(regexp_extract_all(trim(regexp_replace(c, '\s+', ' ', 'g')),
    '(?i)(?:EUR|USD|GBP|CHF|BGN|RON|PLN)\s*(?:[0-9]{{1,3}}(?:[., ][0-9]{{3}})+|[0-9]{{1,7}})|(?:[0-9]{{1,3}}(?:[., ][0-9]{{3}})+|[0-9]{{1,7}})\s*(?:days?|months?|years?|weeks?|tage?n?|monate?n?|jahre?n?|d[íi]as?|mes(?:es)?|a[ñn]os?|jours?|mois|ans?|ann[ée]es?)(?:[^\p{{L}}\p{{N}}_]|$)')) AS t FROM s),
  n AS (SELECT doc_id, regexp_replace(t, '[^0-9]', '', 'g') AS own FROM m)
  SELECT doc_id, CAST(own AS BIGINT) AS number, count(*) AS n FROM n
  WHERE NOT regexp_full_match(own, '[1-9]|1[0-2]|19[0-9][0-9]|20[0-9][0-9]|2100') GROUP BY 1, 2"""
)
def clause_harvest(spark, sf_dir):
    """Documents that begin with a sentence that states terms."""
    said = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("doc_id") % len(_TERMS) + 1).cast("int"))
    docs = _t(spark, sf_dir, "documents").withColumn("text", F.concat(said, F.lit(" "), (F.col("doc_id") + 20).cast("string"), F.lit(" days in all.\n"), F.coalesce("text", F.lit(""))))
    return evaluate.stated_numbers(docs).groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT label, i, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2),
  v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  d AS (SELECT vec_id, label, sum((x - m) * (x - m)) AS d FROM v JOIN c USING (i) GROUP BY 1, 2),
  r AS (SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS section, round(1 / (1 + d), 6) AS score,
    CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), CAST(label AS VARCHAR)) AS INTEGER) AS rank FROM d)
  SELECT * FROM r WHERE rank <= 3"""
)
def vector_topk(spark, sf_dir):
    """Every vector against the means of the labels, as a playbook of few clauses."""
    vectors = _t(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    clauses = means.groupBy(F.col("label").cast("string").alias("section")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("e"))
    clauses = clauses.select("section", F.transform("e", lambda x: x["m"]).alias("embedding"))
    found = retrieval.search(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), clauses)
    return found.withColumn("score", F.round("score", 6))


@query(
    """WITH t AS (SELECT conv_id, role, text, min(turn) AS first FROM conversations GROUP BY 1, 2, 3)
  SELECT conv_id AS doc_id, role AS field, upper(role[1]) || lower(substr(role, 2)) AS label, string_agg(text, '|' ORDER BY first) AS lines FROM t GROUP BY 1, 2, 3"""
)
def concern_groups(spark, sf_dir):
    reason = F.struct(F.col("turn"), F.col("role").alias("rule"), F.col("text").alias("message"), F.col("role").alias("citation"), F.array("role").alias("fields"))
    convs = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(reason)).alias("reasons"))
    return review.concerns(convs).select("doc_id", "field", "label", F.array_join("lines", "|").alias("lines"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def flatten_payload(spark, sf_dir):
    payload = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("_hidden"), F.lit("x")))
    flat = _t(spark, sf_dir, "events").select("event_id", deliver.flattened(payload).alias("p"))
    return flat.select("event_id", F.when(F.size("p") == 1, F.try_element_at("p", F.lit("k"))).alias("k"))


@query("SELECT o_orderkey AS doc_id, 'status' AS name, 'X' AS corrected FROM orders WHERE o_orderstatus <> 'X' AND o_orderkey % 2 = 0")
def corrections_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    new = F.when(F.col("o_orderkey") % 2 == 0, " X ").otherwise(F.concat(F.lit(" "), "o_orderstatus"))
    forms = o.select(F.col("o_orderkey").alias("doc_id"), F.create_map(F.lit("field:status"), new, F.lit("field:nothing"), F.lit("y"), F.lit("action"), F.lit("approve")).alias("form"))
    fields = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("status").alias("name"), F.col("o_orderstatus").alias("v_text"))
    return review.corrections(forms, fields)


@query(
    """SELECT s_nationkey, count(*) FILTER (s_acctbal >= 0) AS approved, count(*) FILTER (s_acctbal < 0) AS suspended FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"""
)
def vendor_status_counts(spark, sf_dir):
    vendors = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return vendors.groupBy("s_nationkey").agg(*ledger.counted(("approved", F.col("s_acctbal") >= 0), ("suspended", F.col("s_acctbal") < 0)))


@query(
    """SELECT lang, count(*) AS n, round(avg(CASE WHEN (quality = 1) = (n_chars > 2000) THEN 1 ELSE 0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1"""
)
def accuracy_by_lang(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").withColumn("correct", (F.col("quality") == 1) == (F.col("n_chars") > 2000))
    return evaluate.accuracy(rows, ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    """WITH s AS (SELECT doc_id, list_filter(['long', 'toxic', 'quality'], lambda x: (x = 'long' AND n_chars > 2000) OR (x = 'toxic' AND toxic = 1) OR (x = 'quality' AND quality = 1)) AS expected,
    list_filter(['long', 'toxic', 'quality'], lambda x: (x = 'long' AND n_chars > 3000) OR (x = 'toxic' AND toxic = 1) OR (x = 'quality' AND quality = 0)) AS found FROM documents JOIN labels USING (doc_id))
  SELECT doc_id, CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(expected, found)) / len(expected), 6) END AS recall,
  CAST(len(expected) - len(list_intersect(expected, found)) AS INTEGER) AS missed FROM s"""
)
def recall_sets(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    named = lambda *pairs: F.filter(F.array(*[F.when(c, n) for n, c in pairs]), lambda x: x.isNotNull())
    sets = rows.select(
        "doc_id",
        named(("long", F.col("n_chars") > 2000), ("toxic", F.col("toxic") == 1), ("quality", F.col("quality") == 1)).alias("expected"),
        named(("long", F.col("n_chars") > 3000), ("toxic", F.col("toxic") == 1), ("quality", F.col("quality") == 0)).alias("found"),
    )
    return evaluate.recall(sets).select("doc_id", F.round("recall", 6).alias("recall"), F.size("missed").alias("missed"))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'germany' WHEN 1 THEN 'england & wales' WHEN 2 THEN 'bulgaria' WHEN 3 THEN 'spain' ELSE lower(n_name) END AS law FROM nation"""
)
def jurisdictions(spark, sf_dir):
    kinds = ("deutschem Recht", "The Laws of England and Wales.", "the Republic of Bulgaria", "la legislación española")
    stated = F.coalesce(F.get(F.array(*map(F.lit, kinds)), (F.col("n_nationkey") % 5).cast("int")), F.concat(F.lit(" "), "n_name", F.lit(", ")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", text.jurisdiction(stated).alias("law"))


@query("SELECT event_id, ts + to_seconds(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 <= 1 THEN 30 WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 2 THEN 120 ELSE 300 END) AS again FROM events")
def retry_times(spark, sf_dir):
    attempts = (F.get_json_object("props", "$.k").cast("long") % 5).cast("int")
    return _t(spark, sf_dir, "events").select("event_id", amounts.retry_at(F.col("ts"), attempts).alias("again"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_intake(spark, sf_dir):
    """events as a stream, appended once each to a table, although every file comes twice."""
    from pyspark.errors import AnalysisException

    folder = new_folder(spark, "stream")
    batch_rows = _t(spark, sf_dir, "events")
    stream = lambda: spark.readStream.schema(batch_rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    for run in ("a", "b"):
        running = start_intake(stream(), f"{folder}/events", f"{folder}/checkpoint-{run}", "event_id", "ts", trigger={"availableNow": True})
        running.awaitTermination()
        if running.exception():
            raise AnalysisException(str(running.exception()))
    return spark.read.parquet(f"{folder}/events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT event_id % 300 AS id, event_id AS n, event_type = 'error' AS failed FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY id, g, failed ORDER BY n) AS run FROM (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY id ORDER BY n) AS g FROM e)),
  d AS (SELECT id, min(n) FILTER (failed AND run = 3) AS died, max(n) AS last, arg_max(CASE WHEN failed THEN run ELSE 0 END, n) AS run FROM r GROUP BY 1)
  SELECT id, coalesce(died, last) AS n, CASE WHEN died IS NOT NULL THEN 'dead' WHEN run > 0 THEN 'waiting' ELSE 'advanced' END AS status, CAST(CASE WHEN died IS NOT NULL THEN 3 ELSE run END AS INTEGER) AS attempts FROM d"""
)
def stream_retries(spark, sf_dir):
    """Outcomes as a stream, errors as failures: where the state of each key ends."""
    folder, batch_rows = new_folder(spark, "retries"), _t(spark, sf_dir, "events")
    events = spark.readStream.schema(batch_rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    tag = F.when(F.col("event_type") == "error", "failed").otherwise("advanced")
    outcomes = events.select((F.col("event_id") % 300).alias("id"), F.col("event_id").alias("n"), tag.alias("tag"), F.lit(True).alias("retryable"))
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    running = followed(outcomes, timers=False).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return intake.latest_of_each(spark.read.parquet(f"{folder}/out").drop("batch"), ["id"], "n").select("id", "n", "status", "attempts")


@query(
    f"""WITH first AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
  {_TRIAGE_SQL.replace("FROM documents JOIN begun ON i = doc_id %", "FROM documents JOIN first USING (doc_id) JOIN begun ON i = 0 * doc_id %")}
  SELECT kind, count(*) AS documents FROM judged GROUP BY 1"""
)
def flagship_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of flagship that SQL can express: how many documents of each kind."""
    return flagship(spark, sf_dir).select("kind", "documents")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: first of each content, classified, masked, and counted by kind and what was masked. Texts that are null are one content.

    Which document of a content is the first is found on digests; texts move to be dealt evenly, as few row groups make few tasks."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "text")
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("sha256", "first_sha256")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("sha256").eqNullSafe(F.col("first_sha256"))
    texts = spread(docs.join(first, same, "left_semi"), "doc_id")
    kinds = triage.classify(texts).withColumn("m", personal.mask("text"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("m.counts")).alias("masked_categories"))


QUERIES["flagship"] = flagship


from docgate import queries_documents, queries_messages, queries_reports  # noqa: E402, F401  (they register)
