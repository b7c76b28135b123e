"""Queries of joins, reports and delivery: items, ledgers, decisions and reviewers' actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgate.operators import deliver, evaluate, intake, ledger, resolve, review, traces, verify
from docgate.plans import batch
from docgate.plans.tables import new_folder
from docgate.registered import query
from docgate.registered import table as _t


def _chain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables behind a review item: each attachment (a customer) has documents, extractions and so on, as many as it has orders."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), "o_orderpriority")
    reasons = lambda rule, text: F.struct(F.lit(rule).alias("rule"), text.alias("message"), F.lit("").alias("citation"), F.array().cast("array<string>").alias("fields"))
    said = F.array(reasons("low_severity_finding", F.col("o_orderpriority")), reasons("high_severity_finding", F.col("o_orderpriority")))
    return {
        "emails": _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("sender")),
        "attachments": _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("email_id"), F.col("c_name").alias("filename")),
        "documents": o.select("id", F.col("c").alias("attachment_id")),
        "extractions": o.select((F.col("id") * 2).alias("id"), F.col("id").alias("document_id")),
        "enrichments": o.select((F.col("id") * 3).alias("id"), (F.col("id") * 2).alias("extraction_id")),
        "decisions": o.select((F.col("id") * 5).alias("id"), (F.col("id") * 3).alias("enrichment_id"), said.alias("reasons")),
    }


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") * 7).alias("id"), (F.col("o_orderkey") * 5).alias("decision_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("approved").alias("state"))


@query(
    """SELECT o_orderkey * 7 AS id, c_name AS filename, n_name AS sender, 'high_severity_finding' AS top FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE o_orderstatus = 'O' ORDER BY id DESC LIMIT 100"""
)
def review_queue(spark, sf_dir):
    """The newest open items with what leads to each and their weightiest reason: the limit is the page shown."""
    out = review.queue(_items(spark, sf_dir), _chain(spark, sf_dir))
    return out.select("id", "filename", "sender", F.col("top_reason.rule").alias("top"))


@query(
    """WITH spent AS (SELECT user_id, sum(value) AS usd FROM events GROUP BY 1)
  SELECT o_orderkey * 7 AS id, c_name AS filename, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'approved' END AS state, round(coalesce(usd, 0), 4) AS usd, 'high_severity_finding,low_severity_finding' AS rules
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN spent ON user_id = c_custkey"""
)
def item_details(spark, sf_dir):
    """Every item with what leads to it, its reasons by weight, and what its attachment cost."""
    calls = _t(spark, sf_dir, "events").select(F.col("user_id").alias("attachment_id"), F.col("value").alias("usd"))
    out = review.detail(_items(spark, sf_dir), _chain(spark, sf_dir), calls)
    return out.select("id", "filename", "state", F.round("usd", 4).alias("usd"), F.array_join(F.transform("reasons", lambda r: r["rule"]), ",").alias("rules"))


@query(
    """SELECT o_custkey AS attachment_id, max(o_orderkey) * 2 AS extraction, max(o_orderkey) * 3 AS enrichment, max(o_orderkey) * 5 AS decision FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"""
)
def latest_of_attachments(spark, sf_dir):
    """The newest extraction, enrichment and decision of each attachment, over one, two and three joins."""
    tables, steps = _chain(spark, sf_dir), (("enrichments", "enrichment_id"), ("extractions", "extraction_id"), ("documents", "document_id"))
    newest = lambda start, chain, name: review.latest(tables, chain, start).select("attachment_id", F.col("id").alias(name))
    out = newest("extractions", steps[2:], "extraction").join(newest("enrichments", steps[1:], "enrichment"), "attachment_id")
    return out.join(newest("decisions", steps, "decision"), "attachment_id")


@query(
    """SELECT count(*) FILTER (o_orderstatus = 'O') AS open, (SELECT count(*) FROM supplier) AS filed, round((SELECT sum(value) FROM events), 2) AS usd,
  (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 = 0) AS unverifiable, round((SELECT sum(value) FROM events) / (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'), 4) AS usd_each FROM orders"""
)
def dashboard(spark, sf_dir):
    """One row over five tables."""
    calls = _t(spark, sf_dir, "events").select(F.col("value").alias("usd"))
    attachments = _t(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "delivered").otherwise("received").alias("status"))
    fields = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, "unverifiable").otherwise("verified").alias("prov_status"))
    out = review.dashboard(_items(spark, sf_dir), _t(spark, sf_dir, "supplier"), calls, attachments, fields)
    return out.withColumns({"usd": F.round("usd", 2), "usd_each": F.round("usd_each", 4)})


@query("SELECT event_id AS id, c_name AS filename, 'extract' AS stage, CAST(value AS VARCHAR) AS message, user_id AS attachment_id FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error'")
def dead_letter_join(spark, sf_dir):
    """Letters of documents that died, beside their attachments."""
    letters = _t(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("attachment_id"), F.lit("extract").alias("stage"), F.col("value").cast("string").alias("message"))
    attachments = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))
    return batch.letters_beside(letters, attachments).select("id", "filename", "stage", "message", "attachment_id")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as decisions, each twice."""
    k = F.col("o_orderkey")
    route = F.when(k % 3 == 0, "auto_approved").when(k % 3 == 1, "needs_review").otherwise("rejected")
    payload = F.create_map(F.lit("term"), k.cast("string"), F.lit("_hidden"), F.lit("x"))
    one = _t(spark, sf_dir, "orders").select(k.alias("decision_id"), F.col("o_custkey").cast("string").alias("counterparty_id"), route.alias("route"), payload.alias("payload"))
    return one.unionByName(one)


@query(
    """SELECT 'contract' AS made, o_orderkey AS decision_id, CAST(o_orderkey AS VARCHAR) AS term FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0
  UNION ALL SELECT 'item', o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0"""
)
def delivered_once(spark, sf_dir):
    """What decisions that stand twice, half of them delivered before, add to contracts and to review items."""
    decisions = _decisions(spark, sf_dir)
    before = _t(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("decision_id"))
    filed = deliver.contracts_to_file(decisions, before).select(F.lit("contract").alias("made"), "decision_id", F.array_join(F.map_values("payload"), ",").alias("term"))
    return filed.unionByName(deliver.items_to_open(decisions, before).select(F.lit("item").alias("made"), "decision_id", F.lit(None).cast("string").alias("term")))


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = _t(spark, sf_dir, "orders").filter(k % 3 == 1).select(k.alias("decision_id"), F.when(k % 2 == 0, "open").otherwise("rejected").alias("state"), F.lit(None).cast("map<string,string>").alias("human_corrections"), F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("timestamp").alias("resolved_at"))
    act = lambda action, day, fixed: F.struct(F.lit(action).alias("action"), fixed.alias("corrections"), F.lit(f"p{day}").alias("resolved_by"), F.to_timestamp(F.lit(f"2024-01-0{day}")).alias("resolved_at"))
    nothing = F.lit(None).cast("map<string,string>")
    approve = act("approve", 2, F.create_map(F.lit("term"), F.lit("9")))
    acts = F.when(k % 5 == 0, F.array(act("reject", 1, nothing), approve)).when(k % 5 == 1, F.array(act("reject", 3, nothing), approve)).otherwise(F.array().cast("array<struct<action:string,corrections:map<string,string>,resolved_by:string,resolved_at:timestamp>>"))
    actions = _t(spark, sf_dir, "orders").select(k.alias("decision_id"), F.explode(acts).alias("a")).select("decision_id", "a.*")
    return deliver.resolved(items, actions)


@query(
    """WITH actions AS (
    SELECT o_orderkey AS decision_id, 'approve' AS action, 'p2' AS who, 2 AS day FROM orders WHERE o_orderkey % 5 IN (0, 1)
    UNION ALL SELECT o_orderkey, 'reject', CASE WHEN o_orderkey % 5 = 0 THEN 'p1' ELSE 'p3' END, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 3 END FROM orders WHERE o_orderkey % 5 IN (0, 1)),
  first AS (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY day) = 1)
  SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 2 = 1 THEN 'rejected' WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE 'open' END AS state,
  CASE WHEN o_orderkey % 2 = 0 THEN coalesce(who, '-') ELSE '-' END AS resolved_by FROM orders LEFT JOIN first ON decision_id = o_orderkey WHERE o_orderkey % 3 = 1"""
)
def resolved_items(spark, sf_dir):
    """Items after reviewers' actions: the first one closes an open item."""
    return _acted(spark, sf_dir).select("decision_id", "state", F.coalesce("resolved_by", F.lit("-")).alias("resolved_by"))


@query("SELECT o_orderkey AS decision_id, '9' AS term, true AS approved_by_human, CAST(1 AS INTEGER) AS keys FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AND o_orderkey % 5 = 1")
def promoted_contracts(spark, sf_dir):
    """Contracts of items that a person approved: corrected, marked, with the mark as a column of its own."""
    decisions = _decisions(spark, sf_dir).dropDuplicates(["decision_id"])
    made = deliver.promoted(_acted(spark, sf_dir), decisions, spark.createDataFrame([], "decision_id long"))
    view = deliver.contract_view(made)
    return view.select("decision_id", F.try_element_at("payload", F.lit("term")).alias("term"), "approved_by_human", F.size("payload").alias("keys"))


@query("SELECT user_id, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(sum(k % 7) AS BIGINT) AS cache_read_tokens FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def usage_by_user(spark, sf_dir):
    """Tokens added up, those that aren't stated as none."""
    k, none = F.get_json_object("props", "$.k").cast("long"), F.lit(None).cast("long")
    calls = _t(spark, sf_dir, "events").select("user_id", k.alias("input_tokens"), none.alias("output_tokens"), (k % 7).alias("cache_read_tokens"), none.alias("cache_write_tokens"))
    from docgate.functions.amounts import none_as_zero

    calls = calls.select("user_id", "input_tokens", "cache_read_tokens", *none_as_zero("output_tokens", "cache_write_tokens"))
    return ledger.usage(calls, ["user_id"]).drop("cache_write_tokens")


@query("SELECT event_type AS effort, count(*) FILTER (user_id % 2 = 0) AS correct, count(*) AS total, round(sum(value), 4) AS usd, CAST(sum(user_id) AS BIGINT) AS seconds FROM events GROUP BY 1")
def effort_sweep(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("effort"), (F.col("user_id") % 2 == 0).alias("correct"), F.col("value").alias("usd"), F.col("user_id").alias("seconds"))
    return evaluate.sweep(rows).withColumn("usd", F.round("usd", 4))


@query("SELECT event_id AS id, event_type AS purpose, value AS usd FROM events ORDER BY event_id DESC LIMIT 1")
def newest_call(spark, sf_dir):
    """A ledger written in two parts, a folder for each purpose, and its last row."""
    calls = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("purpose"), F.col("value").alias("usd"))
    folder = new_folder(spark, "ledger")
    for part in (0, 1):
        ledger.append(calls.filter(F.col("id") % 2 == part), folder)
    return ledger.newest(spark.read.parquet(folder)).select("id", "purpose", "usd")


@query(
    """SELECT o_orderkey AS doc_id, name, CASE name WHEN 'a' THEN o_orderkey % 3 <> 0 WHEN 'b' THEN o_orderkey % 2 = 0 WHEN 'c' THEN o_orderkey % 5 <> 0 ELSE o_orderkey % 2 = 1 END AS correct
  FROM orders, (VALUES ('a'), ('b'), ('c'), ('d')) t(name)"""
)
def judged_fields(spark, sf_dir):
    """Expected fields beside extracted ones: texts, numbers within a hundredth, booleans, and what should not be there."""
    k, none = F.col("o_orderkey"), F.lit(None)
    row = lambda name, text=None, num=None, flag=None: F.struct(F.lit(name).alias("name"), (none.cast("string") if text is None else text).alias("v_text"), (none.cast("double") if num is None else num).alias("v_num"), (none.cast("boolean") if flag is None else flag).alias("v_bool"))
    o = _t(spark, sf_dir, "orders")
    long = lambda *rows: o.select(k.alias("doc_id"), F.explode(F.array(*rows)).alias("f")).select("doc_id", "f.*")
    expected = long(row("a", F.lit("Foo")), row("b", num=F.lit(1.0)), row("c", flag=F.lit(True)), row("d"))
    found = long(row("a", F.when(k % 3 != 0, "the FOO Ltd")), row("b", num=F.when(k % 2 == 0, 1.005).otherwise(1.5)), row("c", flag=k % 5 != 0), row("d", F.when(k % 2 == 0, "x")))
    return evaluate.judged_fields(expected, found).select("doc_id", "name", "correct")


@query(
    """WITH e AS (SELECT user_id, event_type, CASE WHEN value >= 5 THEN value END AS value, json_extract_string(props, '$.k') AS k FROM events)
  SELECT 'null' AS kind, 'value' AS name, count(*) FILTER (value IS NULL) AS n FROM e HAVING count(*) FILTER (value IS NULL) > 0
  UNION ALL SELECT 'repeated', 'user_id', count(*) FROM (SELECT 1 FROM e GROUP BY user_id HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'repeated', 'user_id, event_type, k', count(*) FROM (SELECT 1 FROM e GROUP BY user_id, event_type, k HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'changed', 'k', count(*) FROM e UNION ALL SELECT 'missing', 'latency', count(*) FROM e"""
)
def schema_differences(spark, sf_dir):
    """Events against what is wanted of them: columns by their types, and rows by values that must be there or be there once."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("value") >= 5, F.col("value")).alias("value"), F.get_json_object("props", "$.k").alias("k"))
    wanted = spark.createDataFrame([], "user_id long, event_type string, value double, k long, latency double").schema
    named = [(kind, name) for kind, names in evaluate.schema_difference(rows, wanted).items() for name in names]
    columns = rows.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in named])).alias("d"), "n")
    broken = evaluate.data_differences(rows, ["user_id", "value"], [["user_id"], ["user_id", "event_type", "k"]])
    return broken.unionByName(columns.select("d.kind", "d.name", "n"))


@query("SELECT count(*) AS transitions, count(*) FILTER (o_orderkey % 4 = 0) AS ended FROM orders WHERE o_orderkey % 2 = 0")
def drain_totals(spark, sf_dir):
    """Of two states of a queue, how many rows moved and how many of them ended."""
    k = F.col("o_orderkey")
    before = _t(spark, sf_dir, "orders").select(k.alias("id"), F.lit("received").alias("status"))
    after = _t(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, "dead").when(k % 2 == 0, "triaged").otherwise("received").alias("status"))
    return batch.drained(before, after)


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'loaded' WHEN 1 THEN 'dead' ELSE 'delivered' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS attempts FROM orders")
def revived_letters(spark, sf_dir):
    """Dead rows with a letter go back to the state before the stage that they died in; others stay."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 2, "delivered").otherwise("dead").alias("status"), F.lit(2).alias("attempts"), F.lit(None).cast("timestamp").alias("retry_after"))
    letters = rows.filter(F.col("id") % 3 != 1).select("id", F.lit("extract").alias("stage"), "attempts")
    return batch.revived(rows, letters, {"extract": "loaded"}).select("id", "status", "attempts")


@query(
    """SELECT o_orderkey AS doc_id, name, CASE WHEN name = 'term' THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS quote, CASE WHEN name = 'term' THEN 'verified' ELSE 'unknown' END AS provenance,
  CASE WHEN name = 'term' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS confidence, CASE WHEN name = 'term' THEN '12' ELSE 'true' END AS value FROM orders, (VALUES ('term'), ('renewal')) t(name)"""
)
def field_views(spark, sf_dir):
    """Fields as a reviewer sees them, with the provenance that stands in a table of its own: what is null has a default."""
    k, none = F.col("o_orderkey"), F.lit(None)
    term = F.struct(F.lit("term").alias("name"), none.cast("string").alias("v_text"), F.lit(12.0).alias("v_num"), none.cast("boolean").alias("v_bool"), F.lit(0.5).alias("confidence"), F.col("o_custkey").cast("string").alias("source_quote"))
    renewal = F.struct(F.lit("renewal").alias("name"), none.cast("string").alias("v_text"), none.cast("double").alias("v_num"), F.lit(True).alias("v_bool"), none.cast("double").alias("confidence"), none.cast("string").alias("source_quote"))
    o = _t(spark, sf_dir, "orders")
    fields = o.select(k.alias("doc_id"), F.explode(F.array(term, renewal)).alias("f")).select("doc_id", "f.*").withColumns({"currency": none.cast("string"), "page": none.cast("int")})
    provenance = o.select(k.alias("doc_id"), F.lit("term").alias("name"), F.lit("verified").alias("prov_status"))
    return review.field_view(verify.with_provenance(fields, provenance)).select("doc_id", "name", "quote", "provenance", "confidence", "value")


@query(
    """SELECT o_orderkey AS id, '[{"rule":"r","message":"m' || o_orderkey || '","citation":"","fields":["a","b"]}]' AS json, 'm' || o_orderkey AS message, CAST(2 AS INTEGER) AS fields FROM orders"""
)
def reasons_as_json(spark, sf_dir):
    """Reasons written as JSON and read back by their schema."""
    from docgate.operators.rules import REASON

    k = F.col("o_orderkey")
    reason = F.struct(F.lit("r").alias("rule"), F.concat(F.lit("m"), k.cast("string")).alias("message"), F.lit("").alias("citation"), F.array(F.lit("a"), F.lit("b")).alias("fields")).cast(REASON)
    rows = _t(spark, sf_dir, "orders").select(k.alias("id"), deliver.as_json(F.array(reason)).alias("json"))
    back = deliver.from_json(F.col("json"), f"array<{REASON}>")
    return rows.select("id", "json", back[0]["message"].alias("message"), F.size(back[0]["fields"]).alias("fields"))


@query("SELECT c_custkey AS id, 'one' || chr(10) || c_name AS text FROM customer")
def message_blocks(spark, sf_dir):
    """The text blocks of a model's message, joined; other blocks are left out."""
    from docgate.functions.text import joined_blocks

    block = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    blocks = F.array(block("text", F.lit("one")), block("tool_use", F.lit("x")), block("text", F.col("c_name")), block("text", F.lit(None).cast("string")))
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), joined_blocks(blocks).alias("text"))


@query("SELECT lang, n, believed FROM (SELECT doc_id % 2 AS lang, count(*) AS n, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS believed FROM documents GROUP BY 1)")
def believed_rate(spark, sf_dir):
    """Terms harvested from documents, half of them with another number than the text has: how many of them are believed."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("lang"), F.format_string("The buyer shall pay within %d days of it.\n", F.col("doc_id") + 3000).alias("text"))
    terms = evaluate.stated_numbers(docs).withColumn("number", F.col("number") + F.col("doc_id") % 2)
    return evaluate.believed(terms.join(docs.select("doc_id", "lang"), "doc_id"), ["lang"])


@query("SELECT n_nationkey AS query_id, 'c' || n_nationkey AS vendor, true AS exact FROM nation")
def name_agreement(spark, sf_dir):
    """Names beside registry names that agree with them but for order and legal form; others are ruled out by length or score."""
    n = _t(spark, sf_dir, "nation")
    code = F.translate(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), "0123456789", "abcdefghij")
    own = F.concat(F.repeat(code, 3), F.lit(" of "), F.reverse(code))
    pairs = n.select(F.col("n_nationkey").alias("query_id"), F.format_string("c%d", "n_nationkey").alias("vendor"), F.concat(F.reverse(code), F.lit(" of "), F.repeat(code, 3), F.lit(" GmbH")).alias("name"), F.explode(F.array(own, F.lit("x"), F.lit("zzzzzz yyyyyyyy xxxxx"))).alias("form"))
    return resolve.agreement(pairs, "name", "form", 0.85).select("query_id", "vendor", (F.col("score") == 1).alias("exact"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return evaluate.repeated_keys(_t(spark, sf_dir, "events"), ["user_id"])


@query("SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'image/png' WHEN 'view' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media FROM events")
def media_types(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "png").when(F.col("event_type") == "view", "pdf").otherwise("other")
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), intake.media_type(kind).alias("media"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS ended FROM orders")
def terminal_states(spark, sf_dir):
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(k.alias("id"), batch.is_terminal(F.when(k % 3 == 0, F.element_at(F.array(F.lit("delivered"), F.lit("rejected"), F.lit("dead")), (k % 9 / 3 + 1).cast("int"))).otherwise("loaded")).alias("ended"))


@query(
    """WITH c AS (
    SELECT conv_id AS id, role, coalesce(max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0) = 1 AS looked, conv_id % 3 <> 0 AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') = 'user' AS seen
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT id, true AS ran, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = 1 AS consulted, count(*) AS calls, count(*) FILTER (role = 'assistant') AS findings,
    count(*) FILTER (role = 'assistant' AND NOT looked) AS unfounded, count(*) FILTER (role = 'assistant' AND seen) AS cited FROM c GROUP BY 1"""
)
def agent_traces(spark, sf_dir):
    """Conversations as traces of an agent in JSON, users' turns as searches and answers as findings that cite the section of the turn
    before (or one that no search gave): what was called, and which findings nothing was looked up for."""
    turn, role = F.col("turn"), F.col("role")
    section = lambda n: F.concat(F.lit("§"), n.cast("string"))
    search = traces.recorded(F.lit(traces.SEARCH), F.struct(F.col("text").alias("question")), F.array(F.struct(section(turn).alias("section"), F.lit(0.5).alias("score"))))
    cited = F.when(F.col("conv_id") % 3 == 0, "§x").otherwise(section(turn - 1))
    record = traces.recorded(F.lit(traces.RECORD), F.struct(F.lit("policy_deviation").alias("kind"), cited.alias("citation"), F.col("text").alias("explanation")), F.struct(F.lit(True).alias("recorded")))
    other = traces.recorded(role, F.struct(F.col("text").alias("said")), F.struct(F.lit(None).cast("string").alias("nothing")))
    call = F.when(role == "user", search).when(role == "assistant", record).otherwise(other)
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.struct(turn.alias("turn"), F.to_json(call).alias("call")).alias("c"))
    kept = rows.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list("c")).alias("c"))
    kept = kept.select("id", F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x["call"]), ","), F.lit("]")).alias("trace"))
    cites = traces.found(traces.calls(kept)).groupBy("id").agg(F.count(F.when(F.col("seen"), 1)).alias("cited"))
    return traces.summary(kept).join(cites, "id", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
