"""The review queue and what a reviewer sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions.text import label
from docgate.operators.checks import shown
from docgate.operators.intake import latest_of_each
from docgate.operators.rules import by_weight

#: The chain from a review item back to its message: table, its key, the next table's reference to it.
CHAIN = (("decisions", "decision_id"), ("enrichments", "enrichment_id"), ("extractions", "extraction_id"), ("documents", "document_id"), ("attachments", "attachment_id"), ("emails", "email_id"))


def chained(items: DataFrame, tables: dict[str, DataFrame], chain=CHAIN) -> DataFrame:
    """items joined along a chain of references, each table's id in the reference before it. Inner joins throughout."""
    out = items
    for name, reference in chain:
        out = out.join(tables[name].withColumnRenamed("id", reference), reference)
    return out


def queue(items: DataFrame, tables: dict[str, DataFrame], state: str = "open", limit: int = fixed.QUEUE_ROWS) -> DataFrame:
    """The newest items in a state (or "all"), with what leads to each. The limit is the page that a reviewer sees."""
    kept = items if state == "all" else items.filter(F.col("state") == state)
    return chained(kept, tables).withColumn("top_reason", F.try_element_at(by_weight(F.col("reasons")), F.lit(1))).orderBy(F.desc("id")).limit(limit)


def latest(tables: dict[str, DataFrame], chain: tuple[tuple[str, str], ...], start: str) -> DataFrame:
    """The newest row of `start` for each attachment, reached over a chain of references."""
    return latest_of_each(chained(tables[start], tables, chain), ["attachment_id"], "id")


def concerns(reasons: DataFrame) -> DataFrame:
    """What is wrong by field: doc_id, field (null for the document), label, citations, lines, first.

    reasons has doc_id and reasons. A reason that names one or two fields stands under each, others under the document;
    citations and lines are distinct, in order, and a line loses the field or label it begins with."""
    each = reasons.select("doc_id", F.posexplode("reasons").alias("place", "r"))
    named = F.filter("r.fields", lambda f: f != "")
    under = F.when(F.size(named).between(1, 2), named).otherwise(F.array(F.lit("_document")))
    fanned = each.select("doc_id", "place", "r", F.explode(under).alias("name"))
    document = F.col("name") == "_document"
    shown = F.when(document, "This document").otherwise(label(F.col("name")))
    line = F.coalesce("r.message", F.lit(""))
    for lead in (F.concat("name", F.lit(": ")), F.concat(shown, F.lit(": "))):
        line = F.when(F.startswith(line, lead), F.substring(line, F.length(lead) + 1, F.length(line))).otherwise(line)
    rows = fanned.select("doc_id", "place", "name", shown.alias("label"), F.coalesce("r.citation", F.lit("")).alias("citation"), line.alias("line"))

    def ordered(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct("place", name)))
        return F.array_distinct(F.filter(F.transform(rows, lambda x: x[name]), lambda x: x != ""))

    grouped = rows.groupBy("doc_id", "name", "label").agg(ordered("citation").alias("citations"), ordered("line").alias("lines"), F.min("place").alias("first"))
    return grouped.select("doc_id", F.when(F.col("name") != "_document", F.col("name")).alias("field"), "label", "citations", "lines", "first")


def dashboard(items: DataFrame, contracts: DataFrame, calls: DataFrame, attachments: DataFrame, fields: DataFrame) -> DataFrame:
    """One row: open, filed, usd, usd_each (0 if nothing was delivered), unverifiable documents."""
    parts = [
        items.agg(F.count(F.when(F.col("state") == "open", 1)).alias("open")),
        contracts.agg(F.count(F.lit(1)).alias("filed")),
        calls.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd")),
        attachments.agg(F.count(F.when(F.col("status") == "delivered", 1)).alias("delivered")),
        fields.agg(F.count_distinct(F.when(F.col("prov_status") == "unverifiable", F.col("doc_id"))).alias("unverifiable")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, how="cross")  # one row each
    each = F.when(F.col("delivered") > 0, F.col("usd") / F.col("delivered")).otherwise(0.0)
    return out.withColumn("usd_each", each).drop("delivered")


def corrections(forms: DataFrame, fields: DataFrame, prefix: str = "field:") -> DataFrame:
    """What a reviewer changed: doc_id, name, corrected. forms has doc_id and form, a map of strings."""
    each = forms.select("doc_id", F.explode("form").alias("key", "new")).filter(F.startswith("key", F.lit(prefix)))
    each = each.withColumn("name", F.substring("key", F.lit(len(prefix) + 1), F.length("key")))
    both = each.join(fields.select("doc_id", "name", "v_text"), ["doc_id", "name"])
    changed = F.trim(F.coalesce("new", F.lit(""))) != F.trim(F.coalesce("v_text", F.lit("")))
    return both.filter(changed).select("doc_id", "name", F.trim("new").alias("corrected"))


def agent_ran(trace: Column) -> Column:
    return F.size(F.coalesce(trace, F.array())) > 0


def looked_up(trace: Column) -> Column:
    """Whether any tool but that for recording findings was used."""
    return F.exists(trace, lambda t: t["tool"] != "record_finding")


def detail(items: DataFrame, tables: dict[str, DataFrame], calls: DataFrame) -> DataFrame:
    """Each item with what leads to it, its reasons by weight, and the dollars spent on its attachment."""
    spent = calls.groupBy("attachment_id").agg(F.sum("usd").alias("usd"))
    out = chained(items, tables).join(spent, "attachment_id", "left")
    return out.withColumns({"usd": F.coalesce("usd", F.lit(0.0)), "reasons": by_weight(F.col("reasons"))})


def request(fields: DataFrame) -> DataFrame:
    """doc_id and request, the fields of a document as lines for a reviewer: name, value, page, and the quote's beginning."""
    value = F.coalesce("v_text", F.col("v_num").cast("string"), F.col("v_bool").cast("string"), F.lit("not stated"))
    quote = F.substring(F.coalesce("source_quote", F.lit("")), 1, fixed.QUOTE_CHARS)
    page = F.coalesce(F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")")), F.lit(""))
    line = F.concat(label(F.col("name")), F.lit(": "), value, page, F.when(quote == "", "").otherwise(F.concat(F.lit(' "'), quote, F.lit('"'))))
    lines = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("lines"))
    return lines.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("request"))


def field_view(fields: DataFrame) -> DataFrame:
    """Fields as a reviewer sees them: doc_id, name, label, value (as text), currency, confidence (0 if null), quote (empty if null),
    page and provenance (unknown if null)."""
    value = F.coalesce(F.col("v_text"), shown(F.col("v_num")), F.col("v_bool").cast("string"))
    return fields.select(
        "doc_id", "name", label(F.col("name")).alias("label"), value.alias("value"), "currency", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("source_quote", F.lit("")).alias("quote"), "page", F.coalesce("prov_status", F.lit("unknown")).alias("provenance"),
    )
