"""Whether the text that a field quotes stands in the document and supports the field's value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions.text import alphanumeric, digits, fold, jurisdiction, numbers_in, phrasings, quote_form, states_a_number
from docgate.operators.pages import of_kind


def supports() -> Column:
    """Whether source_quote can be evidence for the value beside it, by field and kind of value."""
    quote = F.coalesce("source_quote", F.lit(""))
    year = F.substring("v_text", 1, 4)
    wanted = digits(F.bround("v_num").cast("decimal(38,0)").cast("string"))
    stated = numbers_in(quote)
    text = alphanumeric(F.col("v_text"))
    return (
        F.when(F.col("v_bool").isNotNull() | (F.col("name") == "signatories"), F.lit(True))
        .when(F.col("name") == "effective_date", ~year.rlike("^[0-9]+$") | F.contains(quote, year))
        .when(F.col("name") == "governing_law", F.exists("ways", lambda p: F.contains(F.col("folded_quote"), p)))
        .when(F.col("v_num").isNotNull(), F.when(F.size(stated) > 0, (wanted == "") | F.array_contains(stated, wanted)).otherwise(states_a_number(quote)))
        .otherwise((text == "") | F.contains(alphanumeric(quote), text))
    )


def verified(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """fields with prov_status (verified, unverifiable, not_found, absent), confidence and prov_note.

    documents has doc_id and pages. A claimed page decides only where the quote is looked for: a quote elsewhere in the
    document is verified with a note, on a scanned page it can't be checked, and any failure sets confidence to 0."""
    mark = "\u0000"
    text_pages = of_kind(F.col("pages"), "text")
    joined = F.array_join(F.transform(text_pages, lambda p: F.coalesce(p["text"], F.lit(""))), f" {mark} ")
    docs = documents.select("doc_id", "pages", quote_form(joined).alias("_joined"), F.size(text_pages).alias("n_text"))
    docs = docs.select(
        "doc_id",
        "n_text",
        F.transform(text_pages, lambda p: p["number"]).alias("numbers"),
        F.transform(of_kind(F.col("pages"), "image"), lambda p: p["number"]).alias("scans"),
        F.transform(F.split("_joined", mark), F.trim).alias("texts"),
        F.trim(F.regexp_replace("_joined", rf"\s*{mark}\s*", " ")).alias("whole"),
    )
    rows = fields.join(docs, "doc_id", "left").withColumns(
        {
            "needle": quote_form(F.trim(F.coalesce("source_quote", F.lit("")))),
            "folded_quote": fold(quote_form(F.coalesce("source_quote", F.lit("")))),
            "law": jurisdiction(F.when(F.col("name") == "governing_law", F.col("v_text"))),
        }
    )
    rows = rows.withColumn("folded_value", fold(quote_form(F.col("v_text"))))
    rows = rows.withColumn("ways", phrasings(F.col("folded_value"), F.col("law")))
    has_value = F.col("v_text").isNotNull() | F.col("v_num").isNotNull() | F.col("v_bool").isNotNull()
    quote = F.trim(F.coalesce("source_quote", F.lit("")))
    place = F.coalesce(F.array_position("numbers", F.col("page")), F.lit(0)).cast("int")
    on_page = (place > 0) & F.contains(F.coalesce(F.try_element_at("texts", F.greatest(place, F.lit(1))), F.lit("")), F.col("needle"))
    anywhere = F.contains(F.coalesce("whole", F.lit("")), F.col("needle"))
    found_on = F.try_element_at(
        F.transform(F.filter(F.arrays_zip("numbers", "texts"), lambda x: F.contains(x["texts"], F.col("needle"))), lambda x: x["numbers"]), F.lit(1)
    )
    verdict = lambda status, note: F.struct(F.lit(status).alias("status"), note.alias("note"))
    nothing = F.lit(None).cast("string")
    claimed = F.coalesce(F.col("page").cast("string"), F.lit("none"))
    checked = (
        F.when(~has_value, verdict("absent", F.lit("not stated")))
        .when(quote == "", verdict("not_found", F.lit("no quote")))
        .when(F.length(quote) < fixed.MIN_QUOTE_CHARS, verdict("not_found", F.lit("quote too short")))
        .when(~F.coalesce(supports(), F.lit(False)), verdict("not_found", F.lit("quote doesn't support the value")))
        .when(on_page, verdict("verified", nothing))
        .when((place > 0) & anywhere, verdict("verified", F.concat(F.lit("on page "), F.coalesce(found_on.cast("string"), F.lit("none")), F.lit(", not "), claimed)))
        .when(place > 0, verdict("not_found", F.lit("quote not in the document")))
        .when(F.coalesce(F.col("n_text"), F.lit(0)) == 0, verdict("unverifiable", F.lit("no page has text")))
        .when(F.coalesce(F.array_contains("scans", F.col("page")), F.lit(False)), verdict("unverifiable", F.lit("the page is a scan")))
        .when(anywhere, verdict("verified", F.concat(F.lit("no page "), claimed)))
        .otherwise(verdict("not_found", F.lit("quote not in the document")))
    )
    out = rows.withColumn("_v", checked)
    kept = F.col("_v.status").isin("verified", "unverifiable")
    return out.withColumns(
        {
            "prov_status": F.col("_v.status"),
            "prov_note": F.col("_v.note"),
            "confidence": F.when(kept, F.coalesce("confidence", F.lit(0.0))).otherwise(F.lit(0.0)),
        }
    ).select(*fields.drop("prov_status", "prov_note").columns, "prov_status", "prov_note")


def provenance_counts(fields: DataFrame) -> DataFrame:
    """How many fields of each document have each of the four statuses."""
    return fields.groupBy("doc_id").agg(*[F.count(F.when(F.col("prov_status") == s, 1)).alias(s) for s in ("verified", "unverifiable", "not_found", "absent")])


def verdict_lists(fields: DataFrame) -> DataFrame:
    """The names of the fields whose quote was found, and of those whose wasn't."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("prov_status") == s, F.col("name"))))
    return fields.groupBy("doc_id").agg(names("verified").alias("verified"), names("not_found").alias("hallucinated"))


def with_provenance(fields: DataFrame, provenance: DataFrame) -> DataFrame:
    """fields with the prov_status that a table of (doc_id, name, prov_status) has for them; null where it has none. Of several rows for
    a field the last in order counts."""
    own = provenance.groupBy("doc_id", "name").agg(F.max("prov_status").alias("prov_status"))
    return fields.drop("prov_status").join(own, ["doc_id", "name"], "left")
