"""Triage: whether a file can be a contract, from its size, kind and first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions.text import first_line, found, other_kinds
from docgate.operators.intake import ACCEPTED


def judged(found_: Column, other: Column) -> Column:
    """kind and evidence from the terms found in a text (functions.text.found()) and those in its title (other_kinds()).

    A title that names another kind of document decides first; then two invoice terms without a contract's marker; then a
    marker with any second term."""
    strong, supporting, invoice = found_["strong"], found_["supporting"], found_["invoice"]
    terms = F.concat(strong, supporting)
    shown = lambda x: F.array_join(F.slice(x, 1, fixed.SHOWN_TERMS), ", ")
    verdict = lambda kind, why: F.struct(F.lit(kind).alias("kind"), why.alias("evidence"))
    counts = F.format_string("%d markers, %d supporting, %d invoice terms", F.size(strong), F.size(supporting), F.size(invoice))
    return (
        F.when(F.size(other) > 0, verdict("unknown", F.concat(F.lit("its title says "), F.try_element_at(other, F.lit(1)))))
        .when((F.size(strong) == 0) & (F.size(invoice) >= fixed.MIN_INVOICE), verdict("invoice", shown(invoice)))
        .when((F.size(strong) >= fixed.MIN_STRONG) & (F.size(terms) >= fixed.MIN_TERMS), verdict("contract", shown(terms)))
        .otherwise(verdict("unknown", counts))
    )


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with kind (contract, invoice, unknown) and evidence. Each text is folded and read once, by one automaton for all terms."""
    own = F.coalesce(F.col(text), F.lit(""))
    read = docs.withColumns({"_found": found(own), "_other": other_kinds(first_line(own))})
    out = read.withColumn("_verdict", judged(F.col("_found"), F.col("_other")))
    return out.withColumns({"kind": F.col("_verdict.kind"), "evidence": F.col("_verdict.evidence")}).drop("_found", "_other", "_verdict")


def triage(files: DataFrame) -> DataFrame:
    """files with outcome (tag advanced or rejected, reason, note).

    files has size_bytes, file_kind, and of PDFs encrypted, readable, page_count and first_page_text."""
    judged_files = classify(files.withColumn("_sample", F.substring("first_page_text", 1, fixed.SAMPLE_CHARS)), "_sample")
    rejected = lambda why: F.struct(F.lit("rejected").alias("tag"), why.alias("reason"), F.lit(None).cast("string").alias("note"))
    advanced = lambda note: F.struct(F.lit("advanced").alias("tag"), F.lit(None).cast("string").alias("reason"), note.alias("note"))
    image = F.col("file_kind") != "pdf"
    scanned = F.length(F.trim(F.coalesce("_sample", F.lit("")))) < fixed.MIN_FIRST_PAGE_CHARS
    outcome = (
        F.when(F.col("size_bytes").isNull(), rejected(F.lit("no file")))
        .when(F.col("size_bytes") == 0, rejected(F.lit("empty")))
        .when(F.col("size_bytes") > fixed.MAX_BYTES, rejected(F.lit("too large")))
        .when(~F.col("file_kind").isin(*ACCEPTED), rejected(F.concat(F.lit("not accepted: "), F.col("file_kind"))))
        .when(image & (F.col("size_bytes") < fixed.MIN_IMAGE_BYTES), rejected(F.lit("too small an image")))
        .when(image, advanced(F.lit("an image")))
        .when(F.coalesce(F.col("encrypted"), F.lit(False)), rejected(F.lit("needs a password")))
        .when(~F.coalesce(F.col("readable"), F.lit(True)), rejected(F.lit("unreadable")))
        .when(F.col("page_count") == 0, rejected(F.lit("no pages")))
        .when(F.col("page_count") > fixed.MAX_PAGES, rejected(F.lit("too many pages")))
        .when(scanned, advanced(F.lit("no text on the first page")))
        .when(F.col("kind") == "contract", advanced(F.concat(F.lit("terms: "), F.col("evidence"))))
        .otherwise(rejected(F.concat(F.col("kind"), F.lit(": "), F.col("evidence"))))
    )
    return judged_files.withColumn("outcome", outcome).drop("_sample")
