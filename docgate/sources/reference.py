"""Reference data: registry, playbook, text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VENDOR = (
    "id string, legal_name string, aliases array<string>, registration_id string, country string, category string, "
    "risk_class string, status string, notes string"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Vendors of a JSON file, an array under `vendors`, with their ordinal; risk_class defaults to standard, status to
    approved."""
    raw = spark.read.schema(f"vendors array<struct<{VENDOR.replace(' string', ':string').replace(' array<string>', ':array<string>')}>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode("vendors").alias("ordinal", "v")).select("ordinal", "v.*")
    return rows.withColumns({"risk_class": F.coalesce("risk_class", F.lit("standard")), "status": F.coalesce("status", F.lit("approved"))})


def sections(texts: DataFrame, text: str = "value") -> DataFrame:
    """The sections of Markdown playbooks: section, title, body, in order. A section begins with a heading `## §n title`."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, r"\r\n?", "\n")), r"\n##[ \t]+(?=§[0-9.]+[ \t])")
    each = texts.select(F.posexplode(parts).alias("ordinal", "part")).filter("ordinal > 0")
    body = F.regexp_extract("part", r"(?s)^[^\n]*\n(.*)$", 1)
    return each.select(
        "ordinal",
        F.regexp_extract("part", r"^(§[0-9.]+)[ \t]", 1).alias("section"),
        F.trim(F.regexp_extract("part", r"^§[0-9.]+[ \t]+([^\n]*)", 1)).alias("title"),
        F.regexp_replace(F.replace(body, F.lit("---"), F.lit("")), r"^\s+|\s+$", "").alias("body"),
    )


def read_playbook(spark: SparkSession, path: str) -> DataFrame:
    return sections(spark.read.text(path, wholetext=True))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Text files below a folder: text, name (without endings, .scan too), label (the folder a file is in), scanned."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(
        F.col("value").alias("text"),
        F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.txt$", 1), r"\.scan$", "").alias("name"),
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("label"),
        path.rlike(r"\.scan\.txt$").alias("scanned"),
    )
