"""From documents to training sequences: five stages, each a DataFrame to a DataFrame.

All stages but the last return the columns of documents. run() writes each stage's result in the shared folder and the
next one reads it there, so no stage repeats the work of those before it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgate.llm.common import discard, fresh, scratch, write
from docgate.llm.exact_dedup import drop_exact_duplicates
from docgate.llm.langid import UNKNOWN, identify, train
from docgate.llm.packing import pack_documents
from docgate.llm.secrets import mask_secrets
from docgate.llm.shingles import drop_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; a missing lang is filled with the predicted one. Without a
    labelled text no language is known, and all documents with a letter stay as they are. Other columns, repeated rows and
    those of null doc_id pass unchanged; no rows give no rows."""
    lang = fresh(docs, "lang_found")
    found = identify(docs, train(docs), lang=lang, score=fresh(docs, "share_found"))
    kept = found.filter(F.col(lang).isNull() | (F.col(lang) != UNKNOWN))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the one with the smallest doc_id stays."""
    return drop_exact_duplicates(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word similarity of 0.8 or more the one with the smallest doc_id stays."""
    return drop_similar(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are masked, and n_chars counts what is left."""
    return mask_secrets(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: a row per piece of a document."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=0, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Language identification and BPE have no SQL form; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table. What a stage has written on the way, and what it read, goes when its
    result stands; the last stage's result is computed when it is asked for, from tables that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, apply in STAGES[:-1]:
        with scratch(spark):
            docs, folder = write(apply(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
