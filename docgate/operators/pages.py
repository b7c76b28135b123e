"""Pages of a document: array<struct<number, kind, text, image_path, width, height>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions.amounts import page_tokens
from docgate.functions.personal import mask_all, plain, suspect

PAGE = "struct<number:int,kind:string,text:string,image_path:string,width:int,height:int>"


def split_pages(text: Column, least: int = fixed.MIN_PAGE_CHARS) -> Column:
    """Pages of a text with form feeds between; one with hardly any text counts as an image."""
    none = lambda kind: F.lit(None).cast(kind)

    def page(t: Column, i: Column) -> Column:
        kind = F.when(F.length(F.trim(t)) >= least, "text").otherwise("image")
        return F.struct(
            (i + 1).alias("number"), kind.alias("kind"), t.alias("text"), none("string").alias("image_path"), none("int").alias("width"), none("int").alias("height")
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\f"), page).cast(f"array<{PAGE}>")


def of_kind(pages: Column, kind: str) -> Column:
    return F.filter(pages, lambda p: p["kind"] == kind)


def all_text(pages: Column) -> Column:
    return F.array_join(F.transform(of_kind(pages, "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def usable(pages: Column) -> Column:
    """Whether any page has text or an image."""
    return F.exists(pages, lambda p: (F.length(F.trim(F.coalesce(p["text"], F.lit("")))) > 0) | p["image_path"].isNotNull())


def measured(docs: DataFrame) -> DataFrame:
    """docs with page_count, text_pages, image_pages and estimated_tokens."""
    total = F.aggregate(F.transform("pages", page_tokens), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    return docs.withColumns(
        {
            "page_count": F.size("pages"),
            "text_pages": F.size(of_kind(F.col("pages"), "text")),
            "image_pages": F.size(of_kind(F.col("pages"), "image")),
            "estimated_tokens": total,
        }
    )


def masked(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with personal data masked on every page, and redactions, how often by category; an empty map if none was found,
    also where there are no pages. Null texts stay null.

    The pages of a document go through one function together, without a shuffle; those of documents that hold neither a digit nor
    an @, and so nothing to mask, stay in the JVM."""
    texts = F.transform("pages", lambda p: p["text"])
    out = docs.drop("redactions").withColumn("_m", mask_all(F.when(F.exists(texts, suspect), texts)))
    new = F.coalesce("_m.texts", F.transform(texts, plain))
    pages = F.transform("pages", lambda p, i: p.withField("text", F.get(new, i)))
    return out.withColumns({"pages": pages, "redactions": F.coalesce("_m.counts", F.create_map().cast("map<string,int>"))}).drop("_m")


def blocks(pages: Column) -> Column:
    """Pages as blocks for a model: array<struct<type, text, image_path>>."""
    none = F.lit(None).cast("string")

    def block(p: Column) -> Column:
        text = F.concat(F.lit("page "), p["number"].cast("string"), F.lit("\n"), F.coalesce(p["text"], F.lit("")))
        return F.struct(
            F.when(p["kind"] == "image", "image").otherwise("text").alias("type"),
            F.when(p["kind"] == "image", none).otherwise(text).alias("text"),
            F.when(p["kind"] == "image", p["image_path"]).alias("image_path"),
        )

    return F.transform(pages, block)
