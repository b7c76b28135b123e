"""What an agent did: its tool calls, kept as variants, since each tool has requests and answers of its own shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tools by what they are for: looking up, and recording what was found.
SEARCH, RESOLVE, RECORD = "search_policy", "resolve_counterparty", "record_finding"
LOOK_UPS = (SEARCH, RESOLVE)


def recorded(tool: Column, request: Column, response: Column) -> Column:
    """A call as a struct for a trace: request and response are structs, maps or arrays."""
    return F.struct(tool.alias("tool"), F.to_variant_object(request).alias("input"), F.to_variant_object(response).alias("output"))


def calls(enrichments: DataFrame) -> DataFrame:
    """id, place, tool, input, output: a row per call of each enrichment's trace (id, trace: the JSON text of an array of calls), in order from
    0; input and output are variants. A trace that is null, no JSON or no array has no calls; a call without a tool has null there."""
    trace = F.try_variant_get(F.try_parse_json("trace"), "$", "array<variant>")
    each = enrichments.select("id", F.posexplode(trace).alias("place", "call"))
    return each.select(
        "id",
        "place",
        F.try_variant_get("call", "$.tool", "string").alias("tool"),
        F.try_variant_get("call", "$.input", "variant").alias("input"),
        F.try_variant_get("call", "$.output", "variant").alias("output"),
    )


def found(made: DataFrame) -> DataFrame:
    """The findings that calls record: id, place, kind, severity, field, citation, explanation, and what they rest on: looked_up (some tool
    was asked before in the same trace) and seen (a search before it gave the section that it cites).

    One window over an enrichment's calls, in order; a trace is one run of an agent."""
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sections = F.when(F.col("tool") == SEARCH, F.transform(F.try_variant_get("output", "$", "array<variant>"), lambda v: F.try_variant_get(v, "$.section", "string")))
    said = lambda name: F.try_variant_get("input", f"$.{name}", "string")
    rows = made.withColumns(
        {
            "looked_up": F.coalesce(F.max(F.col("tool").isin(*LOOK_UPS)).over(before), F.lit(False)),
            "given": F.flatten(F.collect_list(F.coalesce(sections, F.array().cast("array<string>"))).over(before)),
        }
    )
    out = rows.filter(F.col("tool") == RECORD).select(
        "id", "place", said("kind").alias("kind"), said("severity").alias("severity"), said("field_name").alias("field"), said("citation").alias("citation"),
        said("explanation").alias("explanation"), "looked_up", "given",
    )
    return out.withColumn("seen", F.coalesce(F.array_contains("given", F.col("citation")), F.lit(False))).drop("given")


def summary(enrichments: DataFrame) -> DataFrame:
    """A row per enrichment: id, ran (the agent made a call), consulted (it looked anything up), calls, findings, and unfounded, the findings
    that nothing was looked up before."""
    made = calls(enrichments)
    counts = made.groupBy("id").agg(F.count(F.lit(1)).alias("calls"), F.max(F.coalesce(F.col("tool").isin(*LOOK_UPS), F.lit(False))).alias("consulted"))
    findings = found(made).groupBy("id").agg(F.count(F.lit(1)).alias("findings"), F.count(F.when(~F.col("looked_up"), 1)).alias("unfounded"))
    out = enrichments.select("id").distinct().join(counts, "id", "left").join(findings, "id", "left")
    number = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return out.select("id", F.col("calls").isNotNull().alias("ran"), F.coalesce("consulted", F.lit(False)).alias("consulted"), number("calls"), number("findings"), number("unfounded"))
