"""Policy checks as data, evaluated on the long table of fields."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions.text import jurisdiction

#: Checks that are read and evaluated at a time; an agent's findings are numbered from here on, behind any check.
CHECKS_AT_ONCE, AGENT_FROM = 1000, 1_000_000
OPERATORS = ("required", "equals", "between", "lte", "gte", "matches_any", "matches_none", "currency_stated")
CHECK = (
    "ordinal int, id string, section string, field string, op string, severity string, message string, absent_ok boolean, "
    "min double, max double, limit double, expected boolean, values array<string>, categories array<string>"
)
FINDINGS = "array<struct<ordinal:int,severity:string,field:string,citation:string,explanation:string>>"
#: The long table: a row per document and field.
FIELDS = (
    "doc_id long, name string, v_text string, v_num double, v_bool boolean, currency string, confidence double, "
    "source_quote string, page int, prov_status string"
)


def load_checks(spark: SparkSession, checks=fixed.CHECKS) -> DataFrame:
    """Checks as a table. An operator that isn't known fails here, before any document is judged."""
    for c in checks:
        if c["op"] not in OPERATORS:
            raise ValueError(f"check {c['id']} has the unknown operator {c['op']}")
    names = [x.split()[0] for x in CHECK.split(", ")]
    rows = [({"ordinal": i, "severity": "medium", "absent_ok": False} | dict(c)) for i, c in enumerate(checks)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CHECK)


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Checks of a JSON file, an array under `checks`, in its order. An operator that isn't known fails here; keys of a check
    that have no column of their own are left in `params`, as texts."""
    raw = spark.read.schema("checks array<map<string,string>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode("checks").alias("ordinal", "c")).orderBy("ordinal").collect()  # a file of policy, not of data
    known = {x.split()[0]: x.split()[1] for x in CHECK.split(", ")}
    convert = {"double": float, "boolean": lambda v: v == "true", "array<string>": json.loads}
    own = [{k: convert.get(known[k], str)(v) for k, v in r.c.items() if k in known and k != "ordinal" and v is not None} for r in rows]
    params = [(r.ordinal, {k: v for k, v in r.c.items() if k not in known}) for r in rows]
    return load_checks(spark, own).join(spark.createDataFrame(params, "ordinal int, params map<string,string>"), "ordinal")


def passes(check: Row, field: Column, law: Column) -> Column:
    """Whether a field (a struct, null if the document doesn't have it) passes a check. What isn't there fails unless the check
    allows that; so does a number that isn't one."""
    value = field["v_num"]
    number = F.when(~F.isnan(value), value)
    stated = F.coalesce(field["v_text"].isNotNull() | value.isNotNull() | field["v_bool"].isNotNull(), F.lit(False))
    text = F.coalesce(field["v_text"], value.cast("string"), field["v_bool"].cast("string"))
    currency = F.upper(F.trim(F.coalesce(field["currency"], F.lit(""))))
    values = check.values_ or []
    yes = {
        "required": lambda: F.lit(True),
        "equals": lambda: field["v_bool"] == check.expected,
        "between": lambda: number.between(check.min, check.max),
        "lte": lambda: number <= check.limit,
        "gte": lambda: number >= check.limit,
        "matches_any": lambda: law.isin(*values),
        "matches_none": lambda: ~F.exists(F.array(*[F.lit(v.lower()) for v in values]), lambda v: F.contains(F.lower(text), v)) if values else F.lit(True),
        "currency_stated": lambda: (currency != "") & (F.lit(check.values_ is None) | currency.isin(*[v.upper() for v in values])),
    }[check.op]()
    return F.when(~stated, F.lit(bool(check.absent_ok))).otherwise(F.coalesce(yes, F.lit(False)))


def shown(number: Column) -> Column:
    """A number as it is written: without a fraction where it has none."""
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def _failed(rules: list[Row], values: dict[str, Column], law: Column, category: Column) -> Column:
    """The findings of some checks: array<struct<ordinal, severity, field, citation, explanation>>. values has each field's value."""
    failed = []
    for r in rules:
        field = values[r.field]
        said, shows = F.lit(r.message), F.coalesce(field["v_text"], shown(field["v_num"]), field["v_bool"].cast("string"), F.lit(""))
        limits = {n: F.coalesce(shown(F.lit(getattr(r, n)).cast("double")), F.lit("")) for n in ("min", "max", "limit")}
        quoted = F.when(field["v_text"].isNotNull(), F.concat(F.lit("'"), field["v_text"], F.lit("'"))).otherwise(F.nullif(shows, F.lit("")))
        for name, x in {"value!r": F.coalesce(quoted, F.lit("None")), "value": shows, **limits}.items():
            if f"{{{name}}}" in r.message:
                said = F.replace(said, F.lit(f"{{{name}}}"), x)
        due = F.lit(True) if r.categories is None else F.coalesce(category, F.lit("")).isin(*r.categories)
        finding = F.struct(F.lit(r.ordinal).alias("ordinal"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"), F.lit(r.section).alias("citation"), said.alias("explanation"))
        failed.append(F.when(due & ~passes(r, field, law), finding))
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def judged(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """docs (category, fields: array<struct<name, v_text, v_num, v_bool, currency>> and more) with `findings`, those of the checks that a
    document fails, in the checks' order.

    A document without fields, or with null, fails what must be there. Of repeated fields of a document the smallest value counts, null
    before all. The checks are policy; they become expressions over a document's own row, so no row moves. They are read and evaluated
    in blocks of CHECKS_AT_ONCE."""
    ordered = checks.withColumnRenamed("values", "values_")
    last = ordered.agg(F.max("ordinal")).first()[0]
    out = docs.withColumn("findings", F.array().cast(FINDINGS))
    for start in range(0, -1 if last is None else last + 1, CHECKS_AT_ONCE):
        rules = ordered.filter(F.col("ordinal").between(start, start + CHECKS_AT_ONCE - 1)).orderBy("ordinal").collect()
        if not rules:
            continue
        names = {r.field: f"_value{i}" for i, r in enumerate({r.field: r for r in rules}.values())} | {"governing_law": "_law_value"}
        value = lambda name: F.array_min(F.transform(F.filter("fields", lambda f: f["name"] == name), lambda f: F.struct(f["v_text"].alias("v_text"), f["v_num"].alias("v_num"), f["v_bool"].alias("v_bool"), f["currency"].alias("currency"))))
        own = out.withColumns({column: value(name) for name, column in names.items()})
        own = own.withColumn("_law", jurisdiction(F.col("_law_value.v_text")))
        found = _failed(rules, {name: F.col(column) for name, column in names.items()}, F.col("_law"), F.col("category"))
        out = own.withColumn("findings", F.concat("findings", found)).drop("_law", *names.values())
    return out


def each_finding(docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of judged documents and f, a row per finding; documents without one have none. The outer form, since from the inner one
    Spark infers a filter on the number of findings, for which it judges each document once more."""
    return docs.select(*columns, F.explode_outer("findings").alias("f")).filter("f is not null")


def findings(fields: DataFrame, vendors: DataFrame, checks: DataFrame) -> DataFrame:
    """The checks that documents fail: doc_id, ordinal, kind, severity, field, citation, explanation, source.

    vendors has doc_id and category, a row per document to judge; fields is the long table, gathered by document in one aggregate and judged
    as in judged()."""
    own = fields.groupBy("doc_id").agg(F.collect_list(F.struct("name", "v_text", "v_num", "v_bool", "currency")).alias("fields"))
    docs = judged(vendors.select("doc_id", "category").join(own, "doc_id", "left"), checks)
    found = each_finding(docs, "doc_id")
    return found.select("doc_id", "f.ordinal", F.lit("policy_deviation").alias("kind"), "f.severity", "f.field", "f.citation", "f.explanation", F.lit("rules").alias("source"))


def recorded(findings_: DataFrame, agents: DataFrame) -> DataFrame:
    """Findings of the checks, then those of an agent (doc_id, kind, severity, field, citation, explanation), which counts only
    for documents that no check found anything in. Each is tagged by its source; a document's agent findings are numbered
    behind any check, in the order of their texts."""
    order = Window.partitionBy("doc_id").orderBy("citation", "field", "explanation", "severity", "kind")
    own = agents.join(findings_.select("doc_id").distinct(), "doc_id", "left_anti")
    own = own.withColumns({"ordinal": F.lit(AGENT_FROM) + F.row_number().over(order), "source": F.lit("agent")})
    return findings_.unionByName(own.select(*findings_.columns))


def cited_sections(checks: DataFrame) -> DataFrame:
    return checks.select("section").distinct()


def cited(found: DataFrame) -> DataFrame:
    """section and n: how many findings cite each section; those that cite none aren't counted."""
    return found.filter(F.coalesce("citation", F.lit("")) != "").groupBy(F.col("citation").alias("section")).agg(F.count(F.lit(1)).alias("n"))
