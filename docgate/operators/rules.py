"""Routing rules: every rule runs, and any reason keeps a document from being filed without a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate import fixed

REASON = "struct<rule:string,message:string,citation:string,fields:array<string>>"


def _reason(rule: str, message: Column, citation: Column | str = "", fields: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        message.alias("message"),
        (F.lit(citation) if isinstance(citation, str) else citation).alias("citation"),
        (F.array().cast("array<string>") if fields is None else fields).alias("fields"),
    ).cast(REASON)


def _if(condition: Column, reason: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(reason)).otherwise(F.array().cast(f"array<{REASON}>"))


def severity(finding: Column) -> Column:
    """low or medium as stated; anything else weighs as high."""
    said = F.lower(F.trim(F.coalesce(finding["severity"], F.lit(""))))
    return F.when(said.isin("low", "medium"), said).otherwise("high")


def _of_findings(level: str) -> Column:
    def reason(f: Column) -> Column:
        field = F.coalesce(f["field"], F.lit(""))
        said = F.concat(F.when(field == "", "document").otherwise(field), F.lit(": "), F.coalesce(f["explanation"], F.lit("")))
        named = F.when(field == "", F.array().cast("array<string>")).otherwise(F.array(field))
        return _reason(f"{level}_severity_finding", F.trim(said), F.coalesce(f["citation"], F.lit("")), named)

    return F.transform(F.filter("findings", lambda f: severity(f) == level), reason)


def _names(keep) -> Column:
    return F.transform(F.filter("fields", keep), lambda f: f["name"])


def _ordered(names: tuple[str, ...], found: Column) -> Column:
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(found, n))


def _valued(f: Column) -> Column:
    return f["has_value"]


def reasons(confidence: float = fixed.MIN_CONFIDENCE, match: float = fixed.MIN_MATCH) -> Column:
    """All reasons, in the rules' order, from a row of document_kind, counterparty_id, counterparty_score,
    counterparty_status, findings and fields (array<struct<name, has_value, confidence, prov_status>>)."""
    listed = lambda x: F.array_join(x, ", ")
    unchecked = _ordered(fixed.DECISION_BEARING, _names(lambda f: f["prov_status"] == "unverifiable"))
    missing = F.array_except(F.array(*map(F.lit, fixed.REQUIRED)), _names(_valued))
    weak = _ordered(fixed.DECISION_BEARING, _names(lambda f: _valued(f) & (F.coalesce(f["confidence"], F.lit(0.0)) < confidence)))
    invented = _names(lambda f: f["prov_status"] == "not_found")
    statuses = F.array_except(F.array_distinct(F.filter(F.transform("fields", lambda f: f["prov_status"]), lambda s: s.isNotNull())), F.array(F.lit("absent")))
    party = F.array(F.lit("counterparty_name"))
    known = F.coalesce("counterparty_id", F.lit("")) != ""
    return F.concat(
        _if(F.col("document_kind").isNotNull() & ~F.col("document_kind").isin(*fixed.CONTRACT_KINDS), _reason("not_a_contract", F.concat(F.lit("read as "), F.col("document_kind")))),
        _if(F.size(unchecked) > 0, _reason("partially_unverifiable", F.concat(F.lit("only on scanned pages: "), listed(unchecked)), "", unchecked)),
        _if(
            known & (F.coalesce("counterparty_status", F.lit("unknown")) != "approved"),
            _reason("suspended_counterparty", F.concat("counterparty_id", F.lit(" is "), F.coalesce("counterparty_status", F.lit("unknown"))), "§7.1", party),
        ),
        _if(
            ~known,
            _reason("unresolved_counterparty", F.format_string(f"best match %.2f, threshold {match:.2f}", F.coalesce("counterparty_score", F.lit(0.0))), "§7.2", party),
        ),
        _of_findings("high"),
        _of_findings("medium"),
        _of_findings("low"),
        _if(F.size(invented) > 0, _reason("unsupported_quote", F.concat(F.lit("quotes not in the document: "), listed(invented)), "", invented)),
        _if(F.size(missing) > 0, _reason("missing_required_field", F.concat(F.lit("not stated: "), listed(missing)), "", missing)),
        _if(F.size(weak) > 0, _reason("low_confidence_required_field", F.concat(F.lit(f"below {confidence:.2f}: "), listed(weak)), "", weak)),
        _if((F.size(statuses) == 1) & F.array_contains(statuses, "unverifiable"), _reason("wholly_unverifiable", F.lit("every value is on scanned pages"))),
    )


def decide(evidence: DataFrame) -> DataFrame:
    """evidence with reasons, route (auto_approved, needs_review, rejected) and blocking_fields, distinct and in order."""
    out = evidence.withColumn("reasons", reasons())
    rejected = F.exists("reasons", lambda r: r["rule"] == "not_a_contract")
    return out.withColumns(
        {
            "route": F.when(F.size("reasons") == 0, "auto_approved").when(rejected, "rejected").otherwise("needs_review"),
            "blocking_fields": F.array_distinct(F.filter(F.flatten(F.transform("reasons", lambda r: r["fields"])), lambda f: f != "")),
        }
    )


def by_weight(reason_list: Column) -> Column:
    """Reasons by the fixed rank of their rule, then by message; unknown rules rank 9."""
    ranks = F.create_map(*[F.lit(x) for pair in fixed.REASON_RANK.items() for x in pair])
    keyed = F.transform(reason_list, lambda r: F.struct(F.coalesce(F.try_element_at(ranks, r["rule"]), F.lit(9)).alias("rank"), r["message"].alias("message"), r.alias("reason")))
    return F.transform(F.array_sort(keyed), lambda x: x["reason"])


def findings_by_severity(finding_list: Column) -> Column:
    """Findings high, medium, low, others; in their order within each."""
    ranks = F.create_map(*[F.lit(x) for pair in fixed.SEVERITY_RANK.items() for x in pair])
    keyed = F.transform(finding_list, lambda f, i: F.struct(F.coalesce(F.try_element_at(ranks, f["severity"]), F.lit(9)).alias("rank"), i.alias("place"), f.alias("finding")))
    return F.transform(F.array_sort(keyed), lambda x: x["finding"])
