"""Delivery: contracts and review items, each once per decision, and review actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate.operators.intake import first_of_each

APPROVED_MARK = "_approved_by_human"


def flattened(payload: Column) -> Column:
    """A map of names to values without those that begin with an underscore."""
    return F.map_filter(payload, lambda k, _: ~F.startswith(k, F.lit("_")))


def overlaid(payload: Column, corrections: Column) -> Column:
    """A payload with corrections in place of its values. Keys are unique, whatever the policy for doubled keys."""
    kept = F.map_filter(payload, lambda k, _: ~F.array_contains(F.map_keys(corrections), k))
    return F.map_concat(kept, corrections)


def contracts_to_file(decisions: DataFrame, filed: DataFrame) -> DataFrame:
    """Approved decisions that aren't filed yet. Run twice, the second run adds nothing. Of different rows of one decision the one
    with the smallest counterparty, then payload (as JSON), is filed; null comes first."""
    due = decisions.filter(F.col("route") == "auto_approved")
    return first_of_each(due, ["decision_id"], [F.col("counterparty_id"), F.to_json("payload")]).join(filed.select("decision_id"), "decision_id", "left_anti").select("decision_id", "counterparty_id", flattened(F.col("payload")).alias("payload"))


def items_to_open(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions that need a person and have no item yet, each once: decision_id and state."""
    due = decisions.filter(F.col("route") == "needs_review")
    return due.select("decision_id").distinct().join(items.select("decision_id"), "decision_id", "left_anti").select("decision_id", F.lit("open").alias("state"))


def resolved(items: DataFrame, actions: DataFrame) -> DataFrame:
    """items after actions (decision_id, action, corrections, resolved_by, resolved_at): an open one becomes approved or rejected by the
    first action on it, which closes it; later actions change nothing, nor does any on an item that isn't open. Of actions at one time
    one that doesn't approve comes first, then by who acted; an action without a time comes last. The decision itself isn't touched."""
    kept = F.struct("action", "corrections", "resolved_by", "resolved_at")
    approves = F.coalesce(F.col("action") == "approve", F.lit(False))
    order = F.struct(F.col("resolved_at").isNull(), "resolved_at", approves, F.coalesce("resolved_by", F.lit("")))
    first = actions.groupBy("decision_id").agg(F.min_by(kept, order).alias("a"))
    both = items.drop("human_corrections", "resolved_by", "resolved_at").join(first, "decision_id", "left")
    acts = (F.col("state") == "open") & F.col("a").isNotNull()
    state = F.when(acts, F.when(F.col("a.action") == "approve", "approved").otherwise("rejected")).otherwise(F.col("state"))
    return both.select(
        "decision_id",
        state.alias("state"),
        F.when(acts, F.col("a.corrections")).alias("human_corrections"),
        F.when(acts, F.col("a.resolved_by")).alias("resolved_by"),
        F.when(acts, F.col("a.resolved_at")).alias("resolved_at"),
    )


def promoted(items: DataFrame, decisions: DataFrame, filed: DataFrame) -> DataFrame:
    """Contracts of items that a person approved, with their corrections and a mark, once per decision."""
    yes = items.filter(F.col("state") == "approved").select("decision_id", "human_corrections")
    due = yes.join(decisions, "decision_id").join(filed.select("decision_id"), "decision_id", "left_anti")
    none = F.create_map().cast("map<string,string>")
    mark = F.create_map(F.lit(APPROVED_MARK), F.lit("true"))
    payload = F.map_concat(overlaid(flattened(F.col("payload")), F.coalesce("human_corrections", none)), mark)
    return due.select("decision_id", "counterparty_id", payload.alias("payload"))


def contract_view(contracts: DataFrame) -> DataFrame:
    """Contracts newest first, hidden keys as columns of their own."""
    by_human = F.coalesce(F.try_element_at("payload", F.lit(APPROVED_MARK)) == "true", F.lit(False))
    return contracts.withColumns({"approved_by_human": by_human, "payload": flattened(F.col("payload"))}).orderBy(F.desc("decision_id"))


def as_json(value: Column) -> Column:
    """Pages, reasons, findings or costs as one JSON text, without fields that are null."""
    return F.to_json(value)


def from_json(text: Column, schema: str) -> Column:
    """What as_json() has written, by its schema; null where the text isn't JSON."""
    return F.from_json(text, schema)
