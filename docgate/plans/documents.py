"""The intake composed: from files to contracts and review items, in six stages behind the reception of messages.

Each stage takes all documents that wait for it as one plan. What it made, its dead letters and the new states are published together
(plans.store); of a document that a stage failed on nothing is kept but its state and what was spent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate import fixed
from docgate.operators import checks, deliver, pages, resolve, rules, triage, verify
from docgate.plans.batch import OUTCOME, dead_letters, moved, runnable, validated
from docgate.plans.store import Store, Transaction
from docgate.plans.tables import spread

#: The status table: a row per attachment.
STATUS = "id long, status string, status_reason string, attempts int, retry_after timestamp, updated_at timestamp"


@dataclass(frozen=True)
class Inputs:
    """files: id, file_kind, size_bytes, encrypted, readable, page_count, first_page_text and text (pages with form feeds between).

    Recorded calls stand in for a model's, a row for each try of a document (attempt, from 0): extractions has id, attempt,
    document_kind, error_class, message, usd; agent_runs has id, attempt, error_class, message, usd. A try without a row is one that
    wasn't made, and fails. fields: the long table of checks.FIELDS, doc_id being the id. agents: findings of the agent. registry: as
    sources.reference.read_registry() gives it. policy: the checks."""

    files: DataFrame
    extractions: DataFrame
    fields: DataFrame
    registry: DataFrame
    agent_runs: DataFrame
    agents: DataFrame
    policy: DataFrame


@dataclass(frozen=True)
class Step:
    """A stage over the store. work gets the documents due and gives them with an outcome, and rows of `tables`, by id, doc_id or
    decision_id."""

    number: int
    name: str
    consumes: str
    produces: str
    tables: tuple[str, ...]
    work: Callable[[DataFrame], tuple[DataFrame, dict[str, DataFrame]]]


@dataclass(frozen=True)
class Desk:
    """What a stage reads and writes in a transaction: the store's tables as of its beginning, and tables for its own use."""

    own: Transaction

    def read(self, name: str, key: str) -> DataFrame:
        return self.own.store.read(name, key, self.own.version)

    def delivered(self, name: str) -> DataFrame:
        """The decisions that a table of deliveries has."""
        if name not in self.own.entries:
            return self.own.store.spark.createDataFrame([], "decision_id long")
        return self.read(name, "decision_id").select("decision_id")

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        return self.own.keep(name, rows)


@dataclass(frozen=True)
class Drained:
    """What a drain did: transitions of documents, and how many documents ended."""

    transitions: int
    finished: int


def _outcome(tag: Column | str, reason: Column | None = None, note: Column | None = None, error: Column | None = None, retryable: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"),
        (text if note is None else note).alias("note"),
        (text if reason is None else reason).alias("reason"),
        (text if error is None else error).alias("error_class"),
        (F.lit(None).cast("boolean") if retryable is None else retryable).alias("retryable"),
    ).cast(OUTCOME)


def failure(error_class: Column, message: Column, declined: str) -> Column:
    """The outcome of an error, by its class (fixed.ERROR_ACTIONS): rejected with a reason that begins with `declined`, or failed,
    to be tried again or not. A class that isn't listed is tried again, as what a network does mends itself."""
    said = F.coalesce(message, F.lit(""))
    is_ = lambda action: error_class.isin(*[c for c, a in fixed.ERROR_ACTIONS.items() if a == action])
    failed = _outcome("failed", F.concat(error_class, F.when(said == "", "").otherwise(F.concat(F.lit(": "), said))), error=error_class, retryable=~is_("die"))
    return F.when(is_("reject"), _outcome("rejected", F.concat(F.lit(f"{declined}: "), said))).otherwise(failed)


def _joined(rows: DataFrame, table: DataFrame, outcome: Column, on: list[str] | None = None) -> DataFrame:
    """rows with an outcome from the table's row of their id (`_there` is null where there is none)."""
    return rows.join(table.withColumn("_there", F.lit(True)), on or "id", "left").withColumn("outcome", outcome).select(*rows.columns, "outcome")


def _tried(calls: DataFrame) -> DataFrame:
    """Recorded calls by the count of tries that a document has behind it, which `attempts` says. Of repeated rows any equal one."""
    return calls.withColumnRenamed("attempt", "attempts").dropDuplicates(["id", "attempts"])


def triage_step(inputs: Inputs) -> Step:
    """received to triaged: what can't be a contract is rejected."""

    def work(due: DataFrame):
        judged = triage.triage(spread(due.select("id").join(inputs.files, "id", "left"), "id"))
        o = F.col("o")
        return _joined(due, judged.select("id", F.col("outcome").alias("o")), _outcome(o["tag"], o["reason"], o["note"])), {}

    return Step(2, "triage", "received", "triaged", (), work)


def load(inputs: Inputs, ids: DataFrame) -> DataFrame:
    """id, pages (masked), redactions, page_count, text_pages, image_pages, estimated_tokens, of the files named."""
    docs = inputs.files.join(ids, "id", "left_semi").select("id", pages.split_pages(F.col("text")).alias("pages"))
    return pages.measured(pages.masked(spread(docs, "id"), "id"))


def load_step(inputs: Inputs, desk: Desk) -> Step:
    """triaged to loaded: a document without a page to use is rejected."""
    masked = F.aggregate(F.map_values("redactions"), F.lit(0), lambda a, b: a + b)
    note = F.concat(F.format_string("%d pages: %d as text, %d as image", "page_count", "text_pages", "image_pages"), F.when(masked > 0, F.format_string("; %d masked", masked)).otherwise(""))
    usable = F.coalesce(pages.usable(F.col("pages")), F.lit(False))
    outcome = F.when(usable, _outcome("advanced", note=note)).otherwise(_outcome("rejected", F.lit("no page has text or an image")))

    def work(due: DataFrame):
        documents = desk.keep("loaded", load(inputs, due.select("id")))
        return _joined(due, documents, outcome), {"documents": documents}

    return Step(3, "load", "triaged", "loaded", ("documents",), work)


def extract_step(inputs: Inputs, desk: Desk) -> Step:
    """loaded to extracted, by the recorded extraction of this try. A refusal or another kind than a contract is rejected, other errors
    follow their class; without a record the stage fails and is tried again. Quotes are checked against the document's pages."""
    kind = F.col("document_kind")
    outcome = (
        F.when(F.col("_there").isNull(), failure(F.lit("NoExtraction"), F.lit("no call is recorded"), ""))
        .when(F.col("error_class").isNotNull(), failure(F.col("error_class"), F.col("message"), "the model declined to read this"))
        .when(kind == "other", _outcome("rejected", F.lit("read as other")))
        .otherwise(_outcome("advanced", note=F.concat(F.lit("read as "), F.coalesce(kind, F.lit("contract")))))
    )
    tried = _tried(inputs.extractions)

    def work(due: DataFrame):
        read = due.select("id", "attempts").join(tried, ["id", "attempts"]).filter(F.col("error_class").isNull() & ~kind.eqNullSafe("other"))
        extracted = desk.keep("extracted", read.select("id", "document_kind"))
        fields = inputs.fields.join(extracted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        pages_of = desk.read("documents", "id").join(extracted, "id", "left_semi").select(F.col("id").alias("doc_id"), "pages")
        return _joined(due, tried, outcome, ["id", "attempts"]), {"extractions": extracted, "fields": verify.verified(spread(fields, "doc_id"), spread(pages_of, "doc_id"))}

    return Step(4, "extract", "loaded", "extracted", ("extractions", "fields"), work)


def enrich(inputs: Inputs, fields: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enrichments (id, counterparty_id, counterparty_score, matched_on, category) and findings of the checks, of the documents named."""
    said = lambda name: F.max(F.when(F.col("name") == name, F.col("v_text")))
    asked = fields.groupBy("doc_id").agg(said("counterparty_name").alias("name"), said("counterparty_registration_id").alias("registration_id"))
    asked = ids.join(asked, ids["id"] == asked["doc_id"], "left").select(F.col("id").alias("query_id"), "name", "registration_id")
    matched = resolve.resolve(asked, inputs.registry, k=1)
    known = matched.join(inputs.registry.select(F.col("id").alias("vendor_id"), "category"), "vendor_id", "left")
    enrichments = known.select(F.col("query_id").alias("id"), F.col("vendor_id").alias("counterparty_id"), F.col("score").alias("counterparty_score"), "matched_on", "category")
    return enrichments, checks.findings(fields, enrichments.select(F.col("id").alias("doc_id"), "category"), inputs.policy)


def enrich_step(inputs: Inputs, desk: Desk) -> Step:
    """extracted to enriched: the counterparty, the checks, and an agent for documents that no check found anything in.

    For those a run of the agent must be recorded, also one that found nothing: without it the stage fails and is tried again, so that
    no document is filed that nobody looked at. The agent's errors follow their class. The note says how many findings came from where."""
    tried = _tried(inputs.agent_runs)
    n, own = F.coalesce("n", F.lit(0)), F.coalesce("own", F.lit(0))
    note = F.format_string("%d findings: %d from checks, %d from the agent", n, own, n - own)
    outcome = (
        F.when(own > 0, _outcome("advanced", note=note))
        .when(F.col("ran").isNull(), failure(F.lit("NoAgentRun"), F.lit("no call is recorded"), ""))
        .when(F.col("error_class").isNotNull(), failure(F.col("error_class"), F.col("message"), "the model declined to review this"))
        .otherwise(_outcome("advanced", note=note))
    )

    def work(due: DataFrame):
        ids = due.select("id")
        enrichments, rules_found = enrich(inputs, desk.read("fields", "doc_id").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), ids)
        enrichments, rules_found = desk.keep("enriched", enrichments), desk.keep("found", rules_found)
        agents = inputs.agents.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        findings = checks.recorded(rules_found, agents)
        counts = findings.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("source") == "rules", 1)).alias("own"))
        seen = due.select("id", "attempts").join(counts, "id", "left").join(tried.withColumn("ran", F.lit(True)), ["id", "attempts"], "left").drop("attempts")
        return _joined(due, seen, outcome), {"enrichments": enrichments, "findings": findings}

    return Step(5, "enrich", "extracted", "enriched", ("enrichments", "findings"), work)


def decide(registry: DataFrame, extractions: DataFrame, fields: DataFrame, enrichments: DataFrame, findings: DataFrame) -> DataFrame:
    """id, counterparty_id, reasons, route, blocking_fields and payload of each enriched document. The status of a counterparty is read
    from the registry anew."""
    has_value = F.coalesce(F.col("v_text"), F.col("v_num").cast("string"), F.col("v_bool").cast("string")).isNotNull()
    shown = F.coalesce(F.col("v_text"), checks.shown(F.col("v_num")), F.col("v_bool").cast("string"))
    each = fields.withColumns({"has_value": has_value, "shown": shown})
    own = each.groupBy(F.col("doc_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("name", "has_value", "confidence", "prov_status"))).alias("fields"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "shown")))).alias("payload"),
    )
    found = findings.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "severity", "field", "citation", "explanation"))).alias("findings"))
    status = registry.select(F.col("id").alias("counterparty_id"), F.col("status").alias("counterparty_status"))
    evidence = enrichments.join(status, "counterparty_id", "left").join(extractions, "id")
    evidence = evidence.join(own, "id", "left").join(found, "id", "left")
    evidence = evidence.withColumns(
        {
            "fields": F.coalesce("fields", F.array().cast("array<struct<name:string,has_value:boolean,confidence:double,prov_status:string>>")),
            "findings": F.coalesce("findings", F.array().cast("array<struct<ordinal:int,severity:string,field:string,citation:string,explanation:string>>")),
            "payload": F.coalesce("payload", F.create_map().cast("map<string,string>")),
        }
    )
    return rules.decide(evidence).select("id", "counterparty_id", "reasons", "route", "blocking_fields", "payload")


def decide_step(inputs: Inputs, desk: Desk) -> Step:
    """enriched to decided, by the rules."""
    first = F.coalesce(F.try_element_at("reasons", F.lit(1))["rule"], F.lit("no rule"))
    note = F.format_string("%s: %d reasons, first %s", F.col("route"), F.size("reasons"), first)

    def work(due: DataFrame):
        ids = due.select("id")
        docs = ids.withColumnRenamed("id", "doc_id")
        by_id = lambda name: desk.read(name, "id").join(ids, "id", "left_semi")
        by_doc = lambda name: desk.read(name, "doc_id").join(docs, "doc_id", "left_semi")
        made = decide(inputs.registry, by_id("extractions"), by_doc("fields"), by_id("enrichments"), by_doc("findings"))
        decisions = desk.keep("judged", made)
        return _joined(due, decisions, F.when(F.col("_there").isNull(), failure(F.lit("KeyError"), F.lit("no enrichment"), "")).otherwise(_outcome("advanced", note=note))), {"decisions": decisions}

    return Step(6, "decide", "enriched", "decided", ("decisions",), work)


def deliver_step(desk: Desk) -> Step:
    """decided to delivered: filed or queued for a person, once per decision; what the rules rejected ends as rejected."""
    said = F.array_join(F.transform("reasons", lambda r: r["message"]), "; ")
    outcome = F.when(F.col("route") == "rejected", _outcome("rejected", F.concat(F.lit("by rule: "), F.substring(said, 1, 300))))
    outcome = outcome.otherwise(_outcome("advanced", note=F.when(F.col("route") == "auto_approved", "filed").otherwise("queued for review")))

    def work(due: DataFrame):
        decisions = desk.read("decisions", "id").join(due.select("id"), "id", "left_semi")
        made = decisions.withColumnRenamed("id", "decision_id")
        contracts, items = deliver.contracts_to_file(made, desk.delivered("contracts")), deliver.items_to_open(made, desk.delivered("items"))
        return _joined(due, decisions, outcome), {"contracts": contracts, "items": items}

    return Step(7, "deliver", "decided", "delivered", ("contracts", "items"), work)


def steps(inputs: Inputs, desk: Desk) -> list[Step]:
    return [triage_step(inputs), load_step(inputs, desk), extract_step(inputs, desk), enrich_step(inputs, desk), decide_step(inputs, desk), deliver_step(desk)]


def begin(store: Store, status: DataFrame) -> None:
    """Add attachments (STATUS) that the store doesn't have."""
    store.append_once("status", status, ["id"])


def _book(store: Store, step: Step, calls: DataFrame, due: DataFrame) -> None:
    made = due.join(_tried(calls), ["id", "attempts"]).select("id", F.lit(step.name).alias("stage"), "attempts", "usd")
    store.append_once("ledger", made, ["id", "stage", "attempts"])


def advance(store: Store, inputs: Inputs, place: int, now: Column) -> Drained:
    """The stage at a place of steps() over all documents that wait for it.

    What it spends is booked first (table ledger: id, stage, attempts, usd, each once), since it stays spent if the stage fails. The
    rest is one transaction: rows of documents that advanced, letters of those that died, and the states of all that were due. If anything
    fails on the way the store's tables are as they were, and the same call does the same work again. A stage that nothing waits for
    writes no more than its empty tables, once."""
    own = Transaction(store)
    step = steps(inputs, Desk(own))[place]
    due = runnable(store.read("status", "id"), now, [step.consumes])
    if due.isEmpty() and {*step.tables, "letters"} <= own.entries.keys():
        return Drained(0, 0)
    calls = {"extract": inputs.extractions, "enrich": inputs.agent_runs}.get(step.name)
    if calls is not None:
        _book(store, step, calls, due)
    with store.transaction() as own:
        step = steps(inputs, Desk(own))[place]
        status = store.read("status", "id", own.version)
        judged, tables = step.work(runnable(status, now, [step.consumes]))
        after = own.keep("after", moved(judged, step.produces, now))
        advanced = after.filter("outcome.tag = 'advanced'").select("id")
        for name, rows in tables.items():
            key = next(c for c in ("doc_id", "decision_id", "id") if c in rows.columns)
            own.append(name, rows.join(advanced.withColumnRenamed("id", key), key, "left_semi"))
        own.append("letters", dead_letters(after, step.name))
        own.append("status", after.select(*status.columns))
        return Drained(*after.agg(F.count(F.lit(1)), F.count(F.when(F.col("status").isin(*fixed.TERMINAL), 1))).first())


def process(store: Store, inputs: Inputs, now: Column, until: str = "deliver") -> Drained:
    """All stages in order, to the one named `until`, each over all documents that wait for it then.

    Documents that fail keep their state, with an attempt more and a time to try again, or die and leave a letter. Rows of states
    that no stage takes, or whose time hasn't come, stay as they are; no rows give no rows. A decision that is delivered already isn't
    delivered again."""
    names = [s.name for s in validated(steps(inputs, Desk(Transaction(store))))]
    done = [advance(store, inputs, place, now) for place in range(names.index(until) + 1)]
    return Drained(sum(d.transitions for d in done), sum(d.finished for d in done))


def drain(store: Store, inputs: Inputs, now: Column, steps_at_most: int = fixed.DRAIN_STEPS) -> Drained:
    """process() again and again until no document is due; those that wait stay.

    Whether another round is needed is asked of the states alone. A stage run that moves documents is a step; with documents still due
    after `steps_at_most` of them this is an error, as it means a loop and no backlog."""
    transitions = finished = taken = 0
    due = lambda: not runnable(store.read("status", "id"), now).isEmpty()
    while due():
        for place in range(len(fixed.STATES) - 1):
            if taken >= steps_at_most and due():
                raise RuntimeError(f"documents are due after {taken} steps: they go round, or the backlog needs a larger bound")
            done = advance(store, inputs, place, now)
            taken += done.transitions > 0
            transitions, finished = transitions + done.transitions, finished + done.finished
    return Drained(transitions, finished)
