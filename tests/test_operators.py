import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docgate import fixed
from docgate.operators import checks, deliver, evaluate, intake, ledger, pages, resolve, retrieval, review, rules, traces, triage, verify
from docgate.plans import batch
from docgate.plans.store import Store
from docgate.queries import QUERIES
from docgate.sources import mail
from tests.test_functions import ratio


def test_file_kinds(spark):
    heads = [b"%PDF-1.7\n", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"PK\x03\x04..word/document.xml", b"PK\x03\x04", b"II*\x00", b"MZ", b"", None]
    rows = spark.createDataFrame([(i, bytearray(h) if h is not None else None) for i, h in enumerate(heads)], "i int, c binary")
    kinds = [r.k for r in rows.select("i", intake.file_kind(F.col("c")).alias("k")).orderBy("i").collect()]
    assert kinds == ["pdf", "png", "jpeg", "office", "zip", "tiff", "unknown", "unknown", "unknown"]
    names = spark.createDataFrame([("a.PDF",), ("a.tar.gz",), ("a",), ("a.toolongext",), (".hidden",)], "n string")
    assert [r[0] for r in names.select(intake.suffix(F.col("n"))).collect()] == [".pdf", ".gz", "", "", ""]


def test_intake_happens_once(spark):
    schema = "message_id string, received_at int, attachments array<struct<filename:string,content:binary,declared_mime:string>>"
    file = lambda name, data: (name, bytearray(data), "x/y")
    rows = spark.createDataFrame([("a", 1, [file("1.pdf", b"one"), file("2", b"two")]), ("a", 1, [file("1.pdf", b"one")]), ("b", 2, [file("x.PDF", b"one")]), ("c", 3, [])], schema)
    seen = spark.createDataFrame([("z",)], "message_id string")
    new = intake.new_messages(rows, seen)
    assert sorted(r.message_id for r in new.collect()) == ["a", "b"]
    none = spark.createDataFrame([], "sha256 string")
    got = intake.new_attachments(rows, none).collect()
    assert sorted((r.message_id, r.filename, r.size_bytes) for r in got) == [("a", "1.pdf", 3), ("a", "2", 3)]
    again = intake.new_attachments(rows, spark.createDataFrame([(r.sha256,) for r in got], "sha256 string"))
    assert again.count() == 0


def test_classification(spark):
    cases = [
        ("SUPPLY AGREEMENT\nThis agreement is made by the supplier; governing law applies.", "contract"),
        ("INVOICE\nInvoice 7, amount due 5, VAT included", "invoice"),
        ("An agreement", "unknown"),
        ("", "unknown"),
        ("Certificate of Registration\nthe parties agree, whereas, governing law", "unknown"),
        ("Договор\nНастоящият договор се сключи; страните и доставчик", "contract"),
        ("Vertrag\nDieser Vertrag wird geschlossen zwischen den Parteien", "contract"),
        ("Contrato\nEl presente contrato: las partes acuerdan", "contract"),
        ("LE CONTRAT\nLe present contrat, les parties conviennent", "contract"),
        ("AVIS DE MARCHE\nle présent contrat, les parties conviennent", "unknown"),
        ("Supply agreement\nwhereas the supplier gives a certificate of insurance", "contract"),
    ]
    rows = triage.classify(spark.createDataFrame(cases, "text string, want string")).collect()
    assert [r.text for r in rows if r.kind != r.want] == []


def test_titles(spark):
    line = "x" * (fixed.TITLE_CHARS - len("Déclaration"))
    cases = [
        ("\u2028 \x1c\r\n\t\nDéclaration of\nan agreement", "its title says declaration of"), ("\n" * 300_000 + "Bescheinigung", "its title says bescheinigung"),
        (line + "Déclaration", "its title says declaration"), (line + "x" + "Déclaration", "0 markers, 0 supporting, 0 invoice terms"),
        ("a\nBescheinigung", "0 markers, 0 supporting, 0 invoice terms"), (" " * 300_000, "0 markers, 0 supporting, 0 invoice terms"), (None, "0 markers, 0 supporting, 0 invoice terms"),
    ]
    classified = triage.classify(spark.createDataFrame(cases, "text string, want string"))
    assert [(r.want, r.evidence) for r in classified.collect() if r.evidence != r.want] == []
    plan = classified.groupBy("kind").count()._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_extract(") == 1  # a text's line is looked for once, not once for every term of a title


def test_triage_order(spark):
    schema = "size_bytes long, file_kind string, encrypted boolean, readable boolean, page_count int, first_page_text string"
    good = "This agreement is entered into; the supplier shall be governed by the clauses."
    cases = [
        ((None, "pdf", False, True, 1, good), "rejected"), ((0, "pdf", False, True, 1, good), "rejected"), ((26 * 2**20, "pdf", False, True, 1, good), "rejected"),
        ((9, "office", None, None, None, None), "rejected"), ((100, "png", None, None, None, None), "rejected"), ((60_000, "png", None, None, None, None), "advanced"),
        ((9, "pdf", True, True, 1, good), "rejected"), ((9, "pdf", False, False, 1, good), "rejected"), ((9, "pdf", False, True, 0, good), "rejected"),
        ((9, "pdf", False, True, 121, good), "rejected"), ((9, "pdf", False, True, 120, good), "advanced"), ((9, "pdf", False, True, 3, "scan"), "advanced"),
        ((9, "pdf", False, True, 3, "x" * 50), "rejected"),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], schema).withColumn("i", F.monotonically_increasing_id())
    got = [r.outcome.tag for r in triage.triage(rows).orderBy("i").collect()]
    assert got == [tag for _, tag in cases]


def test_pages(spark):
    long = "some words that fill a page with enough text to count as one, surely"
    docs = spark.createDataFrame([(1, f"{long}\f\f{long} mail a@b.org"), (2, ""), (3, None)], "doc_id int, text string")
    paged = docs.select("doc_id", pages.split_pages(F.col("text")).alias("pages"))
    got = {r.doc_id: r for r in pages.measured(paged).collect()}
    assert (got[1].page_count, got[1].text_pages, got[1].image_pages) == (3, 2, 1)
    masked = {r.doc_id: r for r in pages.masked(paged).collect()}
    assert masked[1].redactions == {"email": 1} and masked[2].redactions == {} and [p.number for p in masked[1].pages] == [1, 2, 3]
    assert "[EMAIL]" in masked[1].pages[2].text
    usable = {r.doc_id: r.u for r in paged.select("doc_id", pages.usable(F.col("pages")).alias("u")).collect()}
    assert usable == {1: True, 2: False, 3: False}
    assert [b.type for b in paged.filter("doc_id = 1").select(pages.blocks(F.col("pages")).alias("b")).first().b] == ["text", "image", "text"]


REGISTRY = [
    (0, "V1", "Globex Industrial GmbH", ["Globex"], "HRB 84421", "goods", "approved"),
    (1, "V2", "Initech Software Ltd", [], "BG 175.074-752", "it_services", "suspended"),
    (2, "V3", "Umbrella Logistics AD", ["Umbrella"], None, "goods", "approved"),
]


def test_resolution(spark):
    registry = spark.createDataFrame(REGISTRY, "ordinal int, id string, legal_name string, aliases array<string>, registration_id string, category string, status string")
    cases = [
        (("Globex Industrial G.m.b.H.", None), ("V1", "name")), (("industrial globex", None), ("V1", "name")), (("Globx Industrial", None), ("V1", "name")),
        (("Nobody Ever Heard", None), (None, "none")), (("", "HRB84421"), (None, "none")), ((None, None), (None, "none")),
        (("Globex Industrial", "hrb-84421"), ("V1", "registration_id")), (("Umbrella Logistics", "HRB 84421"), (None, "conflict")),
        (("Initech Software", "unknown 1"), ("V2", "name")), (("INITECH software limited", "BG175074752"), ("V2", "registration_id")),
    ]
    asked = spark.createDataFrame([(i, n, r) for i, ((n, r), _) in enumerate(cases)], "query_id int, name string, registration_id string")
    got = {r.query_id: r for r in resolve.resolve(asked, registry).collect()}
    assert [(got[i].vendor_id, got[i].matched_on) for i in range(len(cases))] == [want for _, want in cases]
    assert got[3].score < 0.85 and len(got[3].runners_up) == 2 and got[6].score == 1.0


def test_top_three_against_plain_code(spark):
    from docgate.functions.similarity import token_sort_ratio
    from tests.test_queries import SMALL

    nation, part = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("nation", "part"))
    registry = nation.select(F.col("n_nationkey").cast("int").alias("ordinal"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("legal_name"), F.array().cast("array<string>").alias("aliases"))
    asked = nation.select(F.col("n_nationkey").alias("query_id"), F.array_join(F.reverse(F.split("n_name", " ")), " ").alias("name"))
    names = [r.n_name for r in spark.read.parquet(f"{SMALL}/nation.parquet").orderBy("n_nationkey").collect()]
    got = {(r.query_id, r["rank"]): (r.vendor_id, r.score) for r in resolve.names_against_registry(asked, registry).collect()}
    form = lambda n: n.lower()  # noqa: E731  no punctuation or legal forms in these names
    for i, name in enumerate(names):
        scored = sorted(((-ratio(form(" ".join(reversed(name.split(" ")))), form(n)), j) for j, n in enumerate(names)))[:3]
        for place, (score, j) in enumerate(scored, 1):
            assert got[i, place] == (str(j), pytest.approx(-score / 100, abs=1e-6))
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    other = F.concat(F.array_join(F.reverse(F.split("p_name", " ")), " "), F.lit("x"))
    for r in part.select("p_partkey", token_sort_ratio(F.col("p_name"), other).alias("ratio")).collect():
        name = parts[r.p_partkey]
        assert r.ratio == pytest.approx(ratio(name, " ".join(reversed(name.split(" "))) + "x"), abs=1e-6)


def fields(spark, rows):
    full = [(d, n, *(v.get(k) for k in ("v_text", "v_num", "v_bool", "currency", "confidence", "source_quote", "page", "prov_status"))) for d, n, v in rows]
    return spark.createDataFrame(full, checks.FIELDS)


GOOD = {
    "payment_terms_days": {"v_num": 60.0}, "term_months": {"v_num": 24.0}, "auto_renewal": {"v_bool": False}, "termination_notice_days": {"v_num": 30.0},
    "liability_cap": {"v_num": 500000.0, "currency": "eur"}, "governing_law": {"v_text": "German law"}, "dpa_present": {"v_bool": True},
    "effective_date": {"v_text": "2024-01-01"}, "liability_uncapped": {"v_bool": False}, "counterparty_name": {"v_text": "Globex"},
}


def test_checks(spark):
    cases = [
        ({}, "goods", set()), ({"payment_terms_days": {"v_num": 45.0}}, "goods", set()), ({"payment_terms_days": {"v_num": 90.0}}, "goods", set()),
        ({"payment_terms_days": {"v_num": 91.0}}, "goods", {"§1.1"}), ({"payment_terms_days": {"v_num": float("nan")}}, "goods", {"§1.1"}), ({"payment_terms_days": {}}, "goods", {"§1.1"}),
        ({"auto_renewal": {"v_bool": True}}, "goods", {"§2.2"}), ({"auto_renewal": {}}, "goods", set()), ({"termination_notice_days": {}}, "goods", {"§2.3"}),
        ({"liability_cap": {}}, "goods", {"§3.2"}), ({"liability_cap": {"v_num": 1.0, "currency": "JPY"}}, "goods", {"§3.1", "§1.2"}), ({"liability_cap": {"v_num": 250000.0}}, "goods", {"§1.2"}),
        ({"governing_law": {"v_text": "New South Wales, Australia"}}, "goods", {"§4.1"}), ({"governing_law": {"v_text": "the laws of England and Wales"}}, "goods", set()),
        ({"governing_law": {"v_text": "Cayman Islands"}}, "goods", {"§4.1"}), ({"dpa_present": {"v_bool": False}}, "it_services", {"§5.1"}), ({"dpa_present": {"v_bool": False}}, None, set()),
        ({"liability_uncapped": {"v_bool": True}}, "goods", {"§3.2"}), ({"effective_date": {}}, "goods", {"§2.1"}),
    ]
    rows = fields(spark, [(i, n, v) for i, (change, _, _) in enumerate(cases) for n, v in (GOOD | change).items()])
    vendors = spark.createDataFrame([(i, category) for i, (_, category, _) in enumerate(cases)], "doc_id long, category string")
    got = {i: set() for i in range(len(cases))}
    for r in checks.findings(rows, vendors, checks.load_checks(spark)).collect():
        got[r.doc_id].add(r.citation)
    assert got == {i: found for i, (_, _, found) in enumerate(cases)}


def test_unknown_operators_fail_early(spark):
    with pytest.raises(ValueError, match="unknown operator"):
        checks.load_checks(spark, [{"id": "x", "op": "equal"}])
    assert checks.cited_sections(checks.load_checks(spark)).count() == len({c["section"] for c in fixed.CHECKS})


PAGES = "1: This Agreement is governed by the laws of Germany and lasts 24 months.\nPayment is due within 60 days of receipt.\fan image\f3: Globex Industrial GmbH, HRB 84421, signs on 1 April 2024 in Sofia with all due care."


def test_verification(spark):
    cases = [
        ("payment_terms_days", {"v_num": 60.0, "source_quote": "Payment is due within 60 days", "page": 1}, "verified"),
        ("payment_terms_days", {"v_num": 60.0, "source_quote": "payment  is due\nWITHIN 60 days", "page": 3}, "verified"),
        ("payment_terms_days", {"v_num": 45.0, "source_quote": "Payment is due within 60 days", "page": 1}, "not_found"),
        ("payment_terms_days", {"v_num": 60.0, "source_quote": "Payment is owed within 60 days", "page": 1}, "not_found"),
        ("payment_terms_days", {"v_num": 60.0, "source_quote": "60 days", "page": 1}, "not_found"),
        ("payment_terms_days", {"v_num": 60.0, "page": 1}, "not_found"),
        ("payment_terms_days", {"page": 1}, "absent"),
        ("payment_terms_days", {"v_num": 60.0, "source_quote": "made up words with 60 in them", "page": 2}, "unverifiable"),
        ("payment_terms_days", {"v_num": 60.0, "source_quote": "made up words with 60 in them", "page": 9}, "not_found"),
        ("payment_terms_days", {"v_num": 60.0, "source_quote": "Payment is due within 60 days", "page": 9}, "verified"),
        ("governing_law", {"v_text": "Germany", "source_quote": "governed by the laws of Germany", "page": 1}, "verified"),
        ("governing_law", {"v_text": "France", "source_quote": "governed by the laws of Germany", "page": 1}, "not_found"),
        ("effective_date", {"v_text": "2024-04-01", "source_quote": "signs on 1 April 2024", "page": 3}, "verified"),
        ("effective_date", {"v_text": "2023-04-01", "source_quote": "signs on 1 April 2024", "page": 3}, "not_found"),
        ("counterparty_registration_id", {"v_text": "HRB84421", "source_quote": "GmbH, HRB 84421, signs", "page": 3}, "verified"),
        ("auto_renewal", {"v_bool": False, "source_quote": "lasts 24 months.\nPayment", "page": 1}, "verified"),
        ("signatories", {"v_text": "A. Person", "source_quote": "with all due care.", "page": 3}, "verified"),
    ]
    docs = spark.createDataFrame([(i, PAGES) for i in range(len(cases))], "doc_id long, text string")
    docs = docs.select("doc_id", pages.split_pages(F.col("text")).alias("pages"))
    rows = verify.verified(fields(spark, [(i, name, {"confidence": 0.9} | value) for i, (name, value, _) in enumerate(cases)]), docs).collect()
    got = {r.doc_id: (r.prov_status, r.confidence) for r in rows}
    assert got == {i: (status, 0.9 if status in ("verified", "unverifiable") else 0.0) for i, (_, _, status) in enumerate(cases)}


def test_provenance_counts_and_documents_without_text(spark):
    docs = spark.createDataFrame([(1, "short")], "doc_id long, text string").select("doc_id", pages.split_pages(F.col("text")).alias("pages"))
    rows = fields(spark, [(1, "signatories", {"v_text": "x", "source_quote": "some long quote here", "page": 1}), (1, "customer_name", {})])
    got = verify.verified(rows, docs)
    assert tuple(verify.provenance_counts(got).first())[1:] == (0, 1, 0, 1)
    assert verify.verdict_lists(got).first().hallucinated == []


def evidence(spark, changes):
    base = {
        "document_kind": "contract", "counterparty_id": "V1", "counterparty_score": 1.0, "counterparty_status": "approved", "findings": [],
        "fields": [(n, True, 0.95, "verified") for n in fixed.DECISION_BEARING],
    }
    schema = (
        "doc_id int, document_kind string, counterparty_id string, counterparty_score double, counterparty_status string, "
        "findings array<struct<severity:string,field:string,citation:string,explanation:string>>, "
        "fields array<struct<name:string,has_value:boolean,confidence:double,prov_status:string>>"
    )
    rows = [(i, *(base | change).values()) for i, change in enumerate(changes)]
    return rules.decide(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()


def some(n, has=True, confidence=0.95, status="verified"):
    return [(x, has, confidence, status) if x == n else (x, True, 0.95, "verified") for x in fixed.DECISION_BEARING]


def test_rules(spark):
    cases = [
        ({}, [], "auto_approved"),
        ({"document_kind": "other"}, ["not_a_contract"], "rejected"),
        ({"document_kind": None}, [], "auto_approved"),
        ({"counterparty_id": None}, ["unresolved_counterparty"], "needs_review"),
        ({"counterparty_status": "under_review"}, ["suspended_counterparty"], "needs_review"),
        ({"counterparty_status": None}, ["suspended_counterparty"], "needs_review"),
        ({"findings": [("low", "x", "§1", "e"), (" HIGH ", "y", "§2", "e"), ("severe", None, None, "e"), ("Medium", "z", "§3", "e")]}, ["high_severity_finding", "high_severity_finding", "medium_severity_finding", "low_severity_finding"], "needs_review"),
        ({"fields": some("term_months", has=False, confidence=0.0, status="absent")}, ["missing_required_field"], "needs_review"),
        ({"fields": some("liability_cap", confidence=0.79)}, ["low_confidence_required_field"], "needs_review"),
        ({"fields": some("liability_cap", confidence=0.80)}, [], "auto_approved"),
        ({"fields": some("liability_cap", status="unverifiable")}, ["partially_unverifiable"], "needs_review"),
        ({"fields": some("liability_cap", status="not_found", confidence=0.0)}, ["unsupported_quote", "low_confidence_required_field"], "needs_review"),
        ({"fields": [(n, True, 0.95, "unverifiable") for n in fixed.DECISION_BEARING]}, ["partially_unverifiable", "wholly_unverifiable"], "needs_review"),
        ({"fields": []}, ["missing_required_field"], "needs_review"),
    ]
    for got, (_, found, route) in zip(evidence(spark, [c for c, _, _ in cases]), cases, strict=True):
        assert [r.rule for r in got.reasons] == found and got.route == route
        assert len(set(got.blocking_fields)) == len(got.blocking_fields)


def test_every_rule_has_a_rank():
    text = open(rules.__file__, encoding="utf-8").read()
    for rule in fixed.REASON_RANK:
        assert rule in text or rule.endswith("_severity_finding")


def test_order_of_reasons_and_findings(spark):
    reasons = [("low_severity_finding", "b", "", []), ("not_a_contract", "z", "", []), ("low_severity_finding", "a", "", []), ("new_rule", "m", "", [])]
    df = spark.createDataFrame([(reasons,)], f"r array<{rules.REASON}>").select(rules.by_weight(F.col("r")).alias("r"))
    assert [(x.rule, x.message) for x in df.first().r] == [("not_a_contract", "z"), ("new_rule", "m"), ("low_severity_finding", "a"), ("low_severity_finding", "b")]
    found = spark.createDataFrame([([("low", "1"), ("odd", "2"), ("high", "3"), ("low", "4")],)], "f array<struct<severity:string,field:string>>")
    assert [x.field for x in found.select(rules.findings_by_severity(F.col("f")).alias("f")).first().f] == ["3", "1", "4", "2"]


def test_concerns(spark):
    reasons = [
        ("a", "governing_law: offshore", "§4.1", ["governing_law"]), ("b", "Governing law: offshore", "§4.1", ["governing_law"]), ("c", "too many", "", ["a", "b", "c"]),
        ("d", "weak", "§1", ["governing_law", "term_months"]),
    ]
    df = spark.createDataFrame([(1, reasons)], f"doc_id int, reasons array<{rules.REASON}>")
    got = {r.field: r for r in review.concerns(df).collect()}
    assert got["governing_law"].lines == ["offshore", "weak"] and got["governing_law"].citations == ["§4.1", "§1"]
    assert got[None].label == "This document" and got[None].lines == ["too many"] and got["term_months"].label == "Initial term"


def test_review_chain_and_dashboard(spark):
    make = spark.createDataFrame
    tables = {
        "emails": make([(1, "s")], "id int, subject string"),
        "attachments": make([(2, 1, "delivered")], "id int, email_id int, status string"),
        "documents": make([(3, 2)], "id int, attachment_id int"),
        "extractions": make([(4, 3)], "id int, document_id int"),
        "enrichments": make([(5, 4)], "id int, extraction_id int"),
        "decisions": make([(6, 5, [("low_severity_finding", "m", "", []), ("unsupported_quote", "q", "", [])])], f"id int, enrichment_id int, reasons array<{rules.REASON}>"),
    }
    items = make([(7, 6, "open"), (8, 6, "approved")], "id int, decision_id int, state string")
    got = review.queue(items, tables).collect()
    assert [(r.id, r.subject, r.top_reason.rule) for r in got] == [(7, "s", "unsupported_quote")]
    assert [r.id for r in review.queue(items, tables, "all").collect()] == [8, 7]
    calls = make([(2, 0.5)], "attachment_id int, usd double")
    whole = review.detail(items, tables, calls).filter("id = 7").first()
    assert whole.usd == 0.5 and [r.rule for r in whole.reasons] == ["unsupported_quote", "low_severity_finding"]
    marks = make([(1, "unverifiable"), (1, "unverifiable"), (2, "verified")], "doc_id int, prov_status string")
    row = review.dashboard(items, make([(1,)], "id int"), calls, tables["attachments"], marks).first()
    assert (row.open, row.filed, row.usd, row.usd_each, row.unverifiable) == (1, 1, 0.5, 0.5, 1)


def test_delivery_happens_once(spark):
    make = spark.createDataFrame
    decisions = make([(1, "auto_approved", "V1", {"a": "1", "_x": "h"}), (1, "auto_approved", "V1", {"a": "1"}), (2, "needs_review", None, {"a": "2", "b": "3"})], "decision_id int, route string, counterparty_id string, payload map<string,string>")
    none = make([], "decision_id int")
    filed = deliver.contracts_to_file(decisions, none)
    assert [r.payload for r in filed.collect()] in ([{"a": "1"}],) and deliver.contracts_to_file(decisions, filed).count() == 0
    items = deliver.items_to_open(decisions, none).selectExpr("*", "cast(null as map<string,string>) human_corrections", "cast(null as string) resolved_by", "cast(null as int) resolved_at")
    actions = make([(2, "approve", {"b": "9"}, "me", 5)], "decision_id int, action string, corrections map<string,string>, resolved_by string, resolved_at int")
    done = deliver.resolved(items, actions)
    assert done.first().state == "approved"
    again = deliver.resolved(done, make([(2, "reject", {"b": "0"}, "you", 6)], actions.schema))
    assert again.first().state == "approved"
    contract = deliver.promoted(done, decisions, filed).first()
    assert contract.payload == {"a": "2", "b": "9", "_approved_by_human": "true"}
    view = deliver.contract_view(deliver.promoted(done, decisions, filed)).first()
    assert view.approved_by_human and view.payload == {"a": "2", "b": "9"}


def test_corrections(spark):
    forms = spark.createDataFrame([(1, {"field:a": " x ", "field:b": "new", "field:c": "?", "action": "approve"})], "doc_id int, form map<string,string>")
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", None)], "doc_id int, name string, v_text string")
    assert [(r.name, r.corrected) for r in review.corrections(forms, old).collect()] == [("b", "new")]


def test_retrieval(spark, tmp_path):
    clauses = spark.createDataFrame([("§1", "t", "b", [0.0, 0.0]), ("§2", "t", "b", [1.0, 0.0]), ("§3", "t", "b", [5.0, 5.0])], "section string, title string, body string, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.9, 0.0])], "query_id int, embedding array<double>")
    got = retrieval.search(asked, clauses, 2).orderBy("rank").collect()
    assert [r.section for r in got] == ["§2", "§1"] and got[0].score == pytest.approx(1 / 1.01)
    assert retrieval.with_text(retrieval.search(asked, clauses, 9), clauses).count() == 3
    for _ in range(2):
        retrieval.build(clauses.unionByName(clauses), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3


def test_ledger_edges(spark):
    calls = spark.createDataFrame([(1, 1, "m", 10, None, 0, 0, 0.4), (2, 1, "m", 0, 5, 0, 0, 0.4), (3, 1, "m", 0, 0, 0, 0, 0.1)], "id int, attachment_id int, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, usd double")
    assert [r.allowed for r in ledger.within_budget(calls, 0.75).orderBy("id").collect()] == [True, True, False]
    rates = spark.createDataFrame([("other", 1.0, 1.0)], "model string, input_rate double, output_rate double")
    with pytest.raises(Exception, match="no rates for model"):
        ledger.priced(calls, rates).collect()
    none = spark.createDataFrame([], "id int, status string")
    row = ledger.totals(calls, none).first()
    assert row.delivered == 0 and row.usd_each is None


def test_ledger_on_disk(spark, tmp_path):
    calls = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, purpose string, usd double")
    for _ in range(2):
        ledger.append(calls, str(tmp_path / "ledger"))
    again = spark.read.parquet(str(tmp_path / "ledger"))
    assert again.count() == 4 and ledger.newest(again).first().id == 2
    assert {r.purpose: r.calls for r in again.groupBy("purpose").agg(F.count("*").alias("calls")).collect()} == {"a": 2, "b": 2}


def test_review_request(spark):
    rows = fields(spark, [(1, "term_months", {"v_num": 24.0, "page": 2, "source_quote": "q" * 500}), (1, "customer_name", {})])
    lines = review.request(rows).first().request.split("\n")
    assert lines[0] == "Our side: not stated" and lines[1].startswith('Initial term: 24.0 (page 2) "qqq') and len(lines[1]) < 200


def test_evaluation(spark):
    want = fields(spark, [(1, "term_months", {"v_num": 24.0}), (1, "governing_law", {"v_text": "Germany"}), (1, "auto_renewal", {"v_bool": False}), (1, "customer_name", {})])
    got = fields(spark, [(1, "term_months", {"v_num": 24.005}), (1, "governing_law", {"v_text": "laws of GERMANY"}), (1, "auto_renewal", {})])
    judged = evaluate.judged_fields(want, got)
    assert {r.name: r.correct for r in judged.collect()} == {"term_months": True, "governing_law": True, "auto_renewal": False, "customer_name": True}
    assert evaluate.accuracy(judged, ["doc_id"]).first().accuracy == 0.75
    assert evaluate.schema_difference(want, got.drop("page").schema) == {"missing": [], "extra": ["page"], "changed": []}
    assert evaluate.repeated_keys(want.unionByName(want), ["doc_id", "name"]).count() == 4


def _stage(number, name, a, b, outcome=None):
    made = outcome if outcome is not None else F.expr("named_struct('tag','advanced','note','','reason',cast(null as string),'error_class','','retryable',true)")
    return batch.Stage(number, name, a, b, lambda rows: rows.withColumn("outcome", made))


def test_chains_of_stages():
    batch.validated([_s(1, "a", "received", "triaged"), _s(2, "b", "triaged", "delivered")])
    for bad in ([], [_s(1, "a", "received", "triaged")], [_s(1, "a", "received", "x"), _s(2, "b", "y", "delivered")], [_s(2, "a", "received", "x"), _s(1, "b", "x", "dead")]):
        with pytest.raises(ValueError):
            batch.validated(bad)


def _s(number, name, a, b):
    return batch.Stage(number, name, a, b, lambda rows: rows)


def test_state_transitions(spark):
    schema = "id int, status string, status_reason string, attempts int, retry_after timestamp, updated_at timestamp"
    rows = spark.createDataFrame([(i, "received", None, a, None, None) for i, a in ((1, 0), (2, 2), (3, 0), (4, 3))], schema)
    now = F.to_timestamp(F.lit("2024-01-01"))
    fails = F.expr("named_struct('tag', if(id = 1, 'advanced', 'failed'), 'note', 'n', 'reason', cast(null as string), 'error_class', 'E', 'retryable', true)")
    after, letters = batch.run_stage(rows, _stage(2, "triage", "received", "triaged", fails), now)
    got = {r.id: r for r in after.collect()}
    assert {i: r.status for i, r in got.items()} == {1: "triaged", 2: "dead", 3: "received", 4: "received"}
    assert got[3].attempts == 1 and (got[3].retry_after - got[3].updated_at).total_seconds() == 30
    assert [r.id for r in letters.collect()] == [2]
    assert batch.revived(after, letters, {"triage": "received"}).filter("status = 'dead'").count() == 0
    assert tuple(batch.drained(rows, after).first()) == (2, 1)
    done = batch.run_all(rows.filter("id = 1"), [_stage(1, "a", "received", "triaged"), _stage(2, "b", "triaged", "delivered")], now)
    assert done.first().status == "delivered"
    assert batch.replay(after, spark.createDataFrame([(2,)], "id int"), _stage(2, "t", "received", "triaged"), now).count() == 0
    assert batch.replay(after, spark.createDataFrame([(2,)], "id int"), _stage(2, "t", "received", "triaged"), now, force=True).count() == 1


def test_sums_of_batches_in_any_order_and_twice(spark, tmp_path):
    """A batch counts once, also where its writer died before the commit."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0.1, 0.25, None]), i, None, 3, 1) for i in range(60)]
    calls = spark.createDataFrame(rows, "id long, purpose string, usd double, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    store, seen = Store(spark, str(tmp_path)), []

    def crash(step):
        seen.append(step)
        if step == "rename" and seen.count(step) == 1:
            raise InterruptedError(step)

    part = lambda b: calls.filter(F.col("id") % 3 == b)
    with pytest.raises(InterruptedError):
        ledger.add_batch(Store(spark, str(tmp_path), crash), part(1), 1)
    assert [ledger.add_batch(store, part(b), b) for b in (1, 0, 1, 2, 0)] == [True, True, False, True, False]
    whole = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert whole(ledger.kept_by_purpose(store)) == whole(ledger.by_purpose(calls))


def test_contents_under_one_name(spark, tmp_path):
    files = spark.createDataFrame([("x", b"b"), ("x", b"a"), (None, b"c"), ("y", b"")], "filename string, content binary")
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        intake.store(files, folder, named=True)
        path = tmp_path / folder.rpartition("/")[2]
        kept = min((b"a", b"b"), key=lambda c: hashlib.sha256(c).hexdigest())
        assert {p.name: p.read_bytes() for p in path.iterdir() if not p.name.startswith(".")} == {"x": kept, "y": b""}
    with pytest.raises(Exception):
        intake.store(files, "nosuch://host/folder")


TRACE = """[{"tool": "record_finding", "input": {"citation": "§1", "kind": "k"}, "output": {"recorded": true}},
  {"tool": "search_policy", "input": {"question": "q"}, "output": [{"section": "§1", "score": 0.4}, {"section": "§2"}]},
  {"tool": "record_finding", "input": {"citation": "§2", "severity": "low"}, "output": null}, {"input": 3},
  {"tool": "record_finding", "input": {"citation": "§9"}}]"""


def test_traces(spark):
    rows = spark.createDataFrame([(1, TRACE), (2, "[]"), (3, None), (4, "no json"), (5, '{"tool": "x"}'), (6, '[{"tool": "resolve_counterparty", "input": {"name": "n"}}]')], "id long, trace string")
    made = {(r.id, r.place): r.tool for r in traces.calls(rows).select("id", "place", "tool").collect()}
    assert made == {(1, 0): "record_finding", (1, 1): "search_policy", (1, 2): "record_finding", (1, 3): None, (1, 4): "record_finding", (6, 0): "resolve_counterparty"}
    found = [(r.place, r.citation, r.severity, r.looked_up, r.seen) for r in traces.found(traces.calls(rows)).orderBy("place").collect()]
    assert found == [(0, "§1", None, False, False), (2, "§2", "low", True, True), (4, "§9", None, True, False)]
    said = {r.id: tuple(r)[1:] for r in traces.summary(rows).collect()}
    assert said == {1: (True, True, 5, 3, 1), 6: (True, True, 1, 0, 0)} | dict.fromkeys((2, 3, 4, 5), (False, False, 0, 0, 0))


def test_a_playbook_is_searched_without_moving_queries(spark, monkeypatch):
    said = ["pay in days", "the law of the land and the law of the sea", "the pay", "Ä", "", "law law", "nothing alike"]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate([*said, None, "the pay in the land, the law", "zzz zzz the"])], "query_id long, text string")
    clauses = spark.createDataFrame([(f"s{i}", "", t) for i, t in enumerate(said)], "section string, title string, body string")
    got = lambda q: sorted((r.query_id, r["rank"], r.section, round(r.score, 8)) for r in retrieval.search_text(q, clauses, k=3).collect())
    assert "Exchange" not in retrieval.search_text(queries, clauses, k=3)._jdf.queryExecution().toString()
    twice = queries.unionByName(queries.filter("query_id in (0, 8)")).unionByName(spark.createDataFrame([(1, "pay pay")], queries.schema))
    whole, again = got(queries), got(twice)
    monkeypatch.setattr(retrieval, "PRODUCTS", 2)
    assert got(queries) == whole
    monkeypatch.setattr(retrieval, "PLAYBOOK_BYTES", -1)  # joined by terms
    assert got(queries) == whole and got(twice) == again and len(whole) == 30


def test_a_folder_is_listed_by_a_task(spark, tmp_path, monkeypatch):
    """The driver plans no task for every few files, and a file that is being written or was left isn't seen."""
    files = spark.createDataFrame([(f"{i}.eml" if i % 2 else f"{i}", bytes([i]) * (i * 30)) for i in range(90)], "filename string, content binary")
    folder = f"file://{tmp_path}/many"
    for _ in range(2):
        intake.store(files, folder, named=True)
    intake.store(spark.createDataFrame([("z.gz", b"zip")], files.schema), folder, named=True)
    assert (tmp_path / "many" / "z.gz").read_bytes() == b"zip" and not [p for p in (tmp_path / "many").iterdir() if p.is_dir()]
    (tmp_path / "many" / "z.gz").unlink()
    (tmp_path / "many" / ".left").mkdir()
    (tmp_path / "many" / "_part").write_bytes(b"x")
    monkeypatch.setattr(intake, "NAMES", 7)
    assert {r["name"]: r["size"] for r in intake.stored(spark, folder).collect()} == {f"{i}.eml" if i % 2 else f"{i}": i * 30 for i in range(90)}
    heads = {r.path.rpartition("/")[2]: bytes(r["head"]) for r in intake.read_heads(spark, folder).collect()}
    assert len(heads) == 90 and heads["80"] == bytes([80]) * fixed.HEAD_BYTES and heads["0"] == b""
    assert [tuple(r) for r in mail.probe(spark, folder).collect()] == [("many", 45)]
    for found in (intake.stored(spark, folder), intake.read_heads(spark, folder)):
        assert "binaryFile" not in found._jdf.queryExecution().toString()
    (tmp_path / "none").mkdir()
    assert intake.stored(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["threshold_findings", "cited_sections"])
def test_documents_are_judged_once_and_on_all_cores(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Repartition" in plan
    assert checks.each_finding(spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "doc_id long, findings array<string>"), "doc_id").count() == 2


def test_an_insert_deals_rows_before_it_sorts_them(spark):
    rows = spark.createDataFrame([(i % 7, f"v{i % 3}") for i in range(60)] + [(None, "n"), (None, "m")], "id long, v string")
    seen = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    new = intake.not_seen(rows, seen, ["id"], [F.col("v")])
    assert sorted(map(str, new.collect())) == sorted(f"Row(id={i}, v='{v}')" for i, v in [(None, "m"), *((k, "v0") for k in (0, 3, 4, 5, 6))])
    plan = new._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("WindowGroupLimit") :]  # the partial one
    assert "REPARTITION_BY_NUM" in below and "HashAggregate" not in plan
