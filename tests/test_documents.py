"""The composed intake, text search, larger registries, and states over a stream."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docgate.functions.similarity import common_length, ratio
from docgate.functions.text import company_form
from docgate.operators import checks, intake, pages, resolve, retrieval
from docgate import queries_documents, queries_messages  # noqa: I001
from docgate.plans import documents
from docgate.plans.store import Store
from docgate.queries_documents import _inputs

SMALL = "/root/testdata/sf0.001"


def states(store):
    return {r.id: (r.status, r.attempts) for r in store.read("status", "id").collect()}


def at(text):
    return F.to_timestamp(F.lit(text))


def test_a_second_pass_delivers_nothing_twice(spark, tmp_path):
    """Delivered documents stay delivered; those that failed are tried again when their time has come."""
    status, inputs = _inputs(spark, SMALL)
    store = Store(spark, str(tmp_path))
    documents.begin(store, status.filter("id < 30"))
    documents.begin(store, status.filter("id < 30"))
    first = documents.process(store, inputs, at("1996-01-01"))
    was = states(store)
    assert len(was) == 30 and was[16] == ("dead", 1) and was[6] == ("rejected", 0) and was[17] == ("extracted", 1)
    delivered = {i for i, (s, _) in was.items() if s == "delivered"}
    ids = lambda name: [r.decision_id for r in store.read(name).collect()]
    assert sorted(ids("contracts") + ids("items")) == sorted(delivered) and first.finished == sum(s in ("delivered", "rejected", "dead") for s, _ in was.values())
    assert documents.process(store, inputs, at("1996-01-01")).transitions == 0
    late = documents.drain(store, inputs, at("1996-01-02"))
    now = states(store)
    assert {i for i in was if was[i] != now[i]} == {4, 14, 17, 24} and now[4] == ("loaded", 2) and now[17] == ("extracted", 2)
    assert late.transitions == 4 and sorted(ids("contracts") + ids("items")) == sorted(delivered)
    booked = store.read("ledger").collect()
    assert len(booked) == len({(r.id, r.stage, r.attempts) for r in booked}) > 0


def test_a_drain_that_goes_on_too_long_fails(spark, tmp_path):
    status, inputs = _inputs(spark, SMALL)
    store = Store(spark, str(tmp_path))
    documents.begin(store, status.filter("id in (8, 9)"))
    with pytest.raises(RuntimeError):
        documents.drain(store, inputs, at("1996-01-01"), steps_at_most=2)
    assert {s for s, _ in states(store).values()} == {"loaded"}
    assert documents.drain(store, inputs, at("1996-01-01"), steps_at_most=4).finished == 2


def test_no_documents(spark, tmp_path):
    status, inputs = _inputs(spark, SMALL)
    store = Store(spark, str(tmp_path))
    documents.begin(store, status.limit(0))
    assert documents.process(store, inputs, at("1996-01-01")) == documents.Drained(0, 0) == documents.drain(store, inputs, at("1996-01-01"))
    assert all(store.read(name).isEmpty() for name in store.tables())


@pytest.mark.parametrize(
    ("error_class", "tag", "retryable"),
    [("RefusalError", "rejected", None), ("BudgetExceededError", "failed", False), ("TruncatedError", "failed", True), ("ImportError", "failed", False), ("TimeoutError", "failed", True)],
)
def test_what_an_error_class_means(spark, error_class, tag, retryable):
    o = spark.range(1).select(documents.failure(F.lit(error_class), F.lit("m"), "declined").alias("o")).first().o
    assert (o.tag, o.retryable) == (tag, retryable) and (o.reason == ("declined: m" if tag == "rejected" else f"{error_class}: m"))


def test_findings_of_an_agent_count_where_checks_found_nothing(spark):
    schema = "doc_id long, kind string, severity string, field string, citation string, explanation string"
    rules = spark.createDataFrame([(1, 0, "k", "low", "f", "c", "e", "rules")], "doc_id long, ordinal int, kind string, severity string, field string, citation string, explanation string, source string")
    agents = spark.createDataFrame([(1, "k", "high", "f", "c", "e"), (2, "k", "high", "f", "c", "b"), (2, "k", "high", "f", "c", "a")], schema)
    rows = sorted((r.doc_id, r.source, r.explanation, r.ordinal) for r in checks.recorded(rules, agents).collect())
    assert rows == [(1, "rules", "e", 0), (2, "agent", "a", checks.AGENT_FROM + 1), (2, "agent", "b", checks.AGENT_FROM + 2)]


def test_more_checks_than_are_read_at_once(spark, monkeypatch):
    policy = checks.load_checks(spark, [{"id": str(i), "section": f"§{i}", "field": f"f{i % 3}", "op": "lte", "limit": float(i), "message": "{value} > {limit}"} for i in range(7)])
    docs = spark.createDataFrame([(1, "f0", 2.0), (1, "f1", 9.0), (1, "f0", 1.0), (2, "f2", 4.5)], "doc_id long, name string, v_num double")
    docs = docs.withColumns({"v_text": F.lit(None).cast("string"), "v_bool": F.lit(None).cast("boolean"), "currency": F.lit(None).cast("string")})
    vendors = spark.createDataFrame([(1, "goods"), (2, None), (3, "goods")], "doc_id long, category string")
    found = lambda: sorted((r.doc_id, r.ordinal, r.explanation) for r in checks.findings(docs, vendors, policy).collect())
    whole = found()
    assert (1, 0, "1 > 0") in whole and (1, 4, "9 > 4") in whole and (2, 2, "4.5 > 2") in whole and not any(r[:2] == (1, 3) for r in whole)
    assert {r[1] for r in whole if r[0] == 3} == set(range(7))
    monkeypatch.setattr(checks, "CHECKS_AT_ONCE", 2)
    assert found() == whole


def test_unknown_operators_of_a_file_fail(spark, tmp_path):
    (tmp_path / "checks.json").write_text('{"checks": [{"id": "a", "section": "1", "field": "f", "op": "about", "message": "m"}]}')
    with pytest.raises(ValueError):
        checks.read_checks(spark, str(tmp_path / "checks.json"))


def test_longest_common_subsequence_against_the_table():
    rng = random.Random(4)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert common_length(a, b) == plain(a, b)


def brute_ranks(names, labels_, k):
    """query -> [(vendor, score)] of all pairs; labels_: (ordinal, id, name) in order, of one form the last one at the place of the first."""
    out = {}
    for i, name in names:
        if name is not None:
            words = lambda t: " ".join(sorted(t.split()))
            out[i] = sorted(((-ratio(words(name), words(label)) / 100, o, v) for o, v, label in labels_))[:k]
    return {i: [(v, round(-s, 9)) for s, _, v in rows] for i, rows in out.items()}


def near_texts(seed, n, names):
    """Names of few syllables and labels made from some of them by a few changed letters."""
    rng = random.Random(seed)
    made = [" ".join("".join(rng.choice(["ba", "lo", "ti", "ré", "sun", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))) + "q" for _ in range(n)]
    labels_ = []
    for name in made:
        letters = list(name)
        for _ in range(rng.randint(0, 3)):
            letters[rng.randrange(len(letters))] = rng.choice("abz")
        labels_.append("".join(letters) + "qq")
    return rng.sample(made, names), sorted(set(labels_))


@pytest.mark.parametrize(("seed", "cell"), [(1, 2000), (2, 14)])
def test_names_by_rare_bigrams_are_those_of_all_pairs(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(resolve, "CELL", cell)
    names, labels_ = near_texts(seed, 150, 60)
    rows = [(i, f"v{i}", x) for i, x in enumerate(labels_)]
    registry = spark.createDataFrame([(*r, None) for r in rows], "ordinal int, id string, legal_name string, aliases array<string>")
    queries = spark.createDataFrame([*enumerate(names), (99, None)], "query_id int, name string")
    form = lambda df, c: [r[0] for r in df.select(company_form(F.col(c))).collect()]
    forms, asked = form(registry, "legal_name"), form(queries.filter("name is not null"), "name")
    labels_ = {}
    for (o, v, _), f in zip(rows, forms, strict=True):
        labels_[f] = (labels_.get(f, (o,))[0], v)
    want = brute_ranks(list(enumerate(asked)), [(o, v, f) for f, (o, v) in labels_.items()], 3)
    got = {}
    for r in resolve.names_against_registry(queries, registry).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vendor_id, round(r.score, 9)))
    assert got == want


@pytest.mark.parametrize("least", [0.85, 0.7, 2 / 3, 1.0])
def test_rare_bigrams_lose_no_pair(spark, least):
    names, labels_ = near_texts(7, 200, 120)
    names += ["", "a", "ab", "ba", "aa", "aaa"]
    labels_ += ["", "a", "b", "ab", "aab", "aaaa"]
    asked, known = (resolve._bigrams(spark.createDataFrame([(x,) for x in set(t)], "words string")) for t in (names, labels_))
    got = {(r.words, r.other): round(r.score, 9) for r in resolve.near_names(asked, known, least).collect()}
    assert got == {(a, b): round(ratio(a, b) / 100, 9) for a in set(names) for b in set(labels_) if ratio(a, b) / 100 >= least}


def test_compared_pairs_grow_less_than_all_pairs(spark, monkeypatch):
    """Of names with words of their own hardly more than the similar pairs are compared."""
    seen = []
    monkeypatch.setattr(resolve, "similarity", lambda a, b: seen.append(1) or F.lit(100.0))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(2)) for _ in range(600)]
    pairs = lambda n: resolve.near_names(*(resolve._bigrams(spark.createDataFrame([(x,) for x in texts[:n]], "words string")),) * 2, 0.85).count()
    assert pairs(600) < 0.25 * 600 * 600 and seen


def test_an_empty_registry_and_no_names(spark):
    registry = spark.createDataFrame([(0, "v", "Name", None)], "ordinal int, id string, legal_name string, aliases array<string>")
    queries = spark.createDataFrame([(1, "other")], "query_id int, name string")
    assert resolve.names_against_registry(queries, registry.limit(0)).count() == 0 == resolve.names_against_registry(queries.limit(0), registry).count()


def test_a_playbook_of_several_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    clauses = spark.createDataFrame([(f"s{i}", [rng.random() for _ in range(3)]) for i in range(20)], "section string, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, None)], "query_id long, embedding array<double>")
    whole = [tuple(r) for r in retrieval.search(queries, clauses).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(retrieval, "CLAUSE_BYTES", 400)
    assert [tuple(r) for r in retrieval.search(queries, clauses).orderBy("query_id", "rank").collect()] == whole and len(whole) == 3


def test_words_find_the_clause_that_they_are_of(spark):
    clauses = spark.createDataFrame([("§1", "Payment", "invoices are paid in 45 to 90 days"), ("§2", "Term", "renews automatically unless notice is given")], "section string, title string, body string")
    queries = spark.createDataFrame([(1, "When are INVOICES paid?"), (2, "does it renew; renews automatically?"), (3, ""), (4, None)], "query_id long, text string")
    best = {r.query_id: r.section for r in retrieval.search_text(queries, clauses, k=1).collect()}
    assert best[1] == "§1" and best[2] == "§2" and set(best) == {1, 2, 3, 4}


def brute_search(queries, clauses, k):
    """(query, rank, section, score) by dense vectors of TF-IDF; clauses: (section, text)."""
    words = lambda t: re.findall(r"[a-z0-9§]+", (t or "").lower())
    parts = lambda t: words(t) + [" ".join(p) for p in zip(words(t), words(t)[1:], strict=False)]
    counts = [(s, Counter(parts(t))) for s, t in clauses]
    held = Counter(t for _, c in counts for t in c)
    idf = lambda t: math.log((1 + len(counts)) / (1 + held[t])) + 1

    def unit(c):
        raw = {t: n * idf(t) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / length for t, x in raw.items()}

    known = [(s, unit(c)) for s, c in counts]
    out = set()
    for q, text in queries:
        own = unit(Counter(parts(text)))
        far = sorted((bool(own) + bool(c) - 2 * round(sum(x * c.get(t, 0) for t, x in own.items()), 9), s) for s, c in known)
        out |= {(q, i, s, round(1 / (1 + d), 8)) for i, (d, s) in enumerate(far[:k], 1)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_by_postings_is_that_by_vectors(spark, seed):
    """Also with words that all have, texts without words, repeated clauses, and fewer clauses than are asked for."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", *[f"w{i}" for i in range(40)]]
    weights = [30, 20, 10, *[4 / (i + 1) for i in range(40)]]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    clauses = [(f"s{i:02}", text(rng.randint(1, 30))) for i in range(40)] + [("a0", "the of w3"), ("a1", "the of w3"), ("z", ""), ("y", "..."), ("x", None)]
    queries = [(i, text(rng.randint(1, 12))) for i in range(60)] + [(100, ""), (101, None), (102, "nothing known"), (103, "the")]
    table = lambda rows: spark.createDataFrame([(s, "", t) for s, t in rows], "section string, title string, body string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = lambda rows, k: {(r.query_id, r["rank"], r.section, round(r.score, 8)) for r in retrieval.search_text(asked, table(rows), k).collect()}
    assert got(clauses, 4) == brute_search(queries, clauses, 4)
    assert got(clauses[:2], 4) == brute_search(queries, clauses[:2], 4)
    assert got([], 4) == set()


def test_masking_keeps_pages_apart_and_nulls_null(spark):
    page = lambda n, t: (n, "text", t, None, None, None)
    docs = spark.createDataFrame([(1, [page(1, "a@example.com"), page(2, None), page(3, "b\xadc\xa0d")]), (2, [page(1, "no​thing")]), (3, []), (4, None)], f"doc_id long, pages array<{pages.PAGE}>")
    rows = {r.doc_id: r for r in pages.masked(docs).collect()}
    assert [p.text for p in rows[1].pages] == ["[EMAIL]", None, "bc d"] and rows[1].redactions == {"email": 1}
    assert [p.text for p in rows[2].pages] == ["nothing"] and rows[2].redactions == rows[3].redactions == rows[4].redactions == {}


def test_a_file_is_stored_once_and_whole(spark, tmp_path):
    files = spark.createDataFrame([("a.PDF", b"one"), ("b.pdf", b"one"), ("c", b"two"), (None, b"two")], "filename string, content binary")
    for _ in range(2):
        intake.store(files, str(tmp_path / "f"))
    assert sorted(r["size"] for r in intake.stored(spark, str(tmp_path / "f")).collect()) == [3, 3]
    assert sorted(p.suffix for p in (tmp_path / "f").iterdir() if not p.name.startswith(".")) == ["", ".pdf"]


def test_names_that_a_number_decides_or_that_equal_a_label_meet_no_other(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("names are compared")

    monkeypatch.setattr(resolve, "near_names", fail)
    monkeypatch.setattr(resolve, "_in_cells", fail)
    registry = spark.createDataFrame([(0, "a", "Alpha Works", None, "R1"), (1, "b", "Beta Works", None, "R2")], "ordinal int, id string, legal_name string, aliases array<string>, registration_id string")
    asked = [(1, "Alpha Works", "r-1"), (2, "Other", "R2"), (3, "works BETA", None), (4, " ", None)]
    got = resolve.resolve(spark.createDataFrame(asked, "query_id int, name string, registration_id string"), registry, k=1)
    assert {r.query_id: (r.vendor_id, r.matched_on) for r in got.collect()} == {1: ("a", "registration_id"), 2: (None, "conflict"), 3: ("b", "name"), 4: (None, "none")}


@pytest.mark.parametrize("most", [0, 20, 256])
def test_short_names_of_few_letters_meet_hardly_more_than_similar_ones(spark, monkeypatch, most):
    monkeypatch.setattr(resolve, "SUBSEQUENCES", most)
    texts = [f"{w} {w[::-1]} works" for w in (str(i).zfill(5).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(0, 40_000, 97))] + ["", "a", "ab"]
    grams = resolve._bigrams(spark.createDataFrame([(x,) for x in texts], "words string"))
    want = {(a, b): round(ratio(a, b) / 100, 9) for a in texts for b in texts if ratio(a, b) >= 85}
    assert {(r.words, r.other): round(r.score, 9) for r in resolve.near_names(grams, grams, 0.85).collect()} == want
    if most == 256:  # before: all that share a rare bigram
        monkeypatch.setattr(resolve, "similarity", lambda a, b: F.lit(100.0))
        assert resolve.near_names(grams, grams, 0.85).count() == len(want)


def test_what_is_slow_a_row_is_dealt_to_all_cores(spark):
    """The tables are files of one row group, so a scan is one task."""
    small, cores = "/root/testdata/sf0.001", spark.sparkContext.defaultParallelism
    _, inputs = queries_documents._inputs(spark, small)
    assert queries_messages._mail(spark, small).rdd.getNumPartitions() > cores
    assert documents.load(inputs, inputs.files.select("id")).rdd.getNumPartitions() > cores
