"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from docgate.llm import lexical
from docgate.llm.lexical import search
from tests.llm.helpers import AZ, edge_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def brute(docs, items, k):
    """docs, items: (id, text). Every document's score for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, c in counts:
            m = 25 + (75 * c.total() * n_docs) // length if length else 0
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in own.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        out += [(item, rank, x[2], x[3]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, search(a, b, k).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed, monkeypatch):
    """Few words, so that scores tie and pruning has something to lose; also with terms in several passes, windows, and joins instead
    of rows that are sent."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "Ü"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n)).replace("w1 ", "W1-")
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(i, "w5 w5 w9") for i in range(1000, 1040)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)]
    want = brute(docs, items, 5)
    assert found(spark, docs, items, 5) == want
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 20)
    monkeypatch.setattr(lexical, "SENT_AT_MOST", 0)
    monkeypatch.setattr(lexical, "WINDOW", 7)
    assert found(spark, docs, items, 5) == want


def test_awkward_rows(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "the cat"), (None, "hello")]
    items = [(1, "hello world"), (1, "The CAT"), (2, None), (3, ""), (4, "zebra"), (None, "cat 日本語のテキスト"), (5, "x"), (6, " :;")]
    assert found(spark, rows, items, 4) == brute(rows, items, 4)
    clashing = docs.withColumnRenamed("score", "tid")
    asked = spark.createDataFrame([(1, "hello", "a")], "item_id long, text string, doc_id string")
    assert {r.doc_id for r in search(clashing, asked).collect()} == {r.doc_id for r in docs.collect() if "hello" in terms(r.text)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []


def test_a_long_text_in_windows():
    text = b"Ab c-" * 500_000
    assert lexical._counted(text) == {b"ab": 500_000, b"c": 500_000}
