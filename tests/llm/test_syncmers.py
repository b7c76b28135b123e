"""Closed syncmers: windows, context, the edited texts, and plans without Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docgate.llm import syncmers
from docgate.llm.queries import op13_fingerprints
from docgate.llm.syncmers import aligned, anchors, closed, closed_after, edited, fingerprint, likeness
from tests.llm.helpers import SMALL, TEXTS, edge_docs, small_docs


def words(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" + rng.choice(["", "é", ".", "日本"]) for _ in range(n))


def of(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [[(a.place, a.hash) for a in r.a] for r in df.select("i", anchors(F.col("t"), **kw).alias("a")).orderBy("i").collect()]


def brute_places(spark, text, size, inner):
    """Places of closed k-mers by Spark's own hash of inner substrings."""
    units = re.findall(r"[!-~]{1,16}|[぀-ヿ㐀-䶿一-鿿]|[^\s぀-ヿ㐀-䶿一-鿿]{1,16}", text)
    rows = [tuple(units[i : i + inner]) for i in range(len(units) - inner + 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *[f"c{j}" for j in range(inner)]])
    h = [r.h for r in df.select("i", F.xxhash64(*[f"c{j}" for j in range(inner)]).alias("h")).orderBy("i").collect()]
    width = size - inner + 1
    return [i for i in range(len(units) - size + 1) if min(h[i], h[i + width - 1]) == min(h[i : i + width])]


@pytest.mark.parametrize(("size", "inner"), [(6, 2), (5, 1), (4, 2), (8, 3)])
def test_edges_by_definition(spark, size, inner):
    text = words(200, size)
    assert [p for p, _ in of(spark, [text], size=size, inner=inner)[0]] == brute_places(spark, text, size, inner)


def test_no_stretch_without_an_anchor_and_no_context(spark):
    passage = words(120, 1)
    alone, inside = of(spark, [passage, f"{words(33, 2)} {passage} {words(40, 3)}"])
    places = [p for p, _ in alone]
    assert places[0] <= 5 and max(b - a for a, b in zip(places, places[1:], strict=False)) <= 5
    shift = next(p for p, h in inside if h == alone[0][1]) - alone[0][0]
    assert set((p + shift, h) for p, h in alone) <= set(inside)


def test_windows_change_nothing(spark, monkeypatch):
    texts = [words(n, n) for n in (1, 5, 6, 7, 60, 400)] + ["x" * 900, "日本語" * 200, "a  b\n\n" * 150, *[t for t in TEXTS if t and len(t) < 1000]]
    whole = of(spark, texts)
    hashes = lambda: spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", closed(F.col("t")).alias("h")).orderBy("i").collect()
    raw = [r.h for r in hashes()]
    for size in (1, 10, 64):
        monkeypatch.setattr(syncmers, "WINDOW", size)
        assert of(spark, texts) == whole and [r.h for r in hashes()] == raw


def test_edits_from_what_is_kept(spark):
    rng = random.Random(5)
    texts = [words(n, n, 30) for n in range(1, 90, 4)] + ["", "x" * 500, "日本語 " * 60, " a " * 50, words(20, 1) + "\n\n"]
    rows = [(t, t[:k] + h, k) for t in texts for k in {0, len(t), *rng.choices(range(len(t) + 1), k=3)} for h in ("", " ", words(9, 3), "yz")]
    df = spark.createDataFrame(rows, "t string, e string, k int")
    t, e = F.col("t"), F.col("e")
    wrong = df.filter(closed_after(t, closed(t), F.col("k"), e) != closed(e))
    assert wrong.count() == 0


def expected(rows):
    """doc_id -> (edited text, next text) of rows with distinct doc_ids."""
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        out[doc] = (text[: len(text) - q] + after[:q], after)
    return out


def test_query_against_texts(spark):
    docs = small_docs(spark)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    rows = {r.doc_id: r for r in op13_fingerprints(spark, SMALL).collect()}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in rows.items()} == {r.doc_id: (len(r.text or ""), hashlib.sha256(want[r.doc_id][0].encode()).hexdigest()) for r in docs.collect()}
    ids = list(want)
    direct = dict(zip(ids, of(spark, [want[d][0] for d in ids]), strict=True))
    for d, r in rows.items():
        assert r.edited_fingerprint == "".join(f"{h & 0xFFFFFFFF:08x}" for _, h in direct[d])
    sets = {d: {r.fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)} for d, r in rows.items()}
    order = sorted(rows)
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        a, b = sets[d], sets[after]
        assert rows[d].near_next == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)
    long = [r.near_edited for r in rows.values() if r.n_chars > 500]
    assert 0.6 < sum(long) / len(long) < 0.9


def test_awkward_rows(spark):
    docs = edge_docs(spark).unionByName(edge_docs(spark).limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    rows = edited(docs).collect()
    assert len(rows) == docs.count()
    plain = {r.doc_id: r for r in edited(edge_docs(spark)).collect()}
    want = expected(list({(r.doc_id, r.text) for r in edge_docs(spark).collect()}))
    assert {d: r.edited for d, r in plain.items()} == {d: e for d, (e, _) in want.items()}
    one = edited(edge_docs(spark).filter("doc_id = 24").limit(1)).collect()
    assert len(one) == 1 and one[0].edited == one[0].text[:9] + one[0].text[:2] and one[0].hashes == one[0].next_hashes
    assert edited(edge_docs(spark, empty=True)).count() == 0


def test_equal_texts_and_likeness(spark):
    texts = [words(50, 1), words(50, 1), words(50, 2), None, "", " \n", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    prints = [r.f for r in df.select("i", fingerprint(F.transform(anchors(F.col("t")), lambda a: a["hash"])).alias("f")).orderBy("i").collect()]
    assert prints[0] == prints[1] != prints[2] and prints[3] == prints[4] == prints[5] == "" and len(prints[6]) == 8
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    got = spark.range(1).select(likeness(a(1, 2, 2, 3), a(3, 4)), likeness(a(), a()), likeness(a(1), a())).first()
    assert tuple(got) == (0.4, 1.0, 0.0)


def test_a_moved_passage_is_aligned(spark):
    passage = words(80, 4)
    pairs = spark.createDataFrame([(1, passage, f"{words(30, 5, 9)} {passage}"), (2, passage, passage), (3, words(50, 6), words(50, 7)), (4, None, passage)], "key int, a string, b string")
    pairs = pairs.select("key", anchors(F.col("a")).alias("a"), anchors(F.col("b")).alias("b"))
    got = {r.key: r for r in aligned(pairs).collect()}
    ahead = len(re.findall(r"[!-~]{1,16}|[日本]|[^\s日本]{1,16}", words(30, 5, 9)))
    assert got[1].shift == ahead and got[2].shift == 0 and got[1].matched > 20 and 4 not in got
    assert 3 not in got or got[3].matched < 3


def test_plan_has_no_python(spark):
    plan = op13_fingerprints(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
