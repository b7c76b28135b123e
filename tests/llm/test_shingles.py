import random
from collections import Counter

from docgate.llm.shingles import drop_similar
from tests.llm.helpers import AZ, SMALL, WORD, edge_docs, small_docs


def shingles(text, words=5):
    w = WORD.findall((text or "").translate(AZ))
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or {" ".join(w)}


def brute_kept(rows):
    """Indices of the rows that stay, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id or 0, i))
    return [min(g)[2] for g in groups.values()]


def test_pairs_of_0_8_are_found_and_others_stay(spark):
    """Each text has a copy with a stretch of words changed, some just above and some just below 0.8."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        near = list(base)
        at = rng.randint(10, 120)
        for j in range(at, at + (4 + i % 30)):
            near[j] = f"v{i}x{j}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, "  ".join(near).upper())]
    kept = {rows[i][0] for i in brute_kept(rows)}
    assert 60 < len(kept) < 110
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == sorted(kept)


def test_pairs_of_0_8_by_keys_of_three_segments(spark, monkeypatch):
    """The keys of tables of many millions of texts find the same."""
    from docgate.llm import shingles as module

    monkeypatch.setattr(module, "TWO_SEGMENTS", 0)
    test_pairs_of_0_8_are_found_and_others_stay(spark)


def test_nodes_with_one_hash_are_told_apart(spark):
    """Of texts that share a node's 64 bits only those of the same words are one."""

    def named(data, offsets):
        from docgate.llm.shingles import names_of

        own = names_of(data, offsets)
        own[:, 0] &= 3
        return own

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(i, t) for i, t in enumerate([a, b, c, d, a.upper(), b + " z", c, "one", "", None, "two  words", "Two words"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_similar(docs, named=named).collect()) == sorted(rows[i][0] for i in brute_kept(rows))


def test_a_common_passage_hides_no_pair(spark):
    """Texts that share a passage of two thirds meet in large buckets; those with a copy besides are still found."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = []
    for i in range(80):
        own = [f"o{i}x{j}" for j in range(60)]
        rows.append((i, f"{passage} {' '.join(own)}"))
        if i % 4 == 0:
            own[rng.randint(0, 59)] = "changed"
            rows.append((1000 + i, f"{passage} {' '.join(own)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == list(range(80)) == sorted(rows[i][0] for i in brute_kept(rows))


def test_large_buckets_of_several_groups(spark, monkeypatch):
    """Texts that share most of their words meet in buckets that count as large; those that are linked besides are all found."""
    from docgate.llm import shingles as module

    monkeypatch.setattr(module, "SMALL", 3)
    rng = random.Random(10)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = [f"o{i % 40}x{j}" for j in range(28 + i % 9)]
        if i >= 40:
            own[rng.randint(0, 20)] = "changed"
        rows.append((i, " ".join(passage + own)))
    kept = sorted(rows[i][0] for i in brute_kept(rows))
    assert 20 < len(kept) < 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == kept


def test_near_copies_that_arent_similar_are_not_all_compared(spark, monkeypatch):
    """Of one text's copies, each with other changes (some in common), few pairs a copy are left to rare shingles, and all links found."""
    from docgate.llm import shingles as module

    asked, checked = [], module._checked

    def counted(pairs, docs, words, percent, name):
        asked.append((name, pairs.count()))
        return checked(pairs, docs, words, percent, name)

    monkeypatch.setattr(module, "_checked", counted)
    rng = random.Random(11)
    base, rows = [f"p{i}" for i in range(150)], []
    for i in range(300):
        own = list(base)
        for j in rng.sample(range(5, 145, 7), 4):
            own[j] = f"c{j}x{rng.randint(0, 2)}" if i % 3 else f"o{i}x{j}"
        rows.append((i, " ".join(own)))
        if i % 50 == 0:
            rows.append((1000 + i, " ".join([*own, "end"])))
    kept = sorted(rows[i][0] for i in brute_kept(rows))
    assert 100 < len(kept) < 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == kept
    assert sum(n for name, n in asked if name == "more_links") < 8 * len(rows)


def test_pipeline_stage_on_the_small_table(spark):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in small_docs(spark).collect()]
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, small_docs(spark), SMALL)
    assert {r.doc_id for r in out.collect()} == {rows[i][0] for i in brute_kept(rows)}


def test_rows_not_identifiers_are_decided_on(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(0, a), (1, a + " z"), (1, b), (2, b + " z"), (None, c), (None, c), (None, a.upper()), (4, "one two"), (4, "one  two"), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, node string")
    out = drop_similar(docs)
    assert out.columns == docs.columns
    want = [(0, a), (1, b), (None, c), (5, "")]
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert {k: got.pop(k) for k in want} == dict.fromkeys(want, 1)
    assert sum(got.values()) == 1 and next(iter(got))[0] == 4
    assert drop_similar(edge_docs(spark, empty=True)).count() == 0
    assert drop_similar(edge_docs(spark)).columns == edge_docs(spark).columns
