import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docgate.llm import simhash
from docgate.llm.common import flat
from docgate.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tests.llm.helpers import AZ, SMALL, TEXTS, WORD, edge_docs, small_docs


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("salts", [1, 7])
def test_exact_duplicates(spark, keep, salts):
    docs = edge_docs(spark).unionByName(edge_docs(spark).limit(4).selectExpr("cast(null as bigint) as doc_id", "* except (doc_id)"))
    rows = [(r.doc_id, (r.text or "").translate(AZ)) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = {t: (min if keep == "smallest" else max)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    out = exact_duplicates(docs, keep, salts).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_query_and_no_rows(spark):
    from docgate.llm.queries import op9_exact_dedup

    texts = {r.doc_id: (r.text or "").translate(AZ) for r in small_docs(spark).collect()}
    out = {r.doc_id: r for r in op9_exact_dedup(spark, SMALL).collect()}
    assert out.keys() == texts.keys()
    last = {t: i for i, t in sorted(texts.items())}
    assert all(r.keep_id == last[texts[i]] and r.kept == (i == r.keep_id) for i, r in out.items())
    assert exact_duplicates(edge_docs(spark, empty=True)).count() == 0


def test_exact_plan_has_no_python(spark):
    plan = exact_duplicates(small_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_drop_exact_duplicates(spark):
    docs = edge_docs(spark)
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter((r.text or "").translate(AZ) for r in rows) == Counter({(t or "").translate(AZ) for t in TEXTS})
    assert drop_exact_duplicates(edge_docs(spark, empty=True)).count() == 0


def brute_print(text, words=3):
    w = WORD.findall((text or "").translate(AZ))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """The smallest identifier reachable from each (identifier, fingerprint)."""
    unique = sorted({p for _, p in prints})
    root = {p: p for p in unique}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(unique):
        for b in unique[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return [(i, f"{p:016x}", least.get(find(p))) for i, p in prints]


def test_fingerprints():
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["ab", "É", "C", " ", "  ", "\n", "\x0b", "z"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for words in (1, 3, 5):
        assert simhash.fingerprints_of(*flat(pa.array(texts)), words).tolist() == [brute_print(t, words) for t in texts]
    assert simhash.fingerprints_of(*flat(pa.array([], pa.string()))).tolist() == []


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    assert (np.bincount(simhash.decode(words), minlength=4096) == 2048).all()
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 22, 2000)
    row, index = simhash.nearby(some, 22)
    near = defaultdict(set)
    for r, i in zip(row.tolist(), index.tolist(), strict=True):
        near[r].add(i)
    for bit in range(22):
        assert all(int(d) in near[r] for r, d in enumerate(simhash.decode(some ^ (1 << bit))))
    assert max(map(len, near.values())) <= 6


def test_keys_of_fingerprints_within_three_bits_meet_both_ways():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)

    def sides(prints):
        out = [(set(), set()) for _ in prints]
        for r, k, s in zip(*(x.tolist() for x in simhash.keys_of(prints)), strict=True):
            out[r][s].add(k)
        return out

    for x, y in zip(sides(a), sides(b), strict=True):
        assert x[0] & y[1] and x[1] & y[0]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    loose = [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    links = [(a, b) for a, b in chain + star + loose if a != b]
    rng.shuffle(links)
    root = {n: n for e in links for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == {n: find(n) for n in root} and len(out) == len(root)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = [base.replace("w7 ", "x7 "), base.replace("w200", "y200"), base + " z", base.upper()]
    rows = [(i, t) for i, t in enumerate([base, *near, "", None, "one", "one two", *(f"other {i} text {i * i}" for i in range(40))])]
    rows += [rows[0], (None, base), (None, "nobody knows")]
    docs = spark.createDataFrame([(i, t, "f", "k") for i, t in rows], "doc_id long, text string, fingerprint string, key string")
    want = brute_components([(i, brute_print(t)) for i, t in rows])
    out = simhash.near_duplicates(docs).collect()
    assert Counter(map(tuple, out)) == Counter(want)
    assert simhash.near_duplicates(edge_docs(spark, empty=True)).count() == 0


def test_near_duplicate_query(spark):
    from docgate.llm.queries import op7_simhash

    want = brute_components([(r.doc_id, brute_print(r.text)) for r in small_docs(spark).collect()])
    assert Counter(map(tuple, op7_simhash(spark, SMALL).collect())) == Counter(want)
