import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgate.llm.ann import Hashes, axes, hadamard, nearest
from tests.llm.helpers import SMALL

SCHEMA = "vec_id long, embedding array<float>, rank string, cell string, score string"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        far = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)
        out[q] = far[:k]
    return out


def test_transform_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(hadamard(hadamard(x)), x)
    assert np.allclose(np.linalg.norm(axes(x, 0, 1)[:, :16], axis=1), 1)


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in df.collect()}
    queries = [i for i in vectors if i % 20 == 0]
    want = brute(vectors, queries, 10)
    rows = nearest(df, F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(x) == 10 and x == sorted(x) for x in got.values())
    assert all(abs(math.dist(vectors[q], vectors[i]) - s) < 1e-12 for q, x in got.items() for s, i in x)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9


def test_awkward_vectors_ties_and_few_candidates(spark):
    good = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [-5.0, 1.0, 0.0]), (5, [0.0, 0.0, 2.0]), (5, [0.0, 0.0, 2.5])]
    bad = [(10, None), (11, [0.0, 0.0, 0.0]), (12, [1.0, None, 0.0]), (13, [float("nan"), 1.0, 0.0]), (14, [float("inf"), 1.0, 0.0]), (15, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "r", "c", "s") for i, v in good + bad], SCHEMA)
    rows = nearest(df, F.col("vec_id") == 0, k=10, dim=3, tables=1).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 5), (4, 3)]
    assert nearest(df.filter("vec_id > 9"), F.lit(True), dim=3).count() == 0
    assert nearest(spark.createDataFrame([], SCHEMA), F.lit(True), dim=3).count() == 0


def test_blocks_of_one_cell_agree(spark, monkeypatch):
    import docgate.llm.ann as ann

    monkeypatch.setattr(ann, "CELL_ROWS", 5)
    monkeypatch.setattr(ann, "CELL_QUERIES", 3)
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=4).tolist() for i in range(120)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    rows = nearest(df, F.col("vec_id") % 6 == 0, k=4, dim=4, tables=1, recall=1.0).collect()
    want = brute(vectors, [i for i in vectors if i % 6 == 0], 4)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for _, i in x] for q, x in want.items()}


def test_a_cell_with_most_rows_is_cut_by_its_own_size(spark, monkeypatch):
    """Half of all vectors are nearly one vector: their cell meets in blocks of about CELL_ROWS."""
    import docgate.llm.ann as ann

    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    seen = spark.sparkContext.accumulator(0)  # blocks with far more rows than CELL_ROWS
    plain = ann._nearest

    def watched(want, hashes, reach):
        run = plain(want, hashes, reach)

        def counted(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
            seen.add(int(rows.num_rows > 50))
            return run(key, queries, rows)

        return counted

    monkeypatch.setattr(ann, "_nearest", watched)
    rng = np.random.default_rng(4)
    vectors = {i: [0.5 + i * 1e-6, 1.0, -0.25, 3.0] if i % 2 else rng.normal(size=4).tolist() for i in range(600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    rows = nearest(df, F.col("vec_id") == 301, k=5, dim=4, recall=1.0).collect()
    want = brute(vectors, [301], 5)[301]
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"])] == [i for _, i in want]
    assert seen.value == 0


def test_one_vector_on_half_of_all_rows(spark):
    """Copies of a vector beyond the k + 1 smallest identifiers can't be results; ties go to smaller identifiers."""
    rng = np.random.default_rng(4)
    vectors = {i: [0.5, 1.0, -0.25, 3.0] if i % 2 else rng.normal(size=4).tolist() for i in range(600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    rows = nearest(df, F.col("vec_id").isin(3, 301, 599), k=5, dim=4).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: [(i, 0.0) for i in (1, 3, 5, 7, 9, 11) if i != q][:5] for q in (3, 301, 599)}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_ids_divisible_by_20(spark, sf):
    df = spark.read.parquet(f"{SMALL.replace('0.001', sf)}/embeddings.parquet")
    ids, x = zip(*[(r.vec_id, r.embedding) for r in df.collect()], strict=True)
    ids, x = np.array(ids), np.array(x, np.float64)
    want = {}
    for at in np.flatnonzero(ids % 20 == 0):
        far = ((x - x[at]) ** 2).sum(axis=1)
        far[at] = np.inf
        want[ids[at]] = set(ids[np.lexsort((ids, far))[:10]].tolist())
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(want[q] & got[q]) for q in want) / (10 * len(want)) >= 0.9


def test_hashes_grow_with_the_table_and_the_share_met_falls(spark):
    """More rows, more hashes; on clustered vectors, each cluster as large in all tables, the share of rows met falls."""
    sizes = [len(Hashes.of(10**e, 64, 2, 0).sizes) for e in (2, 4, 6, 8, 10)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1] and Hashes.of(10**10, 64, 2, 0).coarse > 1
    rng = np.random.default_rng(5)
    shares = []
    for n in (400, 6400):
        x = np.repeat(rng.normal(size=(n // 20, 16)), 20, axis=0) + 0.1 * rng.normal(size=(n, 16))
        hashes = Hashes.of(n, 16, 1, 3)
        every = range(len(hashes.sizes))
        lacks = hashes.spent(hashes.lacks(x[::20], 0, every), hashes.numbers(x, 0, every), every)
        own = np.repeat(np.arange(n // 20), 20)[None] == np.arange(n // 20)[:, None]
        shares.append((lacks <= np.quantile(lacks[own], 0.95)).mean())
    assert shares[1] < shares[0] / 2


def test_copies_of_a_row_take_one_place(spark):
    """Twenty rows of one identifier near the query, in the cells and where all rows are compared."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(1, [1.0, 0.001 * i, 0.0]) for i in range(20)] + [(i, [1.0, 0.1 * i, 0.0]) for i in range(2, 14)]
    df = spark.createDataFrame(rows + rows[1:2] * 20, "vec_id long, embedding array<double>")
    for seed in (2, 3):
        out = nearest(df, F.col("vec_id") == 0, k=10, dim=3, tables=1, seed=seed).collect()
        assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, 11))
