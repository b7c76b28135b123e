"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgate.llm.common import scratch, stage

#: Rows and queries of one cell that meet in a task, about; a larger cell, however large, is cut by hash.
CELL_ROWS, CELL_QUERIES = 65536, 2048
#: Rows of one combination of all hashes, about: the larger the table, the more hashes are concatenated.
FINE_ROWS = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    rows, dim = x.shape
    half = 1
    while half < dim:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, dim)
        half *= 2
    return x / math.sqrt(dim)


def axes(vectors: np.ndarray, place: int, seed: int) -> np.ndarray:
    """The vectors' components, then the negated ones, after the place's pseudo-rotation: random signs and a Hadamard
    transform, three times over. The largest is the nearest signed axis."""
    rows, dim = vectors.shape
    wide = 1 << max(0, (dim - 1).bit_length())
    x = np.zeros((rows, wide))
    x[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, place])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], wide))
    return np.concatenate([x, -x], axis=1)


@dataclass(frozen=True)
class Hashes:
    """`tables` hash tables of concatenated cross-polytope hashes. `sizes` has the number of axes that each hash of a table
    chooses from, signs apart: the whole polytope, but for the last, which may look at fewer. The first `coarse` hashes
    name the cell whose rows meet in a task, the others the place of a row within it."""

    dim: int
    tables: int
    sizes: tuple[int, ...]
    coarse: int
    seed: int

    @staticmethod
    def of(rows: int, dim: int, tables: int, seed: int) -> Hashes:
        """As many hashes as give about FINE_ROWS rows to a combination, as many coarse ones as give CELL_ROWS to a cell."""
        wide = 1 << max(0, (dim - 1).bit_length())
        sizes, coarse, places = [wide], 1, rows / FINE_ROWS / (2 * wide)
        while places >= 2:
            size = min(wide, 1 << int(math.log2(places / 2)))
            sizes.append(size)
            places /= 2 * size
        cells = 2 * wide
        while coarse < len(sizes) and rows / cells > CELL_ROWS:
            cells *= 2 * sizes[coarse]
            coarse += 1
        return Hashes(dim, tables, tuple(sizes), coarse, seed)

    def lacks(self, x: np.ndarray, table: int, hashes: range) -> list[np.ndarray]:
        """For each of these hashes of the table and each of its signed axes: the square of what the axis lacks to the nearest."""
        out = []
        for h in hashes:
            near = axes(x, table * len(self.sizes) + h, self.seed)
            near = np.concatenate([near[:, : self.sizes[h]], near[:, near.shape[1] // 2 :][:, : self.sizes[h]]], axis=1)
            out.append((near.max(axis=1, keepdims=True) - near) ** 2)
        return out

    def numbers(self, x: np.ndarray, table: int, hashes: range) -> np.ndarray:
        """The number that these hashes of the table give each vector."""
        number = np.zeros(len(x), np.int64)
        for h, lack in zip(hashes, self.lacks(x, table, hashes), strict=True):
            number = number * (2 * self.sizes[h]) + lack.argmin(axis=1)
        return number

    def spent(self, lacks: list[np.ndarray], numbers: np.ndarray, hashes: range) -> np.ndarray:
        """What each vector (row) lacks in all to each number (column) that these hashes may give."""
        total = np.zeros((len(lacks[0]) if lacks else 1, len(numbers)))
        for h, lack in zip(reversed(hashes), reversed(lacks), strict=True):
            total = total + lack[:, numbers % (2 * self.sizes[h])]
            numbers = numbers // (2 * self.sizes[h])
        return total

    def first(self) -> range:
        return range(self.coarse)

    def rest(self) -> range:
        return range(self.coarse, len(self.sizes))

    def cells(self) -> int:
        return math.prod(2 * self.sizes[h] for h in self.first())


def _vectors(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _parts(batches, size: int):
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _placed(rows: DataFrame, hashes: Hashes) -> DataFrame:
    """vec_id, embedding, cell and place: each row in its cell of each table."""

    def run(batches):
        for part in _parts(batches, 4000):
            x = _vectors(part.column("embedding"), hashes.dim)
            for table in range(hashes.tables):
                cell = table * hashes.cells() + hashes.numbers(x, table, hashes.first())
                place = hashes.numbers(x, table, hashes.rest())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(place)], [*part.schema.names, "cell", "place"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, cell long, place long")


def _probing(queries: DataFrame, hashes: Hashes, reach: float) -> DataFrame:
    """q, embedding, cell and spent: each query in all cells to which it lacks no more than `reach`."""

    def run(batches):
        for part in _parts(batches, 500):
            x = _vectors(part.column("embedding"), hashes.dim)
            for table in range(hashes.tables):
                row, cell, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
                for h, lack in zip(hashes.first(), hashes.lacks(x, table, hashes.first()), strict=True):
                    total = spent[:, None] + lack[row]
                    at, axis = np.nonzero(total <= reach)
                    row, cell, spent = row[at], cell[at] * (2 * hashes.sizes[h]) + axis, total[at, axis]
                numbers = pa.array(cell + table * hashes.cells())
                taken = [part.column(c).take(pa.array(row)) for c in ("q", "embedding")]
                yield pa.RecordBatch.from_arrays([*taken, numbers, pa.array(spent)], ["q", "embedding", "cell", "spent"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.select("q", "embedding").mapInArrow(run, f"q long, embedding {kind}, cell long, spent double")


def _least(ids: np.ndarray, far: np.ndarray, want: int, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """The `want` identifiers of the smallest distances, ties to the smaller; each once, at its smallest distance."""
    if not single:
        order = np.argsort(ids, kind="stable")
        ids, far = ids[order], far[order]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        ids, far = ids[starts], np.minimum.reduceat(far, starts) if len(starts) else far
    if len(far) > want:
        take = np.flatnonzero(far <= np.partition(far, want - 1)[want - 1])
        ids, far = ids[take], far[take]
    order = np.lexsort((ids, far))[:want]
    return ids[order], far[order]


#: What a block of queries and rows returns.
FOUND = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _nearest(want: int, hashes: Hashes, reach: float):
    """Of two blocks of a cell, the `want` nearest identifiers of each query, by exact distance, among the rows that it lacks no
    more than `reach` to."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            ids, x = rows.column("vec_id").to_numpy(), _vectors(rows.column("embedding"), hashes.dim)
            asked, y, spent = queries.column("q").to_numpy(), _vectors(queries.column("embedding"), hashes.dim), queries.column("spent").to_numpy()
            places, at = np.unique(rows.column("place").to_numpy(), return_inverse=True)
            single = len(np.unique(ids)) == len(ids)
            table, narrow = key[0].as_py() // hashes.cells(), len(hashes.rest()) > 0 and np.isfinite(reach)
            for low in range(0, len(y), 64):
                some = y[low : low + 64]
                near = np.ones((len(some), len(places)), bool)
                if narrow:
                    near = spent[low : low + 64, None] + hashes.spent(hashes.lacks(some, table, hashes.rest()), places, hashes.rest()) <= reach
                for query, q, met in zip(asked[low : low + 64], some, near, strict=True):
                    met = np.flatnonzero(met[at])
                    apart = x[met] - q
                    found, far = _least(ids[met], np.sqrt((apart * apart).sum(axis=1)), want, single)
                    out.append(pa.table([pa.array(np.full(len(found), query)), pa.array(found), pa.array(far)], FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return run


def _meet(queries: DataFrame, rows: DataFrame, want: int, hashes: Hashes, reach: float) -> DataFrame:
    """The `want` nearest identifiers of each query within its cells, a row per query and identifier found in a block.

    The queries and rows of each cell are counted; it is cut by hash into blocks, the more the larger it is, and each block
    of queries meets each block of rows of its cell in a task."""
    many = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("row_cuts"))
    cuts = many.join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("query_cuts")), "cell")
    if hashes.tables * hashes.cells() <= 1 << 16:  # so many rows at most
        cuts = F.broadcast(stage(cuts, "cuts"))

    def cut(df: DataFrame, own: str, key: str, other: str) -> DataFrame:
        dealt = F.pmod(F.xxhash64(key, "embedding"), F.col(f"{own}_cuts")).cast("int")
        blocks = F.explode(F.sequence(F.lit(0), F.col(f"{other}_cuts") - 1))
        return df.join(cuts, "cell").withColumns({f"{own}_block": dealt, f"{other}_block": blocks}).drop("row_cuts", "query_cuts")

    keys = ["cell", "query_block", "row_block"]
    left, right = cut(queries, "query", "q", "row").groupBy(*keys), cut(rows, "row", "vec_id", "query").groupBy(*keys)
    return left.cogroup(right).applyInArrow(_nearest(want, hashes, reach), "q long, vec_id long, score double")


def _reach(queries: DataFrame, rows: DataFrame, k: int, hashes: Hashes, sample: int, recall: float) -> float:
    """What a query may lack to a row's cells, so that its k nearest are met with the share `recall`.

    Measured on at most `sample` queries, chosen by hash, whose k nearest among all rows of another vector are searched
    without hashes, batch by batch; the driver gets those sample * k vectors."""
    picked = queries.orderBy(F.xxhash64("embedding"), "q").limit(sample).select("embedding").collect()
    asked = np.array([r.embedding for r in picked], np.float64).reshape(-1, hashes.dim)
    shared = queries.sparkSession.sparkContext.broadcast(asked)
    kind = rows.schema["embedding"].dataType.simpleString()

    def run(batches):
        y = shared.value
        best, held = np.full((len(y), k), np.inf), np.zeros((len(y), k, hashes.dim))
        for part in _parts(batches, 4000):
            x = _vectors(part.column("embedding"), hashes.dim)
            far = (x * x).sum(axis=1)[None] - 2 * y @ x.T + (y * y).sum(axis=1)[:, None]
            far[far < 1e-12 * (y * y).sum(axis=1)[:, None]] = np.inf
            least = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
            both = np.concatenate([best, np.take_along_axis(far, least, axis=1)], axis=1)
            vectors = np.concatenate([held, x[least]], axis=1)
            keep = np.argsort(both, axis=1, kind="stable")[:, :k]
            best, held = np.take_along_axis(both, keep, axis=1), np.take_along_axis(vectors, keep[:, :, None], axis=1)
        real = np.isfinite(best)
        lists = pa.array(list(held[real]), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(real)[0]), pa.array(best[real]), lists], ["q", "far", "embedding"])

    near = rows.select("embedding").mapInArrow(run, "q long, far double, embedding array<double>")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("far", "embedding"))).filter(F.col("nth") <= k)
    near = near.select("q", "embedding").collect()
    if not near:
        return math.inf
    at, x = np.array([r.q for r in near]), np.array([r.embedding for r in near], np.float64)
    every = range(len(hashes.sizes))
    lacks = np.full(len(x), np.inf)
    for table in range(hashes.tables):
        own = hashes.lacks(asked, table, every)
        total = np.zeros(len(x))
        for mine, his in zip(own, hashes.lacks(x, table, every), strict=True):
            total += mine[at, his.argmin(axis=1)]
        lacks = np.minimum(lacks, total)
    return float(np.quantile(lacks, recall, method="higher")) * (1 + 1e-9)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, dim: int = 64, tables: int = 2, recall: float = 0.95, sample: int = 128, seed: int = 2
) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank (from 1), vec_id, score, the Euclidean distance in double
    precision between the vectors as given.

    `vectors` has vec_id and embedding; `is_query` says which rows are queries. A query's own identifier is no candidate
    for it; ties go to the smaller identifier. Rows whose vector is null, zero, not of `dim` components, or has a null or
    non-finite component, or whose vec_id is null, take no part. Of rows with one vec_id each pair counts once, at its
    smallest distance. Extra columns are ignored; no rows give no rows.

    Each of `tables` tables gives a row the signed axes that its unit vector is nearest to after several pseudo-rotations, the
    more of them the larger the table, so that few rows share them all. What a query lacks to a row's axes, against its own
    nearest ones, says how soon the row is met: a query is compared with all rows to which it lacks no more than a
    reach, which is measured once, on at most `sample` queries compared with all rows, to meet their k nearest with the share
    `recall`. The first axes name a cell; its rows and the queries that reach it meet in a task, in blocks where it
    holds many. A query for which too few rows were found is then compared with all rows, in blocks.

    Of rows with one vector only the k + 1 smallest identifiers can be results, and equal queries are searched for once: so one
    vector on a large share of the rows is no large cell."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = clean.filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    )
    first = Window.partitionBy("embedding").orderBy("vec_id")
    asked = clean.filter("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    best = Window.partitionBy("q").orderBy("score", "vec_id")

    def top(df: DataFrame) -> DataFrame:
        once = df.groupBy("q", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)

    with scratch(vectors.sparkSession) as temporary:
        rows = clean.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
        rows = stage(rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1).select("vec_id", "embedding"), "rows")
        queries = temporary.keep(asked.select("embedding").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
        hashes = Hashes.of(rows.count(), dim, tables, seed)
        reach = _reach(queries, rows, k, hashes, sample, recall)
        found = temporary.keep(top(_meet(_probing(queries, hashes, reach), _placed(rows, hashes), k + 1, hashes, reach)), "found")
        full = found.filter(F.col("nth") == k + 1).select("q")
        short = temporary.keep(queries.join(full, "q", "left_anti").select("q", "embedding"), "short")
        if not short.isEmpty():
            one, none = F.lit(0).cast("long"), F.lit(0.0)
            rest = _meet(short.withColumns({"cell": one, "spent": none}), rows.withColumns({"cell": one, "place": one}), k + 1, hashes, math.inf)
            rest = temporary.keep(top(rest), "rest")
            found = found.join(short.select("q"), "q", "left_anti").unionByName(rest)
    near = asked.join(queries, "embedding").select("query_id", "q").join(found.select("q", "vec_id", "score"), "q")
    near = near.filter(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
