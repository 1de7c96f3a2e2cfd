"""Exact nearest vectors for a set of queries, with cells around pivots that the triangle inequality rules out.

Every vector belongs to the cell of its nearest pivot, at a known radius. A cell whose vectors have radii
between a and b lies at least max(d - b, a - d) from a query whose distance to the pivot is d. Each query
is first held against the nearest cells that have k vectors between them, which bounds its k-th distance
from above; then against the other cells that can hold anything nearer, and inside a cell only against the
radii that can. On clustered vectors few cells are left, on vectors without structure nearly all are: the
result is the same, and exact.

Queries and vectors meet in cells of bounded size (rows dealt by number, so a cell with a third of all
vectors is many tasks), are compared by matrix products there, and only the rows that can be among the
k best are summed exactly, in component order. k rows of a query leave a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .scratch import materialize

#: Vectors that pivots are chosen among, the most pivots, and the most cells over all groups.
SAMPLE, PIVOTS, CELLS = 4096, 1024, 1 << 20
#: Components of the vectors, and queries, that meet in one task at a time.
CELL_VALUES, QUERY_BLOCK = 1 << 20, 1024
#: Queries whose cells are listed at a time, visits (a query and a cell each) in an Arrow batch, vectors placed at a time.
VISITORS, VISITS, PLACED = 64, 1024, 1024
#: Bounds are relaxed by this share of the numbers they come from, so that rounding loses nothing.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, so that what a task holds does not grow with Spark's batches."""
    for batch in batches:
        for x in range(0, batch.num_rows, rows):
            yield batch.slice(x, rows)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows (or all different ones), each the farthest from those before; the first is the first row."""
    at, near = [0], np.square(x - x[0]).sum(axis=1)
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, np.square(x - x[at[-1]]).sum(axis=1))
    return x[at]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` and ``y``, by a matrix product."""
    return np.sqrt(np.maximum(np.square(x).sum(axis=1)[:, None] + np.square(y).sum(axis=1) - 2 * x @ y.T, 0))


def exact_squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances summed in component order."""
    return np.square(x - q).cumsum(axis=1)[:, -1]


def _usable(rows: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, bad))
    return rows if dim is None else rows.where(F.size(column) == dim)


def _visits(spark, queries: DataFrame, pivots: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, kind: str) -> DataFrame:
    """``queries`` (query_row, q, and for the second round g and bound) with the cells to look at.

    First round: for each group the nearest cells that hold k vectors. Second round: the other cells that may hold
    one within the bound.
    """
    shared = spark.sparkContext.broadcast((pivots, counts, low, high))
    dim, first = pivots.shape[1], kind == "first"

    def near_cells(d: np.ndarray, g: int) -> np.ndarray:
        _, counts, _, _ = shared.value
        order = np.argsort(np.where(counts[g] > 0, d, np.inf), kind="stable")
        n = int(np.searchsorted(np.cumsum(counts[g][order]), k)) + 1
        return order[: min(n, int((counts[g] > 0).sum()))]

    def visit(batches):
        for batch in _parts(batches, VISITORS):
            pivots, counts, low, high = shared.value
            d = distances(_matrix(batch["q"], dim), pivots) if batch.num_rows else np.empty((0, len(pivots)))
            at, gs, cells = [], [], []
            given, bounds = (None, None) if first else (batch["g"].to_pylist(), batch["bound"].to_pylist())
            for i in range(batch.num_rows):
                for g in range(len(counts)) if first else [given[i]]:
                    found = near_cells(d[i], g)
                    if not first:
                        bound = bounds[i]
                        least = np.maximum(d[i] - high[g], low[g] - d[i])
                        open_ = (counts[g] > 0) & (least <= bound + SLACK * (bound + d[i] + high[g]))
                        open_[found] = False
                        found = np.flatnonzero(open_)
                    at += [i] * len(found)
                    gs += [g] * len(found)
                    cells += found.tolist()
            at, gs, cells = (np.array(x, np.int64) for x in (at, gs, cells))
            for x in range(0, max(len(at), 1), VISITS):
                i, g, c = at[x : x + VISITS], gs[x : x + VISITS], cells[x : x + VISITS]
                take = pa.array(i)
                bound = pa.nulls(len(i), pa.float64()) if first else batch["bound"].take(take)
                arrays = [batch["query_row"].take(take), batch["q"].take(take), bound, pa.array(g.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(d[i, c])]
                yield pa.RecordBatch.from_arrays(arrays, ["query_row", "q", "bound", "g", "cell", "away"])

    return queries.mapInArrow(visit, "query_row long, q array<double>, bound double, g int, cell int, away double")


def _met(visits: DataFrame, placed: DataFrame, cells: DataFrame, k: int, dim: int, scored: bool) -> DataFrame:
    """The k best of each visited cell: ``(query_row, g, row, square)``, or how many vectors were compared."""
    per = max(CELL_VALUES // dim, 64)
    grid = cells.select("g", "cell", F.ceil(F.col("n") / per).cast("int").alias("nv"))
    busy = visits.groupBy("g", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq"))
    grid = grid.join(busy, ["g", "cell"])  # a row a visited cell
    salt = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    x = placed.join(grid, ["g", "cell"]).select("g", "cell", salt("row", "nv").alias("i"), each("nq").alias("j"), "row", "id", "e", "radius")
    y = visits.join(grid, ["g", "cell"]).select("g", "cell", each("nv").alias("i"), salt("query_row", "nq").alias("j"), "query_row", "q", "bound", "away")
    schema = "query_row long, g int, row long, square double, pairs long"

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            by = np.argsort(left["radius"].to_numpy(), kind="stable")
            e, q = _matrix(left["e"], dim)[by], _matrix(right["q"], dim)
            radius, rows = left["radius"].to_numpy()[by], left["row"].to_numpy()[by]
            ids = left["id"].take(pa.array(by)).to_pylist()
            bounds, away = right["bound"].to_numpy(), right["away"].to_numpy()
            g, norms = left["g"][0].as_py(), np.square(e).sum(axis=1)
            for n, own in enumerate(right["query_row"].to_pylist()):
                lo, hi = 0, len(rows)
                if not np.isnan(bounds[n]):
                    slack = bounds[n] + SLACK * (bounds[n] + away[n] + radius[-1])
                    lo, hi = np.searchsorted(radius, away[n] - slack), np.searchsorted(radius, away[n] + slack, side="right")
                if hi <= lo:
                    continue
                about = norms[lo:hi] - 2 * (e[lo:hi] @ q[n]) + q[n] @ q[n]
                cut = np.partition(about, k - 1)[k - 1] if hi - lo > k else np.inf
                if not np.isnan(bounds[n]):
                    cut = min(cut, bounds[n] ** 2)
                some = np.flatnonzero(about <= cut + SLACK * (norms[lo:hi].max() + q[n] @ q[n])) + lo
                square = exact_squares(e[some], q[n])
                best = sorted(zip(square.tolist(), [ids[i] for i in some], some.tolist(), strict=True))[:k]
                out += [(own, g, int(rows[i]), s, 0) for s, _, i in best]
                out.append((own, g, -1, None, int(hi - lo)))
        c = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(c, kinds, strict=True)], ["query_row", "g", "row", "square", "pairs"])

    keys = ("g", "cell", "i", "j")
    found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(compare, schema)
    return found.where("row < 0").select("query_row", "g", "pairs") if scored else found.where("row >= 0").drop("pairs")


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, by: Sequence[str] = (), id_column: str = "id", scored: bool = False) -> DataFrame:
    """``vectors`` with query_id, distance (squared) and rank: the k nearest to each query (query_id, query) in each ``by`` group.

    Ties go to the smaller id. Null or empty vectors and queries, vectors with a null or non-finite component and
    those of another length than most (the longest length, where the numbers tie) take no part; groups with fewer than k
    vectors give all; rows of one id are rows of their own; null group values are a group; an empty side gives no rows.
    With ``scored`` the result is ``(query_row, g, pairs)``: how many vectors each query was compared with.
    """
    spark, by = vectors.sparkSession, list(by)
    v = _usable(vectors, "embedding")
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim, total = (sizes["d"], sizes["count"]) if sizes else (1, 0)
    v = v.where(F.size("embedding") == dim)
    q = _usable(queries, "query", dim).select("query_id", F.col("query").cast("array<double>").alias("q"))
    q = materialize(q.select(F.monotonically_increasing_id().alias("query_row"), "query_id", "q"))
    share = int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))
    drawn = v.where(F.pmod(F.xxhash64(id_column, "embedding"), F.lit(1 << 30)) < share).limit(2 * SAMPLE).select(F.col("embedding").cast("array<double>").alias("e")).toArrow()
    sample = _matrix(drawn["e"], dim) if drawn.num_rows else np.zeros((1, dim))
    n_groups, rows = 1, v.withColumn("_g", F.lit(0))
    if by:
        numbers = materialize(v.select(*by).distinct().withColumn("_g", F.row_number().over(Window.orderBy(*by)) - 1))
        n_groups = numbers.count()
        other = numbers.select("_g", *(F.col(c).alias(f"_by_{c}") for c in by))
        rows = v.join(other, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.lit(True))).select(*vectors.columns, "_g")
    pivots = farthest_first(sample, max(1, min(PIVOTS, int(total**0.5), CELLS // max(n_groups, 1))))
    shared, at = spark.sparkContext.broadcast(pivots), vectors.columns.index("embedding")

    def place(batches):
        for batch in _parts(batches, PLACED):
            d = distances(_matrix(batch.column(at), dim), shared.value) if batch.num_rows else np.empty((0, len(shared.value)))
            cell = d.argmin(axis=1) if batch.num_rows else np.empty(0, np.int64)
            arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "_cell", "_radius"])

    schema = StructType([*rows.schema.fields, StructField("_cell", IntegerType()), StructField("_radius", DoubleType())])
    v = materialize(rows.mapInArrow(place, schema).withColumn("_row", F.monotonically_increasing_id()))
    placed = v.select(F.col("_row").alias("row"), F.col(id_column).alias("id"), F.col("_g").alias("g"), F.col("embedding").cast("array<double>").alias("e"), F.col("_cell").alias("cell"), F.col("_radius").alias("radius"))
    cells = placed.groupBy("g", "cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    counts, low, high = (np.zeros((n_groups, len(pivots))) for _ in range(3))
    for r in cells.collect():  # CELLS at most
        counts[r["g"], r["cell"]], low[r["g"], r["cell"]], high[r["g"], r["cell"]] = r["n"], r["low"], r["high"]

    visit = lambda queries, kind: _visits(spark, queries, pivots, counts, low, high, k, kind)
    first = visit(q.select("query_row", "q"), "first")
    near = materialize(_met(first, placed, cells, k, dim, False))
    order = Window.partitionBy("query_row", "g").orderBy("square")
    full = near.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_row", "g", F.sqrt("square").alias("bound"))
    second = visit(q.select("query_row", "q").join(full, "query_row"), "second")
    if scored:
        return _met(first, placed, cells, k, dim, True).unionByName(_met(second, placed, cells, k, dim, True))
    found = near.unionByName(_met(second, placed, cells, k, dim, False)).join(q.select("query_row", "query_id"), "query_row")
    out = found.join(v, F.col("row") == F.col("_row")).withColumnRenamed("square", "distance")
    w = Window.partitionBy("query_row", "g").orderBy("distance", id_column)
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(*vectors.columns, "query_id", "distance", "rank")
