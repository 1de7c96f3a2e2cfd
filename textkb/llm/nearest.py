"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue.

Vectors are scaled and lifted by one coordinate so that the largest inner product is the smallest
angle. The trees are as deep as the number of rows asks for leaves of about ``LEAF_ROWS`` rows. The
first ``TOP_LEVELS`` levels split a bounded sample (``SAMPLE_VALUES`` numbers) at the median of the
projection on the difference of two sample points of the node; deeper levels have one random
projection for each level and tree, cut at its median. So the forest that is broadcast has a bounded
size, and *every* row gets one leaf in each tree.

A query walks all trees through one priority queue (a node's priority is the largest margin by which
its path left the query's side) and takes the first leaves that come out; the rows of these leaves
are scored once each (a row that several trees give is scored in the first of them), the best
exactly: double precision, summed in component order.

How many leaves are taken is calibrated, not guessed: for ``CALIBRATION`` of the queries the true
neighbours are found by brute force (a stated query set against all rows, in blocks), and the least
number of leaves that reaches ``TARGET_RECALL`` on them is used for all. On clustered vectors that is
a few leaves whatever the number of rows; vectors without any structure need a large share of all.

Rows and queries meet in cells: a subtree of about ``CELL_VALUES`` numbers by ``QUERIES`` queries. Larger
subtrees (copies of one vector cannot be split) are salted by row, so none lands in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_unit, materialize, sample_fraction, table

TREES, LEAF_ROWS, TOP_LEVELS = 8, 64, 12
SAMPLE_VALUES = 1 << 22
NEIGHBOURS, EVERY = 20, 20
CALIBRATION, TARGET_RECALL = 64, 0.94
CELL_VALUES, QUERIES = 1 << 22, 8192


@dataclass
class Forest:
    """Node i of a tree's top has children 2i+1 and 2i+2; below, level j of tree t has ``deep[t, j]``."""

    plane: np.ndarray  # (trees, nodes, dim + 1)
    cut: np.ndarray  # (trees, nodes)
    deep: np.ndarray  # (trees, levels, dim + 1)
    deep_cut: np.ndarray  # (trees, levels)
    scale: float

    @property
    def top(self) -> int:
        return (self.plane.shape[1] + 1).bit_length() - 1

    @property
    def depth(self) -> int:
        return self.top + self.deep.shape[1]

    @classmethod
    def grow(cls, sample: np.ndarray, scale: float, dim: int, depth: int, seed: int = 5) -> Forest:
        g, top = np.random.default_rng(seed), min(depth, TOP_LEVELS)
        nodes = (1 << top) - 1
        deep = g.standard_normal((TREES, depth - top, dim + 1))
        out = cls(np.zeros((TREES, nodes, dim + 1)), np.zeros((TREES, nodes)), deep, np.zeros((TREES, depth - top)), scale)
        x = out.lifted(sample)
        for t in range(TREES):
            held = {0: np.arange(len(x))}
            for i in range(nodes):
                rows = held.pop(i, np.empty(0, np.int64))
                w = g.standard_normal(dim + 1)
                if len(rows) > 1:
                    tries = [x[a] - x[b] for a, b in (g.choice(rows, 2, replace=False) for _ in range(3))]
                    some = x[rows[:: len(rows) // 1024 + 1]]
                    best = max(tries, key=lambda v: np.std(some @ v) / max(np.linalg.norm(v), 1e-12))
                    w = best if best.any() else w
                out.plane[t, i] = w / np.linalg.norm(w)
                p = x[rows] @ out.plane[t, i]
                out.cut[t, i] = np.median(p) if len(p) else 0.0
                held[2 * i + 1], held[2 * i + 2] = rows[p <= out.cut[t, i]], rows[p > out.cut[t, i]]
        if depth > top:
            out.deep /= np.linalg.norm(out.deep, axis=2, keepdims=True)
            out.deep_cut = np.median(np.einsum("nd,tld->tln", x, out.deep), axis=2) if len(x) else out.deep_cut
        return out

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (0 .. 2**depth - 1) of each row in each tree, (rows, trees)."""
        y, out = self.lifted(x), np.empty((len(x), TREES), np.int64)
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.top):
                node = 2 * node + 1 + (np.einsum("nd,nd->n", y, self.plane[t, node]) > self.cut[t, node])
            code = node - ((1 << self.top) - 1)
            for level in range(self.deep.shape[1]):
                code = 2 * code + (y @ self.deep[t, level] > self.deep_cut[t, level])
            out[:, t] = code
        return out

    def order(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(tree, leaf)`` for one query, best first, from one queue over all trees."""
        y = np.concatenate([q / self.scale, [0.0]])
        margin, below = (self.plane @ y - self.cut).tolist(), (self.deep @ y - self.deep_cut).tolist()
        top, inner, depth = self.top, (1 << self.top) - 1, self.depth
        queue = [(0.0, t, 0, 0) for t in range(TREES)]
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            p, t, level, code = pop(queue)
            while level < depth:  # down the query's own side; the other sides wait in the queue
                m = margin[t][(1 << level) - 1 + code] if level < top else below[t][level - top]
                code, level = 2 * code + (m > 0), level + 1
                push(queue, (max(p, abs(m)), t, level, code ^ 1))
            yield t, code


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact inner products (summed in component order) of the k best rows, best first.

    Quick products find the rows that can be among them; only these are summed in order.
    """
    quick = x @ q
    some = np.arange(len(x))
    if len(x) > k:
        slack = 1e-9 * (1.0 + np.abs(quick).max())
        some = np.flatnonzero(quick >= np.partition(quick, len(x) - k)[len(x) - k] - slack)
    exact = np.concatenate([(x[some[a : a + 4096]] * q).cumsum(axis=1)[:, -1] for a in range(0, len(some), 4096)]) if len(some) else np.empty(0)
    first = _top(exact, ids[some], k)
    return some[first], exact[first]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; shorter vectors are followed by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * dim:
        return flat.reshape(-1, dim)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


FOUND = "query_row long, query_id long, vec_id long, score double"


def _found(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    n = [len(p[2]) for p in parts]
    join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind)
    rows, ids = (np.repeat(np.array([p[i] for p in parts], np.int64), n) for i in (0, 1))
    return [pa.array(rows), pa.array(ids), pa.array(join(2, np.int64)), pa.array(join(3, float))]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: list[tuple[int, int, np.ndarray]], dim: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded block of ``(row, vec_id, query)`` among all ``vectors``: one pass."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, x = batch["row"].to_numpy(), batch["vec_id"].to_numpy(), _matrix(batch["embedding"], dim)
            parts = []
            for own, query_id, q in shared.value:
                others = np.flatnonzero(row != own)
                at, score = best_of(q, x[others] if len(others) < len(x) else x, ids[others], k)
                parts.append((own, query_id, ids[others][at], score))
            yield pa.RecordBatch.from_arrays(_found(parts), ["query_row", "query_id", "vec_id", "score"])

    return _ranked(vectors.select("row", "vec_id", "embedding").mapInArrow(run, FOUND), k)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, float, int]:
    """``(row, vec_id, embedding)`` of the rows that take part, the longest length, the largest norm, the count.

    Null ids, null, empty or zero vectors, and null or non-finite components take no part. Vectors
    shorter than the longest count as followed by zeros. Rows with the same id are rows of their own.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    v = v.where(F.exists("embedding", lambda x: x != 0))
    v = materialize(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dim, norm, n = v.agg(F.max(F.size("embedding")), F.max(F.sqrt(square)), F.count("*")).first()
    return v, dim or 1, float(norm or 1.0), n


def _own() -> F.Column:
    """A number that a vector gives by its components: draws do not depend on how the rows are dealt."""
    return F.xxhash64("embedding")


def _leaf_budget(forest: Forest, placed: DataFrame, queries: DataFrame, dim: int, n: int, k: int, target: float) -> int:
    """The least number of leaves that reaches the target recall on the calibration queries."""
    some = queries.orderBy(hash_unit("vec_id", _own(), seed="calibration"), "vec_id", _own()).limit(CALIBRATION).toArrow()
    if not some.num_rows or n <= k + 1:
        return TREES << forest.depth
    known = list(zip(some["row"].to_pylist(), some["vec_id"].to_pylist(), _matrix(some["embedding"], dim), strict=True))
    truth = brute_force(placed, known, dim, k).select("query_row", "vec_id", "score")
    # A row of the same id in another place is another neighbour; its leaves are as good as the neighbour's.
    near = truth.join(placed.select("vec_id", "leaves"), "vec_id").select("query_row", "leaves").toArrow()
    wanted: dict[int, list[np.ndarray]] = {}
    for own, leaves in zip(near["query_row"].to_pylist(), near["leaves"].to_pylist(), strict=True):
        wanted.setdefault(own, []).append(np.array(leaves))
    reached = []
    for own, _, q in known:
        open_ = wanted.get(own, [])
        for taken, (t, leaf) in enumerate(forest.order(q), 1):
            if not open_:
                break
            left = [x for x in open_ if x[t] != leaf]
            reached += [taken] * (len(open_) - len(left))
            open_ = left
    return int(np.ceil(np.quantile(reached, target))) if reached else TREES << forest.depth


def _packed(taken: np.ndarray, depth: int) -> bytes:
    """A set of ``tree << depth | leaf`` codes: a bitmap or a list, whichever is shorter."""
    if len(taken) * 8 <= TREES << depth >> 3:
        return b"l" + np.sort(taken).tobytes()
    bits = np.zeros(TREES << depth, bool)
    bits[taken] = True
    return b"b" + np.packbits(bits).tobytes()


class _Taken:
    """Membership in a packed set."""

    def __init__(self, packed: bytes):
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)).view(bool) if packed[:1] == b"b" else None
        self.codes = np.frombuffer(packed[1:], np.int64) if self.bits is None else None

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return self.bits[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.codes[at] == codes


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, target: float = TARGET_RECALL, scored: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each row whose id ``every`` divides.

    Nearness is the largest inner product, ties to the smaller id, the query's own row left out. See
    ``usable`` for the vectors that take part. Rows with the same id are queries (and candidates) of
    their own; an empty table gives no rows, a query without other vectors none, and a query with
    fewer than k others all of them. Other columns of ``vectors`` are ignored. With ``scored`` the result
    is ``(query_row, scored)`` instead: how many rows were scored for each query, by cell.
    """
    spark = vectors.sparkSession
    rows, dim, scale, n = usable(vectors)
    depth = max(0, round(np.log2(max(n, 1) / LEAF_ROWS)))
    sample = rows.where(hash_unit("vec_id", _own(), seed="forest") < sample_fraction(n, max(SAMPLE_VALUES // dim, 64)))
    sample = sample.orderBy("vec_id", _own()).select("embedding").toArrow()
    forest = Forest.grow(_matrix(sample["embedding"], dim), scale, dim, depth)
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaves(_matrix(batch["embedding"], dim)) if batch.num_rows else np.empty((0, TREES), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * TREES, pa.int32()), pa.array(leaf.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], batch["embedding"], lists], ["row", "vec_id", "embedding", "leaves"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(place, f"row long, vec_id long, embedding {kind}, leaves array<int>"))
    queries = rows.where(F.col("vec_id") % every == 0)
    budget = _leaf_budget(forest, placed, queries, dim, n, k, target)
    cell_rows = max(CELL_VALUES // dim, 64)
    cut = min(depth, max(0, int(np.ceil(np.log2(max(n, 1) / cell_rows)))))  # levels above a cell

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            cells, sets = [], []
            for q in _matrix(batch["embedding"], dim):
                taken = np.fromiter((t << depth | leaf for (t, leaf), _ in zip(trees.order(q), range(budget))), np.int64)  # noqa: B905
                cells.append(np.unique(taken >> (depth - cut)))
                sets.append(_packed(taken, depth))
            arrays = [batch["row"], batch["vec_id"], batch["embedding"], pa.array(cells, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["query_row", "query_id", "query", "cells", "taken"])

    probes = materialize(queries.mapInArrow(probe, f"query_row long, query_id long, query {kind}, cells array<bigint>, taken binary"))
    probes = probes.select("query_row", "query_id", "query", "taken", F.explode("cells").alias("cell"))
    index = placed.select("row", "vec_id", "embedding", "leaves", F.posexplode("leaves").alias("tree", "leaf"))
    index = index.withColumn("cell", F.shiftleft(F.col("tree").cast("long"), cut).bitwiseOR(F.shiftright(F.col("leaf"), depth - cut))).drop("leaf", "tree")
    grid = index.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).alias("nv")).join(
        probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("nq")), "cell"
    )
    grid = materialize(grid)  # a row for each cell
    salt = lambda c, m: F.pmod(F.xxhash64(c), F.col(m))
    every_of = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    x = index.join(grid, "cell").select("cell", salt("row", "nv").alias("i"), every_of("nq").alias("j"), "row", "vec_id", "embedding", "leaves")
    y = probes.join(grid, "cell").select("cell", every_of("nv").alias("i"), salt("query_row", "nq").alias("j"), "query_row", "query_id", "query", "taken")

    def candidates(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each query of a cell its row, id, vector and the places of the rows to score."""
        tree = right["cell"][0].as_py() >> cut
        leaves = left["leaves"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, TREES)
        codes, own = leaves + (np.arange(TREES) << depth), left["row"].to_numpy()
        for row, query_id, q, packed in zip(right["query_row"].to_pylist(), right["query_id"].to_pylist(), _matrix(right["query"], dim), right["taken"], strict=True):
            taken = _Taken(packed.as_buffer().to_pybytes())
            at = np.flatnonzero(taken(codes[:, tree]))
            for earlier in range(tree):  # there it is scored already
                at = at[~taken(codes[at, earlier])]
            yield row, query_id, q, at[own[at] != row]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            ids, x = left["vec_id"].to_numpy(), _matrix(left["embedding"], dim)
            for row, query_id, q, at in candidates(left, right):
                best, score = best_of(q, x[at], ids[at], k)
                parts.append((row, query_id, ids[at[best]], score))
        return pa.table(_found(parts), ["query_row", "query_id", "vec_id", "score"])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(row, len(at)) for row, _, _, at in candidates(left, right)] if left.num_rows and right.num_rows else []
        return pa.table([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], ["query_row", "scored"])

    keys = ("cell", "i", "j")
    met = x.groupBy(*keys).cogroup(y.groupBy(*keys))
    if scored:
        return met.applyInArrow(counted, "query_row long, scored long")
    return _ranked(met.applyInArrow(cell, FOUND), k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
