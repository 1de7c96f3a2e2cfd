"""Hard-negative mining with Four-Russians scoring.

Components are integers. A candidate is kept as the bits of its two's complement components: for each
bit plane and each group of eight dimensions one byte. For an anchor the sums of all 256 subsets of a
group's eight components are computed once; a candidate's score is then

    sum over planes of weight * (sum over groups of table[group][byte of plane and group])

with weight 2**plane, and -2**plane for the sign plane, summed from the highest plane down by
doubling. Nothing is multiplied and every score is the exact inner product, in 64 bits.

Candidates are packed into rows of up to ``BLOCK_VALUES`` components, sorted by label, and anchors into rows of
up to some hundred. Each packed anchor row meets each packed candidate row once for its positives (only
vectors of its label are scored) and once for its negatives (only those of other labels), so no pair
becomes a row. A task goes through the candidate rows of one anchor row in a strip, and keeps the best
of the strip in bounded lists; the lists of strips are merged by a window. Labels play no part in how
rows are dealt, so a label with a third of all rows is no larger task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Components in a packed row of candidates, such rows in a strip, and bytes of subset sums built at a time.
BLOCK_VALUES, STRIP, TABLE_BYTES = 1 << 18, 64, 2 << 20
#: The most anchors in a packed row; fewer where that would leave too few tasks.
ANCHORS = 1024
#: Components from 2**25 on would let scores of long vectors pass 64 bits.
LARGEST = 1 << 25
_NO_ID = np.iinfo(np.int64).max

PACKED = "ids binary, rows binary, labels binary, values binary"


def quantized(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, label, v)`` of the rows that take part, written to the shared folder.

    Null labels, null vectors, and vectors with a null or non-finite component take no part, nor do components that
    are ``LARGEST`` or more when scaled. Where 7 divides the id, the label is the next one modulo 10. A null id takes
    part as a candidate and comes last in ties; rows of one id are rows of their own.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= F.lit(LARGEST / SCALE))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.where(F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("e", lambda x: F.floor(x * SCALE).cast("int"))
    return materialize(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), whole.alias("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """One row a vector, zeros after the end of a short one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int32)
    out[np.arange(dim) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(v: np.ndarray) -> np.ndarray:
    """Bytes ``(planes, groups, vectors)``: bit k of a byte is the plane's bit of dimension k of the group."""
    n, dim = v.shape
    bits = max(int(max(v.max(), ~v.min(), 0)).bit_length() + 1 if v.size else 1, 1)  # the last plane is the sign
    padded = np.zeros((n, -(-dim // 8) * 8), np.int32)
    padded[:, :dim] = v
    return np.stack([np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)])


def subset_sums(v: np.ndarray, kind: type) -> np.ndarray:
    """``(groups, 256, anchors)``: for each byte the sum of the components whose bits it holds."""
    n, dim = v.shape
    padded = np.zeros((n, -(-dim // 8) * 8), kind)
    padded[:, :dim] = v
    parts = padded.reshape(n, -1, 8).transpose(1, 2, 0)
    out = np.zeros((parts.shape[0], 256, n), kind)
    for k in range(8):  # each dimension doubles what is known
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + parts[:, k : k + 1]
    return out


def score(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products ``(vectors, anchors)`` from lookups, additions and doublings."""
    out = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    found = np.empty_like(out)
    for b in range(len(planes) - 1, -1, -1):
        out += out
        for g in range(len(tables)):
            np.take(tables[g], planes[b, g], axis=0, out=found)
            out += found
        if b == len(planes) - 1:
            np.negative(out, out)  # two's complement: the highest plane counts negative
    return out


class _Block(NamedTuple):
    """A packed row: sorted by label."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, row: dict, dim: int, prefix: str = "") -> _Block:
        get = lambda c, kind: np.frombuffer(row[prefix + c], kind)
        return cls(get("ids", np.int64), get("rows", np.int64), get("labels", np.int64), get("values", np.int32).reshape(-1, dim))

    def spans(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())


def _pack(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors, each sorted by label; a partition's last one may hold fewer.

    A column ``bars`` (a list for each vector) is packed along.
    """
    barred = "bars" in rows.columns

    def flush(t: pa.Table) -> pa.RecordBatch:
        ids = t["vec_id"].combine_chunks().fill_null(_NO_ID).to_numpy()
        labels, own, v = t["label"].to_numpy(), t["row"].to_numpy(), _matrix(t["v"], dim)
        by = np.argsort(labels, kind="stable")
        arrays = [pa.array([c.tobytes()], pa.binary()) for c in (ids[by], own[by], labels[by], v[by])]
        if barred:
            lists = t["bars"].to_pylist()
            arrays.append(pa.array([[lists[i] for i in by]], pa.list_(pa.list_(pa.int64()))))
        return pa.RecordBatch.from_arrays(arrays, ["ids", "rows", "labels", "values", "bars"][: len(arrays)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                n += held[-1].num_rows
                if n >= size:
                    t = pa.Table.from_batches(held)
                    yield flush(t.slice(0, size))
                    held, n = t.slice(size).to_batches(), n - size
        if n:
            yield flush(pa.Table.from_batches(held))

    return rows.mapInArrow(pack, PACKED + (", bars array<array<bigint>>" if barred else ""))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties to the smaller id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _scored(anchors: _Block, cands: _Block, same: bool) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(anchor, first, last candidate, scores)``: candidates of the anchor's label, or else all of the block."""
    dim = anchors.values.shape[1]
    largest = int(np.abs(cands.values.astype(np.int64)).max(initial=0)) + 1
    # Subset sums times twice the largest power of two in use bound every number on the way.
    most = int(np.abs(anchors.values.astype(np.int64)).sum(axis=1).max(initial=0)) * largest * 4
    kind = np.int32 if most < 1 << 31 else np.int64
    step = max(8, TABLE_BYTES // (max(-(-dim // 8), 1) * 256 * np.dtype(kind).itemsize))
    planes = bit_planes(cands.values)
    edges = [(*anchors.spans(x), *cands.spans(x)) for x in np.unique(anchors.labels).tolist()] if same else [(0, len(anchors.ids), 0, len(cands.ids))]
    for a, b, lo, hi in edges:
        for at in range(a, b if hi > lo else a, step):
            to = min(at + step, b)
            scores = score(subset_sums(anchors.values[at:to], kind), planes[:, :, lo:hi])
            for j, s in enumerate(np.ascontiguousarray(scores.T).astype(np.int64, copy=False)):
                yield at + j, lo, hi, s


def _meet(anchors: DataFrame, cands: DataFrame, found: str, visit) -> DataFrame:
    """Each packed anchor row with each packed candidate row: ``visit(blocks, barred, candidates)`` gives the rows of a strip.

    ``anchors`` has its block and the number of strips, ``cands`` its strip and the number of blocks.
    """
    names = found.replace(" long", "").split(", ")
    left = anchors.withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).drop("strips")
    right = cands.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = visit(left.to_pylist(), right.to_pylist()) if left.num_rows and right.num_rows else []
        at = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64) for _ in names]
        return pa.table([pa.array(c, mask=(c == _NO_ID) & n.endswith("_id")) for c, n in zip(at, names, strict=True)], names)

    return left.groupBy("block", "strip").cogroup(right.groupBy("block", "strip")).applyInArrow(strip, found)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """The k best ``(id, score)`` of what the blocks of a strip gave."""
    s, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    at = _best(s, ids, k)
    return list(zip(ids[at].tolist(), s[at].tolist(), strict=True))


def _positives(dim: int):
    def visit(left: list[dict], right: list[dict]) -> list[tuple]:
        found: dict[tuple[int, int], list] = {}
        anchors = [_Block.of(r, dim) for r in left]
        for row in right:
            cands = _Block.of(row, dim)
            for k, own in enumerate(anchors):
                for a, lo, hi, s in _scored(own, cands, same=True):
                    at = _best(s, cands.ids[lo:hi], POSITIVES + 1)  # the anchor itself may be one of them
                    at = at[cands.rows[lo:hi][at] != own.rows[a]]
                    found.setdefault((k, a), []).append((s[at], cands.ids[lo:hi][at]))
        return [(anchors[k].rows[a], anchors[k].ids[a], i, s) for (k, a), parts in found.items() for i, s in _merged(parts, POSITIVES)]

    return visit


def _negatives(dim: int):
    def visit(left: list[dict], right: list[dict]) -> list[tuple]:
        found: dict[tuple[int, int, int], list] = {}
        anchors = [_Block.of(r, dim) for r in left]
        bars = {(k, a): [(p, -(-LOW * p // 100), HIGH * p // 100) for p in ps] for k, r in enumerate(left) for a, ps in enumerate(r["bars"])}
        for row in right:
            cands = _Block.of(row, dim)
            for k, own in enumerate(anchors):
                for a, _, _, s in _scored(own, cands, same=False):
                    wanted = bars[k, a]
                    near = (s >= min(lo for _, lo, _ in wanted)) & (s <= max(hi for *_, hi in wanted))
                    x, y = cands.spans(own.labels[a])
                    near[x:y] = False
                    at = np.flatnonzero(near)
                    at = at[np.lexsort((cands.ids[at], -s[at]))]
                    down = -s[at]
                    for p, lo, hi in wanted:
                        i = np.searchsorted(down, -hi)
                        some = at[i : min(i + NEGATIVES, np.searchsorted(down, -lo, side="right"))]
                        if len(some):
                            found.setdefault((k, a, p), []).append((s[some], cands.ids[some]))
        return [(anchors[k].rows[a], p, i, s) for (k, a, p), parts in found.items() for i, s in _merged(parts, NEGATIVES)]

    return visit


def mine(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows whose id ``every`` divides.

    Positives are the five best other rows of the anchor's label, negatives of a positive the three best rows of other
    labels whose score is 50 to 95 hundredths of its own. See ``quantized`` for the rows that take part. Short vectors
    count as followed by zeros. An anchor without positives, or a positive without negatives, gives no row; an empty
    table none. Rows of one id are anchors of their own, so equal rows give equal results once for each. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors)
    is_anchor = F.col("vec_id") % every == 0
    dim, n, n_anchors = rows.agg(F.max(F.size("v")), F.count("*"), F.count_if(is_anchor)).first()
    dim = max(dim or 1, 1)
    block = max(64, BLOCK_VALUES // dim)
    size = max(32, min(ANCHORS, -(-n_anchors // (2 * spark.sparkContext.defaultParallelism))))
    blocks, strips = max(1, -(-n_anchors // size)), max(1, -(-n // (block * STRIP)))
    of = lambda count: F.pmod(F.xxhash64("rows"), F.lit(count)).cast("int")

    def packed_anchors(rows: DataFrame) -> DataFrame:
        dealt = _pack(rows.repartition(blocks, F.xxhash64("row")), dim, 2 * size)
        return materialize(dealt).withColumn("block", of(blocks)).withColumn("strips", F.lit(strips))

    # Read twice: written once, a lost executor packs nothing again.
    cands = materialize(_pack(rows, dim, block)).withColumn("strip", of(strips)).withColumn("blocks", F.lit(blocks))
    anchors = rows.where(is_anchor)
    found = _meet(packed_anchors(anchors), cands, "anchor_row long, anchor_id long, positive_id long, positive_score long", _positives(dim))
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last())
    positives = materialize(found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= POSITIVES))
    bars = positives.groupBy("anchor_row").agg(F.collect_set("positive_score").alias("bars"))  # five at most
    barred = anchors.join(bars, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    hits = _meet(packed_anchors(barred), cands, "anchor_row long, positive_score long, negative_id long, negative_score long", _negatives(dim))
    order = Window.partitionBy("anchor_row", "positive_score").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    out = positives.drop("k").join(hits, ["anchor_row", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH given AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.row, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other_id,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM given a JOIN given c ON a.row <> c.row WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT row, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, other_id) AS k
  FROM met WHERE same QUALIFY k <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.other_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.k ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN met n ON p.row = n.row AND NOT n.same
  WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives
"""
