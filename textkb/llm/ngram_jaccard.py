"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two documents link when
``100 * |A & B| >= percent * |A | B|``. Plan, each step linear in the text unless said:

1. *Rarity sketch.* Tasks count n-grams into ``2**SKETCH_BITS`` buckets; the buckets are added up
   by Spark and broadcast (size fixed by the parameter). ``(bucket count, hash)`` is one total order
   over all n-grams, rare first. Its quality affects speed, never results.
2. *Classes.* Documents with equal sets form a class (id: hash of the sorted set). Everything from
   here on is about classes, so exact copies cost one row each, not pairs.
3. *Prefixes.* In rare-first order a set of n keeps its first ``n - ceil(n*t) + 1`` n-grams: two
   sets that link share one of those. They are shuffled on the n-gram; n-grams of one class drop out.
4. *Candidates.* Partners with the n-gram in common pass the length filter (``t*|B| <= |A|``), the
   positional filter (what can still follow in both sets reaches the needed overlap) and the suffix
   filter, all inside the join: the parities of the sets' members by hash bucket bound their symmetric
   difference from below. Pairs that are left are made distinct and verified once: bisecting both
   sets by pivots bounds the overlap again, then it is counted.
5. *Components.* Each n-gram first proposes, for each class, only its neighbour and the head of its
   list, and each class checks its most frequent partner. What these links join needs no further
   check, so a group of thousands of near copies costs thousands of checks, not millions. Then
   *every* candidate pair across different components is checked: no link between components is
   lost. ``similar_pairs`` gives all links instead.
6. *Hot lists.* Where more than ``HEAVY`` classes in several components share an n-gram, the classes outside the
   list's largest component meet all of its classes in cells of ``BLOCK`` x ``BLOCK`` postings, salted over tasks; lists of
   more than a block are cut into bands of set sizes first. Only sizes, positions and parities are sent there, never sets.
   A cell applies the filters to all its pairs at once. Where more are left than ``CELL_PAIRS`` a posting, it gives back the
   most similar partner of each class; those that link are joined first, and the cells are asked again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (
    U64, bounded_batches, discard, materialize, mix64, slices, table, unique_names, utf8, word_hashes, words,
)
from .components import components

SKETCH_BITS = 20
SKETCH_CHUNKS = 64
# Bits of the filter that tells which documents' sets are wanted again: as many as its ids ask for, 32 MB at most.
FILTER_BITS, FILTER_BITS_EACH, FILTER_PIECES = range(18, 29), 16, 64
SIGNATURE_LONGS = 8
SIGNATURE = [f"sig{i}" for i in range(SIGNATURE_LONGS)]
HEAVY = 64  # classes of one n-gram from which pairs are made in blocks instead of rows
BLOCK = 2048  # postings on each side of such a block
CELL_PAIRS = 4  # candidate pairs for each posting that a block gives back at once
NGRAM, PERCENT = 5, 80


# --- sets -------------------------------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of all rows, and the len+1 offsets of each row's.

    Fewer words than ``n``: the whole sequence is the one n-gram. No words: none.
    """
    s, e, row = words(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    if len(s) == 0:
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    with np.errstate(over="ignore"):
        h = word_hashes(data, s, e)
        at = np.concatenate([[0], np.cumsum(count)])
        grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        out_at = np.concatenate([[0], np.cumsum(grams)])
        owner = np.repeat(np.arange(rows), grams)
        first = at[:-1][owner] + (np.arange(out_at[-1]) - out_at[:-1][owner])
        length = np.minimum(count, n)[owner]
        total = length.astype(np.uint64) * U64(0x632BE59BD9B4E019)
        padded = np.concatenate([h, np.zeros(n, np.uint64)])
        for j in range(n):
            term = mix64(padded[first + j] + U64((2 * j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            total = mix64(total + np.where(j < length, term, U64(0)))
    return total, out_at


def sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of each row of a batch with ``doc_id, text``."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    for a, b in slices(offsets):
        grams, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
        for i in range(b - a):
            yield a + i, np.unique(grams[at[i] : at[i + 1]])


def class_id(unique: np.ndarray) -> int:
    """Signed 64-bit id of a set: hash of its sorted members."""
    if not len(unique):
        return 0
    with np.errstate(over="ignore"):
        place = np.arange(1, len(unique) + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93)
        total = np.add.reduce(mix64(unique ^ mix64(place)))
    return int(mix64(np.array([total + U64(len(unique))]))[0].astype(np.int64))


def parity_signature(unique: np.ndarray) -> np.ndarray:
    """Parity of the number of members in each of 64 * SIGNATURE_LONGS hash buckets, as longs.

    A member of only one of two sets flips one bit of their XOR, so its bits are at most the size of
    the symmetric difference.
    """
    bits = 64 * SIGNATURE_LONGS
    odd = np.bincount((mix64(unique) % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """One pass: a row ``(doc_id, size, cls, sig0..)`` per document and, at a task's end, its sketch chunks."""
    names = ["doc_id", "size", "cls", *SIGNATURE, "chunk", "counts"]
    schema = ", ".join(f"{c} long" for c in names[:-2]) + ", chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        mask = U64((1 << SKETCH_BITS) - 1)
        pending, waiting, seen = [], 0, False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            size, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            signature = np.zeros((batch.num_rows, SIGNATURE_LONGS), np.int64)
            for i, unique in sets(batch, n):
                size[i], cls[i], signature[i] = len(unique), class_id(unique), parity_signature(unique)
                pending.append((unique & mask).astype(np.int64))
                waiting += len(unique)
                if waiting > 1 << 20:
                    sketch += np.bincount(np.concatenate(pending), minlength=len(sketch))
                    pending, waiting = [], 0
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(cls), *map(pa.array, signature.T.copy()), none.cast(pa.int32()), none.cast(pa.binary())], names
            )
        if pending:
            sketch += np.bincount(np.concatenate(pending), minlength=len(sketch))
        if seen:
            none = pa.nulls(SKETCH_CHUNKS, pa.int64())
            chunks = np.minimum(sketch, 2**31 - 1).astype(np.int32).reshape(SKETCH_CHUNKS, -1)
            yield pa.RecordBatch.from_arrays(
                [none] * (len(names) - 2) + [pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array([c.tobytes() for c in chunks])], names
            )

    return docs.mapInArrow(run, schema)


def _summed_sketch(chunks: DataFrame) -> np.ndarray:
    """Add the tasks' sketches chunk by chunk (streamed, one chunk in memory); 2**SKETCH_BITS counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(raw, np.int32).astype(np.int64)
                totals[c] = totals[c] + one if c in totals else one
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in totals.values()], pa.binary())],
            ["chunk", "counts"],
        )

    rows = chunks.repartition(SKETCH_CHUNKS, "chunk").mapInArrow(run, "chunk int, counts binary").collect()
    sketch = np.zeros((SKETCH_CHUNKS, (1 << SKETCH_BITS) // SKETCH_CHUNKS), np.int32)
    for r in rows:
        sketch[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.int32)
    return sketch.ravel()


def rare_first(unique: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the one global order: by sketch count, ties by hash."""
    return unique[np.lexsort((unique, sketch[(unique & U64(len(sketch) - 1)).astype(np.int64)]))]


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def _prefixes(docs: DataFrame, sketch, n: int, percent: int) -> DataFrame:
    """``(gram, cls, size, pos)``: the rare-first prefix of each class, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sketch.value, set()
        for batch in batches:
            grams, sizes, cls = [], [], []
            for _, unique in sets(batch, n):
                c = class_id(unique)
                if len(unique) == 0 or c in seen:
                    continue
                seen.add(c)
                keep = prefix_length(len(unique), percent)
                grams.append(rare_first(unique, order)[:keep])
                sizes.append(len(unique))
                cls.append(c)
            if not grams:
                continue
            lengths = np.array([len(g) for g in grams])
            ends = np.cumsum(lengths)
            pos = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(grams).view(np.int64)),
                    pa.array(np.repeat(np.array(cls, np.int64), lengths)),
                    pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    pa.array(pos.astype(np.int32)),
                ],
                ["gram", "cls", "size", "pos"],
            )

    return docs.mapInArrow(run, "gram long, cls long, size int, pos int")


def _wanted_sets(docs: DataFrame, wanted, n: int) -> DataFrame:
    """``(holder, grams)`` of the documents whose id passes the bit filter (a superset is harmless)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = (mix64(ids.view(np.uint64)) & U64(8 * len(bits) - 1)).astype(np.int64)
            keep = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if not len(keep):
                continue
            holders, grams = [], []
            for k, unique in sets(batch.take(pa.array(keep)), n):
                holder = int(ids[keep[k]])
                if len(unique) and holder not in seen:
                    seen.add(holder)
                    holders.append(holder)
                    grams.append(unique.tobytes())
            if holders:
                yield pa.RecordBatch.from_arrays([pa.array(holders, pa.int64()), pa.array(grams, pa.binary())], ["holder", "grams"])

    return docs.mapInArrow(run, "holder long, grams binary")


def _bit_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A bitmap over the hashes of about ``n`` ids; each piece of it is made from the ids that fall into it."""
    log = min(max(int(np.ceil(np.log2(max(n, 1) * FILTER_BITS_EACH))), FILTER_BITS[0]), FILTER_BITS[-1])
    size = (1 << log) // FILTER_PIECES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & U64((1 << log) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32))], ["piece", "place"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(piece).tolist():
                out.setdefault(p, np.zeros(size, bool))[place[piece == p]] = True
        packed = [np.packbits(v, bitorder="little").tobytes() for v in out.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(packed, pa.binary())], ["piece", "bits"])

    rows = ids.mapInArrow(deal, "piece int, place int").repartition(FILTER_PIECES, "piece").mapInArrow(mark, "piece int, bits binary")
    bits = np.zeros((FILTER_PIECES, size // 8), np.uint8)
    for r in rows.collect():  # 32 MB at most
        bits[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.ravel()


# --- filters and verification --------------------------------------------------------------------


def needed_overlap(a: int, b: int, percent: int) -> int:
    """Smallest overlap o with 100*o >= percent*(a+b-o)."""
    return -(-percent * (a + b) // (100 + percent))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of |x & y| of two sorted sets: bisect both by a pivot, add the smaller sides."""
    if depth == 0 or len(x) == 0 or len(y) == 0:
        return min(len(x), len(y))
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    need = needed_overlap(len(x), len(y), percent)
    if min(len(x), len(y)) < need or suffix_bound(x, y) < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _passes(percent: int, sa: str, pa_: str, sb: str, pb: str) -> F.Column:
    """Length and positional filter on one shared n-gram (positions count from 0)."""
    need = F.ceil(F.lit(percent) * (F.col(sa) + F.col(sb)) / F.lit(100 + percent))
    length = (F.col(sa) * 100 >= F.col(sb) * percent) & (F.col(sb) * 100 >= F.col(sa) * percent)
    return length & (F.least(F.col(sa) - F.col(pa_), F.col(sb) - F.col(pb)) >= need)


def _verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """``(a, b, ok)`` for each distinct candidate pair with its holders ``ha, hb``: bounds, then the exact count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [
                linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent)
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    side = lambda end, name: grams.select(F.col("holder").alias(end), F.col("grams").alias(name))
    joined = pairs.join(side("ha", "x"), "ha").join(side("hb", "y"), "hb").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, ok boolean")


def block_links(x_sets: list[np.ndarray], y_sets: list[np.ndarray], percent: int, width: int = 8192) -> np.ndarray:
    """Which x and y link, as a boolean matrix; overlaps are counted by products of 0/1 blocks. No step of the join needs it
    since hot lists meet without sets; the tests hold ``linked`` against it."""
    nx, ny = np.array([len(v) for v in x_sets]), np.array([len(v) for v in y_sets])
    shared = np.intersect1d(np.unique(np.concatenate(x_sets)), np.unique(np.concatenate(y_sets)), assume_unique=True)
    overlap = np.zeros((len(nx), len(ny)), np.float32)

    def places(sets_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), [len(v) for v in sets_])
        at = np.searchsorted(shared, flat)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == flat[hit]
        return owner[hit], at[hit]

    (xo, xa), (yo, ya) = places(x_sets), places(y_sets)
    for begin in range(0, len(shared), width):
        left, right = np.zeros((len(nx), width), np.float32), np.zeros((len(ny), width), np.float32)
        for m, o, a in ((left, xo, xa), (right, yo, ya)):
            k = (a >= begin) & (a < begin + width)
            m[o[k], a[k] - begin] = 1
        overlap += left @ right.T
    return overlap * (100 + percent) >= percent * (nx[:, None] + ny[None, :])


def slack(x: dict[str, np.ndarray], y: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """By how much the parities of x and y (columns of postings of one n-gram) differ less than those of linked sets may, as a
    matrix; -1 where the length filter, the positional filter or the parities rule the pair out."""
    out = np.empty((len(x["size"]), len(y["size"])), np.int32)
    bits = [(x[c].view(np.uint64), y[c].view(np.uint64)) for c in SIGNATURE]  # of negative numbers bits are not counted
    ny, after = y["size"][None, :], (y["size"] - y["pos"])[None, :]
    for a in range(0, len(out), 128):
        nx = x["size"][a : a + 128, None]
        need = -(-percent * (nx + ny) // (100 + percent))
        ok = (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & (np.minimum(nx - x["pos"][a : a + 128, None], after) >= need)
        differing = sum(np.bitwise_count(u[a : a + 128, None] ^ v[None, :]).astype(np.int32) for u, v in bits)
        out[a : a + 128] = np.where(ok, np.maximum(nx + ny - 2 * need - differing, -1), -1)
    return out


def cell_pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray], percent: int, whole: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the candidate pairs of a cell of one n-gram, and whether there are more: then only the most similar partner
    of each class is given. Pairs inside a component are none; a pair of two classes that both stand in x is met once."""
    left = slack(x, y, percent)
    left[(x["component"][:, None] == y["component"][None, :]) | (~y["main"][None, :] & (x["cls"][:, None] >= y["cls"][None, :]))] = -1
    i, j = np.nonzero(left >= 0)
    if whole or len(i) <= CELL_PAIRS * (len(left) + left.shape[1]):
        return i, j, False
    by_x, by_y = np.stack([np.arange(len(left)), left.argmax(axis=1)]), np.stack([left.argmax(axis=0), np.arange(left.shape[1])])
    i, j = np.unique(np.concatenate([by_x[:, left.max(axis=1) >= 0], by_y[:, left.max(axis=0) >= 0]], axis=1), axis=1)
    return i, j, True


# --- the join -----------------------------------------------------------------------------------


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls"))


class _Join:
    """The tables that both results need: members, signatures, shared prefix postings, first candidates."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        if n < 1 or not 0 < percent <= 100:
            raise ValueError("n must be positive and percent in 1..100")
        spark, self.n, self.percent = docs.sparkSession, n, percent
        bounded_batches(spark)
        self.docs = docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        described = materialize(_described(docs, n))
        self.members = described.where("chunk is null").select("doc_id", "size", "cls")
        self.signatures = described.where("chunk is null and size > 0").select("cls", *SIGNATURE)
        sketch = spark.sparkContext.broadcast(_summed_sketch(described.where("chunk is not null").select("chunk", "counts")))
        ordered = Window.partitionBy("gram").orderBy("size", "cls")
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # Equal sets of several tasks stand together in this order, and the first of them is kept. The two
        # candidates of each posting come from the same sort, so the postings are shuffled once.
        distinct = F.coalesce(F.lag("cls").over(ordered) != F.col("cls"), F.lit(True))
        heads = {c: F.first(c).over(ordered) for c in ("cls", "size", "pos")}
        before = {c: F.lag(c).over(ordered) for c in ("cls", "size", "pos")}
        shared = (
            _prefixes(docs, sketch, n, percent)
            .withColumns({"lo": F.min("cls").over(whole), "hi": F.max("cls").over(whole), "distinct": distinct})
            .withColumns({f"f_{c}": v for c, v in heads.items()} | {f"p_{c}": v for c, v in before.items()})
            .where("lo < hi and distinct")
            .select("gram", "cls", "size", "pos", *(self._candidate(k).alias(k) for k in ("head", "previous")))
        )
        self.shared = materialize(shared)
        both = self.shared.select("cls", F.explode(F.array("head", "previous")).alias("a")).where("a is not null")
        near = both.groupBy(F.col("cls").alias("b"), "a").count()
        self.proposed = materialize(near)

        self.holders = materialize(self.members.where("size > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("holder")))

    def _sets_of(self, classes: DataFrame) -> DataFrame:
        """``(holder, grams)`` for the given classes: texts are read again, and a bit filter over the ids of
        their holders (a class's smallest document) keeps the others from being taken apart. The few
        that pass by chance are rows of documents that hold no pair, and match nothing."""
        spark = self.docs.sparkSession
        wanted = materialize(self.holders.join(classes.distinct(), "cls", "left_semi").select("holder"))
        bits = spark.sparkContext.broadcast(_bit_filter(wanted, wanted.count()))
        return materialize(_wanted_sets(self.docs.where("doc_id is not null"), bits, self.n))

    def _candidate(self, which: str) -> F.Column:
        """The class of the list's first (or of the previous) posting, if the pair passes the filters."""
        k = which[0] if which == "previous" else "f"
        ok = (F.col(f"{k}_cls") != F.col("cls")) & _passes(self.percent, f"{k}_size", f"{k}_pos", "size", "pos")
        return F.when(ok, F.col(f"{k}_cls"))

    def _signed(self, postings: DataFrame) -> DataFrame:
        """The postings with the parity signatures of their sets beside them."""
        classes = self.signatures.join(postings.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
        return materialize(postings.join(classes, "cls").select("gram", "cls", "size", "pos", "component", *SIGNATURE))

    def _crossing(self, postings: DataFrame) -> DataFrame:
        """Every candidate pair of postings in different components. The parity signatures of the sets
        stand beside the postings, so pairs too far apart never leave the join."""
        names = ["cls", "size", "pos", "component", *SIGNATURE]
        postings = self._signed(postings)
        x = postings.select("gram", *(F.col(c).alias(f"x_{c}") for c in names)).alias("x")
        y = postings.select("gram", *(F.col(c).alias(f"y_{c}") for c in names)).alias("y")
        differing = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in SIGNATURE), F.lit(0))
        sizes = F.col("x_size") + F.col("y_size")
        need = F.ceil(F.lit(self.percent) * sizes / F.lit(100 + self.percent))
        return (
            x.join(
                y,
                (F.col("x.gram") == F.col("y.gram"))
                & (F.col("x_cls") < F.col("y_cls"))
                & (F.col("x_component") != F.col("y_component"))
                & _passes(self.percent, "x_size", "x_pos", "y_size", "y_pos")
                & (differing <= sizes - 2 * need),
            )
            .select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b"))
            .distinct()
        )

    def _hot_cells(self, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two sides of the cells ``gram, band, i, j`` in which the signed postings of one n-gram meet."""
        percent, columns = self.percent, ["cls", "size", "pos", "component", *SIGNATURE]
        lists = postings.groupBy("gram", "component").count().groupBy("gram").agg(
            F.max_by("component", F.struct("count", "component")).alias("main_component"), F.sum("count").alias("n")
        )
        # Linked sets are at most one band apart: its width is a little more than their ratio of sizes.
        band = F.floor(F.log("size") / F.lit(float(np.log(101 / percent)))).cast("int")
        long = F.col("n") > BLOCK
        rows = postings.join(lists.where("n > 1"), "gram").withColumn("main", F.col("component") == F.col("main_component"))
        rows = rows.withColumn("band", F.when(long, band).otherwise(0))
        near = F.when(long, F.array(*(F.col("band") + k for k in (-1, 0, 1)))).otherwise(F.array("band"))
        x = rows.where("not main").drop("main")
        y = rows.withColumn("band", F.explode(near))
        keys = ["gram", "band"]
        count = lambda side, k: side.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias(k))
        sizes = materialize(count(x, "kx").join(count(y, "ky"), keys))
        place = lambda k, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(k))
        every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
        named = lambda cols: [F.col(c).alias(c) for c in cols]
        x = x.join(sizes, keys).select(*named(keys), place("kx", 1).alias("i"), every("ky").alias("j"), *named(columns))
        y = y.join(sizes, keys).select(*named(keys), every("kx").alias("i"), place("ky", 2).alias("j"), *named([*columns, "main"]))
        return x, y

    def _hot_pairs(self, postings: DataFrame, whole: bool) -> DataFrame:
        """``(a, b, cut)``: candidate pairs of signed postings in different components, made list by list and cell by cell;
        ``cut`` where a cell holds more of them (never if ``whole``)."""
        percent = self.percent
        x, y = self._hot_cells(postings)

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            a = b = np.empty(0, np.int64)
            cut = False
            if left.num_rows and right.num_rows:
                read = lambda t: {c: t[c].to_numpy() for c in t.column_names}
                one, other = read(left), read(right)
                i, j, cut = cell_pairs(one, other, percent, whole)
                a, b = one["cls"][i], other["cls"][j]
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cut": np.full(len(a), cut)})

        keys = ["gram", "band", "i", "j"]
        return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(cell, "a long, b long, cut boolean")

    def _check(self, pairs: DataFrame) -> DataFrame:
        """``(a, b, ok)`` for the candidate pairs; the sets taken for it are given up at once."""
        grams = self._sets_of(_ends(pairs))
        end = lambda c: self.holders.select(F.col("cls").alias(c), F.col("holder").alias(f"h{c}"))
        checked = materialize(_verified(pairs.join(end("a"), "a").join(end("b"), "b"), grams, self.percent))
        discard(grams)
        return checked

    def class_components(self) -> DataFrame:
        pairs = self.proposed.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        tested = self._check(pairs)
        comps = materialize(components(tested.where("ok"), "a", "b"))
        postings = self._open_postings(comps).withColumn("n", F.count("*").over(Window.partitionBy("gram")))
        postings = materialize(postings)
        pairs = self._crossing(postings.where(F.col("n") <= HEAVY)).withColumn("cut", F.lit(False))
        hot, whole = None, False
        if postings.where(F.col("n") > HEAVY).take(1):
            hot = self._signed(postings.where(F.col("n") > HEAVY))
            pairs = pairs.unionByName(self._hot_pairs(hot, whole))
        while True:
            found = materialize(pairs.groupBy("a", "b").agg(F.max("cut").alias("cut")))
            cut = bool(found.where("cut").take(1))
            fresh = materialize(found.select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti"))
            if not fresh.take(1) and not cut:
                return comps
            checked = self._check(fresh)
            tested = tested.unionByName(checked)
            comps = materialize(components(tested.where("ok"), "a", "b"))
            if not cut:
                return comps
            # As long as a good part of what is given back are links, components melt away and pairs with them.
            whole = 4 * checked.where("ok").count() <= checked.count()
            joined = hot.drop("component").join(comps.withColumnRenamed("vertex", "cls"), "cls", "left")
            pairs = self._hot_pairs(materialize(joined.withColumn("component", F.coalesce("component", "cls"))), whole)

    def _open_postings(self, comps: DataFrame | None) -> DataFrame:
        """Postings of the n-grams whose classes are not yet all in one component."""
        shared = self.shared.drop("head", "previous")
        if comps is None:
            return shared.withColumn("component", F.col("cls"))
        w = Window.partitionBy("gram")
        return (
            shared.join(comps.withColumnRenamed("vertex", "cls"), "cls", "left")
            .withColumn("component", F.coalesce("component", "cls"))
            .withColumns({"lo": F.min("component").over(w), "hi": F.max("component").over(w)})
            .where("lo < hi")
            .drop("lo", "hi")
        )


def jaccard_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs`` (columns ``doc_id``, ``text``).

    ``component_id`` is the smallest doc_id reachable by links, the document's own included.
    Null or blank texts have an empty set and link with nothing; rows with a null doc_id are given
    back with a null component; repeated rows are given back as often as they come; an empty table
    gives none. Other columns of ``docs`` are ignored.
    """
    j = _Join(docs, n, percent)
    comps = j.class_components()
    named = j.members.where("size > 0").groupBy("cls").agg(F.min("doc_id").alias("own"))
    named = named.join(comps.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("own").alias("low"))
    names = named.join(lowest, "component").select("cls", "low")
    full = j.members.where("size > 0").join(names, "cls", "left")
    empty = j.members.where("size = 0").withColumn("low", F.col("doc_id"))
    out = full.select("doc_id", "size", "low").unionByName(empty.select("doc_id", "size", "low"))
    return out.select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("low")).alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, with all its columns.

    Rows with a null doc_id have no place in that order and stay. Where an id is repeated, the row with the
    smallest text stays (of equal texts any, they are told apart by nothing that counts here). The ids that
    go are a table of their own: where it is small Spark sends it to the texts, else both sides are shuffled.
    """
    found = materialize(jaccard_components(docs, n, percent))
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
    ids = found.where("doc_id is not null").select("doc_id")
    if ids.groupBy("doc_id").count().where("count > 1").take(1):
        (place,) = unique_names(docs.columns, "place_of_id")
        w = Window.partitionBy("doc_id").orderBy("text")
        known = docs.where("doc_id is not null").withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)
        docs = known.unionByName(docs.where("doc_id is null"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def similar_pairs(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links ``(a, b)`` between classes of equal sets, and membership ``(doc_id, size, cls)``.

    Null, empty and blank texts have an empty set and no class; rows of equal sets (repeated rows too) are one class; a
    null id is a member with a null id; texts are taken whole; an empty table gives no rows; other columns are ignored.
    """
    j = _Join(docs, n, percent)
    pairs = materialize(j._crossing(j._open_postings(None)))
    return j._check(pairs).where("ok").select("a", "b"), j.members


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(32))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(32)))) END AS grams FROM worded
), sizes AS (SELECT doc_id, len(grams)::BIGINT AS n FROM sets),
grams AS (SELECT doc_id, unnest(grams) AS g FROM sets),
counted AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM counted JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, low) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT b, low FROM reach JOIN both_ways ON doc_id = a WHERE low < b)
SELECT doc_id, any_value(n) AS n_shingles, min(low) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""
