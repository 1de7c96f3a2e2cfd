"""Shared plumbing of the training-data operators: tables, folds, Arrow text access, shared scratch.

Conventions that hold for every operator in this subpackage:

* Python work runs in ``mapInArrow`` tasks that walk a batch in slices of bounded size, so a
  task's memory follows the slice (or the longest single text), never the partition.
* What is sent to every executor (a model, a sketch, a filter) has a size fixed by parameters.
* Lineage is cut with a table in the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and TAB, LF, VT, FF, CR. Everything else belongs to a word.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a task looks at; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch, whichever is reached first: what bounds a task's memory.
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: a text may be long, so bytes count and not rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the test fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, one machine (a local master) takes a
    temporary folder; on a cluster that is an error, as executors and driver share no other folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/textkb-{uuid.uuid4().hex}"


#: Whether the shuffle files of an execution go when it ends; else they stay until the driver happens to collect garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost no recomputation, and the shuffle
    files behind it are given up."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` gave back; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.materialized_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sample_fraction(n: int, bound: int) -> float:
    return 1.0 if n <= bound else bound / n


def hash_unit(*cols: Column | str, seed: str = "") -> Column:
    """A number in [0, 1) that depends on the values alone (32 bits of an MD5)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N")) for c in cols]
    text = F.concat_ws("\x1f", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def unique_names(existing: list[str], *wanted: str) -> list[str]:
    """Working column names that do not clash with what the input already has."""
    taken, out = {c.lower() for c in existing}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --- Arrow text access -------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row comes alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                step = np.full(size, U64(base))
                step[0] = U64(1)
                _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every word. No word crosses a row."""
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    inside = ~_IS_SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word (A-Z lowered if asked), independent of where the word stands."""
    with np.errstate(over="ignore"):
        up, down = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[_ASCII_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
        return mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


# --- characters ----------------------------------------------------------------------------------

SPACE = 32
_LOWER = np.arange(0x10000, dtype=np.uint32)
_LETTER = np.zeros(0x10000, bool)
for _c in range(0x10000):
    _s = chr(_c)
    if _s.isalpha():
        _LETTER[_c] = True
        _low = _s.lower()
        if len(_low) == 1 and ord(_low) < 0x10000:
            _LOWER[_c] = ord(_low)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the rows, and their offsets; broken UTF-8 is replaced."""
    try:
        text = data.tobytes().decode("utf-8")
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = begins[offsets]
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, at = "".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), at.astype(np.int64)


def letters_only(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with a space for every other character, and where letters stand."""
    low = np.minimum(cp, 0xFFFF).astype(np.int64)
    letter = _LETTER[low]
    out = np.where(letter, _LOWER[low], np.uint32(SPACE))
    beyond = np.flatnonzero(cp > 0xFFFF)
    if len(beyond):
        for i in beyond:
            c = chr(cp[i])
            letter[i] = c.isalpha()
            out[i] = cp[i] if letter[i] else SPACE
    return out, letter


def char_ngrams(cp: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], inner: np.ndarray | None = None):
    """For each order the hashes (64 bits) and the rows of all character n-grams of the rows.

    Each row is padded with a space on both sides, and no n-gram crosses a row. With ``inner`` (True
    where a character may stand inside an n-gram) others may only be its first or last character.
    """
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(len(cp) + 2 * rows, SPACE, np.uint32)
    owner = np.repeat(np.arange(rows), lengths + 2)
    place = np.arange(len(cp)) + 1 + 2 * np.repeat(np.arange(rows), lengths)
    padded[place] = cp
    ok = np.zeros(len(padded), bool)
    ok[place] = True if inner is None else inner
    value = mix64(padded.astype(np.uint64) + U64(0xA0761D6478BD642F))
    n, total, out, inside = len(padded), None, {}, None
    with np.errstate(over="ignore"):
        for j in range(max(orders)):
            factor = U64(pow(0xE7037ED1A0B428DB, j + 1, 1 << 64))
            m = max(n - j, 0)
            total = value[:m] * factor if total is None else total[:m] + value[j:] * factor
            if j >= 2:  # characters 1 .. j-1 lie inside
                step = ok[j - 1 : j - 1 + m]
                inside = step if inside is None else inside[:m] & step
            if j + 1 in orders and m:
                keep = owner[:m] == owner[j:]
                if inside is not None:
                    keep = keep & inside[:m]
                at = np.flatnonzero(keep)
                out[j + 1] = (total[at] + U64(j), owner[at])
            elif j + 1 in orders:
                out[j + 1] = (np.empty(0, np.uint64), np.empty(0, np.int64))
    return out
