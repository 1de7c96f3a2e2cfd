"""Search of saved tables by parts of a text without reading all files: a Bloom filter of trigrams for each part of a file.

A LIKE pattern's literal runs of three characters or more are trigrams that a matching row must hold, so files
whose filters lack one of them are not opened; the rest are filtered as usual. The index may be older
than the table: files it does not know are read, files that are gone are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search as S

#: Bits for each distinct trigram of a part of a file, and probes.
BITS_EACH, PROBES = 10, 4
#: Distinct trigrams after which a part gets a row of its own: bounds a task's memory and a row's size.
MOST = 1 << 20
_UPPER = {c: c + 32 for c in range(65, 91)}
U64 = np.uint64


def _trigrams(text: str) -> np.ndarray:
    """The distinct trigrams (of code points, A to Z folded) as numbers."""
    c = np.frombuffer(text.translate(_UPPER).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << U64(42) | c[1:-1] << U64(21) | c[2:]) if len(c) > 2 else np.empty(0, U64)


def _places(trigrams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        h = trigrams * U64(0x9E3779B97F4A7C15)
        h = (h ^ h >> U64(29)) * U64(0xBF58476D1CE4E5B9)
        low, high = h & U64(0xFFFFFFFF), h >> U64(32) | U64(1)
        for k in range(PROBES):
            yield (low + U64(k) * high) % U64(bits)


def _filter(trigrams: np.ndarray) -> bytes:
    on = np.zeros(max(64, len(trigrams) * BITS_EACH), bool)
    for at in _places(trigrams, len(on)):
        on[at] = True
    return np.packbits(on).tobytes()


def _holds(packed: bytes, trigrams: np.ndarray, bits: int) -> bool:
    on = np.frombuffer(packed, np.uint8)
    return all((on[(at >> U64(3)).astype(np.int64)] >> (U64(7) - (at & U64(7))).astype(np.uint8) & 1).all() for at in _places(trigrams, bits))


def build(table: DataFrame, columns: Sequence[str], path: str) -> None:
    """Index the given columns of a table that was read from files; null texts hold nothing, long ones are walked in whole."""
    columns = list(columns)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def row(file: str) -> pa.RecordBatch:
            found = held.pop(file)
            arrays = [pa.array([file]), pa.array([max(64, len(found) * BITS_EACH)], pa.int64()), pa.array([_filter(found)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["file", "bits", "filter"])

        for batch in batches:
            fresh: dict[str, list] = {}
            files = batch[0].to_pylist()
            for column in batch.columns[1:]:
                for file, text in zip(files, column.to_pylist(), strict=True):
                    fresh.setdefault(file, []).append(_trigrams(text or ""))
            for file, found in fresh.items():
                held[file] = np.unique(np.concatenate([held.get(file, np.empty(0, U64)), *found]))
                if len(held[file]) >= MOST:
                    yield row(file)
        for file in list(held):
            yield row(file)

    texts = table.select(F.col("_metadata.file_path").alias("_file"), *(F.col(c).cast("string") for c in columns))
    texts.mapInArrow(parts, "file string, bits long, filter binary").write.mode("overwrite").parquet(path)


def wanted(value: str) -> np.ndarray:
    """Trigrams that every text LIKE ``%value%`` holds; wildcards part the literal runs."""
    runs = [_trigrams(run) for run in re.split("[%_]", value)]
    return np.unique(np.concatenate(runs))


def files(spark: SparkSession, table: str, index: str, value: str) -> list[str]:
    """The files of the saved table that may hold the value: those whose filter has all its trigrams, or that have none."""
    given = spark.read.parquet(table).inputFiles()
    need = wanted(value)
    if not len(need):
        return given

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["bits"].to_pylist(), batch["filter"].to_pylist(), strict=True)
            fits = [_holds(packed, need, bits) for bits, packed in rows]
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(fits, pa.bool_())], ["file", "fits"])

    judged = spark.read.parquet(index).mapInArrow(keep, "file string, fits boolean").groupBy("file").agg(F.bool_or("fits").alias("fits"))
    out = {r["file"] for r in judged.where("not fits").select("file").toLocalIterator()}
    same = lambda f: re.sub("^file:/+", "/", f)  # noqa: E731 (the two ways that local paths are written)
    out = {same(f) for f in out}
    return [f for f in given if same(f) not in out]


def like(spark: SparkSession, table: str, index: str, columns: Sequence[str], value: str) -> DataFrame:
    """Rows of the saved table in which any of the (indexed) columns is LIKE ``%value%``; see ``search.like``."""
    whole = spark.read.parquet(table)
    some = files(spark, table, index, value)
    # Files are told with their names encoded, and names may hold brackets: they are no patterns.
    read = spark.read.option("basePath", table).option("__globPaths__", "false").schema(whole.schema)
    rows = read.parquet(*map(unquote, some)) if some else whole.limit(0)
    return S.like(rows, columns, value)
