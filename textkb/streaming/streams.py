"""Structured Streaming: incremental library ingest and a monitor of the search log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import key
from ..operators.chapters import split_chapters
from ..operators.clean import cleaned
from ..operators.scratch import materialize
from ..operators.upsert import drop_partition, write_partitions
from ..sources import library


#: A change of one file: ``put`` (new or changed) or ``delete``. ``digest`` tells versions apart, ``at`` orders them.
CHANGE = "path string, op string, digest string, at timestamp"
TOUCHED = "book_name string, paths array<string>"


class BookFiles(StatefulProcessor):
    """The files of one book as state: path -> (digest, time of the last change; a deleted file keeps its time).

    A change gives the book with all its files, in order, if it makes a difference: a version that is known, an older
    change and the deletion of an unknown file make none. Changes of one time are taken deletions first, then by digest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "digest string, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values(["at", "op", "digest"])
        touched = False
        for path, op, digest, at in zip(changes["path"], changes["op"], changes["digest"], changes["at"], strict=True):
            known = self.files.getValue((path,)) if self.files.containsKey((path,)) else None
            digest = None if op == "delete" else digest
            if known is not None and pd.Timestamp(known[1]) > at:
                continue
            self.files.updateValue((path,), (digest, at.to_pydatetime()))
            touched |= digest != (known[0] if known is not None else None)
        if touched:
            paths = sorted(k[0] for k, v in self.files.iterator() if v[0] is not None)
            yield pd.DataFrame({"book_name": [key[0]], "paths": [paths]})

    def close(self) -> None:
        pass


def touched_books(changes: DataFrame, root: str) -> DataFrame:
    """``(book_name, paths)`` of the books that a stream of ``CHANGE`` rows makes a difference to, with all their files."""
    known = changes.where("path is not null and at is not null and op in ('put', 'delete')")
    by_book = library.descriptors(known, root, "path", "op", "digest", "at").select("book_name", "path", "op", "digest", "at").groupBy("book_name")
    return by_book.transformWithStateInPandas(BookFiles(), outputStructType=TOUCHED, outputMode="Update", timeMode="None")


def ingest_library(spark: SparkSession, root: str, table: str, checkpoint: str, changes: str | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Files below ``root`` become cleaned chapters in ``table``; the library is never listed as a whole to build a book.

    New files are noticed by the file source; changed and deleted ones by a log of changes, JSON lines of ``CHANGE`` in
    the folder ``changes`` (what a store's notifications say). The files of each book are kept as state, so a change
    rebuilds its book from all its files and replaces its partition; a book without files loses it. A file that is
    gone before it is read counts as empty. The stream's checkpoint is the manifest: a repeated batch builds the same
    partitions again.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    found = found.option("maxFilesPerTrigger", files_per_batch).load(root)
    events = found.select("path", F.lit("put").alias("op"), F.md5("content").alias("digest"), F.col("modificationTime").alias("at"))
    if changes is not None:
        events = events.unionByName(spark.readStream.schema(CHANGE).json(changes))

    def rebuild(batch: DataFrame, epoch: int) -> None:
        spark, touched = batch.sparkSession, materialize(batch)
        owned = touched.select("book_name", F.explode("paths").alias("path"))
        # Files of the batch's books: Spark lists inputs on the driver. Names hold brackets: they are no patterns.
        paths = [r["path"] for r in owned.select("path").toLocalIterator() if library.is_there(spark, r["path"])]
        if paths:
            read = spark.read.format("binaryFile").option("__globPaths__", "false").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
            books = cleaned(library.merged(library.texts(read.load(paths).select("path", "content")).join(owned, "path")), "book_name")
            rows = split_chapters(books, "book_name").withColumn("id", key("book_name", "chapter_idx", "slice_no")).withColumn("seq", F.lit(epoch))
            write_partitions(materialize(rows), table, "book_name")
        for r in touched.where(F.size("paths") == 0).toLocalIterator():
            drop_partition(spark, table, "book_name", r["book_name"])

    return touched_books(events, root).writeStream.outputMode("update").foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(log: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Searches by window and type; on a stream, rows later than ``late`` are left out and state is bounded."""
    rows = log.withWatermark(time, late) if log.isStreaming else log
    counts = rows.groupBy(F.window(time, width), kind).agg(F.count("*").alias("searches"))
    return counts.select(F.col("window.start").alias("start"), kind, "searches")


def monitor(spark: SparkSession, folder: str, schema: str, id_column: str = "event_id", time: str = "ts", **options) -> DataFrame:
    """Streaming twin of ``windowed_counts`` over a folder of Parquet files, repeated ids dropped."""
    log = spark.readStream.schema(schema).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))
    once = log.withWatermark(time, options.get("late", "1 hour")).dropDuplicatesWithinWatermark([id_column])
    counts = once.groupBy(F.window(time, options.get("width", "1 hour")), options.get("kind", "event_type")).agg(F.count("*").alias("searches"))
    return counts.select(F.col("window.start").alias("start"), options.get("kind", "event_type"), "searches")
