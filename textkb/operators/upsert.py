"""Keyed writes: REPLACE, IGNORE and vector upserts, incremental work and progress.

A batch is one DataFrame with an order column; existing rows count as the earliest batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import one_per_key
from .scratch import materialize


def replaced(rows: DataFrame, key: str, batch: str, seq: str) -> DataFrame:
    """Last write wins, across batches and inside one."""
    return one_per_key(rows, [key], [batch, seq], first=False)


def ignored(rows: DataFrame, key: str, batch: str, seq: str) -> DataFrame:
    """First write wins."""
    return one_per_key(rows, [key], [batch, seq], first=True)


def vector_upserted(rows: DataFrame, key: str, batch: str, seq: str) -> DataFrame:
    """The latest batch wins, and inside it the first row of a key."""
    w = Window.partitionBy(key).orderBy(F.col(batch).desc(), F.col(seq).asc())
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def new_only(rows: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``rows`` hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def drop_partition(spark: SparkSession, path: str, by: str, value: str) -> None:
    """Remove the partition of one value from a saved table, if it is there."""
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = jvm.org.apache.hadoop.fs.Path(path, f"{by}={escape(value)}")
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def upsert_table(rows: DataFrame, path: str, key: str, by: str, seq: str, ignore: bool = False, merge=None) -> None:
    """Keyed upsert into a partitioned table: only the touched partitions are read and written again.

    ``merge`` (default: REPLACE, or IGNORE) makes one row of each key from old rows (``_batch`` 0) and new ones
    (1). The merged rows are written to the shared folder first, since they read the partitions they replace.
    """
    spark = rows.sparkSession
    fresh = rows.withColumn("_batch", F.lit(1))
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:  # no table yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        old = None
    if old is not None:
        touched = rows.select(by).distinct()
        fresh = old.join(touched, by, "left_semi").withColumn("_batch", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    merged = (merge or (ignored if ignore else replaced))(fresh, key, "_batch", seq).drop("_batch")
    write_partitions(materialize(merged), path, by)


def append_log(rows: DataFrame, path: str, query: str = "query_text", limit: int = 500) -> None:
    rows.withColumn(query, F.substring(query, 1, limit)).write.mode("append").parquet(path)


def migrated(df: DataFrame, quality: str = "writing_quality", default: int = 5) -> DataFrame:
    """Tables from before the quality column get it with its default."""
    return df.withColumn(quality, F.coalesce(F.col(quality), F.lit(default)) if quality in df.columns else F.lit(default))


#: Tables that are of no use without the chapter of a row.
CHAPTER_TABLES = ("skills", "plot_arcs", "sensory_mappings", "dialogue_samples", "description_samples", "chapter_functions")


def rebuilt(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The saved table ``name``; where it is missing, cannot be read or lacks a ``chapter_id`` that it needs, an empty one of
    ``schema`` takes its place in the folder. Tables from before the quality column get it with its default."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        found = None
    if found is None or (name in CHAPTER_TABLES and "chapter_id" not in found.columns):
        found = spark.createDataFrame([], schema)
        found.write.mode("overwrite").parquet(path)
        return spark.read.schema(found.schema).parquet(path)
    return migrated(found) if "writing_quality" in spark.createDataFrame([], schema).columns else found


def search_log(searches: DataFrame) -> DataFrame:
    """Rows of the search log with an ``id`` of their own each: a UUID, as equal searches are told apart."""
    return searches.select(F.expr("uuid()").alias("id"), *searches.columns)


def counts_by_book(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.groupBy("book_name").agg(F.count("*").alias("records")).select(F.lit(n).alias("table_name"), "book_name", "records") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pending(wanted: DataFrame, progress: DataFrame) -> DataFrame:
    """(book_name, stage) not yet complete: failed and skipped ones come again."""
    return wanted.join(progress.where("status = 'complete'").select("book_name", "stage").distinct(), ["book_name", "stage"], "left_anti")


def status_matrix(progress: DataFrame, stages: list[str]) -> DataFrame:
    """A row for each book: the status of every stage, and DONE > ERR > SKIP > WIP > NEW overall."""
    wide = progress.groupBy("book_name").pivot("stage", stages).agg(F.max("status"))
    have = lambda s: sum((F.coalesce((F.col(x) == s).cast("int"), F.lit(0)) for x in stages), F.lit(0))
    overall = (
        F.when(have("complete") == len(stages), "DONE").when(have("failed") > 0, "ERR").when(have("skipped") > 0, "SKIP")
        .when(have("complete") > 0, "WIP").otherwise("NEW")
    )
    return wide.withColumn("overall", overall)
