"""Registration of queries with the SQL that states the same result, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents in the role of chapters: book = source, category = lang, order = doc_id."""
    docs = table(spark, sf_dir, "documents")
    all_ = {"book_name": F.col("source"), "category": F.col("lang"), "seq": F.col("doc_id"), "chapter_id": F.concat(F.lit("ch"), F.col("doc_id")), "text": F.col("text")}
    return docs.select(*(all_[c].alias(c) for c in (columns or all_)))


#: The same roles in SQL, to put in front of an oracle.
CHAPTERS = "chapters AS (SELECT source AS book_name, lang AS category, doc_id AS seq, 'ch' || doc_id AS chapter_id, text FROM documents)"


def indexed(df: DataFrame) -> DataFrame:
    """``idx`` (from 0) and ``n`` of each chapter in its book; give it narrow rows, not texts."""
    w = Window.partitionBy("book_name")
    return df.withColumn("idx", F.row_number().over(w.orderBy("seq")) - 1).withColumn("n", F.count("*").over(w).cast("int"))


INDEXED = "(row_number() OVER (PARTITION BY book_name ORDER BY seq) - 1)::INT AS idx, count(*) OVER (PARTITION BY book_name)::INT AS n"
