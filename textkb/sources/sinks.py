"""Sinks: partitioned keyed tables, rejects, logs, vectors, graphs, and a look into saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import export_attributes
from ..operators.upsert import append_log, search_log, upsert_table, vector_upserted

__all__ = ["append_log", "peek", "search_log", "write_graph", "write_rejects", "write_replace", "write_ignore", "write_vectors"]


def write_replace(rows: DataFrame, path: str, key: str = "id", by: str = "book_name", seq: str = "seq") -> None:
    upsert_table(rows, path, key, by, seq)


def write_ignore(rows: DataFrame, path: str, key: str = "id", by: str = "book_name", seq: str = "seq") -> None:
    upsert_table(rows, path, key, by, seq, ignore=True)


def write_rejects(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_vectors(rows: DataFrame, path: str, batch: str = "batch", seq: str = "seq") -> None:
    """Upsert into the collections that ``rows`` name: other ids of a collection stay, and of one id the latest
    batch of the new rows wins (inside it the first), over anything written before."""
    upsert_table(vector_upserted(rows, "id", batch, seq), path, "id", "collection", seq)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges with attributes fit for XML tools."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("attrs", export_attributes(F.col("attrs"))).write.mode("overwrite").parquet(f"{path}/{name}")


def peek(spark: SparkSession, tables: dict[str, DataFrame], seed: int = 0) -> list[tuple[str, int, dict | None]]:
    """Row count and one random row of each table, in one pass each: every row draws a number, the least is shown."""
    out = []
    for name, df in tables.items():
        n, row = df.withColumn("_draw", F.rand(seed)).agg(F.count("*"), F.min_by(F.struct(*df.columns), "_draw")).first()
        out.append((name, n, row.asDict() if row else None))
    return out
