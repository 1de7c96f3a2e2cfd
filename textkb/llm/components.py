"""Connected components of a link table by alternating star contraction.

Every round is two grouped minima over the links, so work follows the number of links; the number
of rounds grows with the logarithm of the component size, also for long chains. Links are cut into
the shared folder after each round. Hot vertices (stars) are joined as ordinary rows: minima are
pre-aggregated before the shuffle and skewed joins are left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: hook neighbours to the smallest vertex in reach. ``links`` has u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hooked = both.join(lowest, "u")
    if large:  # larger neighbours go to the minimum
        out = hooked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours and the vertex itself go to the minimum
        out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
    out = out.where(F.col("u") != F.col("v"))
    return out if large else out.distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether a vertex has two smaller neighbours, or is one and has one: else all links are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("low")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("low"))
    )
    return bool(ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("low").alias("low")).where("n > 1 or (n > 0 and low > 0)").take(1))


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for every vertex of a link; component is its smallest vertex.

    Self links and repeated links are fine, nulls are ignored, an empty input gives no rows.
    """
    edges = (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = materialize(edges)
    for _ in range(max_rounds):
        if not _unsettled(edges):
            break
        edges = materialize(_star(_star(edges, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
