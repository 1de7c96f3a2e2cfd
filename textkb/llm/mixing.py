"""Mixing sources to target weights, in DataFrame functions only.

Words are counted per document in one pass over the text; only ``(doc_id, source, size)`` goes on.
Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a
target stops at twice its source's size and what is left is shared again by weight until no target
is above (water filling). A source's repetition rate is target / size; a document is taken
``floor(rate)`` times and once more if a number hashed from its id falls below the fraction.

Source totals are pre-aggregated before their shuffle, so a source with a third of all rows is one
row a task. Sources themselves may be many: their order is found by range partitions with counts,
and each step of the water filling is one aggregate that gives two numbers back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, hash_unit, materialize, table, unique_names

WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2
SEED = "mix-1"


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) in code-point order, null last, without one task sorting all sources."""
    missing = F.col("source").isNull()
    dealt = (
        sources.repartitionByRange(missing, "source")
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(missing, "source")) - 1)
    )
    dealt = materialize(dealt)
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range, at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return dealt.join(offsets, "part").withColumn("rank", F.col("skip") + F.col("place")).drop("part", "place", "skip")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, size)`` rows."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(totals).select("source", "source_size", weight.cast("long").alias("weight")))
    cap = F.col("source_size") * ceiling
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    left, heft = budget, ranked.agg(F.sum("weight")).first()[0] or 1
    while True:  # each round caps at least one more source, or ends
        above = F.lit(float(left)) * F.col("weight") / F.lit(float(heft)) > cap
        capped, open_weight = ranked.agg(
            F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        new_left, new_heft = budget - (capped or 0), open_weight or 1
        if not open_weight or (new_left, new_heft) == (left, heft):
            break
        left, heft = new_left, new_heft
    level = F.lit(float(left)) * F.col("weight") / F.lit(float(heft))
    return ranked.withColumn("target", F.least(level, cap.cast("double")))


def _word_count() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def _draw(seed: str) -> F.Column:
    """The document's number in [0, 1): from its id, or for a null id from its text, so that they do not draw alike."""
    null_id = F.concat(F.lit("\\N"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return hash_unit(F.coalesce(F.col("doc_id").cast("string"), null_id), seed=seed)


def _copies(rate: F.Column, draw: F.Column) -> F.Column:
    whole = F.floor(rate).cast("long")
    return whole + (draw < rate - whole).cast("long")


def _rate(target: str, size: str) -> F.Column:
    return F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))


def mixed_counts(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    A null text has size 0; null sources are one source; a source without words has target 0 and
    rate 0; repeated rows draw alike, as the draw depends on doc_id only (on the text where the id is
    null); long texts are counted whole; an empty table gives none; other columns are ignored.
    """
    sizes = materialize(docs.select("doc_id", "source", _word_count().alias("size"), _draw(seed).alias("draw")))
    targets = source_targets(sizes, **shares).select(F.col("source").alias("of"), "source_size", "target")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumn("rate", _rate("target", "source_size"))
    return joined.withColumn("copies", _copies(F.col("rate"), F.col("draw"))).drop("draw").withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mixed_counts`` says, with all its columns.

    Only the table of sources meets the texts, and Spark sends it to them where it is small. Nulls, empty and long
    texts and repeated rows as in ``mixed_counts``; an empty table stays empty; working columns get other names where
    ``docs`` has theirs.
    """
    of, size, target, times = unique_names(docs.columns, "mix_of", "mix_size", "mix_target", "mix_times")
    targets = source_targets(docs.select("source", _word_count().alias("size")), **shares)
    targets = materialize(targets.select(F.col("source").alias(of), F.col("source_size").alias(size), F.col("target").alias(target)))
    copies = _copies(_rate(target, size), _draw(seed))
    out = docs.join(targets, F.col("source").eqNullSafe(F.col(of))).withColumn(times, copies).where(F.col(times) > 0)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed_counts(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, '\N' || md5(coalesce(text, ''))) AS drawn FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals
), filled AS (
  SELECT *, source_size * 2 AS cap, 1.5e0 * sum(source_size) OVER () AS budget,
    coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2e0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY source_size * 2e0 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM ranked
), fit AS (
  SELECT *, (budget - cap_before) * weight / weight_left > cap AS above FROM filled
), level AS (
  SELECT arg_min(budget - cap_before, cap_before) AS room, max(weight_left) AS heft FROM fit WHERE NOT above
), targets AS (
  SELECT source, source_size, CASE WHEN above THEN cap::DOUBLE ELSE least(room::DOUBLE * weight / heft::DOUBLE, cap::DOUBLE) END AS target
  FROM fit, level
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
    ('0x' || substr(md5('mix-1' || chr(31) || s.drawn), 1, 8))::UBIGINT::DOUBLE / 4294967296e0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
