"""Deterministic selection of chapters and lines per book. Input rows carry ``idx`` (from 0) and ``n``.

Selections work on narrow rows (keys, lengths, scores); texts are joined afterwards by those who need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE, MULTIPLIER, DENOMINATOR = 10, 5, 100


def sample_size(n: Column) -> Column:
    size = F.floor(F.lit(float(BASE)) + MULTIPLIER * F.sqrt(n / F.lit(float(DENOMINATOR)))).cast("int")
    return F.greatest(F.lit(BASE), F.least(n, size))


def _int_div(a: Column, b: Column) -> Column:
    return F.floor(a.cast("long") / b).cast("int")


def best_per_interval(rows: DataFrame, score: str = "score", everything: bool = False) -> DataFrame:
    """The best-scored row of each of ``sample_size`` equal intervals; ties: the first; small books whole."""
    if everything:
        return rows
    k = sample_size(F.col("n"))
    bucket = _int_div((F.col("idx") + 1) * k + F.col("n") - 1, F.col("n")) - 1
    rows = rows.withColumn("_k", k).withColumn("_bucket", F.when(F.col("n") <= F.col("_k"), F.col("idx")).otherwise(bucket))
    w = Window.partitionBy("book_name", "_bucket").orderBy(F.desc(score), "idx")
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_k", "_bucket", "_place")


def uniform(rows: DataFrame) -> DataFrame:
    """Rows number ``floor(i * n / sample_size)``."""
    k, n, idx = sample_size(F.col("n")), F.col("n"), F.col("idx")
    i = _int_div(idx * k + n - 1, n)
    return rows.where((n <= k) | ((i < k) & (_int_div(i * n, k) == idx)))


def first_last_step(rows: DataFrame) -> DataFrame:
    """First, last and every step-th row; books of ten or fewer whole."""
    n, idx = F.col("n"), F.col("idx")
    step = F.greatest(F.lit(2), _int_div(n - 2, sample_size(n) - 2))
    return rows.where((n <= 10) | (idx == 0) | (idx == n - 1) | ((idx >= step) & (idx < n - 1) & (idx % step == 0)))


def head_middle_tail(lines: DataFrame, budget: int = 4000, least: int = 20) -> DataFrame:
    """A quarter from the head, half evenly from the middle, a quarter from the tail, within a budget of
    characters (``chars`` per line; joining line ends count); books within the budget whole."""
    w = Window.partitionBy("book_name")
    total = F.sum("chars").over(w) + F.col("n") - 1
    lines = lines.withColumn("_total", total)
    most = F.greatest(F.floor(F.lit(float(budget)) / (F.col("_total") / F.col("n"))).cast("int"), F.lit(least))
    lines = lines.withColumn("_most", most).withColumn("_head", _int_div(F.col("_most"), F.lit(4)))
    middle, head, n, idx = F.col("_most") - 2 * F.col("_head"), F.col("_head"), F.col("n"), F.col("idx")
    tail = F.greatest(n - head, head)
    length = tail - head
    i = _int_div((idx - head) * middle + length - 1, length)
    even = (length <= middle) | ((i < middle) & (_int_div(i * length, middle) == idx - head))
    chosen = (idx < head) | (idx >= tail) | ((idx >= head) & (idx < tail) & even)
    return lines.where((F.col("_total") <= budget) | chosen).drop("_total", "_most", "_head")


def compressed_lines(lines: DataFrame, terms: str, most_chars: int = 6000, most_lines: int = 20) -> DataFrame:
    """Lines of long digests: head and tail quarters, every tenth and those with key terms between."""
    w = Window.partitionBy("book_name")
    total = F.sum("chars").over(w) + F.col("n") - 1
    edge, n, idx = F.greatest(F.lit(3), _int_div(F.col("n"), F.lit(4))), F.col("n"), F.col("idx")
    keep = (idx < edge) | (idx >= n - edge) | (idx % 10 == 0) | F.col("line").rlike(terms)
    return lines.withColumn("_total", total).where((F.col("_total") <= most_chars) | (n <= most_lines) | keep).drop("_total")


def main_characters(mentions: DataFrame, top: int = 20, least: int = 3, chapters: int = 6, snippet: int = 900, budget: int = 3800) -> DataFrame:
    """Snippets of the most frequent names: ``mentions`` has (book_name, name, seq, chars).

    A name's first ``chapters`` chapters, up to ``snippet`` characters each, until one would exceed the budget.
    """
    counts = mentions.groupBy("book_name", "name").agg(F.count("*").alias("frequency"))
    order = Window.partitionBy("book_name").orderBy(F.desc("frequency"), "name")
    chosen = counts.withColumn("place", F.row_number().over(order)).where((F.col("place") <= top) & (F.col("frequency") >= least))
    w = Window.partitionBy("book_name", "name").orderBy("seq")
    rows = mentions.join(chosen, ["book_name", "name"]).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= chapters)
    rows = rows.withColumn("used", F.least("chars", F.lit(snippet)) + 2)
    running = F.sum("used").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 2
    rows = rows.withColumn("_over", (running > budget).cast("int"))
    stopped = F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_stop", stopped).where("_stop = 0").select("book_name", "name", "frequency", "place", "nth", "seq")


def active_cast(chapters: DataFrame, protagonists: list[str], names: list[str], most: int = 10, back: int = 3, nobody: str = "旁白") -> DataFrame:
    """Protagonists, then known names (two or more characters) seen in the last ``back`` texts of the book.

    Each chapter is reduced to one flag for each name before the window, so no text is shuffled.
    """
    w = Window.partitionBy("book_name").orderBy("seq").rowsBetween(-back, -1)
    others = [x for x in names if len(x) >= 2 and x not in protagonists]
    flags = chapters.select("book_name", "seq", *(F.contains("text", F.lit(x)).alias(f"_n{i}") for i, x in enumerate(others)))
    seen = [F.when(F.coalesce(F.max(f"_n{i}").over(w), F.lit(False)), F.lit(x)) for i, x in enumerate(others)]
    cast = F.concat(F.array(*map(F.lit, protagonists)).cast("array<string>"), F.filter(F.array(*seen).cast("array<string>"), lambda x: x.isNotNull()))
    cast = F.slice(cast, 1, most)
    return flags.select("book_name", "seq", cast.alias("cast")).withColumn("cast", F.when(F.size("cast") == 0, F.array(F.lit(nobody))).otherwise(F.col("cast")))
