"""Statistics per book: chapter lengths, dialogue share, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def chapter_measures(chapters: DataFrame) -> DataFrame:
    """One narrow row for each chapter: everything that needs the text is computed here, in one scan."""
    lengths = F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(T.strip(x))), lambda n: n > 0)
    return chapters.select(
        "book_name",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(T.dialogue_chars("text", T.QUOTED_SINGLE), F.lit(0)).alias("dialogue"),
        F.coalesce(lengths, F.array().cast("array<int>")).alias("paragraphs"),
    )


def book_statistics(chapters: DataFrame) -> DataFrame:
    """Totals, means, medians and ratios for each book (column ``book_name``, ``text``)."""
    total = lambda f: F.sum(F.aggregate("paragraphs", F.lit(0).cast("long"), f))
    sums = chapter_measures(chapters).groupBy("book_name").agg(
        F.count("*").alias("total_chapters"),
        F.sum("chars").alias("total_chars"),
        F.floor(F.avg("chars")).cast("long").alias("avg_chapter_chars"),
        F.min("chars").alias("min_chapter_chars"),
        F.max("chars").alias("max_chapter_chars"),
        F.floor(F.percentile("chars", F.lit(0.5))).cast("long").alias("median_chapter_chars"),
        F.sum("dialogue").alias("dialogue"),
        F.sum(F.size("paragraphs")).cast("long").alias("total_paragraphs"),
        total(lambda s, x: s + x).alias("paragraph_chars"),
        total(lambda s, x: s + F.when(x < 50, 1).otherwise(0)).alias("short"),
        total(lambda s, x: s + F.when((x >= 50) & (x <= 150), 1).otherwise(0)).alias("medium"),
        total(lambda s, x: s + F.when(x > 150, 1).otherwise(0)).alias("long"),
    )
    share = lambda a, b, places=4: T.decimal_round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), places)
    return sums.select(
        "book_name", "total_chapters", "total_chars", "avg_chapter_chars", "min_chapter_chars", "max_chapter_chars", "median_chapter_chars",
        share("dialogue", "total_chars").alias("dialogue_ratio"),
        T.decimal_round(1 - share("dialogue", "total_chars")).alias("description_ratio"),
        "total_paragraphs",
        share("paragraph_chars", "total_paragraphs", 2).alias("avg_paragraph_chars"),
        share("short", "total_paragraphs").alias("short_paragraph_ratio"),
        share("medium", "total_paragraphs").alias("medium_paragraph_ratio"),
        share("long", "total_paragraphs").alias("long_paragraph_ratio"),
    )
