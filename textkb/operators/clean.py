"""Cleaning of whole documents, and the removal of author's notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def note_free(text: Column | str, trigger: str = T.NOTE_LINE, header: str = T.CHAPTER_LINE) -> Column:
    """A text without author's notes: one walk over its lines inside the row, and only for texts with a trigger."""

    def step(s: Column, line: Column) -> Column:
        def seen(stripped: Column) -> Column:
            note, chapter = stripped.rlike(trigger), stripped.rlike(header)
            keep = (~s["inside"] & ~note) | (s["inside"] & chapter)
            inside = F.when(note & chapter, ~s["inside"]).when(note, True).when(chapter, False).otherwise(s["inside"])
            return F.struct(inside.alias("inside"), F.when(keep, F.array_append(s["kept"], line)).otherwise(s["kept"]).alias("kept"))

        return T.let(T.strip(line), seen)

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))
    walked = lambda t: F.aggregate(F.split(t, "\n"), start, step, lambda s: F.array_join(s["kept"], "\n"))
    return T.let(T.col(text), lambda t: F.when(t.rlike(f"(?m){trigger}"), walked(t)).otherwise(t))


def without_author_notes(docs: DataFrame, key: str, text: str, trigger: str = T.NOTE_LINE, header: str = T.CHAPTER_LINE) -> DataFrame:
    """Documents without author's notes; nothing is shuffled."""
    return docs.withColumn(text, note_free(text, trigger, header))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole cleaning chain in its fixed order, and a flag for texts that end up short."""
    first = T.without_noise_lines(T.without_symbol_lines(T.without_ads(T.unix_newlines(text))))
    rest = T.trimmed_lines(T.collapsed(T.without_controls(text)))
    return docs.withColumn(text, note_free(first)).withColumn(text, rest).withColumn("is_short", T.is_short(text))


def swept(df: DataFrame, columns: list[str], mode: str = "delete") -> DataFrame:
    """Mojibake sweep: ``delete`` drops rows with a dirty column, ``blank`` empties dirty columns only."""
    if mode == "blank":
        return df.withColumns({c: F.when(T.is_mojibake(c), F.lit("")).otherwise(F.col(c)) for c in columns})
    dirty = F.lit(False)
    for c in columns:
        dirty = dirty | T.is_mojibake(c)
    return df.where(~dirty)
