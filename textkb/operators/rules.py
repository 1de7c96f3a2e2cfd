"""Data-quality rules: each gives (stage, book_name, chapter_id, severity, description) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key

COLUMNS = ("stage", "book_name", "chapter_id", "severity", "description")


def issue(rows: DataFrame, stage: str, severity: str | Column, description: str | Column, chapter: str | None = None) -> DataFrame:
    value = lambda v: F.lit(v) if isinstance(v, str) else v
    return rows.select(
        F.lit(stage).alias("stage"), "book_name", (F.col(chapter) if chapter else F.lit("")).alias("chapter_id"), value(severity).alias("severity"), value(description).alias("description")
    )


def summary_rules(chapters: DataFrame, least: int = 50, failure_rate: float = 0.1) -> DataFrame:
    """Stage A: empty summary critical, short one high, no cast medium; many failures of a book critical."""
    c = chapters.withColumn("summary", F.coalesce("summary", F.lit("")))
    empty = F.length("summary") == 0
    failed = c.groupBy("book_name").agg(F.avg(empty.cast("int")).alias("rate")).where(F.col("rate") > failure_rate)
    return union(
        [
            issue(c.where(empty), "A", "critical", "empty summary", "chapter_id"),
            issue(c.where(~empty & (F.length("summary") < least)), "A", "high", "short summary", "chapter_id"),
            issue(c.where(F.col("cast_size") == 0), "A", "medium", "no cast", "chapter_id"),
            issue(failed, "A", "critical", "failure rate too high"),
        ]
    )


def missing_rows(books: DataFrame, rows: DataFrame, stage: str, severity: str, description: str) -> DataFrame:
    """Books without any row in a table."""
    return issue(books.select("book_name").distinct().join(rows.select("book_name").distinct(), "book_name", "left_anti"), stage, severity, description)


def missing_per_chapter(chapters: DataFrame, rows: DataFrame, stage: str, severity: str, description: str) -> DataFrame:
    keys = ["book_name", "chapter_id"]
    return issue(chapters.select(*keys).distinct().join(rows.select(*keys).distinct(), keys, "left_anti"), stage, severity, description, "chapter_id")


def missing_modules(settings: DataFrame, expected: Sequence[str], most: int) -> DataFrame:
    """Books that lack more than ``most`` of the expected modules."""
    have = settings.groupBy("book_name").agg(F.collect_set("module").alias("have"))
    gap = have.withColumn("gap", F.array_sort(F.array_except(F.array(*map(F.lit, expected)), "have"))).where(F.size("gap") > most)
    return issue(gap, "D", "medium", F.concat(F.lit("missing: "), F.array_join(F.slice("gap", 1, 3), ", ")))


def thin_profiles(profiles: DataFrame, fields: Sequence[str], most: int = 2) -> DataFrame:
    """Profiles with two or more empty key fields."""
    empty = [F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) == "", F.lit(f)) for f in fields]
    rows = profiles.withColumn("gap", F.filter(F.array(*empty), lambda x: x.isNotNull())).where(F.size("gap") >= most)
    return issue(rows, "D", "medium", F.concat_ws(" ", "name", F.lit("lacks"), F.array_join("gap", ", ")))


def sample_rules(samples: DataFrame, least: int, quality: int = 3) -> DataFrame:
    """Stage F, per book: any empty text high; over 30 % short medium; over half of low quality medium."""
    n = F.length(F.coalesce("text", F.lit("")))
    s = samples.groupBy("book_name").agg(
        F.count("*").alias("n"), F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < least)).alias("short"), F.count_if(F.col("writing_quality") < quality).alias("low")
    )
    return union(
        [
            issue(s.where("empty > 0"), "F", "high", F.concat(F.col("empty"), F.lit(" empty"))),
            issue(s.where("short > 0.3 * n"), "F", "medium", F.concat(F.col("short"), F.lit("/"), F.col("n"), F.lit(" short"))),
            issue(s.where("low > 0.5 * n"), "F", "medium", F.concat(F.col("low"), F.lit("/"), F.col("n"), F.lit(" of low quality"))),
        ]
    )


#: The least length of a text by its table.
LEAST_CHARS = {"dialogue_samples": 30, "description_samples": 30, "transition_samples": 20, "narrative_distance": 20, "show_tell_patterns": 20, "action_scene_samples": 30, "climax_excerpts": 50, "memorable_quotes": 15}


def sample_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Stage F over the sample tables, each with its own least length; a climax without impact is medium."""
    text = {"narrative_distance": "original_example", "show_tell_patterns": "original_example", "memorable_quotes": "quote_text"}
    parts = []
    for name, rows in tables.items():
        found = sample_rules(rows.select("book_name", F.col(text.get(name, "original_text")).alias("text"), "writing_quality"), LEAST_CHARS[name])
        parts.append(found.withColumn("description", F.concat(F.lit(f"{name}: "), "description")))
        if name == "climax_excerpts":
            parts.append(blank_field(rows, "emotional_impact", "F", "medium", "climax without impact", "chapter_id"))
    return union(parts)


#: What to do about an issue, by stage and a pattern of its description; the first that fits.
SUGGESTIONS = (
    ("A", "summary|failure rate", "check the responses of these chapters and run them again"),
    ("D", "^missing", "run the settings stage over more chapters"),
    ("E", "^no ", "check that the summaries are complete"),
    ("F", "empty", "check the layout of the responses"),
    ("F", "short|low quality", "sample more chapters"),
    ("F", "impact", "ask for the impact again"),
    ("C", "sensory", "the book may hold dialogue alone"),
    (".", "^no (?!cast)", "run the stage again for this book"),
)


def suggested(issues: DataFrame) -> DataFrame:
    """Adds ``suggestion``: '' where there is none."""
    rule = None
    for stage, pattern, text in SUGGESTIONS:
        holds = F.col("stage").rlike(f"^{stage}$") & F.col("description").rlike(pattern)
        rule = F.when(holds, text) if rule is None else rule.when(holds, text)
    return issues.withColumn("suggestion", rule.otherwise(""))


def blank_field(rows: DataFrame, field: str, stage: str, severity: str, description: str, chapter: str | None = None) -> DataFrame:
    return issue(rows.where(F.coalesce(F.trim(F.col(field).cast("string")), F.lit("")) == ""), stage, severity, description, chapter)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def saved(issues: DataFrame) -> DataFrame:
    """One row for each (book, stage, chapter, first 50 characters)."""
    rows = issues.withColumn("id", key("book_name", "stage", "chapter_id", F.substring("description", 1, 50)))
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max(F.struct(*rest)).alias("_r")).select("id", *(F.col(f"_r.{c}") for c in rest))


def verdicts(issues: DataFrame) -> DataFrame:
    """Counts by severity of each book; it warns with any critical or more than five high issues."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    return issues.groupBy("book_name").agg(*counts).withColumn("warn", (F.col("critical") > 0) | (F.col("high") > 5))
