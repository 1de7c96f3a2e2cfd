"""Window, join and aggregate operators of the knowledge base, and cross-book digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: How many of the best rows are kept, per book or per book and type.
KEEP = {"dialogue_samples": (3, True), "description_samples": (3, True), "transition_samples": (5, False), "narrative_distance": (5, False), "show_tell_patterns": (5, False), "action_scene_samples": (5, False), "climax_excerpts": (5, False), "memorable_quotes": (10, False)}

#: Issue types and the dimension they belong to.
DIMENSIONS = {"节奏拖沓": "节奏", "对话生硬": "对话", "描写不足": "描写", "人物失真": "人物", "情节漏洞": "情节", "过度告知": "描写", "视角混乱": "情节"}


def ordered(value: Column | str, *order: str, limit: int | None = None) -> Column:
    """The values of a group in order, as an array."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.transform(F.slice(rows, 1, limit) if limit else rows, lambda x: x["_value"])


# --- windows -------------------------------------------------------------------------------------------


def best_rows(rows: DataFrame, n: int, by_type: bool = False, quality: str = "writing_quality", seq: str = "seq") -> DataFrame:
    """The n best rows by quality of each book (and type), ties in input order."""
    w = Window.partitionBy("book_name", *(["type"] if by_type else [])).orderBy(F.desc(quality), seq)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def carried_state(rows: DataFrame, state: str, failed: str, initial: Column, resets: int = 2) -> DataFrame:
    """The state before each chapter: the last known one, or ``initial`` at the start and once
    ``resets`` or more chapters in a row have failed (until a chapter succeeds again)."""
    w = Window.partitionBy("book_name").orderBy("seq")
    run = F.sum((~F.col(failed)).cast("int")).over(w)
    rows = rows.withColumn("_run", run)
    fails = F.sum(F.col(failed).cast("int")).over(Window.partitionBy("book_name", "_run").orderBy("seq"))
    rows = rows.withColumn("_fails", fails)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col(failed), F.col(state)), ignorenulls=True).over(before)
    out = F.when(F.coalesce(F.lag("_fails").over(w), F.lit(0)) >= resets, initial).otherwise(F.coalesce(last, initial))
    return rows.withColumn("state_before", out).drop("_run", "_fails")


def context_before(rows: DataFrame, value: str, back: int = 3, separator: str = "\n") -> DataFrame:
    w = Window.partitionBy("book_name").orderBy("seq").rowsBetween(-back, -1)
    return rows.withColumn("context", F.array_join(F.collect_list(value).over(w), separator))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}") for c in rest))


# --- joins -----------------------------------------------------------------------------------------------


def with_context(samples: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.join(summaries, list(keys), "left")


def snippets(profiles: DataFrame, chapters: DataFrame, most: int = 5, chars: int = 500) -> DataFrame:
    """Each (book, name) with up to ``most`` cut texts of the chapters that its profiles name."""
    cut = chapters.select("book_name", "chapter_id", "seq", F.substring("text", 1, chars).alias("snippet"))
    rows = profiles.select("book_name", "name", "chapter_id").distinct().join(cut, ["book_name", "chapter_id"], "left")
    w = Window.partitionBy("book_name", "name").orderBy(F.col("seq").asc_nulls_last())
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return rows.groupBy("book_name", "name").agg(F.array_join(ordered("snippet", "seq"), "\n").alias("snippets"), F.count("snippet").alias("found"))


def named_edges(edges: DataFrame, events: DataFrame, missing: str = "未知事件") -> DataFrame:
    """Edges with the names of both ends."""
    name = lambda end: events.select(F.col("event_id").alias(f"{end}_id"), F.col("event_name").alias(f"{end}_name"))
    out = edges.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(missing)) for c in ("source_name", "target_name")})


def within(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with the intervals of its keys that hold it (``start <= at < end``): an equi-join, whatever the lengths.

    An interval's level is its length as a power of two. Neighbouring levels share buckets as wide as the smallest of them,
    so an interval lies in a few buckets and a point looks into one bucket of each group of levels. The groups are those
    that make the fewest rows: one group more costs a row a point, one less costs the long intervals more buckets. So
    there are never more rows than with a group for each level, and a hot bucket is a skewed key of a plain join, which
    Spark splits. Null keys, points and bounds and empty intervals meet nothing; repeated rows meet as often as they stand.
    """
    size = F.col(end) - F.col(start)
    level = F.ceil(F.log2(size.cast("double"))).cast("int")
    held = intervals.where(size > 0).withColumn("_level", F.greatest(level, F.lit(0)))
    sizes = held.groupBy("_level").agg(F.count("*").alias("n"), F.sum(size.cast("double")).alias("chars"))
    found = points.where(F.col(at).isNotNull())
    widths = level_groups(sorted((r["_level"], r["n"], r["chars"]) for r in sizes.collect()), found.count())  # 64 levels at most
    held = held.withColumn("_level", F.element_at(F.create_map(*(F.lit(x) for kv in widths.items() for x in kv)), F.col("_level")) if widths else F.lit(0))
    width = lambda of: F.pow(F.lit(2.0), of).cast("long")
    bucket = lambda c, of: F.floor(F.col(c).cast("double") / width(of)).cast("long")
    last = F.floor((F.col(end) - 1).cast("double") / width(F.col("_level"))).cast("long")
    held = held.withColumn("_bucket", F.explode(F.sequence(bucket(start, F.col("_level")), F.greatest(last, bucket(start, F.col("_level"))))))
    found = found.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(set(widths.values())))).cast("array<int>")))
    found = found.withColumn("_bucket", bucket(at, F.col("_level")))
    met = found.join(held, [*keys, "_level", "_bucket"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return met.drop("_level", "_bucket")


def level_groups(sizes: Sequence[tuple[int, int, float]], points: int) -> dict[int, int]:
    """The level whose buckets each level uses, from ``(level, intervals, sum of lengths)`` ascending: runs of levels that make
    the fewest rows (a row a point and run, and two more than its length in buckets for an interval)."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for to in range(1, len(sizes) + 1):
        cost = lambda a, to=to: best[a][0] + points + sum(c / 2 ** sizes[a][0] + 2 * n for _, n, c in sizes[a:to])
        best.append(min((cost(a), a) for a in range(to)))
    out, to = {}, len(sizes)
    while to:
        a = best[to][1]
        out |= {x[0]: sizes[a][0] for x in sizes[a:to]}
        to = a
    return out


def one_row_each(base: DataFrame, parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """``base`` with one pre-aggregated row of each part: the parts are reduced before they are joined."""
    for part in parts.values():
        base = base.join(part, key, "left")
    return base


# --- aggregates --------------------------------------------------------------------------------------------


def richest_books(tables: Sequence[DataFrame], most: int = 5) -> DataFrame:
    """Books by rows over all tables."""
    parts = [t.groupBy("book_name").agg(F.count("*").alias("n")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("book_name").agg(F.sum("n").alias("records")).where("records > 0").orderBy(F.desc("records"), "book_name").limit(most)


def mistake_patterns(issues: DataFrame, dimensions: Mapping[str, str] = DIMENSIONS, least: int = 2, examples: int = 2, unknown: str = "未知") -> DataFrame:
    """Issues (issue_type, description, seq; later is newer) by dimension and type, where a dimension has
    at least ``least``: how often, and the newest examples."""
    mapping = F.create_map(*(F.lit(x) for kv in dimensions.items() for x in kv))
    kind = F.coalesce(F.nullif(F.col("issue_type"), F.lit("")), F.lit(unknown))
    rows = issues.withColumn("issue_type", kind).withColumn("dimension", F.coalesce(F.try_element_at(mapping, F.col("issue_type")), F.col("issue_type")))
    w = Window.partitionBy("dimension", "issue_type").orderBy(F.desc("seq"), F.desc("description"))
    newest = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples)  # cut in each task first
    newest = newest.groupBy("dimension", "issue_type").agg(ordered("description", "_n").alias("examples"))
    grouped = rows.groupBy("dimension", "issue_type").agg(F.count("*").alias("frequency")).join(newest, ["dimension", "issue_type"])
    return grouped.withColumn("in_dimension", F.sum("frequency").over(Window.partitionBy("dimension"))).where(F.col("in_dimension") >= least)


def run_report(results: DataFrame, most: int = 10) -> DataFrame:
    """By stage: rows of successes, failures, and the first failures by name."""
    failed = F.col("status") != "complete"
    w = Window.partitionBy("stage").orderBy("book_name")
    first = results.where(failed & F.col("book_name").isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    first = first.groupBy("stage").agg(ordered("book_name", "_n").alias("first_failures"))
    out = results.groupBy("stage").agg(
        F.sum(F.when(F.col("status") == "complete", F.col("rows")).otherwise(0)).alias("succeeded"), F.count(F.when(failed, F.col("book_name"))).alias("failures")
    )
    return out.join(first, "stage", "left").withColumn("first_failures", F.coalesce("first_failures", F.array().cast("array<string>")))


def style_summaries(samples: DataFrame, least: int = 2, first: int = 3) -> DataFrame:
    """Per book and scene: mean length, first tensions and techniques by name, and how many."""
    several = lambda c: F.array_join(F.slice(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), 1, first), "、")
    out = samples.groupBy("book_name", "scene_type").agg(
        F.floor(F.avg(F.length("original_text"))).cast("long").alias("avg_chars"), several("tension").alias("tensions"), several("technique").alias("techniques"), F.count("*").alias("samples")
    )
    return out.where(F.col("samples") >= least)


def merged_style(fingerprints: DataFrame, column: str, most: int = 30, placeholders: Sequence[str] = T.PLACEHOLDERS) -> DataFrame:
    """The distinct words of a comma-joined column over all fingerprints of a book, by name, first ``most``."""
    word = F.explode(F.split(column, ",")).alias("word")
    words = fingerprints.select("book_name", word).select("book_name", F.trim("word").alias("word")).where(F.col("word") != "")
    words = words.where(~F.col("word").isin(*placeholders)).distinct()
    return words.groupBy("book_name").agg(F.slice(F.array_sort(F.collect_list("word")), 1, most).alias("words"))


def described(metadata: DataFrame, fingerprints: DataFrame, parts: Sequence[str], order: str) -> DataFrame:
    """Metadata with a description from the first fingerprint row: its non-blank parts, joined."""
    values = [F.nullif(F.trim(F.col(p)), F.lit("")) for p in parts]
    first = fingerprints.groupBy("book_name").agg(F.min_by(F.concat_ws(" | ", *values), order).alias("description"))
    return metadata.join(first, "book_name", "left")


# --- digests -------------------------------------------------------------------------------------------------


def digest(rows: DataFrame, line: Column, keys: Sequence[str], order: Sequence[str], most: int, limit: Column | int | None = None) -> DataFrame:
    """Up to ``most`` lines of each group in order, as one text, cut at ``limit`` characters."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("_line", line)
    out = kept.groupBy(*keys).agg(F.array_join(ordered("_line", "_n"), "\n").alias("digest"), F.count("*").alias("lines"))
    if limit is not None:
        out = out.withColumn("digest", F.substring(F.col("digest"), F.lit(1), (limit if isinstance(limit, Column) else F.lit(limit)).cast("int")))
    return out


def dimension_coverage(tables: Mapping[str, DataFrame], dimensions: Sequence[str], least: int = 2) -> DataFrame:
    """How many books have data for each dimension, and whether it is enough to compare."""
    parts = [t.agg(F.count_distinct("book_name").alias("books")).select(F.lit(d).alias("dimension"), "books") for d, t in tables.items()]
    empty = [d for d in dimensions if d not in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    for d in empty:
        out = out.unionByName(parts[0].select(F.lit(d).alias("dimension"), F.lit(0).cast("long").alias("books")))
    return out.withColumn("run", F.col("books") >= least)


def evidence(sources: Mapping[str, tuple[DataFrame, int]], scene: str, most: int = 10) -> DataFrame:
    """Up to ``most`` rows of each source whose type is like the scene, texts cut per source."""
    out = None
    for name, (rows, chars) in sources.items():
        part = rows.where(F.col("type").ilike(f"%{scene}%")).orderBy("seq").limit(most)
        part = part.select(F.lit(name).alias("origin"), "seq", F.substring("text", 1, chars).alias("excerpt"))
        out = part if out is None else out.unionByName(part)
    return out
