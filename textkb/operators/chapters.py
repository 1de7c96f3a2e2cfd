"""Splitting documents into chapters, excerpts, volumes and batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scratch import bounded_batches

#: Fixed value: what heads a chapter (text start or line ends before it, line ends or text end after).
HEADING = rf"(?:^|\n+)[{T.SPACE}]*((?:第[零一二三四五六七八九十百千万两\d\-]+[章节回卷集部篇][^\n]{{0,30}})|(?:[Cc]hapter[{T.SPACE}]*\d+[^\n]{{0,30}}))[{T.SPACE}]*(?:\n+|$)"
PREFACE, BLOCK = "序章", "分块_"
LEAST_CHAPTER, LEAST_BLOCK, LEAST_SLICE = 100, 50, 200
MAX_CHUNK, OVERLAP = 5000, 200
_CHAPTER = "array<struct<chapter_id:string,text:string>>"


def heading_chapters(text: Column, heading: str = HEADING, least: int = LEAST_CHAPTER) -> Column:
    """Array of ``(chapter_id, text)``: text before the first heading and bodies, if longer than ``least``."""
    parts = F.split(F.regexp_replace(text, heading, "\x01$1\x02"), "\x01")
    pair = lambda name, body: F.struct(name.alias("chapter_id"), body.alias("text"))
    preface = F.array(pair(F.lit(PREFACE), T.strip(F.element_at(parts, 1))))
    rest = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: pair(T.strip(F.substring_index(p, "\x02", 1)), T.strip(F.regexp_replace(p, "(?s)^[^\x02]*\x02", ""))),
    )
    return F.filter(F.concat(preface, rest), lambda c: F.length(c["text"]) > least)


def fixed_blocks(text: Column, size: int = MAX_CHUNK, least: int = LEAST_BLOCK) -> Column:
    """Array of ``(chapter_id, text)``: blocks of ``size`` characters; short ones go, numbers do not jump."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    blocks = F.transform(starts, lambda i: T.strip(F.substring(text, i * size + 1, F.lit(size))))
    kept = F.filter(F.when(F.length(text) > 0, blocks).otherwise(F.array().cast("array<string>")), lambda b: F.length(b) > least)
    return F.transform(kept, lambda b, i: F.struct(F.concat(F.lit(BLOCK), i + 1).alias("chapter_id"), b.alias("text")))


def boundary(region: str) -> int:
    """Where to cut a region: after the last scene mark or blank line in its last two thirds, else after
    the last line end two characters behind a quote or stop, else one behind a stop, else at its end."""
    lo = max(len(region) // 3, 100)
    marks = [region.rfind(m, max(lo - len(m) + 1, 0)) + len(m) for m in ("...", "---", "***", "\n\n") if region.rfind(m, max(lo - len(m) + 1, 0)) >= 0]
    if marks:
        return max(marks)
    for pattern in (r'[”"。！？.!?](?s:.)\n', r"[。！？.!?]\n"):
        hits = [m.start() + len(m[1]) for m in re.finditer(f"(?=({pattern}))", region)]
        if hits and hits[-1] > lo:
            return hits[-1]
    return len(region)


def semantic_slices(text: str, size: int = MAX_CHUNK, overlap: int = OVERLAP, least: int = LEAST_SLICE) -> list[str]:
    """Overlapping slices of a long chapter, cut at boundaries; no overlap once the rest fits one slice."""
    out, at = [], 0
    while at < len(text):
        end = at + boundary(text[at : at + size])
        piece = text[at:end].strip()
        if len(piece) > least:
            out.append(piece)
        if end >= len(text):
            break
        back = max(end - overlap, 0)
        at = end if len(text) - back <= size else back
    return out


def split_chapters(docs: DataFrame, key: str = "doc_id", size: int = MAX_CHUNK, overlap: int = OVERLAP, heading: str = HEADING) -> DataFrame:
    """``(key, chapter_idx, chapter_id, slice_no, text)`` for each document: by headings, by blocks where
    there are none, and chapters longer than ``size`` again into slices (the only part in Python)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(key, T.unix_newlines("text").alias("text"))
    found = heading_chapters(F.col("text"), heading)
    docs = docs.withColumn("found", found)
    chapters = F.when((F.size("found") <= 1) & (F.length("text") > size), fixed_blocks(F.col("text"), size)).otherwise(F.col("found"))
    rows = docs.select(key, F.posexplode(chapters).alias("chapter_idx", "c")).select(key, "chapter_idx", "c.chapter_id", "c.text")
    fits = rows.where(F.length("text") <= size).withColumn("slice_no", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = semantic_slices(row["text"], size, overlap)
                if parts:
                    numbers = range(1, len(parts) + 1)
                    yield pa.RecordBatch.from_pydict(
                        {key: [row[key]] * len(parts), "chapter_idx": [row["chapter_idx"]] * len(parts), "chapter_id": [f"{row['chapter_id']}_{n}" for n in numbers], "text": parts, "slice_no": list(numbers)},
                        schema=batch.schema.append(pa.field("slice_no", pa.int32())),
                    )

    long = rows.where(F.length("text") > size)
    schema = ", ".join(f"{n} {t}" for n, t in [*long.dtypes, ("slice_no", "int")])
    return fits.unionByName(long.mapInArrow(run, schema))


SLICES = "key string, chapter_idx int, chapter_id string, slice_no int, text string"


@F.arrow_udtf(returnType=SLICES)
class TextSlices:
    """Table function ``text_slices(TABLE(chapters))``: the slices of chapters that are too long, and the others as they are.

    ``chapters`` has key, chapter_idx, chapter_id and text. Chapters are sliced one by one: no partitioning of the
    argument is needed, and any gives the same rows. Null texts give none.
    """

    def eval(self, chapters: pa.RecordBatch) -> Iterator[pa.Table]:
        out = []
        for row in chapters.select(["key", "chapter_idx", "chapter_id", "text"]).to_pylist():
            text = row["text"] or ""
            if len(text) > MAX_CHUNK:
                out += [{**row, "chapter_id": f"{row['chapter_id']}_{n}", "slice_no": n, "text": part} for n, part in enumerate(semantic_slices(text), 1)]
            elif text:
                out.append({**row, "slice_no": 0})
        kinds = {"key": pa.string(), "chapter_idx": pa.int32(), "chapter_id": pa.string(), "slice_no": pa.int32(), "text": pa.string()}
        yield pa.Table.from_pydict({c: pa.array([r[c] for r in out], t) for c, t in kinds.items()})


def register(spark: SparkSession) -> None:
    """Make ``text_slices`` known to SQL."""
    bounded_batches(spark)
    spark.udtf.register("text_slices", TextSlices)


def _dense(c: Column | str) -> Column:
    """Characters without line ends and spaces."""
    return F.length(F.translate(T.col(c), "\n ", "")).cast("long")


def conservation(docs: DataFrame, chapters: DataFrame, key: str = "doc_id", overlap: int = OVERLAP) -> DataFrame:
    """Text lost by splitting, per document: ``warn`` above 5 %, ``info`` above 1 %, else ``ok``."""
    kept = chapters.groupBy(key).agg(
        F.sum(_dense("text")).alias("kept"), F.count_if(F.col("chapter_id").rlike(r"_\d+$")).alias("slices")
    )
    whole = docs.select(key, _dense("text").alias("original")).join(kept, key, "left").where("original > 0")
    lost = F.col("original") - (F.coalesce("kept", F.lit(0)) - F.coalesce("slices", F.lit(0)) * overlap)
    ratio = T.decimal_round(lost.cast("double") / F.col("original"))
    return whole.select(key, "original", lost.alias("lost"), ratio.alias("ratio")).withColumn(
        "severity", F.when(F.col("ratio") > 0.05, "warn").when(F.col("ratio") > 0.01, "info").otherwise("ok")
    )


def merged_slices(rows: DataFrame, order: str) -> DataFrame:
    """Slices of a chapter (``_n`` suffix) as one row: the first slice's scene, skills first-wins by name.

    A slice's skills are cut to their first mentions in its row and go to their chapter as one array: no name is a row.
    """
    base = rows.withColumn("chapter_id", F.regexp_replace("chapter_id", r"_\d+$", ""))
    own = base.select("book_name", "chapter_id", F.col(order).alias("_order"), "scene_type", F.array_distinct("skills").alias("_skills"))
    slices = F.array_sort(F.collect_list(F.when(F.size("_skills") > 0, F.struct("_order", "_skills"))))
    out = own.groupBy("book_name", "chapter_id").agg(F.min_by("scene_type", "_order").alias("scene_type"), slices.alias("_slices"))
    names = F.array_distinct(F.flatten(F.transform("_slices", lambda s: s["_skills"])))
    return out.select("book_name", "chapter_id", "scene_type", F.when(F.size("_slices") > 0, names).alias("skills"))


def excerpts(chapters: DataFrame, size: int = 200) -> DataFrame:
    """Two rows for each chapter: its opening and its ending."""
    end = F.when(F.length("text") <= size, F.col("text")).otherwise(F.substring("text", -size, size))
    pair = F.array(F.struct(F.lit("opening").alias("position"), F.substring("text", 1, size).alias("excerpt")), F.struct(F.lit("ending").alias("position"), end.alias("excerpt")))
    return chapters.select(*(c for c in chapters.columns if c != "text"), F.inline(pair))


def volumes(indexed: DataFrame, parts: int = 10, most: int = 75) -> DataFrame:
    """Volume number and label of each chapter of ``(.., idx, n)``."""
    per = F.least(F.ceil(F.col("n") / parts), F.lit(most)).cast("int")
    out = indexed.withColumn("per_volume", per).withColumn("volume", F.floor(F.col("idx") / F.col("per_volume")).cast("int"))
    label = F.concat(F.col("volume") * F.col("per_volume") + 1, F.lit("-"), (F.col("volume") + 1) * F.col("per_volume"))
    return out.withColumn("chapter_range", label)


def batches(indexed: DataFrame, size: int) -> DataFrame:
    return indexed.withColumn("batch", F.floor(F.col("idx") / size).cast("int"))


def sliding_windows(indexed: DataFrame, step: int = 25) -> DataFrame:
    """Each row in the windows of two steps that cover it (a window starts at every step)."""
    last = F.floor(F.col("idx") / step).cast("int")
    return indexed.withColumn("window", F.explode(F.filter(F.array(last - 1, last), lambda w: w >= 0)))
