"""Queries over chapter splitting and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chapters as C
from ..operators import sample
from .base import CHAPTERS, INDEXED, chapters, indexed, query, table
from .text_queries import _RATIO, SCORE

S = T.SPACE
_LINE_HEADING = rf"(?:^|\n+)[{S}]*(Th[^\n]{{0,30}})[{S}]*(?:\n+|$)"
_STRIP = rf"regexp_replace(%s, '^[{S}]+|[{S}]+$', '', 'g')"


@query("chk_01_headings", rf"""
WITH split AS (SELECT doc_id, string_split(regexp_replace(text, '{_LINE_HEADING}', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM documents),
parts AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM split),
named AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '序章' ELSE {_STRIP % 'string_split(x, chr(2))[1]'} END AS chapter_id,
  CASE WHEN i = 0 THEN {_STRIP % 'x'} ELSE {_STRIP % "substr(x, instr(x, chr(2)) + 1)"} END AS body FROM parts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chapter_idx, chapter_id, md5(body) AS digest FROM named WHERE length(body) > 100
""")
def chk_01(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(C.heading_chapters(F.col("text"), _LINE_HEADING)).alias("chapter_idx", "c"))
    return rows.select("doc_id", "chapter_idx", "c.chapter_id", F.md5("c.text").alias("digest"))


_BLOCKS = rf"""
cut AS (SELECT doc_id, unnest(range((length(text) - 1) // 5000 + 1)) AS i, text FROM documents WHERE length(text) > 0),
kept AS (SELECT doc_id, i, {_STRIP % 'substr(text, (i * 5000 + 1)::INT, 5000)'} AS body FROM cut),
blocks AS (SELECT doc_id, '分块_' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chapter_id, body FROM kept WHERE length(body) > 50)"""


@query("chk_02_fixed_blocks", f"WITH {_BLOCKS} SELECT doc_id, chapter_id, length(body)::BIGINT AS chars, md5(body) AS digest FROM blocks")
def chk_02(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(C.fixed_blocks(F.col("text"))))
    return rows.select("doc_id", "chapter_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("chk_03_semantic_slices")
def chk_03(spark, sf_dir):
    rows = C.split_chapters(table(spark, sf_dir, "documents"), size=2000, heading=_LINE_HEADING)
    return rows.select("doc_id", "chapter_idx", "chapter_id", "slice_no", F.length("text").cast("long").alias("chars"))


@query("chk_05_conservation", f"""
WITH {_BLOCKS}, k AS (SELECT doc_id, sum(length(translate(body, chr(10) || ' ', '')))::BIGINT AS kept, count(*) FILTER (regexp_matches(chapter_id, '_[0-9]+$'))::BIGINT AS slices FROM blocks GROUP BY doc_id),
o AS (SELECT doc_id, length(translate(text, chr(10) || ' ', ''))::BIGINT AS original FROM documents),
l AS (SELECT doc_id, original, original - (coalesce(kept, 0) - coalesce(slices, 0) * 200) AS lost FROM o LEFT JOIN k USING (doc_id) WHERE original > 0),
r AS (SELECT *, {_RATIO % ('lost::DOUBLE / original', 4)} AS ratio FROM l)
SELECT *, CASE WHEN ratio > 0.05e0 THEN 'warn' WHEN ratio > 0.01e0 THEN 'info' ELSE 'ok' END AS severity FROM r""")
def chk_05(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.conservation(docs, docs.select("doc_id", F.inline(C.fixed_blocks(F.col("text")))))


@query("chk_06_slice_merge", """
WITH s AS (SELECT source AS book_name, 'ch' || doc_id // 100 AS chapter_id, doc_id, lang AS scene_type, string_split(text, ' ') AS skills FROM documents),
u AS (SELECT book_name, chapter_id, doc_id, unnest(skills) AS name, unnest(range(len(skills))) AS i FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY book_name, chapter_id, name ORDER BY doc_id, i) AS r FROM u),
n AS (SELECT book_name, chapter_id, list(name ORDER BY doc_id, i) AS skills FROM f WHERE r = 1 GROUP BY ALL)
SELECT book_name, chapter_id, arg_min(scene_type, doc_id) AS scene_type, any_value(n.skills) AS skills FROM s JOIN n USING (book_name, chapter_id) GROUP BY book_name, chapter_id""")
def chk_06(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    slices = docs.select(
        F.col("source").alias("book_name"), F.concat(F.lit("ch"), F.floor(F.col("doc_id") / 100), F.lit("_"), F.col("doc_id") % 100 + 1).alias("chapter_id"),
        "doc_id", F.col("lang").alias("scene_type"), F.split("text", " ").alias("skills"),
    )
    return C.merged_slices(slices, "doc_id")


@query("chk_07_excerpts", """
SELECT doc_id, 'opening' AS position, substr(text, 1, 200) AS excerpt FROM documents
UNION ALL SELECT doc_id, 'ending', CASE WHEN length(text) <= 200 THEN text ELSE right(text, 200) END FROM documents""")
def chk_07(spark, sf_dir):
    return C.excerpts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("chk_08_chapter_number", r"SELECT page_id, coalesce(try_cast(regexp_extract(url, '([0-9]+)', 1) AS INT), 9999) AS number FROM pages")
def chk_08(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.chapter_number("url").alias("number"))


_IDX = f"WITH {CHAPTERS}, i AS (SELECT book_name, seq, {INDEXED} FROM chapters)"


@query("chk_09_volumes", f"""{_IDX}, v AS (SELECT *, least(ceil(n / 10e0), 75)::INT AS per_volume FROM i)
SELECT book_name, seq, idx, n, per_volume, (idx // per_volume)::INT AS volume, (idx // per_volume) * per_volume + 1 || '-' || (idx // per_volume + 1) * per_volume AS chapter_range FROM v""")
def chk_09(spark, sf_dir):
    return C.volumes(indexed(chapters(spark, sf_dir, "book_name", "seq")))


@query("chk_10_batches", f"{_IDX} SELECT book_name, (idx // 5)::INT AS batch, count(*)::BIGINT AS chapters, min(seq) AS first_seq FROM i GROUP BY ALL")
def chk_10(spark, sf_dir):
    b = C.batches(indexed(chapters(spark, sf_dir, "book_name", "seq")), 5)
    return b.groupBy("book_name", "batch").agg(F.count("*").alias("chapters"), F.min("seq").alias("first_seq"))


@query("chk_10_sliding_windows", f"{_IDX}, w AS (SELECT *, unnest([idx // 25 - 1, idx // 25]) AS w FROM i) SELECT book_name, w::INT AS \"window\", count(*)::BIGINT AS members, min(seq) AS first_seq FROM w WHERE w >= 0 GROUP BY ALL")
def chk_10_windows(spark, sf_dir):
    w = C.sliding_windows(indexed(chapters(spark, sf_dir, "book_name", "seq")))
    return w.groupBy("book_name", "window").agg(F.count("*").alias("members"), F.min("seq").alias("first_seq"))


_K = "greatest(10, least(n, floor(10e0 + 5 * sqrt(n / 100e0))::INT))"


@query("smp_01_best_per_interval", f"""
WITH {CHAPTERS}, s AS (SELECT book_name, seq, {_RATIO % (SCORE, 4)} AS score FROM chapters), i AS (SELECT *, {INDEXED} FROM s),
b AS (SELECT *, CASE WHEN n <= {_K} THEN idx ELSE ((idx + 1) * {_K} + n - 1) // n - 1 END AS b FROM i)
SELECT book_name, seq, score, idx, n FROM b QUALIFY row_number() OVER (PARTITION BY book_name, b ORDER BY score DESC, idx) = 1""")
def smp_01(spark, sf_dir):
    scored = chapters(spark, sf_dir).select("book_name", "seq", T.decimal_round(T.chunk_score("text", "[！？…!?]")).alias("score"))
    return sample.best_per_interval(indexed(scored))


@query("smp_02_uniform", f"{_IDX} SELECT book_name, seq, idx, n FROM i WHERE n <= {_K} OR ((idx * {_K} + n - 1) // n < {_K} AND ((idx * {_K} + n - 1) // n) * n // {_K} = idx)")
def smp_02(spark, sf_dir):
    return sample.uniform(indexed(chapters(spark, sf_dir, "book_name", "seq")))


@query("smp_03_first_last_step", f"{_IDX}, s AS (SELECT *, greatest(2, (n - 2) // ({_K} - 2)) AS step FROM i) SELECT book_name, seq, idx, n FROM s WHERE n <= 10 OR idx = 0 OR idx = n - 1 OR (idx >= step AND idx < n - 1 AND idx % step = 0)")
def smp_03(spark, sf_dir):
    return sample.first_last_step(indexed(chapters(spark, sf_dir, "book_name", "seq")))


_LINES = f"WITH {CHAPTERS}, l AS (SELECT book_name, seq, chapter_id || ': ' || substr(text, 1, 150) AS line FROM chapters), i AS (SELECT *, length(line) AS chars, {INDEXED} FROM l), t AS (SELECT *, sum(chars) OVER (PARTITION BY book_name) + n - 1 AS total FROM i)"


def _lines(spark, sf_dir):
    c = chapters(spark, sf_dir)
    line = F.concat("chapter_id", F.lit(": "), F.substring("text", 1, 150))
    return indexed(c.select("book_name", "seq", line.alias("line"))).withColumn("chars", F.length("line"))


@query("smp_04_head_middle_tail", f"""{_LINES}, m AS (SELECT *, greatest(floor(4000e0 / (total / n))::INT, 20) AS most FROM t), h AS (SELECT *, most // 4 AS head, most - 2 * (most // 4) AS mid, greatest(n - most // 4, most // 4) AS tail FROM m)
SELECT book_name, seq FROM h WHERE total <= 4000 OR idx < head OR idx >= tail OR (tail - head <= mid) OR
  (((idx - head) * mid + tail - head - 1) // (tail - head) < mid AND ((idx - head) * mid + tail - head - 1) // (tail - head) * (tail - head) // mid = idx - head)""")
def smp_04(spark, sf_dir):
    return sample.head_middle_tail(_lines(spark, sf_dir)).select("book_name", "seq")


@query("smp_05_compressed", f"""{_LINES} SELECT book_name, string_agg(line, chr(10) ORDER BY idx) AS digest FROM t
WHERE total <= 6000 OR n <= 20 OR idx < greatest(3, n // 4) OR idx >= n - greatest(3, n // 4) OR idx % 10 = 0 OR regexp_matches(line, 'keit|ción') GROUP BY book_name""")
def smp_05(spark, sf_dir):
    kept = sample.compressed_lines(_lines(spark, sf_dir), "keit|ción")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"])
    return kept.groupBy("book_name").agg(F.array_join(ordered, "\n").alias("digest"))


@query("smp_06_main_characters", f"""
WITH {CHAPTERS}, m AS (SELECT book_name, seq, substr(text, 1, 2) AS name, length(text) AS chars FROM chapters),
c AS (SELECT book_name, name, count(*)::BIGINT AS frequency FROM m GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY book_name ORDER BY frequency DESC, name)::INT AS place FROM c),
r AS (SELECT m.*, frequency, place, row_number() OVER (PARTITION BY book_name, name ORDER BY seq)::INT AS nth FROM m JOIN p USING (book_name, name) WHERE place <= 20 AND frequency >= 3),
u AS (SELECT *, sum(least(chars, 900) + 2) OVER (PARTITION BY book_name, name ORDER BY seq) - 2 > 3800 AS over FROM r WHERE nth <= 6)
SELECT book_name, name, frequency, place, nth, seq FROM u QUALIFY NOT bool_or(over) OVER (PARTITION BY book_name, name ORDER BY seq)""")
def smp_06(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return sample.main_characters(c.select("book_name", "seq", F.substring("text", 1, 2).alias("name"), F.length("text").alias("chars")))


@query("smp_07_everything", f"WITH {CHAPTERS}, s AS (SELECT book_name, seq FROM chapters) SELECT book_name, seq, {INDEXED} FROM s")
def smp_07(spark, sf_dir):
    return sample.best_per_interval(indexed(chapters(spark, sf_dir, "book_name", "seq")), everything=True)


@query("smp_08_active_cast", f"""
WITH {CHAPTERS}, f AS (SELECT book_name, seq, contains(text, 'idiot') AS a, contains(text, 'stupid') AS b, contains(text, 'keit') AS c FROM chapters),
w AS (SELECT book_name, seq, coalesce(bool_or(a) OVER x, false) AS a, coalesce(bool_or(b) OVER x, false) AS b, coalesce(bool_or(c) OVER x, false) AS c FROM f WINDOW x AS (PARTITION BY book_name ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT book_name, seq, list_concat(['the'], list_filter([CASE WHEN a THEN 'idiot' END, CASE WHEN b THEN 'stupid' END, CASE WHEN c THEN 'keit' END], lambda n: n IS NOT NULL)) AS "cast" FROM w""")
def smp_08(spark, sf_dir):
    return sample.active_cast(chapters(spark, sf_dir), ["the"], ["idiot", "stupid", "keit", "x"])


@query("chk_03_table_function")  # inherently sequential: tests hold the slices against a scan of every place
def chk_03_udtf(spark, sf_dir):
    """Every document as a chapter, through the table function."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("key"), F.lit(0).alias("chapter_idx"), F.concat(F.lit("ch"), "doc_id").alias("chapter_id"), "text")
    C.register(spark)
    return spark.sql("SELECT * FROM text_slices(TABLE({rows}))", rows=rows)
