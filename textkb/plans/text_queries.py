"""Queries over cleaning steps, text statistics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, statistics
from ..operators.lexicon import lexicon_counts
from .base import CHAPTERS, chapters, query, table

S = T.SPACE


def _digest(df, key, value, name="digest"):
    return df.select(key, F.length(value).cast("long").alias("chars"), F.md5(value).alias(name))


def _step(name: str, function, sql: str, source: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    """A cleaning step over a whole table, told by length and md5 of each result."""

    @query(name, f"SELECT {key}, length(x)::BIGINT AS chars, md5(x) AS digest FROM (SELECT {key}, {sql} AS x FROM {source})")
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return df.select(key, function(column).alias("x")).select(key, F.length("x").cast("long").alias("chars"), F.md5("x").alias("digest"))


def _removed(column: str, patterns, flags: str) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p}', '', '{flags}')"
    return column


_step("txt_01_newlines", T.unix_newlines, r"regexp_replace(text, '\r\n?', chr(10), 'g')")
_step("txt_02_ads", T.without_ads, _removed("text", T.AD_PATTERNS, "gi"))
_step("txt_02_ads_pages", lambda c: T.without_ads(c, (r"<!-- ad.*?-->", r"http://.*?\.com")), _removed("html", (r"<!-- ad.*?-->", r"http://.*?\.com"), "gi"), "pages", "page_id", "html")
_step("txt_03_symbol_lines", T.without_symbol_lines, _removed("text", [T.SYMBOL_LINE], "g"))
_step("txt_04_noise_lines", T.without_noise_lines, _removed("text", ["(?m)" + p for p in T.NOISE_LINES], "gi"))
_step("txt_06_controls", T.without_controls, _removed("text", [T.CONTROL], "g"))
_step("txt_07_collapse", T.collapsed, r"regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")
_TRIM = rf"regexp_replace(%s, '^[{S}]+|[{S}]+$', '', 'g')"
_step("txt_08_trim_lines", T.trimmed_lines, _TRIM % f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_TRIM % 'x'}), chr(10))")
_step("txt_09_braces", T.full_width_braces, "translate(html, '{}', '｛｝')", "pages", "page_id", "html")
_step("txt_15_xml_safe", T.xml_safe, _removed("text", [T.XML_ILLEGAL], "g"))


@query("txt_05_author_notes", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents
), marked AS (
  SELECT *, regexp_matches(line, '^The |idiot') AS t, regexp_matches(line, '^(Er|Th)') AS h FROM lines
), set_flip AS (
  SELECT *, CASE WHEN t AND NOT h THEN 1 WHEN h AND NOT t THEN 0 END AS s, sum((t AND h)::INT) OVER (PARTITION BY doc_id ORDER BY no) AS flips FROM marked
), stated AS (
  SELECT *, (coalesce(last_value(s IGNORE NULLS) OVER w, 0) + coalesce(last_value(flips) OVER w, 0)
    - coalesce(last_value(CASE WHEN s IS NOT NULL THEN flips END IGNORE NULLS) OVER w, 0)) % 2 AS state
  FROM set_flip WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS x FROM stated WHERE (state = 0 AND NOT t) OR (state = 1 AND h) GROUP BY doc_id
)
SELECT d.doc_id, length(coalesce(x, ''))::BIGINT AS chars, md5(coalesce(x, '')) AS digest FROM documents d LEFT JOIN kept USING (doc_id)
""")
def txt_05(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(clean.without_author_notes(docs, "doc_id", "text", "^The |idiot", "^(Er|Th)"), "doc_id", "text")


_CLEAN = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
_CLEAN = _removed(_removed(_removed(_CLEAN, T.AD_PATTERNS, "gi"), [T.SYMBOL_LINE], "g"), ["(?m)" + p for p in T.NOISE_LINES], "gi")
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '{T.CONTROL}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"


@query("txt_clean_chain", f"""
SELECT doc_id, length(x)::BIGINT AS chars, md5(x) AS digest, length(x) < 500 AS is_short
FROM (SELECT doc_id, {_TRIM % f"array_to_string(list_transform(string_split({_CLEAN}, chr(10)), lambda y: {_TRIM % 'y'}), chr(10))"} AS x FROM documents)
""")
def txt_chain(spark, sf_dir):
    out = clean.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), "is_short")


@query("txt_10_short_flag", "SELECT doc_id, length(text) < 500 AS is_short FROM documents")
def txt_10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_short("text").alias("is_short"))


@query("txt_11_mojibake", f"SELECT doc_id, regexp_matches(text, '{T.MOJIBAKE}') AS dirty FROM documents")
def txt_11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_mojibake("text").alias("dirty"))


@query("txt_12_mojibake_delete", f"SELECT source, count(*)::BIGINT AS kept FROM documents WHERE NOT regexp_matches(text, '{T.MOJIBAKE}') GROUP BY source")
def txt_12(spark, sf_dir):
    return clean.swept(table(spark, sf_dir, "documents").select("source", "text"), ["text"]).groupBy("source").agg(F.count("*").alias("kept"))


@query("txt_12_mojibake_blank", f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{T.MOJIBAKE}') THEN '' ELSE text END AS text, regexp_matches(text, '{T.MOJIBAKE}') AS blanked FROM conversations""")
def txt_12_blank(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return clean.swept(c.withColumn("blanked", T.is_mojibake("text")), ["text"], "blank").select("conv_id", "turn", "text", "blanked")


@query("txt_13_known_words", r"""
SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: trim(w) <> '' AND NOT list_contains(['the', 'de', 'und', 'la'], trim(w))), ',') AS words FROM documents""")
def txt_13(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", T.joined_known(words, ("the", "de", "und", "la")).alias("words"))


@query("txt_14_scalar_items", "SELECT event_id, [event_type, (props::JSON->>'k')] AS items FROM events")
def txt_14(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    response = F.to_json(F.array(F.col("event_type"), F.get_json_object("props", "$.k"), F.col("props")))
    return e.select("event_id", T.scalar_items(response).alias("items"))


@query("txt_16_lexicon", """
SELECT doc_id, word, hits FROM (
  SELECT doc_id, word, ((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS hits
  FROM documents, (SELECT unnest(['idiot', 'stupid', 'the', 'keit', 'ción', 'eaux']) AS word)) WHERE hits > 0""")
def txt_16(spark, sf_dir):
    lexicon = spark.createDataFrame([(w,) for w in ("idiot", "stupid", "the", "keit", "ción", "eaux")], "word string")
    return lexicon_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon).drop("position")


@query("txt_16_word_table", r"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')) AS word FROM benchmark),
l AS (SELECT word, 'item ' || min(item_id) AS reason, 'stands in ' || count(DISTINCT item_id) || ' items' AS replace_hint FROM w GROUP BY word)
SELECT doc_id, word, ((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS hits, (instr(text, word) - 1)::INT AS position, reason, replace_hint
FROM documents JOIN l ON contains(text, word)""")
def txt_16_word_table(spark, sf_dir):
    """Over a thousand words with their reasons and hints, from a table: the words of the benchmark."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]{5,}"), F.lit(0))).alias("word"))
    lexicon = w.groupBy("word").agg(
        F.concat(F.lit("item "), F.min("item_id")).alias("reason"), F.concat(F.lit("stands in "), F.count_distinct("item_id"), F.lit(" items")).alias("replace_hint")
    )
    return lexicon_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon)


_RATIO = "round((%s)::DECIMAL(20,10), %d)::DOUBLE"


@query("sta_01_book_statistics", rf"""
WITH {CHAPTERS}, measured AS (
  SELECT book_name, length(text)::BIGINT AS chars,
    coalesce(list_sum(list_transform(regexp_extract_all(text, '[\"“”‘’「『''](.*?)[\"“”‘’」』'']', 1, 's'), lambda x: length(x))), 0)::BIGINT AS dialogue,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: length({_TRIM % 'x'})), lambda n: n > 0) AS p
  FROM chapters
), paragraphs AS (SELECT book_name, unnest(p) AS n FROM measured), by_paragraph AS (
  SELECT book_name, count(*)::BIGINT AS total_paragraphs, sum(n)::DOUBLE AS pc, count(*) FILTER (n < 50)::DOUBLE AS s,
    count(*) FILTER (n BETWEEN 50 AND 150)::DOUBLE AS m, count(*) FILTER (n > 150)::DOUBLE AS l FROM paragraphs GROUP BY book_name
), by_chapter AS (
  SELECT book_name, count(*)::BIGINT AS total_chapters, sum(chars)::BIGINT AS total_chars, floor(avg(chars))::BIGINT AS avg_chapter_chars,
    min(chars) AS min_chapter_chars, max(chars) AS max_chapter_chars, floor(median(chars))::BIGINT AS median_chapter_chars, sum(dialogue)::DOUBLE AS d
  FROM measured GROUP BY book_name
)
SELECT book_name, total_chapters, total_chars, avg_chapter_chars, min_chapter_chars, max_chapter_chars, median_chapter_chars,
  {_RATIO % ('d / total_chars', 4)} AS dialogue_ratio, {_RATIO % ('1 - ' + _RATIO % ('d / total_chars', 4), 4)} AS description_ratio, total_paragraphs,
  {_RATIO % ('pc / total_paragraphs', 2)} AS avg_paragraph_chars, {_RATIO % ('s / total_paragraphs', 4)} AS short_paragraph_ratio,
  {_RATIO % ('m / total_paragraphs', 4)} AS medium_paragraph_ratio, {_RATIO % ('l / total_paragraphs', 4)} AS long_paragraph_ratio
FROM by_chapter JOIN by_paragraph USING (book_name)
""")
def sta_01(spark, sf_dir):
    return statistics.book_statistics(chapters(spark, sf_dir, "book_name", "text"))


_DIALOGUE = "coalesce(list_sum(list_transform(regexp_extract_all(text, '[\"“”「『](.*?)[\"“”」』]', 1, 's'), lambda x: length(x))), 0)"
SCORE = (
    f"(CASE WHEN length(text) > 0 THEN least(1e0, 3e0 * {_DIALOGUE}::DOUBLE / length(text)) * 0.4e0"
    " + least(1e0, 200e0 * len(regexp_extract_all(text, '[！？…!?]'))::DOUBLE / length(text)) * 0.3e0"
    " + least(1e0, 8e0 * len(list_distinct(string_split(text, '')))::DOUBLE / length(text)) * 0.3e0 ELSE 0e0 END)"
)


@query("sta_02_chunk_score", f"SELECT doc_id, {_RATIO % (SCORE, 4)} AS score FROM documents")
def sta_02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.decimal_round(T.chunk_score("text", "[！？…!?]")).alias("score"))


@query("sta_03_dialogue", f"SELECT doc_id, len(regexp_extract_all(text, '[\"“”「『](.*?)[\"“”」』]', 1, 's'))::BIGINT AS quotes, {_DIALOGUE}::BIGINT AS dialogue_chars FROM documents")
def sta_03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.dialogue("text")).cast("long").alias("quotes"), T.dialogue_chars("text").alias("dialogue_chars"))


@query("sta_04_token_estimate", r"""
SELECT doc_id, w * 1.5e0 + (length(text) - w) * 0.25e0 AS tokens, w * 1.5e0 + (length(text) - w) * 0.25e0 <= 2000 AS fits
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[^\x00-\x7f]')) AS w FROM documents)""")
def sta_04(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens")).withColumn("fits", F.col("tokens") <= 2000)


def _cut_sql(limit: int, cuts) -> str:
    tail = f"substr(substr(text, 1, {limit}), {max(limit - 500, 0) + 1}, 500)"
    place = lambda b: f"CASE WHEN instr(reverse({tail}), '{b[::-1]}') > 0 THEN {max(limit - 500, 0)} + length({tail}) - instr(reverse({tail}), '{b[::-1]}') + 1 END"
    parts = ", ".join(f"(CASE WHEN {place(b)} - {len(b)} > {limit // 2} THEN {place(b)} END)" for b in cuts)
    return f"CASE WHEN length(text) <= {limit} THEN text ELSE substr(text, 1, coalesce({parts}, {limit})::INT) END"


@query("sta_05_cut_at_boundary", f"SELECT doc_id, length(x)::BIGINT AS chars, md5(x) AS digest FROM (SELECT doc_id, {_cut_sql(1000, T.CUTS)} AS x FROM documents)")
def sta_05(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents").select("doc_id", T.cut_at_boundary("text", 1000).alias("x")), "doc_id", "x")


@query("sta_09_book_metadata", "SELECT source AS book_name, count(*)::BIGINT AS chapters, sum(length(text))::BIGINT AS total_chars, list_sort(list_distinct(list(lang))) AS tags FROM documents GROUP BY source")
def sta_09(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return c.groupBy("book_name").agg(F.count("*").alias("chapters"), F.sum(F.length("text")).alias("total_chars"), F.array_sort(F.collect_set("category")).alias("tags"))


@query("key_01_ids", "SELECT doc_id, md5(to_json([coalesce(source, ''), coalesce(doc_id::VARCHAR, ''), 'chapter'])::VARCHAR) AS id FROM documents")
def key_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.key("source", "doc_id", F.lit("chapter")).alias("id"))
