"""Queries over names, saved API queries and the batch twin of the log monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import views as V
from ..operators.search import top_k_each
from ..sources import library as L
from ..streaming.streams import windowed_counts
from .base import ORACLES, QUERIES, query, table

_TABLES = {n.split("_", 2)[2]: n for n in list(QUERIES) if n.startswith("ing_") and n.split("_", 2)[2] in I.KINDS}


def _has(*columns: str) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '%e%'" for c in columns) + ")"


#: What each view is asked, and the condition and order that this means. The SQL is stated for itself, not taken from VIEWS.
_ASKED = {
    "worldbuilding_settings": ({"query": "E", "module": "e"}, f"{_has('entity', 'content')} AND {_has('module')}", "id"),
    "worldbuilding_timeline": ({"book_name": "1"}, "book_name = '1'", "era_or_year, id"),
    "worldbuilding_search": ({"query": "e"}, _has("module", "entity", "content"), "id"),
    "worldbuilding_conflicts": ({"book_name": "3"}, "book_name = '3'", "id"),
    "worldbuilding_factions": ({"book_name": "4"}, "book_name = '4'", "id"),
    "worldbuilding_setting_evolutions": ({"book_name": "5", "setting_module": "e"}, f"book_name = '5' AND {_has('setting_module')}", "id"),
    "character_profile": ({"role_type": "e", "character_name": "e"}, f"{_has('role_type')} AND {_has('name')}", "id"),
    "character_speech_style": ({"book_name": "7", "character_name": "e"}, f"book_name = '7' AND {_has('character_name')}", "id"),
    "character_behavior": ({"character_name": "E"}, _has("character_name"), "id"),
    "character_relationship": ({"character_a": "e", "character_b": "e"}, _has("character_a", "character_b"), "id"),
    "character_search": ({"query": "e"}, _has("name", "role_type", "personality"), "id"),
    "plot_subplots": ({}, "line_type <> 'main'", "id"),
    "plot_foreshadowing": ({"status": "open"}, "status = 'open'", "id"),
    "plot_chapter_functions": ({"book_name": "2"}, "book_name = '2'", "id"),
    "plot_volume_outlines": ({"book_name": "2"}, "book_name = '2'", "volume_index NULLS LAST, id"),
    "plot_revelation_pacing": ({"book_name": "3"}, "book_name = '3'", "id"),
    "plot_emotion_transitions": ({"book_name": "4"}, "book_name = '4'", "id"),
    "plot_information_management": ({"book_name": "5"}, "book_name = '5'", "id"),
    "plot_climax_buildup": ({"book_name": "6"}, "book_name = '6'", "id"),
    "plot_conflict_escalation": ({"book_name": "7"}, "book_name = '7'", "id"),
    "style_fingerprint": ({"query": "e"}, _has("narrative_perspective"), "id"),
    "style_sensory": ({"emotion": "e"}, _has("emotion"), "id"),
    "style_dialogue_samples": ({"scene_type": "e"}, _has("scene_type"), "writing_quality NULLS LAST, id"),
    "style_description_samples": ({"description_type": "e", "query": "E"}, f"{_has('description_type')} AND {_has('original_text')}", "id"),
    "style_skills": ({"scene_type": "e", "skill_name": "e"}, f"{_has('scene_type')} AND {_has('skill_name')}", "id"),
    "style_transitions": ({"transition_type": "e"}, _has("transition_type"), "id"),
    "style_narrative_distance": ({"distance_type": "e"}, _has("distance_type"), "id"),
    "style_show_tell": ({"pattern_type": "e"}, _has("pattern_type"), "id"),
    "excerpt_search": ({"query": "e"}, _has("style_tag", "excerpt_text"), "id"),
    "excerpt_dialogue": ({"query": "e", "scene_type": "e"}, f"{_has('original_text')} AND {_has('scene_type')}", "id"),
    "excerpt_description": ({"query": "e"}, _has("original_text"), "id"),
    "excerpt_classic": ({"query": "e", "style_tag": "e"}, f"{_has('excerpt_text')} AND {_has('style_tag')}", "id"),
    "search_climax": ({"query": "e", "excerpt_type": "e"}, f"{_has('original_text')} AND {_has('excerpt_type')}", "id"),
    "search_quotes": ({"quote_type": "e"}, _has("quote_type"), "id"),
    "search_style": ({"query": "e"}, _has("sentence_rhythm", "imagery"), "id"),
    "search_plot": ({"query": "e"}, _has("theme", "line_type"), "id"),
    "review": ({}, "true", "id"),
    "recommend": ({}, "true", "id"),
    "compare": ({"comparison_dimension": "e"}, _has("comparison_dimension"), "id"),
    "mistakes": ({"dimension": "", "mistake_name": "e"}, _has("mistake_name"), "frequency DESC NULLS LAST, id"),
    "combos": ({"scene_type": "e", "combo_name": "e"}, f"{_has('scene_type')} AND {_has('combo_name')}", "id"),
    "plot_line_nodes": ({}, "true", "id"),
    "events": ({"chapter_range": "2-4"}, "try_cast(regexp_extract(chapter_id, '(\\d+)', 1) AS INT) BETWEEN 2 AND 4", "try_cast(regexp_extract(chapter_id, '(\\d+)', 1) AS INT), chapter_id, id"),
}


def _register(no: int, name: str, asked: dict, condition: str, order: str) -> None:
    """Views in turn from the start of the list or further on."""
    of, offset = V.VIEWS[name].table, 5 * (no % 3 == 2)
    source = _TABLES[of]

    @query(f"view_{name}", f"SELECT * FROM ({ORACLES[source]}) WHERE {condition} ORDER BY {order} LIMIT 50 OFFSET {offset}")
    def run(spark, sf_dir):
        return V.view({of: QUERIES[source](spark, sf_dir)}, name, offset=offset, **asked)


for _no, (_name, _of) in enumerate(_ASKED.items()):
    _register(_no, _name, *_of)
assert set(_ASKED) == {n for n, v in V.VIEWS.items() if v.table not in V.COMPUTED}

_SAMPLES = ("dialogue_samples", "description_samples", "transition_samples")


def _summary_sql(name: str, kind: str, value: str, text: str) -> str:
    """One kind of summary in SQL: sizes and lengths of a group, and its first three values by chapter number and id."""
    group = f"coalesce({kind}, '未知')" if kind else "'转场'"
    number = "coalesce(try_cast(regexp_extract(chapter_id, '(\\d+)', 1) AS INT), 99999)"
    return f"""SELECT md5(to_json([book_name, '{name}', k])::VARCHAR) AS id, book_name, category, '{name}' AS summary_type, k AS scene_or_desc_type, {text} AS style_description, '样本数:' || size AS key_features
FROM (SELECT book_name, {group} AS k, count(*) AS size, floor(avg(length(original_text)))::BIGINT AS chars, '' AS category,
  coalesce(array_to_string((list({value} ORDER BY {number}, id) FILTER ({value} <> ''))[1:3], '、'), '') AS told,
  {"coalesce(array_to_string(list_sort(list_distinct((list(transition_type ORDER BY " + number + ", id) FILTER (transition_type <> ''))[1:5])), '、'), '')" if not kind else "''"} AS kinds
  FROM ({ORACLES[_TABLES[{'dialogue': _SAMPLES[0], 'description': _SAMPLES[1], 'transition': _SAMPLES[2]}[name]]]}) GROUP BY ALL HAVING count(*) >= 2)"""


_SUMMARIES = " UNION ALL ".join((
    _summary_sql("dialogue", "scene_type", "emotional_tension", "'本书的' || k || '对话特点：平均长度' || chars || '字，' || CASE WHEN told <> '' THEN '情绪张力类型包括：' || told ELSE '' END"),
    _summary_sql("description", "description_type", "technique_analysis", "'本书的' || k || '描写特点：平均长度' || chars || '字，' || CASE WHEN told <> '' THEN '常用技法：' || told ELSE '' END"),
    _summary_sql("transition", "", "technique_analysis", "'本书的转场手法：常用类型包括' || kinds || '，' || CASE WHEN told <> '' THEN '技法特点：' || told ELSE '' END"),
))


@query("sta_06_summary_rows", _SUMMARIES)
def sta_06_rows(spark, sf_dir):
    return V.style_summaries(*(QUERIES[_TABLES[t]](spark, sf_dir) for t in _SAMPLES))


@query("view_style_summaries", f"SELECT * FROM ({_SUMMARIES}) WHERE book_name = '1' AND summary_type = 'dialogue' ORDER BY id LIMIT 50")
def view_style_summaries(spark, sf_dir):
    return V.view({"style_summaries": sta_06_rows(spark, sf_dir)}, "style_summaries", book_name="1", summary_type="dialogue")


@query("view_style_statistics", f"SELECT * FROM ({ORACLES['sta_01_book_statistics']}) WHERE book_name = 'src3'")
def view_style_statistics(spark, sf_dir):
    return V.view({"book_statistics": QUERIES["sta_01_book_statistics"](spark, sf_dir)}, "style_statistics", book_name="src3")


@query("view_comprehensive", """
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 50),
h AS (SELECT 'c' || label AS collection, vec_id AS id, list_sum(list_transform(range(1, len(q) + 1), lambda i: (embedding[i]::DOUBLE - q[i]::DOUBLE) ** 2)) AS distance FROM embeddings, q),
k AS (SELECT *, CASE WHEN collection IN ('c0', 'c1') THEN 'even and one' ELSE 'rest' END AS dimension FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY distance, id) AS r FROM h) WHERE r <= 5 AND collection <> 'c9')
SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY distance, id)::INT AS place, collection, id, round(distance::DECIMAL(20,10), 4)::DOUBLE AS distance FROM k QUALIFY place <= 5""")
def view_comprehensive(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 50").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query"))
    vectors = v.select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), "label").alias("collection"), "embedding")
    dimensions = {f"c{i}": "even and one" if i < 2 else "rest" for i in range(9)}
    return V.comprehensive(top_k_each(vectors, q, 5, ["collection"]), dimensions).withColumn("distance", F.round(F.col("distance").cast("decimal(20,10)"), 4).cast("double"))


@query("view_by_book", """
SELECT 'documents' AS table_name, source AS book_name, count(*)::BIGINT AS records FROM documents GROUP BY source
UNION ALL SELECT 'labels', source, count(*) FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def view_by_book(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"), "doc_id")
    return V.by_book({"documents": d, "labels": d.join(table(spark, sf_dir, "labels"), "doc_id")})


@query("view_books", """
SELECT source AS book_name, min(lang) AS category, array_to_string(list_sort(list(DISTINCT lang)), ',') AS genre_tags, 'author of ' || source AS author, max(doc_id) AS added_at, count(*)::BIGINT AS chapters
FROM documents GROUP BY source HAVING contains(min(lang), 'd') AND contains(array_to_string(list_sort(list(DISTINCT lang)), ','), 'en') AND contains('author of ' || source, '1') ORDER BY added_at DESC, book_name LIMIT 50""")
def view_books(spark, sf_dir):
    m = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book_name")).agg(
        F.min("lang").alias("category"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("genre_tags"), F.concat(F.lit("author of "), F.first("source")).alias("author"),
        F.max("doc_id").alias("added_at"), F.count("*").alias("chapters"),
    )
    return V.books(m, "D", "EN", "1")


@query("view_patterns", f"""
SELECT origin, id, name FROM (SELECT * FROM (SELECT 0 AS n, 'comparison' AS origin, created_at AS t, id, comparison_dimension AS name FROM ({ORACLES['ing_18_cross_book_comparisons']}) WHERE {_has('comparison_dimension')} ORDER BY created_at DESC, id LIMIT 30)
UNION ALL SELECT * FROM (SELECT 1, 'combination', NULL, id, combo_name FROM ({ORACLES['ing_18_technique_combinations']}) WHERE {_has('scene_type', 'combo_name')} ORDER BY id LIMIT 30)) ORDER BY n, t DESC NULLS LAST, id LIMIT 30""")
def view_patterns(spark, sf_dir):
    return V.patterns(QUERIES["ing_18_cross_book_comparisons"](spark, sf_dir), QUERIES["ing_18_technique_combinations"](spark, sf_dir), "e", most=30)


_RAW = "CASE WHEN c_custkey % 3 = 0 THEN '《' || c_name || '》作者：' || c_mktsegment || ' 分类：c' || c_nationkey || ' 标签：a、 b、' || c_nationkey WHEN c_custkey % 3 = 1 THEN c_name || ' by ' || c_mktsegment ELSE c_name || '[番外]' END"


def _names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key, name, segment, nation = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit("《"), name, F.lit("》作者："), segment, F.lit(" 分类：c"), nation, F.lit(" 标签：a、 b、"), nation)).when(key % 3 == 1, F.concat(name, F.lit(" by "), segment)).otherwise(F.concat(name, F.lit("[番外]")))
    return c.select(key, raw.alias("raw"), nation)


@query("src_02_title", "SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 3 = 2 THEN '[番外]' ELSE '' END AS suffix FROM customer")
def src_02(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", L.book_title("raw").alias("title"), L.title_suffix("raw").alias("suffix"))


@query("src_03_descriptor", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '未知作者' ELSE c_mktsegment END AS author, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_nationkey ELSE 'fantasy' END AS category,
  CASE WHEN c_custkey % 3 = 0 THEN ['a', 'b', c_nationkey::VARCHAR] ELSE [] END AS tags FROM customer""")
def src_03(spark, sf_dir):
    path = F.concat(F.lit("root/fantasy(合集)/"), F.col("raw"), F.lit(".txt"))
    rows = _names(spark, sf_dir).withColumn("path", path)
    return rows.select("c_custkey", L.author("raw").alias("author"), L.category("raw", "path").alias("category"), L.tags("raw").alias("tags"))


@query("src_04_canonical", """
SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 3 = 2 THEN '番外' ELSE '' END AS kind,
  CASE WHEN c_custkey % 3 = 0 THEN replace(c_mktsegment, ' ', '') || '分类：c' || c_nationkey || '标签：a、b、' || c_nationkey WHEN c_nationkey % 3 = 0 THEN '作家甲' WHEN c_nationkey % 3 = 1 THEN '作家乙' ELSE '未知' END AS author FROM customer""")
def src_04(spark, sf_dir):
    n = F.col("c_nationkey") % 3
    folder = F.when(n == 0, "作家甲（3本）合集").when(n == 1, "凡人修仙传").otherwise("诛仙")
    parent = F.when(n == 1, "作家乙小说").otherwise("三体·书籍")
    rows = _names(spark, sf_dir)
    return rows.select("c_custkey", L.canonical_name("raw", folder, parent).alias("n")).select("c_custkey", "n.title", "n.kind", "n.author")


@query("src_05_decoded", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '第一章 ' || c_name WHEN 1 THEN '你好' || c_name WHEN 2 THEN c_name ELSE c_name || ' café' END AS text FROM customer""")
def src_05(spark, sf_dir):
    """UTF-8, GBK, UTF-16 with its mark, and Latin-1 (an odd number of bytes)."""
    c, name, n = table(spark, sf_dir, "customer"), F.col("c_name"), F.col("c_custkey") % 4
    gbk, mark = F.unhex(F.lit("C4E3BAC3")), F.unhex(F.lit("FFFE"))
    raw = F.when(n == 0, F.encode(F.concat(F.lit("第一章 "), name), "UTF-8")).when(n == 1, F.concat(gbk, F.encode(name, "UTF-8"))).when(n == 2, F.concat(mark, F.encode(name, "UTF-16LE"))).otherwise(F.encode(F.concat(name, F.lit(" café")), "ISO-8859-1"))
    return L.texts(c.select(F.col("c_custkey").cast("string").alias("path"), raw.alias("content"))).select(F.col("path").cast("long").alias("c_custkey"), "text")


@query("src_06_merged", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY lpad(turn::VARCHAR, 6, '0'), text) AS text FROM conversations GROUP BY conv_id")
def src_06(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return L.merged(c.select("conv_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("path"), "text"), "conv_id")


@query("str_02_monitor", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS searches FROM events GROUP BY ALL")
def str_02(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
