"""Queries over filters, vector search, hybrid retrieval and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import search as S
from ..operators import textindex as X
from ..operators.scratch import shared_folder
from . import ingest_queries  # noqa: F401 (its SQL comes first)
from .base import ORACLES, query, table

_Q = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0"
_DIST = "list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_ROUND = lambda c: f"round(({c})::DECIMAL(20,10), 4)::DOUBLE"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _queries(spark, sf_dir, every=50):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _told(df, *columns):
    return df.select(*columns, F.round(F.col("distance").cast("decimal(20,10)"), 4).cast("double").alias("distance"))


@query("vec_01_top_k", f"SELECT query_id, vec_id AS id, rank, {_ROUND('d')} AS distance FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, {_DIST} AS d FROM embeddings, ({_Q}))) WHERE rank <= 10")
def vec_01(spark, sf_dir):
    return _told(S.top_k_each(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10), "query_id", "id", "rank")


@query("vec_02_filtered", f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, label, {_ROUND('d')} AS distance FROM (SELECT vec_id, label, {_DIST} AS d FROM embeddings, q WHERE label = 3) ORDER BY d, vec_id LIMIT 10")
def vec_02(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    return _told(S.top_k(_vectors(spark, sf_dir), q, 10, {"label": 3}), "id", "label")


@query("vec_03_fan_out", f"SELECT query_id, label, vec_id AS id, rank FROM (SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY {_DIST}, vec_id)::INT AS rank FROM embeddings, ({_Q})) WHERE rank <= 3")
def vec_03(spark, sf_dir):
    return S.top_k_each(_vectors(spark, sf_dir), _queries(spark, sf_dir), 3, ["label"]).select("query_id", "label", "id", "rank")


@query("vec_04_hybrid", f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_DIST}, vec_id)::INT AS rank FROM embeddings, q QUALIFY rank <= 10),
s AS (SELECT doc_id AS id FROM documents WHERE text ILIKE '%idiot%' AND doc_id NOT IN (SELECT id FROM v)),
u AS (SELECT id, rank, 'semantic' AS leg FROM v UNION ALL SELECT id, NULL, 'structured' FROM s)
SELECT * FROM u ORDER BY leg, rank NULLS LAST, id LIMIT 20""")
def vec_04(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query"))
    hits = S.top_k_each(_vectors(spark, sf_dir), q, 10).select("id", "rank")
    rows = S.like(table(spark, sf_dir, "documents"), "text", "idiot").select(F.col("doc_id").alias("id"))
    return S.hybrid(hits, rows, 20)


@query("vec_05_enhance", f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 100), v AS (SELECT 'vectors' AS origin, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY {_DIST}, vec_id) AS r FROM embeddings, q WHERE label IN (1, 2)),
s AS (SELECT 'documents' AS origin, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE text ILIKE '%stupid%' AND lang = 'en'),
b AS (SELECT 'benchmark' AS origin, item_id AS id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark)
SELECT origin, id FROM v WHERE r <= 5 UNION ALL SELECT origin, id FROM s WHERE r <= 10 UNION ALL SELECT origin, id FROM b WHERE r <= 5""")
def vec_05(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id = 100").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query"))
    tag = lambda df, name: df.select(F.lit(name).alias("origin"), F.col("id"))
    v = S.top_k_each(_vectors(spark, sf_dir).where("label in (1, 2)"), q, 5, ["label"])
    d = S.page(S.like(S.equals(table(spark, sf_dir, "documents"), lang="en"), "text", "stupid").withColumnRenamed("doc_id", "id"), ["id"], 10)
    b = S.page(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), ["id"], 5)
    return tag(v, "vectors").unionByName(tag(d, "documents")).unionByName(tag(b, "benchmark"))


@query("vec_06_context", f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 200), v AS (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY {_DIST}, vec_id)::INT AS rank FROM embeddings, q WHERE label IN (4, 5, 6)) SELECT * FROM v WHERE rank <= 4")
def vec_06(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id = 200").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query"))
    return S.top_k_each(_vectors(spark, sf_dir).where("label in (4, 5, 6)"), q, 4, ["label"]).select("label", "id", "rank")


def _rule_sql() -> str:
    words = {S.ELEMENTS: "array_to_string(elements, ' ')", S.MOOD: "mood"}
    cases = []
    for stages, either, subs, entries in S.LOOKUPS:
        parts = ["stage IN (" + ", ".join(f"'{x}'" for x in stages) + ")"] + (["sub_type IN (" + ", ".join(f"'{x}'" for x in subs) + ")"] if subs else [])
        rows = ", ".join(f"{{'bucket': '{b}', 'table_name': '{t}', 'field': '{f}', 'term': {words.get(w, repr(w))}}}" for b, t, f, w in entries)
        cases.append(f"WHEN {(' OR ' if either else ' AND ').join(parts)} THEN [{rows}]")
    return f"CASE {' '.join(cases)} END"


_STAGE_NAMES = ("世界观设计", "人物设计", "大纲设计", "正文写作", "修改打磨", "其他")
_SUB_NAMES = ("打斗场景", "环境描写", "决战", "推理场景", "情感对话", "其他", "地理设计")


@query("vec_07_lookups", f"""
WITH c AS (SELECT event_id AS context_id, {list(_STAGE_NAMES)}[(event_id % 6 + 1)::INT] AS stage, {list(_SUB_NAMES)}[(event_id % 7 + 1)::INT] AS sub_type, event_type AS mood, [event_type, user_id::VARCHAR] AS elements FROM events),
r AS (SELECT context_id, unnest({_rule_sql()}) AS x FROM c) SELECT context_id, x.bucket, x.table_name, x.field, x.term FROM r""")
def vec_07(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    c = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("context_id"), pick(_STAGE_NAMES).alias("stage"), pick(_SUB_NAMES).alias("sub_type"),
        F.col("event_type").alias("mood"), F.array("event_type", F.col("user_id").cast("string")).alias("elements"),
    )
    return S.lookups(c)


@query("vec_08_templates", "SELECT event_id, 'scene:' || event_type || chr(10) || 'who:' || user_id || chr(10) || 'k:' || coalesce(props::JSON->>'k', '') AS document FROM events")
def vec_08(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select("event_id", S.document_text({"scene": "event_type", "who": "user_id", "k": "k"}).alias("document"))


@query("vec_09_recount", "SELECT label AS collection, count(*)::BIGINT AS vectors FROM embeddings GROUP BY label")
def vec_09(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("vectors"))


@query("flt_02_indexed", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%worthless%' OR source ILIKE '%worthless%'")
def flt_02_indexed(spark, sf_dir):
    """Documents saved by source and language, with an index of their trigrams: files without the word are not read."""
    saved, index = shared_folder(spark), shared_folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").write.partitionBy("source", "lang").parquet(saved)
    X.build(spark.read.parquet(saved), ["text", "source"], index)
    return X.like(spark, saved, index, ["text", "source"], "WORTHLESS").select("doc_id", "lang")


# --- filters, orders, sets ---------------------------------------------------------------------------

_FILTERS = {
    "flt_01_equal": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", lambda s, d: S.equals(table(s, d, "customer"), c_mktsegment="BUILDING", c_name="").select("c_custkey", "c_name")),
    "flt_02_like": ("SELECT doc_id FROM documents WHERE text ILIKE '%IDIOT%'", lambda s, d: S.like(table(s, d, "documents"), "text", "IDIOT").select("doc_id")),
    "flt_03_like_any": ("SELECT p_partkey FROM part WHERE p_name ILIKE '%1%' OR p_brand ILIKE '%1%'", lambda s, d: S.like(table(s, d, "part"), ["p_name", "p_brand"], "1").select("p_partkey")),
    "flt_04_optional": ("SELECT doc_id FROM documents WHERE lang = 'fr' AND source ILIKE '%src1%'", lambda s, d: S.like(S.equals(table(s, d, "documents"), lang="fr", source=None), "source", "src1").select("doc_id")),
    "flt_05_number_range": ("SELECT page_id, number FROM (SELECT page_id, coalesce(try_cast(regexp_extract(url, '([0-9]+)', 1) AS INT), 9999) AS number FROM pages) WHERE number BETWEEN 1 AND 500", None),
    "flt_06_page": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40", lambda s, d: S.page(table(s, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40).select("o_orderkey", "o_totalprice")),
    "flt_07_renamed": ("SELECT event_id AS id, event_type AS kind FROM events", lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))),
    "flt_08_decoded": ("SELECT event_id, coalesce((props::JSON->>'k')::INT, 0) AS k, []::VARCHAR[] AS tags FROM events", lambda s, d: table(s, d, "events").withColumn("p", F.from_json("props", "k int, tags array<string>")).select("event_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"))),
    "flt_09_split": ("SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents", lambda s, d: table(s, d, "documents").select("doc_id", F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "").alias("items"))),
    "flt_10_shortened": ("SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS excerpt FROM documents", None),
    "srt_02_frequency": ("SELECT event_type, count(*)::BIGINT AS frequency FROM events GROUP BY event_type ORDER BY frequency DESC, event_type LIMIT 3", lambda s, d: S.page(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("frequency")), [F.desc("frequency"), F.col("event_type")], 3)),
    "srt_01_latest": ("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25", lambda s, d: S.page(table(s, d, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 25)),
    "set_01_tagged_union": ("SELECT 'customer' AS origin, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier", lambda s, d: table(s, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name")).unionByName(table(s, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name")))),
    "set_03_difference": ("SELECT source, list_sort(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(l, x))) AS missing FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source)", lambda s, d: table(s, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("l")).select("source", F.array_sort(F.array_except(F.array(*map(F.lit, ("de", "en", "es", "fr", "it"))), "l")).alias("missing"))),
    "set_04_union": ("SELECT doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE lang = 'es'", lambda s, d: table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).union(table(s, d, "documents").where("lang = 'es'").select("doc_id")).distinct()),
}


def _number_range(spark, sf_dir):
    from ..functions.text import chapter_number

    return S.number_between(table(spark, sf_dir, "pages").select("page_id", chapter_number("url").alias("number")), "number", "1-500")


def _shortened(spark, sf_dir):
    from ..functions.text import shortened

    return table(spark, sf_dir, "documents").select("doc_id", shortened("text", 150).alias("excerpt"))


for _name, (_sql, _f) in _FILTERS.items():
    query(_name, _sql)(_f or {"flt_05_number_range": _number_range, "flt_10_shortened": _shortened}[_name])


# --- graphs: suppliers and parts, and events of one user in a row ----------------------------------------

_EDGES = "edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def _named(items):
    return items.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _links(spark, sf_dir):
    """An edge for each row: for what repeated edges don't change."""
    return _named(table(spark, sf_dir, "lineitem"))


def _edges(spark, sf_dir):
    return _named(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct())


_STEPS = "steps AS (SELECT src AS at_, dst AS to_, 0 AS way FROM edges UNION ALL SELECT dst, src, 1 FROM edges)"


@query("grf_05_neighbourhood", f"""
WITH {_EDGES}, {_STEPS}, d0 AS (SELECT 's1' AS node),
d1 AS (SELECT to_ AS node, min((way, at_)) AS e FROM d0 JOIN steps ON node = at_ WHERE to_ <> 's1' GROUP BY to_),
d2 AS (SELECT to_ AS node, min((way, at_)) AS e FROM d1 JOIN steps ON node = at_ WHERE to_ NOT IN (SELECT node FROM d1) AND to_ <> 's1' GROUP BY to_)
SELECT 's1' AS start, 's1' AS node, 0::INT AS depth, NULL::VARCHAR AS via, NULL::INT AS way UNION ALL
SELECT 's1', node, 1, e[2], e[1] FROM d1 UNION ALL SELECT 's1', node, 2, e[2], e[1] FROM d2""")
def grf_05(spark, sf_dir):
    start = table(spark, sf_dir, "supplier").where("s_suppkey = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return G.neighbourhood(_edges(spark, sf_dir), start, 2)


@query("grf_06_numbered_subgraph", f"WITH {_EDGES} SELECT src, dst FROM edges WHERE substr(src, 2)::INT BETWEEN 1 AND 10 AND substr(dst, 2)::INT BETWEEN 1 AND 300")
def grf_06(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_suppkey between 1 and 10").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.col("s_suppkey").alias("number"))
    p = table(spark, sf_dir, "part").where("p_partkey between 1 and 300").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_partkey").alias("number"))
    return G.numbered_subgraph(s.unionByName(p), _edges(spark, sf_dir), 1, 300)


@query("grf_07_components")  # too slow as recursive SQL on whole tables: tests hold it against plain search
def grf_07(spark, sf_dir):
    return G.weak_components(_links(spark, sf_dir))


@query("grf_07_incremental")  # the same rows as grf_07_components, grown batch by batch: tests hold it against that
def grf_07_incremental(spark, sf_dir):
    e = _links(spark, sf_dir)
    batch = F.pmod(F.xxhash64("src", "dst"), F.lit(3))
    labels = G.weak_components(e.where(batch == 0))
    for n in (1, 2):
        labels = G.extended_components(labels, e.where(batch == n))
    return labels


@query("grf_07_stats")
def grf_07_stats(spark, sf_dir):
    e, ends = _edges(spark, sf_dir), _links(spark, sf_dir)
    nodes = ends.select(F.col("src").alias("node_id")).union(ends.select("dst")).distinct().withColumn("node_type", F.substring("node_id", 1, 1))
    return G.graph_stats(nodes.withColumn("book_list", F.concat_ws("|", F.substring("node_id", 1, 2), F.substring("node_id", -1, 1))), e)


@query("grf_08_induced", f"WITH {_EDGES}, n AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_partkey % 2 = 0) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def grf_08(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    n = n.unionByName(table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node")))
    return G.induced(_edges(spark, sf_dir), n)


@query("grf_08_character_relations", """
WITH n AS (SELECT 'char:' || s_suppkey AS node_id, 'b' || s_nationkey % 4 || '|b' || s_suppkey % 3 AS book_list FROM supplier WHERE s_suppkey % 5 <> 0),
o AS (SELECT node_id FROM n WHERE contains(book_list, 'b1')),
e AS (SELECT 'char:' || l_suppkey AS src, 'char:' || l_partkey % 100 AS dst, nullif(l_returnflag, 'N') AS relation_type, CASE WHEN l_linenumber > 2 THEN l_quantity::DOUBLE END AS strength FROM lineitem)
SELECT src, dst, coalesce(relation_type, 'unknown') AS relation_type, coalesce(strength, 0)::DOUBLE AS relation_strength FROM e WHERE src IN (SELECT node_id FROM o) AND dst IN (SELECT node_id FROM o)""")
def grf_08_relations(spark, sf_dir):
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("s_suppkey") % 5 == 0, "event").otherwise("character")
    books = F.concat(F.lit("b"), F.col("s_nationkey") % 4, F.lit("|b"), F.col("s_suppkey") % 3)
    nodes = s.select(F.concat(F.lit("char:"), "s_suppkey").alias("node_id"), kind.alias("node_type"), books.alias("book_list"))
    edges = li.select(
        F.concat(F.lit("char:"), "l_suppkey").alias("src"), F.concat(F.lit("char:"), F.col("l_partkey") % 100).alias("dst"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("relation_type"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity").cast("double")).alias("strength"),
    )
    return G.character_relations(nodes, edges, "b1")


@query("srt_04_chapter_order", "SELECT doc_id, chapter_id FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '序章' ELSE '第' || (doc_id * 37 % 500) || '章' END AS chapter_id FROM documents) ORDER BY coalesce(try_cast(regexp_extract(chapter_id, '([0-9]+)', 1) AS INT), 99999), doc_id LIMIT 300")
def srt_04(spark, sf_dir):
    """Chapters by their number, those without one last: the first 300."""
    name = F.when(F.col("doc_id") % 9 == 0, "序章").otherwise(F.concat(F.lit("第"), F.col("doc_id") * 37 % 500, F.lit("章")))
    return S.page(table(spark, sf_dir, "documents").select("doc_id", name.alias("chapter_id")), [T.chapter_number("chapter_id", 99999), "doc_id"], 300)


@query("grf_01_appearances", """
WITH s AS (SELECT role AS name, 'c' || conv_id AS chapter_id, substr(text, 1, 50) AS state, min(turn) AS seq FROM conversations GROUP BY 1, 2, 3)
SELECT 'char:' || name AS src, 'chap:' || chapter_id AS dst, string_agg(state, '|' ORDER BY seq, state) AS action FROM s GROUP BY name, chapter_id""")
def grf_01(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return G.appearance_edges(c.select(F.col("role").alias("name"), F.concat(F.lit("c"), "conv_id").alias("chapter_id"), F.col("turn").alias("seq"), F.col("text").alias("state")))


@query("grf_02_latest_relation", "SELECT user_id::VARCHAR AS src, event_type AS dst, arg_max(coalesce(props::JSON->>'k', 'unknown'), event_id) AS relation FROM events GROUP BY ALL")
def grf_02(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return G.latest_edges(e.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), "event_id", F.get_json_object("props", "$.k").alias("relation")), "event_id", "relation")


@query("grf_03_event_graph", "SELECT 'event:' || event_id AS src, 'event:' || lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, event_type AS causal_type FROM events QUALIFY dst IS NOT NULL")
def grf_03(spark, sf_dir):
    return _causal(spark, sf_dir)


def _causal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.concat(F.lit("event:"), "event_id").alias("src"), F.concat(F.lit("event:"), after).alias("dst"), F.col("event_type").alias("causal_type")).where("dst is not null")


@query("grf_04_skill_graph", "SELECT 'scene:' || lang AS src, 'skill:' || substr(text, 1, 2) AS dst, list_sort(list(DISTINCT source)) AS book_list FROM documents GROUP BY lang, substr(text, 1, 2)")
def grf_04(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return G.skill_graph(d.select(F.col("lang").alias("scene_type"), F.substring("text", 1, 2).alias("skill_name"), F.col("source").alias("book_name")))


@query("grf_10_causal_chain", """
WITH o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), s AS (SELECT * FROM o WHERE event_id % 500 = 0)
SELECT 'event:' || s.event_id AS start, 'event:' || o.event_id AS node, (o.r - s.r)::INT AS depth, o.event_type AS event_name FROM s JOIN o ON o.user_id = s.user_id AND o.r BETWEEN s.r AND s.r + 4""")
def grf_10(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("event:"), "event_id").alias("event_id"), F.col("event_type").alias("event_name"))
    starts = table(spark, sf_dir, "events").where("event_id % 500 = 0").select(F.concat(F.lit("event:"), "event_id").alias("node"))
    return G.causal_chain(events, _causal(spark, sf_dir), starts, 4, "downstream").select("start", "node", "depth", "event_name")


@query("grf_11_export", r"SELECT doc_id, [source, regexp_replace(coalesce(text, ''), '[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{fffe}\x{ffff}]', '', 'g')] AS vals FROM documents")
def grf_11(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    attrs = F.create_map(F.lit("book"), F.col("source"), F.lit("text"), F.col("text"))
    return d.select("doc_id", F.map_values(G.export_attributes(attrs)).alias("vals"))


_STORY = "e AS (SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS book_name, 'c' || event_id % 7 AS chapter_id, event_type || '-' || (props::JSON->>'k') AS event_name, event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS significance, user_id, ts, event_id AS n FROM events), l AS (SELECT book_name, event_id AS source_event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, n) AS target_event_id, event_type AS relation_type, chapter_id AS relation_detail FROM e), links AS (SELECT * FROM l WHERE target_event_id IS NOT NULL)"


def _story(spark, sf_dir):
    """Events as story events, each the cause of the next one of its user."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("book_name"), F.concat(F.lit("c"), F.col("event_id") % 7).alias("chapter_id"), F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("event_name"), "event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("significance"), "user_id", "ts", F.col("event_id").alias("n"))
    links = rows.withColumn("target_event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "n"))).where("target_event_id is not null")
    return rows, links.select("book_name", F.col("event_id").alias("source_event_id"), "target_event_id", F.col("event_type").alias("relation_type"), F.col("chapter_id").alias("relation_detail"))


@query("grf_10_overview", f"""
WITH {_STORY}, h AS (SELECT *, row_number() OVER (PARTITION BY book_name ORDER BY event_id) AS r FROM e WHERE significance = 'high'),
g AS (SELECT book_name, list({{'event_name': event_name, 'chapter_id': chapter_id, 'event_type': event_type}} ORDER BY r) AS high_events FROM h WHERE r <= 5 GROUP BY book_name),
a AS (SELECT book_name, count(*)::BIGINT AS total_events FROM e GROUP BY book_name), b AS (SELECT book_name, count(*)::BIGINT AS total_edges FROM links GROUP BY book_name)
SELECT book_name, total_events, coalesce(total_edges, 0)::BIGINT AS total_edges, list_transform(high_events, lambda x: x.event_name || ' ' || x.chapter_id || ' ' || x.event_type) AS high FROM a LEFT JOIN b USING (book_name) LEFT JOIN g USING (book_name)""")
def grf_10_overview(spark, sf_dir):
    events, links = _story(spark, sf_dir)
    o = G.causal_overview(events, links, 5)
    return o.select("book_name", "total_events", "total_edges", F.transform("high_events", lambda x: F.concat_ws(" ", x["event_name"], x["chapter_id"], x["event_type"])).alias("high"))


@query("grf_10_edges", f"""
WITH {_STORY}, d0 AS (SELECT event_id AS start, event_id AS node, 0 AS depth FROM e WHERE n % 50 = 0), s AS (SELECT source_event_id AS a, target_event_id AS b FROM links),
d1 AS (SELECT start, b AS node, 1 AS depth FROM d0 JOIN s ON a = node), r AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1)
SELECT start, (depth + 1)::INT AS depth, 'downstream' AS direction, relation_type, relation_detail, event_name, e.chapter_id FROM r JOIN links ON source_event_id = node JOIN e ON e.event_id = target_event_id""")
def grf_10_edges(spark, sf_dir):
    events, links = _story(spark, sf_dir)
    starts = events.where("n % 50 = 0").select(F.col("event_id").alias("node"))
    steps = links.select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"))
    return G.chain_edges(G.neighbourhood(steps, starts, 1, "out"), events, links, "downstream")


@query("grf_03_by_name", f"""
WITH {_STORY}, j AS (SELECT 'event:' || a.event_name AS src, 'event:' || b.event_name AS dst, relation_type, links.book_name, source_event_id, target_event_id FROM links JOIN e a ON a.event_id = source_event_id JOIN e b ON b.event_id = target_event_id)
SELECT src, dst, arg_max(relation_type, (source_event_id, target_event_id)) AS relation_type, arg_max(book_name, (source_event_id, target_event_id)) AS book FROM j GROUP BY src, dst""")
def grf_03_by_name(spark, sf_dir):
    return G.event_graph(*_story(spark, sf_dir))[1]


@query("grf_03_event_nodes", f"""
WITH {_STORY} SELECT 'event:' || event_name AS node_id, 'story_event' AS node_type, arg_max(book_name, event_id) AS book_list, arg_max(chapter_id, event_id) AS chapter_id, arg_max(event_type, event_id) AS event_type, arg_max(significance, event_id) AS significance FROM e GROUP BY event_name""")
def grf_03_event_nodes(spark, sf_dir):
    return G.event_graph(*_story(spark, sf_dir))[0]


def _hits(spark, sf_dir, vec_id, collections):
    """The nearest vectors to one, by collection: labels 0, 1, .. play the collections."""
    q = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.lit(0).alias("query_id"), F.col("embedding").alias("query"))
    name = F.element_at(F.array(*map(F.lit, collections)), F.col("label") + 1)
    v = _vectors(spark, sf_dir).where(F.col("label") < len(collections))
    return S.top_k_each(v, q, 20, ["label"]).select(name.alias("collection"), "id", "rank")


def _hits_sql(vec_id, collections):
    return f"(SELECT {list(collections)}[label + 1] AS origin, label AS n, vec_id::VARCHAR AS id, row_number() OVER (PARTITION BY label ORDER BY {_DIST}, vec_id) AS rank FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {vec_id}) WHERE label < {len(collections)})"


def _kinds(spark, sf_dir, *names):
    from ..operators import ingest as I
    from .ingest_queries import kind_responses

    return {n: I.ingest(kind_responses(spark, sf_dir, I.KINDS[n]), I.KINDS[n]) for n in names}


def _first_sql(names, most, genre=""):
    from .ingest_queries import kind_sql

    where = lambda t: f" WHERE category ILIKE '%{genre}%'" if genre and "category" in kind_columns(t) else ""
    return " UNION ALL ".join(f"(SELECT '{t}' AS origin, {i} AS n, id FROM ({kind_sql(t)}){where(t)} ORDER BY id LIMIT {most})" for i, t in enumerate(names))


def kind_columns(name):
    from ..operators import ingest as I

    return I.KINDS[name].columns


def _part_sql(part, rows, order, most):
    return f"(SELECT '{part}' AS part, origin, id, (row_number() OVER (ORDER BY {order}))::INT AS place FROM ({rows}) QUALIFY place <= {most})"


_COLLECTIONS, _FIRST, _SECOND = S.DOCUMENT_TYPES["character"]


@query("vec_05_by_type", " UNION ALL ".join([
    _part_sql("primary", f"SELECT origin, n - 100 AS n, id, rank FROM {_hits_sql(100, _COLLECTIONS)} WHERE rank <= 12 UNION ALL SELECT origin, n, id, NULL FROM ({_first_sql(_FIRST, 12, 'click')})", "n, rank NULLS LAST, id", 12),
    _part_sql("secondary", _first_sql(_SECOND, 5), "n, id", 6),
    _part_sql("patterns", "SELECT 'cross_book_comparisons' AS origin, id FROM (" + ORACLES["ing_18_cross_book_comparisons"] + ")", "id", 5),
]))
def vec_05_by_type(spark, sf_dir):
    tables = _kinds(spark, sf_dir, *_FIRST, *_SECOND, "cross_book_comparisons")
    return S.enhance(_hits(spark, sf_dir, 100, _COLLECTIONS), tables, "character", 12, "click", tables["cross_book_comparisons"])


@query("vec_06_by_stage", " UNION ALL ".join([
    _part_sql("vectors", f"SELECT * FROM {_hits_sql(200, S.WRITING_STAGES['writing'][0])} WHERE rank <= 8", "n, rank, id", 8),
    _part_sql("structured", _first_sql(S.WRITING_STAGES["writing"][1], 4), "n, id", 8),
]))
def vec_06_by_stage(spark, sf_dir):
    collections, names = S.WRITING_STAGES["writing"]
    return S.context_search(_hits(spark, sf_dir, 200, collections), _kinds(spark, sf_dir, *names), "writing", 8)


@query("vec_08_documents", f"""
SELECT id, '场景:' || scene_type || chr(10) || '对话:' || original_text || chr(10) || '情绪张力:' || emotional_tension || chr(10) || '潜台词:' || subtext || chr(10) || '剧情作用:' || plot_function
  || CASE WHEN summary <> '' THEN chr(10) || '剧情上下文:' || CASE WHEN length(summary) > 150 THEN left(summary, 150) || '...' ELSE summary END ELSE '' END AS document
FROM ({ORACLES['ing_12_dialogue_samples']}) d LEFT JOIN (SELECT book_name, chapter_id, summary || repeat('x', 160) AS summary FROM ({ORACLES['ing_01_plot_arcs']})) p USING (book_name, chapter_id)
UNION ALL SELECT id, '卷主题:' || theme || chr(10) || '冲突:' || conflict || chr(10) || '弧光:' || arc || chr(10) || '节拍:' || chr(10) || array_to_string(list_transform(beats_json::JSON::VARCHAR[], lambda b: '- ' || b), chr(10)) FROM ({ORACLES['ing_08_macro_outlines']})""")
def vec_08_documents(spark, sf_dir):
    rows = _kinds(spark, sf_dir, "dialogue_samples", "plot_arcs", "macro_outlines")
    arcs = rows["plot_arcs"].withColumn("summary", F.concat("summary", F.lit("x" * 160)))
    told = S.documents(rows["dialogue_samples"], "dialogue_samples", arcs).select("id", "document")
    return told.unionByName(S.documents(rows["macro_outlines"], "macro_outlines").select("id", "document"))
