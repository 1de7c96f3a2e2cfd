"""Queries over windows, joins, aggregates, data-quality rules and cross-book digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import digests as D
from ..operators import lexicon
from ..operators import relate as R
from ..operators import rules as Q
from ..operators import ingest as I
from .base import CHAPTERS, INDEXED, chapters, indexed, query, table
from .ingest_queries import kind_responses, kind_sql

_SAMPLES = "SELECT source AS book_name, lang AS type, doc_id AS seq, coalesce(quality, 5)::INT AS writing_quality FROM documents LEFT JOIN labels USING (doc_id)"


def _samples(spark, sf_dir, *more):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(F.col("source").alias("book_name"), F.col("lang").alias("type"), F.col("doc_id").alias("seq"), F.coalesce("quality", F.lit(5)).alias("writing_quality"), *more)


def _best(name, table_name, n, by_type):
    by = "book_name, type" if by_type else "book_name"

    @query(f"win_01_{name}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY writing_quality DESC, seq)::INT AS place FROM ({_SAMPLES})) WHERE place <= {n}")
    def run(spark, sf_dir):
        return R.best_rows(_samples(spark, sf_dir), n, by_type)


for _t, (_n, _by) in R.KEEP.items():
    if _t in ("dialogue_samples", "transition_samples", "memorable_quotes"):
        _best(_t, _t, _n, _by)


@query("win_02_carried_state", """
WITH e AS (SELECT user_id::VARCHAR AS book_name, event_id AS seq, event_type AS state, event_type = 'error' OR event_id % 3 = 0 AS failed FROM events),
r AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY book_name ORDER BY seq) AS run FROM e), f AS (SELECT *, sum(failed::INT) OVER (PARTITION BY book_name, run ORDER BY seq) AS fails FROM r)
SELECT book_name, seq, state, failed, CASE WHEN coalesce(lag(fails) OVER w, 0) >= 2 THEN 'start' ELSE
  coalesce(last_value(CASE WHEN NOT failed THEN state END IGNORE NULLS) OVER (PARTITION BY book_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') END AS state_before
FROM f WINDOW w AS (PARTITION BY book_name ORDER BY seq)""")
def win_02(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error") | (F.col("event_id") % 3 == 0)
    rows = e.select(F.col("user_id").cast("string").alias("book_name"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), failed.alias("failed"))
    return R.carried_state(rows, "state", "failed", F.lit("start"))


@query("win_03_context", """
SELECT conv_id AS book_name, turn AS seq, coalesce(string_agg(left(text, 40), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""")
def win_03(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_name"), F.col("turn").alias("seq"), F.substring("text", 1, 40).alias("head"))
    return R.context_before(c, "head").drop("head")


@query("win_04_latest_relation", "SELECT user_id, list(event_type ORDER BY ts, event_id)[-1] AS latest FROM events GROUP BY user_id")
def win_04(spark, sf_dir):
    timeline = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    return timeline


@query("win_05_first_valid", "SELECT source AS book_name, arg_min(doc_id, doc_id) AS first_toxic FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source")
def win_05(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return d.groupBy(F.col("source").alias("book_name")).agg(F.min_by("doc_id", "doc_id").alias("first_toxic"))


@query("win_06_numbered_events", """
WITH o AS (SELECT user_id::VARCHAR AS book_name, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS c FROM events)
SELECT book_name, event_id, (c // 10)::INT AS batch, '#' || row_number() OVER (PARTITION BY book_name, c // 10 ORDER BY c, event_id) AS label FROM o""")
def win_06(spark, sf_dir):
    from ..operators.ingest import numbered_events

    e = table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select(F.col("user_id").cast("string").alias("book_name"), "event_id", order.alias("chapter_no"), F.col("event_id").alias("seq"))
    return numbered_events(rows).select("book_name", "event_id", "batch", F.concat(F.lit("#"), "number").alias("label"))


@query("win_07_latest_review", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def win_07(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


# --- joins -------------------------------------------------------------------------------------------------


@query("jon_01_context", "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jon_01(spark, sf_dir):
    return R.with_context(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("jon_02_snippets", f"""
WITH {CHAPTERS}, p AS (SELECT DISTINCT book_name, category AS name, chapter_id FROM chapters), r AS (SELECT p.*, seq, substr(text, 1, 500) AS s, row_number() OVER (PARTITION BY p.book_name, name ORDER BY seq) AS n FROM p JOIN chapters c USING (book_name, chapter_id))
SELECT book_name, name, string_agg(s, chr(10) ORDER BY seq) AS snippets, count(s)::BIGINT AS found FROM r WHERE n <= 5 GROUP BY ALL""")
def jon_02(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return R.snippets(c.select("book_name", F.col("category").alias("name"), "chapter_id"), c)


@query("jon_03_named_edges", """
WITH x AS (SELECT event_id AS source_id, event_id + 1 + event_id % 3 AS target_id FROM events)
SELECT source_id, target_id, coalesce(a.event_type, '未知事件') AS source_name, coalesce(b.event_type, '未知事件') AS target_name FROM x LEFT JOIN events a ON a.event_id = source_id LEFT JOIN events b ON b.event_id = target_id""")
def jon_03(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    edges = e.select(F.col("event_id").alias("source_id"), (F.col("event_id") + 1 + F.col("event_id") % 3).alias("target_id"))
    return R.named_edges(edges, e.select("event_id", F.col("event_type").alias("event_name")))


@query("jon_04_extension", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def jon_04(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return R.with_context(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


@query("jon_05_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%')")
def jon_05(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").ilike("%build%")).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("jon_06_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def jon_06(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


#: A cast for each book: the longer words of some benchmark items.
_CAST = "c AS (SELECT DISTINCT 'src' || item_id % 20 AS book_name, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS name FROM benchmark), m AS (SELECT book_name, doc_id, name, ((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS hits, (instr(text, name) - 1)::INT AS position FROM documents JOIN c ON source = book_name AND contains(text, name))"


def _mentions(spark, sf_dir):
    name = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]{6,}"), F.lit(0))).alias("name")
    cast = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("book_name"), name)
    texts = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"), "doc_id", "text")
    return lexicon.mentions(texts, cast, "doc_id")


@query("jon_07_mentions", f"WITH {_CAST} SELECT * FROM m")
def jon_07(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query("agg_08_cast_frequency", f"WITH {_CAST} SELECT book_name, name, count(*) AS texts, sum(hits)::BIGINT AS hits FROM m GROUP BY ALL")
def agg_08_cast(spark, sf_dir):
    return lexicon.frequencies(_mentions(spark, sf_dir))


@query("jon_10_positions_in_chapters", """
WITH c AS (SELECT source AS book_name, doc_id, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS ends FROM documents),
q AS (SELECT 'src' || l_suppkey % 20 AS book_name, l_orderkey, l_linenumber, (l_partkey * 997 + l_linenumber * 13)::BIGINT AS place FROM lineitem)
SELECT book_name, l_orderkey, l_linenumber, place, doc_id, place - begins AS inside FROM q JOIN c USING (book_name) WHERE begins <= place AND place < ends""")
def jon_10_positions(spark, sf_dir):
    """Places in whole books (one of a position of each line item) to the chapters that hold them."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"), "doc_id", F.length("text").alias("n"))
    w = Window.partitionBy("book_name").orderBy("doc_id")
    c = d.withColumn("ends", F.sum("n").over(w)).withColumn("begins", F.col("ends") - F.col("n")).drop("n")
    q = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("book_name"), "l_orderkey", "l_linenumber", (F.col("l_partkey") * 997 + F.col("l_linenumber") * 13).cast("long").alias("place")
    )
    met = R.within(q, c, ["book_name"], "place", "begins", "ends")
    return met.select("book_name", "l_orderkey", "l_linenumber", "place", "doc_id", (F.col("place") - F.col("begins")).alias("inside"))


@query("jon_08_book_digest", """
WITH b AS (SELECT DISTINCT source AS book_name FROM documents), d AS (SELECT source AS book_name, count(*)::BIGINT AS chapters FROM documents GROUP BY ALL),
l AS (SELECT source AS book_name, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT * FROM b LEFT JOIN d USING (book_name) LEFT JOIN l USING (book_name)""")
def jon_08(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"), "doc_id")
    toxic = c.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("book_name").agg(F.sum("toxic").alias("toxic"))
    return R.one_row_each(c.select("book_name").distinct(), {"d": c.groupBy("book_name").agg(F.count("*").alias("chapters")), "l": toxic}, "book_name")


@query("jon_09_benchmark_example", """
WITH m AS (SELECT DISTINCT lang AS dimension FROM documents), b AS (SELECT lang AS dimension, arg_min(substr(text, 1, 200), doc_id) AS example FROM documents WHERE lang <> 'es' GROUP BY lang) SELECT dimension, example FROM m LEFT JOIN b USING (dimension)""")
def jon_09(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    example = d.where("lang <> 'es'").groupBy(F.col("lang").alias("dimension")).agg(F.min_by(F.substring("text", 1, 200), "doc_id").alias("example"))
    return R.with_context(d.select(F.col("lang").alias("dimension")).distinct(), example, ["dimension"])


# --- aggregates ------------------------------------------------------------------------------------------------

_SIMPLE = {
    "agg_01_counts": ("SELECT count(*)::BIGINT AS records, count(DISTINCT source)::BIGINT AS books FROM documents", lambda s, d: table(s, d, "documents").agg(F.count("*").alias("records"), F.count_distinct("source").alias("books"))),
    "agg_05_nodes_by_type": ("SELECT p_brand AS node_type, count(*)::BIGINT AS nodes FROM part GROUP BY p_brand", lambda s, d: table(s, d, "part").groupBy(F.col("p_brand").alias("node_type")).agg(F.count("*").alias("nodes"))),
    "agg_05_nodes_by_book": ("SELECT b AS book, count(*)::BIGINT AS nodes FROM (SELECT unnest(string_split(source || '|' || lang, '|')) AS b FROM documents) GROUP BY b", lambda s, d: table(s, d, "documents").select(F.explode(F.split(F.concat_ws("|", "source", "lang"), r"\|")).alias("book")).groupBy("book").agg(F.count("*").alias("nodes"))),
    "agg_07_spread": ("SELECT event_type, round(avg(value)::DECIMAL(20,10), 4)::DOUBLE AS mean, median(value) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY event_type", lambda s, d: table(s, d, "events").groupBy("event_type").agg(T.decimal_round(F.avg("value")).alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))),
    "agg_08_frequency": ("SELECT role AS name, count(*)::BIGINT AS frequency, list_sort(list(DISTINCT conv_id)) AS chapters FROM conversations GROUP BY role", lambda s, d: table(s, d, "conversations").groupBy(F.col("role").alias("name")).agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set("conv_id")).alias("chapters"))),
    "agg_10_distinct": ("SELECT DISTINCT source AS book_name FROM documents", lambda s, d: table(s, d, "documents").select(F.col("source").alias("book_name")).distinct()),
    "agg_04_names": ("SELECT conv_id, string_agg(left(text, 30), '|' ORDER BY turn) AS profile, list(role ORDER BY turn) AS names FROM conversations GROUP BY conv_id", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(R.ordered(F.substring("text", 1, 30), "turn"), "|").alias("profile"), R.ordered("role", "turn").alias("names"))),
}
for _name, (_sql, _f) in _SIMPLE.items():
    query(_name, _sql)(_f)


@query("agg_02_richest_books", """
WITH u AS (SELECT source AS book_name FROM documents UNION ALL SELECT source FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'src' || l_suppkey % 20 FROM lineitem)
SELECT book_name, count(*)::BIGINT AS records FROM u GROUP BY book_name ORDER BY records DESC, book_name LIMIT 5""")
def agg_02(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"), "doc_id")
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("book_name"))
    return R.richest_books([d, d.join(table(spark, sf_dir, "labels"), "doc_id"), li])


@query("agg_03_mistakes", """
WITH i AS (SELECT CASE WHEN event_type = 'error' THEN '未知' ELSE event_type END AS issue_type, props AS description, event_id AS seq FROM events),
d AS (SELECT *, CASE issue_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' ELSE issue_type END AS dimension FROM i),
g AS (SELECT dimension, issue_type, count(*)::BIGINT AS frequency, list(description ORDER BY seq DESC)[1:2] AS examples FROM d GROUP BY ALL)
SELECT *, sum(frequency) OVER (PARTITION BY dimension)::BIGINT AS in_dimension FROM g QUALIFY in_dimension >= 2""")
def agg_03(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = e.select(F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("issue_type"), F.col("props").alias("description"), F.col("event_id").alias("seq"))
    return R.mistake_patterns(i, {"click": "touch", "view": "touch"})


@query("agg_06_severity", "SELECT user_id::VARCHAR AS book_name, count(*) FILTER (event_type = 'error')::BIGINT AS critical, 0::BIGINT AS high, 0::BIGINT AS medium, count(*) FILTER (event_type = 'view')::BIGINT AS low, count(*) FILTER (event_type = 'error') > 0 AS warn FROM events GROUP BY user_id")
def agg_06(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "low").otherwise("none")
    return Q.verdicts(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("book_name"), severity.alias("severity")))


@query("agg_09_run_report", """
WITH r AS (SELECT event_type AS stage, user_id::VARCHAR AS book_name, CASE WHEN value < 2 THEN 'failed' ELSE 'complete' END AS status, event_id % 10 AS n FROM events)
SELECT stage, sum(CASE WHEN status = 'complete' THEN n ELSE 0 END)::BIGINT AS succeeded, count(*) FILTER (status <> 'complete')::BIGINT AS failures, list_sort(list(book_name) FILTER (status <> 'complete'))[1:10] AS first_failures FROM r GROUP BY stage""")
def agg_09(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.run_report(e.select(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("book_name"), F.when(F.col("value") < 2, "failed").otherwise("complete").alias("status"), (F.col("event_id") % 10).alias("rows")))


@query("sta_06_style_summaries", """
SELECT source AS book_name, lang AS scene_type, floor(avg(length(text)))::BIGINT AS avg_chars, array_to_string(list_sort(list(DISTINCT left(text, 2)))[1:3], '、') AS tensions,
  array_to_string(list_sort(list(DISTINCT nullif(right(source, 1), '')))[1:3], '、') AS techniques, count(*)::BIGINT AS samples FROM documents GROUP BY ALL HAVING count(*) >= 2""")
def sta_06(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return R.style_summaries(d.select(F.col("source").alias("book_name"), F.col("lang").alias("scene_type"), F.col("text").alias("original_text"), F.substring("text", 1, 2).alias("tension"), F.substring("source", -1, 1).alias("technique")))


@query("sta_07_description", """
WITH f AS (SELECT source AS book_name, arg_min(concat_ws(' | ', nullif(trim(text), ''), lang), doc_id) AS description FROM documents GROUP BY source)
SELECT DISTINCT d.source AS book_name, f.description FROM documents d LEFT JOIN f ON d.source = f.book_name""")
def sta_07(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"), F.col("text").alias("head"), "lang", "doc_id")
    return R.described(d.select("book_name").distinct(), d, ["head", "lang"], "doc_id")


@query("sta_08_merged_style", """
WITH w AS (SELECT DISTINCT source AS book_name, trim(unnest(string_split(text, ','))) AS word FROM documents), k AS (SELECT * FROM w WHERE word <> '' AND word NOT IN ('无', 'none'))
SELECT book_name, list_sort(list(word))[1:30] AS words FROM k GROUP BY book_name""")
def sta_08(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"), F.col("text").alias("verbs"))
    return R.merged_style(d, "verbs")


# --- quotes ------------------------------------------------------------------------------------------------------


@query("key_10_unverified", "WITH q AS (SELECT doc_id, substr(text, 11, 30) || CASE WHEN doc_id % 4 = 0 THEN 'zzz' ELSE '' END AS quote, text FROM documents) SELECT doc_id, length(translate(quote, ' ' || chr(10), '')) >= 8 AND NOT contains(translate(text, ' ' || chr(10), ''), translate(quote, ' ' || chr(10), '')) AS unverified FROM q")
def key_10(spark, sf_dir):
    from ..operators.quotes import unverified

    q = F.concat(F.substring("text", 11, 30), F.when(F.col("doc_id") % 4 == 0, "zzz").otherwise(""))
    return unverified(table(spark, sf_dir, "documents").select("doc_id", q.alias("quote"), "text"), "quote", "text").select("doc_id", "unverified")


@query("key_11_positions", """
WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN replace(substr(text, 21, 40), ' ', '') WHEN doc_id % 3 = 1 THEN substr(text, 21, 40) ELSE 'qqqqqqqq' END AS quote FROM documents),
s AS (SELECT *, regexp_replace(text, '\\s', '', 'g') AS dense, regexp_replace(quote, '\\s', '', 'g') AS dq FROM q),
p AS (SELECT *, CASE WHEN quote <> '' AND instr(text, quote) > 0 THEN 'exact' WHEN dq <> '' AND instr(dense, dq) > 0 THEN 'spaces' ELSE 'none' END AS level FROM s),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM p WHERE level = 'spaces'),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c WHERE NOT regexp_matches(ch, '\\s'))
SELECT p.doc_id, level, CASE level WHEN 'exact' THEN instr(text, quote) - 1 WHEN 'spaces' THEN n.i ELSE -1 END::INT AS position FROM p LEFT JOIN n ON level = 'spaces' AND n.doc_id = p.doc_id AND n.k = instr(dense, dq)""")
def key_11(spark, sf_dir):
    from ..operators.quotes import positions

    d = table(spark, sf_dir, "documents")
    piece = F.substring("text", 21, 40)
    quote = F.when(F.col("doc_id") % 3 == 0, F.replace(piece, F.lit(" "), F.lit(""))).when(F.col("doc_id") % 3 == 1, piece).otherwise("qqqqqqqq")
    return positions(d.select("doc_id", quote.alias("quote"), "text"), "quote", "text").select("doc_id", "level", "position")


@query("key_11_fuzzy")
def key_11_fuzzy(spark, sf_dir):
    from ..operators.fuzzy import fuzzy_matches

    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return fuzzy_matches(b, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("key_11_located")
def key_11_located(spark, sf_dir):
    """A passage of each text with every 12th character changed, located in its own text; two in three need the third level."""
    from ..operators.quotes import located

    d = table(spark, sf_dir, "documents")
    passage = F.trim(F.element_at(F.split("text", r"(?<=[.!?\n])"), 1))
    changed = F.regexp_replace(passage, r"(?s)(.{11}).", "$1#")
    quote = F.when(F.col("doc_id") % 3 == 0, passage).otherwise(changed)
    return located(d.select("doc_id", quote.alias("quote"), "text"), "quote", "text").select("doc_id", "level", "position")


# --- data quality ----------------------------------------------------------------------------------------------------

_SUMMARY = "s AS (SELECT source AS book_name, 'ch' || doc_id AS chapter_id, CASE WHEN length(text) < 100 THEN '' WHEN length(text) < 300 THEN substr(text, 1, 40) ELSE substr(text, 1, 100) END AS summary, (doc_id % 5)::INT AS cast_size FROM documents)"


def _summaries(spark, sf_dir):
    c = chapters(spark, sf_dir)
    n = F.length("text")
    s = F.when(n < 100, "").when(n < 300, F.substring("text", 1, 40)).otherwise(F.substring("text", 1, 100))
    return c.select("book_name", "chapter_id", s.alias("summary"), (F.col("seq") % 5).cast("int").alias("cast_size"))


@query("dq_a_summaries", f"""
WITH {_SUMMARY} SELECT 'A' AS stage, book_name, chapter_id, 'critical' AS severity, 'empty summary' AS description FROM s WHERE summary = ''
UNION ALL SELECT 'A', book_name, chapter_id, 'high', 'short summary' FROM s WHERE summary <> '' AND length(summary) < 50
UNION ALL SELECT 'A', book_name, chapter_id, 'medium', 'no cast' FROM s WHERE cast_size = 0
UNION ALL SELECT 'A', book_name, '', 'critical', 'failure rate too high' FROM s GROUP BY book_name HAVING avg((summary = '')::INT) > 0.1""")
def dq_a(spark, sf_dir):
    return Q.summary_rules(_summaries(spark, sf_dir))


_CH = "SELECT DISTINCT source AS book_name, 'ch' || doc_id AS chapter_id FROM documents"


@query("dq_b_no_skills", f"SELECT 'B' AS stage, book_name, chapter_id, 'medium' AS severity, 'no skills' AS description FROM ({_CH}) WHERE chapter_id NOT IN (SELECT 'ch' || doc_id FROM labels)")
def dq_b(spark, sf_dir):
    c = chapters(spark, sf_dir, "book_name", "chapter_id")
    labelled = table(spark, sf_dir, "labels").select(F.concat(F.lit("ch"), "doc_id").alias("chapter_id")).join(c, "chapter_id")
    return Q.missing_per_chapter(c, labelled, "B", "medium", "no skills")


def _no_rows(letter: str, severity: str, what: str) -> None:
    @query(f"dq_{letter.lower()}_no_{what}", f"SELECT '{letter}' AS stage, o AS book_name, '' AS chapter_id, '{severity}' AS severity, 'no {what}' AS description FROM (SELECT DISTINCT c_custkey::VARCHAR AS o FROM customer EXCEPT SELECT DISTINCT o_custkey::VARCHAR FROM orders WHERE o_totalprice > 200000)")
    def run(spark, sf_dir):
        books = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("book_name"))
        rows = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").cast("string").alias("book_name"))
        return Q.missing_rows(books, rows, letter, severity, f"no {what}")


for _letter, _severity, _what in (("C", "high", "sensory"), ("D", "high", "settings"), ("E", "high", "outlines"), ("G", "high", "speech"), ("H", "high", "plot_lines"), ("O", "high", "events"), ("I", "high", "statistics")):
    _no_rows(_letter, _severity, _what)


@query("dq_d_modules", """
WITH h AS (SELECT user_id::VARCHAR AS book_name, list(DISTINCT (props::JSON->>'k')) AS have FROM events GROUP BY user_id), g AS (SELECT book_name, list_sort(list_filter(['11', '23', '42', '58', '77'], lambda x: NOT list_contains(have, x))) AS gap FROM h)
SELECT 'D' AS stage, book_name, '' AS chapter_id, 'medium' AS severity, 'missing: ' || array_to_string(gap[1:3], ', ') AS description FROM g WHERE len(gap) > 3""")
def dq_d(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("book_name"), F.get_json_object("props", "$.k").alias("module"))
    return Q.missing_modules(e, ["11", "23", "42", "58", "77"], 3)


@query("dq_d_profiles", """
WITH p AS (SELECT c_nationkey::VARCHAR AS book_name, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS motivation, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE ' ' END AS personality, c_mktsegment AS identity FROM customer)
SELECT 'D' AS stage, book_name, '' AS chapter_id, 'medium' AS severity, name || ' lacks motivation, personality' AS description FROM p WHERE motivation IS NULL AND personality = ' '""")
def dq_d_profiles(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("book_name"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("motivation"), F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise(" ").alias("personality"), F.col("c_mktsegment").alias("identity"))
    return Q.thin_profiles(p, ["motivation", "personality", "identity"])


@query("dq_f_samples", """
WITH t AS (SELECT source AS book_name, CASE WHEN doc_id % 29 = 0 THEN '' ELSE text END AS text, coalesce(quality, 5) AS q FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT book_name, count(*) AS n, count(*) FILTER (text = '') AS e, count(*) FILTER (text <> '' AND length(text) < 400) AS sh, count(*) FILTER (q < 3) AS low FROM t GROUP BY book_name)
SELECT 'F' AS stage, book_name, '' AS chapter_id, 'high' AS severity, e || ' empty' AS description FROM s WHERE e > 0 UNION ALL SELECT 'F', book_name, '', 'medium', sh || '/' || n || ' short' FROM s WHERE sh > 0.3 * n UNION ALL SELECT 'F', book_name, '', 'medium', low || '/' || n || ' of low quality' FROM s WHERE low > 0.5 * n""")
def dq_f(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text = F.when(F.col("doc_id") % 29 == 0, "").otherwise(F.col("text"))
    return Q.sample_rules(d.select(F.col("source").alias("book_name"), text.alias("text"), F.coalesce("quality", F.lit(5)).alias("writing_quality")), 400)


@query("dq_o_untyped_edges", "SELECT 'O' AS stage, user_id::VARCHAR AS book_name, 'e' || event_id AS chapter_id, 'low' AS severity, 'edge without type' AS description FROM events WHERE event_type = 'error'")
def dq_o(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("book_name"), F.concat(F.lit("e"), "event_id").alias("chapter_id"), kind.alias("causal_type"))
    return Q.blank_field(e, "causal_type", "O", "low", "edge without type", "chapter_id")


def _rows_of(spark, sf_dir, *tables):
    """Rows ingested from responses, by table."""
    return {t: I.ingest(kind_responses(spark, sf_dir, I.KINDS[t]), I.KINDS[t]) for t in tables}


@query("dq_c_perspective", f"SELECT 'C' AS stage, book_name, chapter_id, 'medium' AS severity, 'no perspective' AS description FROM ({kind_sql('author_fingerprints')}) WHERE narrative_perspective = ''")
def dq_c_perspective(spark, sf_dir):
    return Q.blank_field(_rows_of(spark, sf_dir, "author_fingerprints")["author_fingerprints"], "narrative_perspective", "C", "medium", "no perspective", "chapter_id")


def _dq_f_sql(t, c, least):
    s = f"s AS (SELECT book_name, count(*) AS n, count(*) FILTER ({c} = '') AS e, count(*) FILTER ({c} <> '' AND length({c}) < {least}) AS sh, count(*) FILTER (writing_quality < 3) AS low FROM ({kind_sql(t)}) GROUP BY book_name)"
    row = lambda severity, what, where: f"SELECT 'F' AS stage, book_name, '' AS chapter_id, '{severity}' AS severity, '{t}: ' || {what} AS description FROM s WHERE {where}"
    return f"(WITH {s} " + " UNION ALL ".join([row("high", "e || ' empty'", "e > 0"), row("medium", "sh || '/' || n || ' short'", "sh > 0.3 * n"), row("medium", "low || '/' || n || ' of low quality'", "low > 0.5 * n")]) + ")"


@query("dq_f_tables", " UNION ALL ".join([_dq_f_sql("dialogue_samples", "original_text", 30), _dq_f_sql("memorable_quotes", "quote_text", 15), _dq_f_sql("climax_excerpts", "original_text", 50), f"SELECT 'F', book_name, chapter_id, 'medium', 'climax without impact' FROM ({kind_sql('climax_excerpts')}) WHERE emotional_impact = ''"]))
def dq_f_tables(spark, sf_dir):
    return Q.sample_tables(_rows_of(spark, sf_dir, "dialogue_samples", "memorable_quotes", "climax_excerpts"))


@query("dq_g_characters", " UNION ALL ".join(f"SELECT 'G' AS stage, c_custkey::VARCHAR AS book_name, '' AS chapter_id, '{s}' AS severity, '{d}' AS description FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT book_name FROM ({kind_sql(t)}))" for t, s, d in (("character_speech_style", "high", "no speech style"), ("character_behavior_marks", "medium", "no behaviour"), ("character_relationship_dynamics", "medium", "no relations"))))
def dq_g_characters(spark, sf_dir):
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("book_name"))
    wanted = {"character_speech_style": ("high", "no speech style"), "character_behavior_marks": ("medium", "no behaviour"), "character_relationship_dynamics": ("medium", "no relations")}
    return Q.union([Q.missing_rows(books, rows, "G", *wanted[t]) for t, rows in _rows_of(spark, sf_dir, *wanted).items()])


@query("dq_save_suggested", f"""
WITH {_SUMMARY}, i AS (SELECT book_name, chapter_id, CASE WHEN summary = '' THEN 'critical' ELSE 'high' END AS severity, CASE WHEN summary = '' THEN 'empty summary' ELSE 'short summary' END AS description FROM s WHERE length(summary) < 50
  UNION ALL SELECT book_name, chapter_id, 'medium', 'no cast' FROM s WHERE cast_size = 0 UNION ALL SELECT book_name, '', 'critical', 'failure rate too high' FROM s GROUP BY book_name HAVING avg((summary = '')::INT) > 0.1)
SELECT md5(to_json([book_name, 'A', chapter_id, description])::VARCHAR) AS id, 'A' AS stage, book_name, chapter_id, severity, description, CASE WHEN description = 'no cast' THEN '' ELSE 'check the responses of these chapters and run them again' END AS suggestion FROM i""")
def dq_save_suggested(spark, sf_dir):
    return Q.suggested(Q.saved(Q.summary_rules(_summaries(spark, sf_dir)))).select("id", "stage", "book_name", "chapter_id", "severity", "description", "suggestion")


@query("dq_save_verdicts", f"""
WITH {_SUMMARY}, i AS (SELECT book_name, chapter_id, CASE WHEN summary = '' THEN 'critical' ELSE 'high' END AS severity FROM s WHERE length(summary) < 50 UNION ALL SELECT book_name, chapter_id, 'medium' FROM s WHERE cast_size = 0 UNION ALL SELECT book_name, '', 'critical' FROM s GROUP BY book_name HAVING avg((summary = '')::INT) > 0.1)
SELECT book_name, count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'high')::BIGINT AS high, count(*) FILTER (severity = 'medium')::BIGINT AS medium, 0::BIGINT AS low,
  count(*) FILTER (severity = 'critical') > 0 OR count(*) FILTER (severity = 'high') > 5 AS warn FROM i GROUP BY book_name""")
def dq_save(spark, sf_dir):
    return Q.verdicts(Q.saved(Q.summary_rules(_summaries(spark, sf_dir))))


# --- cross-book ----------------------------------------------------------------------------------------------------------


@query("xbk_01_coverage", """
SELECT 'world' AS dimension, count(DISTINCT source)::BIGINT AS books, count(DISTINCT source) >= 2 AS run FROM documents WHERE lang = 'es' UNION ALL
SELECT 'people', count(DISTINCT source), count(DISTINCT source) >= 2 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT 'retired', 0, false""")
def xbk_01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "book_name")
    return R.dimension_coverage({"world": d.where("lang = 'es'"), "people": d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")}, ["world", "people", "retired"])


@query("xbk_03_digest_lines", f"""
WITH {CHAPTERS}, r AS (SELECT category, book_name, '- ' || chapter_id || ': ' || left(text, 60) AS line, row_number() OVER (PARTITION BY category, book_name ORDER BY seq) AS n FROM chapters)
SELECT category, book_name, string_agg(line, chr(10) ORDER BY n) AS digest, count(*)::BIGINT AS lines FROM r WHERE n <= 5 GROUP BY ALL""")
def xbk_03(spark, sf_dir):
    return R.digest(chapters(spark, sf_dir), F.concat(F.lit("- "), "chapter_id", F.lit(": "), F.substring("text", 1, 60)), ["category", "book_name"], ["seq"], 5)


@query("xbk_04_evidence", """
SELECT 'documents' AS origin, doc_id AS seq, substr(text, 1, 300) AS excerpt FROM (SELECT * FROM documents WHERE lang ILIKE '%e%' ORDER BY doc_id LIMIT 10)
UNION ALL SELECT 'pages', page_id, substr(html, 1, 200) FROM (SELECT * FROM pages WHERE url ILIKE '%e%' ORDER BY page_id LIMIT 10)""")
def xbk_04(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("type"), F.col("doc_id").alias("seq"), "text")
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("type"), F.col("page_id").alias("seq"), F.col("html").alias("text"))
    return R.evidence({"documents": (d, 300), "pages": (p, 200)}, "e")


@query("xbk_06_benchmark_pack", f"""
SELECT book_name, type, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY book_name, type ORDER BY writing_quality DESC, seq)::INT AS place FROM ({_SAMPLES})) WHERE place <= 3""")
def xbk_06(spark, sf_dir):
    return R.best_rows(_samples(spark, sf_dir), 3, True).select("book_name", "type", "seq", "place")


@query("xbk_07_recommendation", f"""
WITH {CHAPTERS}, a AS (SELECT book_name, string_agg(x, chr(10) ORDER BY n) AS settings FROM (SELECT book_name, category || ':' || chapter_id AS x, row_number() OVER (PARTITION BY book_name ORDER BY seq) AS n FROM chapters) WHERE n <= 5 GROUP BY ALL),
t AS (SELECT book_name, arg_min(left(text, 50), seq) AS theme FROM chapters GROUP BY ALL) SELECT * FROM a JOIN t USING (book_name)""")
def xbk_07(spark, sf_dir):
    c = chapters(spark, sf_dir)
    settings = R.digest(c, F.concat_ws(":", "category", "chapter_id"), ["book_name"], ["seq"], 5).select("book_name", F.col("digest").alias("settings"))
    return R.one_row_each(settings, {"t": c.groupBy("book_name").agg(F.min_by(F.substring("text", 1, 50), "seq").alias("theme"))}, "book_name")


_GIVEN = lambda c: f"coalesce({c}::VARCHAR, '')"
_STEPS = lambda c: f"coalesce(json_array_length({c}), 0)"
_BOOKS = "SELECT DISTINCT user_id::VARCHAR AS book_name FROM events WHERE user_id % 3 <> 0"

#: Each dimension's table, rows and line, stated in SQL for itself.
_DIMENSION_SQL = {
    "高潮铺垫方式": ("climax_buildup_chains", 5, f"'高潮: ' || {_GIVEN('climax_name')} || ' (第' || {_GIVEN('climax_chapter')} || '章) | 铺垫步骤: ' || {_STEPS('buildup_steps_json')} || '步 | 张力升级: ' || {_GIVEN('tension_escalation')}"),
    "冲突升级模式": ("conflict_escalation", 5, f"'冲突线: ' || {_GIVEN('conflict_line')} || ' | 升级步骤: ' || {_STEPS('escalation_steps_json')} || '步 | 升级模式: ' || {_GIVEN('escalation_pattern')}"),
    "人物塑造": ("character_profiles", 5, f"'角色: ' || {_GIVEN('name')} || ' (' || {_GIVEN('role_type')} || ')'"),
    "世界观设计": ("world_settings", 10, f"{_GIVEN('module')} || ':' || {_GIVEN('entity')} || ' - ' || left({_GIVEN('content')}, 100)"),
    "对话风格": ("character_speech_style", 5, f"'角色: ' || {_GIVEN('character_name')} || ' | 口头禅: ' || {_GIVEN('catchphrases')} || ' | 词汇偏好: ' || {_GIVEN('vocabulary_preference')} || ' | 句式: ' || {_GIVEN('sentence_pattern')}"),
    "描写技法": ("description_samples", 5, f"'类型: ' || {_GIVEN('description_type')} || ' | 技法: ' || {_GIVEN('technique_analysis')} || ' | 感官: ' || {_GIVEN('sensory_details')}"),
    "信息管理": ("information_management", 5, f"'策略: ' || {_GIVEN('strategy_type')} || ' | 目标信息: ' || {_GIVEN('target_info')} || ' | 隐瞒方式: ' || {_GIVEN('conceal_method')} || ' | 揭露时机: ' || {_GIVEN('reveal_timing')} || ' | 戏剧目的: ' || {_GIVEN('dramatic_purpose')}"),
    "伏笔设计": ("plot_foreshadowing", 5, f"'伏笔: ' || {_GIVEN('hook_name')} || ' | 埋设: 第' || {_GIVEN('planted_chapter')} || '章 | 计划回收: ' || {_GIVEN('planned_payoff')} || ' | 状态: ' || {_GIVEN('status')}"),
}


def _told_sql(table_sql: str, line: str, most: int, separator: str = "chr(10)", where: str = "true") -> str:
    return f"SELECT book_name, string_agg(line, {separator} ORDER BY n) AS told FROM (SELECT book_name, {line} AS line, row_number() OVER (PARTITION BY book_name ORDER BY id) AS n FROM ({table_sql}) WHERE {where}) WHERE n <= {most} GROUP BY book_name"


@query("xbk_03_dimension_digests", f"WITH b AS ({_BOOKS}) " + " UNION ALL ".join(
    [f"SELECT '{d}' AS dimension, book_name, told AS digest FROM ({_told_sql(kind_sql(t), line, n)}) WHERE book_name IN (SELECT book_name FROM b)" for d, (t, n, line) in _DIMENSION_SQL.items()]
    + [f"SELECT '{d}', book_name, '{x}' FROM b" for d, x in (("感情线设计", "感情线: 数据已废弃"), ("结构编排", "结构: 数据已废弃"))]))
def xbk_03_dimensions(spark, sf_dir):
    books = table(spark, sf_dir, "events").where("user_id % 3 <> 0").select(F.col("user_id").cast("string").alias("book_name"))
    return D.dimension_digests(_rows_of(spark, sf_dir, *(t for t, *_ in D.LINES.values())), books)


_EVIDENCE = (
    ("buildup_chain", "climax_buildup_chains", "s IN ('打斗', '高潮', '转折', '揭秘', 'e') AND contains(climax_name, s)", "climax_name", "buildup_steps_json", "tension_escalation", _STEPS("buildup_steps_json") + "::VARCHAR"),
    ("excerpt", "climax_excerpts", "contains(excerpt_type, s)", "excerpt_type", "left(original_text, 300)", "technique_analysis", "''"),
    ("dialogue", "dialogue_samples", "s = '对话'", "scene_type", "left(original_text, 300)", "subtext", "plot_function"),
    ("description", "description_samples", "s = '描写'", "description_type", "left(original_text, 300)", "technique_analysis", "sensory_details"),
    ("action", "action_scene_samples", "s = '打斗'", "action_type", "left(original_text, 300)", "technique_analysis", "pacing_analysis"),
    ("skill", "skills", "contains(scene_type, s)", "skill_name", "left(original_example, 200)", "analysis", "''"),
)


@query("xbk_04_scene_evidence", "WITH s AS (SELECT unnest(['打斗', '对话', '描写', '高潮', '转折', '揭秘', 'e']) AS s), u AS (" + " UNION ALL ".join(
    f"SELECT s, {n} AS source, id, '{kind}' AS type, book_name, {_GIVEN(name)} AS name, {_GIVEN(text)} AS text, {_GIVEN(analysis)} AS analysis, {_GIVEN(more)} AS more FROM ({kind_sql(t)}), s WHERE {of.replace(", 'e'", '')} QUALIFY row_number() OVER (PARTITION BY s ORDER BY id) <= 10"
    for n, (kind, t, of, name, text, analysis, more) in enumerate(_EVIDENCE))
    + ") SELECT s AS scene_type, row_number() OVER (PARTITION BY s ORDER BY source, id)::INT AS place, type, book_name, name, text, analysis, more FROM u QUALIFY place <= 20")
def xbk_04_scenes(spark, sf_dir):
    return D.scene_evidence(_rows_of(spark, sf_dir, *(t for _, t, *_ in _EVIDENCE)), (*D.SCENES, "e"))


_LINE = lambda a, x, b, y, c, z: f"'  {a}:' || {_GIVEN(x)} || ' | {b}:' || {_GIVEN(y)} || chr(10) || '  {c}:' || {z}"


@query("xbk_06_review_pack", f"""
WITH b AS ({_BOOKS}), d AS ({_told_sql(kind_sql('dialogue_samples'), _LINE('场景', 'scene_type', '张力', 'emotional_tension', '原文', "left(coalesce(original_text, ''), 200)"), 3)}),
e AS ({_told_sql(kind_sql('description_samples'), _LINE('类型', 'description_type', '技法', 'technique_analysis', '原文', "left(coalesce(original_text, ''), 200)"), 3)}),
n AS ({_told_sql(kind_sql('narrative_distance'), _LINE('距离', 'distance_type', '触发', 'trigger_reason', '示例', "left(coalesce(original_example, ''), 150)"), 2)})
SELECT book_name, concat_ws(chr(10), chr(10) || '===== 标杆作品《' || book_name || '》=====', '【对话样本】' || chr(10) || d.told, '【描写样本】' || chr(10) || e.told, '【叙事距离控制】' || chr(10) || n.told) AS pack
FROM b LEFT JOIN d USING (book_name) LEFT JOIN e USING (book_name) LEFT JOIN n USING (book_name) WHERE coalesce(d.told, e.told, n.told) IS NOT NULL""")
def xbk_06_pack(spark, sf_dir):
    books = table(spark, sf_dir, "events").where("user_id % 3 <> 0").select(F.col("user_id").cast("string").alias("book_name"))
    return D.review_pack(_rows_of(spark, sf_dir, "dialogue_samples", "description_samples", "narrative_distance"), books)


@query("xbk_07_recommendation_digest", f"""
WITH b AS (SELECT user_id::VARCHAR AS book_name, min(event_type) AS category FROM events GROUP BY ALL),
w AS ({_told_sql(kind_sql('world_settings'), f"{_GIVEN('module')} || ':' || {_GIVEN('entity')}", 5, "', '")}),
c AS ({_told_sql(kind_sql('character_profiles'), f"{_GIVEN('name')} || '(' || {_GIVEN('role_type')} || ')'", 5, "', '")}),
m AS ({_told_sql(kind_sql('plot_lines'), _GIVEN('theme'), 1, "''", "line_type = 'main'")})
SELECT book_name, '【《' || book_name || '》】' || chr(10) || concat_ws(chr(10), '分类: ' || category, '世界观: ' || w.told, '人物: ' || c.told, '主线: ' || m.told) AS digest
FROM b LEFT JOIN w USING (book_name) LEFT JOIN c USING (book_name) LEFT JOIN m USING (book_name)""")
def xbk_07_digest(spark, sf_dir):
    books = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("book_name")).agg(F.min("event_type").alias("category"))
    rows = _rows_of(spark, sf_dir, "world_settings", "character_profiles", "plot_lines")
    return D.recommendation_digest(books, *rows.values())


@query("xbk_08_volume_digest", f"""
WITH {CHAPTERS}, i AS (SELECT book_name, seq, chapter_id, {INDEXED} FROM chapters), v AS (SELECT *, (idx // least(ceil(n / 10e0), 75)::INT)::INT AS volume FROM i)
SELECT book_name, volume, string_agg(chapter_id, chr(10) ORDER BY seq) AS digest, count(*)::BIGINT AS lines FROM v GROUP BY ALL""")
def xbk_08(spark, sf_dir):
    from ..operators.chapters import volumes

    v = volumes(indexed(chapters(spark, sf_dir, "book_name", "seq", "chapter_id")))
    return R.digest(v, F.col("chapter_id"), ["book_name", "volume"], ["seq"], 1000)


@query("xbk_09_event_digest", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, props FROM events), l AS (SELECT user_id, n, '#' || n || ' [' || event_id || '] ' || event_type || ': ' || props AS line FROM r WHERE n <= 50)
SELECT user_id, left(string_agg(line, chr(10) ORDER BY n), least(8000, 200 * count(*) + 1000)::INT) AS digest, count(*)::BIGINT AS lines FROM l GROUP BY user_id""")
def xbk_09(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("#"), "_n", F.lit(" ["), "event_id", F.lit("] "), "event_type", F.lit(": "), "props")
    return R.digest(e, line, ["user_id"], ["ts", "event_id"], 50, F.least(F.lit(8000), F.col("lines") * 200 + 1000))
