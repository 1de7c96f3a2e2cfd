"""Queries over response ingestion and keyed writes. Events play the extraction responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import upsert as U
from .base import query, table

_K = "(props::JSON->>'k')::INT"


def _responses(spark, sf_dir, body, *beside):
    """Events as responses: book = user, chapter = hour, JSON built from the event, some fenced, some broken."""
    e = _events(spark, sf_dir)
    json = F.to_json(body)
    fenced = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Here it is:\n```json\n"), json, F.lit("\n```\nDone.")))
    broken = F.when(F.col("event_id") % 17 == 0, F.substring(json, 1, 12))
    return e.select(
        F.col("user_id").cast("string").alias("book_name"), F.date_format("ts", "'h'dd-HH").alias("chapter_id"), F.col("event_id").alias("seq"),
        F.coalesce(broken, fenced, json).alias("response"), *beside,
    )


def _events(spark, sf_dir):
    """Events with the number in their ``props``, which is read out once however many fields use it."""
    return table(spark, sf_dir, "events").withColumn("_k", F.get_json_object("props", "$.k").cast("int"))


def _k():
    return F.col("_k")


_GOOD = "event_id % 17 <> 0"
_BOOK = "user_id::VARCHAR"
_CHAPTER = "strftime(ts, 'h%d-%H')"


@query("src_07_parse", f"SELECT event_id AS seq, {_GOOD} AS ok, CASE WHEN {_GOOD} THEN event_type END AS kind, CASE WHEN {_GOOD} THEN {_K} END AS k FROM events")
def src_07(spark, sf_dir):
    r = _responses(spark, sf_dir, F.struct(F.col("event_type").alias("kind"), _k().alias("k")))
    p = I.parsed(r, "struct<kind:string,k:int>")
    return p.select("seq", F.col("parsed").isNotNull().alias("ok"), "parsed.kind", "parsed.k")


@query("src_07_rejects", f"SELECT user_id::VARCHAR AS book_name, count(*)::BIGINT AS rejected FROM events WHERE NOT ({_GOOD}) GROUP BY user_id")
def src_07_rejects(spark, sf_dir):
    r = _responses(spark, sf_dir, F.struct(F.col("event_type").alias("kind"), _k().alias("k")))
    return I.rejects(r).groupBy("book_name").agg(F.count("*").alias("rejected"))


#: What an event says for a field, by its kind, in Spark and in SQL (missing for some events).
_VALUES = {
    "text": (lambda f, i: F.when(_k() % (7 + i) == 0, F.lit(" ")).otherwise(F.concat(F.lit(f"{f}-"), F.col("event_type"), F.lit("-"), _k() % (5 + i))), lambda f, i: f"CASE WHEN {_K} % {7 + i} = 0 THEN NULL ELSE '{f}-' || event_type || '-' || {_K} % {5 + i} END"),
    "int": (lambda f, i: F.when(_k() % 4 != 0, _k()), lambda f, i: f"CASE WHEN {_K} % 4 <> 0 THEN {_K} END"),
    "double": (lambda f, i: F.when(_k() % 4 != 0, F.col("value")), lambda f, i: f"CASE WHEN {_K} % 4 <> 0 THEN value END"),
    "json": (lambda f, i: F.when(_k() % 6 != 0, F.array(F.col("event_type"), _k().cast("string"))), lambda f, i: f"CASE WHEN {_K} % 6 <> 0 THEN to_json([event_type, {_K}::VARCHAR])::VARCHAR END"),
    "bar": (lambda f, i: F.array(F.col("event_type"), _k().cast("string")), lambda f, i: f"event_type || '|' || {_K}"),
    "comma": (lambda f, i: F.array(F.col("event_type"), F.lit("未知"), _k().cast("string")), lambda f, i: f"event_type || ',' || {_K}"),
    "array": (lambda f, i: F.array(F.col("event_type"), (_k() % 3).cast("string")), lambda f, i: f"[event_type, ({_K} % 3)::VARCHAR]"),
}


def _objects(**fields):
    """A list of two objects, of which only the first has its required field."""
    kind = "array<struct<" + ",".join(f"{n}:string" for n in fields) + ">>"
    item = lambda first: F.struct(*((F.col("event_type") if v == "=" and first else F.lit(None if v == "=" else v)).cast("string").alias(n) for n, v in fields.items()))
    return F.array(item(True), item(False)).cast(kind)


#: Fields with a layout of their own: (table, field) -> the JSON value in Spark.
_LAYOUTS = {
    ("plot_arcs", "_state"): lambda: F.struct(F.struct(F.array(F.col("event_type"), _k().cast("string")).alias("feels"), F.lit("京城").alias("at")).alias("甲"), F.col("event_type").alias("乙")),
    ("plot_arcs", "_key_events"): lambda: F.array(F.struct(F.col("event_type").alias("event"), F.lit("变").alias("impact"))),
    ("plot_arcs", "_scene_transitions"): lambda: F.struct(_k().alias("count"), F.array(F.lit("时间跳跃")).alias("methods")),
    ("plot_arcs", "_emotion_arc"): lambda: F.lit("平静"),
    ("plot_foreshadowing", "_action"): lambda: F.element_at(F.array(*map(F.lit, ("Resolve", "推进(advance)", "defer", "plant"))), _k() % 4 + 1),
    ("chapter_reviews", "_scores"): lambda: F.struct(F.struct(_k().alias("score"), F.col("event_type").alias("comment")).alias("对话"), F.lit("x").alias("note")),
    ("chapter_reviews", "_issues"): lambda: _objects(issue_type="=", severity=None, description="d", extra="e"),
    ("chapter_reviews", "_suggestions"): lambda: _objects(suggestion_type="=", priority="高"),
    ("chapter_reviews", "_rewrites"): lambda: _objects(rewritten_text="=", original_text="o"),
}

_OPEN = "CASE WHEN k % 4 = 0 THEN 'resolved' WHEN k % 4 = 1 THEN 'advancing' WHEN k % 4 = 2 THEN 'deferred' ELSE 'open' END"
#: Derived columns where Spark's expression is not SQL that both engines read.
_DERIVED = {
    ("plot_arcs", "character_state_json"): """'{"character_state":{"乙":"' || et || '","甲_at":"京城","甲_feels":"' || et || ', ' || k || '"},"key_events":[{"event":"' || et || '","impact":"变"}],"scene_transitions":{"count":' || k || ',"methods":["时间跳跃"]},"information_flow":' || _information_flow || ',"emotion_arc":"平静","time_progression":' || _time_progression || '}'""",
    ("classic_excerpts", "_garbled"): "false",
    ("plot_foreshadowing", "status"): _OPEN,
    ("entity_state_tracker", "current_state_json"): "json_object('type', _type, 'detail', _detail)::VARCHAR",
    ("cross_book_comparisons", "books_analyzed"): "to_json(_books)::VARCHAR",
    ("cross_book_comparisons", "_joined"): "array_to_string(_books, '_')",
    ("chapter_reviews", "dimension_scores_json"): """'{"对话":{"score":' || k::DOUBLE || ',"comment":"' || et || '"}}'""",
    ("chapter_reviews", "issues_json"): """'[{"issue_type":"' || et || '","severity":"中","location":"","description":"d","original_excerpt":""}]'""",
    ("chapter_reviews", "suggestions_json"): """'[{"suggestion_type":"' || et || '","priority":"高","description":"","expected_effect":""}]'""",
    ("chapter_reviews", "rewrite_samples_json"): """'[{"original_text":"o","rewritten_text":"' || et || '","rewrite_reason":"","technique_applied":""}]'""",
}


def _literal(v: object) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _kind_sql(kind: I.Kind) -> str:
    raw, filled = [], []
    for i, (name, f) in enumerate(kind.fields.items()):
        value = "NULL" if (kind.table, name) in _LAYOUTS else _VALUES[f.how][1](name.strip("_"), i)
        raw.append(f"{value} AS {name}")
        filled.append(name if f.default is None or f.how == "array" else f"coalesce({name}, {_literal(f.default)}) AS {name}")
    kept = [c for c in ("book_name", "chapter_id", "seq") if c not in kind.fields]
    own = {"book_name": f"{_BOOK} AS book_name", "chapter_id": f"{_CHAPTER} AS chapter_id", "seq": "event_id AS seq"}
    derived = "".join(f", {_DERIVED.get((kind.table, n), r)} AS {n}" for n, r in kind.derive.items())
    where = " AND ".join([f"coalesce({f}, '') <> ''" for f in kind.required if (kind.table, f) not in _LAYOUTS] or ["true"])
    names = {*kind.fields, *kind.derive, "book_name", "chapter_id"}
    key = "chapter_id" if kind.key == ("chapter_id",) else "md5(to_json([" + ", ".join(f"coalesce({k}::VARCHAR, '')" if k in names else f"'{k}'" for k in kind.key) + "])::VARCHAR)"
    order = "ASC" if kind.first else "DESC"
    columns = ["id", "book_name", "chapter_id", "seq", "0::INT AS pos", *(c for c in kind.columns if c not in ("book_name", "chapter_id"))]
    once = " QUALIFY row_number() OVER (PARTITION BY book_name ORDER BY seq) = 1" if kind.limit_one_per_book else ""
    return f"""
WITH raw AS (SELECT {', '.join([*(own[c] for c in kept), 'event_type AS et', f'{_K} AS k', *raw])} FROM events WHERE {_GOOD}),
filled AS (SELECT {', '.join([*kept, 'et', 'k', *filled])} FROM raw),
derived AS (SELECT *{derived} FROM filled WHERE {where}),
keyed AS (SELECT *, {key} AS id FROM derived WHERE {kind.where}),
kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq {order}) = 1)
SELECT {', '.join(columns)} FROM kept{once}"""


def kind_sql(name: str) -> str:
    return _kind_sql(I.KINDS[name])


def kind_responses(spark, sf_dir, kind: I.Kind):
    """Events as responses in the layout of a kind, with the columns that stand beside them."""
    inside, outside, beside = [], [], []
    for i, (name, f) in enumerate(kind.fields.items()):
        layout = _LAYOUTS.get((kind.table, name))
        value = layout() if layout else _VALUES[f.how][0](name.strip("_"), i)
        if f.source.startswith("@"):
            beside.append((F.when(F.trim(value) != "", value) if f.how == "text" else value).alias(f.source[1:]))
        elif f.source.startswith("$"):
            outside.append(value.alias(f.source[2:]))
        else:
            inside.append(value.alias(f.source))
    item = F.struct(*inside)
    body = item if not kind.path else F.struct(*outside, (item if kind.one else F.array(item)).alias(kind.path))
    return _responses(spark, sf_dir, body, *beside)


def _register(number: str, kind: I.Kind) -> None:
    @query(f"{number}_{kind.table}", _kind_sql(kind))
    def run(spark, sf_dir):
        return I.ingest(kind_responses(spark, sf_dir, kind), kind)


_NUMBERS = {
    "ing_01": ["plot_arcs"], "ing_02": ["skills"], "ing_03": ["author_fingerprints", "sensory_mappings", "classic_excerpts"], "ing_04": ["world_settings"],
    "ing_05": ["world_timeline", "faction_networks"], "ing_06": ["golden_finger"], "ing_07": ["character_profiles"], "ing_08": ["macro_outlines"],
    "ing_09": ["plot_foreshadowing"], "ing_10": ["entity_state_tracker", "setting_evolutions"], "ing_11": ["chapter_functions"],
    "ing_12": ["dialogue_samples", "description_samples", "transition_samples", "narrative_distance", "show_tell_patterns", "action_scene_samples", "climax_excerpts", "memorable_quotes"],
    "ing_13": ["character_speech_style", "character_behavior_marks", "character_relationship_dynamics"],
    "ing_14": ["plot_lines", "revelation_pacing", "emotion_transition_patterns", "information_management", "climax_buildup_chains", "conflict_escalation"],
    "ing_15": ["story_events", "event_causal_edges"], "ing_16": ["chapter_reviews"], "ing_17": ["kb_references"], "ing_18": ["cross_book_comparisons", "common_mistakes", "technique_combinations"],
}
for _number, _tables in _NUMBERS.items():
    for _table in _tables:
        _register(_number, I.KINDS[_table])


@query("ing_01_flattened_state", f"SELECT event_id, ['mood_' || event_type, 'plain'] AS names, [{_K}::VARCHAR || ', ' || user_id, event_type] AS vals FROM events")
def ing_01_state(spark, sf_dir):
    e = _events(spark, sf_dir)
    inner = F.create_map(F.col("event_type"), F.array(_k().cast("string"), F.col("user_id").cast("string")))
    state = F.concat(F.lit('{"mood":'), F.to_json(inner), F.lit(',"plain":"'), F.col("event_type"), F.lit('"}'))
    m = I.flattened_state(state)
    return e.select("event_id", m.alias("m")).select("event_id", F.map_keys("m").alias("names"), F.map_values("m").alias("vals"))


@query("ing_09_status", """
SELECT event_id, CASE WHEN s LIKE '%resolve%' THEN 'resolved' WHEN s LIKE '%advance%' THEN 'advancing' WHEN s LIKE '%defer%' THEN 'deferred' ELSE 'open' END AS status
FROM (SELECT event_id, ['Resolved', 'advance', 'defer it', 'planted', ''][(event_id % 5 + 1)::INT].lower() AS s FROM events)""")
def ing_09_status(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, ("Resolved", "advance", "defer it", "planted", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", I.foreshadowing_status(s).alias("status"))


@query("ing_15_causal_edges", f"""
WITH e AS (SELECT {_BOOK} AS book_name, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS c, event_type FROM events),
n AS (SELECT *, (c // 10)::INT AS batch, row_number() OVER (PARTITION BY book_name, c // 10 ORDER BY c, event_id)::INT AS number FROM e),
edges AS (
  SELECT a.book_name, a.event_id AS source_event_id, b.event_id AS target_event_id, a.event_type AS relation_type, b.event_type AS relation_detail
  FROM n a JOIN n b ON a.book_name = b.book_name AND a.batch = b.batch AND b.number = a.number + 1
  UNION ALL SELECT book_name, event_id, lead(event_id) OVER (PARTITION BY book_name ORDER BY c), 'global', '' FROM n WHERE event_type = 'error'
)
SELECT md5(to_json([book_name, source_event_id::VARCHAR, target_event_id::VARCHAR])::VARCHAR) AS id, * FROM edges WHERE target_event_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY book_name, source_event_id, target_event_id ORDER BY relation_type = 'global') = 1""")
def ing_15_edges(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    events = e.select(F.col("user_id").cast("string").alias("book_name"), "event_id", order.alias("chapter_no"), F.col("event_id").alias("seq"), "event_type")
    events = I.numbered_events(events)
    w = Window.partitionBy("book_name", "batch").orderBy("number")
    edges = events.select("book_name", "batch", F.col("number").cast("string").alias("source"), (F.col("number") + 1).cast("string").alias("target"), F.col("event_type").alias("relation_type"), F.coalesce(F.lead("event_type").over(w), F.lit("")).alias("relation_detail"))
    weighty = events.where("event_type = 'error'").withColumn("next", F.lead("event_id").over(Window.partitionBy("book_name").orderBy("chapter_no"))).where("next is not null")
    whole = weighty.select(T.key("book_name", "event_id", "next").alias("id"), "book_name", F.col("event_id").alias("source_event_id"), F.col("next").alias("target_event_id"), F.lit("global").alias("relation_type"), F.lit("").alias("relation_detail"))
    return I.with_global_edges(I.causal_edges(edges, events), whole)


@query("ing_18_benchmarks", f"""
WITH m AS ({_kind_sql(I.KINDS['common_mistakes'])}), d AS ({_kind_sql(I.KINDS['dialogue_samples'])}), x AS ({_kind_sql(I.KINDS['climax_excerpts'])}),
b AS (SELECT 0 AS n, substr(arg_min(original_text, id), 1, 200) AS example, arg_min(book_name, id) AS book FROM d UNION ALL SELECT 1, substr(arg_min(original_text, id), 1, 200), arg_min(book_name, id) FROM x)
SELECT m.id, CASE m.frequency % 3 WHEN 0 THEN '对话' WHEN 1 THEN '节奏' ELSE '其他' END AS dimension, coalesce(example, '') AS benchmark_example, coalesce(book, '') AS benchmark_book FROM m LEFT JOIN b ON n = m.frequency % 3""")
def ing_18_benchmarks(spark, sf_dir):
    rows = {t: I.ingest(kind_responses(spark, sf_dir, I.KINDS[t]), I.KINDS[t]) for t in ("common_mistakes", "dialogue_samples", "climax_excerpts")}
    mistakes = rows.pop("common_mistakes").withColumn("dimension", F.when(F.col("frequency") % 3 == 0, "对话").when(F.col("frequency") % 3 == 1, "节奏").otherwise("其他"))
    return I.with_benchmarks(mistakes.select("id", "dimension"), rows)


_ROWS = f"SELECT md5(to_json([user_id::VARCHAR, event_type])::VARCHAR) AS id, user_id, event_type, value, event_id AS seq, (event_id // 1000)::INT AS batch FROM events"


def _rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(T.key("user_id", "event_type").alias("id"), "user_id", "event_type", "value", F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 1000).cast("int").alias("batch"))


@query("key_02_replace", f"SELECT * FROM ({_ROWS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC, seq DESC) = 1")
def key_02(spark, sf_dir):
    return U.replaced(_rows(spark, sf_dir), "id", "batch", "seq")


@query("key_03_ignore", f"SELECT * FROM ({_ROWS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch, seq) = 1")
def key_03(spark, sf_dir):
    return U.ignored(_rows(spark, sf_dir), "id", "batch", "seq")


@query("key_04_vector_upsert", f"SELECT * FROM ({_ROWS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC, seq) = 1")
def key_04(spark, sf_dir):
    return U.vector_upserted(_rows(spark, sf_dir), "id", "batch", "seq")


@query("key_05_new_only", f"WITH r AS ({_ROWS}) SELECT * FROM r WHERE batch >= 1 AND id NOT IN (SELECT id FROM r WHERE batch < 1)")
def key_05(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return U.new_only(r.where("batch >= 1"), r.where("batch < 1"))


@query("key_06_counts", """
SELECT 'documents' AS table_name, source AS book_name, count(*)::BIGINT AS records FROM documents GROUP BY source
UNION ALL SELECT 'events', user_id::VARCHAR, count(*) FROM events GROUP BY user_id""")
def key_06(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_name"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("book_name"))
    return U.counts_by_book({"documents": d, "events": e})


_PROGRESS = f"(SELECT {_BOOK} AS book_name, event_type AS stage, arg_max(CASE WHEN {_K} % 3 = 0 THEN 'failed' WHEN {_K} % 7 = 0 THEN 'skipped' ELSE 'complete' END, event_id) AS status FROM events GROUP BY ALL)"


def _progress(spark, sf_dir):
    status = F.when(_k() % 3 == 0, "failed").when(_k() % 7 == 0, "skipped").otherwise("complete")
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("book_name"), F.col("event_type").alias("stage"), status.alias("status"), "event_id")
    return e.groupBy("book_name", "stage").agg(F.max_by("status", "event_id").alias("status"))


@query("key_07_pending", f"""
WITH p AS {_PROGRESS}, w AS (SELECT DISTINCT b.book_name, s.stage FROM p b, (SELECT DISTINCT stage FROM p) s)
SELECT * FROM w EXCEPT SELECT book_name, stage FROM p WHERE status = 'complete'""")
def key_07(spark, sf_dir):
    p = _progress(spark, sf_dir)
    stages = F.explode(F.array(*(F.lit(r["stage"]) for r in p.select("stage").distinct().collect())))
    return U.pending(p.select("book_name").distinct().select("book_name", stages.alias("stage")), p)


_STAGES = ("click", "error", "login", "purchase", "view")


@query("key_08_status_matrix", f"""
WITH p AS {_PROGRESS}, w AS (SELECT book_name, {', '.join(f"max(CASE WHEN stage = '{s}' THEN status END) AS {s}" for s in _STAGES)} FROM p GROUP BY book_name)
SELECT *, CASE WHEN list_count(list_filter([{', '.join(_STAGES)}], lambda x: x = 'complete')) = 5 THEN 'DONE' WHEN list_contains([{', '.join(_STAGES)}], 'failed') THEN 'ERR'
  WHEN list_contains([{', '.join(_STAGES)}], 'skipped') THEN 'SKIP' WHEN list_contains([{', '.join(_STAGES)}], 'complete') THEN 'WIP' ELSE 'NEW' END AS overall FROM w""")
def key_08(spark, sf_dir):
    return U.status_matrix(_progress(spark, sf_dir), list(_STAGES))


@query("key_09_grown", "SELECT count(DISTINCT source)::BIGINT AS books, count(DISTINCT source) > count(DISTINCT CASE WHEN doc_id < 5 THEN source END) AS run FROM documents")
def key_09(spark, sf_dir):
    before = F.count_distinct(F.when(F.col("doc_id") < 5, F.col("source")))
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("books"), (F.count_distinct("source") > before).alias("run"))


@query("snk_05_migrated", "SELECT d.doc_id, coalesce(l.quality, 5)::INT AS writing_quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def snk_05(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return U.migrated(joined.withColumnRenamed("quality", "writing_quality")).select("doc_id", "writing_quality")
