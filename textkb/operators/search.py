"""Filters, paging, vector top-k, fan-out over collections, and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pivots import nearest_each

#: Queries that are held against all vectors in one pass.
FEW = 256

def _known(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def equals(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal the given values; values that are None or '' do not filter."""
    given = {k: v for k, v in values.items() if v not in (None, "")}
    _known(df, list(given))
    return df.where(reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]), given.items(), F.lit(True)))


def like(df: DataFrame, columns: str | Sequence[str], value: str) -> DataFrame:
    """Rows in which any of the columns is LIKE ``%value%``; '' does not filter.

    ``%`` and ``_`` in the value are wildcards and nothing escapes them, so a backslash is one; case is ignored for A to Z
    and no other letters. A null column does not match.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    _known(df, columns)
    if not value:
        return df
    pattern = "%" + "".join(c.lower() if c.isascii() else c for c in value).replace("\\", "\\\\") + "%"
    folded = lambda c: F.translate(F.col(c).cast("string"), ascii_uppercase, ascii_lowercase)
    return df.where(reduce(lambda a, c: a | folded(c).like(pattern), columns, F.lit(False)))


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page; give an order that ends in a unique column."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def number_between(df: DataFrame, column: str, span: str) -> DataFrame:
    """Rows whose number lies in a range written ``a-b`` (or ``a``)."""
    a, _, b = span.partition("-")
    return df.where(F.col(column).between(int(a), int(b or a)))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in double precision in component order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: Sequence[float], k: int, where: Mapping[str, object] | None = None, id_column: str = "id") -> DataFrame:
    """The k nearest vectors to one query, by (distance, id); ``where`` filters before."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = equals(vectors, **dict(where or {})).withColumn("distance", squared_distance(F.col("embedding"), q))
    return page(found, ["distance", id_column], k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, by: Sequence[str] = (), id_column: str = "id") -> DataFrame:
    """The k nearest vectors for every row of a query set (``query_id``, ``query``) of any size, per ``by`` group.

    Up to ``FEW`` queries are held against all vectors in one pass, which costs less than cells around pivots; more go
    through ``pivots``. Both are exact and give the same rows. Vectors and queries that are null or of another length
    meet nothing in the pass; see ``nearest_each`` for those around pivots.
    """
    q = queries.where("query is not null").select("query_id", F.col("query").cast("array<double>").alias("query"))
    if q.count() > FEW:
        return nearest_each(vectors, queries, k, by, id_column)
    held = q.agg(F.collect_list(F.struct("query_id", "query")).alias("_q"))  # one row of at most FEW queries
    rows = vectors.join(F.broadcast(held), F.lit(True)).withColumn("_q", F.explode("_q"))
    rows = rows.select(*vectors.columns, F.col("_q.query_id").alias("query_id"), squared_distance(F.col("embedding"), F.col("_q.query")).alias("distance"))
    w = Window.partitionBy("query_id", *by).orderBy("distance", id_column)
    ranked = rows.where("distance is not null").withColumn("rank", F.row_number().over(w))  # k rows a query leave each task
    return ranked.where(F.col("rank") <= k)


def hybrid(semantic: DataFrame, structured: DataFrame, limit: int, id_column: str = "id") -> DataFrame:
    """Vector hits by rank first, then structured rows that they do not hold, by id; cut to ``limit``.

    ``semantic`` has a ``rank``; both have the id and may have different other columns.
    """
    a = semantic.withColumn("leg", F.lit("semantic"))
    b = structured.join(semantic.select(id_column), id_column, "left_anti").withColumn("leg", F.lit("structured")).withColumn("rank", F.lit(None).cast("int"))
    both = a.unionByName(b, allowMissingColumns=True)
    return page(both, [F.when(F.col("leg") == "semantic", 0).otherwise(1), F.col("rank").asc_nulls_last(), F.col(id_column)], limit)


def document_text(template: Mapping[str, str]) -> Column:
    """``label:value`` lines for the given columns; missing values are empty."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in template.items()))


#: The lines of a row's document by its table: (label, column); a label with ? is left out when blank.
TEMPLATES = {
    "skills": (("技法", "skill_name"), ("分析", "analysis"), ("原文", "original_example")),
    "sensory_mappings": (("情绪", "emotion"), ("展示", "show_not_tell"), ("分析", "analysis")),
    "world_settings": (("模块", "module"), ("实体", "entity"), ("设定", "content")),
    "character_profiles": (("定位", "role_type"), ("外貌", "appearance"), ("微表情/口癖", "quirks"), ("身份", "identity"), ("动机", "motivation"), ("内心冲突/弧光", "internal_conflict"), ("性格", "personality"), ("与主角关系", "relation_to_mc"), ("与其他配角关系", "relations_to_others"), ("高光/宿命预设", "climax_or_fate"), ("前史", "background"), ("语言风格样本", "speech_samples"), ("行为标志样本", "behavior_samples"), ("关系演变", "relationship_evolution"), ("能力体系", "abilities"), ("两难困境", "internal_dilemma"), ("转变触发器", "transformation_trigger"), ("对比设计", "contrast_design")),
    "macro_outlines": (("卷主题", "theme"), ("冲突", "conflict"), ("弧光", "arc"), ("节拍", "beats")),
    "dialogue_samples": (("场景", "scene_type"), ("对话", "original_text"), ("情绪张力", "emotional_tension"), ("潜台词", "subtext"), ("剧情作用", "plot_function"), ("剧情上下文?", "context_summary")),
    "description_samples": (("类型", "description_type"), ("描写", "original_text"), ("技法", "technique_analysis"), ("感官", "sensory_details"), ("剧情上下文?", "context_summary")),
    "transition_samples": (("转场类型", "transition_type"), ("原文", "original_text"), ("技法", "technique_analysis"), ("剧情上下文?", "context_summary")),
    "action_scene_samples": (("动作类型", "action_type"), ("原文", "original_text"), ("技法", "technique_analysis"), ("节奏", "pacing_analysis"), ("剧情上下文?", "context_summary")),
    "climax_excerpts": (("高潮类型", "excerpt_type"), ("原文", "original_text"), ("技法", "technique_analysis"), ("情感冲击", "emotional_impact"), ("剧情上下文?", "context_summary")),
    "memorable_quotes": (("金句", "quote_text"), ("上下文", "context"), ("技法", "technique_analysis"), ("类型", "quote_type"), ("剧情上下文?", "context_summary")),
    "character_speech_style": (("人物", "character_name"), ("口头禅", "catchphrases"), ("词汇偏好", "vocabulary_preference"), ("句式偏好", "sentence_pattern"), ("对话样本", "dialogue_samples")),
    "story_events": (("事件", "event_name"), ("摘要", "event_summary"), ("类型", "event_type"), ("角色", "characters"), ("重要性", "significance")),
    "event_causal_edges": (("因", "source_name"), ("果", "target_name"), ("关系", "relation_type"), ("详情", "relation_detail")),
}


def documents(rows: DataFrame, table: str, summaries: DataFrame | None = None, most: int = 150) -> DataFrame:
    """``rows`` of a table with the ``document`` that is embedded for them. JSON lists of strings are told line by
    line (beats) or joined; the summary of the row's chapter (cut to ``most``) stands below, where there is one."""
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    more = {"beats": lambda: F.concat(F.lit("\n"), F.array_join(F.transform(listed("beats_json"), lambda b: F.concat(F.lit("- "), b)), "\n")), "dialogue_samples": lambda: F.array_join(listed("dialogue_samples_json"), "|"), "characters": lambda: F.array_join(listed("characters_involved"), ",")}
    out = rows
    if summaries is not None and any(c == "context_summary" for _, c in TEMPLATES[table]):
        short = F.when(F.length("summary") > most, F.concat(F.substring("summary", 1, most), F.lit("..."))).otherwise(F.col("summary"))
        out = rows.join(summaries.select("book_name", "chapter_id", short.alias("context_summary")), ["book_name", "chapter_id"], "left")
    parts = []
    for label, column in TEMPLATES[table]:
        known = column in out.columns or column in more
        value = F.coalesce((more[column]() if column in more and column not in out.columns else F.col(column)).cast("string"), F.lit("")) if known else F.lit("")
        line = F.concat(F.lit(f"{label.rstrip('?')}:"), value)
        parts.append(F.when(value != "", line) if label.endswith("?") else line)
    return out.withColumn("document", F.concat_ws("\n", *parts)).select(*rows.columns, "document")


#: What a kind of document, and a stage of writing, asks: collections of vectors, tables, further tables.
DOCUMENT_TYPES = {
    "world": (("world_settings_kb",), ("world_settings", "world_timeline"), ("faction_networks", "setting_evolutions")),
    "character": (("character_profiles_kb", "character_speech_style_kb"), ("character_profiles",), ("character_behavior_marks", "character_relationship_dynamics")),
    "outline": (("macro_outlines_kb",), ("macro_outlines", "plot_foreshadowing"), ("climax_buildup_chains", "conflict_escalation")),
    "chapter": (("novel_skills", "dialogue_samples_kb"), ("dialogue_samples", "description_samples"), ("skills", "technique_combinations")),
}
WRITING_STAGES = {
    "world_building": (("world_settings_kb",), ("world_settings", "world_timeline")),
    "character_design": (("character_profiles_kb",), ("character_profiles", "character_speech_style")),
    "outlining": (("macro_outlines_kb",), ("macro_outlines", "plot_lines")),
    "chapter_outlining": (("macro_outlines_kb", "story_events_kb"), ("chapter_functions", "plot_foreshadowing")),
    "writing": (("novel_skills", "dialogue_samples_kb"), ("dialogue_samples", "description_samples")),
    "polishing": (("classic_excerpts", "sensory_details"), ("sensory_mappings", "common_mistakes")),
}


def query_text(content: Column, needs: Column, most: int) -> Column:
    """What is embedded for a request: its needs, then the head of its content."""
    return F.trim(F.concat_ws(" ", F.nullif(F.trim(needs), F.lit("")), F.substring(content, 1, most)))


def _of_genre(rows: DataFrame, genre: str) -> DataFrame:
    return like(rows, "category", genre) if "category" in rows.columns else rows


def _listed(tables: Mapping[str, DataFrame], names: Sequence[str], genre: str, most: int) -> DataFrame | None:
    """``(origin, id, n)``: the first rows by id of each of the tables that there are."""
    parts = [page(_of_genre(tables[t], genre), ["id"], most).select(F.lit(t).alias("origin"), F.col("id").cast("string").alias("id"), F.lit(i).alias("n")) for i, t in enumerate(names) if t in tables]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _numbered(rows: DataFrame, part: str, order: Sequence[str], most: int) -> DataFrame:
    """One part of an answer, in order and cut: it holds a page of rows, so one window over all is fine."""
    w = Window.orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(F.lit(part).alias("part"), "origin", "id", "place")


def enhance(hits: DataFrame, tables: Mapping[str, DataFrame], document_type: str, limit: int = 10, genre: str = "", comparisons: DataFrame | None = None) -> DataFrame:
    """``(part, origin, id, place)``: primary rows (vector ``hits`` of the type's collections by rank, then rows of its
    tables that the hits do not hold), secondary rows (at most ``min(limit // 2, 5)`` a table, ``limit // 2`` in all) and up
    to five cross-book patterns. ``hits`` has collection, id and rank."""
    collections, first, second = DOCUMENT_TYPES[document_type]
    number = F.array_position(F.array(*map(F.lit, collections)), F.col("collection"))
    near = hits.where(F.col("collection").isin(*collections)).where(F.col("rank") <= limit).select(F.col("collection").alias("origin"), F.col("id").cast("string").alias("id"), (number - 100).cast("int").alias("n"), "rank")
    rows = _listed(tables, first, genre, limit)
    primary = near if rows is None else near.unionByName(rows.join(near.select("id"), "id", "left_anti").withColumn("rank", F.lit(None).cast("int")))
    parts = [_numbered(primary, "primary", ["n", "rank", "id"], limit)]
    more = _listed(tables, second, genre, min(limit // 2, 5))
    if more is not None:
        parts.append(_numbered(more, "secondary", ["n", "id"], limit // 2))
    if comparisons is not None:
        parts.append(_numbered(comparisons.select(F.lit("cross_book_comparisons").alias("origin"), F.col("id").cast("string").alias("id")), "patterns", ["id"], 5))
    return reduce(DataFrame.unionByName, parts)


def context_search(hits: DataFrame, tables: Mapping[str, DataFrame], stage: str, limit: int = 10, genre: str = "") -> DataFrame:
    """``(part, origin, id, place)``: what a stage of writing asks: vector hits of its collections, then rows of its tables
    (at most ``min(limit // 2, 5)`` a table), each cut to ``limit``."""
    collections, names = WRITING_STAGES[stage]
    number = F.array_position(F.array(*map(F.lit, collections)), F.col("collection")).cast("int")
    near = hits.where(F.col("collection").isin(*collections)).where(F.col("rank") <= limit).select(F.col("collection").alias("origin"), F.col("id").cast("string").alias("id"), number.alias("n"), "rank")
    vectors = _numbered(near, "vectors", ["n", "rank", "id"], limit)
    rows = _listed(tables, names, genre, min(limit // 2, 5))
    return vectors if rows is None else vectors.unionByName(_numbered(rows, "structured", ["n", "id"], limit))


#: Which lookups a writing context gets. The first rule that holds counts: stages, whether a
#: stage or a sub type is enough, sub types (none: any), then (bucket, table, field, term); a term is a
#: fixed word, the context's elements, or its mood.
ELEMENTS, MOOD = "{elements}", "{mood}"
LOOKUPS = (
    (("世界观设计",), True, ("力量体系设计", "社会结构设计", "地理设计"), (("excerpts", "world_settings", "query", ELEMENTS), ("structure_tips", "cross_book_comparisons", "dimension", "世界观设计"))),
    (("人物设计",), True, ("角色对话", "人物塑造", "关系设计"), (("excerpts", "dialogue_samples", "query", ELEMENTS), ("techniques", "character_speech_style", "query", ELEMENTS), ("structure_tips", "cross_book_comparisons", "dimension", "人物塑造"), ("common_mistakes", "common_mistakes", "dimension", "人物"))),
    (("大纲设计",), True, ("大纲设计", "结构设计", "情节编排"), (("structure_tips", "macro_outlines", "query", ELEMENTS), ("techniques", "climax_buildup_chains", "query", ELEMENTS), ("common_mistakes", "common_mistakes", "dimension", "情节"))),
    (("正文写作", "修改打磨"), False, ("打斗场景", "动作场景", "战斗描写"), (("excerpts", "action_scene_samples", "query", ELEMENTS), ("excerpts", "climax_excerpts", "type", "打斗"), ("techniques", "technique_combinations", "scene_type", "打斗"), ("common_mistakes", "common_mistakes", "dimension", "节奏"))),
    (("正文写作", "修改打磨"), False, ("感情线对话", "暧昧对话", "情感对话"), (("excerpts", "dialogue_samples", "scene_type", "感情"), ("techniques", "technique_combinations", "scene_type", "对话"), ("common_mistakes", "common_mistakes", "dimension", "对话"))),
    (("正文写作", "修改打磨"), False, ("环境描写", "氛围描写", "场景描写"), (("excerpts", "description_samples", "query", ELEMENTS), ("techniques", "sensory_mappings", "query", MOOD), ("common_mistakes", "common_mistakes", "dimension", "描写"))),
    (("正文写作", "修改打磨"), False, ("高潮铺垫", "高潮场景", "决战", "揭秘"), (("excerpts", "climax_excerpts", "query", ELEMENTS), ("techniques", "climax_buildup_chains", "query", ELEMENTS), ("techniques", "technique_combinations", "scene_type", "高潮"), ("common_mistakes", "common_mistakes", "dimension", "节奏"))),
    (("正文写作", "修改打磨"), False, ("悬疑场景", "推理场景", "线索揭露"), (("techniques", "information_management", "query", ELEMENTS), ("common_mistakes", "common_mistakes", "dimension", "情节"))),
    (("正文写作", "修改打磨"), False, (), (("excerpts", "dialogue_samples", "query", ELEMENTS), ("excerpts", "description_samples", "query", ELEMENTS), ("techniques", "skills", "query", ELEMENTS), ("common_mistakes", "common_mistakes", "dimension", "对话"), ("common_mistakes", "common_mistakes", "dimension", "描写"))),
)


def lookups(contexts: DataFrame) -> DataFrame:
    """Contexts (context_id, stage, sub_type, mood, elements) to the lookups of the first rule that holds."""
    words = {ELEMENTS: F.array_join("elements", " "), MOOD: F.coalesce("mood", F.lit(""))}
    chosen = None
    for stages, either, subs, entries in LOOKUPS:
        stage, sub = F.col("stage").isin(*stages), F.coalesce(F.col("sub_type").isin(*subs), F.lit(False)) if subs else F.lit(True)
        rows = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(t).alias("table_name"), F.lit(f).alias("field"), words.get(w, F.lit(w)).alias("term")) for b, t, f, w in entries))
        holds = (stage | sub) if either else (stage & sub)
        chosen = F.when(holds, rows) if chosen is None else chosen.when(holds, rows)
    return contexts.select("context_id", F.inline(chosen))
