"""Saved queries of the read API: each is a filter, an order and a page over one table of the knowledge base."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S
from .ingest import KINDS


@dataclass(frozen=True)
class View:
    """``text``: columns that the parameter ``query`` looks in. ``like``: parameters that look in a column each (or, as
    ``name: (columns)``, in several). ``equal``: parameters that filter by equality. ``order``: columns, ``-`` before those
    that go down; ``#column`` is the number in it. Every order ends in the id."""

    table: str
    text: tuple[str, ...] = ()
    like: tuple[str, ...] | Mapping[str, tuple[str, ...]] = ()
    equal: tuple[str, ...] = ("book_name",)
    order: tuple[str, ...] = ("id",)
    where: str = ""

    @property
    def parameters(self) -> dict[str, tuple[str, ...]]:
        return dict(self.like) if isinstance(self.like, Mapping) else {c: (c,) for c in self.like}


VIEWS: dict[str, View] = {
    "worldbuilding_settings": View("world_settings", ("entity", "content"), ("module", "tags")),
    "worldbuilding_timeline": View("world_timeline", order=("era_or_year", "id")),
    "worldbuilding_search": View("world_settings", ("module", "entity", "content")),
    "worldbuilding_conflicts": View("conflict_escalation"),
    "worldbuilding_factions": View("faction_networks"),
    "worldbuilding_setting_evolutions": View("setting_evolutions", like=("setting_module",)),
    "character_profile": View("character_profiles", ("name", "personality"), {"character_name": ("name",), "role_type": ("role_type",)}),
    "character_speech_style": View("character_speech_style", like=("character_name",)),
    "character_behavior": View("character_behavior_marks", like=("character_name",)),
    "character_relationship": View("character_relationship_dynamics", like={"character_a": ("character_a", "character_b"), "character_b": ("character_a", "character_b")}),
    "character_search": View("character_profiles", ("name", "role_type", "personality")),
    "plot_subplots": View("plot_lines", where="line_type <> 'main'"),
    "plot_foreshadowing": View("plot_foreshadowing", equal=("book_name", "status")),
    "plot_chapter_functions": View("chapter_functions", equal=("book_name", "function_type")),
    "plot_volume_outlines": View("macro_outlines", order=("volume_index", "id")),
    "plot_revelation_pacing": View("revelation_pacing"),
    "plot_emotion_transitions": View("emotion_transition_patterns"),
    "plot_information_management": View("information_management"),
    "plot_climax_buildup": View("climax_buildup_chains"),
    "plot_conflict_escalation": View("conflict_escalation"),
    "style_fingerprint": View("author_fingerprints", ("narrative_perspective",)),
    "style_sensory": View("sensory_mappings", like=("emotion",)),
    "style_dialogue_samples": View("dialogue_samples", ("original_text",), ("scene_type",), order=("writing_quality", "id")),
    "style_description_samples": View("description_samples", ("original_text",), ("description_type",)),
    "style_skills": View("skills", like=("scene_type", "skill_name")),
    "style_transitions": View("transition_samples", like=("transition_type",)),
    "style_summaries": View("style_summaries", equal=("book_name", "summary_type")),
    "style_statistics": View("book_statistics", order=("book_name",)),
    "style_narrative_distance": View("narrative_distance", like=("distance_type",)),
    "style_show_tell": View("show_tell_patterns", like=("pattern_type",)),
    "excerpt_search": View("classic_excerpts", ("style_tag", "excerpt_text")),
    "excerpt_dialogue": View("dialogue_samples", ("original_text",), ("scene_type",)),
    "excerpt_description": View("description_samples", ("original_text",), ("description_type",)),
    "excerpt_classic": View("classic_excerpts", ("excerpt_text",), ("style_tag",)),
    "search_climax": View("climax_excerpts", ("original_text",), ("excerpt_type",)),
    "search_quotes": View("memorable_quotes", ("quote_text",), ("quote_type",)),
    "search_style": View("author_fingerprints", ("sentence_rhythm", "imagery")),
    "search_plot": View("plot_lines", ("theme", "line_type")),
    "review": View("chapter_reviews", equal=("project_name", "chapter_index")),
    "recommend": View("kb_references", equal=("project_name",)),
    "compare": View("cross_book_comparisons", ("best_practices",), ("comparison_dimension",), ()),
    "mistakes": View("common_mistakes", (), ("dimension", "mistake_name"), (), ("-frequency", "id")),
    "combos": View("technique_combinations", (), ("scene_type", "combo_name"), ()),
    "plot_line_nodes": View("plot_lines", equal=("book_name", "line_type")),
    "events": View("story_events", equal=("book_name", "event_type", "significance"), order=("#chapter_id", "chapter_id", "id")),
}


def _order(column: str) -> Column:
    if column.startswith("-"):
        return F.col(column[1:]).desc_nulls_last()
    return T.chapter_number(column[1:], 99999).asc() if column.startswith("#") else F.col(column).asc_nulls_last()


def view(tables: Mapping[str, DataFrame], name: str, query: str = "", limit: int = 50, offset: int = 0, chapter_range: str = "", **given: object) -> DataFrame:
    """One saved query; parameters that the view does not know are an error, blank ones do not filter.

    ``chapter_range`` (``a-b``) keeps rows whose chapter id holds a number in it; only views with chapters know it. A
    range that is none does not filter.
    """
    v = VIEWS[name]
    likes, rows = v.parameters, tables[v.table]
    unknown = set(given) - set(v.equal) - set(likes)
    if unknown or (query and not v.text) or (chapter_range and "#chapter_id" not in v.order):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown)) or ('query' if query else 'chapter_range')}")
    rows = S.equals(rows, **{k: x for k, x in given.items() if k in v.equal})
    for parameter, columns in likes.items():
        rows = S.like(rows, columns, str(given.get(parameter) or ""))
    rows = S.like(rows, v.text, query) if v.text else rows
    if re.fullmatch(r"\s*\d+\s*-\s*\d+\s*", chapter_range):
        a, b = map(int, chapter_range.split("-"))
        rows = rows.where(T.chapter_number("chapter_id", -1).between(a, b))
    return S.page(rows.where(v.where) if v.where else rows, [_order(c) for c in v.order], limit, offset)


def by_book(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each book in every table."""
    from .upsert import counts_by_book

    return counts_by_book(dict(tables))


def books(metadata: DataFrame, category: str = "", genre_tag: str = "", author: str = "", limit: int = 50) -> DataFrame:
    """The books added last, by parts of their category, tags and author."""
    rows = S.like(S.like(S.like(metadata, "category", category), "genre_tags", genre_tag), "author", author)
    return S.page(rows, [F.desc_nulls_last("added_at"), "book_name"], limit)


def patterns(comparisons: DataFrame, combinations: DataFrame, pattern_type: str = "", genre: str = "", most: int = 10) -> DataFrame:
    """``(origin, id, name)``: cross-book findings on a dimension, the newest first, then technique combinations whose scene
    or name holds it, each and in all cut to ``most``; ``genre`` looks in the books of a finding. Ids break ties."""
    a = S.like(S.like(comparisons, "comparison_dimension", pattern_type), "books_analyzed", genre)
    a = S.page(a, [F.desc_nulls_last("created_at"), "id"], most).select(F.lit(0).alias("n"), F.col("created_at").cast("string").alias("at"), "id", F.col("comparison_dimension").alias("name"))
    b = S.page(S.like(combinations, ["scene_type", "combo_name"], pattern_type), ["id"], most)
    b = b.select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("at"), "id", F.col("combo_name").alias("name"))
    rows = S.page(a.unionByName(b), ["n", F.desc_nulls_last("at"), "id"], most)
    return rows.select(F.when(F.col("n") == 0, "comparison").otherwise("combination").alias("origin"), "id", "name")


def style_summaries(dialogues: DataFrame, descriptions: DataFrame, transitions: DataFrame, least: int = 2, first: int = 3) -> DataFrame:
    """``(id, book_name, category, summary_type, scene_or_desc_type, style_description, key_features)`` from the samples of each
    book: per scene and per kind of description, and one row for the transitions of a book, where there are ``least``.

    The first tensions and techniques are those of the first samples by chapter and id (in each task only these are kept);
    the types of transitions, which have no order of their own, stand by name.
    """

    def grouped(rows: DataFrame, kind: str, value: str) -> DataFrame:
        rows = rows.withColumn("_kind", F.coalesce(F.col(kind), F.lit("未知")) if kind else F.lit("转场"))
        rows = rows if "category" in rows.columns else rows.withColumn("category", F.lit(""))
        keys = ["book_name", "_kind"]
        w = Window.partitionBy(*keys).orderBy(T.chapter_number("chapter_id", 99999), "id")
        told = rows.where(F.col(value) != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
        told = told.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]), "、").alias("_told"))
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_size"), F.floor(F.avg(F.length("original_text"))).alias("_chars"), F.max("category").alias("category"))
        return counts.where(F.col("_size") >= least).join(told, keys, "left").withColumn("_told", F.coalesce("_told", F.lit("")))

    def rows(part: DataFrame, name: str, text: Column) -> DataFrame:
        return part.select(
            T.key("book_name", F.lit(name), "_kind").alias("id"), "book_name", "category", F.lit(name).alias("summary_type"),
            F.col("_kind").alias("scene_or_desc_type"), text.alias("style_description"), F.concat(F.lit("样本数:"), F.col("_size")).alias("key_features"),
        )

    lead = lambda middle: F.concat(F.lit("本书的"), F.col("_kind"), F.lit(middle), F.col("_chars"), F.lit("字，"))
    more = lambda words: F.when(F.col("_told") != "", F.concat(F.lit(words), F.col("_told"))).otherwise("")
    w = Window.partitionBy("book_name").orderBy(T.chapter_number("chapter_id", 99999), "id")
    kinds = transitions.where("transition_type <> ''").withColumn("_n", F.row_number().over(w)).where("_n <= 5")
    kinds = kinds.groupBy("book_name").agg(F.array_join(F.array_sort(F.collect_set("transition_type")), "、").alias("_kinds"))
    turns = grouped(transitions, "", "technique_analysis").join(kinds, "book_name", "left")
    parts = (
        rows(grouped(dialogues, "scene_type", "emotional_tension"), "dialogue", F.concat(lead("对话特点：平均长度"), more("情绪张力类型包括："))),
        rows(grouped(descriptions, "description_type", "technique_analysis"), "description", F.concat(lead("描写特点：平均长度"), more("常用技法："))),
        rows(turns, "transition", F.concat(F.lit("本书的转场手法：常用类型包括"), F.coalesce("_kinds", F.lit("")), F.lit("，"), more("技法特点："))),
    )
    return reduce(DataFrame.unionByName, parts)


#: The dimension that a collection of vectors belongs to in a search over all of them.
DIMENSIONS = {
    "novel_skills": "技法", "sensory_details": "感官", "classic_excerpts": "经典片段", "world_settings_kb": "世界观", "character_profiles_kb": "人物", "macro_outlines_kb": "大纲",
    "dialogue_samples_kb": "对话", "description_samples_kb": "描写", "transition_samples_kb": "转场", "action_scene_samples_kb": "动作", "climax_excerpts_kb": "高潮", "memorable_quotes_kb": "金句",
    "character_speech_style_kb": "语言风格", "technique_combinations_kb": "技法组合", "story_events_kb": "事件", "event_causal_edges_kb": "因果",
}


def comprehensive(hits: DataFrame, dimensions: Mapping[str, str] = DIMENSIONS, most: int = 5) -> DataFrame:
    """``(dimension, place, collection, id, distance)``: vector hits (collection, id, distance) of all collections by dimension, the
    ``most`` nearest of each; hits of a collection without a dimension are left out, ties go to the smaller id."""
    names = F.create_map(*(F.lit(x) for kv in dimensions.items() for x in kv))
    rows = hits.withColumn("dimension", F.try_element_at(names, F.col("collection"))).where("dimension is not null")
    w = Window.partitionBy("dimension").orderBy("distance", "id", "collection")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("dimension", "place", "collection", "id", "distance")


#: Tables that are computed from others, not ingested.
COMPUTED = {"style_summaries", "book_statistics"}
assert {v.table for v in VIEWS.values()} <= set(KINDS) | COMPUTED
