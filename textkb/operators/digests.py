"""Texts told from the tables of the knowledge base: by dimension and book, by kind of scene, for a review, for a recommendation.

Each table is cut to the few rows of a book (or scene) that are told before anything is joined or collected, in
every task first. Rows that the tables hold in no order are told by id. Missing values are empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relate import ordered

#: What each dimension tells of a book: its table, how many rows, and the parts of a line. A part is a label and
#: a column; ``#`` counts the steps of a JSON list, ``:n`` cuts a text; the separator stands between the parts.
LINES: dict[str, tuple[str, int, str, tuple[tuple[str, str, str], ...]]] = {
    "高潮铺垫方式": ("climax_buildup_chains", 5, " | ", (("高潮: ", "climax_name", ""), ("(第", "climax_chapter", "章)"), ("铺垫步骤: ", "#buildup_steps_json", "步"), ("张力升级: ", "tension_escalation", ""))),
    "冲突升级模式": ("conflict_escalation", 5, " | ", (("冲突线: ", "conflict_line", ""), ("升级步骤: ", "#escalation_steps_json", "步"), ("升级模式: ", "escalation_pattern", ""))),
    "人物塑造": ("character_profiles", 5, " | ", (("角色: ", "name", ""), ("(", "role_type", ")"))),
    "世界观设计": ("world_settings", 10, " - ", (("", "module", ""), (":", "entity", ""), ("", "content:100", ""))),
    "对话风格": ("character_speech_style", 5, " | ", (("角色: ", "character_name", ""), ("口头禅: ", "catchphrases", ""), ("词汇偏好: ", "vocabulary_preference", ""), ("句式: ", "sentence_pattern", ""))),
    "描写技法": ("description_samples", 5, " | ", (("类型: ", "description_type", ""), ("技法: ", "technique_analysis", ""), ("感官: ", "sensory_details", ""))),
    "信息管理": ("information_management", 5, " | ", (("策略: ", "strategy_type", ""), ("目标信息: ", "target_info", ""), ("隐瞒方式: ", "conceal_method", ""), ("揭露时机: ", "reveal_timing", ""), ("戏剧目的: ", "dramatic_purpose", ""))),
    "伏笔设计": ("plot_foreshadowing", 5, " | ", (("伏笔: ", "hook_name", ""), ("埋设: 第", "planted_chapter", "章"), ("计划回收: ", "planned_payoff", ""), ("状态: ", "status", ""))),
}
#: Parts that follow the one before without a separator (a space before the bracket of a chapter or role).
_CLOSE = {"(第": " ", "(": " ", ":": ""}
#: Dimensions whose tables are gone, and what is told instead.
RETIRED = {"感情线设计": "感情线: 数据已废弃", "结构编排": "结构: 数据已废弃"}
#: Kinds of scenes, and those that chains of buildup, dialogues, descriptions and actions belong to.
SCENES = ("打斗", "对话", "描写", "高潮", "转折", "揭秘")
BUILDUP_SCENES = ("打斗", "高潮", "转折", "揭秘")


def _value(column: str) -> Column:
    if column.startswith("#"):
        return F.coalesce(F.json_array_length(column[1:]), F.lit(0)).cast("string")
    name, _, cut = column.partition(":")
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.substring(text, 1, int(cut)) if cut else text


def _first(rows: DataFrame, keys: Sequence[str], most: int, order: Sequence[Column | str] = ("id",)) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)


def _told(rows: DataFrame, line: Column, most: int, name: str, separator: str = "\n", order: Sequence[Column | str] = ("id",)) -> DataFrame:
    """One text of the first rows of each book."""
    kept = _first(rows, ["book_name"], most, order).select("book_name", "_n", line.alias("_line"))
    return kept.groupBy("book_name").agg(F.array_join(ordered("_line", "_n"), separator).alias(name))


def dimension_digests(tables: Mapping[str, DataFrame], books: DataFrame, dimensions: Sequence[str] = (*LINES, *RETIRED)) -> DataFrame:
    """``(dimension, book_name, digest)`` of the given books (``book_name``) in each dimension where they have data.

    Retired dimensions say so for every book; a dimension that is not known tells the book's metadata (table
    ``book_metadata``). A book that ``books`` repeats is told once.
    """
    wanted, parts = books.select("book_name").distinct(), []
    for d in dimensions:
        if d in RETIRED:
            parts.append(wanted.select(F.lit(d).alias("dimension"), "book_name", F.lit(RETIRED[d]).alias("digest")))
            continue
        if d in LINES:
            table, most, separator, fields = LINES[d]
            pieces = []
            for label, column, end in fields:
                close = _CLOSE.get(label) if pieces else ""
                between = separator if close is None else close
                pieces += [F.lit((between if pieces else "") + label), _value(column), F.lit(end)]
            told = _told(tables[table], F.concat(*pieces), most, "digest")
        else:
            labels = (("分类: ", "category"), ("标签: ", "genre_tags"), ("总章数: ", "total_chapters"), ("简介: ", "description:100"))
            told = _told(tables["book_metadata"], F.concat_ws(" | ", *(F.concat(F.lit(a), _value(c)) for a, c in labels)), 1, "digest", order=("book_name",))
        parts.append(told.join(wanted, "book_name", "left_semi").select(F.lit(d).alias("dimension"), "book_name", "digest"))
    return reduce(DataFrame.unionByName, parts)


def scene_evidence(tables: Mapping[str, DataFrame], scenes: Sequence[str] = SCENES, most: int = 10, used: int = 20) -> DataFrame:
    """``(scene_type, place, type, book_name, name, text, analysis, more)``: the evidence for each kind of scene.

    Up to ``most`` rows of each of six sources, in this order: chains of buildup (for four kinds), excerpts whose type
    names the scene, dialogues, descriptions and actions (each for its own kind), and skills of the scene; the first
    ``used`` in all. Texts are cut to 300 characters, examples of skills to 200. Every source is read once for all kinds.
    """
    none = F.lit("")
    given = lambda c: F.coalesce(F.col(c).cast("string"), none)
    all_of = F.array(*map(F.lit, scenes))

    def named(column: str, among: Sequence[str] = tuple(scenes)) -> Column:
        return F.filter(F.array(*(F.lit(s) for s in scenes if s in among)) if set(scenes) & set(among) else F.slice(all_of, 1, 0), lambda s: F.contains(F.col(column), s))

    only = lambda scene: F.filter(all_of, lambda s: s == scene)
    cut = lambda c, n: F.substring(given(c), 1, n)
    steps = F.coalesce(F.json_array_length("buildup_steps_json"), F.lit(0)).cast("string")
    sources = (
        ("buildup_chain", "climax_buildup_chains", named("climax_name", BUILDUP_SCENES), given("climax_name"), given("buildup_steps_json"), given("tension_escalation"), steps),
        ("excerpt", "climax_excerpts", named("excerpt_type"), given("excerpt_type"), cut("original_text", 300), given("technique_analysis"), none),
        ("dialogue", "dialogue_samples", only("对话"), given("scene_type"), cut("original_text", 300), given("subtext"), given("plot_function")),
        ("description", "description_samples", only("描写"), given("description_type"), cut("original_text", 300), given("technique_analysis"), given("sensory_details")),
        ("action", "action_scene_samples", only("打斗"), given("action_type"), cut("original_text", 300), given("technique_analysis"), given("pacing_analysis")),
        ("skill", "skills", named("scene_type"), given("skill_name"), cut("original_example", 200), given("analysis"), none),
    )
    parts = []
    for n, (kind, table, of, name, text, analysis, more) in enumerate(sources):
        rows = tables[table].select(
            F.explode(of).alias("_scene"), "id", "book_name", F.lit(n).alias("_source"), F.lit(kind).alias("type"),
            name.alias("name"), text.alias("text"), analysis.alias("analysis"), more.alias("more"),
        )
        parts.append(_first(rows, ["_scene"], most))
    rows = _first(reduce(DataFrame.unionByName, parts).drop("_n"), ["_scene"], used, ("_source", "id"))
    return rows.select(F.col("_scene").alias("scene_type"), F.col("_n").alias("place"), "type", "book_name", "name", "text", "analysis", "more")


def review_pack(tables: Mapping[str, DataFrame], books: DataFrame) -> DataFrame:
    """``(book_name, pack)``: three dialogues, three descriptions and two narrative distances of each benchmark book with any."""
    line = lambda a, x, b, y, c, z: F.concat(F.lit(f"  {a}:"), _value(x), F.lit(f" | {b}:"), _value(y), F.lit(f"\n  {c}:"), _value(z))
    parts = {
        "【对话样本】": _told(tables["dialogue_samples"], line("场景", "scene_type", "张力", "emotional_tension", "原文", "original_text:200"), 3, "_0"),
        "【描写样本】": _told(tables["description_samples"], line("类型", "description_type", "技法", "technique_analysis", "原文", "original_text:200"), 3, "_1"),
        "【叙事距离控制】": _told(tables["narrative_distance"], line("距离", "distance_type", "触发", "trigger_reason", "示例", "original_example:150"), 2, "_2"),
    }
    rows, told = books.select("book_name").distinct(), []
    for i, (title, part) in enumerate(parts.items()):
        rows = rows.join(part, "book_name", "left")
        told.append(F.concat(F.lit(f"{title}\n"), F.col(f"_{i}")))
    head = F.concat(F.lit("\n===== 标杆作品《"), F.col("book_name"), F.lit("》====="))
    return rows.where("coalesce(_0, _1, _2) is not null").select("book_name", F.concat_ws("\n", head, *told).alias("pack"))


def recommendation_digest(metadata: DataFrame, settings: DataFrame, profiles: DataFrame, lines: DataFrame) -> DataFrame:
    """``(book_name, digest)`` of every book of ``metadata``: category, five settings, five persons with their roles, the main line."""
    books = metadata.where("book_name <> ''").groupBy("book_name").agg(F.min("category").alias("_category"))
    parts = {
        "世界观: ": _told(settings, F.concat(_value("module"), F.lit(":"), _value("entity")), 5, "_0", ", "),
        "人物: ": _told(profiles, F.concat(_value("name"), F.lit("("), _value("role_type"), F.lit(")")), 5, "_1", ", "),
        "主线: ": _told(lines.where("line_type = 'main'"), _value("theme"), 1, "_2"),
    }
    told = [F.concat(F.lit("分类: "), F.coalesce("_category", F.lit("未知")))]
    for i, (title, part) in enumerate(parts.items()):
        books = books.join(part, "book_name", "left")
        told.append(F.concat(F.lit(title), F.col(f"_{i}")))
    return books.select("book_name", F.concat(F.lit("【《"), F.col("book_name"), F.lit("》】\n"), F.concat_ws("\n", *told)).alias("digest"))
