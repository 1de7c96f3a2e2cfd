"""Extraction responses (JSON text) to typed, keyed rows: one generic operator and a table of kinds."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as _field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def json_part(response: Column | str) -> Column:
    """From the first opening to the last closing brace: fences and prose around the object fall away."""
    return F.nullif(F.regexp_extract(T.col(response), r"(?s)\{.*\}", 0), F.lit(""))


def parsed(responses: DataFrame, schema: str, column: str = "response") -> DataFrame:
    """Adds ``parsed``: the struct, or null where the text holds no valid JSON object."""
    return responses.withColumn("parsed", F.try_variant_get(F.try_parse_json(json_part(column)), "$", schema))


def rejects(responses: DataFrame, column: str = "response") -> DataFrame:
    """The responses that hold no valid JSON object."""
    return responses.where(F.try_parse_json(json_part(column)).isNull())


#: The type that a field is read as.
READ = {"text": "string", "int": "int", "double": "double", "json": "variant", "bar": "array<string>", "comma": "array<string>"}


@dataclass(frozen=True)
class Field:
    """Where a column comes from: ``name`` in the item, ``$.name`` in the response, ``@name`` beside it.

    ``how``: text (JSON text for anything nested), int, double, json (JSON text), bar or comma (a list of
    strings joined by that). ``default`` stands for what is missing or blank.
    """

    source: str
    how: str = "text"
    default: object = ""


def _fields(*specs: str) -> dict[str, Field]:
    """``name=source#how?default``, all but the name optional. A name with ``_`` in front is only for others to use."""
    out = {}
    empty = {"text": "", "bar": "", "comma": "", "json": "[]", "int": None, "double": None, "array": None}
    for spec in specs:
        name, source, how, default = re.fullmatch(r"(\w+)(?:=([@$.\w]+))?(?:#(\w+))?(?:\?(.*))?", spec).groups()
        how = how or "text"
        value = empty[how] if default is None else {"int": int, "double": float}.get(how, str)(default)
        out[name] = Field(source or name, how, value)
    return out


@dataclass(frozen=True)
class Kind:
    """How one kind of response becomes rows of a table.

    ``path``: the list of items in the response, with ``one`` a single object ('': the response itself);
    ``required`` columns must not be blank and ``where`` must hold; ``derive`` adds columns (SQL or a
    function) from the others; ``key`` makes the id; ``first``: the first row of a key wins (else the last).
    """

    table: str
    path: str
    fields: dict[str, Field]
    required: tuple[str, ...] = ()
    key: tuple[str, ...] = ("book_name", "chapter_id")
    derive: dict[str, str | Callable[[], Column]] = _field(default_factory=dict)
    where: str = "true"
    one: bool = False
    first: bool = False
    limit_one_per_book: bool = False

    @cached_property
    def context(self) -> list[str]:
        """Columns that must stand beside the response."""
        return list(dict.fromkeys(f.source[1:] for f in self.fields.values() if f.source.startswith("@")))

    @cached_property
    def read(self) -> dict[str, str]:
        """The names in an item and the types that they are read as; a name is read once."""
        out = {f.source: READ[f.how] for f in self.fields.values() if f.source[0] not in "@$"}
        if any(out[f.source] != READ[f.how] for f in self.fields.values() if f.source in out):
            raise ValueError(f"{self.table} reads a name as two types")
        return out

    @cached_property
    def columns(self) -> list[str]:
        return [c for c in (*self.fields, *self.derive) if not c.startswith("_")]


def _value(name: str, f: Field) -> Column:
    if f.source.startswith("@"):
        got = F.col(f"_context.{f.source[1:]}")
        return got if f.how == "array" else F.coalesce(got, F.lit(f.default))
    read = F.try_variant_get("_response", f.source, READ[f.how]) if f.source.startswith("$") else F.col("_item").getField(f.source)
    if f.how in ("int", "double"):
        got = read
    elif f.how == "json":
        got = F.to_json(read)
    elif f.how == "bar":
        got = F.array_join(read, "|")
    elif f.how == "comma":
        got = T.joined_known(read)
    else:
        got = F.nullif(T.strip(read), F.lit(""))
    return got if f.default is None else F.coalesce(got, F.lit(f.default))


def ingest(responses: DataFrame, kind: Kind) -> DataFrame:
    """``(id, book_name, chapter_id, seq, pos, columns..)`` rows of one kind, one for each key.

    ``responses`` has book_name, chapter_id, seq (the order in which later rows win), response and the kind's
    ``context`` columns. Every response is parsed once; items are read one by one, so that one that is no
    object does not spoil the others. Copies of a key are cut to one in each task before the shuffle; columns
    that neither the key nor ``where`` needs are derived for the rows that stay.
    """
    given = F.struct(*(F.col(c) for c in kind.context)) if kind.context else F.lit(None)
    rows = responses.select("book_name", "chapter_id", "seq", given.alias("_context"), F.try_parse_json(json_part("response")).alias("_response"))
    # All fields of an item are read in one walk over it: an item that is no object is null.
    shape = "struct<" + ",".join(f"`{n}`:{t}" for n, t in kind.read.items()) + ">"
    path = f"$.{kind.path}" if kind.path else "$"
    whole = F.try_variant_get("_response", path, shape if kind.one or not kind.path else f"array<{shape}>")
    # Outer: else Spark would filter by the list, and parse each response a second time for that.
    rows = rows.select("*", F.posexplode_outer(F.array(whole) if kind.one or not kind.path else whole).alias("pos", "_item")).where("_item is not null")
    kept = [c for c in ("book_name", "chapter_id", "seq", "pos") if c not in kind.fields]
    early = any(n in kind.key or re.search(rf"\b{n}\b", kind.where) for n in kind.derive)
    # JSON texts of a whole response are written for the rows that stay; items of a list are smaller as columns.
    late = {n: f for n, f in kind.fields.items() if f.how == "json" and not (kind.path or early or n in (*kind.key, *kind.required) or f.source[0] in "@$")}
    rows = rows.select(*kept, *(["_item"] if late else []), *(_value(n, f).alias(n) for n, f in kind.fields.items() if n not in late))
    for f in kind.required:
        rows = rows.where(F.coalesce(F.col(f), F.lit("")) != "")
    rows = (_derived(rows, kind) if early else rows).where(kind.where)
    rows = rows.withColumn("id", F.col("chapter_id") if kind.key == ("chapter_id",) else T.key(*(F.col(k) if k in rows.columns else F.lit(k) for k in kind.key)))
    out = one_per_key(rows, ["id"], ["seq", "pos"], first=kind.first)
    if kind.limit_one_per_book:
        out = one_per_key(out, ["book_name"], ["seq", "pos"], first=True)
    out = out if early else _derived(out.withColumns({n: _value(n, f) for n, f in late.items()}), kind)
    return out.select("id", "book_name", "chapter_id", "seq", "pos", *(c for c in kind.columns if c not in ("book_name", "chapter_id")))


def _derived(rows: DataFrame, kind: Kind) -> DataFrame:
    for name, rule in kind.derive.items():
        rows = rows.withColumn(name, F.expr(rule) if isinstance(rule, str) else rule())
    return rows


def one_per_key(rows: DataFrame, key: list[str], order: list[str], first: bool) -> DataFrame:
    """The first or last row of each key by ``order``. Spark cuts a key's rows to one in each task before the
    shuffle (window group limit), so no key's rows meet in one sort."""
    w = Window.partitionBy(*key).orderBy(*((F.col(c).asc() if first else F.col(c).desc()) for c in order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _sample(table: str, type_: str, *others: str, text: str = "original_text", default: str = "未知", strict: bool = False) -> Kind:
    fields = _fields(f"{type_}?{'' if strict else default}", text, *others, "writing_quality#int?5")
    return Kind(table, table, fields, (type_, text) if strict else (text,), ("book_name", "chapter_id", type_))


def _state_json() -> Column:
    """Flattened character state and the other notes on a chapter as one JSON object."""
    parts = [F.lit('{"character_state":'), F.coalesce(F.to_json(flattened_state("_state")), F.lit("{}"))]
    for name in ("key_events", "scene_transitions", "information_flow", "emotion_arc", "time_progression"):
        parts += [F.lit(f',"{name}":'), F.col(f"_{name}")]
    return F.concat(*parts, F.lit("}"))


def _scores() -> Column:
    """``{dimension: {score, comment}}`` of the dimensions that are objects."""
    entry = "struct<score:double,comment:string>"
    scores = F.map_filter(F.from_json("_scores", "map<string,string>"), lambda k, v: v.rlike(r"^\s*\{"))
    filled = lambda k, v: F.struct(F.coalesce(F.from_json(v, entry)["score"], F.lit(0.0)).alias("score"), F.coalesce(F.from_json(v, entry)["comment"], F.lit("")).alias("comment"))
    return F.coalesce(F.to_json(F.transform_values(scores, filled)), F.lit("{}"))


def _listed(source: str, required: str, **defaults: str) -> Callable[[], Column]:
    """The objects of a JSON list that have ``required``, with exactly the given fields."""

    def column() -> Column:
        objects = F.filter(F.from_json(source, "array<string>"), lambda x: x.startswith("{"))
        typed = F.transform(objects, lambda x: F.from_json(x, "struct<" + ",".join(f"{n}:string" for n in defaults) + ">"))
        kept = F.filter(typed, lambda x: F.coalesce(x[required], F.lit("")) != "")
        return F.coalesce(F.to_json(F.transform(kept, lambda x: F.struct(*(F.coalesce(x[n], F.lit(d)).alias(n) for n, d in defaults.items())))), F.lit("[]"))

    return column


_PROFILE = ("appearance", "quirks", "identity", "motivation", "internal_conflict", "personality", "relation_to_mc?未知", "relations_to_others", "climax_or_fate", "background", "speech_samples", "behavior_samples", "relationship_evolution", "abilities", "internal_dilemma", "transformation_trigger", "contrast_design")

#: Response kinds by table, with the names and defaults of their fields. Keys name columns or, where there is none, literals.
KINDS = {
    k.table: k
    for k in (
        Kind("plot_arcs", "", _fields("category=@category", "summary=chapter_summary", "_state=character_state", "_key_events=key_events#json", "_scene_transitions=scene_transitions#json?{}", "_information_flow=information_flow#json?{}", '_emotion_arc=emotion_arc#json?""', '_time_progression=time_progression#json?""'), key=("chapter_id",), derive={"character_state_json": _state_json}),
        Kind("skills", "narrative_skills", _fields("category=@category", "scene_type=$.scene_type?未知", "skill_name", "analysis", "original_example"), ("skill_name",), ("book_name", "chapter_id", "skill_name"), {"tags": "scene_type || '|' || skill_name"}),
        Kind("author_fingerprints", "author_fingerprint", _fields("category=@category", "verbs=preferred_verbs#comma", "adjectives=preferred_adjectives#comma", "imagery=environmental_imagery#comma", "transitions=signature_transitions#comma", "narrative_perspective", "sentence_rhythm"), key=("book_name", "chapter_id", "fingerprint"), one=True),
        Kind("sensory_mappings", "sensory_mappings", _fields("category=@category", "emotion", "show_not_tell", "analysis"), ("emotion",), ("book_name", "chapter_id", "emotion")),
        Kind("classic_excerpts", "classic_excerpts", _fields("category=@category", "excerpt_text", "scene_type", "style_tag"), ("excerpt_text",), ("book_name", "chapter_id", "style_tag"), {"_garbled": lambda: T.is_mojibake("excerpt_text")}, "NOT _garbled"),
        Kind("world_settings", "world_settings", _fields("author=@author", "category=@category", "module?未知", "entity?未知", "content", "tags#bar"), ("content",), ("book_name", "module", "entity")),
        Kind("world_timeline", "world_timeline", _fields("era_or_year?未知纪元", "event_name", "event_description", "impact"), ("event_name",), ("book_name", "era_or_year", "event_name"), first=True),
        Kind("faction_networks", "faction_networks", _fields("faction_a", "faction_b", "relation_type?未知", "relation_detail", "stability", "key_events"), ("faction_a", "faction_b"), ("book_name", "faction_a", "faction_b")),
        Kind("golden_finger", "golden_finger", _fields("name", "type", "abilities#json", "upgrade_path", "limitations#json", "cost_layers#json", "interaction_with_plot"), ("name",), ("book_name", "golden_finger", "name"), {"source_chapter": "chapter_id"}, "type <> '无'", one=True, first=True, limit_one_per_book=True),
        Kind("character_profiles", "character_profiles", _fields("author=@author", "category=@category", "name", "role_type?未知", *_PROFILE), ("name",), ("book_name", "name", "profile")),
        Kind("macro_outlines", "", _fields("category=@category", "volume_index=@volume_index#int", "chapter_range=@chapter_range", "theme=volume_theme", "conflict=core_conflict", "_beats=plot_beats#json", "arc=character_arc"), ("theme",), ("book_name", "_volume"), {"_volume": "'vol_' || volume_index", "beats_json": "CASE WHEN _beats LIKE '[%' THEN _beats ELSE '[]' END"}),
        Kind("plot_foreshadowing", "foreshadowing", _fields("hook_name", "_action=action?plant", "_range=@chapter_range", "planned_payoff=description", "payoff_timing", "scope_type"), ("hook_name",), ("book_name", "hook_name", "planted_chapter", "resolved_chapter"), {"status": lambda: foreshadowing_status("_action"), "planted_chapter": "CASE WHEN status = 'open' THEN _range ELSE '' END", "resolved_chapter": "CASE WHEN status = 'resolved' THEN _range ELSE '' END", "last_advanced_chapter": "CASE WHEN status = 'advancing' THEN _range ELSE '' END"}),
        Kind("entity_state_tracker", "state_changes", _fields("entity_name", "chapter_range=@chapter_range", "_type=change_type?状态变更", "_detail=change_description"), ("entity_name", "_detail"), ("book_name", "entity_name", "chapter_range"), {"current_state_json": "to_json(named_struct('type', _type, 'detail', _detail))"}, first=True),
        Kind("setting_evolutions", "setting_evolutions", _fields("setting_module", "setting_entity", "chapter_range=@chapter_range", "evolution_type?未知", "before_state", "after_state", "trigger_event"), ("setting_module", "setting_entity"), ("book_name", "setting_module", "setting_entity", "chapter_range")),
        Kind("chapter_functions", "chapter_functions", _fields("chapter_id", "function_type?未知", "pacing_type?未知", "structure_pattern_json=structure_pattern#json?{}", "hook_type?无钩子", "hook_content"), ("chapter_id",), ("book_name", "chapter_id")),
        _sample("dialogue_samples", "scene_type", "emotional_tension", "subtext", "plot_function"),
        _sample("description_samples", "description_type", "technique_analysis", "sensory_details"),
        _sample("transition_samples", "transition_type", "technique_analysis"),
        _sample("narrative_distance", "distance_type", "trigger_reason", text="original_example", strict=True),
        _sample("show_tell_patterns", "pattern_type", "switching_triggers", text="original_example", strict=True),
        _sample("action_scene_samples", "action_type", "technique_analysis", "pacing_analysis", "sensory_details"),
        _sample("climax_excerpts", "excerpt_type", "technique_analysis", "emotional_impact"),
        _sample("memorable_quotes", "quote_type", "context", "technique_analysis", text="quote_text", default=""),
        Kind("character_speech_style", "speech_style", _fields("character_name=@character_name", "catchphrases#bar", "vocabulary_preference", "sentence_pattern", "tone_contexts_json=tone_contexts#json?{}", "dialogue_samples_json=dialogue_samples#json"), key=("book_name", "character_name", "speech"), one=True),
        Kind("character_behavior_marks", "behavior_marks", _fields("character_name=@character_name", "habitual_actions#bar", "micro_expressions#bar", "defense_mechanisms", "behavior_samples_json=behavior_samples#json"), key=("book_name", "character_name", "behavior"), one=True),
        Kind("character_relationship_dynamics", "relationship_dynamics", _fields("character_a=@character_name", "character_b=other_character", "timeline_json=relationship_timeline#json"), ("character_b",), ("book_name", "character_a", "character_b")),
        Kind("plot_lines", "plot_lines", _fields("line_type", "theme", "chapter_distribution", "milestones_json=milestones#json"), ("line_type",), ("book_name", "line_type", "theme")),
        Kind("revelation_pacing", "revelation_pacing", _fields("revelation_name", "reveal_chapter", "reveal_method", "impact"), ("revelation_name",), ("book_name", "revelation_name", "reveal_chapter")),
        Kind("emotion_transition_patterns", "emotion_transition_patterns", _fields("transition_type", "foreshadowing_method"), ("transition_type",), ("book_name", "transition_type")),
        Kind("information_management", "information_management", _fields("strategy_type", "target_info", "conceal_method", "reveal_timing", "dramatic_purpose"), ("strategy_type", "target_info"), ("book_name", "strategy_type", "target_info")),
        Kind("climax_buildup_chains", "climax_buildup_chains", _fields("climax_name", "climax_chapter", "buildup_steps_json=buildup_steps#json", "tension_escalation"), ("climax_name",), ("book_name", "climax_name")),
        Kind("conflict_escalation", "conflict_escalation", _fields("conflict_line", "escalation_steps_json=escalation_steps#json", "escalation_pattern"), ("conflict_line",), ("book_name", "conflict_line")),
        Kind("story_events", "events", _fields("chapter_id", "event_name", "event_summary", "event_type", "characters_involved#json", "significance"), ("event_name",), ("book_name", "chapter_id", "event_name")),
        Kind("event_causal_edges", "causal_edges", _fields("batch=@batch#int", "source=source_index", "target=target_index", "relation_type?未知", "relation_detail"), ("source", "target"), ("book_name", "batch", "source", "target")),
        Kind("chapter_reviews", "", _fields("project_name=@project_name", "chapter_index=@chapter_index#int", "overall_score#double?0", "_scores=dimension_scores#json?{}", "_issues=issues#json", "_suggestions=suggestions#json", "_rewrites=rewrite_samples#json", "benchmark_books=@benchmark_books", "reviewed_at=@reviewed_at"), key=("project_name", "chapter_index", "review"), derive={
            "dimension_scores_json": _scores,
            "issues_json": _listed("_issues", "issue_type", issue_type="", severity="中", location="", description="", original_excerpt=""),
            "suggestions_json": _listed("_suggestions", "suggestion_type", suggestion_type="", priority="中", description="", expected_effect=""),
            "rewrite_samples_json": _listed("_rewrites", "rewritten_text", original_text="", rewritten_text="", rewrite_reason="", technique_applied=""),
        }),
        Kind("kb_references", "recommendations", _fields("project_name=@project_name", "_dimension=dimension", "ref_book", "ref_table", "ref_content=ref_content_summary", "usage_purpose=usage_suggestion"), ("ref_book", "_dimension"), ("project_name", "_dimension", "ref_book", "ref_table"), {"target_type": "'project'", "target_id": "project_name", "ref_id": "''"}),
        Kind("cross_book_comparisons", "", _fields("comparison_dimension=@comparison_dimension", "_books=@books#array", "common_patterns_json=common_patterns#json", "unique_features_json=unique_features#json", "best_practices", "created_at=@created_at"), key=("comparison_dimension", "_joined"), derive={"books_analyzed": lambda: F.to_json("_books"), "_joined": lambda: F.array_join("_books", "_")}),
        Kind("common_mistakes", "mistakes", _fields("dimension", "mistake_name", "typical_manifestation", "frequency#int?0", "correction_direction", "created_at=@created_at"), ("mistake_name",), ("dimension", "mistake_name")),
        Kind("technique_combinations", "combinations", _fields("scene_type=@scene_type", "combo_name", "technique_sequence_json=technique_sequence#json", "technique_roles_json=technique_roles#json", "applicable_scenarios", "variations", "benchmark_book", "original_example", "created_at=@created_at"), ("combo_name",), ("scene_type", "combo_name", "benchmark_book")),
    )
}

#: Which table and column gives the good example for a mistake's dimension.
BENCHMARKS = {"对话": ("dialogue_samples", "original_text"), "描写": ("description_samples", "original_text"), "节奏": ("climax_excerpts", "original_text"), "人物": ("character_profiles", "speech_samples"), "情节": ("climax_buildup_chains", "buildup_steps_json")}


def with_benchmarks(mistakes: DataFrame, tables: dict[str, DataFrame], most: int = 200) -> DataFrame:
    """Mistakes with ``benchmark_example`` (cut) and ``benchmark_book``: the row with the smallest id of the table
    that ``BENCHMARKS`` names for the dimension; blank where there is none."""
    rows = [tables[t].agg(F.min_by(F.struct(F.col(c).alias("x"), "book_name"), "id").alias("b")).select(F.lit(d).alias("dimension"), F.substring("b.x", 1, most).alias("benchmark_example"), F.col("b.book_name").alias("benchmark_book")) for d, (t, c) in BENCHMARKS.items() if t in tables]
    if not rows:
        return mistakes.withColumns({"benchmark_example": F.lit(""), "benchmark_book": F.lit("")})
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    out = mistakes.join(F.broadcast(found), "dimension", "left")  # a row for each dimension at most
    return out.select(*mistakes.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in ("benchmark_example", "benchmark_book")))


def flattened_state(state: Column | str) -> Column:
    """One level of nested state: ``{k: {a: x}}`` (JSON values) becomes ``{k_a: x}``; lists joined by ``, ``;
    a value that is no object stays as it is, under its own name. A state that is no object is ``{_raw: state}``."""
    whole = T.strip(F.coalesce(T.col(state), F.lit("")))
    entries = F.map_entries(F.from_json(whole, "map<string,string>"))
    text = lambda v: F.coalesce(F.when(v.rlike(r"^\s*\["), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v), F.lit(""))
    nested = lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat(e["key"], F.lit("_"), x["key"]).alias("key"), text(x["value"]).alias("value")))
    plain = lambda e: F.array(F.struct(e["key"].alias("key"), text(e["value"]).alias("value")))
    flat = F.map_from_entries(F.flatten(F.transform(entries, lambda e: F.when(e["value"].rlike(r"^\s*\{"), nested(e)).otherwise(plain(e)))))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(whole.startswith("{"), flat).when((whole == "") | (whole == "[]"), none).otherwise(F.create_map(F.lit("_raw"), whole))


def foreshadowing_status(status: Column | str) -> Column:
    s = F.lower(F.coalesce(T.col(status), F.lit("")))
    return (
        F.when(s.rlike("resolve|回收"), "resolved").when(s.rlike("advance|推进"), "advancing").when(s.rlike("defer|延后"), "deferred").otherwise("open")
    )


def causal_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges by batch and event number (``source``, ``target``) to keyed edges by event id; what matches no
    event is dropped, and of edges between the same two events one stays."""
    number = lambda c: F.col(c).try_cast("int")
    source = events.select("book_name", "batch", F.col("number").alias("s"), F.col("event_id").alias("source_event_id"))
    target = events.select("book_name", "batch", F.col("number").alias("t"), F.col("event_id").alias("target_event_id"))
    rows = edges.withColumn("s", number("source")).withColumn("t", number("target")).where("s is not null and t is not null")
    joined = rows.join(source, ["book_name", "batch", "s"]).join(target, ["book_name", "batch", "t"])
    keyed = joined.withColumn("id", T.key("book_name", "source_event_id", "target_event_id"))
    return one_per_key(keyed, ["id"], ["batch", "relation_type", "relation_detail"], first=True).select("id", "book_name", "source_event_id", "target_event_id", "relation_type", "relation_detail")


def with_global_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges of the batches and, of those found over a whole book, the ones with new ids."""
    return edges.unionByName(found.join(edges.select("id"), "id", "left_anti"))


def numbered_events(events: DataFrame, batch: int = 10) -> DataFrame:
    """Events in chapter order, numbered from 1 inside batches of ``batch`` chapters."""
    rows = events.withColumn("batch", F.floor(F.col("chapter_no") / batch).cast("int"))
    w = Window.partitionBy("book_name", "batch").orderBy("chapter_no", "seq")
    return rows.withColumn("number", F.row_number().over(w))
