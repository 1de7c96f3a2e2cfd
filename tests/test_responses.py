"""A response of each kind, written by hand in the layout that models are asked for, and the row it becomes."""

import json

import pytest

from textkb.operators import ingest

BESIDE = {
    "category": "玄幻", "author": "某", "volume_index": 2, "chapter_range": "11-20", "character_name": "甲", "project_name": "p", "chapter_index": 7,
    "benchmark_books": "书一|书二", "reviewed_at": "2024-01-01", "comparison_dimension": "对话", "books": ["书一", "书二"], "created_at": "2024-01-02", "scene_type": "战斗", "batch": 0,
}
TYPES = {"volume_index": "int", "chapter_index": "int", "batch": "int", "books": "array<string>"}

#: kind -> (response, expected columns; JSON columns as Python values)
CASES = {
    "plot_arcs": (
        {"chapter_summary": "摘要", "key_events": [{"event": "e", "impact": "i"}], "character_state": {"甲": "京城", "乙": {"伤": "轻", "友": ["丙", "丁"]}, "物": ["刀", 2]}, "scene_transitions": {"count": 2, "methods": ["时间跳跃"]}, "information_flow": {"new_info": ["x"], "hidden_info": []}, "emotion_arc": "平静→紧张", "time_progression": "过了三天", "inferred_category": "玄幻"},
        {"category": "玄幻", "summary": "摘要", "character_state_json": {"character_state": {"甲": "京城", "乙_伤": "轻", "乙_友": "丙, 丁", "物": "刀, 2"}, "key_events": [{"event": "e", "impact": "i"}], "scene_transitions": {"count": 2, "methods": ["时间跳跃"]}, "information_flow": {"new_info": ["x"], "hidden_info": []}, "emotion_arc": "平静→紧张", "time_progression": "过了三天"}},
    ),
    "skills": (
        {"scene_type": "冲突", "narrative_skills": [{"skill_name": "白描", "original_example": "原文", "analysis": "短句"}, 5, {"skill_name": ""}], "climax_point": {"has_climax_point": False}, "style_feature": {"tone": "冷"}},
        {"category": "玄幻", "scene_type": "冲突", "skill_name": "白描", "analysis": "短句", "original_example": "原文", "tags": "冲突|白描"},
    ),
    "author_fingerprints": (
        {"author_fingerprint": {"preferred_verbs": ["斩", "无", "掠"], "preferred_adjectives": ["冷"], "environmental_imagery": ["雪", "暂无"], "signature_transitions": [], "narrative_perspective": "第一人称", "sentence_rhythm": "短句"}, "sensory_mappings": []},
        {"category": "玄幻", "verbs": "斩,掠", "adjectives": "冷", "imagery": "雪", "transitions": "", "narrative_perspective": "第一人称", "sentence_rhythm": "短句"},
    ),
    "sensory_mappings": ({"sensory_mappings": [{"emotion": "怒", "show_not_tell": "握拳", "analysis": "具体"}]}, {"category": "玄幻", "emotion": "怒", "show_not_tell": "握拳", "analysis": "具体"}),
    "classic_excerpts": (
        {"classic_excerpts": [{"excerpt_text": "雪落。", "scene_type": "环境", "style_tag": "肃杀"}, {"excerpt_text": "êéèà", "style_tag": "坏"}, {"style_tag": "空"}]},
        {"category": "玄幻", "excerpt_text": "雪落。", "scene_type": "环境", "style_tag": "肃杀"},
    ),
    "world_settings": ({"world_settings": [{"module": "力量体系", "content": "九境", "tags": ["修炼", "境界"]}]}, {"author": "某", "category": "玄幻", "module": "力量体系", "entity": "未知", "content": "九境", "tags": "修炼|境界"}),
    "world_timeline": ({"world_timeline": [{"event_name": "大战", "event_description": "d", "impact": "i"}]}, {"era_or_year": "未知纪元", "event_name": "大战", "event_description": "d", "impact": "i"}),
    "faction_networks": ({"faction_networks": [{"faction_a": "A", "faction_b": "B", "relation_detail": "d", "stability": "稳", "key_events": "k"}, {"faction_a": "A"}]}, {"faction_a": "A", "faction_b": "B", "relation_type": "未知", "relation_detail": "d", "stability": "稳", "key_events": "k"}),
    "golden_finger": (
        {"golden_finger": {"name": "系统", "type": "系统流", "abilities": ["抽奖"], "upgrade_path": "任务", "limitations": ["每日一次"], "cost_layers": [], "interaction_with_plot": "推动"}},
        {"name": "系统", "type": "系统流", "abilities": ["抽奖"], "upgrade_path": "任务", "limitations": ["每日一次"], "cost_layers": [], "interaction_with_plot": "推动", "source_chapter": "c"},
    ),
    "character_profiles": (
        {"character_profiles": [{"name": "甲", "role_type": "主角", "appearance": "白衣", "quirks": "挑眉", "identity": ["剑客", "王爷"], "motivation": "复仇", "internal_conflict": "义", "personality": "冷", "abilities": ["剑"], "speech_samples": "哼", "behavior_samples": "按剑", "climax_or_fate": "", "background": "孤儿"}]},
        {"author": "某", "category": "玄幻", "name": "甲", "role_type": "主角", "appearance": "白衣", "quirks": "挑眉", "identity": '["剑客","王爷"]', "motivation": "复仇", "internal_conflict": "义", "personality": "冷", "relation_to_mc": "未知", "relations_to_others": "", "climax_or_fate": "", "background": "孤儿", "speech_samples": "哼", "behavior_samples": "按剑", "relationship_evolution": "", "abilities": '["剑"]', "internal_dilemma": "", "transformation_trigger": "", "contrast_design": ""},
    ),
    "macro_outlines": (
        {"volume_theme": "崛起", "core_conflict": "宗门", "plot_beats": ["a", "b"], "character_arc": "成长"},
        {"category": "玄幻", "volume_index": 2, "chapter_range": "11-20", "theme": "崛起", "conflict": "宗门", "beats_json": ["a", "b"], "arc": "成长"},
    ),
    "plot_foreshadowing": (
        {"foreshadowing": [{"hook_name": "玉佩", "action": "回收(Resolve)", "description": "身世", "payoff_timing": "卷末", "scope_type": "全书"}]},
        {"hook_name": "玉佩", "planned_payoff": "身世", "payoff_timing": "卷末", "scope_type": "全书", "status": "resolved", "planted_chapter": "", "resolved_chapter": "11-20", "last_advanced_chapter": ""},
    ),
    "entity_state_tracker": ({"state_changes": [{"entity_name": "乙", "change_description": "断臂"}, {"entity_name": "丙"}]}, {"entity_name": "乙", "chapter_range": "11-20", "current_state_json": {"type": "状态变更", "detail": "断臂"}}),
    "setting_evolutions": (
        {"setting_evolutions": [{"setting_module": "势力", "setting_entity": "青云", "before_state": "盛", "after_state": "衰", "trigger_event": "战"}]},
        {"setting_module": "势力", "setting_entity": "青云", "chapter_range": "11-20", "evolution_type": "未知", "before_state": "盛", "after_state": "衰", "trigger_event": "战"},
    ),
    "chapter_functions": (
        {"chapter_functions": [{"chapter_id": "第3章", "function_type": "铺垫", "structure_pattern": {"开": "静"}, "hook_content": "h"}]},
        {"chapter_id": "第3章", "function_type": "铺垫", "pacing_type": "未知", "structure_pattern_json": {"开": "静"}, "hook_type": "无钩子", "hook_content": "h"},
    ),
    "dialogue_samples": ({"dialogue_samples": [{"scene_type": "争吵", "original_text": "“滚！”", "emotional_tension": "高", "subtext": "s", "plot_function": "p", "writing_quality": "8"}]}, {"scene_type": "争吵", "original_text": "“滚！”", "emotional_tension": "高", "subtext": "s", "plot_function": "p", "writing_quality": 8}),
    "description_samples": ({"description_samples": [{"original_text": "山", "technique_analysis": "t", "sensory_details": "s"}]}, {"description_type": "未知", "original_text": "山", "technique_analysis": "t", "sensory_details": "s", "writing_quality": 5}),
    "transition_samples": ({"transition_samples": [{"transition_type": "时间", "original_text": "三日后", "technique_analysis": "t", "writing_quality": 6}]}, {"transition_type": "时间", "original_text": "三日后", "technique_analysis": "t", "writing_quality": 6}),
    "narrative_distance": ({"narrative_distance": [{"distance_type": "贴近内心", "trigger_reason": "r", "original_example": "他想", "writing_quality": 7}, {"original_example": "无类型"}]}, {"distance_type": "贴近内心", "trigger_reason": "r", "original_example": "他想", "writing_quality": 7}),
    "show_tell_patterns": ({"show_tell_patterns": [{"pattern_type": "混合", "switching_triggers": "s", "original_example": "x"}]}, {"pattern_type": "混合", "switching_triggers": "s", "original_example": "x", "writing_quality": 5}),
    "action_scene_samples": ({"action_scene_samples": [{"action_type": "打斗", "original_text": "一剑", "technique_analysis": "t", "pacing_analysis": "p", "sensory_details": "s", "writing_quality": 9}]}, {"action_type": "打斗", "original_text": "一剑", "technique_analysis": "t", "pacing_analysis": "p", "sensory_details": "s", "writing_quality": 9}),
    "climax_excerpts": ({"climax_excerpts": [{"excerpt_type": "决战", "original_text": "轰", "technique_analysis": "t", "emotional_impact": "震撼"}]}, {"excerpt_type": "决战", "original_text": "轰", "technique_analysis": "t", "emotional_impact": "震撼", "writing_quality": 5}),
    "memorable_quotes": ({"memorable_quotes": [{"quote_text": "天地不仁", "context": "c", "technique_analysis": "t", "quote_type": "哲理句"}]}, {"quote_type": "哲理句", "quote_text": "天地不仁", "context": "c", "technique_analysis": "t", "writing_quality": 5}),
    "character_speech_style": (
        {"speech_style": {"catchphrases": ["哼", "有趣"], "vocabulary_preference": "文言", "sentence_pattern": "短", "tone_contexts": {"怒": "冷"}, "dialogue_samples": ["“走”"]}},
        {"character_name": "甲", "catchphrases": "哼|有趣", "vocabulary_preference": "文言", "sentence_pattern": "短", "tone_contexts_json": {"怒": "冷"}, "dialogue_samples_json": ["“走”"]},
    ),
    "character_behavior_marks": (
        {"behavior_marks": {"habitual_actions": ["按剑"], "micro_expressions": ["挑眉", "抿唇"], "defense_mechanisms": "沉默", "behavior_samples": ["他按剑"]}},
        {"character_name": "甲", "habitual_actions": "按剑", "micro_expressions": "挑眉|抿唇", "defense_mechanisms": "沉默", "behavior_samples_json": ["他按剑"]},
    ),
    "character_relationship_dynamics": ({"relationship_dynamics": [{"other_character": "乙", "relationship_timeline": [{"stage": "敌", "event": "e"}]}, {"x": 1}]}, {"character_a": "甲", "character_b": "乙", "timeline_json": [{"stage": "敌", "event": "e"}]}),
    "plot_lines": ({"plot_lines": [{"line_type": "main", "theme": "复仇", "chapter_distribution": "1-90", "milestones": ["入门"]}]}, {"line_type": "main", "theme": "复仇", "chapter_distribution": "1-90", "milestones_json": ["入门"]}),
    "revelation_pacing": ({"revelation_pacing": [{"revelation_name": "身世", "reveal_chapter": "30", "reveal_method": "梦", "impact": "i"}]}, {"revelation_name": "身世", "reveal_chapter": "30", "reveal_method": "梦", "impact": "i"}),
    "emotion_transition_patterns": ({"emotion_transition_patterns": [{"transition_type": "爱到恨", "foreshadowing_method": "细节"}]}, {"transition_type": "爱到恨", "foreshadowing_method": "细节"}),
    "information_management": (
        {"information_management": [{"strategy_type": "隐瞒", "target_info": "凶手", "conceal_method": "视角", "reveal_timing": "末", "dramatic_purpose": "悬念"}]},
        {"strategy_type": "隐瞒", "target_info": "凶手", "conceal_method": "视角", "reveal_timing": "末", "dramatic_purpose": "悬念"},
    ),
    "climax_buildup_chains": ({"climax_buildup_chains": [{"climax_name": "决战", "climax_chapter": "88", "buildup_steps": ["集结"], "tension_escalation": "渐强"}]}, {"climax_name": "决战", "climax_chapter": "88", "buildup_steps_json": ["集结"], "tension_escalation": "渐强"}),
    "conflict_escalation": ({"conflict_escalation": [{"conflict_line": "宗门", "escalation_steps": ["口角", "死斗"], "escalation_pattern": "阶梯"}]}, {"conflict_line": "宗门", "escalation_steps_json": ["口角", "死斗"], "escalation_pattern": "阶梯"}),
    "story_events": (
        {"events": [{"chapter_id": "第5章", "event_name": "夺剑", "event_summary": "s", "event_type": "高潮", "characters_involved": ["甲", "乙"], "significance": "high"}]},
        {"chapter_id": "第5章", "event_name": "夺剑", "event_summary": "s", "event_type": "高潮", "characters_involved": ["甲", "乙"], "significance": "high"},
    ),
    "event_causal_edges": ({"causal_edges": [{"source_index": 1, "target_index": "3", "relation_detail": "d"}]}, {"batch": 0, "source": "1", "target": "3", "relation_type": "未知", "relation_detail": "d"}),
    "chapter_reviews": (
        {"overall_score": 7.5, "dimension_scores": {"对话": {"score": 8, "comment": "好"}, "坏": "x"}, "issues": [{"issue_type": "节奏", "location": "段3", "description": "拖", "original_excerpt": "e"}, {"severity": "高"}], "suggestions": [{"suggestion_type": "删", "priority": "高", "description": "d", "expected_effect": "f"}], "rewrite_samples": [{"original_text": "a", "rewritten_text": "b", "rewrite_reason": "r", "technique_applied": "t"}, {"original_text": "a"}]},
        {"project_name": "p", "chapter_index": 7, "overall_score": 7.5, "benchmark_books": "书一|书二", "reviewed_at": "2024-01-01", "dimension_scores_json": {"对话": {"score": 8.0, "comment": "好"}}, "issues_json": [{"issue_type": "节奏", "severity": "中", "location": "段3", "description": "拖", "original_excerpt": "e"}], "suggestions_json": [{"suggestion_type": "删", "priority": "高", "description": "d", "expected_effect": "f"}], "rewrite_samples_json": [{"original_text": "a", "rewritten_text": "b", "rewrite_reason": "r", "technique_applied": "t"}]},
    ),
    "kb_references": (
        {"recommendations": [{"dimension": "对话", "ref_book": "书一", "ref_table": "dialogue_samples", "ref_content_summary": "c", "usage_suggestion": "u", "relevance_score": 9}, {"ref_book": "书二"}]},
        {"project_name": "p", "ref_book": "书一", "ref_table": "dialogue_samples", "ref_content": "c", "usage_purpose": "u", "target_type": "project", "target_id": "p", "ref_id": ""},
    ),
    "cross_book_comparisons": (
        {"common_patterns": [{"pattern": "x"}], "unique_features": [{"book": "书一"}], "best_practices": "b"},
        {"comparison_dimension": "对话", "common_patterns_json": [{"pattern": "x"}], "unique_features_json": [{"book": "书一"}], "best_practices": "b", "created_at": "2024-01-02", "books_analyzed": ["书一", "书二"]},
    ),
    "common_mistakes": ({"mistakes": [{"dimension": "对话", "mistake_name": "同声", "typical_manifestation": "t", "frequency": 4, "correction_direction": "c"}]}, {"dimension": "对话", "mistake_name": "同声", "typical_manifestation": "t", "frequency": 4, "correction_direction": "c", "created_at": "2024-01-02"}),
    "technique_combinations": (
        {"combinations": [{"combo_name": "动静", "technique_sequence": ["静", "动"], "technique_roles": [{"静": "蓄"}], "applicable_scenarios": "a", "variations": "v", "benchmark_book": "书一", "original_example": "o"}]},
        {"scene_type": "战斗", "combo_name": "动静", "technique_sequence_json": ["静", "动"], "technique_roles_json": [{"静": "蓄"}], "applicable_scenarios": "a", "variations": "v", "benchmark_book": "书一", "original_example": "o", "created_at": "2024-01-02"},
    ),
}


def test_every_kind_has_a_case():
    assert set(CASES) == set(ingest.KINDS) and len(CASES) == 39


@pytest.fixture(scope="module")
def responses(spark):
    rows = [("b", "c", i, kind, json.dumps(body, ensure_ascii=False), *BESIDE.values()) for i, (kind, (body, _)) in enumerate(CASES.items())]
    types = ", ".join(f"{n} {TYPES.get(n, 'string')}" for n in BESIDE)
    return spark.createDataFrame(rows, f"book_name string, chapter_id string, seq int, kind string, response string, {types}").cache()


@pytest.mark.parametrize("kind", list(CASES))
def test_kind(responses, kind):
    want = CASES[kind][1]
    got = ingest.ingest(responses.where(f"kind = '{kind}'"), ingest.KINDS[kind]).collect()
    assert len(got) == 1
    row = got[0].asDict()
    assert set(row) == {*want, "id", "book_name", "chapter_id", "seq", "pos"} and row["book_name"] == "b"
    for name, value in want.items():
        have = row[name]
        if isinstance(have, str) and not isinstance(value, str):
            have = json.loads(have)
        assert have == value, name


def test_missing_fields_and_null_rows(spark):
    """Blank fields take their defaults; null responses, null keys and empty tables are no trouble."""
    rows = [(None, None, 0, '{"dialogue_samples": [{"original_text": "x", "writing_quality": "bad"}, null, "y"]}'), ("b", "c", 1, None), ("b", "c", 2, "no json"), ("b", "c", 3, "[]")]
    df = spark.createDataFrame(rows, "book_name string, chapter_id string, seq int, response string")
    got = ingest.ingest(df, ingest.KINDS["dialogue_samples"]).collect()
    assert [(r["book_name"], r["scene_type"], r["writing_quality"], r["subtext"]) for r in got] == [(None, "未知", 5, "")]
    assert ingest.ingest(df.limit(0), ingest.KINDS["dialogue_samples"]).count() == 0
    assert ingest.rejects(df).count() == 3


def test_state_that_is_no_object(spark):
    rows = [('"昏迷"',), ("[]",), (None,), ('{"a": {"b": null}}',)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(ingest.flattened_state("s")).collect()] == [{"_raw": '"昏迷"'}, {}, {}, {"a_b": ""}]
