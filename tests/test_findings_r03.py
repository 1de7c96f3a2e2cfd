"""Cases of the findings of round 3."""

import random

import pytest
from pyspark.sql import functions as F

from textkb.functions import text as T
from textkb.operators import chapters as C
from textkb.operators import fuzzy, graph
from textkb.operators import ingest as I
from textkb.operators import lexicon, pivots, quotes, relate
from textkb.operators import views
from textkb.plans import registry, view_queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["plot_subplots", "excerpt_description", "recommend", "plot_line_nodes"])
def test_views_ask_for_all_books(name):
    asked, condition, _ = view_queries._ASKED[name]
    assert "book_name" not in asked and "book_name" not in condition
    assert "book_name = '" not in registry.ORACLES[f"view_{name}"]


def test_dialogue_samples_come_by_quality(spark):
    rows = spark.createDataFrame([("a", "e", "t", 7), ("b", "e", "t", 3), ("c", "e", "t", None), ("d", "x", "t", 1)], "id string, scene_type string, original_text string, writing_quality int")
    got = views.view({"dialogue_samples": rows.selectExpr("*", "'k' as book_name")}, "style_dialogue_samples", scene_type="E")
    assert [r["id"] for r in got.collect()] == ["b", "a", "c"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_responses_read_each_value_once(spark):
    """Steps of F10, F11, F13, F18, F19, F20, F22 and F25: one number of an event, one walk over an item, no pattern at its ends."""
    from textkb.plans import ingest_queries as Q

    for name in ("dialogue_samples", "chapter_reviews"):
        plan = _plan(I.ingest(Q.kind_responses(spark, DIR, I.KINDS[name]), I.KINDS[name]))
        assert plan.count("get_json_object(") == 1 and plan.count("try_variant_get(") == 1 and "regexp_replace" not in plan
    assert "from_json" not in plan[plan.index("WindowGroupLimit") :]  # issues of a review are told for the reviews that stay


def test_strip_takes_every_kind_of_space(spark):
    texts = [f"{chr(c)}{chr(c)}a{chr(c)}b{chr(c)}" for c in range(0x3001) if not 0xD800 <= c <= 0xDFFF] + [None, "", "　 \n"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    pattern = F.regexp_replace("v", rf"^[{T.SPACE}]+|[{T.SPACE}]+\z", "")
    assert df.where(~T.strip("v").eqNullSafe(pattern)).count() == 0 and "regexp" not in _plan(df.select(T.strip("v")))


def test_slices_are_merged_without_a_row_for_each_name(spark):
    rows = spark.createDataFrame([("b", "c_1", 1, "s", ["x", "y", "x"]), ("b", "c_2", 2, "t", ["y", None, "z"]), ("b", "d", 3, "u", []), ("b", "e", 4, "v", None)], "book_name string, chapter_id string, seq long, scene_type string, skills array<string>")
    got = C.merged_slices(rows, "seq")
    assert sorted((r["chapter_id"], r["scene_type"], r["skills"]) for r in got.collect()) == [("c", "s", ["x", "y", None, "z"]), ("d", "u", None), ("e", "v", None)]
    assert "explode" not in _plan(got)


def test_texts_reach_python_in_small_batches(spark):
    rows = spark.createDataFrame([("1", "abc")], "doc_id string, text string")
    for build in (lambda: C.register(spark), lambda: lexicon.lexicon_counts(rows, rows.selectExpr("text as word")), lambda: fuzzy.fuzzy_position(rows, "text", "text")):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        build()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20


def test_visits_of_cells_leave_in_small_batches():
    import pyarrow as pa

    parts = list(pivots._parts(iter([pa.RecordBatch.from_pydict({"x": list(range(150))})]), pivots.VISITORS))
    assert [p.num_rows for p in parts] == [64, 64, 22] and [x for p in parts for x in p["x"].to_pylist()] == list(range(150))


def test_points_look_into_few_groups_of_levels():
    sizes = [(level, 1000, 1000 * 0.75 * 2**level) for level in range(4, 16)]
    groups = relate.level_groups(sizes, 10_000_000)
    assert list(sorted(groups)) == [level for level, *_ in sizes] and all(g <= level for level, g in groups.items())
    assert len(set(groups.values())) <= 2  # a group for each level before
    assert relate.level_groups(sizes, 0) == {level: level for level, *_ in sizes} and relate.level_groups([], 5) == {}


def test_ascii_quotes_are_not_searched_for_characters_that_change(spark):
    rows = spark.createDataFrame([("ASCII quote", "an ASCII quote"), ("ASCII quote", "other text"), ("ﬁne quote 1", "a fine quote 1"), (None, "x"), ("short", "x")], "q string, t string")
    got = quotes.unverified(rows, "q", "t")
    assert sorted((r["q"] or "", r["t"], r["unverified"]) for r in got.collect()) == [("", "x", None), ("ASCII quote", "an ASCII quote", False), ("ASCII quote", "other text", True), ("short", "x", False), ("ﬁne quote 1", "a fine quote 1", False)]
    assert "octet_length" in _plan(got)


def _written(monkeypatch):
    """Rows of each table that graph loops write from now on."""
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return rows


def _dense(spark, part=lambda s, p: True):
    """150 parts, each of 40 suppliers: 6,000 edges, 190 nodes, one component."""
    return spark.createDataFrame([(f"s{s}", f"p{p}") for s in range(40) for p in range(150) if part(s, p)], "src string, dst string")


def test_components_walk_all_edges_of_a_dense_graph_once(spark, monkeypatch):
    """every round joined each edge in both directions; after one round few are left."""
    rows = _written(monkeypatch)
    got = graph.weak_components(_dense(spark)).collect()
    assert len(got) == 190 and {r["component"] for r in got} == {"p0"}
    assert rows[0] == 6000 and sum(rows[1:]) < 6000 / 2


def test_components_of_paths_and_stars_under_shared_numbers(spark, monkeypatch):
    """nodes that share a number are told apart by another seed."""
    r = random.Random(4)
    names = [f"n{i:03d}" for i in range(200)]
    r.shuffle(names)
    edges = list(zip(names[:120], names[1:121])) + [(names[150], x) for x in names[151:190]] + [(names[195], names[195]), (names[196], None), (None, None)]
    want = {x: min(part) for part in (names[:121], names[150:190], names[195:196]) for x in part}
    number, seeds = graph._number, []

    def shared(node, seed):
        seeds.append(seed)
        return number(node, seed) % 7 if seed == 0 else number(node, seed)

    monkeypatch.setattr(graph, "_number", shared)
    got = graph.weak_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {x["node"]: x["component"] for x in got} == want and len(got) == len(want) and max(seeds) == 1


def test_graph_stats_compute_their_inputs_once(spark, monkeypatch):
    """each measure computed the edges and the nodes anew."""
    rows = _written(monkeypatch)
    edges = _dense(spark).unionByName(spark.createDataFrame([("s0", None), ("x", None)], "src string, dst string"))
    nodes = spark.createDataFrame([(x, "n") for x in [f"s{s}" for s in range(40)] + [f"p{p}" for p in range(150)] + ["x", "y"]], "node_id string, node_type string")
    calls = spark.sparkContext.accumulator(0)

    def told(x):
        calls.add(1)
        return x

    once = F.udf(told, "string").asNondeterministic()
    out = graph.graph_stats(nodes.withColumn("node_type", once("node_type")), edges)
    assert {(r["measure"], r["value"]) for r in out.collect()} == {("nodes", 192), ("edges", 6002), ("nodes by type", 192), ("components", 2), ("largest component", 190)}
    assert calls.value == 192 and rows[:2] == [192, 6002]


def test_edges_inside_a_component_are_not_written(spark, monkeypatch):
    """each new edge was written, also those that change nothing."""
    labels = graph.weak_components(_dense(spark, lambda s, p: (s + p) % 2 == 0))
    rows = _written(monkeypatch)
    got = graph.extended_components(labels, _dense(spark, lambda s, p: (s + p) % 2 == 1).unionByName(spark.createDataFrame([("z", "y"), ("s1", "z"), ("w", "w"), (None, "s1")], "src string, dst string")))
    assert {(r["component"], r["node"]) for r in got.collect()} == {("p0", f"s{s}") for s in range(40)} | {("p0", f"p{p}") for p in range(150)} | {("p0", "y"), ("p0", "z"), ("w", "w")}
    assert sum(rows) < 3000 / 4
