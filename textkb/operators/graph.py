"""Property graphs as node and edge tables: building, neighbourhoods, components, causal chains.

Loops run over frontiers: a step is one join on the edges, visited nodes go out by an anti join, and the
lineage is cut with a table in the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize as cut


def appearance_edges(states: DataFrame, skip=("_raw", "旁白"), chars: int = 50) -> DataFrame:
    """char -> chapter edges from (name, chapter_id, seq, state): distinct short states in first order."""
    rows = states.where(~F.col("name").isin(*skip)).withColumn("state", F.substring("state", 1, chars))
    first = rows.groupBy("name", "chapter_id", "state").agg(F.min("seq").alias("seq"))
    actions = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda x: x["state"]), "|")
    edges = first.groupBy("name", "chapter_id").agg(actions.alias("action"))
    return edges.select(F.concat(F.lit("char:"), "name").alias("src"), F.concat(F.lit("chap:"), "chapter_id").alias("dst"), "action")


def latest_edges(edges: DataFrame, order: str, value: str, missing: str = "unknown") -> DataFrame:
    """One edge for each (src, dst): the last written value."""
    return edges.groupBy("src", "dst").agg(F.coalesce(F.max_by(value, order), F.lit(missing)).alias(value))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).alias("way"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("way"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """``(start, node, depth, via, way)`` of every node within ``depth`` steps of each start (breadth first).

    Each start has its own visited set. The edge that is told for a node: least depth, then out (0) before
    in (1), then the smallest neighbour it was reached from. Nodes of a start come once; the start has depth 0.
    """
    steps = _steps(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), direction)
    none = F.lit(None)
    frontier = starts.select(F.col("node").alias("start"), "node").distinct()
    seen = frontier.select("start", "node", F.lit(0).alias("depth"), none.cast(starts.schema["node"].dataType).alias("via"), none.cast("int").alias("way"))
    for d in range(1, depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("at")).select("start", F.col("to").alias("node"), F.col("at").alias("via"), "way")
        new = reached.groupBy("start", "node").agg(F.min(F.struct("way", "via")).alias("e")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        new = cut(new.select("start", "node", F.lit(d).alias("depth"), F.col("e.via").alias("via"), F.col("e.way").alias("way")))
        seen, frontier = seen.unionByName(new), new.select("start", "node")
        if not new.take(1):
            break
    return seen


def causal_chain(events: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, direction: str) -> DataFrame:
    """Events up- or downstream of each start event, by shortest distance, with their names."""
    way = {"downstream": "out", "upstream": "in", "both": "both"}[direction]
    reached = neighbourhood(edges, starts, depth, way)
    return reached.join(events.select(F.col("event_id").alias("node"), "event_name"), "node")


def chain_edges(reached: DataFrame, events: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """The causal edges at each reached event: ``(start, depth, direction, relation_type, relation_detail, event_name,
    chapter_id)`` of the event at the other end, one step further than the reached one. ``edges`` has source_event_id,
    target_event_id, relation_type and relation_detail; what is missing of an unknown event is blank."""
    ends = {"downstream": ("source_event_id", "target_event_id"), "upstream": ("target_event_id", "source_event_id")}
    parts = []
    for way in ends if direction == "both" else (direction,):
        here, there = ends[way]
        parts.append(edges.select(F.col(here).alias("node"), F.col(there).alias("other"), F.lit(way).alias("direction"), "relation_type", "relation_detail"))
    steps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    known = events.select(F.col("event_id").alias("other"), "event_name", "chapter_id")
    rows = reached.select("start", "node", "depth").join(steps, "node").join(known, "other", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("start", (F.col("depth") + 1).alias("depth"), "direction", "relation_type", "relation_detail", blank("event_name"), blank("chapter_id"))


def causal_overview(events: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """A row for each book without a start event: counts of events and edges, and its first ``most`` events of high
    significance by id. Each task keeps at most ``most`` of a book before the shuffle."""
    w = Window.partitionBy("book_name").orderBy("event_id")
    high = events.where("significance = 'high'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    told = F.transform(F.array_sort(F.collect_list(F.struct("_n", "event_name", "chapter_id", "event_type"))), lambda x: F.struct(x["event_name"].alias("event_name"), x["chapter_id"].alias("chapter_id"), x["event_type"].alias("event_type")))
    out = events.groupBy("book_name").agg(F.count("*").alias("total_events")).join(edges.groupBy("book_name").agg(F.count("*").alias("total_edges")), "book_name", "left")
    out = out.join(high.groupBy("book_name").agg(told.alias("high_events")), "book_name", "left")
    return out.withColumn("total_edges", F.coalesce("total_edges", F.lit(0).cast("long")))


def event_graph(events: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``event:name`` (of equal names the last by id) and edges between names; edges of unknown events go."""
    node = events.groupBy(F.concat(F.lit("event:"), "event_name").alias("node_id")).agg(F.max_by(F.struct("book_name", "chapter_id", "event_type", "significance"), "event_id").alias("a"))
    nodes = node.select("node_id", F.lit("story_event").alias("node_type"), F.col("a.book_name").alias("book_list"), "a.chapter_id", "a.event_type", "a.significance")
    name = lambda end: events.select(F.col("event_id").alias(f"{end}_event_id"), F.concat(F.lit("event:"), "event_name").alias(end))
    both = edges.join(name("source"), "source_event_id").join(name("target"), "target_event_id")
    last = both.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.max_by(F.struct("relation_type", "book_name"), F.struct("source_event_id", "target_event_id")).alias("a"))
    return nodes, last.select("src", "dst", "a.relation_type", F.col("a.book_name").alias("book"))


def plot_line_nodes(lines: DataFrame) -> DataFrame:
    """A node for each plot line, keyed by book, type and theme."""
    blank = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown"))
    return lines.select(F.concat_ws(":", F.lit("plot"), "book_name", blank("line_type"), blank("theme")).alias("node_id"), F.lit("plot_line").alias("node_type"), F.col("book_name").alias("book_list"), "line_type", "theme", "chapter_distribution").dropDuplicates(["node_id"])


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes (column ``node``)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids, F.col("src") == F.col("node"), "left_semi").join(ids, F.col("dst") == F.col("node"), "left_semi")


def character_relations(nodes: DataFrame, edges: DataFrame, book_name: str, name: str = "") -> DataFrame:
    """``(src, dst, relation_type, relation_strength)`` between the characters of a book (nodes: node_id, node_type, book_list).

    A missing type is ``unknown``, a missing strength 0; ``name`` keeps characters whose id holds it.
    """
    own = nodes.where((F.col("node_type") == "character") & F.contains(F.col("book_list"), F.lit(book_name)) & F.contains(F.col("node_id"), F.lit(name)))
    kept = induced(edges, own.select(F.col("node_id").alias("node")))
    return kept.select("src", "dst", F.coalesce("relation_type", F.lit("unknown")).alias("relation_type"), F.coalesce(F.col("strength").cast("double"), F.lit(0.0)).alias("relation_strength"))


def _near(steps: DataFrame, key: str) -> DataFrame:
    """``(key, near)``: the least neighbour of each vertex but itself (columns ``at``, ``to``), null for one that has none."""
    return steps.groupBy(F.col("at").alias(key)).agg(F.min("to").alias("near"))


def _trees(near: DataFrame) -> DataFrame:
    """``(id, root)`` of the trees that the pointers ``(id, near)`` make, by jumps that halve their depth.

    Two steps never lead to a larger id, so that chains end in pairs that point at each other: the smaller is the root.
    """
    up = near.select("id", F.coalesce("near", "id").alias("up"))
    beyond = lambda t: t.select(F.col("id").alias("up"), F.col("up").alias("next"))
    end = F.when(F.col("next") == F.col("id"), F.least("id", "up")).otherwise(F.col("next"))
    up = cut(up.join(beyond(up), "up").select("id", end.alias("up"), F.lit(True).alias("moved")))
    while up.where("moved").take(1):
        up = cut(up.join(beyond(up), "up").select("id", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
    return up.select("id", F.col("up").alias("root"))


def _between(edges: DataFrame, trees: DataFrame) -> DataFrame:
    """The edges (``u``, ``v``) between different trees, each pair of trees once."""
    root = lambda end: trees.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    met = edges.join(root("u"), "u").join(root("v"), "v").where("u_root <> v_root")
    return met.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct()


def _number(node: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def weak_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)``: component is the smallest node, by contractions over numbered nodes.

    A node's number is a hash, with another seed if two nodes share one. In a round each vertex points at its least
    neighbour, the trees of these pointers become the vertices of the next round, and only edges between trees stay,
    each once. So vertices fall by half at least, and one round leaves few edges of a graph with many for each node.
    """
    return _components(cut(edges.where("src is not null and dst is not null").select("src", "dst")), max_rounds)


def _components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``weak_components`` of a table of edges, which is read a few times."""
    for seed in range(max_rounds):
        steps = _steps(edges, "both")
        numbered = steps.select("at", F.when(F.col("at") != F.col("to"), _number("to", seed)).alias("to"))
        nodes = cut(_near(numbered, "node").select("node", _number("node", seed).alias("id"), "near"))
        if not nodes.groupBy("id").count().where("count > 1").take(1):
            break
    else:
        raise RuntimeError(f"nodes share numbers under {max_rounds} seeds")
    rest, near, rounds = edges.select(_number("src", seed).alias("u"), _number("dst", seed).alias("v")), nodes.select("id", "near"), []
    while True:
        rounds.append(_trees(near))
        rest = cut(_between(rest, rounds[-1]))
        if not rest.take(1):
            break
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        near = _near(_steps(rest.select(F.col("u").alias("src"), F.col("v").alias("dst")), "both"), "id")
    roots = rounds.pop()
    for trees in reversed(rounds):  # the small ones first
        later = roots.select(F.col("id").alias("root"), F.col("root").alias("last"))
        roots = trees.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    named = cut(nodes.join(roots, "id").select("node", "root"))
    return cut(named.join(named.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component"))


def extended_components(labels: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` after new edges, from the labels before them (``node``, ``component``: the smallest node).

    Old components are single vertices here: only the new edges between them, or with a new node, are walked, and then
    every label is looked up once. New nodes are labels of their own at first. Edges with a null end are left out;
    edges inside a component change nothing. Labels only ever merge: edges are not taken away.
    """
    new = edges.where("src is not null and dst is not null").select("src", "dst")
    known = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
    met = new.join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    ends = [c for end in ("src", "dst") for c in (F.coalesce(f"{end}_label", end).alias(end), F.col(f"{end}_label").isNull().alias(f"{end}_new"))]
    met = cut(met.select(*ends).where("src <> dst or src_new or dst_new").distinct())
    moved = _components(met.select("src", "dst"), max_rounds).withColumnRenamed("component", "root")
    fresh = reduce(DataFrame.unionByName, (met.where(f"{end}_new").select(F.col(end).alias("node")) for end in ("src", "dst"))).distinct()
    every = labels.select("node", "component").unionByName(fresh.withColumn("component", F.col("node")))
    return cut(every.join(moved.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(measure, name, value)``: nodes and edges, nodes by type, nodes by book (where there is a ``book_list``, names
    with ``|`` between them), components and the largest."""
    row = lambda df, measure, name, value: df.select(F.lit(measure).alias("measure"), name.alias("name"), value.cast("long").alias("value"))
    nodes, edges = cut(nodes.select("node_id", "node_type", *(c for c in ("book_list",) if c in nodes.columns))), cut(edges.select("src", "dst"))
    labels = _components(edges.where("src is not null and dst is not null"))
    comp = labels.groupBy("component").count()
    loose = edges.where("src is null or dst is null").select(F.coalesce("src", "dst").alias("node_id"))
    alone = nodes.join(labels.select(F.col("node").alias("node_id")).unionByName(loose), "node_id", "left_anti")
    sizes = comp.select("count").unionByName(alone.select(F.lit(1).cast("long").alias("count")))
    parts = [
        row(nodes.agg(F.count("*").alias("v")), "nodes", F.lit(""), F.col("v")),
        row(edges.agg(F.count("*").alias("v")), "edges", F.lit(""), F.col("v")),
        row(nodes.groupBy("node_type").agg(F.count("*").alias("v")), "nodes by type", F.col("node_type"), F.col("v")),
        row(sizes.agg(F.count("*").alias("v")), "components", F.lit(""), F.col("v")),
        row(sizes.agg(F.max("count").alias("v")), "largest component", F.lit(""), F.col("v")),
    ]
    if "book_list" in nodes.columns:
        book = nodes.select(F.explode(F.transform(F.split("book_list", r"\|"), lambda b: F.trim(b))).alias("book")).where("book <> ''")
        parts.append(row(book.groupBy("book").agg(F.count("*").alias("v")), "nodes by book", F.col("book"), F.col("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skill_graph(skills: DataFrame) -> DataFrame:
    """scene -> skill edges with the books that hold them."""
    return skills.groupBy(F.concat(F.lit("scene:"), "scene_type").alias("src"), F.concat(F.lit("skill:"), "skill_name").alias("dst")).agg(F.array_sort(F.collect_set("book_name")).alias("book_list"))


def export_attributes(attrs: Column) -> Column:
    """Attribute map ready for XML: null becomes '', illegal characters go."""
    from ..functions.text import xml_safe

    return F.transform_values(attrs, lambda k, v: xml_safe(F.coalesce(v, F.lit(""))))


def numbered_subgraph(nodes: DataFrame, edges: DataFrame, first: int, last: int) -> DataFrame:
    """Edges among the nodes whose ``number`` lies in a range."""
    return induced(edges, nodes.where(F.col("number").between(first, last)).select(F.col("node_id").alias("node")))
