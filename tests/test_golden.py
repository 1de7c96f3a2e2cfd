"""Hand-written cases: cleaning, headings, blocks, slices, names, encodings, keys, ingestion, graphs, streams."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from textkb.functions import text as T
from textkb.operators import chapters as C
from textkb.operators import clean, digests, fuzzy, graph, ingest, lexicon, pivots, quotes, relate, search, textindex, upsert, views
from textkb.sources import library as L
from textkb.sources import sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def notes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in clean.without_author_notes(df, "doc_id", "text").collect()}


def test_author_notes(spark):
    got = notes(spark, ["a\n题外话：x\nb\n第3章 y\nc", "a\n作者说 x\nb", "a\n第4章 题外话\nb", "题外话\nb\n第4章 题外话\nc\n第5章", "PS\nx", "PS: x\ny\n第一章", "plain\nPSx"])
    assert got == {0: "a\n第3章 y\nc", 1: "a", 2: "a", 3: "第4章 题外话\nc\n第5章", 4: "", 5: "第一章", 6: "plain\nPSx"}


def test_author_notes_equal_a_line_scan(spark):
    import re

    r, pool = random.Random(7), ["x", "题外话", "第1章 a", "第2章 碎碎念", "PS: b", "", "作者的话"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 14))) for _ in range(120)]

    def scan(text):
        inside, out = False, []
        for line in text.split("\n"):
            t, h = bool(re.search(r"作者的话|作者说|题外话|碎碎念|^PS([：:\s]|$)", line)), bool(re.match("第[12]章", line))
            if inside and h or not inside and not t:
                out.append(line)
            inside = (not h) if inside else t
        return "\n".join(out)

    assert notes(spark, texts) == {i: scan(t) for i, t in enumerate(texts)}


def test_cleaning_is_idempotent_and_keeps_order(spark):
    text = "第一章 开始\r\n  正文　\n\n\n\n求月票！！\nwww.abc.com 好看\n========~~~~####\nPS：谢谢\n第二章\n最新网址：x.com\n末尾\x07"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    once = clean.cleaned(df).drop("is_short")
    assert clean.cleaned(once).first()["text"] == once.first()["text"]
    body = once.first()["text"]
    assert "求月票" not in body and "www" not in body and "\x07" not in body and body.startswith("第一章 开始\n正文") and body.endswith("末尾")


def test_headings_and_blocks(spark):
    body, preface = "文" * 101, "序" * 101
    text = f"{preface}\n第一章 起\n{body}\n\n第二章 承\n第三章 转\n{body}\nChapter 7 Title\n{'x' * 100}\n第9章\n{body}"
    got = one(spark, C.heading_chapters, text)
    assert [(c["chapter_id"], c["text"][:1]) for c in got] == [("序章", "序"), ("第一章 起", "文"), ("第二章 承", "第"), ("第9章", "文")]
    assert one(spark, C.heading_chapters, "序" * 100) == [] and one(spark, C.heading_chapters, "") == []
    sizes = lambda n: [len(c["text"]) for c in one(spark, lambda c: C.fixed_blocks(c, 5000), "x" * n)]
    assert sizes(10_051) == [5000, 5000, 51] and sizes(10_050) == [5000, 5000] and sizes(0) == []


def test_semantic_slices():
    text = ("a" * 2990 + "\n\n") * 4
    parts = C.semantic_slices(text, 5000, 200)
    assert parts[0] == "a" * 2990 and all(len(p) <= 5000 for p in parts)
    assert C.boundary("b" * 3000 + "---" + "c" * 1997) == 3003 and C.boundary("b" * 4000 + "……" + "c" * 998) == 5000
    assert C.boundary("b" * 3000 + "。\n" + "c" * 1998) == 3002 and C.boundary("b" * 3000 + "”x\n" + "c" * 1000 + "。\n" + "c" * 100) == 3003
    assert C.boundary("b" * 100 + "---" + "c" * 4897) == 5000
    whole = "x" * 12_000
    assert C.semantic_slices(whole, 5000, 200) == ["x" * 5000, "x" * 5000, "x" * 2200]


def test_split_chapters_loses_nothing(spark):
    docs = spark.createDataFrame([(1, "第一章 a\n" + "好。\n" * 3000 + "第二章 b\n" + "x" * 300), (2, "short"), (3, None)], "doc_id long, text string")
    rows = C.split_chapters(docs, size=2000)
    got = rows.orderBy("chapter_idx", "slice_no").collect()
    assert {r["doc_id"] for r in got} == {1} and got[-1]["chapter_id"] == "第二章 b" and [r["slice_no"] for r in got[:-1]] == list(range(1, len(got)))


def test_names(spark):
    names = ["《书》作者：某 分类：玄幻 标签：热血、升级", "书 by someone", "书[番外]", "《 书名 》作者:乙[番外]"]
    df = spark.createDataFrame([(f"/lib/{p}/{n}.txt",) for n, p in zip(names, ["x", "x/武侠(合集)/y", "仙侠", ""])], "path string")
    got = [(r["book_name"], r["author"], r["category"], r["tags"]) for r in L.descriptors(df, "/lib").collect()]
    assert got == [("书", "某", "玄幻", ["热血", "升级"]), ("书", "someone", "武侠", []), ("书[番外]", "未知作者", "仙侠", []), ("书名[番外]", "乙[番外]", "/" and got[3][2], [])]
    canon = lambda name, folder="热门小说", parent="": tuple(one(spark, lambda c: L.canonical_name(c, F.lit(folder), F.lit(parent)), name))
    assert canon("[完结]《长夜》作者：墨香") == ("长夜", "墨香", "") and canon("《长夜》全本", "墨香合集") == ("长夜", "墨香", "")
    assert canon("长夜-墨香") == ("长夜", "墨香", "") and canon("长夜番外 by priest") == ("长夜番外", "priest", "番外")
    # Folders on the block list, named like the title or holding a count are told apart.
    assert canon("长夜", "凡人修仙传") == ("长夜", "未知", "") and canon("《诛仙》", "诛仙", "萧鼎（7本）") == ("诛仙", "萧鼎", "")
    assert canon("《甲乙》作者：丙") == ("甲乙", "未知", "") and canon("《甲乙》作者：乱") == ("甲乙", "乱", "") and canon("《甲乙》作者：水千丞 番全") == ("甲乙", "水千丞", "番外")
    assert canon("007 《甲-乙》（墨香）") == ("甲乙", "墨香", "") and canon("【全】长夜 （完结）墨香2020") == ("长夜", "墨香", "")


def test_decoding():
    s = "第一章 天地玄黄，宇宙洪荒。"
    for codec in ("utf-8", "utf-8-sig", "utf-16", "gbk"):
        assert L.decoded(s.encode(codec)) == s
    assert L.decoded("這是繁體字".encode("big5")) and L.decoded(b"") == ""
    assert [L.decoded(t.encode("gbk")) for t in ("你好", "第一章")] == ["你好", "第一章"] and L.decoded("café".encode("latin-1") + b"!!!") == "café!!!"


def test_library_scan_merge_and_stream(spark, tmp_path):
    from textkb.streaming import streams

    root = tmp_path / "lib"
    (root / "玄幻").mkdir(parents=True)
    (root / "玄幻" / "《甲》作者：某.txt").write_bytes(("第一章 起\n" + "天地玄黄宇宙洪荒" * 30).encode("gbk"))
    found = L.files(spark, str(root))
    assert L.texts(found).first()["text"].startswith("第一章")
    table, check = str(tmp_path / "chapters"), str(tmp_path / "check")
    streams.ingest_library(spark, str(root), table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    (root / "《乙》.txt").write_text("第一章 a\n" + "y" * 150 + "\n第二章 b\n" + "z" * 150)
    for _ in range(2):  # the second run finds nothing new
        streams.ingest_library(spark, str(root), table, check).awaitTermination()
    count = lambda: sorted((r["book_name"], r["count"]) for r in spark.read.parquet(table).groupBy("book_name").count().collect())
    assert count() == [("乙", 2), ("甲", 1)]
    (root / "二").mkdir()
    (root / "二" / "《乙》.txt").write_text("第三章 c\n" + "w" * 150)  # a later file adds to the book
    streams.ingest_library(spark, str(root), table, check).awaitTermination()
    assert count() == [("乙", 3), ("甲", 1)]
    (root / "《乙》.txt").unlink()
    (root / "《乙》新.txt").write_text("第一章 a\n" + "y" * 150)  # a shorter edition leaves no chapter behind
    streams.ingest_library(spark, str(root), table, check).awaitTermination()
    assert count() == [("乙", 2), ("甲", 1)]  # what is gone when it is read counts as empty, told or not


def test_changes_of_a_library(spark, tmp_path):
    import json

    from textkb.streaming import streams

    root, table, check, log = tmp_path / "lib", str(tmp_path / "chapters"), str(tmp_path / "check"), tmp_path / "log"
    root.mkdir()
    log.mkdir()
    body = lambda c, n=1: "\n".join(f"第{i + 1}章 {c}\n" + c * 150 for i in range(n))
    one, two, other = root / "《甲》[番外]一.txt", root / "《甲》[番外]二.txt", root / "《乙》.txt"
    one.write_text(body("a"))
    two.write_text(body("b"))
    other.write_text(body("c", 2))

    def told(*changes):
        (log / f"{len(list(log.iterdir()))}.json").write_text("\n".join(json.dumps({"path": p and f"file:{p}", "op": op, "digest": d, "at": at}) for p, op, d, at in changes))

    def run():
        streams.ingest_library(spark, str(root), table, check, str(log)).awaitTermination()
        rows = spark.read.parquet(table).select("book_name", F.substring("text", 1, 1).alias("c"), "seq").collect()
        return {b: "".join(sorted(r["c"] for r in rows if r["book_name"] == b)) for b in {r["book_name"] for r in rows}}, {r["book_name"]: r["seq"] for r in rows}

    assert run()[0] == {"甲[番外]": "ab", "乙": "cc"}
    two.write_text(body("d", 2))  # changed in place: only the log tells
    told((two, "put", "v2", "2100-01-01T00:00:00Z"))
    first, seqs = run()
    assert first == {"甲[番外]": "add", "乙": "cc"}
    told((two, "put", "v2", "2100-01-01T00:00:01Z"), (other, "put", "old", "1990-01-01T00:00:00Z"), (root / "《丙》.txt", "delete", None, "2100-01-01T00:00:00Z"))
    assert run() == (first, seqs)  # replayed, outdated and unknown changes rebuild nothing
    one.unlink()
    told((one, "delete", None, "2100-01-02T00:00:00Z"))
    assert run()[0] == {"甲[番外]": "dd", "乙": "cc"}
    two.unlink()
    told((two, "delete", None, "2100-01-02T00:00:00Z"), (None, "put", "x", "2100-01-02T00:00:00Z"))
    assert run()[0] == {"乙": "cc"}


def test_monitor_stream_equals_batch(spark, tmp_path):
    from textkb.streaming import streams

    src = "/root/testdata/sf0.001/events.parquet"
    pytest.importorskip("pyarrow")
    (tmp_path / "in").mkdir()
    shutil.copy(src, tmp_path / "in" / "a.parquet")
    events = spark.read.parquet(src)
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    q = streams.monitor(spark, str(tmp_path / "in"), schema).writeStream.format("memory").queryName("monitor").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r["start"]), r["event_type"], r["searches"])
    assert sorted(map(key, spark.table("monitor").collect())) == sorted(map(key, streams.windowed_counts(events).collect()))


def test_upsert_polarities(spark):
    rows = spark.createDataFrame([("k", 0, 0, "a"), ("k", 0, 1, "b"), ("k", 0, 2, "c"), ("k", 1, 0, "d"), ("k", 1, 1, "e")], "id string, batch int, seq int, v string")
    assert upsert.replaced(rows, "id", "batch", "seq").first()["v"] == "e"
    assert upsert.ignored(rows, "id", "batch", "seq").first()["v"] == "a"
    assert upsert.vector_upserted(rows, "id", "batch", "seq").first()["v"] == "d"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "b", 0, "old"), ("2", "c", 0, "kept")], "id string, book_name string, seq int, v string")
    path = str(tmp_path / "t")
    for _ in range(2):  # twice is once
        sinks.write_replace(rows, path)
    sinks.write_replace(rows.where("id = '1'").withColumn("v", F.lit("new")), path)
    assert {r["id"]: r["v"] for r in L.saved_table(spark, path).collect()} == {"1": "new", "2": "kept"}
    sinks.write_ignore(rows.withColumn("v", F.lit("late")), path)
    assert {r["v"] for r in L.saved_table(spark, path, "c").collect()} == {"kept"}
    log = spark.createDataFrame([("q" * 600,)], "query_text string")
    sinks.append_log(log, str(tmp_path / "log"))
    assert len(spark.read.parquet(str(tmp_path / "log")).first()["query_text"]) == 500
    vectors = rows.withColumn("collection", F.lit("x")).withColumn("batch", F.lit(0))
    other = vectors.withColumn("collection", F.lit("y"))
    sinks.write_vectors(vectors.unionByName(other.withColumn("id", F.concat(F.lit("y"), "id"))), str(tmp_path / "v"))
    sinks.write_vectors(vectors.where("id = '1'").withColumn("v", F.lit("again")), str(tmp_path / "v"))
    assert {r["id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"1": "again", "2": "kept", "y1": "old", "y2": "kept"}
    logged = sinks.search_log(spark.createDataFrame([("q",), ("q",)], "query_text string")).collect()
    assert len({r["id"] for r in logged}) == 2
    nodes = spark.createDataFrame([("n", {"a": "x\x07", "b": None})], "node_id string, attrs map<string,string>")
    sinks.write_graph(nodes, nodes, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).first()["attrs"] == {"a": "x", "b": ""}
    sinks.write_rejects(rows, str(tmp_path / "r"))
    assert sinks.peek(spark, {"t": rows})[0][1] == 2
    (tmp_path / "lex.json").write_text('{"banned_words": {"items": [{"word": "仿佛", "reason": "r", "replace_hint": "h"}]}}')
    words = L.lexicon(spark, str(tmp_path / "lex.json"))
    docs = spark.createDataFrame([(1, "仿佛仿佛"), (2, "x")], "doc_id long, text string")
    assert [tuple(r) for r in lexicon.lexicon_counts(docs, words).select("doc_id", "word", "hits").collect()] == [(1, "仿佛", 2)]


def test_responses(spark):
    good = '{"scene_type":"t","narrative_skills":[{"skill_name":"a","analysis":"s"},{"skill_name":" "},{"skill_name":"a","analysis":"u"}, 5]}'
    rows = [("b", "c", 0, good), ("b", "c", 1, f"Sure!\n```json\n{good}\n```"), ("b", "d", 2, '{"narrative_skills": [{'), ("b", "e", 3, '{"other": 1}'), ("b", "f", 4, None)]
    df = spark.createDataFrame(rows, "book_name string, chapter_id string, seq int, response string").withColumn("category", F.lit("x"))
    got = ingest.ingest(df, ingest.KINDS["skills"]).collect()
    assert [(r["skill_name"], r["scene_type"], r["analysis"], r["seq"]) for r in got] == [("a", "t", "u", 1)]
    assert sorted(r["seq"] for r in ingest.rejects(df).collect()) == [2, 4]


def test_scalars(spark):
    assert one(spark, T.is_mojibake, "êé") is True and one(spark, T.is_mojibake, "cafe") is False
    assert one(spark, T.dialogue, "“x\ny” 「z」 “open") == ["x\ny", "z"]
    assert one(spark, T.chapter_number, "第12章 3") == 12 and one(spark, T.chapter_number, "序") == 9999
    assert one(spark, lambda c: T.joined_known(c), ["a", "", "未知", "b"], "array<string>") == "a,b"
    assert one(spark, T.scalar_items, '["a", {"x": 1}, null, 2]') == ["a", "2"] and one(spark, T.scalar_items, '{"a": 1}') == []
    assert one(spark, quotes.nfkc, "ＡＢＣ１") == "ABC1"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    walk = lambda depth, way: {(r["node"], r["depth"]) for r in graph.neighbourhood(edges, start, depth, way).collect()}
    assert walk(1, "out") == {("a", 0), ("b", 1), ("c", 1)} and walk(3, "out") == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert walk(2, "in") == {("a", 0), ("d", 1), ("b", 2), ("c", 2)} and walk(1, "both") == {("a", 0), ("b", 1), ("c", 1), ("d", 1)}
    assert graph.neighbourhood(edges, spark.createDataFrame([("zzz",)], "node string"), 2).count() == 1
    chain = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(60)], "src string, dst string")
    comps = {r["node"]: r["component"] for r in graph.weak_components(edges.unionByName(chain)).collect()}
    assert {comps[n] for n in "abcde"} == {"a"} and comps["y"] == "x" and {v for k, v in comps.items() if k.isdigit()} == {"0000"}


def test_graph_stats_by_plain_search(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(40):02d}", f"n{r.randrange(40):02d}") for _ in range(25)]
    nodes = [(f"n{i:02d}", "ab"[i % 2], ["x", "x|y ", "", " z| "][i % 4]) for i in range(42)]
    near, seen, sizes = {n: set() for n, *_ in nodes}, set(), []
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in near:
        if n not in seen:
            todo, size = [n], 0
            seen.add(n)
            while todo:
                size += 1
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            sizes.append(size)
    got = {(x["measure"], x["name"]): x["value"] for x in graph.graph_stats(spark.createDataFrame(nodes, "node_id string, node_type string, book_list string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    books = [b.strip() for *_, bs in nodes for b in bs.split("|") if b.strip()]
    want = {("nodes", ""): 42, ("edges", ""): 25, ("components", ""): len(sizes), ("largest component", ""): max(sizes), ("nodes by type", "a"): 21, ("nodes by type", "b"): 21}
    assert got == want | {("nodes by book", b): books.count(b) for b in set(books)}


def test_plot_lines_and_documents(spark):
    from textkb.operators import search

    lines = spark.createDataFrame([("b", "main", "t", "1-9"), ("b", "main", "t", "1-9"), ("b", None, " ", "")], "book_name string, line_type string, theme string, chapter_distribution string")
    assert {r["node_id"] for r in graph.plot_line_nodes(lines).collect()} == {"plot:b:main:t", "plot:b:unknown:unknown"}
    assert set(search.TEMPLATES) >= {"skills", "world_settings", "story_events"}
    event = spark.createDataFrame([("夺剑", None, "高潮", '["甲","乙"]', "high")], "event_name string, event_summary string, event_type string, characters_involved string, significance string")
    assert search.documents(event, "story_events").first()["document"] == "事件:夺剑\n摘要:\n类型:高潮\n角色:甲,乙\n重要性:high"
    assert one(spark, lambda c: search.query_text(c, F.lit("needs"), 3), "abcdef") == "needs abc"


def test_carried_state(spark):
    rows = spark.createDataFrame([("b", i, s, f) for i, (s, f) in enumerate([("a", False), ("x", True), ("x", True), ("b", False), ("x", True), ("c", False)])], "book_name string, seq int, state string, failed boolean")
    got = [r["state_before"] for r in relate.carried_state(rows, "state", "failed", F.lit("0")).orderBy("seq").collect()]
    assert got == ["0", "a", "a", "0", "b", "b"]


def test_views_reject_unknown_parameters(spark):
    t = spark.createDataFrame([("1", "b", "e")], "id string, book_name string, event_name string")
    with pytest.raises(ValueError):
        views.view({"world_timeline": t}, "worldbuilding_timeline", nope=1)


def test_top_k_of_many_queries_stays_off_the_driver(spark, monkeypatch):
    from textkb.operators import search

    r = random.Random(3)
    vectors = [(i, "ab"[i % 2], [float(r.randrange(4)) for _ in range(3)]) for i in range(60)]
    queries = [(i, [float(r.randrange(4)) for _ in range(3)]) for i in range(search.FEW + 50)]
    v, q = spark.createDataFrame(vectors, "id long, kind string, embedding array<float>"), spark.createDataFrame(queries, "query_id long, query array<float>")
    with monkeypatch.context() as m:
        for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
            plain = getattr(type(q), name)
            m.setattr(type(q), name, lambda self, *a, f=plain: pytest.fail("the query set passes through the driver") if {"q", "query", "query_id", "query_row"} & set(self.columns) else f(self, *a))
        found = search.top_k_each(v, q, 2, ["kind"])
    got = sorted((x["query_id"], x["kind"], x["rank"], x["id"]) for x in found.collect())
    want = []
    for i, a in queries:
        for kind in "ab":
            near = sorted((sum((x - y) ** 2 for x, y in zip(a, e, strict=True)), j) for j, c, e in vectors if c == kind)
            want += [(i, kind, n + 1, j) for n, (_, j) in enumerate(near[:2])]
    assert got == sorted(want) and found.columns == ["id", "kind", "embedding", "query_id", "distance", "rank"]


def test_quote_positions_without_wide_blanks(spark):
    rows = [("天地玄黄", "第一章\u3000天地\u3000玄黄"), ("天地", "天地"), ("", "x"), (None, "x"), ("x", None), ("洪荒", "天地"), ("a\u3000b", " \n a b")]
    df = spark.createDataFrame(rows, "q string, t string")
    assert [(r["level"], r["position"]) for r in quotes.positions(df, "q", "t").collect()] == [("spaces", 4), ("exact", 0), ("none", -1), ("none", -1), ("none", -1), ("none", -1), ("spaces", 3)]


def test_unverified_quotes_in_another_unicode_form(spark):
    rows = [("ＡＢＣ１２３ＤＥＦ", "so abc ABC123DEF end"), ("cafe\u0301 au lait", "un café au lait"), ("ABC123DEF", "x ＡＢＣ１２３\nＤＥＦ"), ("ＡＢＣ１２３ＤＥＧ", "so ABC123DEF end"), ("ＡＢ", "so"), (None, "so")]
    df = spark.createDataFrame(rows, "q string, t string")
    found = {(r["q"], r["t"]): r["unverified"] for r in quotes.unverified(df, "q", "t").collect()}
    assert [found[r["q"], r["t"]] for r in df.collect()] == [False, False, False, True, False, None]


def test_fuzzy_matches_equal_brute_force(spark):
    import re

    r = random.Random(11)
    pool = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 12))) for _ in range(60)]
    sentence = lambda: " ".join(r.choice(pool) for _ in range(r.randrange(2, 9))) + "."
    texts, quotes_ = [], []
    for i in range(12):
        parts = [sentence() + " " for _ in range(10)]
        texts.append((i, "".join(parts)))
        for share in (0.0, 0.08, 0.14, 0.2):
            a = r.randrange(8)
            c = list("".join(parts[a : a + r.randrange(1, 3)]).strip())
            step = int(1 / share) if share else len(c) + 1
            for at in range(step - 1, len(c), step):  # evenly spread: every long word is touched
                c[at] = "Z"
            quotes_.append((len(quotes_), "".join(c)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    want = {}
    for doc, text in texts:
        s = re.split(r"(?<=[.])", text)
        for no in range(len(s)):
            for span in {"".join(s[no : no + n]).strip(" ") for n in range(1, 9)}:
                for q, quote in quotes_:
                    if abs(len(span) - len(quote)) <= len(quote) * (1 - 0.85):
                        ratio = round(1 - distance(span, quote) / max(len(span), len(quote)), 4)
                        if ratio >= 0.85:
                            want[q, doc] = max(want.get((q, doc), (0, 0)), (ratio, -no))
    found = fuzzy.fuzzy_matches(spark.createDataFrame(quotes_, "quote_id long, quote string"), spark.createDataFrame(texts, "doc_id long, text string"), "doc_id").collect()
    assert {(x["quote_id"], x["doc_id"]): -x["sentence"] for x in found} == {k: v[1] for k, v in want.items()} and len(want) >= 30
    assert all(abs(float(x["ratio"]) - want[x["quote_id"], x["doc_id"]][0]) < 2e-4 for x in found)


def test_fuzzy_matches_of_odd_quotes(spark):
    kanji = "月光落在长长的石桥上，他没有回头；只听见身后的脚步声越来越近。"
    texts = [(1, f"第一句。{kanji}最后一句。"), (2, None), (3, ""), (4, "   \n. " + kanji.replace("石桥", "木桥")), (4, kanji), (5, "x" * 300_000 + ".The quick brown fox jumps over the lazy dog." + "y" * 1000)]
    quotes_ = [("a", kanji), ("b", ""), ("c", None), ("d", "the quick brown fox jumps over the lazy dog."), ("e", "他"), ("e", "他"), ("f", "第一句。")]
    found = fuzzy.fuzzy_matches(spark.createDataFrame(quotes_, "quote_id string, quote string"), spark.createDataFrame(texts, "doc_id long, text string"), "doc_id")
    got = {(r["quote_id"], r["doc_id"]): (round(float(r["ratio"]), 3), r["sentence"], r["position"]) for r in found.collect()}
    assert got == {("a", 1): (1.0, 1, 4), ("a", 4): (1.0, 0, 0), ("d", 5): (0.977, 1, 300_001), ("f", 1): (1.0, 0, 0)}
    assert fuzzy.fuzzy_matches(found.select("quote_id", F.lit("x").alias("quote")).limit(0), spark.createDataFrame(texts, "doc_id long, text string"), "doc_id").count() == 0


def test_located_at_three_levels(spark):
    text = "One here. Two quick brown foxes jump over a lazy dog. Three there."
    rows = [(1, "Two quick", text), (2, "Twoquick", text), (3, "Two quick brawn foxes jumped over a lazy dog.", text), (4, "Nothing of the kind stands in it.", text), (5, None, text), (6, "Two", None), (7, "", "")]
    got = {r["i"]: (r["level"], r["position"]) for r in quotes.located(spark.createDataFrame(rows, "i long, q string, t string"), "q", "t").collect()}
    assert got == {1: ("exact", 10), 2: ("spaces", 10), 3: ("fuzzy", 10), 4: ("none", -1), 5: ("none", -1), 6: ("none", -1), 7: ("none", -1)}


def test_words_of_a_table_equal_a_plain_count(spark):
    r = random.Random(7)
    texts = [(i, "".join(r.choice("abc ") for _ in range(r.randrange(0, 400)))) for i in range(40)] + [(50, None), (51, ""), (7, "aaaa")]
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(300)})
    table = spark.createDataFrame([(w, f"r{w}", "h") for w in words] + [("aa", "zz", "h"), ("", "x", "h"), (None, "x", "h")], "word string, reason string, hint string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = sorted(tuple(x) for x in lexicon.lexicon_counts(docs, table).collect())
    reason = {w: f"r{w}" for w in words} | ({"aa": min("raa", "zz")} if "aa" in words else {"aa": "zz"})
    assert got == sorted((i, w, t.count(w), t.find(w), reason[w], "h") for i, t in texts if t for w in reason if w in t)
    assert lexicon.lexicon_counts(docs, table.limit(0)).count() == 0


def test_names_of_a_books_own_cast(spark):
    texts = spark.createDataFrame([("a", 1, "Ann met Bo and Ann"), ("a", 1, "Ann"), ("b", 2, "Ann met Bo"), (None, 3, "Ann"), ("c", 4, "Ann"), ("a", 5, None)], "book_name string, doc_id long, text string")
    cast = spark.createDataFrame([("a", "Ann"), ("a", "Ann"), ("a", "An"), ("b", "Bo"), ("b", ""), (None, "Ann"), ("d", "Bo")], "book_name string, name string")
    found = lexicon.mentions(texts, cast, "doc_id")
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, "An", 1, 0), ("a", 1, "An", 2, 0), ("a", 1, "Ann", 1, 0), ("a", 1, "Ann", 2, 0), ("b", 2, "Bo", 1, 8)]
    assert {tuple(r) for r in lexicon.frequencies(found).collect()} == {("a", "An", 2, 3), ("a", "Ann", 2, 3), ("b", "Bo", 1, 1)}


def test_components_grow_with_batches(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(200)}", f"n{r.randrange(200)}") for _ in range(150)] + [("a", "a"), (None, "b"), ("n1", None)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    whole = {(x["node"], x["component"]) for x in graph.weak_components(frame(edges)).collect()}
    labels = graph.weak_components(frame(edges[:50]))
    for part in (edges[50:100], edges[100:], [], edges[:10]):
        labels = graph.extended_components(labels, frame(part))
    assert {(x["node"], x["component"]) for x in labels.collect()} == whole


def test_points_in_intervals_equal_every_pair(spark):
    r = random.Random(5)
    points = [(r.choice("ab"), r.randrange(-50, 5000)) for _ in range(300)] + [(None, 5), ("a", None), ("a", 7), ("a", 7)]
    spans = [(r.choice("abc"), s, s + r.choice((1, 2, 3, 17, 64, 1000, 5000))) for s in (r.randrange(-60, 4000) for _ in range(80))] + [("a", 7, 7), ("a", 9, 3), (None, 0, 9), ("a", None, 9), ("b", 0, 4096), ("b", 0, 4096)]
    got = relate.within(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, "k string, s long, e long"), ["k"], "at", "s", "e")
    want = [(k, p, s, e) for k, p in points for j, s, e in spans if k is not None and k == j and p is not None and s is not None and s <= p < e]
    assert sorted((x["k"], x["at"], x["s"], x["e"]) for x in got.collect()) == sorted(want) and len(want) > 300
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert relate.within(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame([], "k string, s long, e long"), ["k"], "at", "s", "e").count() == 0


def test_like_knows_no_escape_and_folds_ascii_only(spark):
    df = spark.createDataFrame([(1, "a\\b"), (2, "É"), (3, "é"), (4, "A%b"), (5, "aXb"), (6, None), (7, "K\u212a")], "i long, v string")
    found = lambda v: [r["i"] for r in search.like(df, "v", v).orderBy("i").collect()]
    assert found("a\\b") == [1] and found("a\\") == [1] and found("é") == [3] and found("É") == [2]
    assert found("a%B") == [1, 4, 5] and found("a_b") == [1, 4, 5] and found("k") == [7] and found("") == [1, 2, 3, 4, 5, 6, 7]


def test_views_in_their_order_and_with_their_parameters(spark):
    m = spark.createDataFrame([("a", "对话", "x", 1), ("b", "节奏", "y", 9), ("c", "对话", "z", 9), ("d", "对话", "z", None)], "id string, dimension string, mistake_name string, frequency int")
    ids = lambda name, t, **p: [r["id"] for r in views.view({views.VIEWS[name].table: t}, name, **p).collect()]
    assert ids("mistakes", m) == ["b", "c", "a", "d"] and ids("mistakes", m, dimension="对", mistake_name="Z") == ["c", "d"]
    e = spark.createDataFrame([("a", "k", "第10章"), ("b", "k", "第2章"), ("c", "k", "序"), ("d", "k", "第2章 乙"), ("e", "j", "第3章")], "id string, book_name string, chapter_id string")
    e = e.withColumn("event_type", F.lit("x")).withColumn("significance", F.lit("high"))
    assert ids("events", e, book_name="k") == ["b", "d", "a", "c"] and ids("events", e, chapter_range="2-3") == ["b", "d", "e"] and ids("events", e, chapter_range="x-3") == ["b", "d", "e", "a", "c"]
    rel = spark.createDataFrame([("a", "甲", "乙"), ("b", "乙", "丙"), ("c", "丙", "丁")], "id string, character_a string, character_b string").withColumn("book_name", F.lit("k"))
    assert ids("character_relationship", rel, character_a="乙", character_b="丙") == ["b"] and ids("character_relationship", rel, character_a="乙") == ["a", "b"]
    with pytest.raises(ValueError, match="query"):
        views.view({"common_mistakes": m}, "mistakes", query="x")


def test_evidence_of_scenes(spark):
    text = "original_text string, technique_analysis string"
    tables = {
        "climax_buildup_chains": spark.createDataFrame([("a", "k", "决战高潮", '["x","y"]', "up"), ("b", "k", "对话", None, None)], "id string, book_name string, climax_name string, buildup_steps_json string, tension_escalation string"),
        "climax_excerpts": spark.createDataFrame([(f"e{i:02}", "k", "高潮", "t" * 400, "x") for i in range(30)], f"id string, book_name string, excerpt_type string, {text}"),
        "dialogue_samples": spark.createDataFrame([("d", "k", "闲谈", "t", "s", "f")], "id string, book_name string, scene_type string, original_text string, subtext string, plot_function string"),
        "description_samples": spark.createDataFrame([], f"id string, book_name string, description_type string, sensory_details string, {text}"),
        "action_scene_samples": spark.createDataFrame([("x", "k", "剑", "t", "a", "p")], f"id string, book_name string, action_type string, {text}, pacing_analysis string"),
        "skills": spark.createDataFrame([(f"s{i:02}", "k", "高潮场景", "n", "a", None) for i in range(15)], "id string, book_name string, scene_type string, skill_name string, analysis string, original_example string"),
    }
    rows = digests.scene_evidence(tables).orderBy("scene_type", "place").collect()
    assert [(r["scene_type"], r["type"]) for r in rows if r["scene_type"] != "高潮"] == [("对话", "dialogue"), ("打斗", "action")]
    climax = [r for r in rows if r["scene_type"] == "高潮"]
    assert [r["type"] for r in climax] == ["buildup_chain"] + ["excerpt"] * 10 + ["skill"] * 9 and [r["place"] for r in climax] == list(range(1, 21))
    assert climax[0]["more"] == "2" and len(climax[1]["text"]) == 300 and climax[-1]["text"] == ""


def test_tables_without_what_they_need_are_rebuilt(spark, tmp_path):
    schema = "id string, chapter_id string, writing_quality int"
    path = lambda n: str(tmp_path / n)
    spark.range(3).select(F.col("id").cast("string")).write.parquet(path("old"))
    spark.createDataFrame([("a", "c")], "id string, chapter_id string").write.parquet(path("kept"))
    assert upsert.rebuilt(spark, path("old"), "dialogue_samples", schema).count() == 0 and upsert.rebuilt(spark, path("none"), "plot_lines", schema).count() == 0
    assert spark.read.parquet(path("old")).columns == ["id", "chapter_id", "writing_quality"]
    assert [tuple(r) for r in upsert.rebuilt(spark, path("kept"), "dialogue_samples", schema).collect()] == [("a", "c", 5)]
    assert upsert.rebuilt(spark, path("kept"), "plot_lines", "id string").columns == ["id", "chapter_id"]


def test_nearest_by_pivots_equals_every_pair(spark):
    import numpy as np

    g = np.random.default_rng(3)
    x = np.round(np.concatenate([c + g.normal(0, 0.05, (60, 6)) for c in g.normal(0, 1, (8, 6))]), 3)
    x[40] = x[41]
    rows = [(i, v.tolist(), f"g{i % 3}" if i % 7 else None) for i, v in enumerate(x)]
    odd = [(900, None, "g0"), (901, [], "g0"), (902, [1.0] * 5, "g0"), (903, [None] * 6, "g0"), (904, [float("nan")] * 6, "g0"), (5, x[5].tolist(), "g1")]
    vectors = spark.createDataFrame(rows + odd, "id long, embedding array<double>, kind string")
    queries = spark.createDataFrame([(i, v) for i, v, _ in rows[::9]] + [(1, None), (2, [0.0] * 6)], "query_id long, query array<double>")
    every = rows + odd[-1:]
    for by in ((), ("kind",)):
        got = {}
        for r in pivots.nearest_each(vectors, queries, 4, by).collect():
            got.setdefault((r["query_id"], r["kind"] if by else 0), []).append((r["rank"], round(r["distance"], 9), r["id"]))
        want = {}
        for q, v in [(i, v) for i, v, _ in rows[::9]] + [(2, [0.0] * 6)]:
            for kind in {k for *_, k in every} if by else {0}:
                near = sorted((round(sum((a - b) ** 2 for a, b in zip(e, v, strict=True)), 9), i) for i, e, k in every if not by or k == kind)[:4]
                want[q, kind] = [(n, d, i) for n, (d, i) in enumerate(near, 1)]
        assert {k: sorted(v) for k, v in got.items()} == want
    scored = pivots.nearest_each(vectors, queries, 4, scored=True).agg(F.sum("pairs")).first()[0]
    assert scored < 0.5 * len(every) * (len(rows[::9]) + 1)
    assert pivots.nearest_each(vectors.limit(0), queries, 4).count() == pivots.nearest_each(vectors, queries.limit(0), 4).count() == 0


def test_trigram_index_reads_fewer_files_and_finds_the_same(spark, tmp_path):
    r = random.Random(9)
    saved, index = str(tmp_path / "t"), str(tmp_path / "i")
    rows = [(i, f"p[{i % 12}] é:", " ".join(r.choice(("alpha", "beta", "Ünïcode", "é", "100%")) for _ in range(30)) + (f" Needle{i % 12}Hay" if i % 12 < 3 else "")) for i in range(200)] + [(900, "p[3] é:", None), (901, None, "x")]
    spark.createDataFrame(rows, "i long, part string, v string").repartition(3).write.partitionBy("part").parquet(saved)
    textindex.build(spark.read.parquet(saved), ["v"], index)
    whole = spark.read.parquet(saved)
    for value in ("needle1hay", "NEEDLE", "le2", "é", "al%ta", "_100\\%", "Ünï", "nowhere", "", "x", "dle_H"):
        got = sorted(tuple(x) for x in textindex.like(spark, saved, index, ["v"], value).collect())
        assert got == sorted(tuple(x) for x in search.like(whole, "v", value).collect()), value
    every = len(whole.inputFiles())
    assert 0 < len(textindex.files(spark, saved, index, "needle1hay")) <= every // 6 and textindex.files(spark, saved, index, "nowhere") == []
    spark.createDataFrame([(999, "p5", "needle7")], "i long, part string, v string").write.mode("append").partitionBy("part").parquet(saved)  # not indexed
    assert [x["i"] for x in textindex.like(spark, saved, index, ["v"], "needle7").collect()] == [999]


def test_slices_equal_a_scan_of_every_place(spark):
    """The definition, place by place: which kind of cut may stand behind each character."""

    def cut(region):
        kinds = {}
        for i in range(max(len(region) // 3, 100), len(region)):
            last3 = region[i - 2 : i + 1]
            if last3 in ("...", "---", "***") or last3[1:] == "\n\n":
                kinds[2] = i + 1
            elif last3[2:] == "\n" and last3[0] in "”\"。！？.!?":
                kinds[3] = i + 1
            elif last3[2:] == "\n" and last3[1] in "。！？.!?":
                kinds[4] = i + 1
        return kinds[min(kinds)] if kinds else len(region)

    def slices(text, size, overlap):
        out, at = [], 0
        while at < len(text):
            end = at + cut(text[at : at + size])
            out.append(text[at:end].strip())
            if end >= len(text):
                break
            at = end if len(text) - max(end - overlap, 0) <= size else max(end - overlap, 0)
        return [x for x in out if len(x) > 200]

    r = random.Random(6)
    for n in range(60):
        marks = ["字", "x", " ", "\n", "\n\n", "。\n", "”\n", "。”\n", "...", "---", "!a\n", "……"]
        weights = [40, 40, 5, 1, 0.3, 0.5, 0.5, 0.5, 0.1, 0.1, 0.5, 0.2] if n % 3 else [50, 50, 1, 0.1, 0, 0.1, 0, 0.1, 0, 0, 0.1, 0]
        text = "".join(r.choices(marks, weights, k=r.randrange(300, 6000)))
        for size, overlap in ((700, 50), (1500, 200), (400, 0)):
            assert C.semantic_slices(text, size, overlap) == slices(text, size, overlap)
    C.register(spark)
    rows = [(str(i), 0, f"第{i}章", "".join(r.choices(["字", "。\n", "\n\n"], [60, 1, 0.2], k=n))) for i, n in enumerate((100, 5000, 5001, 30_000))] + [("9", 0, "x", None), ("8", 0, "x", "")]
    spark.createDataFrame(rows, "key string, chapter_idx int, chapter_id string, text string").repartition(3).createOrReplaceTempView("long_chapters")
    got = sorted((x["key"], x["slice_no"], x["chapter_id"], x["text"]) for x in spark.sql("SELECT * FROM text_slices(TABLE(long_chapters))").collect())
    want = []
    for k, _, name, t in rows[:4]:
        want += [(k, n, f"{name}_{n}", p) for n, p in enumerate(slices(t, 5000, 200), 1)] if len(t) > 5000 else [(k, 0, name, t)]
    assert got == sorted(want)
    assert sorted(x["text"] for x in spark.sql("SELECT * FROM text_slices(TABLE(long_chapters) PARTITION BY key)").collect()) == sorted(x[3] for x in want)
