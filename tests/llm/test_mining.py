"""Hard negatives, quality rules and collocations on small odd inputs, each against a plain restatement."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("textkb.llm")
from textkb.llm import collocations, hard_negatives, quality, quality_rules  # noqa: E402

from . import brute  # noqa: E402

# --- 11 ------------------------------------------------------------------------------------------------


def mined(rows, every=50):
    """All rows of the definition, by scoring every pair."""
    use = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    late = lambda i: (i is None, i)
    out = []
    for a, (i, label, v) in enumerate(use):
        if i is None or i % every:
            continue
        met = [(-sum(x * y for x, y in zip(v, w, strict=False)), late(j), m == label, j) for b, (j, m, w) in enumerate(use) if a != b]
        met.sort(key=lambda x: x[:2])
        for s, _, _, p in [x for x in met if x[2]][:5]:
            fits = [(j, -t) for t, _, same, j in met if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, n, j, -s, t) for n, (j, t) in enumerate(fits, 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, "x") for i, label, v in rows], "vec_id long, label int, embedding array<double>, rows string")


def found(df):
    return [tuple(r) for r in df.collect()]


by_text = lambda rows: sorted(rows, key=repr)


def test_hard_negatives_equal_every_pair(spark):
    g = np.random.default_rng(1)
    base = g.normal(0, 1, 19)
    rows = [(i, int(g.integers(0, 3)), (base + g.normal(0, 0.8, 19)).round(2).tolist()) for i in range(320)]
    rows += [(None, 1, rows[3][2]), (50, 2, rows[60][2]), (50, 2, rows[60][2]), (500, None, rows[0][2]), (550, 1, None), (600, 1, [None] * 19), (650, 1, [float("inf")] * 19)]
    rows += [(700, 1, rows[0][2][:11]), (750, 2, []), (800, 1, [0.0] * 19), (-50, 1, rows[7][2]), (850, -3, rows[9][2]), (900, 9, (np.array(rows[4][2]) * 900).tolist())]
    want = mined(rows)
    assert by_text(found(hard_negatives.mine(vectors(spark, rows)))) == by_text(want) and len(want) > 60
    assert found(hard_negatives.mine(vectors(spark, rows[:1]))) == found(hard_negatives.mine(vectors(spark, rows).limit(0))) == []


def test_hard_negatives_in_many_blocks_and_strips(spark, monkeypatch):
    g = np.random.default_rng(2)
    rows = [(i, 0 if i % 3 == 0 else int(g.integers(0, 4)), (1 + g.normal(0, 0.5, 5)).round(1).tolist()) for i in range(2500)]
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 5 * 64)
    monkeypatch.setattr(hard_negatives, "STRIP", 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 32)
    assert by_text(found(hard_negatives.mine(vectors(spark, rows), 10))) == by_text(mined(rows, 10))


def test_subset_sum_scores_are_inner_products():
    g = np.random.default_rng(4)
    for low, high, dim in ((-300, 300, 64), (-1, 1, 8), (0, 1, 3), (-(1 << 24), 1 << 24, 21), (5, 6, 9)):
        a, c = g.integers(low, high, (7, dim)).astype(np.int32), g.integers(low, high, (50, dim)).astype(np.int32)
        got = hard_negatives.score(hard_negatives.subset_sums(a, np.int64), hard_negatives.bit_planes(c))
        assert (got == c.astype(np.int64) @ a.astype(np.int64).T).all()


# --- 12 ------------------------------------------------------------------------------------------------


def measured(text):
    text = text or ""
    w = brute.WORD.findall(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x, n in collections.Counter(windows).items() if n > 1}
    repeated = len({i + k for i, x in enumerate(windows) if x in many for k in range(3)})
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated


def odd_texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé🙂") for _ in range(r.randrange(1, 9)))
    prose = " ".join(word() for _ in range(80))
    return [
        None, "", " \t\n\x0b\f\r", prose, prose, " ".join(word() for _ in range(49)), " ".join(word() for _ in range(50)), prose + " " + prose, "a b c a b c", "x " * 60, "a b c d " * 20 + prose,
        prose.upper(), "# * $ % & | < > " * 10 + prose, "\n".join([prose] * 3), "\n".join(f"- {word()} {word()}" for _ in range(40)), "\n".join(f"{word()} {word()}…" for _ in range(40)),
        "12 34 56 78 90 " * 3 + " ".join(str(i) for i in range(60)), " nbsp stays " + prose, "w" * 100_000 + " " + prose, " ".join(word() for _ in range(30_000)),
    ]


def test_quality_rules_on_odd_texts(spark):
    texts = odd_texts()
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, failed_rule string")
    got = {r["doc_id"]: r for r in quality_rules.measured(docs).collect()}
    for i, t, *_ in rows:
        n, chars, symbols, dup, repeated = measured(t)
        base = n < 50 or 100 * repeated > 50 * n
        assert tuple(got[i])[1:7] == (n, chars, symbols, dup, repeated, base), t and t[:40]
        assert not (base and got[i]["kept"])
    kept = {i for i, r in got.items() if r["kept"]}
    assert {3, 4, 6, 19} <= kept and not kept & {11, 12, 14, 15, 16, 18}
    stays = quality_rules.keep(docs)
    assert {r["doc_id"] for r in stays.collect()} == kept and stays.columns == docs.columns
    told = quality_rules.judge(docs)
    assert told.columns == [*docs.columns, "failed_rule_"] and {r["doc_id"] for r in told.collect() if r["failed_rule_"] is None} == kept
    assert quality_rules.measured(docs.limit(0)).count() == quality_rules.judge(docs.limit(0)).count() == 0


def test_the_order_of_rules_is_greedy_and_changes_nothing(spark):
    rules = quality_rules.RULES[:3]
    a, b, c = rules
    # a rejects most, but what it rejects beyond b is little; c is cheap.
    masks = {0b000: 10, 0b011: 50, 0b001: 5, 0b100: 20}
    assert quality_rules.greedy_order(rules, masks, {a.name: 1.0, b.name: 0.5, c.name: 0.1}) == [c, b, a]
    assert quality_rules.greedy_order(rules, masks, {a.name: 1.0, b.name: 1.0, c.name: 9.0}) == [a, c, b]
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    every = [*quality_rules.BASE, *quality_rules.RULES]
    verdict = lambda order: {r["doc_id"] for r in docs.where(quality_rules.failed_rule(order).isNull()).collect()}
    assert verdict(every) == verdict(every[::-1]) == {r["doc_id"] for r in quality_rules.keep(docs).collect()}


def test_quality_rules_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.measured(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 13 ------------------------------------------------------------------------------------------------


def collocated(rows, max_words=3, least=10, kept=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = collections.defaultdict(list)
    often = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    for (lang, p), a in often.items():
        if 100 * longer[lang, p] < 50 * a:
            score, _, x, y = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), x, y))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:kept], 1))


def prose(seed, n, words=60, marks=". , \n \t ! ;"):
    r = random.Random(seed)
    pool = [f"w{min(r.randrange(words), r.randrange(words))}" for _ in range(n)]
    return "".join(w + r.choice([" "] * 12 + marks.split(" ") + ["  ", "\t", ", "]) for w in pool)


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(5)


@pytest.mark.parametrize("capacity", [1 << 20, 300])
def test_collocations_equal_a_plain_count(spark, capacity, monkeypatch):
    monkeypatch.setattr(collocations, "COUNTED_AT_ONCE", 3000)
    rows = [(prose(i, 900), random.Random(i).choice(["en", "de", None])) for i in range(40)] + [(None, "en"), ("", "de"), ("  \t", "en"), (None, None), (prose(1, 900), "en"), (prose(1, 900).upper(), "en")]
    rows += [("É é École " * 30, "fr"), ("one two " * 4000, "hot"), ("x" * 50_000 + " y " * 30, "hot"), ("a.b.c" * 50, "hot")]
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(frame(spark, rows), capacity=capacity).collect()]
    want = collocated(rows)
    assert sorted(got) == want and len(want) > 300


def test_collocations_of_longer_phrases_and_of_nothing(spark):
    rows = [(prose(i, 400, words=8), "en") for i in range(6)]
    got = collocations.collocations(frame(spark, rows), max_words=4, least=5, kept=30)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == collocated(rows, 4, 5, 30)
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == collocations.collocations(frame(spark, [(None, None), ("", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 900_000_000_001
    counts = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 5), ("en", "a b", 2, big)], "lang string, phrase string, n_words int, f long")
    row = collocations.scored(counts).first()
    assert row["score"] == 1_000_000 * big * big // ((big + 7) * (big + 5)) and (row["l"], row["r"]) == (big + 7, big + 5)


def test_summaries_keep_every_frequent_item():
    r = np.random.default_rng(5)
    for capacity, least in ((400, 10), (50, 80), (2000, 3)):
        items = np.concatenate([np.repeat(r.integers(0, 1 << 60, 20), least), r.integers(0, 1 << 60, int(capacity * least * 0.95) - 20 * least)]).astype(np.uint64)
        r.shuffle(items)
        summary = collocations.Summary(capacity, least)
        for part in np.array_split(items, 13):
            known, counts = np.unique(part, return_counts=True)
            summary.merge([known], [counts])
            assert len(summary.items) <= capacity
        known, counts = np.unique(items, return_counts=True)
        assert set(known[counts >= least]) <= set(summary.survivors()) and 0 < summary.taken < least or least == 3


# --- 9 -------------------------------------------------------------------------------------------------


def test_quality_training_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("alpha beta gamma ### $$$ DELTA".split()) for _ in range(r.randrange(5, 90))) for _ in range(40)]
    rows = [(i, texts[i % 40], i % 2) for i in range(120)] + [(200 + i, texts[0], 1 - i % 2) for i in range(6)]  # equal texts, contradicting labels
    train = lambda rows, n: quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(n))
    one, two = train(rows, 1), train(rows[::-1], 7)
    assert one.shift == two.shift and all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


# --- 3, 7, 10: names that clash, ties, empty tables ------------------------------------------------------


def test_operators_ignore_columns_of_their_own_names(spark):
    from textkb.llm import nearest, secrets, warc

    key = "AKIA" + "".join(random.Random(1).choices(secrets.ALPHABETS[3], k=16))
    docs = spark.createDataFrame([(1, f"see {key} there", "a", "b", "c"), (1, f"see {key} there", "a", "b", "c"), (2, "plain", "a", "b", "c")], "doc_id long, text string, spans string, kind string, start string")
    rows = sorted((r["doc_id"], len(r["spans"])) for r in secrets.secret_spans(docs).collect())
    assert rows == [(1, 1), (1, 1), (2, 0)] and secrets.secret_spans(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "a", "b"), (2, "u", "x" * 2000, "a", "b")], "page_id long, url string, html string, payload string, digest string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == [(1, "response", None), (2, "revisit", 1)]
    v = spark.createDataFrame([(i, [1.0, float(i // 2)], "x", 1.0) for i in range(20, 30)], "vec_id long, embedding array<double>, row string, score double")
    got = [(r["rank"], r["vec_id"]) for r in nearest.nearest(v).orderBy("rank").collect()]
    assert got == list(enumerate([28, 29, 26, 27, 24, 25, 22, 23, 21], 1))


def test_the_whole_pipeline_is_its_stages(spark):
    import os

    import corpus_pipeline
    from textkb.llm.common import materialize, table

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder))
    told = lambda df: sorted((r["n_tokens"], tuple(r["doc_ids"]), bytes(r["ids"])) for r in df.collect())
    assert told(corpus_pipeline.run(spark, folder)) == told(docs) != []
