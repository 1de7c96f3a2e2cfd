"""Every registered query of the training-data operators on the small tables: columns, types and folds of the
contracts, SQL where there is some, and a plain restatement of the rest."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest

pytest.importorskip("textkb.llm")
from textkb.llm import decontamination, packing, registry  # noqa: E402

from . import brute  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def run(spark, name):
    return registry.QUERIES[name](spark, DIR)


def kinds(df, **want):
    assert df.dtypes[: len(want)] == list(want.items())
    return df.collect()


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_sql_gives_the_same_rows(spark, duck, name):
    got = run(spark, name)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_op1(spark, duck, texts):
    rows = kinds(run(spark, "op1_language_id"), doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    learned = {langs[i] for i in texts if not brute.held_out(i) and langs[i]}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned | {"und"} and (r["lang_pred"] == "und" or any(c.isalpha() for c in text))
        assert any(c.isalpha() for c in text) or r["lang_pred"] == "und"
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"] and langs[r["doc_id"]]]) >= 0.95


@pytest.mark.parametrize(("name", "column", "bar", "least"), [("op5_toxicity", "toxic", 0.5, 0.85), ("op9_quality", "quality", 0.3, 0.75)])
def test_scores(spark, duck, texts, name, column, bar, least):
    rows = kinds(run(spark, name), doc_id="bigint", held_out="boolean", score="double", predicted="int")
    labels = dict(duck.execute(f"SELECT doc_id, {column} FROM labels WHERE {column} IS NOT NULL").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bar) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]) >= least
    again = {r["doc_id"]: r["score"] for r in run(spark, name).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_op2(spark, texts):
    rows = run(spark, "op2_packing").collect()
    coder, segments = packing.Tokenizer(packing.read_vocabulary()), {}
    for r in rows:
        ids = np.frombuffer(r["ids"], coder.dtype)
        for k, (doc, at) in enumerate(zip(r["doc_ids"], r["doc_offsets"], strict=True)):
            segments.setdefault(doc, {})[at] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    assert set(segments) == {i for i, t in texts.items() if t}
    for doc, parts in segments.items():
        assert coder.encoding.decode(np.concatenate([parts[k] for k in sorted(parts)]).tolist()[:-1]) == texts[doc]


def test_op6(spark, duck, texts):
    rows = kinds(run(spark, "op6_decontamination"), doc_id="bigint", item_id="bigint")
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    items = dict(duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    flat = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip()
    exact = {(d, i) for d, t in texts.items() for i, item in items.items() if flat(item) in flat(t)}
    assert exact and exact <= found
    for r in rows:
        code = lambda t: decontamination.normalized(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0, len(t)]))[0]
        item = code(items[r["item_id"]])
        least = decontamination.best_substring(item, code(texts[r["doc_id"]]), len(item))[0]
        assert least == r["edits"] <= decontamination.MAX_EDITS * len(item)


def test_op7(spark, duck):
    rows = kinds(run(spark, "op7_nearest"), query_id="bigint", rank="int", vec_id="bigint", score="double")
    ids, x = map(np.array, zip(*duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall(), strict=True))
    hits, queries = 0, [i for i in ids if i % 20 == 0]
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == sorted(queries)
    for q, got in by.items():
        score = (x.astype(float) * x[ids == q][0].astype(float)).cumsum(axis=1)[:, -1]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(order) + 1)) and all(score[ids == r["vec_id"]][0] == r["score"] for r in got)
        hits += len({r["vec_id"] for r in got} & set(ids[order].tolist()))
    assert hits >= 0.9 * len(rows)


def test_op10(spark, texts):
    rows = kinds(run(spark, "op10_secret_scan"), doc_id="bigint", n_assign="bigint", n_access="bigint", n_hex="bigint", base_sha256="string", spans="string")
    names = "password passwd secret token api_key apikey".split()
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assignments(t):
        """The assignment rule, by hand: a name, a quote, blanks, a mark, blanks, a quote, the value."""
        out, at, low = [], 0, "".join(c.lower() if c.isascii() else c for c in t)
        while at < len(t):
            hit = next((n for n in names if low.startswith(n, at)), None)
            end = at + len(hit) if hit else at
            k = end + (hit is not None and t[end : end + 1] in ("'", '"') and t[end : end + 1] != "")
            if hit:
                while t[k : k + 1] == " ":
                    k += 1
                if t[k : k + 1] in (":", "=") and t[k : k + 1]:
                    k += 1
                    while t[k : k + 1] == " ":
                        k += 1
                    k += t[k : k + 1] in ("'", '"') and t[k : k + 1] != ""
                    v = k
                    while v < len(t) and t[v] in value:
                        v += 1
                    if v > k:
                        if v - k >= 12:
                            out.append((at, 0, v))
                        at = v
                        continue
            at += 1
        return out

    def maximal(t, kind, chars, least, head=""):
        out, at = [], 0
        while (at := t.find(head, at) if head else at) >= 0 and at < len(t):
            end = at + len(head)
            while end < len(t) and t[end] in chars:
                end += 1
            if end > at + len(head) and end - at >= least:
                out.append((at, kind, end))
            at = max(end, at + 1) if end > at + len(head) else at + 1
        return out

    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        spans = [assignments(t), maximal(t, 1, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18, "AKIA"), maximal(t, 2, set("0123456789abcdef"), 16)]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(map(len, spans))
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(sum(spans, [])))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("markov")) == base


def test_op10_planted_keys_and_ordinary_runs(spark, texts):
    """Recall on random strings of many alphabets and lengths, and no alarm on identifiers of another vocabulary."""
    from textkb.llm import secrets

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    models = secrets.fit(docs)
    flagged = lambda run: secrets.ratio(models, run) > max(secrets.THRESHOLD, secrets.PER_CHARACTER * len(run))
    for alphabet in secrets.ALPHABETS[2:]:
        assert np.mean([flagged(s) for s in secrets.random_strings(alphabet, 300, seed=9)]) >= 0.97, alphabet
    plain = ["MAX_RETRY_COUNT_PER_HOST", "src/main/java/org/example/project", "customer-order-history-2023", "XMLHttpRequestEventTarget", "internationalization", "2024-01-31-backup-final", "=" * 30, "-" * 20, "4939918345101225", "test_user_login_with_invalid_password", "aaaaaaaaaaaaaaaaaaaa"]
    assert not [s for s in plain if flagged(s)]
    keys = secrets.random_strings(secrets.ALPHABETS[5], 50, seed=10)
    planted = spark.createDataFrame([(i, f"see {k} and get_customer_order_list_by_name") for i, k in enumerate(keys)] + [(100 + i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "markov"] for r in secrets.secret_spans(planted).collect()}
    assert sum(found[i] == [(4, 4 + len(k))] for i, k in enumerate(keys)) >= 48 and sum(map(len, (found[100 + i] for i in range(len(texts))))) <= 2
