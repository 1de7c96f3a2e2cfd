"""Cases of the findings of round 4 about the training-data operators."""

import os
import random
import time

import numpy as np
import pytest

from textkb.llm import ngram_jaccard as J
from textkb.llm.common import discard, materialize

from . import brute


def _sets(r, n, size=100, changes=8):
    base = r.integers(0, 2**63, size).astype(np.uint64)
    out = []
    for _ in range(n):
        own = base.copy()
        k = int(r.integers(0, changes))
        own[:k] = r.integers(0, 2**63, k).astype(np.uint64)
        out.append(np.unique(own[: int(r.integers(size * 9 // 10, size))]))
    return out


def _columns(sets, component, main=None):
    signs = np.array([J.parity_signature(v) for v in sets]).reshape(len(sets), J.SIGNATURE_LONGS)
    x = {"cls": np.arange(len(sets)), "size": np.array([len(v) for v in sets], np.int32), "pos": np.zeros(len(sets), np.int32), "component": np.array(component)}
    return x | {c: signs[:, k].copy() for k, c in enumerate(J.SIGNATURE)} | {"main": np.zeros(len(sets), bool) if main is None else main}


def test_a_cell_loses_no_link_and_gives_back_few_pairs():
    sets = _sets(np.random.default_rng(4), 150)
    x = _columns(sets, range(150))
    i, j, cut = J.cell_pairs(x, x, 80, whole=True)
    assert not cut and {(a, b) for a in range(150) for b in range(a + 1, 150) if J.linked(sets[a], sets[b], 80)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    k, m, cut = J.cell_pairs(x, x, 80, whole=False)
    assert cut and len(i) > J.CELL_PAIRS * 300 and 0 < len(k) <= 300
    assert set(zip(k.tolist(), m.tolist(), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
    same = _columns(sets, [7] * 150)
    assert not len(J.cell_pairs(same, same, 80, whole=True)[0])


def test_lists_that_hang_together_are_not_compared_with_each_other(spark):
    """op4_ngram_jaccard: hot lists that share a class were one group, and each class of it met all others with its whole set."""
    n, width, schema = 40, 80, "gram long, cls long, size int, pos int, component long, " + ", ".join(f"{c} long" for c in J.SIGNATURE)
    signs = np.random.default_rng(1).integers(-(2**63), 2**63, (n * width, J.SIGNATURE_LONGS)).tolist()
    chain = [g * (width - 1) + k for g in range(n) for k in range(width)]  # the last class of a list is the first of the next
    rows = [(k // width, c, 50, 0, c, *signs[c]) for k, c in enumerate(chain)]
    join = object.__new__(J._Join)
    join.percent = 80
    postings = spark.createDataFrame(rows, schema)
    x, y = join._hot_cells(postings)
    assert (x.count(), y.count()) == (n * (width - 1), n * width)
    assert {t for _, t in x.dtypes + y.dtypes} <= {"int", "bigint", "boolean"}  # no sets
    assert join._hot_pairs(postings, False).count() == 0


@pytest.mark.parametrize("block, pairs", [(4, 0), (16, 0), (2048, 4)])
def test_hot_lists_against_brute_force(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(J, "HEAVY", 3)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "CELL_PAIRS", pairs)
    r, rows = random.Random(3), []
    word = lambda k: f"w{r.randrange(k)}"
    for group in range(6):
        base = [word(10**6) for _ in range(r.randrange(20, 120))]
        for i in range(40):
            w = list(base)
            for _ in range(r.randrange(0, len(w) // 12)):
                w[r.randrange(len(w))] = word(10**6)
            rows.append((100 * group + i, " ".join(w)))
    line = "this text is free for any use and may be given on without asking anyone for it".split()
    rows += [(5000 + i, " ".join(line + [word(10**6) for _ in range(r.randrange(0, 30))])) for i in range(120)]
    r.shuffle(rows)
    want = brute.jaccard_components(rows)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted((i, *want[i]) for i in want)


def test_materialize_leaves_no_shuffle_files_and_tables_can_be_given_up(spark):
    """op4_ngram_jaccard: shuffle files of all its steps and the sets of all its checks lay on disk until the end."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    out = materialize(spark.range(10_000).selectExpr("id % 100 as k", "id").groupBy("k").count())
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 100
    path = out.materialized_at.removeprefix("file://")
    assert os.path.isdir(path)
    discard(out)
    assert not os.path.exists(path)
