"""The pipeline against its definition, stage by stage, on the small tables."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from textkb.llm import decontamination, mixing, packing, quality  # noqa: E402
from textkb.llm.common import materialize  # noqa: E402

from . import brute  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_each_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, DIR))
        before = [r.asDict() for r in docs.collect()]
        after = [r.asDict() for r in out.collect()]
        if name == "quality_classifier":
            model = quality.trained_on(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
            want = [r["doc_id"] for r in before if scores[r["doc_id"]] >= 0.3]
        elif name == "ngram_jaccard_join":
            comps = brute.jaccard_components([(r["doc_id"], r["text"]) for r in before])
            want = [i for i, (_, c) in comps.items() if c == i]
        elif name == "benchmark_decontamination":
            bench = [r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            found = {r["doc_id"] for r in decontamination.contamination(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in before if any(b in r["text"] for b in bench)} <= found
            want = [r["doc_id"] for r in before if r["doc_id"] not in found]
        elif name == "mixing_to_target_weights":
            want = [r["doc_id"] for r in mixing.mixed_counts(docs).collect() for _ in range(r["copies"])]
        else:
            coder = packing.Tokenizer(packing.read_vocabulary())
            assert sum(r["n_tokens"] for r in after) == sum(len(coder.ids(r["text"])) for r in before)
            assert {d for r in after for d in r["doc_ids"]} == {r["doc_id"] for r in before}
            continue
        assert sorted(r["doc_id"] for r in after) == sorted(want), name
        assert out.columns == columns
        seen.append(name)
        docs = out
    assert len(seen) == 4


def test_stages_take_odd_rows(spark):
    """Null ids and texts, repeated rows, empty and long texts, a null source, clashing names, an empty table."""
    long = "a long text of words " * 8000
    rows = [
        (None, "some words without an id that nobody repeats", "en", None, 1, "x", "y"), (1, None, None, None, 0, None, None), (2, "", "en", "a", 0, "x", "y"), (3, " \n", "en", "a", 2, "x", "y"),
        (4, long, "en", "hot", len(long), "x", "y"), (5, "one two three four five six", "de", "hot", 5, "x", "y"), (5, "one two three four five six", "de", "hot", 5, "x", "y"), (5, "another text under the same id", "de", "hot", 5, "x", "y"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, place_of_id string")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:4]:
            out = materialize(stage(spark, docs, DIR))
            assert out.columns == docs.columns
            docs = out
        texts = sorted(str(r["text"])[:12] for r in docs.collect())
        packed = corpus_pipeline.STAGES[4][1](spark, docs, DIR).collect()
        assert set(texts) <= {"None", "", " \n", "a long text ", "another text", "some words w"} and bool(packed) == bool([t for t in texts if t not in ("None", "")])
    kept = corpus_pipeline.STAGES[0][1](spark, odd, DIR)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {None, 1, 2, 3, 4, 5}
    assert corpus_pipeline.STAGES[0][1](spark, odd.limit(0), DIR).count() == 0
