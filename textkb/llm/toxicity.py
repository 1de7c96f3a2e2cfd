"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratio features.

1. A feature is a hashed character n-gram that a text holds at least once, twice, or four times
   (``LEVELS``): what few texts hold by chance, toxic ones repeat.
2. Training uses at most about ``TRAIN_PER_LABEL`` labelled documents of each label, drawn by a hash of
   the id before texts meet labels, so only drawn texts are shuffled. How many of them hold a feature is
   counted by tasks and added up by Spark.
3. ``r = log((p + a) / |p| / ((q + a) / |q|))`` is a feature's log-count ratio; the ``FEATURES`` features
   whose presence tells most about the label (G statistic) are kept.
4. A logistic regression on the present features, each with value r, is fitted on the same documents; its
   intercept is moved back to the label shares of all training documents.

Scoring walks the whole text. All sizes are parameters, none grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bounded_batches, char_ngrams, code_points, hash_unit, held_out, letters_only, materialize, slices, table, utf8

ORDERS = (3, 4, 5, 6)
BITS = 18
LEVELS = (1, 2, 4)
FEATURES = 4096
TRAIN_PER_LABEL = 4000
SMOOTHING = 1.0
L2, STEPS = 1.0, 300
_FACTOR = U64(0x9E3779B97F4A7C15)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the rows' lower-cased words, and their rows."""
    cp, at = code_points(data, offsets)
    text, letter = letters_only(cp)
    parts = char_ngrams(text, at, ORDERS, letter).values()
    with np.errstate(over="ignore"):
        bucket = [((h ^ (h >> U64(31))) * _FACTOR >> U64(64 - BITS)).astype(np.int64) for h, _ in parts]
    return np.concatenate(bucket), np.concatenate([r for _, r in parts])


def _features(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, row) pairs of n-grams: feature = level << BITS | bucket."""
    pair, n = np.unique(rows << BITS | bucket, return_counts=True)
    held = [np.flatnonzero(n >= least) for least in LEVELS]
    feature = [pair[at] & ((1 << BITS) - 1) | level << BITS for level, at in enumerate(held)]
    return np.concatenate(feature), np.concatenate([pair[at] >> BITS for at in held])


def _chosen(sample: DataFrame, docs: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of the largest G statistic of presence against label, and their log-count ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(LEVELS) << BITS), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(offsets):
                found, rows = _features(*_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                for k in (0, 1):
                    total[k] += np.bincount(found[label[a:b][rows] == k], minlength=total.shape[1])
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["feature", "n0", "n1"])

    counts = sample.select("text", "label").mapInArrow(run, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    inside = [F.col(f"n{k}") + 0.5 for k in (0, 1)]
    outside = [F.lit(float(docs[k])) - F.col(f"n{k}") + 0.5 for k in (0, 1)]
    p = (inside[0] + inside[1]) / F.lit(float(docs.sum()) + 2)
    told = [i * F.log(i / (i + o) / p) + o * F.log(o / (i + o) / (1 - p)) for i, o in zip(inside, outside, strict=True)]
    best = counts.orderBy(F.desc(F.round(told[0] + told[1], 6)), "feature").limit(features).toArrow()
    smooth = np.array([best["n0"].to_numpy(), best["n1"].to_numpy()]) + SMOOTHING
    share = smooth / (docs[:, None] + 2 * SMOOTHING)
    return best["feature"].to_numpy().astype(np.int64), np.log(share[1] / share[0])


@dataclass
class ToxicityModel:
    number: np.ndarray  # int32 by feature, -1: not kept
    weight: np.ndarray  # by number, the ratio already multiplied in
    intercept: float

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept features of the rows, by number, and their rows."""
        bucket, rows = _buckets(data, offsets)
        keep = (self.number.reshape(len(LEVELS), -1) >= 0).any(axis=0)[bucket]
        found, row = _features(bucket[keep], rows[keep])
        n = self.number[found]
        return n[n >= 0], row[n >= 0]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, row = self.present(data, offsets)
        z = self.intercept + np.bincount(row, weights=self.weight[n], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, y: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """L2 logistic regression of binary features scaled by ``value`` (accelerated gradient steps)."""
    n = len(y)
    scale = np.bincount(rows, weights=value[cols] ** 2, minlength=n).max(initial=1.0)
    w, b, vw, vb = np.zeros(features), 0.0, np.zeros(features), 0.0
    step = 4.0 / (scale + 1.0) * 4
    mw, mb = w, b
    for t in range(STEPS):
        z = np.bincount(rows, weights=(mw * value)[cols], minlength=n) + mb
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gw = np.bincount(cols, weights=g[rows], minlength=features) * value / n + L2 * mw / n
        nw, nb = mw - step * gw, mb - step * g.mean()
        k = t / (t + 3)
        mw, mb = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    return w, b


def train(labelled: DataFrame, per_label: int = TRAIN_PER_LABEL, features: int = FEATURES) -> ToxicityModel:
    """From ``(doc_id, text, label)`` rows, one for each id. Rows with other labels than 0 and 1 take no part.

    A null text counts as an empty one. With one label or none, every score is that label's share. The
    order of rows does not matter: features of one statistic are taken by number, documents are sorted.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    labelled = labelled.where("label in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"))
    have = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n0, n1 = have.get(0, 0), have.get(1, 0)
    none = np.full(len(LEVELS) << BITS, -1, np.int32)
    if not n0 or not n1:
        return ToxicityModel(none, np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    bound = F.when(F.col("label") == 1, per_label / n1).otherwise(per_label / n0)
    # The larger share does not depend on the label, so Spark applies it where the texts are read.
    draw = hash_unit("doc_id", seed="toxicity")
    sample = materialize(labelled.where(draw < per_label / min(n0, n1)).where(draw < bound).select("text", "label"))
    drawn = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    docs = np.array([drawn.get(0, 0), drawn.get(1, 0)], float)
    best, ratio = _chosen(sample, docs, features)
    number = none.copy()
    number[best] = np.arange(len(best))
    model = ToxicityModel(number, ratio, 0.0)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found = []
            for a, b in slices(offsets):
                n, row = shared.value.present(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.lexsort((n, row))
                n, edges = n[order].astype(np.int32), np.searchsorted(row[order], np.arange(b - a + 1))
                found += [n[edges[i] : edges[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["found", "label"])

    rows = sorted((r["label"], bytes(r["found"])) for r in sample.mapInArrow(encode, "found binary, label int").collect())
    y = np.array([label for label, _ in rows], float)
    cols = [np.frombuffer(found, np.int32) for _, found in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    w, b = _logistic(owner, np.concatenate(cols) if cols else np.empty(0, np.int64), ratio, y, len(best))
    ones, zeros = max(y.sum(), 0.5), max(len(y) - y.sum(), 0.5)
    b += float(np.log(n1 / n0) - np.log(ones / zeros))
    return ToxicityModel(number, w * ratio, b)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``, from ``text`` alone: equal texts score equally, repeated rows and
    ids as often as they come. Null and empty texts get the intercept's score; long texts are walked whole;
    an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = [shared.value.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``(doc_id, text, label)`` of the training fold, one row for each id.

    A document with several labels takes the largest; of several texts under one id the smallest in
    code-point order counts (null only where there is no other). Null ids have no label.
    """
    kept = labels.where(F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(column).alias("label"))
    return docs.where(~held_out()).groupBy("doc_id").agg(F.min("text").alias("text")).join(kept, "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
