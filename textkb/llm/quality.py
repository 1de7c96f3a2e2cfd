"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE_WORDS`` words, every one encoded: the passage's histogram of
neighbouring byte classes and word statistics, standardised, then a tanh layer. Gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and a logistic unit scores the
weighted representation. Document labels alone train all of it (Adam, plain numpy gradients).

Training uses at most about ``TRAIN_PER_LABEL`` documents of each label, chosen by a hash of the id,
whole texts; the intercept is then moved to the label shares of all training documents. Tasks send
encoded passages of that sample to the driver, nothing that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hash_unit, held_out, slices, table, utf8, word_hashes, words
from .toxicity import labelled_texts

PASSAGE_WORDS = 64
HIDDEN, ATTENTION = 24, 12
TRAIN_PER_LABEL = 2500
EPOCHS, BATCH, RATE, DECAY = 25, 64, 5e-3, 1e-4
KEEP_FROM = 0.3

#: Byte classes: lower, upper, digit, beyond ASCII, blank, line end, sentence mark, other mark, symbol.
_CLASS = np.full(256, 8, np.uint8)
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), (32, 9, 11, 12), (10, 13), b".!?", b",;:'\"()-")):
    _CLASS[list(_chars)] = _i
_N = 9
FEATURES = _N * _N + 7


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (float32) of all passages of the rows, and the len+1 offsets of each row's passages.

    A row without words is one passage of zeros.
    """
    rows = len(offsets) - 1
    s, e, row = words(data, offsets)
    count = np.bincount(row, minlength=rows)
    passages = np.maximum(1, -(-count // PASSAGE_WORDS))
    at = np.concatenate([[0], np.cumsum(passages)])
    x = np.zeros((at[-1], FEATURES), np.float32)
    if len(s) == 0:
        return x, at
    first_word = np.concatenate([[0], np.cumsum(count)])
    word_passage = at[:-1][row] + (np.arange(len(s)) - first_word[row]) // PASSAGE_WORDS
    begins = np.flatnonzero(np.concatenate([[True], word_passage[1:] != word_passage[:-1]]))
    # A byte belongs to the passage of the last word of its row that began at or before it, or else to the row's
    # first; bytes of rows without words to none.
    passage, of = word_passage[begins], row[begins]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    start = np.where(first, offsets[of], s[begins])
    size = np.concatenate([np.where(first[1:], offsets[of[:-1] + 1], start[1:]), [offsets[of[-1] + 1]]]) - start
    body_at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    body, owner = data[body_at], np.repeat(passage, size)
    c = _CLASS[body].astype(np.int64)
    same = owner[1:] == owner[:-1]
    if len(body) > 1:
        pair = (owner[:-1] * (_N * _N) + c[:-1] * _N + c[1:])[same]
        x[:, : _N * _N] = np.bincount(pair, minlength=at[-1] * _N * _N).reshape(-1, _N * _N)
    n_words = np.bincount(word_passage, minlength=at[-1]).astype(np.float64)
    some = np.maximum(n_words, 1)
    length = (e - s).astype(np.float64)
    mean = np.bincount(word_passage, weights=length, minlength=at[-1]) / some
    square = np.bincount(word_passage, weights=length * length, minlength=at[-1]) / some
    h = word_hashes(data, s, e)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (word_passage[1:] == word_passage[:-1])])
    key = word_passage.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)
    distinct = np.bincount((np.unique(key) >> np.uint64(44)).astype(np.int64), minlength=at[-1])
    repeated = np.zeros(len(body))
    repeated[1:] = same & (body[1:] == body[:-1]) & (c[1:] >= 4)
    total = np.maximum(x[:, : _N * _N].sum(axis=1, keepdims=True), 1)
    x[:, : _N * _N] = np.sqrt(x[:, : _N * _N] / total)
    extra = (mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 5, np.log1p(n_words) / 4, distinct / some,
             np.bincount(word_passage, weights=again, minlength=at[-1]) / some,
             np.bincount(owner, weights=repeated, minlength=at[-1]) / total[:, 0], n_words / PASSAGE_WORDS)
    for i, v in enumerate(extra):
        x[:, _N * _N + i] = v
    return x, at


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    @classmethod
    def new(cls, x: np.ndarray, seed: int = 7) -> QualityModel:
        g = np.random.default_rng(seed)
        mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-2) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        shape = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,)}
        p = {k: g.normal(0, 1 / np.sqrt(v[0]), v) for k, v in shape.items()}
        return cls(mean, scale, p | {"b": np.zeros(HIDDEN), "d": np.zeros(1)})

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        p, begin = self.p, at[:-1]
        bag = np.repeat(np.arange(len(begin)), np.diff(at))
        n = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(n @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, begin)[bag])
        a = s / np.add.reduceat(s, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        return {"n": n, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "logit": z @ p["c"] + p["d"][0]}

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, at)
        h, v, u, a, bag = f["h"], f["v"], f["u"], f["a"], f["bag"]
        g = (1 / (1 + np.exp(-np.clip(f["logit"], -40, 40))) - y) * weight
        dz = (g[:, None] * p["c"])[bag]
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, at[:-1])[bag])
        dvu = ds[:, None] * p["w"]
        dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": f["n"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": f["z"].T @ g, "d": np.array([g.sum()])}

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, at)["logit"] + self.shift, -40, 40)))


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> QualityModel:
    """Adam over bags of passages; the labels weigh alike in total."""
    model = QualityModel.new(np.concatenate(bags))
    g, ones = np.random.default_rng(11), y.mean()
    weight = np.where(y == 1, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    q = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = g.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            at = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            grad = model.gradients(np.concatenate([bags[i] for i in pick]), at, y[pick], weight[pick] / len(pick))
            t += 1
            for name, d in grad.items():
                d = d + DECAY * model.p[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                q[name] = 0.999 * q[name] + 0.001 * d * d
                model.p[name] = model.p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(q[name] / (1 - 0.999**t)) + 1e-8)
    return model


def train(labelled: DataFrame, per_label: int = TRAIN_PER_LABEL) -> QualityModel:
    """From ``(doc_id, text, label)`` rows, one for each id. Rows with other labels than 0 and 1 take no part.

    A null text counts as an empty one; long texts are encoded whole. With one label or none, every score is that
    label's share. The order of rows does not matter: bags are sorted before they are learned from.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where("label in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"))
    have = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n0, n1 = have.get(0, 0), have.get(1, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n0 or not n1:
        model = QualityModel.new(np.zeros((0, FEATURES)))
        model.p["c"], model.shift = np.zeros(HIDDEN), prior
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            out = []
            for a, b in slices(offsets):
                x, at = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += [x[at[i] : at[i + 1]].astype(np.float16).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["bag", "label"])

    bound = F.when(F.col("label") == 1, per_label / n1).otherwise(per_label / n0)
    # The larger share does not depend on the label, so Spark applies it where the texts are read.
    most = per_label / min(n0, n1)
    draw = hash_unit("doc_id", seed="quality")
    sample = labelled.where(draw < most).where(draw < bound).select("text", "label", "doc_id")
    rows = sample.select("text", "label").mapInArrow(run, "bag binary, label int").collect()
    rows = sorted((len(r["bag"]), bytes(r["bag"]), r["label"]) for r in rows)  # the order of rows and tasks does not matter
    bags = [np.frombuffer(bag, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, bag, _ in rows]
    model = fit(bags, np.array([label for *_, label in rows], float))
    model.shift = prior  # the labels weighed alike while training
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``, from ``text`` alone: equal texts score equally, repeated rows and ids as
    often as they come. A null or blank text is one empty passage; long texts are encoded whole; an empty table
    gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = [shared.value.scores(*encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: QualityModel, least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns and nothing shuffled.

    Rows are judged one by one as in ``score``: a row at the bar stays, repeated rows fare alike, null and empty texts
    score as one empty passage, long texts are encoded whole, an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(place))
            out = [shared.value.scores(*encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets)]
            if out:
                yield batch.filter(pa.array(np.concatenate(out) >= least))

    return docs.mapInArrow(run, docs.schema)


def trained_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return train(labelled_texts(docs, labels, "quality"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted")
    )
