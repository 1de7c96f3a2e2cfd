"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has a bit mask over all languages in each slot; the AND of an n-gram's
slots is the set of languages that (probably) contain it, for all languages at once. A text's hits
are counted per language, and a language's expected false positives (its fill to the power of the
number of hashes) are taken out: ``(hits - n * fp) / (1 - fp)``. The largest corrected count decides.

Training: character n-grams within words of a sample of labelled documents (a hash of the id picks
about ``TRAIN_PER_LANGUAGE`` for each language). A language keeps its ``GRAMS`` most frequent
n-grams among those at least half as frequent as in any other language. Counting is a Spark
aggregate; what comes to the driver are the kept n-grams, and the filter's size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bounded_batches, char_ngrams, code_points, hash_unit, held_out, letters_only, slices, table, utf8

ORDERS = (2, 3, 4, 5)
TRAIN_PER_LANGUAGE = 1500
GRAMS = 30_000
SLOT_BITS, HASHES = 19, 3
SHARE = 0.5
LEAST = 3
UNDETERMINED = "und"
_FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _slots(hashes: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes ^ (hashes >> U64(29))) * _FACTORS[k] >> U64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class LanguageFilter:
    """``slots[position]`` is a little-endian bit mask over ``languages``."""

    languages: list[str]
    slots: np.ndarray  # uint8, (2**SLOT_BITS, ceil(languages / 8))
    prior: int = 0  # the language of texts without any hit

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], prior: str | None = None) -> LanguageFilter:
        languages = sorted(grams, key=lambda s: s.encode())
        slots = np.zeros((1 << SLOT_BITS, -(-max(len(languages), 1) // 8)), np.uint8)
        for i, name in enumerate(languages):
            for k in range(HASHES):
                slots[_slots(grams[name], k), i // 8] |= np.uint8(1 << i % 8)
        return cls(languages, slots, languages.index(prior) if prior in grams else 0)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = self.slots[_slots(hashes, 0)]
        for k in range(1, HASHES):
            out &= self.slots[_slots(hashes, k)]
        return out

    def false_positives(self) -> np.ndarray:
        bits = np.unpackbits(self.slots, axis=1, bitorder="little")[:, : len(self.languages)]
        return bits.mean(axis=0) ** HASHES

    def counts(self, hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Hits of each row (``rows`` ascends) and language."""
        masks = self.masks(hashes)
        out = np.empty((n_rows, len(self.languages)), np.int64)
        edges = np.searchsorted(rows, np.arange(n_rows + 1))
        for i in range(len(self.languages)):
            total = np.concatenate([[0], np.cumsum(masks[:, i // 8] >> np.uint8(i % 8) & np.uint8(1), dtype=np.int64)])
            out[:, i] = total[edges[1:]] - total[edges[:-1]]
        return out


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Hashes and rows by order, and which rows have a letter."""
    cp, at = code_points(data, offsets)
    text, letter = letters_only(cp)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    has = np.bincount(owner[letter], minlength=len(at) - 1) > 0
    return char_ngrams(text, at, ORDERS, letter), has


def _counted(sample: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` of the sample; each task adds up before it emits, in bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                by_order, _ = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                langs, inverse = np.unique(names[a:b].astype(str), return_inverse=True)
                hashes = np.concatenate([h for h, _ in by_order.values()])
                owner = inverse[np.concatenate([r for _, r in by_order.values()])]
                for i, name in enumerate(langs):
                    g, n = np.unique(hashes[owner == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                    )

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, grams: int = GRAMS) -> LanguageFilter:
    """A filter from ``docs`` (doc_id, text, lang); rows with null text or lang teach nothing.

    Rows of one id are drawn together or not at all; empty texts have no n-grams; n-grams of equal rate are kept by
    their hash; long texts count whole; an empty table gives a filter that knows no language; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    have = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a number for each language
    biggest = max(sorted(have), key=have.get) if have else None
    limit = F.create_map(*(F.lit(x) for lang, n in have.items() for x in (lang, per_language / n))) if have else None
    drawn = hash_unit("doc_id", seed="language") < limit[F.col("lang")] if have else F.lit(False)
    sample = known.where(drawn)
    total = _counted(sample).groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    kept = (
        total.withColumn("rate", rate)
        .where(F.col("rate") >= 0)
        .withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
        .where(F.col("rate") >= SHARE * F.col("top"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        .where(F.col("place") <= grams)
        .groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    )
    found = {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in kept.collect()}
    return LanguageFilter.build(found, biggest)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row of ``docs``, from ``text`` alone.

    Texts that are null or have no letter are ``und`` with score 0, as is everything if nothing was
    learned. Ties go to the language first in code-point order; a text without hits to the language
    most frequent in training, with score 0. The score is the winner's share of the corrected counts.
    Equal texts fare alike, repeated rows and ids as often as they come; long texts are walked whole; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        fp = m.false_positives()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            names, scores = [], []
            for a, b in slices(offsets):
                by_order, has = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                corrected = np.zeros((b - a, max(len(m.languages), 1)))
                if m.languages:
                    for hashes, rows in by_order.values():
                        n = np.bincount(rows, minlength=b - a)[:, None]
                        corrected += np.maximum(0.0, (m.counts(hashes, rows, b - a) - n * fp) / (1 - fp))
                best, total = corrected.argmax(axis=1), corrected.sum(axis=1)
                best[total <= 0] = m.prior
                share = np.where(total > 0, corrected[np.arange(b - a), best] / np.maximum(total, 1e-300), 0.0)
                ok = has & bool(m.languages)
                names += [m.languages[k] if good else UNDETERMINED for k, good in zip(best, ok, strict=True)]
                scores.append(np.where(ok, np.clip(share, 0, 1), 0.0))
            score = pa.array(np.concatenate(scores) if scores else np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), score], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
