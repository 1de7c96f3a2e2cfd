"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass.

First pass. Tasks hash the n-grams of their texts (64 bits, the language included), count them over
some millions at a time and send these partial counts to the hash partition that the hash belongs to.
There they are merged into one Misra-Gries summary: of more than ``capacity`` counters the
(capacity + 1)-th largest count is taken from all, and counters at 0 go. What is taken away in all is
below mass / capacity, so with a capacity above mass / threshold less than ``threshold`` is ever taken
and every n-gram that stands ``threshold`` times or more keeps a counter. The number of partitions is
set from the mass of all n-grams, so a partition's mass stays below capacity * threshold. N-grams that
reach the threshold in one partial count are known to be frequent and stand beside the summary: they
add no mass, so a word with a third of all occurrences is one row a task and crowds nobody out.

Second pass. Survivors (counters that may have stood for ``threshold``) become a Bloom filter of bounded
size, one segment a hash partition, with which tasks pick the n-grams to count. These are counted exactly by
language and phrase, as text. Where survivors outgrow the filter more n-grams pass it and are counted in
vain: the second pass then shuffles more, and its result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix64, slices, table, utf8, word_hashes

MAX_WORDS, LEAST, KEPT = 3, 10, 2000
#: Share of a longer phrase's count, in hundredths of the shorter one's, from which the shorter one is dropped.
CONTAINED = 50
#: Counters of one summary: bounds a task's memory (some 16 bytes each, and the same again while merging).
CAPACITY = 1 << 20
#: Part of capacity * threshold that a partition's mass is planned for: partitions by hash differ a little.
FILL = 0.8
#: N-grams that a task counts at a time, and bytes of text that it keeps for their phrases: what bounds its memory.
COUNTED_AT_ONCE, TEXT_AT_ONCE = 3 << 19, 8 << 20
#: The most bits of the filter (64 MB), bits a survivor and probes.
FILTER_BITS, BITS_EACH, PROBES = 1 << 29, 12, 4

U64 = np.uint64
_BLANK, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9] = 32


def pieces_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), row and piece of every word; no piece crosses a row."""
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e, e
    cut = _CUT[data]
    inside = ~(cut | _BLANK[data])
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1, np.cumsum(cut | first[:n])[s]


def ngrams(batch: pa.RecordBatch, max_words: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, list]]:
    """By slices of a batch: bytes, languages, starts, ends and rows of words, and per n the first words and hashes of n-grams."""
    data, offsets = utf8(batch["text"])
    langs = batch["lang"].to_pylist()
    seeds = {x: np.frombuffer(hashlib.blake2b(x.encode(), digest_size=8).digest(), U64)[0] for x in set(langs)}
    seed = np.array([seeds[x] for x in langs], U64)
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        s, e, row, piece = pieces_words(part, offsets[a : b + 1] - offsets[a])
        word = word_hashes(part, s, e)
        out, total = [], mix64(word + seed[a:b][row]) if len(s) else word
        with np.errstate(over="ignore"):
            for n in range(1, max_words + 1):
                m = max(len(s) - n + 1, 0)
                if n > 1:
                    total = mix64(total[:m] * U64(0x9E3779B97F4A7C15) + word[n - 1 :][:m])
                whole = np.flatnonzero(piece[:m] == piece[n - 1 :][:m]) if m else np.empty(0, np.int64)
                out.append((whole, total[whole]))
        yield part, langs[a:b], s, e, row, out


def _counted(hashes: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and their summed counts."""
    h = np.concatenate(hashes) if hashes else np.empty(0, U64)
    if counts is None:
        return np.unique(h, return_counts=True)
    by = np.argsort(h, kind="stable")
    h, c = h[by], np.concatenate(counts)[by]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else np.empty(0, c.dtype)


class Summary:
    """A Misra-Gries summary of ``capacity`` counters for items that stand ``least`` times or more.

    Counters grow past the capacity only where the mass is larger than the capacity was chosen for: taking more away
    would then lose frequent items.
    """

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.taken = capacity, least, 0
        self.items, self.counts = np.empty(0, U64), np.empty(0, np.int64)

    def merge(self, items: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.items, self.counts = _counted([self.items, *items], [self.counts, *counts])
        if len(self.items) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            take = int(np.partition(self.counts, at)[at])
            if self.taken + take < self.least:
                self.taken += take
                alive = self.counts > take
                self.items, self.counts = self.items[alive], self.counts[alive] - take

    def survivors(self) -> np.ndarray:
        """Items that may have stood ``least`` times: what was taken is at most ``taken``."""
        return self.items[self.counts + self.taken >= self.least]


def _probes(hashes: np.ndarray, parts: int, bits: int) -> Iterator[np.ndarray]:
    """Bits of each hash inside the segment of its partition."""
    base = _part(hashes, parts).astype(np.int64) * bits
    h = mix64(hashes ^ U64(0xA24BAED4963EE407))
    low, high = h & U64(0xFFFFFFFF), h >> U64(32) | U64(1)
    for k in range(PROBES):
        yield base + ((low + U64(k) * high & U64(0xFFFFFFFF)) * U64(bits) >> U64(32)).astype(np.int64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash, by its upper bits: ascending hashes have ascending partitions."""
    return (hashes >> U64(32)) * U64(parts) >> U64(32)


def _among(bloom: np.ndarray, hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Whether the filter may hold each hash."""
    ok = np.ones(len(hashes), bool)
    for at in _probes(hashes, parts, bits):
        ok &= bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
    return ok


def _phrases(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of a lower-case text (tabs are spaces already) as strings, with single spaces."""
    n = (end - start).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    data = text[np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])]
    wide = np.flatnonzero((data[1:] == 32) & (data[:-1] == 32))
    out = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    if len(wide):
        at = np.unique(np.searchsorted(offsets, wide, side="right") - 1)
        told = [b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split()).decode("utf-8", "replace") for i in at]
        place = np.arange(len(n))
        place[at] = len(n) + np.arange(len(at))
        out = pa.concat_arrays([out, pa.array(told, pa.large_string())]).take(pa.array(place))
    return out.cast(pa.string())


def survivors(docs: DataFrame, max_words: int, least: int, parts: int, capacity: int) -> DataFrame:
    """``(part, items)``: the n-grams that may stand ``least`` times or more, as packed hashes, written to the shared folder."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            h, c = _counted(held)
            edges = np.searchsorted(_part(h, parts), np.arange(parts + 1))
            c = np.minimum(c, least).astype(np.uint8 if least < 256 else np.int64)
            some = np.flatnonzero(np.diff(edges))
            cells = [[x[edges[p] : edges[p + 1]].tobytes() for p in some] for x in (h, c)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in cells)], ["part", "items", "counts"])

        for batch in batches:
            for *_, out in ngrams(batch, max_words):
                held += [h for _, h in out]
                n += sum(len(h) for _, h in out)
                if n >= COUNTED_AT_ONCE:
                    yield flush()
                    held.clear()
                    n = 0
        if n:
            yield flush()

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, tuple[Summary, list, list, list]] = {}
        for batch in batches:
            for part, items, counts in zip(*(batch[c].to_pylist() for c in ("part", "items", "counts")), strict=True):
                summary, held, held_counts, sure = at.setdefault(part, (Summary(capacity, least), [], [], []))
                h, c = np.frombuffer(items, U64), np.frombuffer(counts, np.uint8 if least < 256 else np.int64).astype(np.int64)
                sure.append(h[c >= least])
                held.append(h[c < least])
                held_counts.append(c[c < least])
                if sum(map(len, held)) >= capacity:
                    summary.merge(held, held_counts)
                    held.clear()
                    held_counts.clear()
                if sum(map(len, sure)) >= capacity:
                    sure[:] = [np.unique(np.concatenate(sure))]
        for part, (summary, held, held_counts, sure) in at.items():
            summary.merge(held, held_counts)
            found = np.unique(np.concatenate([summary.survivors(), *sure]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["part", "n", "items"])

    rows = docs.mapInArrow(partial, "part int, items binary, counts binary")
    # One hash partition a task, or a few: each keeps its own summary.
    return materialize(rows.repartition(parts, "part").mapInArrow(summarize, "part int, n long, items binary"))


def _filter(found: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """The Bloom filter of the survivors, as bytes, and the bits of a segment: at most ``FILTER_BITS`` in all."""
    most = found.agg(F.max("n")).first()[0] or 0
    bits = max(64, min(FILTER_BITS // parts, most * BITS_EACH) // 8 * 8)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, items in zip(batch["part"].to_pylist(), batch["items"].to_pylist(), strict=True):
                on = np.zeros(bits, bool)
                for at in _probes(np.frombuffer(items, U64), parts, bits):
                    on[at - part * bits] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros(parts * bits // 8, np.uint8)
    for r in found.select("part", "items").mapInArrow(segment, "part int, bits binary").collect():  # FILTER_BITS at most
        out[r["part"] * bits // 8 : (r["part"] + 1) * bits // 8] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, capacity: int = CAPACITY) -> DataFrame:
    """``(lang, phrase, n_words, f)``: every n-gram of 1 to ``max_words`` words that stands ``least`` times or more, counted exactly.

    ``docs`` has text and lang; see ``collocations`` for nulls and odd rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    words = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]++")).cast("long"))).first()[0] or 0
    parts = max(1, int(np.ceil(words * max_words / (FILL * capacity * least))), min(64, -(-words // 100_000)))
    found = survivors(docs, max_words, least, parts, capacity)
    bloom, bits = _filter(found, parts)
    shared = spark.sparkContext.broadcast(bloom)  # at most FILTER_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []  # languages of this task, by number
        numbers: dict[str, int] = {}
        texts, hits, size, n_hits = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            h, start, end, lang, n = (np.concatenate(c) for c in zip(*hits, strict=True))
            _, one, f = np.unique(h, return_index=True, return_counts=True)
            phrases = _phrases(np.concatenate(texts), start[one], end[one])
            arrays = [pa.array(names).take(pa.array(lang[one])), phrases, pa.array(n[one], pa.int32()), pa.array(f, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "n_words", "f"])

        for batch in batches:
            for part, langs, s, e, row, out in ngrams(batch, max_words):
                for x in set(langs) - numbers.keys():
                    numbers[x] = len(names)
                    names.append(x)
                lang = np.array([numbers[x] for x in langs], np.int32)
                for n, (first, h) in enumerate(out, 1):
                    ok = np.flatnonzero(_among(shared.value, h, parts, bits))
                    if len(ok):
                        w = first[ok]
                        hits.append((h[ok], (s[w] + size).astype(np.int32), (e[w + n - 1] + size).astype(np.int32), lang[row[w]], np.full(len(ok), n, np.int8)))
                        n_hits += len(ok)
                texts.append(_LOWER[part])
                size += len(part)
                if hits and (n_hits >= COUNTED_AT_ONCE or size >= TEXT_AT_ONCE):
                    yield flush()
                if n_hits >= COUNTED_AT_ONCE or size >= TEXT_AT_ONCE:
                    texts, hits, size, n_hits = [], [], 0, 0
        if hits:
            yield flush()

    rows = docs.mapInArrow(counted, "lang string, phrase string, n_words int, f long")
    return rows.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(counts: DataFrame) -> DataFrame:
    """Per phrase of two words or more the cut with the lowest score: lang, phrase, n_words, a, l, r, score."""
    w = F.split("phrase", " ")
    cut = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    longer = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    longer = longer.select("*", cut(F.lit(1), F.col("k")).alias("head"), cut(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("tail"))
    part = lambda key, name: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = longer.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # Whole numbers of up to 38 digits, and a division that gives the whole quotient: counts below 10**15 are exact.
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return cuts.groupBy("lang", "phrase", "n_words", "a").agg(lowest).select("lang", "phrase", "n_words", "a", "m.l", "m.r", "m.score")


def uncontained(phrases: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """Phrases that no longer one holds with at least ``contained`` hundredths of their count."""
    w = F.split("phrase", " ")
    sizes = F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m")
    inner = phrases.where("n_words > 2").select("lang", "a", "n_words", w.alias("w"), sizes)
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = phrases.join(inner, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, kept: int = KEPT, capacity: int = CAPACITY) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``kept`` phrases.

    A null text is empty, a null language ``und``; repeated rows count each time; long texts are walked in whole; ties
    go to the larger count and then to the phrase that comes first by its bytes; an empty table gives no rows; other
    columns are ignored. N-grams are told apart by 64-bit hashes inside a task and as text beyond it.
    """
    counts = materialize(phrase_counts(docs, max_words, least, capacity))
    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]++")).cast("long")
    totals = docs.select(lang, words.alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = uncontained(scored(counts)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang")).withColumn("rank", F.col("rank").cast("long"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, (SELECT unnest([1, 2, 3]) AS k))
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, k AS words, f AS a, c, array_to_string(list_slice(w, 1, c), ' ') AS head, array_to_string(list_slice(w, c + 1, k), ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM counts WHERE k > 1 AND f >= 10)
), cut_scores AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN counts x ON cuts.lang = x.lang AND head = x.phrase JOIN counts y ON cuts.lang = y.lang AND tail = y.phrase
), scored AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM (SELECT lang, a, string_split(phrase, ' ') AS w FROM scored WHERE words = 3)
  ) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_ i ON s.lang = i.lang AND s.phrase = i.phrase AND s.words = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
