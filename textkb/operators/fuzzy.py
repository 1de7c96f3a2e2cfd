"""Fuzzy location of quotes: an inverted index of seeds, merged along diagonals, then a bit-parallel distance.

A quote matches a span of up to eight sentences at a Levenshtein similarity of ``least`` or more. That
admits a known number of edits, E. The quote is cut into m > E pieces of one length (its seeds), so at
least m - E seeds of every match stand unchanged in the span, each moved by E characters at most. The
texts are walked once: the substrings at all their places are looked up in the sorted seeds of a block
of quotes, a hit votes for the sentences that begin within E characters of its diagonal (place in the text
minus place in the quote), and only sentences with votes from m - E different seeds are compared. One
walk over the text from such a sentence gives the distances of all its spans.

Texts are never shuffled and no pair becomes a row before it has passed the vote. Quotes are sent in
blocks of bounded size, each a pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scratch import bounded_batches

#: What ends a sentence.
SENTENCE_ENDS = "。！？\n.!?；"
WINDOW, LEAST = 8, 0.85
#: A similarity this much below the least one may still round to it.
ROUNDED = 0.0001
#: Characters of quotes in a block, and of texts looked at in one step.
BLOCK_CHARS, STEP_CHARS = 8 << 20, 1 << 20
#: Hits of seeds that are spread out at a time: what bounds the memory of a walk, however often a seed stands in a text.
HITS_AT_ONCE = 1 << 17
SEED_LENGTHS = range(8, 0, -1)

U64 = np.uint64
_ENDS = np.array(sorted(map(ord, SENTENCE_ENDS)), np.uint32)
FOUND = "sentence int, position int, edits int, span_chars int, quote_chars int"


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _hashes(code: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` characters from every place."""
    n = len(code) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * U64(0x9E3779B97F4A7C15) + code[k : k + n]
            out ^= out >> U64(29)
    return out


def _expanded(first: np.ndarray, last: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges ``first .. last``, and the range's value beside it."""
    n = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), np.repeat(value, n)


class _Covered:
    """How often each number is covered by ranges of numbers, kept as the steps of that count."""

    def __init__(self):
        self.at, self.step = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, first: np.ndarray, last: np.ndarray) -> None:
        self.pending.append((first, last))
        if sum(len(f) for f, _ in self.pending) > max(HITS_AT_ONCE, len(self.at)):
            self._sum()

    def _sum(self) -> None:
        at = np.concatenate([self.at, *(f for f, _ in self.pending), *(n for _, n in self.pending)])
        step = np.full(len(at), -1)
        step[: (len(at) + len(self.at)) // 2] = 1
        step[: len(self.at)] = self.step
        by = np.argsort(at)
        at, step = at[by], np.cumsum(step[by])
        last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else np.empty(0, np.int64)
        step = np.diff(step[last], prepend=0)
        self.at, self.step, self.pending = at[last][step != 0], step[step != 0], []

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and count of the runs of numbers that are covered equally often."""
        self._sum()
        return self.at[:-1], self.at[1:], np.cumsum(self.step)[:-1]


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of items whose sizes add up to ``HITS_AT_ONCE`` at most; a larger item comes alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS_AT_ONCE, side="right")))
        yield slice(a, b)
        a = b


class Index:
    """The seeds of a block of quotes. Empty and null quotes match nothing."""

    def __init__(self, quotes: list[str | None], least: float = LEAST):
        self.least, self.code = least, [_code(q or "") for q in quotes]
        self.masks: dict[int, dict[int, int]] = {}
        n = np.array([len(c) for c in self.code], np.int64)
        # As many edits as the longest span admits.
        self.edits = np.floor((1 - least + ROUNDED) * (np.floor(n * (2 - least)) + 1)).astype(np.int64)
        self.need = np.zeros(len(n), np.int64)
        seeds: dict[int, list[tuple[np.ndarray, int]]] = {}
        for q, code in enumerate(self.code):
            # The longest seed that leaves two votes, or one; a quote shorter than its edits has none and is walked everywhere.
            fits = [x for votes in (2, 1) for x in SEED_LENGTHS if len(code) // x - self.edits[q] >= votes]
            if fits:
                self.need[q] = len(code) // fits[0] - self.edits[q]
                seeds.setdefault(fits[0], []).append((_hashes(code, fits[0])[: len(code) // fits[0] * fits[0] : fits[0]], q))
        self.open = [q for q in range(len(n)) if len(self.code[q]) and not self.need[q]]
        self.tables = []
        for length, parts in seeds.items():
            h = np.concatenate([p for p, _ in parts])
            quote = np.concatenate([np.full(len(p), q) for p, q in parts])
            place = np.concatenate([np.arange(len(p)) * length for p, _ in parts])
            by = np.argsort(h, kind="stable")
            h = h[by]
            known = np.zeros(1 << min(20, max(10, (64 * len(h)).bit_length())), bool)
            known[h & U64(len(known) - 1)] = True
            self.tables.append((length, h, quote[by], place[by], known))

    def candidates(self, code: np.ndarray, row: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(quote, sentence)`` with enough votes; ``starts`` are where sentences begin, ascending."""
        n, n_starts, pairs = len(code), len(starts), [np.empty(0, np.int64)]
        texts = np.arange(int(row[-1]) + 2)
        owner, at = row[np.minimum(starts, n - 1)], np.searchsorted(row, texts)
        first_start = np.searchsorted(owner, texts)  # of each text
        for length, h, quote, place, known in self.tables:
            at_place = _hashes(code, length)
            hit = np.flatnonzero(known[at_place & U64(len(known) - 1)])
            hit = hit[row[hit] == row[hit + length - 1]]
            hit = hit[np.argsort(at_place[hit], kind="stable")]  # by hash, then by place
            value = at_place[hit]
            first, last = np.searchsorted(value, h), np.searchsorted(value, h, side="right")
            most, votes, often = self.edits[quote], _Covered(), last - first > n_starts
            key = quote * (n_starts + 1)
            # A seed that stands in few places votes for the sentences around each of them, ...
            few = np.flatnonzero(~often & (first < last))
            for part in _portions((last - first)[few]):
                seeds = few[part]
                x, seed = _expanded(first[seeds], last[seeds], seeds)
                t = hit[x]
                diagonal, a, b = t - place[seed], first_start[row[t]], first_start[row[t] + 1]
                lo = np.clip(np.searchsorted(starts, diagonal - most[seed]), a, b)
                hi = np.clip(np.searchsorted(starts, diagonal + most[seed], side="right"), a, b)
                # once for each: both ends ascend, and what the place before has covered is left out.
                lo[1:] = np.where(seed[1:] == seed[:-1], np.maximum(lo[1:], hi[:-1]), lo[1:])
                some = lo < hi
                votes.add(key[seed[some]] + lo[some], key[seed[some]] + hi[some])
            # ... and for one that stands in many, each sentence is asked whether a place is around it.
            many = np.flatnonzero(often)
            if not len(few) and not len(many):
                continue
            segment = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) * (n + 1) if len(many) else value
            for part in _portions(np.full(len(many), n_starts)):
                seed, s = np.repeat(many[part], n_starts), np.tile(np.arange(n_starts), len(many[part]))
                middle, a, b = starts[s] + place[seed], at[owner[s]], at[owner[s] + 1]
                own = segment[first[seed]]
                x = np.searchsorted(segment + hit, own + np.clip(middle - most[seed], a, b))
                some = x < np.searchsorted(segment + hit, own + np.clip(middle + most[seed] + 1, a, b))
                votes.add(key[seed[some]] + s[some], key[seed[some]] + s[some] + 1)
            begin, end, count = votes.runs()
            enough = count >= self.need[begin // (n_starts + 1)]
            begin, end = begin[enough], end[enough]
            pair, q = _expanded(begin, end, begin // (n_starts + 1))
            pairs.append(pair - q)  # numbers by quote and sentence, n_starts of each quote
        pairs += [np.arange(n_starts) + q * n_starts for q in self.open]
        found = np.concatenate(pairs)
        return found // max(n_starts, 1), found % max(n_starts, 1)

    def distances(self, q: int, text: np.ndarray, ends: list[int]) -> list[int]:
        """Edit distances of the quote and the text's prefixes of the given (ascending) lengths."""
        code = self.code[q]
        if q not in self.masks:
            mask: dict[int, int] = {}
            for i, c in enumerate(code.tolist()):
                mask[c] = mask.get(c, 0) | 1 << i
            self.masks[q] = mask
        mask, full, top = self.masks[q], (1 << len(code)) - 1, 1 << len(code) - 1
        up, down, score, out, wanted = full, 0, len(code), [], set(ends)
        for j, c in enumerate(text[: ends[-1]].tolist(), 1):
            same = mask.get(c, 0)
            vertical = same | down
            diagonal = (((same & up) + up) ^ up) | same
            plus, minus = down | (full & ~(diagonal | up)), up & diagonal
            score += 1 if plus & top else -1 if minus & top else 0
            plus, minus = plus << 1 | 1, minus << 1
            up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
            if j in wanted:
                out.append(score)
        return out

    def matches(self, texts: list[str | None], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
        """``(text, quote, sentence, position, edits, characters of the span)`` of the spans within the edits."""
        step: list[tuple[int, np.ndarray]] = []
        for i, t in enumerate(texts):
            code = _code(t or "")
            if step and sum(len(c) for _, c in step) + len(code) > STEP_CHARS:
                yield from self._step(step, window)
                step = []
            if len(code):
                step.append((i, code))
        if step:
            yield from self._step(step, window)

    def _step(self, step: list[tuple[int, np.ndarray]], window: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        code = np.concatenate([c for _, c in step])
        sizes = np.array([len(c) for _, c in step])
        at = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(step)), sizes)
        begins = np.unique(np.concatenate([at[:-1], np.flatnonzero(np.isin(code, _ENDS)) + 1]))
        begins = begins[begins < len(code)]
        owner = row[begins]
        number = np.arange(len(begins)) - np.searchsorted(owner, np.arange(len(step)))[owner]
        # A span begins at its first character that is no space, and ends at its last.
        filled = np.append(np.flatnonzero(code != 32), len(code))
        starts = filled[np.searchsorted(filled, begins)]
        quotes, sentences = self.candidates(code, row, starts)
        for q, s in zip(quotes.tolist(), sentences.tolist(), strict=True):
            start, n = int(starts[s]), len(self.code[q])
            last = at[owner[s] + 1]
            ends = [int(begins[e]) if e < len(begins) and owner[e] == owner[s] else int(last) for e in range(s + 1, s + 1 + window)]
            spans = {}
            for end in ends:
                k = int(np.searchsorted(filled, end)) - 1
                size = int(filled[k]) + 1 - start if k >= 0 else 0
                if size > 0 and abs(size - n) <= n * (1 - self.least) and start < last:
                    spans[size] = None
            if not spans:
                continue
            lengths = sorted(spans)
            for size, edits in zip(lengths, self.distances(q, code[start : start + lengths[-1]], lengths), strict=True):
                if edits <= self.edits[q]:
                    yield step[owner[s]][0], q, int(number[s]), start - int(at[owner[s]]), edits, size


def _similar(rows: DataFrame, least: float) -> DataFrame:
    ratio = 1 - F.col("edits") / F.greatest("span_chars", "quote_chars")
    return rows.withColumn("ratio", T.decimal_round(ratio)).where(F.col("ratio") >= least)


def _blocks(quotes: DataFrame) -> Iterator[pa.Table]:
    """Quotes in blocks of bounded size, read one at a time."""
    spark = quotes.sparkSession
    total = quotes.agg(F.sum(F.length("quote"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        of = quotes.where(F.pmod(F.xxhash64("quote_id", "quote"), F.lit(n)) == b) if n > 1 else quotes
        yield of.select("quote_id", "quote").toArrow()


def fuzzy_matches(quotes: DataFrame, texts: DataFrame, key: str, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """``(quote_id, key, ratio, sentence, position)``: the best span of each quote (quote_id, quote) in each text, where one is similar.

    Ties go to the earlier sentence; ``position`` is where the span begins, in characters. Null and empty quotes and
    texts match nothing; rows of one key are one text's versions, of which the best counts; long texts are walked in
    whole. No match is lost: every similar span has the seeds it is found by.
    """
    spark = quotes.sparkSession
    bounded_batches(spark)
    quotes = quotes.where("length(quote) > 0")
    name, kinds = f"`{key}`", (quotes.schema["quote_id"].dataType.simpleString(), texts.schema[key].dataType.simpleString())
    out = spark.createDataFrame([], f"quote_id {kinds[0]}, {name} {kinds[1]}, {FOUND}")
    for block in _blocks(quotes):
        shared = spark.sparkContext.broadcast((block["quote_id"].combine_chunks(), block["quote"].to_pylist()))

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, held = shared.value
            index = Index(held, least)
            for batch in batches:
                rows = list(index.matches(batch[1].to_pylist(), window))
                t, q, *rest = zip(*rows, strict=True) if rows else [()] * 6
                sizes = [len(index.code[i]) for i in q]
                arrays = [ids.take(pa.array(q, pa.int64())), batch[0].take(pa.array(t, pa.int64())), *(pa.array(c, pa.int32()) for c in (*rest, sizes))]
                yield pa.RecordBatch.from_arrays(arrays, ["quote_id", key, "sentence", "position", "edits", "span_chars", "quote_chars"])

        out = out.unionByName(texts.select(key, "text").mapInArrow(walk, f"quote_id {kinds[0]}, {name} {kinds[1]}, {FOUND}"))
    scored = _similar(out, least)
    best = F.max_by(F.struct("ratio", "sentence", "position"), F.struct("ratio", -F.col("sentence"))).alias("b")
    return scored.groupBy("quote_id", key).agg(best).select("quote_id", key, "b.ratio", "b.sentence", "b.position")


def fuzzy_position(rows: DataFrame, quote: str, text: str, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """``rows`` with ``fuzzy_at``: where the best similar span of the row's own text begins, -1 where there is none.

    Rows are judged one by one; null and empty quotes and texts have none.
    """
    bounded_batches(rows.sparkSession)
    columns = rows.columns
    schema = rows.withColumn("fuzzy_at", F.lit(-1)).schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for q, t in zip(batch.column(columns.index(quote)).to_pylist(), batch.column(columns.index(text)).to_pylist(), strict=True):
                index = Index([q], least)
                n = len(index.code[0])
                ratio = lambda edits, size: round(1 - edits / max(size, n), 4)
                found = [(-ratio(e, size), s, p) for _, _, s, p, e, size in index.matches([t], window) if ratio(e, size) >= least]
                at.append(min(found)[2] if found else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*columns, "fuzzy_at"])

    return rows.mapInArrow(walk, schema)
