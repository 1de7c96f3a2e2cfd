"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are compared as lower-case characters with runs of white space as one space.

* *Windows.* Items are dealt into classes by length (``CLASSES``). The windows of a class are two thirds as
  long as its shortest item, and a text has one every third of that: wherever an item stands, a whole
  window lies in it. All windows of an item are indexed, so its place in the text does not matter.
* *Embedding.* The CGK random walk reads the window and writes 3w/2 characters; after each, a random
  bit for (step, character) says whether to move on. Texts at edit distance k end up within O(k^2)
  Hamming distance, as the walks fall into step again after an edit.
* *LSH.* Each of ``TABLES`` tables samples some places of a stretch of one of the walks; a key is the XOR of
  random words of (place, character). One of the item's windows has to collide in one table. Classes,
  samples and tables are set for a recall of at least 0.9 at every share of random edits up to
  ``MAX_EDITS`` (tests: items of 24 to 1,000 characters). A walk over hundreds of characters loses its step
  under so many edits, so items of more than 240 characters have several windows of 107 instead of one.
* *Short items.* Items shorter than the least of ``CLASSES`` are not hashed by walks: all their places within
  ``MAX_EDITS`` are found, by pieces (``ShortItems``).
* *Verification.* A colliding pair is dropped only if the ``STRETCH`` characters of the item around it
  stand in the text with more than ``STRETCH_EDITS`` times the allowed share of edits. The rest is
  verified by the exact edit distance of the item to the best substring around the place it proposes
  (bit-parallel), which must be at most ``MAX_EDITS`` of the item's length.

The benchmark is the stated query set: it is broadcast in blocks of ``BLOCK_CHARS`` characters, each
a pass over the corpus without any shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, U64, bounded_batches, code_points, mix64, slices, table, utf8

#: Least length of an item, width of its windows, length of a sampled stretch of the walk, places sampled in it.
CLASSES = ((24, 16, 18, 9), (36, 24, 18, 9), (54, 36, 18, 10), (81, 54, 24, 14), (160, 107, 24, 14))
WALKS, TABLES = 2, 64
FLAG_BITS = 18
MAX_EDITS = 0.2
STRETCH, STRETCH_EDITS = 32, 2
BLOCK_CHARS = 200_000
WINDOWS = 32768  # of a text that are embedded at once
SEGMENT = 160  # places of a text at which stretches are tried at once
SCHEMA = "doc_id long, item_id long, start int, end int, edits int, item_chars int"

_BLANK = np.zeros(0x10000, bool)
_BLANK[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def normalized(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points with single spaces, offsets of the rows, and each one's old place."""
    low = np.minimum(cp, 0xFFFF)
    blank = _BLANK[low]
    out = np.where(cp > 0xFFFF, cp, _LOWER[low])
    out[blank] = 32
    first = np.zeros(len(cp) + 1, bool)
    first[at] = True
    again = blank.copy()
    again[1:] &= blank[:-1]
    keep = ~(again & ~first[: len(cp)])
    places = np.flatnonzero(keep)
    return out[places], np.concatenate([[0], np.cumsum(keep)])[at], places


def _symbols(cp: np.ndarray) -> np.ndarray:
    return ((cp ^ (cp >> np.uint32(8)) * np.uint32(167)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


_SYMBOL = _symbols(np.arange(0x10000, dtype=np.uint32))


def symbols(cp: np.ndarray) -> np.ndarray:
    """One of 255 symbols (1..255) for each code point; 0 stands for the end."""
    out, beyond = _SYMBOL.take(cp, mode="clip"), np.flatnonzero(cp > 0xFFFF)
    out[beyond] = _symbols(cp[beyond])
    return out


_bits: dict[tuple[int, int], np.ndarray] = {}


def _walk_bits(width: int, walk: int) -> np.ndarray:
    if (width, walk) not in _bits:
        g = np.random.default_rng(1000 * walk + width)
        b = g.integers(0, 2, (width * 3 // 2, 256))
        b[:, 0] = 0
        _bits[width, walk] = b
    return _bits[width, walk]


_samples: dict[tuple[int, int, int, int], tuple[np.ndarray, list[np.ndarray]]] = {}


def _sampling(steps: int, walk: int, stretch: int, sampled: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random odd factor for each step of a walk, and the places that each of its tables samples: half of the
    stretches lie evenly, half at random."""
    known = steps, walk, stretch, sampled
    if known not in _samples:
        g, room = np.random.default_rng(77 + walk), max(1, steps - stretch + 1)
        factors = (mix64(np.arange(steps, dtype=np.uint64) + U64(1 + walk * (1 << 32))) >> U64(32)).astype(np.uint32) | np.uint32(1)
        places = []
        for t in range(TABLES // WALKS):  # within a stretch: an edit spoils what follows it for a while
            begin = int(g.integers(0, room)) if t % 2 else (t // 2 * stretch // 2) % room
            places.append(begin + g.choice(min(stretch, steps), min(sampled, steps), replace=False))
        _samples[known] = factors, places
    return _samples[known]


def keys(symbol: np.ndarray, start: np.ndarray, width: int, walk: int, stretch: int, sampled: int) -> Iterator[np.ndarray]:
    """The 32-bit keys of each table of one walk for the windows of ``width`` symbols at ``start``.

    The CGK embedding of a window has 3w/2 characters (a walk passes about 3/4 of it). The symbols are read in
    place, as windows overlap; a walk that leaves its window stays there and reads 0.
    """
    steps = width * 3 // 2
    bits, (factors, places) = _walk_bits(width, walk), _sampling(steps, walk, stretch, sampled)
    place, end, hashed = start.astype(np.intp), start + width, np.empty((steps, len(start)), np.uint32)
    read, index, move = np.empty(len(start), np.uint8), np.empty(len(start), np.intp), np.empty(len(start), bits.dtype)
    for j in range(steps):
        symbol.take(place, out=read, mode="clip")  # unbuffered
        if j >= width:
            read[place >= end] = 0
        np.multiply(read, factors[j], out=hashed[j])
        index[:] = read
        place += bits[j].take(index, out=move, mode="clip")
    key = np.empty(len(start), np.uint32)
    for picked in places:
        np.add(hashed[picked[0]], hashed[picked[1]], out=key) if len(picked) > 1 else np.copyto(key, hashed[picked[0]])
        for j in picked[2:]:
            key += hashed[j]
        yield key


def _flag(key: np.ndarray) -> np.ndarray:
    return key >> np.uint32(32 - FLAG_BITS)


def bit_rows(symbol: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """For the ``size`` symbols (32 at most) from each ``begin`` on: the places of each of 32 classes of symbols, as bits."""
    out = np.zeros((len(begin), 32), np.uint32)
    every = np.arange(len(begin))
    for j in range(size):
        out[every, symbol[begin + j] & 31] |= np.uint32(1 << j)
    return out


def least_edits(bits: np.ndarray, size: int, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern (a row of ``bit_rows``) to a substring of its text, classes told
    apart only, so never more than the true one: ``best_substring`` for all rows at once, one word a row."""
    n, one, top = len(bits), np.uint32(1), np.uint32(size - 1)
    bits, rows = bits.ravel(), np.arange(n, dtype=np.intp) * 32
    pv, mv = np.full(n, (1 << size) - 1, np.uint32), np.zeros(n, np.uint32)
    score = np.full(n, size, np.int32)
    best, at = score.copy(), np.empty(n, np.intp)
    eq, xv, xh, ph, mh = (np.empty(n, np.uint32) for _ in range(5))
    for column in np.ascontiguousarray(texts.T & np.uint8(31)):
        np.add(rows, column, out=at)
        bits.take(at, out=eq, mode="clip")  # unbuffered
        np.bitwise_or(eq, mv, out=xv)
        np.bitwise_and(eq, pv, out=xh)  # xh = (((eq & pv) + pv) ^ pv) | eq
        xh += pv
        xh ^= pv
        xh |= eq
        np.bitwise_or(xh, pv, out=ph)  # ph, mh = mv | ~(xh | pv), pv & xh
        np.invert(ph, out=ph)
        ph |= mv
        np.bitwise_and(pv, xh, out=mh)
        np.right_shift(ph, top, out=eq)
        eq &= one
        score += eq.view(np.int32)
        np.right_shift(mh, top, out=eq)
        eq &= one
        score -= eq.view(np.int32)
        ph <<= one
        mh <<= one
        np.bitwise_or(xv, ph, out=pv)  # pv, mv = mh | ~(xv | ph), ph & xv
        np.invert(pv, out=pv)
        pv |= mh
        np.bitwise_and(ph, xv, out=mv)
        np.minimum(best, score, out=best)
    return best


def _regions(symbol: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """``length`` symbols from each ``begin`` on, 0 outside ``low`` to ``high``."""
    out, inside = np.empty((len(begin), length), np.uint8), (begin >= low) & (begin + length <= high)
    if inside.any():
        out[inside] = np.lib.stride_tricks.sliding_window_view(symbol, length)[begin[inside]]
    rest = np.flatnonzero(~inside)
    at = begin[rest, None] + np.arange(length)
    out[rest] = np.where((at >= low[rest, None]) & (at < high[rest, None]), symbol[np.clip(at, 0, len(symbol) - 1)], np.uint8(0))
    return out


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``counts`` rows for each: whose they are, and their number from 0."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class ItemIndex:
    """Keys of all windows of the items of one class."""

    def __init__(self, width: int, stretch: int, sampled: int, items: list[tuple[int, np.ndarray]]):
        self.width, self.stride, self.items, self.sampling = width, width // 3, items, (stretch, sampled)
        self.lengths = np.array([len(cp) for _, cp in items])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.symbols = np.concatenate([symbols(cp) for _, cp in items])
        self.item = np.repeat(np.arange(len(items)), self.lengths - width + 1)
        counts = self.lengths - width + 1
        self.offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = np.minimum(self.lengths, STRETCH)
        self.first_bits = np.cumsum(self.lengths - sizes + 1) - (self.lengths - sizes + 1)
        self.bits = np.concatenate([bit_rows(self.symbols, b + np.arange(n - m + 1), m) for b, n, m in zip(self.begins, self.lengths, sizes, strict=True)])
        self.tables = []
        for walk in range(WALKS):
            for k in keys(self.symbols, self.begins[self.item] + self.offset, width, walk, *self.sampling):
                order = np.argsort(k, kind="stable").astype(np.int32)
                flags = np.zeros(1 << FLAG_BITS, bool)
                flags[_flag(k)] = True
                self.tables.append((k[order], order, flags))

    def proposals(self, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window (its number in ``start``) and an item's window that collide in any table, each once."""
        pairs = []
        for walk in range(WALKS):
            for t, k in enumerate(keys(symbol, start, self.width, walk, *self.sampling), walk * (TABLES // WALKS)):
                known, order, flags = self.tables[t]
                maybe = np.flatnonzero(flags.take(_flag(k).astype(np.intp), mode="clip"))
                k = k[maybe]
                lo = np.searchsorted(known, k, "left")
                same = known.take(lo, mode="clip") == k
                maybe, k, lo = maybe[same], k[same], lo[same]
                if not len(maybe):
                    continue
                n = np.searchsorted(known, k, "right") - lo
                hit = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pairs.append(np.repeat(maybe, n) * len(self.item) + hit)
        pairs = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
        return pairs // len(self.item), pairs % len(self.item)

    def plausible(self, symbol: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, hit: np.ndarray, max_edits: float) -> np.ndarray:
        """Whether the stretch of the item around each proposed window stands in the text (rows ``low`` to
        ``high``) with at most ``STRETCH_EDITS`` times the allowed share of edits."""
        item, offset = self.item[hit], self.offset[hit]
        m = np.minimum(self.lengths[item], STRETCH)
        begin = np.clip(offset - (m - self.width) // 2, 0, self.lengths[item] - m)
        limit = (STRETCH_EDITS * max_edits * m).astype(np.int64)
        first, good = start - offset + begin - limit // 2, np.zeros(len(hit), bool)
        for size in np.unique(m).tolist():
            rows = np.flatnonzero(m == size)
            for a in range(0, len(rows), 1 << 13):
                r = rows[a : a + (1 << 13)]
                most = int(limit[r[0]])
                texts = _regions(symbol, first[r], low[r], high[r], size + most // 2 * 2)
                good[r] = least_edits(self.bits[self.first_bits[item[r]] + begin[r]], size, texts) <= most
        return good

    def possible(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether each item may stand in the text from ``low`` to ``high`` within ``limit`` edits: its disjoint
        stretches have no more edits in sum, each wherever it fits best. No item that does is turned away."""
        sizes, good = np.minimum(self.lengths[item], STRETCH), np.zeros(len(item), bool)
        for size in np.unique(sizes).tolist():
            rows, length = np.flatnonzero(sizes == size), SEGMENT + 2 * size  # a best place is no longer than 2 * size
            for a in range(0, len(rows), 1 << 8):
                r = rows[a : a + (1 << 8)]
                stretches, segments = self.lengths[item[r]] // size, np.maximum(-(-(high[r] - low[r]) // SEGMENT), 1)
                of, n = _each(stretches)  # a row for each stretch of each item
                first = self.first_bits[item[r]][of] + n * size
                one, s = _each(segments[of])  # and segment of its text
                where, begin = r[of[one]], low[r[of[one]]] + s * SEGMENT
                least = least_edits(self.bits[first[one]], size, _regions(symbol, begin, low[where], high[where], length))
                least = np.minimum.reduceat(least, np.flatnonzero(s == 0))
                good[r] = np.add.reduceat(least, np.flatnonzero(n == 0)) <= limit[r]
        return good


class ShortItems:
    """Items too short for windows. One of (edits + 1) equal pieces of an item stands unchanged in every
    match, so all places are met: pieces are looked up at each place of the text."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items, self._pieces = items, {}

    def pieces(self, max_edits: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(length, codes in order, item, offset in the item)`` for each length of a piece, 8 at most."""
        if max_edits not in self._pieces:
            by: dict[int, list] = {}
            for k, (_, cp) in enumerate(self.items):
                parts, s = int(max_edits * len(cp)) + 1, symbols(cp)
                size = len(cp) // parts
                for o in range(0, parts * size, size):
                    by.setdefault(min(size, 8), []).append((int(_codes(s[o : o + size], min(size, 8))[0]), k, o))
            self._pieces[max_edits] = [(n, *(np.array(c, t) for c, t in zip(zip(*sorted(x), strict=True), (np.uint64, np.int64, np.int64), strict=True))) for n, x in sorted(by.items())]
        return self._pieces[max_edits]

    def candidates(self, symbol: np.ndarray, rows_at: np.ndarray, max_edits: float) -> Iterator[tuple[int, int, int, int, int]]:
        """``(row, item, begin, end, least edits)`` of the stretches that may hold an item."""
        lengths = np.array([len(cp) for _, cp in self.items])
        limits = (max_edits * lengths).astype(np.int64)
        bits = [bit_rows(symbols(cp), np.zeros(1, np.int64), len(cp)) for _, cp in self.items]
        for size, known, items, offsets in self.pieces(max_edits):
            for a in range(0, len(symbol) - size + 1, 1 << 16):
                codes = _codes(symbol[a : a + (1 << 16) + size - 1], size)
                lo, hi = np.searchsorted(known, codes, "left"), np.searchsorted(known, codes, "right")
                n = hi - lo
                at = np.repeat(np.arange(a, a + len(codes)), n)
                hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.searchsorted(rows_at, at, "right") - 1
                inside = at + size <= rows_at[row + 1]
                at, hit, row = at[inside], hit[inside], row[inside]
                for k in np.unique(items[hit]).tolist():
                    length, limit = int(lengths[k]), int(limits[k])
                    mine = np.flatnonzero(items[hit] == k)
                    for b in range(0, len(mine), 1 << 13):
                        m = mine[b : b + (1 << 13)]
                        r, first = row[m], at[m] - offsets[hit[m]] - limit
                        least = least_edits(np.repeat(bits[k], len(m), axis=0), length, _regions(symbol, first, rows_at[r], rows_at[r + 1], length + 2 * limit))
                        good = least <= limit
                        begin, end = np.maximum(first, rows_at[r]), np.minimum(first + length + 2 * limit, rows_at[r + 1])
                        yield from zip(r[good].tolist(), [k] * int(good.sum()), begin[good].tolist(), end[good].tolist(), least[good].tolist(), strict=True)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """The places of the first of equal rows."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = c - c.min(initial=0)
        key = key * (int(c.max(initial=0)) + 1) + c
    return np.unique(key, return_index=True)[1]


def _codes(symbol: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` symbols from each place on, as one number."""
    out = np.zeros(len(symbol) - size + 1, np.uint64)
    for j in range(size):
        out |= symbol[j : j + len(out)].astype(np.uint64) << U64(8 * j)
    return out


def best_substring(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to a substring of ``text``, if at most ``limit``, and its first
    end: the bit-parallel column recurrence over integers of any length."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    for j, c in enumerate(text.tolist()):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = score, j + 1
    return best


def located(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the best substring within ``limit``."""
    found = best_substring(item, text, limit)
    if found is None:
        return None
    edits, end = found
    back = best_substring(item[::-1], text[:end][::-1], edits)
    return edits, end - back[1], end


def _indexes(items: list[tuple[int, np.ndarray]]) -> list[ItemIndex | ShortItems]:
    by_class: dict[int, list] = {}
    for one in items:
        by_class.setdefault(sum(c[0] <= len(one[1]) for c in CLASSES), []).append(one)
    return [ItemIndex(*CLASSES[c - 1][1:], x) if c else ShortItems(x) for c, x in sorted(by_class.items())]


_latest: dict[str, list] = {}  # the index that this worker built last


def _indexed(token: str, items: list[tuple[int, np.ndarray]]) -> list[ItemIndex | ShortItems]:
    if token not in _latest:
        _latest.clear()
        _latest[token] = _indexes(items)
    return _latest[token]


def search(cp: np.ndarray, at: np.ndarray, indexes: list[ItemIndex | ShortItems], max_edits: float, one: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """``(row, item_id, start, end, edits, item_chars)``: the best place of each item in each row; with ``one``
    a row in which an item is found is not searched further."""
    text, rows_at, places = normalized(cp, at)
    symbol = symbols(text)
    best: dict[tuple[int, int], tuple] = {}
    done: set[int] = set()
    for index in indexes:
        if isinstance(index, ShortItems):
            for r, k, lo, hi, least in index.candidates(symbol, rows_at, max_edits):
                item_id, item = index.items[k]
                old = best.get((r, item_id))
                if one and r in done:
                    continue
                if old and (least, int(places[lo] - at[r])) > old[:2]:
                    continue
                found = located(item, text[lo:hi], int(max_edits * len(item)))
                if found:
                    edits, s, e = found
                    value = (edits, int(places[lo + s] - at[r]), int(places[lo + e - 1] - at[r]) + 1, len(item))
                    best[r, item_id] = min(old or value, value)
                    done.add(r)
            continue
        w = index.width
        windows = np.maximum((np.diff(rows_at) - w) // index.stride + 1, 0)
        row = np.repeat(np.arange(len(windows)), windows)
        if not len(row):
            continue
        start = rows_at[:-1][row] + (np.arange(len(row)) - (np.cumsum(windows) - windows)[row]) * index.stride
        guesses = []
        for a in range(0, len(row), WINDOWS):
            part = start[a : a + WINDOWS]
            i, hit = index.proposals(symbol, part)
            once = _first_of(i, index.item[hit], (part[i] - index.offset[hit]) // 4)  # neighbours say the same
            i, hit = i[once], hit[once]
            good = index.plausible(symbol, part[i], rows_at[row[a + i]], rows_at[row[a + i] + 1], hit, max_edits)
            i, hit = i[good], hit[good]
            which = index.item[hit]
            limits = (max_edits * index.lengths[which]).astype(np.int64)
            guesses.append((row[a + i], which, (part[i] - index.offset[hit]) // np.maximum(limits, 1)))
        r, which, bin_ = (np.concatenate(x) for x in zip(*guesses, strict=True))
        once = _first_of(r, which, bin_)
        r, which, bin_ = r[once], which[once], bin_[once]
        limits = (max_edits * index.lengths[which]).astype(np.int64)
        lo = np.maximum(rows_at[r], np.where(limits > 0, (bin_ - 1) * limits, bin_))
        hi = np.minimum(rows_at[r + 1], np.where(limits > 0, (bin_ + 2) * limits, bin_) + index.lengths[which])
        good = index.possible(symbol, lo, hi, which, limits)
        for r, k, lo, hi, limit in zip(*(x[good].tolist() for x in (r, which, lo, hi, limits)), strict=True):
            item_id, item = index.items[k]
            if one and r in done:
                continue
            found = located(item, text[lo:hi], limit)
            if found:
                edits, s, e = found
                value = (edits, int(places[lo + s] - at[r]), int(places[lo + e - 1] - at[r]) + 1, len(item))
                best[r, item_id] = min(best.get((r, item_id), value), value)
                done.add(r)
    return sorted((r, i, s, e, d, n) for (r, i), (d, s, e, n) in best.items())


def _item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        cp = np.frombuffer(r["text"].encode("utf-32-le", "replace"), np.uint32)
        item = normalized(cp, np.array([0, len(cp)]))[0]
        item = item[1:] if len(item) and item[0] == 32 else item
        item = item[:-1] if len(item) and item[-1] == 32 else item
        if not len(item):
            continue
        if block and size + len(item) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], item))
        size += len(item)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows ``(doc_id, item_id, start, end, edits, item_chars)``: each item found in each row of ``docs``
    at its best place (code points, end exclusive; ties: the first).

    Null and empty texts hold nothing; rows are judged one by one, so repeated rows repeat their findings
    and rows with a null doc_id give theirs with a null; texts are searched whole, however long; items
    that are null or empty after normalization take no part; an empty table on either side gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def scan(shared, token: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                indexes = _indexed(token, shared.value)
                ids = batch.column(0).to_pylist()
                data, offsets = utf8(batch.column(1))
                out = []
                for a, b in slices(offsets):
                    cp, at = code_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    out += [(ids[a + r], *rest) for r, *rest in search(cp, at, indexes, max_edits)]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    names = [x.split()[0] for x in SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        return docs.mapInArrow(run, SCHEMA)

    passes = [scan(spark.sparkContext.broadcast(block), uuid.uuid4().hex) for block in _item_blocks(benchmark, block_chars)]
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns and nothing shuffled.

    Rows are judged one by one by their own text: null ids, repeated ids and clashing column names make no
    difference, null and empty texts stay. Each block of the benchmark judges what the earlier ones left.
    """
    spark, place = docs.sparkSession, docs.columns.index("text")
    bounded_batches(spark)

    def kept(docs: DataFrame, shared, token: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                indexes = _indexed(token, shared.value)
                data, offsets = utf8(batch.column(place))
                free = np.ones(batch.num_rows, bool)
                for a, b in slices(offsets):
                    cp, at = code_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    free[[a + found[0] for found in search(cp, at, indexes, max_edits, one=True)]] = False
                yield batch.filter(pa.array(free))

        return docs.mapInArrow(run, docs.schema)

    for block in _item_blocks(benchmark, block_chars):
        docs = kept(docs, spark.sparkContext.broadcast(block), uuid.uuid4().hex)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
