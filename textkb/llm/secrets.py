"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

*Base spans* are what three patterns find (assignments, access ids, hexadecimal runs).
*Model spans* are further runs of ``RUN_LEAST`` or more key-like characters that a first-order Markov model
of random strings explains better than one of ordinary identifiers. Both kinds of samples are
labelled by how they are made: the random ones are drawn from the alphabets that keys use (``ALPHABETS``,
a model for each, the best one counts); the ordinary ones are the words of at most about
``TRAIN_DOCUMENTS`` documents (chosen by a hash of their id) put together the way code does
(snake_case, camelCase, paths, numbers behind), long numbers, dates and rulers. So no secret of the corpus counts as an ordinary string.
The counts are summed by Spark into a table of fixed size. Every text is scanned whole.

A run is a model span if its ratio exceeds ``THRESHOLD`` in total and ``PER_CHARACTER`` on average: long
ordinary runs cannot collect it bit by bit. Shorter runs and secrets made of words are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hash_unit, sample_fraction, table, utf8

#: The three base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

RUN_LEAST = 16  # characters of a run that the models look at
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}", re.ASCII)
THRESHOLD, PER_CHARACTER = 12.0, 1.6  # nats by which a random model must explain a run better
TRAIN_DOCUMENTS, TRAIN_IDENTIFIERS = 5_000, 200_000
RANDOM_STRINGS = 2000  # for each alphabet

WORD = re.compile(r"[A-Za-z]{2,15}", re.ASCII)
BACK_OFF = 10.0
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_START = len(_ALPHABET)  # stands before the first character
_SIDE = len(_ALPHABET) + 1
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))

_UPPER, _LOWER, _DIGITS = _ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62]
#: What keys are drawn from: hexadecimal, base 32, digits and one case, letters and digits, the two base 64.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", _UPPER + "234567", _UPPER + _DIGITS, _LOWER + _DIGITS, _ALPHABET[:62], _ALPHABET[:62] + "+/", _ALPHABET[:62] + "-_")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_TO_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TO_RUN = bytes(120 if b < 128 and _CODE[b] >= 0 else 32 for b in range(256))


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches, sorted. The byte tests only skip hopeless texts."""
    raw = text.encode() if raw is None else raw
    out = []
    lowered = raw.lower()
    if any(k in lowered for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in raw.translate(_TO_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(out)


def runs(text: str, raw: bytes | None = None) -> list[tuple[int, int]]:
    raw = text.encode() if raw is None else raw
    if b"x" * RUN_LEAST not in raw.translate(_TO_RUN):
        return []
    return [m.span() for m in RUN.finditer(text)]


def _codes(run: str) -> np.ndarray:
    return _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]


def _transitions(run: str) -> np.ndarray:
    c = _codes(run)
    return np.concatenate([[_START], c[:-1]]) * _SIDE + c


def _overlaps(spans: list[tuple[int, int, int]], a: int, b: int) -> bool:
    return any(s < b and a < e for s, _, e in spans)


def random_strings(alphabet: str, n: int = RANDOM_STRINGS, seed: int = 1) -> list[str]:
    """Labelled samples of one kind: strings of 16 to 64 characters of an alphabet, all alike likely."""
    g = np.random.default_rng([seed, len(alphabet), ord(alphabet[0])])
    return ["".join(alphabet[i] for i in g.integers(0, len(alphabet), m)) for m in g.integers(16, 65, n)]


_JOINS = (
    lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "".join(w),
    lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w),
    lambda w: "_".join(x.upper() for x in w), lambda w: "".join(x.upper() for x in w),
)


def identifiers(words: list[str], share: int = 1 << 32) -> list[str]:
    """Labelled samples of the other kind: three neighbouring words put together as code does, some with a number.

    Of these the part that ``share`` (of 2**32) says, spread over all numbers.
    """
    out = []
    for k in range(len(words) // 3):
        if (k * 2654435761 + len(words)) % (1 << 32) < share:
            name = _JOINS[k % len(_JOINS)](words[3 * k : 3 * k + 3])
            out.append(f"{name}{k % 2000}" if k % 5 == 0 else f"{name}={words[3 * k]}" if k % 11 == 0 else name)
    return out


def plain_strings(n: int = RANDOM_STRINGS, seed: int = 2) -> list[str]:
    """More ordinary samples: long numbers, dates, rulers."""
    g = np.random.default_rng(seed)
    numbers = ["".join(map(str, g.integers(0, 10, m))) for m in g.integers(16, 25, n)]
    dates = [f"{y}-{m:02d}-{d:02d}" + ("" if k % 2 else f"_{k % 24:02d}-{k % 60:02d}") for k, (y, m, d) in enumerate(g.integers((1990, 1, 1), (2031, 13, 29), (n, 3)))]
    return numbers + dates + [c * 20 for c in "=-_+/"] * (n // 20)


def _pairs(names: list[str]) -> np.ndarray:
    """How often each character pair stands in the names, counted in one array."""
    if not names:
        return np.zeros(_SIDE * _SIDE, np.int64)
    c = _CODE[np.frombuffer(("\n" + "\n".join(names)).encode("ascii"), np.uint8)]
    c[c < 0] = _START
    at = np.flatnonzero(c != _START)
    return np.bincount(c[at - 1] * _SIDE + c[at], minlength=_SIDE * _SIDE)


def fit(docs: DataFrame, bound: int = TRAIN_DOCUMENTS, most: int = TRAIN_IDENTIFIERS) -> np.ndarray:
    """Log-likelihood ratios (random over ordinary) of each character pair, (alphabets, pairs).

    Ordinary identifiers come from about ``bound`` documents, and of these about ``most`` are drawn by their number, so
    long texts do not make the sample longer. Null and empty texts, and an empty table, give none: then the ordinary
    model knows the plain strings alone. Rows of one id are drawn alike; the order of rows does not matter.
    """
    n = docs.count()
    sample = docs.where(hash_unit("doc_id", seed="secrets") < sample_fraction(n, bound)).select("text")
    words = sample.agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0] or 0
    share = int(sample_fraction(words // 3, most) * 2**32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIDE * _SIDE, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += _pairs(identifiers(WORD.findall(text or ""), share))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    ordinary = _pairs(plain_strings()).astype(float)
    for r in sample.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        ordinary[r["at"]] += r["n"]
    ordinary = ordinary.reshape(_SIDE, _SIDE)
    # A pair backs off to its second character alone, and that to a uniform one, as if seen BACK_OFF times.
    single = (ordinary.sum(axis=0) + 1.0) / (ordinary.sum() + _SIDE)
    p_ordinary = (ordinary + BACK_OFF * single) / (ordinary.sum(axis=1, keepdims=True) + BACK_OFF)
    out = []
    for alphabet in ALPHABETS:
        random = _pairs(random_strings(alphabet)).reshape(_SIDE, _SIDE)
        one = (random.sum(axis=0) + 0.02) / (random.sum() + 0.02 * _SIDE)
        p_random = (random + BACK_OFF * one) / (random.sum(axis=1, keepdims=True) + BACK_OFF)
        out.append(np.log(p_random / p_ordinary).ravel())
    return np.array(out)


def ratio(models: np.ndarray, run: str) -> float:
    """Nats by which the best of the random models explains a run better than the ordinary one."""
    return float(models[:, _transitions(run)].sum(axis=1).max())


def secret_spans(docs: DataFrame, bound: int = TRAIN_DOCUMENTS, threshold: float = THRESHOLD, per_character: float = PER_CHARACTER) -> DataFrame:
    """Per row of ``docs``: doc_id and its spans ``array<struct<kind,start,end,score>>`` (code points,
    end exclusive) by start, then kind.

    A null or empty text has none; repeated rows and ids are judged row by row; texts are scanned whole,
    however long; overlapping matches of different kinds are all given, ties by kind as listed; a model span
    never overlaps a base span; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = spark.sparkContext.broadcast(fit(docs, bound))
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                text = raw.decode("utf-8", "replace")
                spans = base_spans(text, raw)
                found = [(s, k, e, None) for s, k, e in spans]
                for a, b in runs(text, raw):
                    if not _overlaps(spans, a, b):
                        score = ratio(models, text[a:b])
                        if score > max(threshold, per_character * (b - a)):
                            found.append((a, 3, b, score))
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(found, key=lambda f: f[:3])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return docs.mapInArrow(scan, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
