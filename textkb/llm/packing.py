"""Token ids and packed binary output: best-fit-decreasing packing with a segment tree over capacities.

Each task tokenizes its documents and packs them in shards of about ``SHARD_SEQUENCES`` full rows, so
nothing is shuffled and memory follows the shard, whatever the document sizes or groups are. Documents
longer than a row are split without loss: full rows, then the rest, each a segment that knows its
place. A shard's segments, longest first, go to the open row with the least room that still fits;
a segment tree over room sizes finds it in O(log row length).

Output, a row for each packed sequence: the id matrix row (little-endian, padded), the cumulative
segment lengths, where positions start again, and which document and token offset each segment has.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256  # free in the vocabulary: it ends every document
ROW_TOKENS = 2048
SHARD_SEQUENCES = 512

#: Fixed value: the word pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = (
    "shard string, sequence int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, doc_offsets array<int>"
)

_SPACE_RUN = re.compile(r"\s\s")
_LOOKAHEAD = r"\s+(?!\S)|"


class Tokenizer:
    """Byte-level BPE. The pattern's look-ahead only matters where white space meets white space;
    texts without that use the pattern less the look-ahead, which gives the same ids much faster."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN, end: int | None = END_OF_TEXT):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        make = lambda p: tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={})
        self.encoding, self.simple = make(pattern), make(pattern.replace(_LOOKAHEAD, ""))
        self.dtype = np.dtype("<u2") if max(max(ranks.values()), end or 0) < 1 << 16 else np.dtype("<u4")
        self.end = [] if end is None else [end]

    def ids(self, text: str) -> np.ndarray:
        found = (self.encoding if _SPACE_RUN.search(text) else self.simple).encode_ordinary(text)
        return np.array(found + self.end if found else found, self.dtype)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read on the driver: executors need not hold it."""
    with open(path, "rb") as f:
        return f.read()


_tokenizers: dict[tuple, Tokenizer] = {}


def tokenizer(vocabulary: bytes, *key) -> Tokenizer:
    """One per worker process: it is slow to build."""
    key = (hash(vocabulary), *key)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(vocabulary, *key[1:])
    return _tokenizers[key]


class Capacities:
    """Open rows by room left; ``take(n)`` gives one with the least room >= n."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(self.size)]
        self.tree = [0] * (2 * self.size)  # rows below each node

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up, until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:  # down, to its leftmost leaf with rows
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.tree[i] -= 1
            i >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Rows of segment numbers; every length is in 1..row_tokens; ties keep their order."""
    rows: list[list[int]] = []
    open_rows = Capacities(row_tokens)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = open_rows.take(lengths[k])
        if found is None:
            rows.append([k])
            found = len(rows) - 1, row_tokens
        else:
            rows[found[0]].append(k)
        if found[1] > lengths[k]:
            open_rows.add(found[0], found[1] - lengths[k])
    return rows


def _packed(name: str, segments: list[tuple[int | None, int, np.ndarray]], row_tokens: int, pad: int, dtype) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing([len(s[2]) for s in segments], row_tokens)
    for first in range(0, len(rows), 256):
        columns: list[list] = [[] for _ in range(8)]
        for number, row in enumerate(rows[first : first + 256], first):
            parts = [segments[k] for k in row]
            ends = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])]).tolist()
            ids = np.full(row_tokens, pad, dtype)
            ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
            for c, v in zip(columns, (name, number, ends[-1], ids.tobytes(), ends, ends[:-1], [p[0] for p in parts], [p[1] for p in parts]), strict=True):
                c.append(v)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int | None = END_OF_TEXT, row_tokens: int = ROW_TOKENS, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """Packed sequences of the texts of ``docs`` (doc_id, text), columns as in ``SCHEMA``.

    Every token of every text is in exactly one segment; a document's segments in order of
    ``doc_offsets`` are its ids with the end mark. Null and empty texts have no segment; a null
    doc_id is kept as null; repeated rows are packed as often as they come; long texts are split into
    full rows and a rest; segments of equal length keep their order; padding repeats the end mark (or 0)
    after ``n_tokens``. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokenizer(shared.value, PATTERN, end), TaskContext.get()
        part, shard, held, segments = task.partitionId() if task else 0, 0, 0, []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                ids = coder.ids(text)
                segments += [(doc, k, ids[k : k + row_tokens]) for k in range(0, len(ids), row_tokens)]
                held += len(ids)
                if held >= shard_sequences * row_tokens:
                    yield from _packed(f"{part:06d}-{shard:05d}", segments, row_tokens, end or 0, coder.dtype)
                    shard, held, segments = shard + 1, 0, []
        if segments:
            yield from _packed(f"{part:06d}-{shard:05d}", segments, row_tokens, end or 0, coder.dtype)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
