"""Words of a table found in texts: one automaton for all words, one walk over each text.

A walk costs the length of the text and the number of hits, however many words there are. Words are
sent in blocks of bounded size, each a pass over the texts; the words of a book's own cast come to
its texts by a join on the book, in rows of bounded size, so a book with many texts is split like any
skewed join and a book with many names makes several rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches

#: Characters of words in a block, and names in a row of a cast.
BLOCK_CHARS, CAST_ROW = 4 << 20, 4096
#: Automata of casts that a task keeps: texts of one book mostly follow each other.
KEPT_CASTS = 16


def automaton(words: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, (i, len(w)))
    out.make_automaton()
    return out


def occurrences(found: ahocorasick.Automaton, text: str | None) -> dict[int, tuple[int, int]]:
    """Per word that stands in the text: how often (left to right, without overlap with itself) and where first."""
    out: dict[int, list[int]] = {}
    if text and len(found):
        for end, (i, size) in found.iter(text):
            start, seen = end - size + 1, out.get(i)
            if seen is None:
                out[i] = [1, start, end]
            elif start > seen[2]:
                seen[0] += 1
                seen[2] = end
    return {i: (n, first) for i, (n, first, _) in out.items()}


def _blocks(words: DataFrame) -> Iterator[list[str]]:
    """The distinct words, in blocks of bounded size, read one at a time."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        of = words.where(F.pmod(F.xxhash64("word"), F.lit(n)) == b) if n > 1 else words
        yield sorted(of.toArrow()["word"].to_pylist())


def lexicon_counts(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, word, hits, position)`` with the lexicon's other columns (reason, hint): each word of ``lexicon`` that stands
    in a text, how often (without overlap), and where first, in characters.

    Empty and null words and texts have no hits; a word that the lexicon repeats has the columns of its first row by
    their values; words that overlap each other are all counted; repeated keys are rows of their own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = lexicon.where("length(word) > 0")
    more = [c for c in lexicon.columns if c != "word"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, word string, hits long, position int"
    out = spark.createDataFrame([], schema)
    for words in _blocks(given.select("word").distinct()):
        shared = spark.sparkContext.broadcast(words)

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = shared.value
            found = automaton(words)
            for batch in batches:
                rows = [(t, words[i], n, at) for t, value in enumerate(batch[1].to_pylist()) for i, (n, at) in occurrences(found, value).items()]
                t, word, hits, at = zip(*rows, strict=True) if rows else [()] * 4
                arrays = [batch[0].take(pa.array(t, pa.int64())), pa.array(word, pa.string()), pa.array(hits, pa.int64()), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, [key, "word", "hits", "position"])

        out = out.unionByName(docs.select(key, text).mapInArrow(walk, schema))
    if not more:
        return out
    first = given.groupBy("word").agg(F.min(F.struct(*more)).alias("_more")).select("word", "_more.*")
    return out.join(first, "word").select(key, "word", "hits", "position", *more)


def mentions(texts: DataFrame, cast: DataFrame, key: str, text: str = "text", by: str = "book_name") -> DataFrame:
    """``(by, key, name, hits, position)``: the names of a text's own book (``cast``: by, name) that it holds.

    Empty and null names, null books and texts have no hits; repeated names count once, repeated keys are rows of
    their own; a book without a cast gives none.
    """
    bounded_batches(texts.sparkSession)
    names = cast.where(F.col(by).isNotNull() & (F.length("name") > 0)).select(by, "name").distinct()
    sizes = names.groupBy(by).agg(F.ceil(F.count("*") / CAST_ROW).alias("_rows"))
    part = F.pmod(F.xxhash64("name"), F.col("_rows")).alias("_part")
    rows = names.join(sizes, by).select(by, "name", part).groupBy(by, "_part").agg(F.sort_array(F.collect_list("name")).alias("_names"))
    met = texts.select(by, key, text).join(rows, by).select(by, key, text, "_part", "_names")
    kinds = {c: texts.schema[c].dataType.simpleString() for c in (by, key)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        casts: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            names = batch[4]
            for t, (book, value, number) in enumerate(zip(batch[0].to_pylist(), batch[2].to_pylist(), batch[3].to_pylist(), strict=True)):
                known = casts.get((book, number))
                if known is None:
                    words = names[t].as_py()
                    if len(casts) >= KEPT_CASTS:
                        casts.pop(next(iter(casts)))
                    known = casts[book, number] = (words, automaton(words))
                out += [(t, known[0][i], n, at) for i, (n, at) in occurrences(known[1], value).items()]
            t, name, hits, at = zip(*out, strict=True) if out else [()] * 4
            take = pa.array(t, pa.int64())
            arrays = [batch[0].take(take), batch[1].take(take), pa.array(name, pa.string()), pa.array(hits, pa.int64()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [by, key, "name", "hits", "position"])

    return met.mapInArrow(walk, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, name string, hits long, position int")


def frequencies(found: DataFrame, by: str = "book_name") -> DataFrame:
    """Per book and name: in how many texts it stands, and how often in all. ``found`` is the index of names to texts."""
    return found.groupBy(by, "name").agg(F.count("*").alias("texts"), F.sum("hits").alias("hits"))
