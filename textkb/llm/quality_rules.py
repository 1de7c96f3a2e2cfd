"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a Column over a text that is true where the text fails. The rules stand in one CASE
expression, so a row that one of them rejects never meets the later ones, and the order decides the
cost. It is found on a bounded sample: one pass says which rules each sampled row fails, one timed
pass a rule says what the rule costs, and then the rule that rejects most of the rows still left
for its cost comes next (rules overlap, so rejections are counted among the rows left). The order
changes the cost alone: a row is kept where no rule fails, whatever comes first.

Nothing is shuffled. Everything about a text is computed inside its row; repeated windows are found
by sorting the row's own window hashes (64 bits), so a long text costs n log n and one row at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_unit, materialize, sample_fraction, table, unique_names

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"
#: Blanks of Java's patterns are exactly the six above.
WORD = r"\S++"
#: Rows that the order of the rules is found on.
SAMPLE_ROWS = 500
#: Words of a window.
WINDOW = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _without(chars: str) -> Column:
    return F.length(F.translate(_text(), chars, ""))


def _words() -> Column:
    return F.regexp_extract_all(_text(), F.lit(WORD), F.lit(0))


def _lines() -> Column:
    return F.filter(F.split(_text(), "\n"), lambda x: x.rlike(r"\S"))


def _covered(starts: Column) -> Column:
    """How many words the windows at these (sorted) places cover together."""
    steps = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash stands twice or more in the array."""

    def starts(pairs: Column) -> Column:
        same = lambda s, i: F.coalesce(F.get(pairs, i)["h"] == s["h"], F.lit(False))
        twice = F.filter(pairs, lambda s, i: same(s, i - 1) | same(s, i + 1))
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, starts), _covered))


def repeat_words() -> Column:
    """Words of the text that lie in 3-word windows found twice or more in it, the first included."""

    def of(words: Column) -> Column:
        first = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
        return let(F.transform(first, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW)))), _repeated)

    return let(_words(), of)


#: What rules are made of. Each is a long, 0 for a null text.
STATISTICS: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.regexp_count(_text(), F.lit(WORD)).cast("long"),
    "word_chars": lambda: _without(_BLANKS).cast("long"),
    "n_symbols": lambda: (F.length(_text()) - _without(SYMBOLS)).cast("long"),
    "n_dup_lines": lambda: let(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": repeat_words,
    "n_lines": lambda: F.size(_lines()).cast("long"),
    "n_letters": lambda: F.length(F.regexp_replace(_text(), r"\P{L}++", "")).cast("long"),
    "n_capitals": lambda: F.length(F.regexp_replace(_text(), r"\P{Lu}++", "")).cast("long"),
    "n_lettered": lambda: F.regexp_count(_text(), F.lit(r"[^\s\p{L}]*+\p{L}\S*+")).cast("long"),
    "n_ellipses": lambda: F.regexp_count(_text(), F.lit(r"(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*(?:\n|\z)")).cast("long"),
    "n_bullets": lambda: F.regexp_count(_text(), F.lit(r"(?:\A|\n)[\x20\x09\x0B-\x0D]*[-*•][\x20\x09]")).cast("long"),
}


class Rule(NamedTuple):
    """A text fails where ``fails`` of the named statistics is true."""

    name: str
    uses: tuple[str, ...]
    fails: Callable[..., Column]


#: The two rules whose verdict is reported by itself.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
)
#: The further rules. Shares, so that long texts fare as short ones.
RULES = (
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 3 * n) | (c > 12 * n)),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("equal_lines", ("n_lines", "n_dup_lines"), lambda n, d: 10 * d > 3 * n),
    Rule("capitals", ("n_letters", "n_capitals"), lambda n, c: 2 * c > n),
    Rule("lettered_words", ("n_words", "n_lettered"), lambda n, w: 10 * w < 7 * n),
    Rule("ellipses", ("n_lines", "n_ellipses"), lambda n, e: 10 * e > 3 * n),
    Rule("bullets", ("n_lines", "n_bullets"), lambda n, b: 10 * b > 9 * n),
)


def _fails(rule: Rule, known: dict[str, str]) -> Column:
    """The rule over columns where the statistic is there already, else over the text itself."""
    return rule.fails(*(F.col(known[s]) if s in known else STATISTICS[s]() for s in rule.uses))


def greedy_order(rules: Sequence[Rule], masks: dict[int, int], cost: dict[str, float]) -> list[Rule]:
    """Rules by rejections among the rows still left for their cost; ``masks`` counts rows by the bits of failed rules."""
    left, out, masks = list(range(len(rules))), [], dict(masks)
    while left:
        worth = lambda k: (-sum(n for m, n in masks.items() if m >> k & 1) / cost[rules[k].name], cost[rules[k].name], k)
        best = min(left, key=worth)
        left.remove(best)
        out.append(rules[best])
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
    return out


def _seconds(df: DataFrame, value: Column) -> float:
    """The quicker of two timed passes that compute ``value`` for every row."""
    took = []
    for _ in range(2):
        t = time.perf_counter()
        df.agg(F.sum(value)).first()
        took.append(time.perf_counter() - t)
    return min(took)


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), known: Sequence[str] = (), rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that a sample of about ``rows`` rows asks for.

    Rows are drawn by a hash of their id (at most twice ``rows``, whatever repeats). Statistics named in ``known``
    cost a rule nothing, as they are computed anyway. An empty table leaves the order by cost alone.
    """
    fraction = sample_fraction(docs.count(), rows)
    drawn = docs.select("doc_id", "text").where(hash_unit("doc_id", seed="rules") < fraction).limit(2 * rows)
    for s in known:
        drawn = drawn.withColumn(s, STATISTICS[s]())
    drawn = materialize(drawn)
    columns = {s: s for s in known}
    masks = drawn.groupBy(sum(F.when(_fails(r, columns), F.lit(1 << k)).otherwise(0) for k, r in enumerate(rules)).alias("m")).count()
    nothing = _seconds(drawn, F.length(_text()))
    cost = {r.name: max(_seconds(drawn, _fails(r, columns).cast("int")) - nothing, 1e-3) for r in rules}
    return greedy_order(rules, {r["m"]: r["count"] for r in masks.collect()}, cost)


def failed_rule(rules: Sequence[Rule], known: dict[str, str] | None = None) -> Column:
    """The name of the first rule that fails, null where none does; later rules are not computed for a rejected row."""
    out = None
    for r in rules:
        cond, name = F.coalesce(_fails(r, known or {}), F.lit(False)), F.lit(r.name)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule`` (null: kept); which of several failing rules is named follows the order found.

    A null text is an empty one and fails ``few_words``; rows are judged one by one, so repeated rows fare alike and
    a row at a rule's bar passes; an empty table stays empty; the name gets a trailing ``_`` where ``docs`` has it.
    """
    (name,) = unique_names(docs.columns, "failed_rule")
    return docs.withColumn(name, failed_rule(cascade_order(docs, rules, rows=rows)))


def keep(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns. Odd rows as in ``judge``."""
    (name,) = unique_names(docs.columns, "failed_rule")
    return docs.withColumn(name, failed_rule(cascade_order(docs, rules, rows=rows))).where(F.col(name).isNull()).drop(name)


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, the five reported statistics, base_failed, kept and failed_rule (of ``rules``, by the cascade).

    The five are wanted for every row, so rules over them cost nothing more; the base rules come first and what they
    reject meets no further rule. Nulls, empties, ties and repeats as in ``judge``; other columns are ignored.
    """
    given = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = cascade_order(docs, rules, known=given, rows=rows)
    out = docs.select("doc_id", "text", *(STATISTICS[s]().alias(s) for s in given))
    columns = {s: s for s in given}
    base = _fails(BASE[0], columns) | _fails(BASE[1], columns)
    out = out.withColumn("base_failed", base)
    out = out.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(failed_rule(order, columns)))
    return out.select("doc_id", *given, "base_failed", F.col("failed_rule").isNull().alias("kept"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), windows AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), repeated AS (
  SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, w) > 1
), covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(3)) AS k) GROUP BY row
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_capitals,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_lettered,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0B-\x0D]*$'))) AS n_ellipses,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09\x0B-\x0D]*[-*•][\x20\x09]'))) AS n_bullets
  FROM split LEFT JOIN covered USING (row)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 2 * n_capitals > n_letters OR 10 * n_lettered < 7 * n_words OR 10 * n_ellipses > 3 * n_lines OR 10 * n_bullets > 9 * n_lines) AS kept
FROM based
"""
