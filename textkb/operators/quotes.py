"""Verification and location of quotes in texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .fuzzy import fuzzy_position


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalization, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Characters that NFKC leaves alone wherever they stand: ASCII, Latin letters without ligatures and digraphs, Greek and
#: Cyrillic letters, kana, the first block of ideographs, and the quotation marks and dashes of running text.
PLAIN = r"\x00-\x7F\u00A1-\u00A7\u00AB\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03A1\u03A3-\u03C9\u0400-\u0481\u2013\u2014\u2018-\u201E\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF"


def unverified(rows: DataFrame, quote: str, text: str, name: str = "unverified", least: int = 8) -> DataFrame:
    """``rows`` with ``name``: true for a quote of ``least`` or more characters that the text does not contain, both in NFKC,
    spaces and line ends aside; null where either is null.

    Only rows that hold a character which NFKC may change pass through Python: the others are a branch of their own.
    """
    both = F.concat(F.col(quote), F.col(text))
    # Texts of one byte a character are ASCII: no pattern walks them.
    changes = F.coalesce((F.octet_length(both) != F.length(both)) & both.rlike(f"[^{PLAIN}]"), F.lit(False))

    def judged(part: DataFrame, form) -> DataFrame:
        dense = lambda c: F.translate(form(F.col(c)), " \n", "")
        return part.withColumn(name, (F.length(dense(quote)) >= least) & ~F.contains(dense(text), dense(quote)))

    return judged(rows.where(~changes), lambda c: c).unionByName(judged(rows.where(changes), nfkc))


def positions(rows: DataFrame, quote: str, text: str) -> DataFrame:
    """``level`` and ``position`` (from 0, -1: none): the exact place, else the place with white space left out,
    counted back to the original by the non-space characters before it. Null and blank quotes are nowhere. One
    expression a row, no join; only rows found without white space are walked."""
    found = lambda a, b: F.expr(f"if({b} = '', 0, coalesce(instr({a}, {b}), 0))")
    dense = lambda c: f"regexp_replace(`{c}`, r'[{T.SPACE}]', '')"
    rows = rows.withColumn("_exact", found(f"`{text}`", f"`{quote}`"))
    rows = rows.withColumn("_dense", F.when(F.col("_exact") > 0, F.lit(0)).otherwise(found(dense(text), dense(quote))))
    return _with_place(rows, text)


def _with_place(rows: DataFrame, text: str) -> DataFrame:
    chars = F.split(F.col(text), "")
    blank = lambda c: c.rlike(f"[{T.SPACE}]")
    walk = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.lit(-1).alias("found")),
        lambda s, c: F.struct(
            (s["seen"] + F.when(blank(c), 0).otherwise(1)).alias("seen"),
            (s["at"] + 1).alias("at"),
            F.when((s["found"] < 0) & ~blank(c) & (s["seen"] + 1 == F.col("_dense")), s["at"]).otherwise(s["found"]).alias("found"),
        ),
    )["found"]
    level = F.when(F.col("_exact") > 0, "exact").when(F.col("_dense") > 0, "spaces").otherwise("none")
    place = F.when(F.col("_exact") > 0, F.col("_exact") - 1).when(F.col("_dense") > 0, walk).otherwise(-1)
    return rows.withColumn("level", level).withColumn("position", place.cast("int")).drop("_exact", "_dense")


def located(rows: DataFrame, quote: str, text: str) -> DataFrame:
    """``level`` (exact, spaces, fuzzy or none) and ``position`` of each row's quote in its own text: ``positions``, and where that
    finds none the best similar span of sentences. Rows found before are not walked again."""
    found = positions(rows, quote, text)
    left = fuzzy_position(found.where("level = 'none'"), quote, text)
    near = left.withColumn("level", F.when(F.col("fuzzy_at") >= 0, "fuzzy").otherwise("none")).withColumn("position", F.col("fuzzy_at")).drop("fuzzy_at")
    return found.where("level <> 'none'").unionByName(near)
