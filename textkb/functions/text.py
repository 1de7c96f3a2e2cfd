"""Column functions over text: cleaning steps, predicates, statistics, scores and keys.

All are plain Column expressions, so they stay inside whole-stage code generation. Patterns are
written so that they mean the same in Java and RE2 (``\\x{..}`` escapes, explicit space classes).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware engines see it.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The same, character by character.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Advertisement patterns (case-insensitive, within a line).
AD_PATTERNS = (
    r"最新网址：.*?\.com",
    r"手机版阅读网址：.*",
    r"天才一秒记住.*?秒",
    r"本站.*?域名",
    r"www\..*?\.com",
    r"手机阅读.*",
    r"一秒记住.*",
)
#: Fixed value: a whole line of ten or more characters none of which is ordinary.
SYMBOL_LINE = rf"(?m)^[^\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9{SPACE}.,;:!?，。；：！？、\n]{{10,}}$"
#: Noise lines (case-insensitive, line by line).
NOISE_LINES = (
    rf"^[{SPACE} ]*(求月票|求订阅|求推荐|求收藏|求打赏|拜求|感谢.*?打赏|感谢.*?万赏).*?$",
    rf"^[{SPACE} ]*(PS|ps|Ps|pS)[：:].*?$",
    rf"^[{SPACE} ]*(作者的话|作者说|题外话|碎碎念)[：:].*?$",
    rf"^[{SPACE} ]*(本章未完|点击下一页继续阅读|最新网址|手机阅读).*?$",
)
#: Fixed value: a line that opens a chapter (closes an author's note).
CHAPTER_LINE = r"^第[零一二三四五六七八九十百千万两\d]+[章节回]"
#: Fixed value: a line that opens an author's note.
NOTE_LINE = rf"作者的话|作者说|题外话|碎碎念|^(PS|ps|Ps|pS)[：:{SPACE}]|^(PS|ps|Ps|pS)$"
#: Placeholders that stand for nothing.
PLACEHOLDERS = ("无", "未知", "暂无", "没有", "null", "none", "未提供")
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"
MOJIBAKE = r"(?:[\x{80}-\x{ff}]{3,}|[\x{c0}-\x{ff}]{2,})"
XML_ILLEGAL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{fffe}\x{ffff}]"
QUOTED = r"(?s)[\"“”「『](.*?)[\"“”」』]"
QUOTED_SINGLE = r"(?s)[\"“”‘’「『'](.*?)[\"“”‘’」』']"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning ---------------------------------------------------------------------------------------


def unix_newlines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\r\n?", "\n")


def without(c: Column | str, patterns: Sequence[str], flags: str = "") -> Column:
    out = col(c)
    for p in patterns:
        out = F.regexp_replace(out, F.lit(flags + p), F.lit(""))
    return out


def without_ads(c: Column | str, patterns: Sequence[str] = AD_PATTERNS) -> Column:
    return without(c, patterns, "(?i)")


def without_symbol_lines(c: Column | str) -> Column:
    return without(c, [SYMBOL_LINE])


def without_noise_lines(c: Column | str, patterns: Sequence[str] = NOISE_LINES) -> Column:
    return without(c, patterns, "(?mi)")


def without_controls(c: Column | str) -> Column:
    return without(c, [CONTROL])


def collapsed(c: Column | str) -> Column:
    """Three or more line ends become two; runs of spaces and tabs one space."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\n{3,}", "\n\n"), r"[ \t]+", " ")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))  # looks at both ends alone, where a pattern would walk the whole text


def trimmed_lines(c: Column | str) -> Column:
    """Every line trimmed, then the whole."""
    return strip(F.array_join(F.transform(F.split(col(c), "\n"), strip), "\n"))


def full_width_braces(c: Column | str) -> Column:
    return F.translate(col(c), "{}", "｛｝")


def is_short(c: Column | str, least: int = 500) -> Column:
    return F.length(col(c)) < least


def is_mojibake(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(MOJIBAKE), F.lit(False))


def xml_safe(c: Column | str) -> Column:
    return without(c, [XML_ILLEGAL])


def joined_known(c: Column | str, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """A list of strings without blanks and placeholders, joined by commas."""
    bad = F.array(*map(F.lit, placeholders))
    return F.array_join(F.filter(col(c), lambda w: (F.trim(w) != "") & ~F.array_contains(bad, F.trim(w))), ",")


def scalar_items(c: Column | str) -> Column:
    """The scalar items of a JSON list as strings; anything else gives an empty list."""
    items = F.from_json(col(c), "array<string>")
    return F.coalesce(F.filter(items, lambda x: x.isNotNull() & ~x.rlike(r"^\s*[\[{]")), F.array().cast("array<string>"))


# --- statistics and scores ----------------------------------------------------------------------------


def decimal_round(c: Column, places: int = 4) -> Column:
    """Rounding through a decimal, so that engines agree at binary near-ties."""
    return F.round(c.cast("decimal(20,10)"), places).cast("double")


def dialogue(c: Column | str, pattern: str = QUOTED) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), 1)


def dialogue_chars(c: Column | str, pattern: str = QUOTED) -> Column:
    return F.aggregate(dialogue(c, pattern), F.lit(0).cast("long"), lambda s, x: s + F.length(x))


def distinct_chars(c: Column | str) -> Column:
    return F.size(F.array_distinct(F.split(col(c), ""))).cast("long")


def chunk_score(c: Column | str, emotion: str = "[！？…]") -> Column:
    """0.4 dialogue + 0.3 emotion marks + 0.3 variety of characters, each cut at 1; empty: 0."""
    n = F.length(col(c)).cast("double")
    part = lambda k, v: F.least(F.lit(1.0), F.lit(float(k)) * v.cast("double") / n)
    marks = F.regexp_count(col(c), F.lit(emotion))
    score = part(3, dialogue_chars(c)) * 0.4 + part(200, marks) * 0.3 + part(8, distinct_chars(c)) * 0.3
    return F.when(F.length(col(c)) > 0, score).otherwise(F.lit(0.0))


def token_estimate(c: Column | str) -> Column:
    wide = F.regexp_count(col(c), F.lit(r"[^\x{00}-\x{7f}]"))
    return wide * F.lit(1.5) + (F.length(col(c)) - wide) * F.lit(0.25)


#: Boundaries at which a text may be cut, best first.
CUTS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?")


def cut_at_boundary(c: Column | str, limit: int, cuts: Sequence[str] = CUTS, window: int = 500) -> Column:
    """At most ``limit`` characters, cut after the last boundary of the best kind in the last ``window``
    characters, if that lies past half of the limit; else a hard cut."""
    text = col(c)
    head = F.substring(text, 1, limit)
    tail_from = max(limit - window, 0)
    tail = F.substring(head, tail_from + 1, window)
    places = []
    for b in cuts:
        back = F.instr(F.reverse(tail), b[::-1])
        at = F.when(back > 0, F.lit(tail_from) + F.length(tail) - back + 1)
        places.append(F.when(at - len(b) > limit // 2, at))
    at = F.coalesce(*places, F.lit(limit)).cast("int")
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), at))


# --- keys and numbers -----------------------------------------------------------------------------------


def key(*parts: Column | str) -> Column:
    """md5 of the JSON array of the parts as strings; null parts count as empty."""
    return F.md5(F.to_json(F.array(*(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))))


def chapter_number(c: Column | str, none: int = 9999) -> Column:
    return F.coalesce(F.regexp_extract(col(c), r"(\d+)", 1).try_cast("int"), F.lit(none))


def shortened(c: Column | str, n: int, mark: str = "...") -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit(mark))).otherwise(col(c))
