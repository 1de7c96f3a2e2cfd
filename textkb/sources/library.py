"""Reading a library of text files: scan, names, decoding, merging, lexicons and saved tables."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, let, strip

UNKNOWN_AUTHOR, UNSORTED = "未知作者", "未分类"

#: Words that are no part of a name, in the order in which they are taken out.
JUNK_WORDS = ("番外完结", "精校版", "未删减", "未删", "全本", "完整版", "完结", "番外", "补番", "补车", "补车番", "补C", "补F", "连载", "坑", "作者", "补r", "补R", "实体", "福利", "校对", "精校", "全订", "-txt", "txt", "TXT", "NP", "np", "全文")
#: Words that are no part of a name when they stand alone.
LONE_JUNK = ("番全", "番", "补")
#: Patterns of texts that stand where an author should but name none.
FAKE_AUTHORS = (r"热门", r"^未知$", r"^全$", r"^\+全$", r"^\+$", r"感言", r"贺岁篇", r"补最新福", r"东南亚篇", r"南京篇", r"共七册", r"个故事", r"篇$", r"^车$", r"微博小段", r"补全", r"未删减完整版", r"精校版全本", r"校对版全本", r"共\d+章", r"补\d+", r"\+番外", r"^\[.*\]$", r"^［.*］$", r"^不含.*?$", r"^番番$", r"^完&$", r"^\d+$")
#: A tag that no author has, a one-character author, Latin author names.
TAG, SHORT_AUTHORS, LATIN_AUTHORS = "电竞", ("乱",), ("priest", "阎ZK", "larivegauche")
#: Folders that are no authors.
NO_AUTHOR_FOLDERS = ("热门小说", "男频热文", "晋江长佩top合集带番外（精校版全本）", "晋江长佩top合集带番外", "晋江长佩top带番外", "晋江高收藏必存50本", "作者合集小说", "novels", "男频文62本", "《盗墓笔记》全系列", "盗墓笔记全系列", "凡人修仙传", "十日终焉", "三体·书籍", "三体书籍", "三体", "全职高手", "诛仙", "轮回乐园", "辰东7本合集", "辰东7本", "辰东", "龙族", "诡秘地海", "诡舍", "大奉打更人", "天才俱乐部", "学霸的黑科技系统", "宿命之环", "异兽迷城", "我师兄实在太稳健了", "我的属性修行人生", "我的模拟长生路", "我真没想重生啊", "择日走红", "深海余烬", "牧神记", "穷鬼的上下两千年", "逆天邪神", "遮天", "雪中悍刀行", "高武纪元", "天倾之后", "大乘期才有逆袭系统", "庆余年", "全球高武", "剑来", "剑出大唐", "一世之尊", "万古神帝", "万族之劫", "从红月开始", "光阴之外", "全职法师", "大王饶命", "将夜", "小阁老", "惊悚乐园", "斗破苍穹", "明日之劫", "明朝那些事儿", "晚明", "死亡万花筒", "死人经", "求魔", "灵境行者", "烂柯棋缘", "黎明之剑", "黜龙", "FOG［电竞］", "FOG[电竞]", "《嘘别说话》请及时转存，失效不补！", "《子夜十》+《子夜鸮》", "《宫廷生存纪事》请及时转存，购买三天后失效不补！！", "《江医生他怀了死对头的崽》by葫芦酱", "《荒唐》作者：臣年", "《陈年烈苟》", "《默读》作者：priest", "值此新婚", "剑来（1-49册）(烽火戏诸侯)", "囚于永夜（及时保存，过后失效不补）", "天官赐福", "将进酒", "提灯映桃花", "沧澜道", "漂亮的玫瑰", "老婆孩子热炕头", "臣服四部曲+笼中鸟", "神秘复苏", "秦吏", "第一序列", "覆汉", "超神机械师", "道诡异仙", "太平令", "热门", "盗墓笔记", "晋江长佩top", "我不是戏神")
#: What a file's marks say about its kind; the first mark found counts.
KINDS = (("补番", "番外"), ("番全", "番外"), ("补车", "番外"), ("补车番", "番外"), ("补C", "番外"), ("补F", "番外"), ("fw番外", "番外"), ("fw完结", ""), ("fw连载", ""), ("番外", "番外"), ("含番外", "番外"), ("坑", ""), ("未删减", ""), ("未删", ""), ("精校", ""))
#: What goes from a file name before it is taken apart.
NAME_NOISE = (r"^[\[【（(]+.*?[\]】）)]+\s*", r"^(完整版|实体番全|番外全|福利番全|附带番外|精校版|含实体番|新版|旧版|回归重修版|【.*?】)\s*", r"^\d+\s*", "（加作者感言）", r"\[电竞\]", "［电竞］", "（精校版全本.*?）", "（校对版全本.*?）", "（未删.*?）", "（完结.*?）")
#: Brackets with what they hold, then brackets that lost their partner.
BRACKETS = (r"[(（\[【『].*?[)）\]】』]", r"[(（\[【『］\]]+", r"[)）\]】』]+$")
#: Edition marks of a title.
EDITIONS = r"(番外完结|番外全|完结\+番外|正文\+微博番外全|精校版|未删减|全本|\+番外全|\+番外)"
#: Characters that a file name cannot hold, and what a title or an author does not begin or end with.
ILLEGAL, TITLE_EDGE, AUTHOR_EDGE = r'[\\/:*?"<>|&]', r" \-_·.！!？?", r" \-_·.！!？?()（）+"


def files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """``(path, content)`` of all matching files below ``root``."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.load(root).select("path", "content")


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, in any store that Spark reads."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(file)


# --- names --------------------------------------------------------------------------------------------


def book_title(name: Column | str) -> Column:
    """What stands in 《》, else what stands before the author, without edition marks."""
    name = col(name)
    quoted = F.nullif(strip(F.regexp_extract(name, "《(.*?)》", 1)), F.lit(""))
    before = strip(F.regexp_extract(name, r"(?is)^(.*?)(?:作者[：:]|by|\z)", 1))
    plain = strip(F.regexp_replace(before, r"\[番外\]|\(番外\)|番外|补车|精校版|未删减", ""))
    return F.coalesce(quoted, plain)


def title_suffix(name: Column | str) -> Column:
    return F.regexp_extract(col(name), r"(\[番外\]|\[补车\]|\[精校\]|\(番外\))", 1)


def _field(name: Column, label: str, until: str) -> Column:
    stop = rf"(?=\s*(?:{until})[：:]|\s*$)" if until else r"\s*$"
    return F.nullif(strip(F.regexp_extract(name, rf"{label}\s*(.+?){stop}", 1)), F.lit(""))


def author(name: Column | str) -> Column:
    name = col(name)
    return F.coalesce(_field(name, "作者[：:]", "分类|标签"), _field(name, r"(?i)by\s", "分类|标签"), F.lit(UNKNOWN_AUTHOR))


def category(name: Column | str, path: Column | str) -> Column:
    """From the name, else from the folders of the path relative to the root."""
    parts = F.split(col(path), "/")
    nested = strip(F.replace(F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"[(（].*?[)）]", ""), F.lit("合集"), F.lit("")))
    folder = F.when(F.size(parts) >= 3, nested).when(F.size(parts) == 2, F.element_at(parts, 1)).otherwise(F.lit(UNSORTED))
    return F.coalesce(_field(col(name), "分类[：:]", "标签"), folder)


def tags(name: Column | str) -> Column:
    found = F.split(F.coalesce(_field(col(name), "标签[：:]", ""), F.lit("")), "、")
    return F.filter(F.transform(found, strip), lambda t: t != "")


def descriptors(paths: DataFrame, root: str, *more: str) -> DataFrame:
    """A book descriptor for each file ``path``, with ``more`` columns of its row."""
    prefix = root.rstrip("/") + "/"
    relative = F.when(F.instr("path", prefix) > 0, F.substring_index("path", prefix, -1)).otherwise(F.col("path"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.txt$", "")
    rows = paths.withColumn("_n", name).withColumn("_r", relative)
    return rows.select(
        F.concat(book_title("_n"), title_suffix("_n")).alias("book_name"), book_title("_n").alias("pure_name"), author("_n").alias("author"),
        category("_n", "_r").alias("category"), tags("_n").alias("tags"), F.array("path").alias("all_files"), *more,
    )


def is_fake_author(c: Column | str) -> Column:
    """Blank, a number, one of the patterns that name nobody, or Latin letters alone that are no known author."""
    c = F.coalesce(col(c), F.lit(""))
    fake = F.contains(c, F.lit(TAG))
    for p in FAKE_AUTHORS:
        fake = fake | c.rlike(p)
    latin = c.rlike("[a-zA-Z]") & ~F.lower(c).isin(*(x.lower() for x in LATIN_AUTHORS)) & ~c.rlike(HAN)
    return (c == "") | fake | latin


HAN = r"[\x{4e00}-\x{9fa5}]"


def _gone(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def _within(c: Column, edge: str) -> Column:
    return _gone(c, f"^[{edge}]+", f"[{edge}]+$")


def folder_author(folder: Column | str) -> Column:
    """The author that a folder is named after: no brackets, counts, collection words, tags or Latin head."""
    name = _gone(F.coalesce(col(folder), F.lit("")), r"[(（].*?[)）]", r"\d+本.*$", "合集|小说|书籍|[·.]")
    name = strip(_gone(_gone(strip(name), r"［电竞］|\[电竞\]", r"(?s)[／/].*$"), r"^[A-Za-z\s]+"))
    return F.when(~name.isin("三体", "盗墓笔记"), name).otherwise("")


def canonical_name(name: Column | str, folder: Column | str, parent: Column | str) -> Column:
    """``struct(title, author, kind)`` of a messy file name (without extension).

    Noise goes first. The title is what stands in 《》, or before a dash, or before white space or the author's
    label; the author is what is labelled, else in brackets, else behind an underline or at the end. Junk goes
    from both. An author that names nobody is taken from the folder, then from its parent folder (not from
    folders on the block list or named like the title), then unknown.
    """
    raw = F.coalesce(col(name), F.lit(""))
    kind = None
    for word, value in KINDS:
        found = F.contains(raw, F.lit(word))
        kind = F.when(found, value) if kind is None else kind.when(found, value)
    parts = let(strip(_gone(raw, *NAME_NOISE)), _split_name)
    tidy = let(parts, lambda p: F.struct(_tidy_title(p["title"]).alias("title"), _tidy_author(p["author"]).alias("author")))

    def chosen(p: Column) -> Column:
        single = (F.length(p["author"]) == 1) & ~p["author"].isin(*SHORT_AUTHORS)
        own = F.when(~is_fake_author(p["author"]) & ~p["author"].startswith("+") & ~single, p["author"])
        inherited = lambda c: let(folder_author(c), lambda f: F.when(~is_fake_author(f) & ~f.isin(*NO_AUTHOR_FOLDERS) & (f != p["title"]), f))
        who = _within(_gone(F.coalesce(own, inherited(folder), inherited(parent), F.lit("未知")), ILLEGAL), "·. ")
        return F.struct(_gone(p["title"], ILLEGAL).alias("title"), F.coalesce(F.nullif(who, F.lit("")), F.lit("未知")).alias("author"), kind.otherwise("").alias("kind"))

    return let(tidy, chosen)


def _split_name(head: Column) -> Column:
    """Raw title and author of a name without its noise."""
    first = lambda c, p, g=1: F.regexp_extract(c, p, g)
    label, bracket = r"(?i)(?:作者[：:\s_]*|by\s*)(.*)", r"[(（]([^)）]+)[)）]"
    dash = r"^(.+?)[-_]([^\d\-_]{2,10})$"

    def author(rest: Column, *others: tuple[Column, Column]) -> Column:
        """What is labelled in the rest of the name, else bracketed, else the first of the others that holds."""
        out = F.when(rest.rlike(label), first(rest, label)).when(rest.rlike(bracket), first(rest, bracket))
        for holds, value in others:
            out = out.when(holds, value)
        return strip(out)

    underline, ending = r"[_\-]{1,2}([a-zA-Z0-9\x{4e00}-\x{9fa5}]+)$", r"([\x{4e00}-\x{9fa5}A-Za-z]{2,})$"
    quoted, dashed = head.rlike("(?s)《.*》"), head.rlike(dash)
    by_quoted = let(strip(first(head, "(?s)《.*》(.*)$")), lambda r: author(r, (r.rlike(underline), first(r, underline)), (F.lit(True), first(r, r"(?s)^([^\s\[（(【\-_.]*)"))))
    lead = strip(first(head, r"(?s)^(.*?)(?:\s+|_|作者[：:\s_]*|by\s*|\z)"))
    by_plain = let(F.substring(head, F.length(lead) + 1, F.length(head)), lambda r: author(r, (r.rlike(ending), first(r, ending)), (F.lit(True), r)))
    title = F.when(quoted, first(head, "(?s)《(.*)》")).when(dashed, strip(first(head, dash))).otherwise(lead)
    who = F.when(quoted, by_quoted).when(dashed, strip(first(head, dash, 2))).otherwise(by_plain)
    return F.struct(title.alias("title"), who.alias("author"))


def _tidy_title(title: Column) -> Column:
    title = _within(_gone(title, *BRACKETS, EDITIONS, "[》《]|作者|txt|TXT"), TITLE_EDGE)
    title = F.regexp_replace(_gone(title, r"\s+"), "^子-鸮$", "子夜鸮")
    return _gone(title, r"(?<!\d)-(?!\d)")


def _tidy_author(who: Column) -> Column:
    who = _within(_gone(F.translate(_gone(who, *BRACKETS), "-_", "  "), "作者|txt|TXT"), AUTHOR_EDGE)
    for w in JUNK_WORDS:
        who = strip(F.replace(who, F.lit(w), F.lit("")))
    for w in LONE_JUNK:
        who = strip(_gone(who, rf"(?:^|[\s\-_]){w}(?:$|[\s\-_])"))
    return _gone(who, r"[番补]\d+$", r"\d{4}$", r"\s+")


# --- content ------------------------------------------------------------------------------------------------


def decoded(raw: bytes) -> str:
    """By byte order mark, else the first of five encodings that reads all bytes as clean text, else Latin-1."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace").replace("\ufeff", "")
    for name in ("utf-8", "gbk", "gb2312", "utf-16-le", "big5"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        controls = sum(ord(c) < 32 and c not in "\t\n\r" for c in text[:5000])
        if text.count("\ufffd") <= 10 and controls <= 50:
            return text.replace("\ufeff", "")
    return raw.decode("latin-1")


def texts(found: DataFrame) -> DataFrame:
    """``(path, text)`` of ``(path, content)`` rows; a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [decoded(bytes(c)) for c in b["content"]]})

    found.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    return found.mapInPandas(run, "path string, text string")


def merged(parts: DataFrame, key: str = "book_name") -> DataFrame:
    """The files of each book as one text, in path order."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "text")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(word, reason, replace_hint)`` from a rule lexicon file (one JSON document)."""
    raw = spark.read.option("multiLine", True).schema("banned_words struct<items:array<struct<word:string,reason:string,replace_hint:string>>>").json(path)
    return raw.select(F.inline("banned_words.items"))


def saved_table(spark: SparkSession, path: str, book_name: str | None = None) -> DataFrame:
    """A saved table, or one book of it (the folder of that book alone is read)."""
    df = spark.read.parquet(path)
    return df if book_name is None else df.where(F.col("book_name") == book_name)
