"""Scalar functions over document text, as Column builders that stay inside Spark's expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings, punctuation and patterns that the checks rely on.
REF_HEADINGS = ("参考文献", "references", "bibliography", "主要参考文献")
ACK_HEADINGS = ("致谢", "致谢：", "acknowledgement", "acknowledgments")
TOC_HEADINGS = ("目录", "目次", "contents")
APPENDIX_PREFIX = "附录"
SENTENCE_END = "。！？!?"
CLAUSE_PUNCT = "；，、：,;:）)】」”"
PUNCT_BEFORE = "。！？；，、：!?,;:"
CITE = r"^\s*([\[［【（(])?\s*(\d+(?:\s*[-–—~,，、]\s*\d+)*)\s*([\]］】）)])?\s*$"
REF_NUM = r"^\s*[\[［]\s*(\d+)\s*[\]］]"
HAN = r"[一-鿿]"
FULLWIDTH = r"[⺀-鿿　-〿＀-￯]"
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
CN_SIZES = {
    "初号": 42.0, "小初": 36.0, "一号": 26.0, "小一": 24.0, "二号": 22.0, "小二": 18.0, "三号": 16.0, "小三": 15.0,
    "四号": 14.0, "小四": 12.0, "五号": 10.5, "小五": 9.0, "六号": 7.5, "小六": 6.5, "七号": 5.5, "八号": 5.0,
}
ALIGNMENTS = {
    "left": "LEFT", "left_align": "LEFT", "顶格": "LEFT", "左对齐": "LEFT", "center": "CENTER", "centre": "CENTER", "居中": "CENTER",
    "right": "RIGHT", "右对齐": "RIGHT", "justify": "JUSTIFY", "两端对齐": "JUSTIFY", "兩端對齊": "JUSTIFY",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: Column | str) -> Column:
    """Lower case without any white space; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)[\s　]+", ""))


def strip(c: Column | str) -> Column:
    """Without white space at both ends, ideographic spaces included, which trim() would leave."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^[\s　]+|[\s　]+$", "")


def hex_mod(digest: Column, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(modulus))


def issue_id(rule: Column, *parts: Column) -> Column:
    """Short id: the rule and four digits of a hash of the parts. issue_key() is the unique one."""
    joined = F.concat_ws("|", rule, *parts)
    return F.format_string("%s-%04d", rule, hex_mod(F.sha1(joined.cast("binary")), 10000))


def issue_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fingerprint(c: Column | str) -> Column:
    """First 12 hexadecimal digits of the SHA-1 of the normalised text."""
    return F.substring(F.sha1(norm(c).cast("binary")), 1, 12)


def excerpt(text: Column, start: Column, end: Column, around: int = 18) -> Column:
    """The text around [start, end), with an ellipsis where it was cut. Offsets count code points from 0."""
    lo, hi = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    return F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), F.substring(text, lo + 1, hi - lo), F.when(hi < F.length(text), F.lit("…")).otherwise(F.lit("")))


def bracket_of(token: Column) -> Column:
    """square, paren or none; null for what is no citation token."""
    op, cl = F.regexp_extract(token, CITE, 1), F.regexp_extract(token, CITE, 3)
    return (
        F.when(~token.rlike(CITE), None)
        .when(op.isin("[", "［", "【") | cl.isin("]", "］", "】"), "square")
        .when(op.isin("（", "(") | cl.isin("）", ")"), "paren")
        .otherwise("none")
    )


WIDEST = 1_000_000


def cited_numbers(token: Column) -> Column:
    """The numbers of a citation token, ranges written with a dash expanded. One of over WIDEST numbers is no range but two numbers."""
    body = F.regexp_replace(F.regexp_extract(token, CITE, 2), r"\s", "")
    return F.flatten(F.transform(F.split(body, "[,，、]"), _range_of))


def _range_of(piece: Column) -> Column:
    ends = F.transform(F.split(piece, "[-–—~]"), lambda x: x.cast("int"))
    first, last = F.element_at(ends, 1), F.element_at(ends, -1)
    wide = F.when((F.size(ends) == 2) & (first < last) & (last - first < WIDEST), F.sequence(first, last))
    return F.when(piece.rlike(r"^\d+([-–—~]\d+)*$"), F.coalesce(wide, ends)).otherwise(F.array().cast("array<int>"))


def position_of(text: Column, start: Column, end: Column) -> Column:
    """Where a citation stands to punctuation. At a paragraph's start nothing stands before it."""
    after, before = F.substring(text, end + 1, 1), F.when(start > 0, F.substring(text, start, 1)).otherwise(F.lit(""))
    behind = (before != "") & (F.instr(F.lit(PUNCT_BEFORE), before) > 0)
    return (
        F.when((after == "") & behind, "after-punct")
        .when(after == "", "end-of-paragraph")
        .when(F.instr(F.lit(SENTENCE_END + CLAUSE_PUNCT), after) > 0, "before-punct")
        .when(behind, "after-punct")
        .otherwise("mid-sentence")
    )


def cn_int(c: Column | str) -> Column:
    """Chinese or Arabic numeral as a number; null if it is neither."""
    s = strip(c)
    digits, units = F.create_map(*[x for k, v in CN_DIGITS.items() for x in (F.lit(k), F.lit(v))]), F.create_map(*[x for k, v in CN_UNITS.items() for x in (F.lit(k), F.lit(v))])

    def step(acc: Column, ch: Column) -> Column:
        digit, unit = F.try_element_at(digits, ch), F.try_element_at(units, ch)
        return F.struct(
            F.when(unit.isNotNull(), acc["total"] + F.when(acc["cur"] == 0, 1).otherwise(acc["cur"]) * unit).otherwise(acc["total"]).cast("int").alias("total"),
            F.when(unit.isNotNull(), 0).otherwise(F.coalesce(digit, acc["cur"])).cast("int").alias("cur"),
            (acc["ok"] & (digit.isNotNull() | unit.isNotNull())).alias("ok"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("cur"), F.lit(True).alias("ok"))
    folded = F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), start, step, lambda a: F.when(a["ok"], a["total"] + a["cur"]))
    return F.when(s == "", None).when(s.rlike(r"^\d+$"), s.try_cast("int")).otherwise(folded)


def han_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(HAN))


def fullwidth_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(FULLWIDTH))


def visible_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"(?U)[\s　]", ""))


def keywords(c: Column | str) -> Column:
    body = F.regexp_replace(strip(c), r"^(关键词|关键字|(?i)key\s*words?)\s*[:：]?\s*", "")
    return F.filter(F.transform(F.split(body, "[；;，,]"), lambda x: F.trim(x)), lambda x: x != "")


def number_after(c: Column, pattern: str) -> Column:
    """The number in the pattern's first group; null if the pattern isn't there."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int")


#: What an anchors file may say instead: the words before a planned and a reached number of people, and before a promised one.
PLAN_WORDS, DONE_WORDS, PROMISE_WORDS = ("计划访谈", "拟访谈"), ("完成访谈", "访谈"), ("不少于",)


def counted_as(words: tuple[str, ...], unit: str) -> str:
    """Pattern of a number, or of two with a dash between, behind one of the words and before the unit."""
    return f"(?:{'|'.join(map(re.escape, words))})\\s*([0-9]+)\\s*(?:[-–—]\\s*([0-9]+)\\s*)?{re.escape(unit)}"


def sample_range(c: Column, words: tuple[str, ...], unit: str = "人") -> tuple[Column, Column]:
    """(least, most) of a number of people, of the first of the words that has one; both equal for a single number."""
    found = [(number_after(c, p), F.nullif(F.regexp_extract(c, p, 2), F.lit("")).try_cast("int")) for p in (counted_as((w,), unit) for w in words)]
    return F.coalesce(*[lo for lo, _ in found]), F.coalesce(*[F.when(lo.isNotNull(), F.coalesce(hi, lo)) for lo, hi in found])


def planned_sample(c: Column, words: tuple[str, ...] = PLAN_WORDS) -> tuple[Column, Column]:
    return sample_range(c, words)


def actual_sample(c: Column, words: tuple[str, ...] = DONE_WORDS) -> Column:
    return sample_range(c, words)[0]


def promised(c: Column, words: tuple[str, ...] = PROMISE_WORDS) -> Column:
    return sample_range(c, words, "条")[0]


def size_in_points(label: Column) -> Column:
    sizes = F.create_map(*[x for k, v in CN_SIZES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(sizes, F.regexp_replace(F.trim(label), " ", ""))


def size_name(points: Column) -> Column:
    """The nearest named size within 0.6 points, else the number itself."""
    named = F.array(*[F.struct(F.abs(points - v).alias("d"), F.lit(k).alias("name")) for k, v in CN_SIZES.items()])
    best = F.array_min(named)
    return F.when(points.isNull(), None).when(best["d"] <= 0.6, best["name"]).otherwise(F.concat(F.regexp_replace(points.cast("string"), r"\.0$", ""), F.lit("磅")))


def alignment(value: Column) -> Column:
    names = F.create_map(*[x for k, v in ALIGNMENTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(value))), F.lit("JUSTIFY"))


def font_name(c: Column) -> Column:
    """A font's name without a subset prefix such as ABCDEF+."""
    return F.regexp_replace(c, r"^[A-Z]{6}\+", "")


# Names under which files embed Chinese fonts, the first that a name holds counts.
FONT_ALIASES = {
    "simsun": "宋体", "nsimsun": "新宋体", "simhei": "黑体", "simkai": "楷体", "kaiti": "楷体", "fangsong": "仿宋", "microsoftyahei": "微软雅黑", "msyh": "微软雅黑", "stsong": "宋体", "sthei": "黑体",
    "stkaiti": "楷体", "songti": "宋体", "heitisc": "黑体",
}


def chinese_font(c: Column) -> Column:
    """The Chinese name of an embedded font; the name as it is if no alias is in it."""
    letters = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")
    return F.coalesce(*[F.when(letters.contains(alias), name) for alias, name in FONT_ALIASES.items()], c)


def dice(a: Column, b: Column) -> Column:
    """Twice the bigrams that two texts share, of all that they have; 0 if one has none."""
    x, y = F.filter(bigrams(a), lambda g: g != ""), F.filter(bigrams(b), lambda g: g != "")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def observations(c: Column, word: str = "观察") -> Column:
    """How many times something was observed: the number before that word; null without one."""
    return number_after(c, rf"([0-9]+)\s*次[^0-9，。]{{0,2}}{re.escape(word)}")


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character is its own."""
    s = F.regexp_replace(c, r"(?U)[\s　]+", "")
    return F.when(F.length(s) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, 2)))).otherwise(F.array(s))


def named_level(style: Column, whole: bool = False) -> Column:
    """1, 2 or 3 for a style whose name holds that level's Chinese name, or is (or holds) a generic heading's."""
    out = F.lit(None).cast("int")
    for n, name in ((3, "三级标题"), (2, "二级标题"), (1, "一级标题")):
        generic = style == f"Heading {n}" if whole else F.lower(style).rlike(rf"heading\s*{n}\b")
        out = F.when(style.contains(name) | generic, n).otherwise(out)
    return out


def heading_level(style: Column, text: Column, mode: str = "exact") -> Column:
    """Level of a heading; null for other paragraphs. Checks differ in what they take for one, by mode:

    exact: the three style names. contains: names that hold one of them or a generic heading's. outline: these, a fourth level,
    and where no style says so, the number that the text begins with. chapter: six exact names, or h1 to h6. any: exact names,
    a fourth level, generic styles of all levels, and dotted numbers.
    """
    exact = F.when(style == "一级标题", 1).when(style == "二级标题", 2).when(style == "三级标题", 3)
    if mode == "exact":
        return exact
    if mode == "contains":
        return named_level(style)
    if mode == "chapter":
        cn = F.when(style.rlike("^[一二三四五六]级标题$"), F.instr(F.lit("一二三四五六"), F.substring(style, 1, 1)))
        return F.coalesce(cn, F.nullif(F.regexp_extract(style, "^h([1-6])$", 1), F.lit("")).try_cast("int"))
    if mode == "outline":
        t = strip(text)
        by_text = F.when(t.rlike("^第[一二三四五六七八九十]+章"), 1).when(t.rlike(r"^\d+[.、]"), 2).when(t.rlike("^（[一二三四五六七八九十]+）"), 3)
        contents = F.coalesce(F.lower(style).contains("toc"), F.lit(False)) | (t == "")
        return F.when(~contents, F.coalesce(named_level(F.coalesce(style, F.lit("")), True), F.when(style.contains("四级标题"), 4), by_text))
    generic = F.regexp_extract(F.lower(style), r"^(?:heading|h)\s*([1-6])$", 1).try_cast("int")
    by_number = F.when(text.rlike(r"^第\s*([0-9]+|[一二三四五六七八九十百零〇]+)\s*章"), 1).when(text.rlike(r"^\d+\.\d+\.\d+\b"), 3).when(text.rlike(r"^\d+\.\d+\b"), 2)
    return F.coalesce(exact, F.when(style == "四级标题", 4), generic, by_number)


CHAPTER, DOTTED, CN_SUB = r"^第\s*([0-9]+|[一二三四五六七八九十百零〇]+)\s*章", r"^(\d+(?:\.\d+){1,3})\b", r"^[（(]\s*([一二三四五六七八九十]+)\s*[）)]\s"


def heading_number(text: Column) -> Column:
    """The number of a heading as an array: 第3章 is [3], 1.2 is [1, 2]; null without one."""
    t = strip(text)
    return (
        F.when(t.rlike(CHAPTER), F.array(cn_int(F.regexp_extract(t, CHAPTER, 1))))
        .when(t.rlike(DOTTED), F.transform(F.split(F.regexp_extract(t, DOTTED, 1), r"\."), lambda x: x.cast("int")))
        .when(F.concat(t, F.lit(" ")).rlike(CN_SUB), F.array(cn_int(F.regexp_extract(F.concat(t, F.lit(" ")), CN_SUB, 1))))
    )


def number_level(text: Column) -> Column:
    t = strip(text)
    return F.when(t.rlike(CHAPTER), 1).when(t.rlike(DOTTED), F.size(F.split(F.regexp_extract(t, DOTTED, 1), r"\."))).when(F.concat(t, F.lit(" ")).rlike(CN_SUB), 2)


def role_of_style(name: Column, outline: Column) -> Column:
    """The role that a style's name or outline level suggests; null if neither does."""
    n = F.lower(name)
    return (
        F.when(n.rlike("^toc|目录"), "toc")
        .when(n.rlike("摘要|abstract"), "abstract")
        .when(n.rlike("参考文献|bibliograph"), "references")
        .when(n.rlike("题注|表题|图题|caption"), "caption")
        .when(n.rlike("^(heading|h) ?1$|一级标题") | (outline == 0), "h1")
        .when(n.rlike("^(heading|h) ?2$|二级标题") | (outline == 1), "h2")
        .when(n.rlike("^(heading|h) ?3$|三级标题") | (outline == 2), "h3")
        .when(n.rlike("正文|^normal$|^body"), "body")
    )
