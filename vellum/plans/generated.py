"""Relations made from the documents table, so many rows for each document, as expressions that both engines read.

They have the shape that parsed documents have, with defects at places that follow from the numbers of document and row. So
every rule runs over as many documents as there are, here and in the engine that checks it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_S, NULL_I, NULL_D, NULL_B = (f"CAST(NULL AS {t})" for t in ("STRING", "INT", "DOUBLE", "BOOLEAN"))


@dataclass(frozen=True)
class Made:
    """n rows k = 0 .. n - 1 for each document; columns by name, over doc_id and k; of them those where the condition holds."""

    n: int
    columns: dict[str, str]
    where: str = "true"

    def sql(self) -> str:
        each = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        return f"SELECT doc_id, {each} FROM (SELECT doc_id, CAST(unnest(range(0, {self.n})) AS INT) AS k FROM documents) WHERE {self.where}"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
        row = ", ".join(f"'{c}', {e}" for c, e in self.columns.items())
        # numbers first, and only those that the condition keeps are worked out, by compiled code (a lambda function isn't compiled);
        # the rows come out of explode, so that rules see plain columns and don't work out the expressions again and again
        numbers = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("k")).filter(self.where)
        rows = numbers.select("doc_id", F.explode(F.array(F.expr(f"named_struct({row})"))).alias("row"))
        return rows.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in self.columns])


def pick(by: str, *values: str) -> str:
    """The value at place `by` modulo their number."""
    return f"CASE ({by}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def q(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


P3 = "CAST(floor(k / 3) AS INT)"
_LINKED = f"k % 3 = 1 AND (doc_id + {P3}) % 2 = 0"
#: Six paragraphs of three runs, the second of which is a citation in most.
RUNS = Made(18, {
    "para_index": f"{P3} + 1",
    "run_ord": "k % 3",
    "text": f"CASE k % 3 WHEN 0 THEN {pick(f'doc_id + {P3}', *q('前人指出', '又有研究。', 'as shown,', '其他'))} WHEN 1 THEN {pick(f'doc_id * 5 + {P3}', *q('[1]', '[3]', '[2-4]', '[1,5]', '（2）', '［4］', '5', '[7]', '文字'))} ELSE {pick(f'doc_id * 3 + {P3}', *q('。后文', '，后', '后续', ''))} END",
    "superscript": f"(k % 3 = 1 AND (doc_id + {P3}) % 3 <> 0)",
    "anchor": f"CASE WHEN {_LINKED} THEN concat('ref', {text(f'1 + (doc_id * 5 + {P3}) % 6')}) END",
    "link_kind": f"CASE WHEN {_LINKED} THEN {pick(f'doc_id + k', *q('field', 'hyperlink', 'hyperlink'))} END",
    "size_pt": f"CASE WHEN k % 3 = 1 AND (doc_id + {P3}) % 7 = 0 THEN 9.0e0 WHEN k % 3 = 0 AND (doc_id + {P3}) % 11 = 0 THEN 10.5e0 END",
    "font_ea": "CASE WHEN (doc_id + k) % 13 = 0 THEN '黑体' END",
})
_OF = "(CASE WHEN doc_id % 5 = 0 AND k = 4 THEN 0 ELSE k END)"
_NR = "CASE WHEN doc_id % 6 = 0 AND k = 3 THEN 6 WHEN doc_id % 7 = 0 AND k = 2 THEN NULL ELSE k + 1 END"
#: Reference lists, some with gaps, entries without a number, repeated ones, and codes, years or pages that lack.
ENTRIES = Made(6, {
    "nr": "k + 1",
    "number": f"CAST({_NR} AS INT)",
    "text": f"concat(CASE WHEN doc_id % 7 = 0 AND k = 2 THEN '' ELSE concat('[', {text(f'coalesce({_NR}, 0)')}, '] ') END, '作者', {text(_OF)}, '. 题名', {text(_OF)}, {pick(f'doc_id + {_OF}', *q('[M]', '[J]', '', '[D]'))}, {pick(f'doc_id * 3 + {_OF}', *q('. 北京: 出版社, 2011.', '. 刊名, 2025(11).', '. 刊名, 1999(3): 12-15.', '. 无年.'))})",
    "para_index": "20 + k",
}, "k <> 5 OR doc_id % 3 = 0")
BOOKMARKS = Made(6, {"para_index": "20 + k + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END", "name": f"concat('ref', {text('k + 1')})"}, "(doc_id + k) % 4 <> 0")

_CH = "(CAST(floor(k / 4) AS INT) + 1 + CASE WHEN doc_id % 5 = 0 AND k >= 8 THEN 1 ELSE 0 END)"
_SUB = f"(CASE WHEN doc_id % 7 = 0 AND k = 7 THEN 1 ELSE {_CH} END)"
HEADINGS = Made(12, {
    "kind": "'p'", "ord": "k + 1", "para_index": "k + 1",
    "style_name": "CASE WHEN k % 4 = 0 THEN '一级标题' WHEN k % 4 = 2 THEN CASE WHEN (doc_id + k) % 6 = 0 THEN '一级标题' ELSE '三级标题' END ELSE '二级标题' END",
    "text": f"CASE k % 4 WHEN 0 THEN concat('第', CASE WHEN doc_id % 4 = 0 THEN substr('一二三四五', {_CH}, 1) ELSE {text(_CH)} END, '章 标题') WHEN 1 THEN concat({text(_CH)}, '.1 背景') WHEN 2 THEN concat({text(_CH)}, '.1.', {text('1 + (doc_id + k) % 3')}, ' 细节') ELSE concat({text(_SUB)}, '.', {text('2 + (doc_id + k) % 2')}, ' 方法') END",
})
CAPTIONS = Made(14, {
    "kind": "CASE WHEN k % 4 = 1 THEN 'tbl' ELSE 'p' END", "ord": "k + 1", "para_index": "CASE WHEN k % 4 <> 1 THEN k + 1 END", "style_name": "CASE WHEN k % 4 IN (0, 3) THEN '表题' WHEN k % 4 = 2 THEN '正文文本' END",
    "text": f"CASE k % 4 WHEN 0 THEN CASE WHEN (doc_id + k) % 3 = 0 THEN '无题' ELSE concat('表 1-', {text('1 + CAST(floor(k / 4) AS INT) + (doc_id + k) % 2')}, ' 甲') END WHEN 1 THEN '' WHEN 2 THEN concat('如表 1-', {text('1 + (doc_id + k) % 5')}, ' 与图 2.1 所示') ELSE CASE WHEN doc_id % 2 = 0 THEN concat('图2-', {text('1 + (doc_id + k) % 3')}, ' 乙') ELSE '续' END END",
})
SECTIONS = Made(3, {
    "section_index": "k + 1", "page_fmt": pick("doc_id + k", "'decimal'", "'lowerRoman'", NULL_S, "'decimal'"), "header_text": pick("doc_id * 3 + k", *q("论文", "论 文", "乙", "")), "header_has_rule": pick("doc_id + k * 2", "true", "false", NULL_B),
    "has_pgnumtype": "(doc_id + k) % 3 <> 2", "has_page_field": "(doc_id * 2 + k) % 5 = 0", "is_front": "k = 0 OR (k = 1 AND doc_id % 4 = 0)",
    "width_cm": pick("doc_id + k", "21.0e0", "21.04e0", "21.59e0", "21.0e0"), "height_cm": pick("doc_id + k", "29.7e0", "29.7e0", "27.94e0", "29.7e0"), "top_cm": pick("doc_id * 2 + k", "2.5e0", "2.54e0", "2.0e0"),
    "right_cm": "2.5e0", "bottom_cm": pick("doc_id + k", "2.5e0", "2.5e0", "2.5e0", "2.5e0", "3.5e0"), "left_cm": "3.0e0",
})
#: Styles with chains, a circle, and links both ways, as word processors write them.
STYLES = Made(24, {
    "style_id": f"concat('s', {text('k')})", "name": f"CASE k WHEN 0 THEN 'Normal' WHEN 1 THEN '正文文本' WHEN 2 THEN '一级标题' WHEN 3 THEN '二级标题' ELSE concat('样式', {text('k')}) END",
    "based_on": f"CASE WHEN k = 0 THEN NULL WHEN k = 22 THEN 's23' WHEN k = 23 THEN 's22' WHEN (doc_id + k) % 5 = 0 THEN NULL WHEN k > 16 THEN concat('s', {text('k - 1')}) ELSE concat('s', {text('CAST(floor((k - 1) / 2) AS INT)')}) END",
    "link": f"CASE WHEN k > 3 AND k < 22 THEN concat('s', {text('k + 1 - 2 * (k % 2)')}) END", "is_default": "(k = 0)",
    "size_pt": "CASE WHEN (doc_id * 7 + k * 3) % 4 = 0 THEN 9.0e0 + (doc_id + k) % 8 END", "font_ea": pick("doc_id + k * 2", "'宋体'", NULL_S, NULL_S, "'黑体'", NULL_S),
})
WANTED = Made(2, {"style_id": f"concat('s', {text('2 + (doc_id * 3 + k * 7) % 20')})"})
SPECIFIED = Made(6, {
    "name": f"CASE k WHEN 0 THEN 'Normal' WHEN 1 THEN '正文文本' WHEN 2 THEN '一级标题' ELSE concat('样式', {text('k + 1')}) END",
    "size_pt": "CASE WHEN k % 2 = 0 THEN 9.0e0 + (doc_id + k) % 8 + CASE WHEN doc_id % 3 = 0 THEN 0.005e0 ELSE 0.0e0 END END", "font_ea": pick("doc_id + k", "'宋体'", NULL_S, "'黑体'"),
})
USED = Made(5, {"para_index": "k + 1", "style_name": f"CASE WHEN (doc_id + k) % 4 = 0 THEN NULL WHEN k = 1 THEN '正文文本' ELSE concat('样式', {text('4 + (doc_id + k) % 20')}) END"})
#: Front matter with abstracts, two chapters, references; some parts lack in some documents.
ABSTRACT = Made(13, {
    "kind": "'p'", "ord": "k + 1", "para_index": "k + 1",
    "style_name": "CASE k WHEN 0 THEN '摘要标题' WHEN 3 THEN '英文摘要标题' WHEN 5 THEN '一级标题' WHEN 8 THEN '一级标题' WHEN 10 THEN '参考文献标题' ELSE '正文文本' END",
    "text": "CASE k WHEN 0 THEN '摘要' WHEN 1 THEN " + pick("doc_id", *q("本文研究乡村教育，见图1-1。", "本文研究乡村", "乡村教育研究 [2] 与访谈")) + " WHEN 2 THEN " + pick("doc_id", *q("关键词：乡村；教育,访谈", "关键词：乡村；教育", "关键字 乡村", "关键词：甲, 乙, 丙"))
    + " WHEN 3 THEN 'Abstract' WHEN 4 THEN " + pick("doc_id", *q("This paper studies rural schools [3] in 2020", "A short paper", "We ask, and we answer", "This  paper, see 图2-1")) + " WHEN 5 THEN '第1章 绪论' WHEN 6 THEN concat('正文内容，含ABC。', substr('一二三四五六七八九十', 1, CAST(doc_id % 10 AS INT))) WHEN 7 THEN '第二 段　全角'"
    + " WHEN 8 THEN '第2章 结语' WHEN 9 THEN '结语' WHEN 10 THEN '参考文献' WHEN 11 THEN '[1] 甲. 题名[M]. 2011.' ELSE '附录 A 乙' END",
}, "NOT (doc_id % 6 = 1 AND k IN (3, 4)) AND NOT (doc_id % 7 = 2 AND k = 2)")
TOC = Made(9, {
    "kind": "'p'", "para_index": "k + 1", "style_name": "CASE k WHEN 0 THEN '目录标题' WHEN 5 THEN '正文文本' WHEN 6 THEN '一级标题' WHEN 7 THEN '一级标题' WHEN 8 THEN '二级标题' ELSE 'toc 1' END",
    "text": "CASE k WHEN 0 THEN " + pick("doc_id", *q("目录", "目 录", "Contents", "前言")) + " WHEN 1 THEN '第1章 1' WHEN 2 THEN '' WHEN 3 THEN " + pick("doc_id", *q("错误!未定义书签。", "第2章 5", "Error! Bookmark not defined.", "第2章 5", "第2章 7")) + " WHEN 4 THEN '第3章 9' WHEN 5 THEN '后文' ELSE '题' END",
    "is_marker": "k IN (1, 3, 4) AND NOT (doc_id % 5 = 3 AND k = 4)", "has_toc_field": "k = 1 AND doc_id % 3 <> 1", "has_toc_anchor": "k IN (1, 3, 4) AND doc_id % 7 <> 4 AND NOT (doc_id % 4 = 2 AND k = 3)",
})
_RULE = pick("doc_id + k", *q("cite-form", "cite-jump", "toc", "style-compliance", "dash-density"))
ISSUES = Made(5, {
    "issue_key": f"concat({text('doc_id')}, '-i', {text('k')})", "id": f"concat({_RULE}, '-', {text('(doc_id * 5 + k) % 100')})", "rule": _RULE, "severity": pick("doc_id + k * 2", *q("error", "warn", "info", "warn")), "skill": pick("doc_id + k", *q("cite-doctor", "cite-doctor", "format-audit", "format-audit", "text-style")),
    "standard_source": pick("doc_id * 2 + k", *q("default", "template", "config")), "suppressible": "(doc_id + k) % 4 <> 1", "loc_index": "CASE WHEN (doc_id + k) % 5 = 4 THEN NULL ELSE CAST((doc_id * 3 + k * 4) % 17 AS INT) END",
    "action": pick("doc_id * 2 + k", "'cite.superscript'", "'run.clear_size'", "'ref.bookmark'", NULL_S, "'para.delete'", "'para.style'"),
})
SNAPSHOTS = Made(16, {"stamp": f"concat('2024-01-', {text('10 + CAST(floor(k / 2) AS INT) * 3 + doc_id % 3')})", "dup_no": "k % 2"}, "(doc_id + k) % 8 <> 0")
PROPOSALS = Made(1, {
    "proposal": "concat(" + pick("doc_id", *q("题目《乡村教育》。", "题目：乡村。", "《城市 教育》研究。")) + ", " + pick("doc_id", *q("计划访谈 30-40人。", "拟访谈15 人。", "没有数字。", "计划访谈 12人，")) + ", " + pick("doc_id", *q("不少于 3 条", "", "不少于9条", "共 4 条", "不少于 5 条")) + ")",
    "thesis": "concat(" + pick("doc_id", *q("乡村教育研究。", "城市 教育。", "其他。")) + ", " + pick("doc_id", *q("完成访谈 35 人", "访谈15人", "访谈若干人", "完成访谈 9人，访谈 30 人", "访谈 12 人")) + ")",
})
OUTLINES = Made(1, {"text": "concat_ws(chr(10), '题目', " + pick("doc_id", *q("论文提纲", "提要")) + ", '一、绪论', '（一）背景', " + pick("doc_id", *q("二、文献综述", "二、方法")) + ", '1. 细目', '三、讨论', " + pick("doc_id", *q("进度安排", "其他")) + ", '四、不算')"})
THESIS_HEADS = Made(6, {
    "para_index": "k + 1", "style_level": "CASE WHEN k IN (0, 3) THEN 1 ELSE 2 END",
    "text": "CASE k WHEN 0 THEN " + pick("doc_id", *q("第1章 绪论与综述", "第1章 引言")) + " WHEN 1 THEN '1.1 背景' WHEN 2 THEN " + pick("doc_id", *q("1.2 补充材料", "1.2 其他背景", "1.2 临时")) + " WHEN 3 THEN " + pick("doc_id", *q("第2章 讨论", "第2章 方法", "第2章 结语")) + " WHEN 4 THEN '2.1 临时小节' ELSE '2.2 细目' END",
})
SPANS = Made(8, {
    "size": pick("k", "10.5e0", "10.54e0", "16.0e0", "14.0e0", "10.8e0", "9.0e0", "12.0e0 + doc_id % 5", "10.5e0"), "font": pick("doc_id + k", *q("ABCDEF+宋体", "Times", "宋体")), "bold": "(doc_id + k) % 3 = 0", "text": "substr('正文正文正文正文正文正文', 1, CAST(2 + (doc_id * 5 + k * 3) % 9 AS INT))",
    "x0": "CASE WHEN (doc_id + k) % 4 = 0 THEN 200.0e0 ELSE 72.0e0 END", "x1": "CASE WHEN (doc_id + k) % 4 = 0 THEN 400.0e0 ELSE 523.0e0 END", "page_width": "600.0e0",
})
SPECS = Made(1, {
    "template": "CASE doc_id % 4 WHEN 0 THEN " + "'{\"citation\":{\"style\":\"bracket\"},\"page\":{\"margins_cm\":[]},\"header\":{\"rule\":false}}'" + " WHEN 1 THEN '{\"citation\":{\"superscript_size_ratio\":0.6},\"length\":{\"body_min_chars\":0}}' WHEN 2 THEN '{\"text\":{\"heading_max_chars\":20},\"bibliography\":{\"system\":\"author-year\"}}' END",
    "config": "CASE doc_id % 3 WHEN 0 THEN '{\"text\":{\"heading_max_chars\":30}}' WHEN 1 THEN '{\"citation\":{\"style\":\"\"}}' END",
})
#: Locators: of paragraphs that stayed, moved, stand several times, were edited behind their start, were wrapped, or are gone.
PLACES = Made(6, {
    "key": pick("k", *q("same", "shifted", "several", "edited", "wrapped", "gone")), "hint": pick("k", "3", "1", "CAST(8 + doc_id % 3 AS INT)", "4", "6", "2"),
    "text": "CASE k WHEN 0 THEN concat('第三段', " + text("doc_id") + ") WHEN 1 THEN '第五段' WHEN 2 THEN '重复' WHEN 3 THEN '012345678901234567890123456789旧' WHEN 4 THEN '里面的话' ELSE '不在了' END",
})
NOW = Made(8, {
    "para_index": pick("k", "2", "3", "4", "5", "9", "12", "6", "7"),
    "text": "CASE k WHEN 0 THEN '重复' WHEN 1 THEN concat('第三段', " + text("doc_id") + ") WHEN 2 THEN '012345678901234567890123456789新' WHEN 3 THEN '第五段' WHEN 4 THEN '重复' WHEN 5 THEN '重 复' WHEN 6 THEN '外面有里面的话，还有' ELSE CASE WHEN doc_id % 2 = 0 THEN '又有里面的话' ELSE '无' END END",
})
PARAS = Made(6, {"para_index": "k + 1", "style_name": pick("doc_id + k", *q("正文文本", "一级标题", "图片来源", "样式7", "二级标题")), "text": "repeat('长', CAST(25 + (doc_id * 7 + k * 5) % 30 AS INT))"})
BODIES = Made(1, {"body": pick("doc_id", *q("关于论文的正文", "正文", "乙的正文"))})
ITEMS = Made(8, {
    "issue_key": f"concat({text('doc_id')}, '-k', {text('k')})", "loc_index": pick("k", "1", "2", "3", "5", "6", "99", "4", "1"),
    "action": pick("k", *q("cite.superscript", "cite.rewrite", "para.delete", "run.clear_size", "para.insert_after", "cite.superscript", "cite.link", "ref.bookmark")),
    "enabled": "k <> 2 OR doc_id % 3 = 0",
})
#: Parameters of ITEMS: of one engine only, as the other checks what comes out.
PARAMS = "CASE action WHEN 'cite.superscript' THEN map('on', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, 'run_ord', '1') WHEN 'cite.rewrite' THEN map('text', '改', 'run_ord', '0') WHEN 'run.clear_size' THEN map('run_ord', '1') WHEN 'para.insert_after' THEN map('text', '新') WHEN 'cite.link' THEN map('kind', 'none', 'run_ord', '1') WHEN 'ref.bookmark' THEN map('name', 'ref1') ELSE map('x', 'y') END"
NUMBERS = Made(20, {"n": "CAST((doc_id * 37 + k * 13) % 9999 + 1 AS INT)"})
SIZES = Made(6, {"points": "CAST(4.0e0 + (doc_id * 3 + k * 7) % 160 * 0.25e0 AS DOUBLE)"})
LABELS = Made(8, {"a": pick("doc_id + k", *q("居中", " Left ", "?", "右对齐", "Justify", "顶格", "CENTRE", "兩端對齊")), "f": pick("doc_id * 3 + k", *q("ABCDEF+宋体", "Times", "abcdef+X", "QWERTY+Arial", "AB+C"))})
KEYLINES = Made(5, {"line": "CASE k WHEN 0 THEN concat('关键词：甲；乙', " + text("doc_id") + ", ',丙') WHEN 1 THEN 'Key words: a, b' WHEN 2 THEN concat('甲', " + text("doc_id % 7") + ") WHEN 3 THEN '关键字 ;; 甲 ， 乙;' ELSE 'KEYWORDS:x;y，z' END"})
PATHS = Made(6, {"path": "concat('a', " + text("doc_id % 3") + ", '/b', " + text("doc_id * 7 + k") + ", " + pick("doc_id + k", *q(".docx", ".PDF", "", ".txt", ".Jpeg", ".json", ".docm")) + ")"})
#: Findings about a thesis with the paragraph that they name (none in some), and those that a person found, with a keyword.
REPORTED = Made(3, {"anchor": pick("k", *q("A4", "A5", "A6")), "conclusion": pick("doc_id + k", *q("changed", "deviates")), "para_index": "CASE WHEN doc_id % 11 <> 3 THEN 1 + CAST((doc_id * 5 + k * 3) % 6 AS INT) END"}, "(doc_id + k) % 4 <> 1")
GOLDEN = Made(3, {"anchor": pick("k", *q("A4", "A5", "A6")), "conclusion": pick("doc_id + k + CASE WHEN doc_id % 9 = 2 THEN 1 ELSE 0 END", *q("changed", "deviates")), "keyword": pick("doc_id * 2 + k", *q("综述", "临时小节", "方法", "细目", "没有的"))}, "(doc_id + k) % 5 <> 2")
