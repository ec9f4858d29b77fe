"""Small literal relations that a person writes, as SQL that both engines read, and defects put into the documents table."""

from __future__ import annotations


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


IGNORE = values("kind, value", "('id', 'cite-form-15')", "('id', 'cite-jump-16')", "('rule', 'dash-density')", "('rule', 'toc')")
PHRASES = values(
    "skill, kind, phrase",
    "('cite-doctor', 'trigger', '引用序号改成右上角')", "('cite-doctor', 'trigger', '参考文献的顺序')", "('text-style', 'trigger', '破折号太多')", "('text-style', 'trigger', '标题太玄乎')",
    "('format-audit', 'trigger', '页眉横线')", "('structure-length', 'trigger', '字数超出要求')", "('text-style', 'not_for', '标题编号')", "('-', 'out_of_scope', '帮我写个摘要')", "('-', 'out_of_scope', '查重')",
)
PROMPTS = values("prompt", "('引用序号放右上角，能跳过去')", "('我这章的破折号是不是太多了')", "('页眉是不是该有根横线')", "('字数超出要求了')", "('帮我查重')", "('完全无关的话')")

#: Deterministic defects for the documents table, as one SQL expression for both engines.
INJECTED = """CASE WHEN doc_id % 7 = 0 THEN replace(replace(translate(text, '.,', '。，'), '。 ', '。。 '), '， a', '，。 a') WHEN doc_id % 7 = 1 THEN replace(text, ' the ', ' “the” ') WHEN doc_id % 7 = 2 THEN replace(text, ' of ', '—of— ')
 WHEN doc_id % 7 = 3 THEN concat(text, ' TODO 待补') WHEN doc_id % 7 = 4 THEN replace(translate(text, 'ae', '中文'), ' ', CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE ',' END) WHEN doc_id % 7 = 5 THEN concat(translate(text, 'o', '０'), ' 9') ELSE text END"""
