"""Queries over relations as parsed documents have them, made for every document of the table, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cite_rules as C
from vellum.operators import conventions as V
from vellum.operators import derive as D
from vellum.operators import format_rules as FR
from vellum.operators import issues as I
from vellum.operators import proposal_rules as P
from vellum.operators import repair as R
from vellum.operators import routing as RT
from vellum.operators import standards as S
from vellum.operators import structure_rules as ST
from vellum.operators import styles as Y
from vellum.operators import templates as TP
from vellum.operators import text_rules as X
from vellum.plans import fixtures as L
from vellum.plans import generated as G
from vellum.plans.registry import STD, brief, found, long, query, table, union
from vellum.sources import docx as DX
from vellum.sources import tables as B


def norm(c: str) -> str:
    return f"lower(regexp_replace({c}, '[\\s\\x{{3000}}]+', '', 'g'))"


# citations and references


def cites(spark, sf) -> DataFrame:
    return D.citations(G.RUNS.df(spark, sf))


def entries(spark, sf) -> DataFrame:
    return G.ENTRIES.df(spark, sf).withColumnRenamed("nr", "order")


_TOKEN = "^\\s*[\\[［【（(]?\\s*\\d+(\\s*[-–—~,，、]\\s*\\d+)*\\s*[\\]］】）)]?\\s*$"
_CT = f"""r AS ({G.RUNS.sql()}), pt AS (SELECT doc_id, para_index, string_agg(text, '' ORDER BY run_ord) AS para FROM r GROUP BY ALL),
w AS (SELECT r.*, para, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, para_index ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM r JOIN pt USING (doc_id, para_index)),
tk AS (SELECT *, CASE WHEN regexp_matches(text, '[\\[［【\\]］】]') THEN 'square' WHEN regexp_matches(text, '[（(）)]') THEN 'paren' ELSE 'none' END AS bracket FROM w WHERE regexp_matches(text, '{_TOKEN}')),
ct AS (SELECT *, CASE WHEN s > 0 THEN substr(para, s, 1) ELSE '' END AS b, substr(para, s + length(text) + 1, 1) AS a FROM tk WHERE superscript OR bracket <> 'none'),
cp AS (SELECT *, CASE WHEN a = '' AND b <> '' AND strpos('。！？；，、：!?,;:', b) > 0 THEN 'after-punct' WHEN a = '' THEN 'end-of-paragraph' WHEN strpos('。！？!?；，、：,;:）)】」”', a) > 0 THEN 'before-punct' WHEN b <> '' AND strpos('。！？；，、：!?,;:', b) > 0 THEN 'after-punct' ELSE 'mid-sentence' END AS pos FROM ct),
pc AS (SELECT doc_id, para_index, s, unnest(regexp_extract_all(text, '\\d+(-\\d+)?')) AS piece, generate_subscripts(regexp_extract_all(text, '\\d+(-\\d+)?'), 1) AS nth FROM cp),
rf AS (SELECT doc_id, para_index, s, nth * 1000 + n AS k, n FROM (SELECT *, unnest(range(regexp_extract(piece, '^\\d+')::INT, regexp_extract(piece, '\\d+$')::INT + 1))::INT AS n FROM pc)),
rn AS (SELECT doc_id, para_index, string_agg(n::VARCHAR, ',' ORDER BY k) AS refs, count(*) AS n_refs, min(n) AS one FROM rf GROUP BY ALL),
cr AS (SELECT cp.*, refs, n_refs, 'ref' || one AS target FROM cp JOIN rn USING (doc_id, para_index)),
en AS ({G.ENTRIES.sql()}), bm AS ({G.BOOKMARKS.sql()})"""


@query(f"WITH {_CT} SELECT doc_id::BIGINT AS doc_id, para_index::BIGINT AS para_index, text AS token, bracket, refs, s::BIGINT AS start_at, pos AS position FROM cr")
def cite_tokens(spark, sf):
    return cites(spark, sf).select(long("doc_id"), long("para_index"), F.col("text").alias("token"), "bracket", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), long("start", "start_at"), "position")


@query(f"WITH {_CT} " + union(found("FROM cp WHERE pos = 'after-punct'", "cite-position", "after", "error", "para_index", "text"), found("FROM cp WHERE pos = 'end-of-paragraph'", "cite-position", "paragraph-end", "warn", "para_index", "text")))
def cite_position(spark, sf):
    return brief(C.cite_position(cites(spark, sf), STD))


@query(f"WITH {_CT} " + union(found("FROM cp WHERE NOT superscript", "cite-form", "superscript", "error", "para_index", "text"), found("FROM cp WHERE bracket <> 'square'", "cite-form", "bracket", "error", "para_index", "text || ':' || bracket"), found("FROM cp WHERE size_pt IS NOT NULL", "cite-form", "explicit-size", "warn", "para_index", "size_pt")))
def cite_form(spark, sf):
    return brief(C.cite_form(cites(spark, sf), STD))


@query(f"WITH {_CT} " + found("FROM cp WHERE superscript", "cite-form", "no-superscript", "error", "para_index", "text") + " UNION ALL " + found("FROM cp WHERE bracket <> 'square'", "cite-form", "bracket", "error", "para_index", "text || ':' || bracket"))
def cite_form_inline(spark, sf):
    return brief(C.cite_form(cites(spark, sf), STD | {"cite_style": "bracket", "cite_allow_explicit_size": True}))


@query(f"WITH {_CT} " + found("FROM (SELECT DISTINCT doc_id FROM cp)", "cite-form", "unsupported", "info", "NULL", "'author-year'"))
def cite_form_unsupported(spark, sf):
    return brief(C.cite_form(cites(spark, sf), STD | {"cite_style": "author-year"}))


@query(f"""WITH {_CT}, st AS (SELECT cr.doc_id, cr.para_index, cr.text, CASE WHEN n_refs > 1 THEN 'multi' WHEN anchor = target AND b.name IS NOT NULL THEN 'ok' WHEN anchor = target THEN 'dangling' WHEN anchor IS NOT NULL THEN 'wrong' WHEN b.name IS NOT NULL THEN 'nolink' ELSE 'dangling' END AS state
 FROM cr LEFT JOIN (SELECT DISTINCT doc_id, name FROM bm) b ON b.doc_id = cr.doc_id AND b.name = target) """
       + found("FROM en WHERE number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bm WHERE bm.doc_id = en.doc_id AND bm.para_index = en.para_index AND bm.name = 'ref' || en.number)", "cite-jump", "bookmark", "error", "para_index", "'ref' || number")
       + " UNION ALL SELECT doc_id::BIGINT, 'cite-jump', state, CASE WHEN state = 'multi' THEN 'warn' ELSE 'error' END, para_index::BIGINT, text FROM st WHERE state <> 'ok'")
def cite_jump(spark, sf):
    return brief(C.cite_jump(cites(spark, sf), entries(spark, sf), G.BOOKMARKS.df(spark, sf)))


@query(f"""WITH {_CT}, u AS (SELECT doc_id, link_kind, count(*) AS n, min(struct_pack(p := para_index, s := s)) AS first FROM cp WHERE link_kind IS NOT NULL GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS i FROM u) SELECT DISTINCT cp.doc_id, coalesce(k.link_kind, 'hyperlink') AS kind FROM cp LEFT JOIN k ON k.doc_id = cp.doc_id AND i = 1""")
def cite_link_kind(spark, sf):
    return C.link_kind(cites(spark, sf))


@query(f"""WITH {_CT}, z AS (SELECT doc_id, string_agg(nr::VARCHAR, ',' ORDER BY nr) AS shown FROM en WHERE number IS NULL GROUP BY 1), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS k FROM en WHERE number IS NOT NULL), g AS (SELECT doc_id, bool_or(number <> k) AS bad, string_agg(number::VARCHAR, ',' ORDER BY k) AS shown FROM rk GROUP BY doc_id),
 f AS (SELECT doc_id, n, min(struct_pack(p := para_index, s := s, k := k)) AS first FROM rf GROUP BY ALL), o AS (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id ORDER BY first) AS b, first FROM f), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS k FROM o WHERE b > n), x AS (SELECT doc_id, string_agg(b || '>' || n, ',' ORDER BY first) AS shown FROM i WHERE k <= 8 GROUP BY doc_id) """
       + union(found("FROM z", "cite-numbering", "none", "error", "NULL", "shown"), found("FROM g WHERE bad", "cite-numbering", "discontinuous", "error", "NULL", "shown"), found("FROM x", "cite-numbering", "first-cite-order", "warn", "NULL", "shown")))
def cite_numbering(spark, sf):
    return brief(C.cite_numbering(cites(spark, sf), entries(spark, sf), STD))


@query(f"WITH {_CT}, u AS (SELECT doc_id, string_agg(DISTINCT number::VARCHAR, ',' ORDER BY number::VARCHAR) AS w FROM en WHERE doc_id IN (SELECT doc_id FROM rf) AND number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rf WHERE rf.doc_id = en.doc_id AND rf.n = en.number) GROUP BY doc_id), m AS (SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS w FROM (SELECT DISTINCT doc_id, n FROM rf) r WHERE doc_id IN (SELECT doc_id FROM en) AND NOT EXISTS (SELECT 1 FROM en WHERE r.doc_id = en.doc_id AND r.n = en.number) GROUP BY doc_id) "
       + union(found("FROM u", "ref-coverage", "unused", "warn", "NULL", "w"), found("FROM m", "ref-coverage", "missing", "error", "NULL", "w")))
def ref_coverage(spark, sf):
    return brief(C.ref_coverage(cites(spark, sf), entries(spark, sf)))


@query(f"WITH en AS ({G.ENTRIES.sql()}) " + union(found("FROM en WHERE NOT regexp_matches(text, '\\[(M|J|D|C|N|R|S|P|A|Z|G|EB/OL|DB/OL|J/OL|M/CD|C/OL|N/OL)\\]')", "ref-format", "type", "warn", "para_index", "nr"),
       found("FROM en WHERE NOT regexp_matches(text, '(^|\\D)(19|20)\\d{2}(\\D|$)')", "ref-format", "year", "warn", "para_index", "nr"),
       found("FROM en WHERE contains(text, '[J]') AND regexp_matches(text, '(^|\\D)(19|20)\\d{2}(\\D|$)') AND NOT regexp_matches(text, '(^|\\D)(19|20)\\d{2}(\\D.*)?[:：]\\s*\\d')", "ref-format", "pages", "warn", "para_index", "nr")))
def ref_format(spark, sf):
    return brief(C.ref_format(entries(spark, sf)))


_KEY = "substr(lower(regexp_replace(regexp_replace(text, '^\\s*[\\[［]\\s*(\\d+)\\s*[\\]］]', ''), '\\s+', '', 'g')), 1, 30)"


@query(f"WITH k AS (SELECT *, {_KEY} AS key FROM ({G.ENTRIES.sql()})), d AS (SELECT *, row_number() OVER w AS n, first_value(coalesce(number, nr)) OVER w AS f FROM k WINDOW w AS (PARTITION BY doc_id, key ORDER BY nr)) " + found("FROM d WHERE n > 1", "ref-duplicate", "key", "error", "para_index", "'=' || f"))
def ref_duplicate(spark, sf):
    return brief(C.ref_duplicate(entries(spark, sf)))


@query(f"""WITH b AS ({G.ABSTRACT.sql()}), h AS (SELECT doc_id, min(para_index) AS h FROM b WHERE length(trim(text)) <= 20 AND {norm('text')} = '参考文献' GROUP BY 1), x AS (SELECT doc_id, min(para_index) AS x FROM b JOIN h USING (doc_id) WHERE para_index > h AND text LIKE '附录%' GROUP BY 1)
 SELECT b.doc_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY para_index)::BIGINT AS nr, nullif(regexp_extract(text, '^\\s*[\\[［]\\s*(\\d+)', 1), '')::BIGINT AS number, text, para_index::BIGINT AS para_index FROM b JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) WHERE para_index > h AND (x IS NULL OR para_index < x) AND text <> ''""")
def reference_list(spark, sf):
    return D.references(G.ABSTRACT.df(spark, sf)).select("doc_id", long("order", "nr"), long("number"), "text", long("para_index"))


@query(f"""WITH b AS ({G.ABSTRACT.sql()}), h AS (SELECT doc_id, min(para_index) AS h FROM b WHERE length(trim(text)) <= 20 AND {norm('text')} = '参考文献' GROUP BY 1), x AS (SELECT doc_id, min(para_index) AS x FROM b JOIN h USING (doc_id) WHERE para_index > h AND text LIKE '附录%' GROUP BY 1), r AS (SELECT b.doc_id, min(para_index) AS lo, max(para_index) AS hi FROM b JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) WHERE para_index > h AND (x IS NULL OR para_index < x) AND text <> '' GROUP BY 1)
 SELECT b.doc_id, para_index::BIGINT AS para_index FROM b LEFT JOIN r USING (doc_id) WHERE (lo IS NULL OR para_index NOT BETWEEN lo AND hi) AND style_name <> '目录标题' AND NOT contains(lower(style_name), 'toc')""")
def body_without_references(spark, sf):
    b = G.ABSTRACT.df(spark, sf)
    return D.body_only(b, D.references(b)).select("doc_id", long("para_index"))


# structure


HN = f"""hh AS (SELECT doc_id, para_index AS p, text, CASE style_name WHEN '一级标题' THEN 1 WHEN '二级标题' THEN 2 WHEN '三级标题' THEN 3 END AS sl, CASE WHEN regexp_matches(text, '^第\\s*\\d+\\s*章') THEN [regexp_extract(text, '\\d+')::INT] WHEN regexp_matches(text, '^第[一二三四五]章') THEN [strpos('一二三四五', substr(text, 2, 1))::INT] ELSE list_transform(string_split(regexp_extract(text, '^\\d+(\\.\\d+)+'), '.'), lambda x: x::INT) END AS num FROM ({G.HEADINGS.sql()})),
 nn AS (SELECT *, len(num) AS nl, array_to_string(num, '.') AS d FROM hh)"""


@query(f"WITH {HN}, j AS (SELECT doc_id, p, d, unnest(range(1, nl)) AS k, num FROM nn), jj AS (SELECT doc_id, p, d, array_to_string(num[1:k], '.') AS pre FROM j), s AS (SELECT doc_id, num[1:nl-1] AS pre, nl, num[nl] AS last FROM nn), g AS (SELECT doc_id, pre, nl, min(last) AS lo, max(last) AS hi, list(DISTINCT last) AS seen FROM s GROUP BY ALL), m AS (SELECT doc_id, pre, seen, unnest(range(lo, hi + 1)) AS m FROM g), t AS (SELECT doc_id, d, count(*) AS n FROM nn GROUP BY ALL) "
       + union(found("FROM nn WHERE sl <> nl", "heading-sequence", "level", "error", "p", "d || ':' || sl || ':' || nl"), found("FROM jj WHERE NOT EXISTS (SELECT 1 FROM nn WHERE nn.doc_id = jj.doc_id AND nn.d = jj.pre)", "heading-sequence", "jump", "warn", "p", "pre || '<' || d"),
       found("FROM m WHERE NOT list_contains(seen, m::INT)", "heading-sequence", "gap", "error", "NULL", "array_to_string(list_append(pre, m::INT), '.')"), found("FROM t WHERE n > 1", "heading-sequence", "repeat", "error", "NULL", "d || 'x' || n")))
def heading_sequence(spark, sf):
    return brief(ST.heading_sequence(D.headings(G.HEADINGS.df(spark, sf))))


@query(f"WITH {HN}, e AS (SELECT *, concat_ws(',', CASE WHEN length(text) > 8 THEN 'long' END, CASE WHEN regexp_matches(text, '[：:？?！!]') THEN 'mark' END) AS labels FROM hh), "
       "u AS (SELECT doc_id, sl, last_value(CASE WHEN sl = 2 THEN p END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p) AS h2 FROM hh), m AS (SELECT doc_id, h2, count(*) AS n FROM u WHERE sl = 3 AND h2 IS NOT NULL GROUP BY ALL) "
       + found("FROM e WHERE labels <> ''", "heading-style", "each", "warn", "p", "labels") + " UNION ALL " + found("FROM m WHERE n > 0", "heading-style", "h3-per-h2", "warn", "h2", "n"))
def heading_style(spark, sf):
    return brief(X.heading_style(D.headings(G.HEADINGS.df(spark, sf)), STD | {"heading_max_chars": 8, "max_h3_per_h2": 0}))


@query(f"WITH h AS ({G.HEADINGS.sql()}), n AS (SELECT doc_id, para_index, CASE WHEN k = 0 THEN 'heading 1' WHEN k = 1 THEN 'H2' WHEN k = 2 THEN '四级标题' END AS style_name, text FROM (SELECT *, para_index % 4 AS k FROM h)) "
       "SELECT doc_id, para_index::BIGINT AS para_index, CASE style_name WHEN 'heading 1' THEN 1 WHEN 'H2' THEN 2 WHEN '四级标题' THEN 4 ELSE CASE WHEN regexp_matches(text, '^第\\s*([0-9]+|[一二三四五]+)\\s*章') THEN 1 WHEN regexp_matches(text, '^\\d+\\.\\d+\\.\\d+') THEN 3 WHEN regexp_matches(text, '^\\d+\\.\\d+') THEN 2 END END::BIGINT AS level FROM n")
def heading_levels_any(spark, sf):
    h = G.HEADINGS.df(spark, sf).withColumn("style_name", F.expr("CASE para_index % 4 WHEN 0 THEN 'heading 1' WHEN 1 THEN 'H2' WHEN 2 THEN '四级标题' END"))
    return h.select("doc_id", long("para_index"), long(T.heading_level(F.col("style_name"), F.col("text"), "any"), "level"))


CP = f"b AS ({G.CAPTIONS.sql()}), c AS (SELECT doc_id, ord, substr(text, 1, 1) AS type, regexp_extract(text, '(\\d+)[-—.](\\d+)', 1)::INT AS ch, regexp_extract(text, '(\\d+)[-—.](\\d+)', 2)::INT AS seq FROM b WHERE kind = 'p' AND regexp_matches(text, '^(图|表)\\s*[0-9]+[-—.][0-9]+'))"


@query(f"WITH {CP}, n AS (SELECT t.doc_id, t.ord AS t_ord, c.ord AS c_ord, ch, seq, row_number() OVER (PARTITION BY t.doc_id, t.ord ORDER BY abs(c.ord - t.ord), c.ord) AS k FROM b t JOIN c ON c.doc_id = t.doc_id AND abs(c.ord - t.ord) <= 4 WHERE t.kind = 'tbl' AND type = '表'), g AS (SELECT doc_id, type, ch, list(seq) AS seen, unnest(range(min(seq), max(seq) + 1)) AS m FROM c GROUP BY doc_id, type, ch), t AS (SELECT doc_id, type, ch, seq, count(*) AS n FROM c GROUP BY ALL), "
       "r AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '(图|表)\\s*[0-9]+[-—.][0-9]+')), '\\s', '', 'g'), '[—.]', '-', 'g') AS ref FROM b WHERE kind = 'p' AND doc_id IN (SELECT doc_id FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = b.doc_id AND c.ord = b.ord)) "
       + union(found("FROM n WHERE k = 1 AND c_ord > t_ord", "figure-table", "position", "warn", "t_ord", "ch || '-' || seq || ' below'"), found("FROM g WHERE NOT list_contains(seen, m::INT)", "figure-table", "gap", "error", "NULL", "type || ch || '-' || m"),
       found("FROM t WHERE n > 1", "figure-table", "repeat", "error", "NULL", "type || ch || '-' || seq"), found("FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = r.doc_id AND type || ch || '-' || seq = ref)", "figure-table", "dangling", "warn", "NULL", "ref")))
def figure_table(spark, sf):
    b = G.CAPTIONS.df(spark, sf)
    return brief(ST.figure_table(b, D.captions(b), STD))


_AB = f"""b AS ({G.ABSTRACT.sql()}), mk AS (SELECT doc_id, min(para_index) FILTER (style_name = '摘要标题') AS cn, min(para_index) FILTER (style_name = '英文摘要标题') AS en, min(para_index) FILTER (text LIKE '关键词%') AS kw, min(para_index) FILTER (style_name = '一级标题') AS h1, bool_or(style_name IN ('摘要标题', '英文摘要标题')) AS has FROM b GROUP BY 1),
 pa AS (SELECT b.doc_id, para_index AS p, trim(text) AS text, CASE WHEN para_index = kw THEN 'kw' WHEN para_index > cn AND para_index < least(CASE WHEN en > cn THEN en ELSE 9999 END, CASE WHEN kw > cn THEN kw ELSE 9999 END, CASE WHEN h1 > cn THEN h1 ELSE 9999 END) THEN 'cn'
  WHEN para_index > en AND para_index < least(CASE WHEN cn > en THEN cn ELSE 9999 END, CASE WHEN h1 > en THEN h1 ELSE 9999 END) THEN 'en' END AS part FROM b JOIN mk USING (doc_id)),
 sz AS (SELECT doc_id, part, sum(CASE WHEN part = 'cn' THEN len(regexp_extract_all(text, '[一-鿿]')) ELSE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]'))) END) AS n FROM pa WHERE part IN ('cn', 'en') GROUP BY ALL)"""
_MARKS = "list_filter(regexp_extract_all(text, '[；;，,]'), lambda x, i: list_position(regexp_extract_all(text, '[；;，,]'), x) = i)"
_WORDS = "len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '^关键词\\s*[:：]?\\s*', ''), '[；;，,]'), lambda x: trim(x)), lambda x: x <> ''))"


@query(f"WITH {_AB} " + union(found("FROM sz", "abstract-layout", "length", "CASE WHEN n > CASE part WHEN 'cn' THEN 10 ELSE 4 END THEN 'error' ELSE 'info' END", "NULL", "part || ':' || n"), found("FROM pa WHERE part = 'kw'", "abstract-layout", "keywords", f"CASE WHEN len({_MARKS}) > 1 THEN 'warn' ELSE 'info' END", "p", f"{_WORDS} || ':' || array_to_string({_MARKS}, '')"),
       found("FROM mk WHERE has AND kw IS NULL", "abstract-layout", "no-keywords", "warn", "NULL", "'none'"), found("FROM pa WHERE part IN ('cn', 'en') AND regexp_matches(text, '\\[\\s*\\d+')", "abstract-layout", "citation", "warn", "p", "part"), found("FROM pa WHERE part IN ('cn', 'en') AND regexp_matches(text, '(图|表)\\s*[0-9]+[-—.][0-9]+')", "abstract-layout", "figure", "warn", "p", "part")))
def abstract_layout(spark, sf):
    return brief(ST.abstract_layout(G.ABSTRACT.df(spark, sf), STD | {"abstract_cn_max_chars": 10, "abstract_en_max_words": 4}))


_LEN = f"""b AS ({G.ABSTRACT.sql()}), m AS (SELECT doc_id, min(ord) FILTER (style_name = '一级标题') AS h, min(ord) FILTER (text = '参考文献') AS r FROM b GROUP BY 1), x AS (SELECT b.*, sum((style_name = '一级标题')::INT) OVER (PARTITION BY b.doc_id ORDER BY ord)::BIGINT AS chapter, CASE WHEN ord < h THEN 'front' WHEN ord >= r THEN 'ref' ELSE 'body' END AS region FROM b JOIN m USING (doc_id)),
 y AS (SELECT doc_id, chapter, len(regexp_extract_all(text, '[一-鿿]')) AS han, len(regexp_extract_all(text, '[⺀-鿿　-〿＀-￯]')) AS fw, length(regexp_replace(text, '[\\s\\x{{3000}}]', '', 'g')) AS v FROM x WHERE region = 'body')"""


@query(f"WITH {_LEN} SELECT doc_id::BIGINT AS doc_id, coalesce(chapter, -1) AS chapter, sum(han)::BIGINT AS han, sum(fw)::BIGINT AS fullwidth, sum(v)::BIGINT AS visible FROM y GROUP BY GROUPING SETS ((doc_id, chapter), (doc_id))")
def chapter_lengths(spark, sf):
    out = ST.chapter_lengths(D.regions(G.ABSTRACT.df(spark, sf)))
    return out.select(long("doc_id"), long(F.coalesce("chapter", F.lit(-1)), "chapter"), long("han"), long("fullwidth"), long("visible"))


@query(f"WITH {_LEN}, t AS (SELECT doc_id, sum(han) AS han, sum(fw) AS fw, sum(v) AS v FROM y GROUP BY 1) " + found("FROM t", "length", "summary", "info", "NULL", "han || '/' || fw || '/' || v") + " UNION ALL " + found("FROM t WHERE han < 22", "length", "short", "warn", "NULL", "han"))
def length_rules(spark, sf):
    return brief(ST.length(D.regions(G.ABSTRACT.df(spark, sf)), STD | {"body_min_chars": 22}))


@query(f"WITH {_LEN}, t AS (SELECT doc_id, sum(han) AS han FROM y GROUP BY 1), c AS (SELECT doc_id, chapter, sum(han) AS han FROM y GROUP BY ALL) SELECT doc_id, chapter, round(c.han / t.han, 6) AS share FROM c JOIN t USING (doc_id) WHERE t.han > 0")
def chapter_shares(spark, sf):
    return ST.chapter_shares(ST.chapter_lengths(D.regions(G.ABSTRACT.df(spark, sf)))).select("doc_id", long("chapter"), F.round("share", 6).alias("share"))


# format


_SEC = f"s AS ({G.SECTIONS.sql()})"
_SIDES = (("top", 2.5), ("right", 2.5), ("bottom", 2.5), ("left", 3.0))


@query(f"WITH {_SEC} " + union(found("FROM s WHERE abs(width_cm - 21.0) > 0.05 OR abs(height_cm - 29.7) > 0.05", "page-setup", "size", "error", "section_index", "width_cm || 'x' || height_cm"), *[found(f"FROM s WHERE abs({side}_cm - {v}) > 0.05", "page-setup", "margin", "error", "section_index", f"'{side}:' || {side}_cm") for side, v in _SIDES]))
def page_setup(spark, sf):
    return brief(FR.page_setup(G.SECTIONS.df(spark, sf), STD | {"page_margins_cm": [2.5, 2.5, 2.5, 3.0]}))


_BARE = [found("FROM s WHERE NOT has_pgnumtype AND NOT has_page_field AND is_front", "page-numbering", "no-front", "warn", "section_index", "'none'"), found("FROM s WHERE NOT has_pgnumtype AND NOT has_page_field AND NOT is_front", "page-numbering", "no-body", "error", "section_index", "'none'")]


@query(f"WITH {_SEC}, f AS (SELECT doc_id, bool_or(has_pgnumtype) AS typed, min(section_index) FILTER (is_front AND has_pgnumtype AND page_fmt = 'decimal') AS stop FROM s GROUP BY 1), j AS (SELECT s.*, typed, stop FROM s JOIN f USING (doc_id) WHERE stop IS NULL OR section_index <= stop) "
       + union(*_BARE, found("FROM j WHERE section_index = stop", "page-numbering", "front-arabic", "warn", "section_index", "'arabic'"), found("FROM j WHERE typed AND NOT has_pgnumtype", "page-numbering", "missing", "warn", "section_index", "'no type'")))
def page_numbering(spark, sf):
    return brief(FR.page_numbering(G.SECTIONS.df(spark, sf), STD))


@query(f"WITH {_SEC} " + union(*_BARE, found("FROM s WHERE has_pgnumtype AND page_fmt <> 'decimal'", "page-numbering", "format", "error", "section_index", "page_fmt")))
def page_numbering_scheme(spark, sf):
    return brief(FR.page_numbering(G.SECTIONS.df(spark, sf), STD | {"page_numbering_scheme": "arabic"}))


@query(f"WITH {_SEC}, h AS (SELECT *, {norm('header_text')} AS n FROM s WHERE header_text <> '') " + union(found("FROM h WHERE header_has_rule = false", "header", "line", "warn", "section_index", "'false'"), found("FROM (SELECT doc_id, bool_or(coalesce(header_has_rule, false)) AS a, bool_and(coalesce(header_has_rule, false)) AS b FROM s GROUP BY 1) WHERE a AND NOT b", "header", "line-mixed", "warn", "NULL", "'mixed'"),
       found("FROM h WHERE n <> '论文'", "header", "text", "warn", "section_index", "header_text"), found("FROM (SELECT doc_id, count(DISTINCT n) AS n FROM h GROUP BY 1) WHERE n > 1", "header", "text-mixed", "warn", "NULL", "n")))
def header_rules(spark, sf):
    return brief(FR.header(G.SECTIONS.df(spark, sf), STD | {"header_rule": True, "header_content": "论文"}))


def effective_paras(spark, sf) -> DataFrame:
    styles = G.STYLES.df(spark, sf).filter("name = '正文文本'").select("doc_id", "name", F.lit(12.0).alias("size_pt"), "font_ea")
    runs = G.RUNS.df(spark, sf)
    return FR.effective(runs.select("doc_id", "para_index", F.lit("正文文本").alias("style_name")).distinct(), runs, styles)


_EFF = f"""r AS ({G.RUNS.sql()}), st AS (SELECT doc_id, font_ea FROM ({G.STYLES.sql()}) WHERE name = '正文文本'), f AS (SELECT r.doc_id, para_index, coalesce(first(size_pt ORDER BY run_ord) FILTER (size_pt IS NOT NULL), 12.0) AS size, coalesce(first(r.font_ea ORDER BY run_ord) FILTER (r.font_ea IS NOT NULL), any_value(st.font_ea)) AS font FROM r JOIN st USING (doc_id) GROUP BY ALL)"""


@query(f"WITH {_EFF} " + union(found("FROM (SELECT doc_id, list_sort(list(DISTINCT size)) AS v FROM f GROUP BY 1) WHERE len(v) > 1", "fonts", "size", "warn", "NULL", "'正文文本:' || array_to_string(v, '/')"), found("FROM (SELECT doc_id, list_sort(list(DISTINCT font) FILTER (font IS NOT NULL)) AS v FROM f GROUP BY 1) WHERE len(v) > 1", "fonts", "font", "warn", "NULL", "'正文文本:' || array_to_string(v, '/')"),
       found("FROM f WHERE abs(size - 12) > 0.5", "fonts", "standard", "warn", "para_index", "size")))
def fonts_mix(spark, sf):
    return brief(FR.fonts(effective_paras(spark, sf), STD | {"body_size_pt": 12}))


@query(f"WITH p AS ({G.PARAS.sql()}), r AS ({G.RUNS.sql()}), bp AS (SELECT doc_id, para_index FROM p WHERE NOT contains(style_name, '标题') AND style_name <> '图片来源'), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para_index ORDER BY run_ord) AS k FROM r WHERE size_pt IS NOT NULL OR font_ea IS NOT NULL), dd AS (SELECT d.* FROM d SEMI JOIN bp USING (doc_id, para_index) WHERE k = 1) "
       + union(found("FROM (SELECT DISTINCT doc_id, style_name FROM p WHERE style_name NOT IN ('正文文本', '一级标题', '二级标题'))", "style-compliance", "unknown", "warn", "NULL", "style_name"), found("FROM p WHERE style_name IN ('一级标题', '二级标题') AND length(text) > 40", "style-compliance", "heading-misuse", "warn", "para_index", "length(text)"),
       found("FROM dd WHERE size_pt IS NOT NULL", "style-compliance", "direct-size", "warn", "para_index", "size_pt"), found("FROM dd WHERE size_pt IS NULL", "style-compliance", "direct-font", "warn", "para_index", "font_ea")))
def style_compliance(spark, sf):
    return brief(FR.style_compliance(G.PARAS.df(spark, sf), G.RUNS.df(spark, sf), spark.sql("SELECT explode(array('正文文本', '一级标题', '二级标题')) AS name")))


_TOC = f"""b AS ({G.TOC.sql()}), hd AS (SELECT doc_id, min(para_index) AS head FROM b WHERE {norm('text')} IN ('目录', '目次', 'contents') GROUP BY 1), nr AS (SELECT b.*, head, max(is_marker::INT) OVER (PARTITION BY b.doc_id ORDER BY para_index) = 1 AS started FROM b JOIN hd USING (doc_id) WHERE para_index >= head),
 sp AS (SELECT doc_id, min(para_index) AS stop FROM nr WHERE started AND NOT is_marker AND trim(text) <> '' GROUP BY 1), ins AS (SELECT nr.* FROM nr LEFT JOIN sp USING (doc_id) WHERE started AND (stop IS NULL OR para_index < stop)),
 al AS (SELECT b.doc_id, bool_or({norm('text')} IN ('目录', '目次', 'contents')) AS has, count(*) FILTER (regexp_matches(style_name, '^[一二三四五六]级标题$')) AS heads FROM b GROUP BY 1),
 q AS (SELECT al.*, coalesce(f, false) AS f, coalesce(e, 0) AS e, coalesce(br, false) AS br FROM al LEFT JOIN (SELECT doc_id, bool_or(has_toc_field) AS f, count(*) FILTER (has_toc_anchor) AS e, bool_or(regexp_matches(text, '未定义书签|(?i:bookmark not defined)')) AS br FROM ins GROUP BY 1) USING (doc_id))"""


@query(f"WITH {_TOC} " + union(found("FROM q WHERE NOT has", "toc", "none", "info", "NULL", "'none'"), found("FROM q WHERE has AND NOT f", "toc", "no-field", "error", "NULL", "'text'"), found("FROM q WHERE has AND br", "toc", "broken", "error", "NULL", "'broken'"), found("FROM q WHERE has AND heads > 0 AND e = 0", "toc", "empty", "error", "NULL", "heads"), found("FROM q WHERE has AND e > 0 AND e < heads", "toc", "mismatch", "warn", "NULL", "e || '<' || heads")))
def toc_rules(spark, sf):
    paras = G.TOC.df(spark, sf)
    return brief(FR.contents(paras, D.contents_region(paras)))


@query(f"WITH {_TOC} SELECT doc_id, para_index::BIGINT AS para_index FROM ins")
def toc_region(spark, sf):
    return D.contents_region(G.TOC.df(spark, sf)).select("doc_id", long("para_index"))


# styles, conventions, standards


@query(f"""WITH RECURSIVE s AS ({G.STYLES.sql()}), up AS (SELECT doc_id, style_id, style_id AS here, 0 AS depth FROM s UNION ALL SELECT u.doc_id, u.style_id, s.based_on, depth + 1 FROM up u JOIN s ON s.doc_id = u.doc_id AND s.style_id = u.here WHERE s.based_on IS NOT NULL AND depth < 24),
 v AS (SELECT u.doc_id, u.style_id, u.depth, size_pt, font_ea FROM up u JOIN s ON s.doc_id = u.doc_id AND s.style_id = u.here) SELECT doc_id::BIGINT AS doc_id, style_id, min_by(size_pt, depth) FILTER (size_pt IS NOT NULL) AS size_pt, min_by(font_ea, depth) FILTER (font_ea IS NOT NULL) AS font_ea FROM v GROUP BY ALL""")
def style_inheritance(spark, sf):
    return Y.inherited(G.STYLES.df(spark, sf)).select(long("doc_id"), "style_id", "size_pt", "font_ea")


_REACH = f"""s AS ({G.STYLES.sql()}), w AS ({G.WANTED.sql()}), e AS (SELECT doc_id, style_id, based_on AS t FROM s WHERE based_on IS NOT NULL UNION SELECT doc_id, style_id, link FROM s WHERE link IS NOT NULL),
 rc AS (SELECT doc_id, style_id FROM w UNION SELECT doc_id, style_id FROM s WHERE is_default UNION SELECT rc.doc_id, e.t FROM rc JOIN e ON e.doc_id = rc.doc_id AND e.style_id = rc.style_id)"""


@query(f"WITH RECURSIVE {_REACH} SELECT s.doc_id, s.style_id FROM s ANTI JOIN rc USING (doc_id, style_id)")
def dead_styles(spark, sf):
    return Y.dead(G.STYLES.df(spark, sf), G.WANTED.df(spark, sf)).select(long("doc_id"), "style_id")


@query(f"WITH RECURSIVE {_REACH} SELECT doc_id, count(*)::BIGINT AS before, count(*) FILTER (style_id IN (SELECT style_id FROM rc WHERE rc.doc_id = s.doc_id))::BIGINT AS after FROM s GROUP BY 1")
def style_clean_up(spark, sf):
    return Y.removable(G.STYLES.df(spark, sf), G.WANTED.df(spark, sf)).select("doc_id", long("before"), long("after"))


@query(f"WITH RECURSIVE {_REACH} SELECT s.doc_id, s.style_id, NOT (is_default OR EXISTS (SELECT 1 FROM w WHERE w.doc_id = s.doc_id AND w.style_id = s.style_id)) AS hidden FROM s SEMI JOIN rc USING (doc_id, style_id)")
def style_hiding(spark, sf):
    return Y.pruned(G.STYLES.df(spark, sf), G.WANTED.df(spark, sf))[0].select("doc_id", "style_id", "hidden")


_DIFF = " UNION ALL ".join(f"SELECT w.doc_id, w.name, '{f}' AS field, w.{f}::VARCHAR AS want, h.{f}::VARCHAR AS have FROM w LEFT JOIN s h ON h.doc_id = w.doc_id AND h.name = w.name WHERE w.{f} IS NOT NULL AND (h.{f} IS NULL OR {same})" for f, same in (("size_pt", "abs(w.size_pt - h.size_pt) > 0.01"), ("font_ea", "w.font_ea <> h.font_ea")))


@query(f"WITH s AS ({G.STYLES.sql()}), w AS ({G.SPECIFIED.sql()}) {_DIFF}")
def style_verify_diff(spark, sf):
    return Y.differences(G.SPECIFIED.df(spark, sf), G.STYLES.df(spark, sf), ["size_pt", "font_ea"]).select(long("doc_id"), "name", "field", "want", "have")


@query(f"WITH s AS ({G.STYLES.sql()}), u AS ({G.USED.sql()}) SELECT doc_id, name, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.doc_id = s.doc_id AND u.style_name = s.name) THEN 'referenced' WHEN name = 'Normal' THEN 'reserved' ELSE 'unused' END AS state FROM s")
def style_usage(spark, sf):
    return Y.usage(G.STYLES.df(spark, sf), G.USED.df(spark, sf), ["Normal"]).select(long("doc_id"), "name", "state")


@query(f"""WITH s AS ({G.STYLES.sql()}), n AS (SELECT DISTINCT doc_id, regexp_replace(name, '\\d$', '') AS name FROM s), x AS (SELECT n.*, e.style_id AS exact FROM n LEFT JOIN s e ON e.doc_id = n.doc_id AND e.name = n.name),
 c AS (SELECT doc_id, regexp_replace(name, '\\d+$', '') AS base, min_by(style_id, name) AS near FROM s WHERE regexp_matches(name, '\\d$') GROUP BY ALL) SELECT x.doc_id, x.name, coalesce(exact, near) AS style_id FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.base = x.name""")
def style_names_resolved(spark, sf):
    styles = G.STYLES.df(spark, sf)
    return Y.resolved_names(styles.select("doc_id", F.regexp_replace("name", r"\d$", "").alias("name")).distinct(), styles)


def _most(value: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, v) AS k, sum(c) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, {value} AS v, count(*) AS c FROM z GROUP BY ALL)"


@query(f"""WITH {_CT}, z AS (SELECT doc_id, CASE WHEN superscript THEN 'superscript-' ELSE 'inline-' END || bracket AS form, pos, CASE WHEN n_refs = 1 THEN 'single' WHEN regexp_matches(text, '[-–—~]') THEN 'merged' ELSE 'separate' END AS multi FROM cr),
 f AS ({_most('form')}), p AS ({_most('pos')}), m AS ({_most('multi')}) SELECT f.doc_id, f.v AS form, f.n::BIGINT AS n, CASE WHEN f.n >= 10 THEN 'high' WHEN f.n >= 3 THEN 'medium' ELSE 'low' END AS confidence, p.v AS position, m.v AS multi FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = 1 JOIN m ON m.doc_id = f.doc_id AND m.k = 1 WHERE f.k = 1""")
def citation_convention(spark, sf):
    return V.citation(cites(spark, sf)).select(long("doc_id"), "form", "n", "confidence", "position", "multi")


@query(f"""WITH e AS ({G.ENTRIES.sql()}), g AS (SELECT doc_id, count(*) AS n, count(number) AS nr, count(*) FILTER (number IS NULL AND regexp_matches(text, '[（(,，]\\s*(19|20)\\d{{2}}')) AS dated, count(*) FILTER (regexp_matches(text, '\\[(M|J|D|C|N|R|S|P|A|Z|G|EB/OL|DB/OL|J/OL)\\]')) AS typed FROM e GROUP BY 1)
 SELECT doc_id, CASE WHEN nr >= greatest(dated, 1) THEN 'sequence' WHEN dated > 0 THEN 'author-year' ELSE 'unknown' END AS system, CASE WHEN typed * 2 >= n THEN 'GB/T 7714' END AS standard, CASE WHEN n >= 10 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS confidence, n::BIGINT AS n FROM g""")
def bibliography_convention(spark, sf):
    return V.bibliography(entries(spark, sf)).select(long("doc_id"), "system", "standard", "confidence", "n")


@query(f"""WITH {_SEC}, b AS ({G.BODIES.sql()}), h AS (SELECT s.doc_id, header_has_rule AS r, contains(body, substr(lower(regexp_replace(header_text, '\\s+', '', 'g')), 1, 10)) AS inside FROM s JOIN b USING (doc_id) WHERE header_text <> '')
 SELECT doc_id, CASE WHEN count(*) FILTER (inside) > 0 THEN 'paper-title' ELSE 'custom' END AS content, CASE WHEN count(*) FILTER (r) > count(*) FILTER (NOT r) THEN true WHEN count(*) FILTER (NOT r) > count(*) FILTER (r) THEN false END AS rule, count(*)::BIGINT AS n FROM h GROUP BY 1""")
def header_convention(spark, sf):
    return V.header(G.SECTIONS.df(spark, sf), G.BODIES.df(spark, sf))


@query(f"WITH {_SEC} SELECT doc_id, CASE count(DISTINCT page_fmt) WHEN 0 THEN 'unknown' WHEN 1 THEN 'single' ELSE 'multi-section' END AS scheme FROM s GROUP BY 1")
def page_numbering_convention(spark, sf):
    return V.page_numbering(G.SECTIONS.df(spark, sf)).select(long("doc_id"), "scheme")


@query(f"""WITH {CP}, m AS (SELECT b.doc_id, b.ord, c.type, coalesce(max((kind = 'tbl')::INT) OVER (PARTITION BY b.doc_id ORDER BY b.ord ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS up, coalesce(max((kind = 'tbl')::INT) OVER (PARTITION BY b.doc_id ORDER BY b.ord ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS down FROM b LEFT JOIN c USING (doc_id, ord))
 SELECT doc_id, type, count(*) FILTER (down = 1)::BIGINT AS above, count(*) FILTER (down = 0 AND up = 1)::BIGINT AS below FROM m WHERE type IS NOT NULL GROUP BY ALL""")
def caption_convention(spark, sf):
    b = G.CAPTIONS.df(spark, sf)
    t = F.regexp_extract("text", D.CAPTION, 1)
    marked = b.select("doc_id", "ord", (t != "").alias("is_caption"), t.alias("type"), (F.col("kind") == "tbl").alias("is_object"))
    return V.caption(marked).select("doc_id", "type", long("above"), long("below"))


@query(f"WITH {_AB} SELECT doc_id, part, n::BIGINT AS n FROM sz")
def abstract_convention(spark, sf):
    words = F.when(F.col("part") == "cn", T.han_count("text")).otherwise(F.size(F.filter(F.split("text", r"\s+"), lambda x: x.rlike("[A-Za-z]"))))
    return V.abstract(ST.abstract_parts(G.ABSTRACT.df(spark, sf)).filter("part <> 'kw'"), words).select("doc_id", "part", long("n"))


@query(f"""WITH e AS ({G.ENTRIES.sql()}), {_SEC}, g AS (SELECT doc_id, 'entries' AS name, CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS c FROM e GROUP BY 1 UNION ALL SELECT doc_id, 'headers', CASE WHEN count(*) FILTER (header_text <> '') >= 10 THEN 'high' WHEN count(*) FILTER (header_text <> '') >= 3 THEN 'medium' ELSE 'low' END FROM s GROUP BY 1)
 SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (c = 'low'), '') AS ask, CASE WHEN count(*) FILTER (c = 'low') * 2 > count(*) THEN 'low' WHEN count(*) FILTER (c = 'high') = count(*) THEN 'high' ELSE 'medium' END AS confidence FROM g GROUP BY 1""")
def convention_roll_up(spark, sf):
    a = V.bibliography(entries(spark, sf)).select("doc_id", F.lit("entries").alias("name"), "confidence")
    b = G.SECTIONS.df(spark, sf).groupBy("doc_id").agg(F.count_if(F.col("header_text") != "").alias("n")).select("doc_id", F.lit("headers").alias("name"), V.confidence(F.col("n")).alias("confidence"))
    return V.roll_up(a.unionByName(b))


_SIZES = f"""WITH p AS (SELECT *, round(size, 1) AS z, length(text) AS c, regexp_replace(font, '^[A-Z]{{6}}\\+', '') AS fn, abs((x0 + x1) / 2 - page_width / 2) <= 0.02 * page_width AND x1 - x0 < 0.6 * page_width AS mid FROM ({G.SPANS.sql()})), g AS (SELECT doc_id, z, sum(c) AS chars, sum(c) FILTER (bold) AS bold, sum(c) FILTER (mid) AS mid FROM p GROUP BY ALL),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, z ORDER BY c DESC, fn) AS k FROM (SELECT doc_id, z, fn, sum(c) AS c FROM p GROUP BY ALL)), b AS (SELECT *, first_value(z) OVER (PARTITION BY doc_id ORDER BY chars DESC, z) AS body FROM g), r AS (SELECT *, CASE WHEN z > body + 0.4 THEN row_number() OVER (PARTITION BY doc_id, z > body + 0.4 ORDER BY z DESC) END AS k FROM b)
 SELECT r.doc_id, r.z AS size, chars::BIGINT AS chars, CASE WHEN r.z = body THEN 'body' WHEN r.k <= 4 THEN 'h' || r.k ELSE 'other' END AS role, coalesce(bold, 0) * 2 > chars AS bold, fn AS font, coalesce(mid, 0) * 2 > chars AS centred FROM r JOIN f ON f.doc_id = r.doc_id AND f.z = r.z AND f.k = 1"""


@query(_SIZES)
def pdf_size_histogram(spark, sf):
    return V.sizes_of_spans(G.SPANS.df(spark, sf)).select(long("doc_id"), "size", long("chars"), "role", "bold", "font", "centred")


def _standard(key: str, default: str | None, path: str) -> str:
    def given(column: str) -> str:
        v = f"json_extract_string({column}, '$.{path}')"
        return f"CASE WHEN {v} IS NOT NULL THEN 'true' END" if path.endswith("size_ratio") else f"CASE WHEN trim({v}) NOT IN ('', '[]', '{{}}', 'null') THEN {v} END"

    value = "NULL" if default is None else "'" + str(json.loads(default) if default.startswith('"') else default) + "'"
    c, t = given("config"), given("template")
    return f"SELECT doc_id, '{key}' AS key, coalesce({c}, {t}, {value}) AS value, CASE WHEN {c} IS NOT NULL THEN 'config' WHEN {t} IS NOT NULL THEN 'template' WHEN {value} IS NOT NULL THEN 'default' END AS source FROM sp"


@query(f"WITH sp AS ({G.SPECS.sql()}) " + " UNION ALL ".join(_standard(*s) for s in S.STANDARDS))
def standards_resolution(spark, sf):
    return S.resolve(G.SPECS.df(spark, sf)).select(long("doc_id"), "key", "value", "source")


_ST = f"WITH sp AS ({G.SPECS.sql()}), st AS (" + " UNION ALL ".join(_standard(*s) for s in S.STANDARDS) + ")"


@query(_ST + " SELECT doc_id, string_agg(key || '=' || value || ' (' || source || ')', '; ' ORDER BY key || '=' || value || ' (' || source || ')') AS line FROM st WHERE value IS NOT NULL GROUP BY 1")
def standards_described(spark, sf):
    return S.described(S.resolve(G.SPECS.df(spark, sf)))


@query(_ST + " SELECT doc_id, 'not judged: ' || string_agg(key, ',' ORDER BY key) AS note FROM st WHERE value IS NULL GROUP BY 1")
def standards_unset(spark, sf):
    return S.notes(S.resolve(G.SPECS.df(spark, sf)))


# issues and repair


_IS = f"i AS ({G.ISSUES.sql()})"


def issues(spark, sf) -> DataFrame:
    return G.ISSUES.df(spark, sf).withColumn("params", F.create_map().cast("map<string,string>"))


@query(f"WITH {_IS}, g AS ({L.IGNORE}) SELECT issue_key, suppressible AND (id IN (SELECT value FROM g WHERE kind = 'id') OR rule IN (SELECT value FROM g WHERE kind = 'rule')) AS suppressed FROM i")
def suppress_split(spark, sf):
    return I.suppressed(issues(spark, sf), spark.sql(L.IGNORE)).select("issue_key", "suppressed")


@query(f"WITH {_IS} SELECT doc_id, issue_key, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, coalesce(loc_index, 0), issue_key)::BIGINT AS k FROM i")
def severity_order(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(I.rank(), F.coalesce("loc_index", F.lit(0)), "issue_key")
    return issues(spark, sf).select("doc_id", "issue_key", long(F.row_number().over(w), "k"))


@query(f"WITH {_IS} SELECT rule, count(*)::BIGINT AS n FROM i GROUP BY 1")
def rule_distribution(spark, sf):
    return I.by_rule(issues(spark, sf))


@query(f"WITH {_IS} SELECT doc_id, issue_key, action, (NOT suppressible OR severity = 'error') AS enabled FROM i WHERE action IS NOT NULL")
def repair_plan(spark, sf):
    return R.plan(issues(spark, sf)).select(long("doc_id"), "issue_key", "action", "enabled")


@query(f"WITH {_IS} SELECT doc_id, issue_key, CASE WHEN doc_id % 3 = 0 THEN true ELSE NOT suppressible OR severity = 'error' END AS enabled FROM i WHERE action IS NOT NULL")
def repair_plan_toggled(spark, sf):
    items = R.plan(issues(spark, sf))
    return R.toggled(items, items.filter("doc_id % 3 = 0").select("issue_key", F.lit(True).alias("enabled"))).select("doc_id", "issue_key", "enabled")


@query(f"WITH {_IS} SELECT doc_id, issue_key, CASE WHEN doc_id % 4 <> 0 THEN action END AS action, doc_id % 4 = 0 AS stale FROM i WHERE action IS NOT NULL")
def repair_plan_stale(spark, sf):
    items = R.plan(issues(spark, sf))
    return R.with_params(items, issues(spark, sf).filter("doc_id % 4 <> 0")).select("doc_id", "issue_key", "action", "stale")


@query(f"WITH {_IS} SELECT doc_id, count(*) FILTER (NOT suppressible OR severity = 'error')::BIGINT AS enabled, count(*)::BIGINT AS items FROM i WHERE action IS NOT NULL GROUP BY 1")
def repair_plan_counts(spark, sf):
    return R.counts(R.plan(issues(spark, sf))).select("doc_id", long("enabled"), long("items"))


_HEADS = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('h', CAST(doc_id % 7 AS STRING)) END"
_THERE = "concat('h', CAST(CASE WHEN doc_id % 4 = 0 THEN 9 ELSE doc_id % 7 END AS STRING))"


def _guard(strict: bool) -> str:
    changed = "changed document" if strict else "warn: changed document"
    return f"""WITH {_IS}, h AS (SELECT doc_id, {_HEADS} AS want FROM documents), d AS (SELECT doc_id, {_THERE} AS now, doc_id % 13 = 0 AS locked FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT h.*, now, locked FROM h LEFT JOIN d USING (doc_id)),
 r AS (SELECT doc_id, CASE WHEN now IS NULL THEN 'missing document' WHEN locked THEN 'locked document' WHEN want IS NULL THEN 'warn: no hash' WHEN want <> now THEN '{changed}' END AS reason FROM b)
 SELECT doc_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT doc_id, 'unknown action: ' || action FROM (SELECT doc_id, CASE WHEN action = 'para.style' THEN 'para.fold' ELSE action END AS action FROM i) WHERE action = 'para.fold'"""


def _guarded(spark, sf, strict: bool) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    items = R.plan(issues(spark, sf)).withColumn("action", F.when(F.col("action") == "para.style", "para.fold").otherwise(F.col("action")))
    there = docs.filter("doc_id % 11 <> 0").selectExpr("doc_id", f"{_THERE} AS sha256", "doc_id % 13 = 0 AS locked")
    return R.guard(items, docs.selectExpr("doc_id", f"{_HEADS} AS sha256"), there, strict).select(long("doc_id"), "reason")


@query(_guard(True))
def guard_rejects(spark, sf):
    return _guarded(spark, sf, True)


@query(_guard(False))
def guard_lenient(spark, sf):
    return _guarded(spark, sf, False)


_PHASE = "CASE WHEN action = 'ref.bookmark' THEN 0 WHEN action IN ('para.delete', 'para.merge_into', 'para.insert_after') THEN 2 ELSE 1 END"


@query(f"WITH {_IS} SELECT doc_id, issue_key, row_number() OVER (PARTITION BY doc_id ORDER BY {_PHASE}, coalesce(loc_index, 0) DESC, issue_key)::BIGINT AS step FROM i WHERE action IS NOT NULL AND (NOT suppressible OR severity = 'error')")
def apply_order(spark, sf):
    return R.ordered(R.plan(issues(spark, sf))).select(long("doc_id"), "issue_key", long("step"))


@query(f"WITH {_IS} SELECT issue_key FROM i WHERE action IS NOT NULL AND NOT (doc_id % 3 = 0 AND severity = 'warn')")
def ledger_skip(spark, sf):
    ledger = issues(spark, sf).filter("doc_id % 2 = 0 OR doc_id % 3 = 0").filter("severity = 'warn'").selectExpr("doc_id", "issue_key", "CASE WHEN doc_id % 3 = 0 THEN 'now' ELSE 'old' END AS result_sha")
    return R.pending(R.plan(issues(spark, sf)).withColumn("sha256", F.lit("now")), ledger).select("issue_key")


@query(f"WITH s AS ({G.SNAPSHOTS.sql()}) SELECT doc_id, stamp, dup_no::BIGINT AS dup_no FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY stamp DESC, dup_no DESC) AS k FROM s) WHERE k <= 12")
def snapshots_kept(spark, sf):
    return R.kept_snapshots(G.SNAPSHOTS.df(spark, sf)).select(long("doc_id"), "stamp", long("dup_no"))


@query(f"WITH s AS ({G.SNAPSHOTS.sql()}) SELECT doc_id, max(dup_no)::BIGINT AS dup_no FROM s WHERE stamp = '2024-01-17' GROUP BY 1")
def rolled_back(spark, sf):
    s = G.SNAPSHOTS.df(spark, sf)
    return R.rollback(s, s.select("doc_id").distinct(), "2024-01-17")[0].select("doc_id", long("dup_no"))


_FP = "substr(sha1({0}), 1, 12)".format(norm("text"))


@query(f"""WITH p AS (SELECT *, {_FP} AS fp FROM ({G.PLACES.sql()})), n AS (SELECT *, {_FP} AS fp FROM ({G.NOW.sql()})),
 s AS (SELECT p.doc_id, key, n.para_index, abs(n.para_index - hint) AS d, count(*) OVER (PARTITION BY p.doc_id, key) AS c FROM p JOIN n ON n.doc_id = p.doc_id AND n.fp = p.fp), a AS (SELECT doc_id, key, para_index, CASE WHEN d = 0 THEN 0 WHEN c = 1 THEN 1 ELSE 2 END AS r, d FROM s),
 t AS (SELECT p.doc_id, key, n.para_index, count(*) OVER (PARTITION BY p.doc_id, key) AS c FROM p JOIN n ON n.doc_id = p.doc_id AND substr(trim(n.text), 1, 30) = substr(trim(p.text), 1, 30)), u AS (SELECT * FROM a UNION ALL SELECT doc_id, key, para_index, 3, 0 FROM t WHERE c = 1),
 b AS (SELECT doc_id, key, min(struct_pack(r := r, d := d, i := para_index)) AS b FROM u GROUP BY ALL), o AS (SELECT p.doc_id, p.key, n.para_index, count(*) OVER (PARTITION BY p.doc_id, p.key) AS c FROM p JOIN n ON n.doc_id = p.doc_id AND contains(n.text, p.text) ANTI JOIN b ON b.doc_id = p.doc_id AND b.key = p.key)
 SELECT p.doc_id, p.key, coalesce((b.b).i, o.para_index)::BIGINT AS para_index, CASE WHEN o.para_index IS NOT NULL THEN 'whole' WHEN b.b IS NULL THEN 'gone' ELSE ['same place', 'unique', 'ambiguous', 'prefix'][(b.b).r + 1] END AS how FROM p LEFT JOIN b USING (doc_id, key) LEFT JOIN o ON o.doc_id = p.doc_id AND o.key = p.key AND o.c = 1""")
def relocation(spark, sf):
    return R.relocated(G.PLACES.df(spark, sf).withColumn("fp", T.fingerprint("text")), G.NOW.df(spark, sf)).select("doc_id", "key", long("para_index"), "how")


@query(f"""WITH r AS ({G.RUNS.sql()}), w AS (SELECT doc_id, para_index, text, run_ord, row_number() OVER (PARTITION BY doc_id, para_index, text ORDER BY run_ord) - 1 AS nth FROM r), l AS (SELECT DISTINCT doc_id, para_index, 0 AS nth, '。后文' AS run_text FROM r)
 SELECT l.doc_id, l.para_index::BIGINT AS para_index, run_ord::BIGINT AS run_ord FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.para_index = l.para_index AND w.text = run_text AND w.nth = l.nth""")
def run_relocation(spark, sf):
    r = G.RUNS.df(spark, sf)
    places = r.select("doc_id", "para_index").distinct().select(F.lit("x").alias("key"), "doc_id", "para_index", F.lit("。后文").alias("run_text"), F.lit(0).alias("nth"))
    return R.relocated_runs(places, r).select("doc_id", long("para_index"), long("run_ord"))


def edits(spark, sf) -> DataFrame:
    items = G.ITEMS.df(spark, sf).withColumn("params", F.expr(G.PARAMS))
    return R.edited(R.parts_of(G.RUNS.df(spark, sf)), items)


_AFTER = f"""r AS ({G.RUNS.sql()}), e AS (SELECT doc_id, para_index, run_ord, CASE WHEN para_index = 2 AND run_ord = 0 THEN '改' ELSE text END AS text, CASE WHEN para_index = 1 AND run_ord = 1 THEN doc_id % 2 = 0 ELSE superscript END AS superscript, CASE WHEN para_index = 5 AND run_ord = 1 THEN NULL ELSE size_pt END AS size_pt, CASE WHEN para_index = 4 AND run_ord = 1 THEN NULL ELSE anchor END AS anchor FROM r),
 d AS (SELECT * FROM e WHERE NOT (doc_id % 3 = 0 AND para_index = 3) UNION ALL SELECT doc_id, 7, 0, '新', false, NULL, NULL FROM documents)"""


@query(f"WITH {_AFTER} SELECT doc_id, (para_index - CASE WHEN doc_id % 3 = 0 AND para_index > 3 THEN 1 ELSE 0 END)::BIGINT AS para_index, run_ord::BIGINT AS run_ord, text, superscript, size_pt, anchor FROM d")
def apply_edits(spark, sf):
    return R.of_kind(edits(spark, sf), "run").select("doc_id", long("para_index"), long("run_ord"), "text", "superscript", "size_pt", "anchor")


@query(f"""WITH r AS ({G.RUNS.sql()}), i AS ({G.ITEMS.sql()}), j AS (SELECT i.*, r.superscript, r.size_pt, r.anchor, r.link_kind FROM i LEFT JOIN r ON r.doc_id = i.doc_id AND r.para_index = i.loc_index AND r.run_ord = 1 WHERE enabled)
 SELECT doc_id, issue_key, row_number() OVER (PARTITION BY doc_id ORDER BY {_PHASE}, loc_index DESC, issue_key)::BIGINT AS step, CASE WHEN loc_index = 99 THEN 'failed: no such paragraph' WHEN action = 'cite.superscript' AND superscript = (doc_id % 2 = 0) THEN 'skipped' WHEN action = 'run.clear_size' AND size_pt IS NULL THEN 'skipped' WHEN action = 'cite.link' AND anchor IS NULL AND link_kind IS NULL THEN 'skipped' ELSE 'applied' END AS status FROM j""")
def apply_journal(spark, sf):
    return R.of_kind(edits(spark, sf), "journal").select("doc_id", "issue_key", long("step"), "status")


# proposal, routing, scalars


_PS = f"""p AS ({G.PROPOSALS.sql()}), t AS (SELECT doc_id, nullif(trim(regexp_extract(proposal, '《([^》]+)》', 1)), '') AS title, proposal, thesis FROM p), n AS (SELECT doc_id, nullif(regexp_extract(proposal, '(?:计划访谈|拟访谈)\\s*([0-9]+)\\s*(?:[-–—]\\s*([0-9]+)\\s*)?人', 1), '')::INT AS lo, nullif(regexp_extract(proposal, '(?:计划访谈|拟访谈)\\s*([0-9]+)\\s*(?:[-–—]\\s*([0-9]+)\\s*)?人', 2), '')::INT AS hi,
 coalesce(nullif(regexp_extract(thesis, '完成访谈\\s*([0-9]+)\\s*人', 1), ''), nullif(regexp_extract(thesis, '访谈\\s*([0-9]+)\\s*人', 1), ''))::INT AS got, nullif(regexp_extract(proposal, '不少于\\s*([0-9]+)\\s*条', 1), '')::INT AS want FROM p), en AS (SELECT doc_id, count(*) AS c FROM ({G.ENTRIES.sql()}) GROUP BY 1), nn AS (SELECT n.*, coalesce(hi, lo) AS most, coalesce(c, 0) AS c FROM n LEFT JOIN en USING (doc_id))"""
_A = {
    "A1": "SELECT doc_id, 'A1' AS anchor, CASE WHEN title IS NULL THEN 'undecidable' WHEN NOT contains(proposal, title) THEN 'missing' WHEN NOT contains(thesis, title) THEN 'deviates' ELSE 'passed' END AS conclusion, coalesce(title, '') AS value FROM t",
    "A4": "SELECT doc_id, 'A4', CASE WHEN lo IS NULL OR got IS NULL THEN 'undecidable' WHEN got BETWEEN lo AND most THEN 'passed' ELSE 'changed' END, coalesce(lo::VARCHAR, '?') || '-' || coalesce(most::VARCHAR, '?') || ':' || coalesce(got::VARCHAR, '?') FROM nn",
    "A7": "SELECT doc_id, 'A7', CASE WHEN want IS NULL OR c >= want THEN 'passed' ELSE 'missing' END, c || '/' || coalesce(want::VARCHAR, '-') FROM nn",
}
NO_ANCHORS = "section string, field string, tokens array<string>"


def anchors(spark, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), NO_ANCHORS)


@query(f"WITH {_PS} " + union(*_A.values()))
def proposal_consistency(spark, sf):
    pairs = G.PROPOSALS.df(spark, sf)
    none = anchors(spark)
    return P.topic(pairs, none).unionByName(P.sample(pairs, none)).unionByName(P.promised_entries(pairs, entries(spark, sf))).select(long("doc_id"), "anchor", "conclusion", "value")


@query(f"WITH {_PS} SELECT doc_id, 'A4' AS anchor, CASE WHEN NOT (contains(proposal, '访谈') AND contains(proposal, '条')) THEN 'missing' WHEN NOT (contains(thesis, '访谈') AND contains(thesis, '条')) THEN 'deviates' ELSE 'passed' END AS conclusion, '访谈,条' AS value FROM p UNION ALL "
       "SELECT doc_id, 'A4', CASE WHEN lo IS NULL OR g IS NULL THEN 'undecidable' WHEN g BETWEEN lo AND most THEN 'passed' ELSE 'changed' END, coalesce(lo::VARCHAR, '?') || '-' || coalesce(most::VARCHAR, '?') || ':' || coalesce(g::VARCHAR, '?') FROM (SELECT nn.doc_id, nullif(regexp_extract(proposal, '拟访谈\\s*([0-9]+)\\s*人', 1), '')::INT AS lo, nullif(regexp_extract(proposal, '拟访谈\\s*([0-9]+)\\s*人', 1), '')::INT AS most, nullif(regexp_extract(thesis, '访谈\\s*([0-9]+)\\s*人', 1), '')::INT AS g FROM nn JOIN p USING (doc_id))")
def proposal_method(spark, sf):
    pairs, a = G.PROPOSALS.df(spark, sf), anchors(spark, ("A4_method", "tokens", ["访谈", "条"]), ("A4_method", "plan_anchor", ["拟访谈"]), ("A4_method", "actual_anchor", ["访谈"]))
    return P.method(pairs, a).unionByName(P.sample(pairs, a))


_OL = f"""o AS ({G.OUTLINES.sql()}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM o), lo AS (SELECT doc_id, min(k) AS lo FROM l WHERE raw LIKE '论文提纲%' GROUP BY 1), hi AS (SELECT doc_id, min(k) AS hi FROM l JOIN lo USING (doc_id) WHERE k > lo AND raw LIKE '进度安排%' GROUP BY 1),
 pl AS (SELECT l.doc_id, k, CASE WHEN regexp_matches(raw, '^[一二三四五六七八九十]+、') THEN 1 WHEN regexp_matches(raw, '^[（(][一二三四五六七八九十]+[）)]') THEN 2 WHEN regexp_matches(raw, '^\\d+[.．、]') THEN 3 END AS level, regexp_replace(raw, '^([一二三四五六七八九十]+、|[（(][一二三四五六七八九十]+[）)]|\\d+[.．、])\\s*', '') AS text FROM l JOIN lo USING (doc_id) LEFT JOIN hi USING (doc_id) WHERE k > lo AND (hi IS NULL OR k < hi)),
 plan AS (SELECT * FROM pl WHERE level IS NOT NULL), h AS ({G.THESIS_HEADS.sql()})"""


@query(f"WITH {_OL} SELECT doc_id, (k - 1)::BIGINT AS k, level::BIGINT AS level, text FROM plan")
def proposal_plan(spark, sf):
    return P.outline(G.OUTLINES.df(spark, sf), "论文提纲", "进度安排").select("doc_id", long("k"), long("level"), "text")


@query(f"""WITH {_OL}, x AS (SELECT doc_id, min(para_index) AS lo FROM h WHERE style_level = 1 AND contains(text, '第1章') GROUP BY 1), y AS (SELECT doc_id, min(para_index) AS hi FROM h JOIN x USING (doc_id) WHERE style_level = 1 AND para_index > lo GROUP BY 1)
 SELECT doc_id, 'A5' AS anchor, 'passed' AS conclusion, '背景' AS value FROM (SELECT DISTINCT doc_id FROM plan WHERE contains(text, '背景')) SEMI JOIN (SELECT doc_id FROM h WHERE contains(text, '背景')) USING (doc_id)
 UNION ALL SELECT p.doc_id, 'A5', 'changed', concat_ws('>', '文献综述', (SELECT arg_min(text, para_index) FROM h WHERE h.doc_id = p.doc_id AND contains(text, '绪论'))) FROM (SELECT DISTINCT doc_id FROM plan WHERE level = 1 AND contains(text, '文献综述')) p ANTI JOIN (SELECT doc_id FROM h WHERE style_level = 1 AND contains(text, '文献综述')) USING (doc_id)
 UNION ALL SELECT h.doc_id, 'A5', 'deviates', text FROM h JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) WHERE style_level = 2 AND para_index > lo AND (hi IS NULL OR para_index < hi) AND (contains(text, '补充') OR contains(text, '临时')) AND h.doc_id NOT IN (SELECT doc_id FROM plan WHERE contains(text, '补充') OR contains(text, '临时'))
 UNION ALL SELECT p.doc_id, 'A5', 'missing', concat_ws('~', '讨论', (SELECT arg_min(text, para_index) FROM h WHERE h.doc_id = p.doc_id AND contains(text, '结语'))) FROM (SELECT DISTINCT doc_id FROM plan WHERE contains(text, '讨论')) p ANTI JOIN (SELECT doc_id FROM h WHERE contains(text, '讨论')) USING (doc_id)""")
def proposal_outline(spark, sf):
    a = anchors(spark, *[("A5_outline", f, t) for f, t in (("expect_passed", ["背景"]), ("merged_chapter", ["文献综述"]), ("merged_target", ["绪论"]), ("extra_tokens", ["补充", "临时"]), ("chapter_heading", ["第1章"]), ("missing_section", ["讨论"]), ("missing_fallback", ["结语"]))])
    return P.structure(P.outline(G.OUTLINES.df(spark, sf), "论文提纲", "进度安排"), G.THESIS_HEADS.df(spark, sf), a)


_SNIP = "CASE WHEN strpos({0}, tk) > 0 THEN substr({0}, greatest(strpos({0}, tk) - 12, 1), strpos({0}, tk) - greatest(strpos({0}, tk) - 12, 1) + 34) END"


@query(f"""WITH p AS ({G.PROPOSALS.sql()}), h AS ({G.THESIS_HEADS.sql()}), k AS (SELECT p.*, CASE WHEN contains(proposal, '访谈') AND contains(thesis, '访谈') THEN '访谈' ELSE '访谈' END AS tk, (SELECT arg_min(text, para_index) FROM h WHERE h.doc_id = p.doc_id AND contains(text, '讨论')) AS th, (SELECT min(para_index) FROM h WHERE h.doc_id = p.doc_id AND contains(text, '讨论')) AS ti FROM p)
 SELECT doc_id, 'A2' AS anchor, 'pending' AS verdict, 'same concept? 访谈/乡村' AS question, {_SNIP.format('proposal')} AS proposal_excerpt, {_SNIP.format('thesis')} AS thesis_excerpt, th AS thesis_heading, ti::BIGINT AS para_index FROM (SELECT * REPLACE (CASE WHEN contains(proposal, '访谈') AND contains(thesis, '访谈') THEN '访谈' WHEN contains(proposal, '乡村') AND contains(thesis, '乡村') THEN '乡村' ELSE '访谈' END AS tk) FROM k)
 UNION ALL SELECT doc_id, 'A3', 'undecidable', 'same theory?', NULL, NULL, NULL, NULL FROM p UNION ALL SELECT doc_id, 'A6', 'pending', 'same conclusion?', NULL, NULL, th, ti FROM k""")
def proposal_cards(spark, sf):
    a = anchors(spark, ("A2_concept", "tokens", ["访谈", "乡村"]), ("A2_concept", "thesis_heading", ["讨论"]), ("A6_conclusion", "thesis_heading", ["讨论"]))
    return P.cards(G.PROPOSALS.df(spark, sf), a, G.THESIS_HEADS.df(spark, sf)).select("doc_id", "anchor", "verdict", "question", "proposal_excerpt", "thesis_excerpt", "thesis_heading", long("para_index"))


@query(f"WITH {_PS}, al AS ({union(*_A.values())}) SELECT doc_id, conclusion, count(*)::BIGINT AS n FROM al GROUP BY ALL")
def proposal_counts(spark, sf):
    return P.by_conclusion(proposal_consistency(spark, sf))


@query(f"WITH {_PS}, al AS ({union(*_A.values())}) " + found("FROM al WHERE conclusion <> 'passed'", "prop-consistency", "anchor", "CASE conclusion WHEN 'missing' THEN 'error' WHEN 'undecidable' THEN 'info' ELSE 'warn' END", "NULL", "anchor || ':' || conclusion || ':' || value"))
def proposal_issues(spark, sf):
    return brief(P.proposal_issues(proposal_consistency(spark, sf)))


@query(f"WITH {_PS}, al AS ({union(*_A.values())}), r AS (SELECT doc_id, anchor FROM al WHERE conclusion <> 'passed'), g AS (SELECT doc_id, 'A4' AS anchor FROM p WHERE doc_id % 2 = 0) SELECT (SELECT count(*) FROM r SEMI JOIN g USING (doc_id, anchor))::BIGINT AS hits, (SELECT count(*) FROM g)::BIGINT AS golden, (SELECT count(*) FROM r)::BIGINT AS reported, (SELECT count(*) FROM r ANTI JOIN g USING (doc_id, anchor))::BIGINT AS extra, (SELECT count(*) FROM g ANTI JOIN r USING (doc_id, anchor))::BIGINT AS missed")
def proposal_scores(spark, sf):
    golden = G.PROPOSALS.df(spark, sf).filter("doc_id % 2 = 0").select("doc_id", F.lit("A4").alias("anchor"))
    return P.scores(proposal_consistency(spark, sf).filter("conclusion <> 'passed'"), golden, ["doc_id", "anchor"])


@query(f"""WITH r AS (SELECT DISTINCT * FROM ({G.REPORTED.sql()})), g AS ({G.GOLDEN.sql()}), t AS ({G.THESIS_HEADS.sql()}), h AS (SELECT r.doc_id, r.anchor, r.conclusion, EXISTS (SELECT 1 FROM t WHERE t.doc_id = r.doc_id AND abs(t.para_index - r.para_index) <= 1 AND contains(t.text, g.keyword)) AS located FROM r JOIN g ON g.doc_id = r.doc_id AND g.anchor = r.anchor AND g.conclusion = r.conclusion),
 n AS (SELECT (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM g) AS golden, (SELECT count(*) FROM r) AS reported, (SELECT count(*) FROM h WHERE located) AS located) SELECT hits, golden, reported, reported - hits AS extra, located, hits / golden AS recall, (reported - hits) / reported AS false_rate, located / hits AS located_rate FROM n""")
def golden_locations(spark, sf):
    golden = G.GOLDEN.df(spark, sf).withColumn("keywords", F.array("keyword"))
    return P.located_scores(G.REPORTED.df(spark, sf), golden, G.THESIS_HEADS.df(spark, sf), reach=1)


@query("""WITH p AS (SELECT DISTINCT lower(regexp_replace(p_name, '\\s+', '', 'g')) AS phrase FROM part), g AS (SELECT DISTINCT phrase, g FROM (SELECT phrase, unnest(list_transform(range(1, length(phrase)), lambda i: substr(phrase, i, 2))) AS g FROM p)) SELECT g, count(*)::BIGINT AS df FROM g GROUP BY 1""")
def bigram_frequencies(spark, sf):
    phrases = table(spark, sf, "part").select(T.norm("p_name").alias("phrase")).distinct()
    return phrases.select(F.explode(T.bigrams(F.col("phrase"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))


#: Prompts for every document: one of those given, with a number behind it.
_PROMPTS = f"SELECT concat(prompt, CAST(doc_id AS STRING)) AS prompt FROM (SELECT doc_id, doc_id % 6 AS k FROM documents) JOIN (SELECT prompt, row_number() OVER (ORDER BY prompt) - 1 AS k FROM ({L.PROMPTS})) USING (k)"
_ROUTE = f"""ph AS ({L.PHRASES}), pr AS ({_PROMPTS}), n AS (SELECT count(*) AS n FROM ph), pg AS (SELECT DISTINCT skill, kind, phrase, unnest(list_transform(range(1, length(phrase)), lambda i: substr(phrase, i, 2))) AS g FROM ph), rg AS (SELECT DISTINCT prompt, unnest(list_transform(range(1, length(prompt)), lambda i: substr(prompt, i, 2))) AS g FROM pr),
 sk AS (SELECT count(DISTINCT skill) AS s FROM ph WHERE kind = 'trigger'), idle AS (SELECT g FROM pg WHERE kind = 'trigger' GROUP BY g HAVING count(DISTINCT skill) >= 2 AND count(DISTINCT skill) >= 0.5 * (SELECT s FROM sk)), wt AS (SELECT g, CASE WHEN g IN (SELECT g FROM idle) THEN 0.0 ELSE ln((n + 1) / (df + 0.5)) END AS w FROM (SELECT g, count(DISTINCT phrase) AS df FROM pg GROUP BY 1), n),
 rw AS (SELECT prompt, rg.g, coalesce(w, ln((n + 1) / 0.5)) AS w FROM rg LEFT JOIN wt USING (g), n), pw AS (SELECT skill, kind, phrase, pg.g, w FROM pg JOIN wt USING (g)), ra AS (SELECT prompt, sum(w) AS wa FROM rw GROUP BY 1), pa AS (SELECT skill, kind, phrase, sum(w) AS wb FROM pw GROUP BY ALL),
 sc AS (SELECT rw.prompt, pw.skill, pw.kind, pw.phrase, sum(rw.w) AS shared FROM rw JOIN pw USING (g) GROUP BY ALL), sm AS (SELECT sc.*, CASE WHEN wa + wb > 0 THEN 2 * shared / (wa + wb) ELSE 0 END AS score FROM sc JOIN ra USING (prompt) JOIN pa USING (skill, kind, phrase)),
 be AS (SELECT prompt, skill, coalesce(max(score) FILTER (kind = 'trigger'), 0) AS hit, coalesce(max(score) FILTER (kind = 'not_for'), 0) AS block, coalesce(max(score) FILTER (kind = 'out_of_scope'), 0) AS o FROM sm GROUP BY ALL), op AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY hit DESC, skill) AS k, lead(hit) OVER (PARTITION BY prompt ORDER BY hit DESC, skill) AS second FROM be WHERE hit > 0 AND NOT block >= greatest(hit, 0.30)), ou AS (SELECT prompt, max(o) AS o FROM be GROUP BY 1)"""


@query(f"WITH {_ROUTE} SELECT pr.prompt, CASE WHEN coalesce(ou.o, 0) > greatest(coalesce(hit, 0), 0.12) THEN 'not_covered' WHEN coalesce(hit, 0) < 0.12 THEN 'not_covered' WHEN hit - coalesce(second, 0) < 0.08 THEN 'ambiguous' ELSE skill END AS choice FROM pr LEFT JOIN (SELECT * FROM op WHERE k = 1) t USING (prompt) LEFT JOIN ou USING (prompt)")
def route_prompts(spark, sf):
    rows = sorted(r["prompt"] for r in spark.sql(L.PROMPTS).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    prompt = F.concat(F.element_at(F.array(*map(F.lit, rows)), (F.col("doc_id") % 6 + 1).cast("int")), F.col("doc_id").cast("string"))
    return RT.route(docs.select(prompt.alias("prompt")), spark.sql(L.PHRASES))


_DIGIT = "substr('零一二三四五六七八九', CAST(floor({0}) AS INT) % 10 + 1, 1)"
#: Numbers below 10000 in words, so that every unit and the zero between them occur.
IN_WORDS = (
    "concat(CASE WHEN n >= 1000 THEN concat(" + _DIGIT.format("n / 1000") + ", '千') ELSE '' END, CASE WHEN CAST(floor(n / 100) AS INT) % 10 > 0 THEN concat(" + _DIGIT.format("n / 100") + ", '百') WHEN n >= 1000 AND n % 100 > 0 THEN '零' ELSE '' END, "
    "CASE WHEN CAST(floor(n / 10) AS INT) % 10 = 1 AND n < 20 THEN '十' WHEN CAST(floor(n / 10) AS INT) % 10 > 0 THEN concat(" + _DIGIT.format("n / 10") + ", '十') WHEN n >= 100 AND CAST(floor(n / 100) AS INT) % 10 > 0 AND n % 10 > 0 THEN '零' ELSE '' END, CASE WHEN n % 10 > 0 THEN " + _DIGIT.format("n") + " ELSE '' END)"
)


@query(f"SELECT doc_id, {IN_WORDS} AS s, n::BIGINT AS n FROM ({G.NUMBERS.sql()}) UNION ALL SELECT doc_id, n || 'x', NULL FROM ({G.NUMBERS.sql()}) UNION ALL SELECT doc_id, ' ' || n || ' ', n FROM ({G.NUMBERS.sql()})")
def chinese_numbers(spark, sf):
    n = G.NUMBERS.df(spark, sf)
    s = n.selectExpr("doc_id", f"{IN_WORDS} AS s").union(n.selectExpr("doc_id", "concat(n, 'x') AS s")).union(n.selectExpr("doc_id", "concat(' ', n, ' ') AS s"))
    return s.select("doc_id", "s", long(T.cn_int("s"), "n"))


_NAMED = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in T.CN_SIZES.items())


@query(f"""WITH c(name, pt) AS (VALUES {_NAMED}), s AS (SELECT DISTINCT points FROM ({G.SIZES.sql()})), m AS (SELECT points, name, pt, row_number() OVER (PARTITION BY points ORDER BY abs(points - pt), name) AS k, abs(points - pt) AS d FROM s, c), b AS (SELECT points, CASE WHEN d <= 0.6 THEN name ELSE regexp_replace(points::VARCHAR, '\\.0$', '') || '磅' END AS name FROM m WHERE k = 1)
 SELECT b.points, b.name, c.pt AS back FROM b LEFT JOIN c USING (name)""")
def named_sizes(spark, sf):
    s = G.SIZES.df(spark, sf).select("points").distinct()
    return s.withColumn("name", T.size_name(F.col("points"))).withColumn("back", T.size_in_points(F.col("name")))


@query(f"WITH l AS ({G.LABELS.sql()}) SELECT doc_id, a, CASE WHEN lower(trim(a)) IN ('left', '顶格') THEN 'LEFT' WHEN lower(trim(a)) IN ('centre', '居中') THEN 'CENTER' WHEN lower(trim(a)) = '右对齐' THEN 'RIGHT' ELSE 'JUSTIFY' END AS alignment, f, CASE WHEN regexp_matches(f, '^[A-Z]{{6}}\\+') THEN substr(f, 8) ELSE f END AS font FROM l")
def alignments_and_fonts(spark, sf):
    return G.LABELS.df(spark, sf).select("doc_id", "a", T.alignment(F.col("a")).alias("alignment"), "f", T.font_name(F.col("f")).alias("font"))


@query(f"SELECT doc_id, line, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(line), '^(关键词|关键字|(?i:key\\s*words?))\\s*[:：]?\\s*', ''), '[；;，,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS words FROM ({G.KEYLINES.sql()})")
def keyword_split(spark, sf):
    return G.KEYLINES.df(spark, sf).select("doc_id", "line", F.array_join(T.keywords("line"), "|").alias("words"))


@query(f"""WITH p AS ({G.PATHS.sql()}), x AS (SELECT path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS e FROM p) SELECT path, CASE WHEN e IN ('docx', 'docm') THEN 'docx' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff', 'webp') THEN 'image' WHEN e IN ('md', 'txt') THEN 'text' WHEN e = 'json' THEN 'json' ELSE 'other' END AS kind,
 array_to_string(list_transform(regexp_extract_all(lower(path), '\\d+|\\D+'), lambda t: CASE WHEN regexp_matches(t, '^\\d') THEN lpad(t, 12, '0') ELSE t END), '') AS natural_key FROM x""")
def input_probe(spark, sf):
    return B.probe(G.PATHS.df(spark, sf))


@query(f"SELECT doc_id, k, place, (CASE WHEN lo > 0 THEN '…' ELSE '' END) || substr(text, lo + 1, hi - lo) || (CASE WHEN hi < length(text) THEN '…' ELSE '' END) AS shown FROM (SELECT doc_id, k, place, text, greatest(place - 18, 0) AS lo, least(place + 3 + 18, length(text)) AS hi FROM (SELECT doc_id, unnest(range(0, 5))::BIGINT AS k, (unnest(range(0, 5)) * 11 % greatest(length(text) - 3, 1))::BIGINT AS place, text FROM documents WHERE length(text) > 3))")
def excerpts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) > 3").select("*", F.explode(F.expr("sequence(0L, 4L)")).alias("k"))
    places = docs.withColumn("place", F.col("k") * 11 % F.greatest(F.length("text") - 3, F.lit(1)))
    return places.select("doc_id", "k", long("place"), T.excerpt(F.col("text"), F.col("place").cast("int"), (F.col("place") + 3).cast("int")).alias("shown"))


@query(f"SELECT doc_id, style_id, CASE WHEN regexp_matches(lower(name), '^toc|目录') THEN 'toc' WHEN regexp_matches(name, '一级标题') OR outline = 0 THEN 'h1' WHEN name = '二级标题' OR outline = 1 THEN 'h2' WHEN outline = 2 THEN 'h3' WHEN regexp_matches(lower(name), '正文|^normal$|^body') THEN 'body' END AS role FROM (SELECT doc_id, style_id, name, CASE WHEN regexp_extract(style_id, '\\d+')::INT % 6 = 5 THEN doc_id % 4 END AS outline FROM ({G.STYLES.sql()}))")
def style_roles(spark, sf):
    s = G.STYLES.df(spark, sf).withColumn("outline", F.expr("CASE WHEN cast(substr(style_id, 2) AS int) % 6 = 5 THEN doc_id % 4 END"))
    return s.select("doc_id", "style_id", T.role_of_style(F.col("name"), F.col("outline")).alias("role"))


@query(f"WITH l AS ({G.LABELS.sql()}), x AS (SELECT DISTINCT f, a FROM l), g AS (SELECT f, a, list_distinct(list_transform(range(1, length(f)), lambda i: substr(f, i, 2))) AS p, list_distinct(list_transform(range(1, length(trim(a))), lambda i: substr(trim(a), i, 2))) AS q FROM x WHERE length(trim(a)) > 1) SELECT f, a, 2.0 * len(list_intersect(p, q)) / (len(p) + len(q)) AS dice FROM g")
def bigram_similarity(spark, sf):
    return G.LABELS.df(spark, sf).select("f", "a").distinct().filter("length(trim(a)) > 1").select("f", "a", T.dice(F.col("f"), F.col("a")).alias("dice"))


@query(f"""WITH s AS ({G.STYLES.sql()}), h AS ({G.HEADINGS.sql()}) SELECT doc_id, para_index::BIGINT AS para_index, CASE WHEN contains(n, '一级标题') OR regexp_matches(lower(n), 'heading\\s*1\\b') THEN 1 WHEN contains(n, '二级标题') THEN 2 WHEN contains(n, '三级标题') THEN 3 END::BIGINT AS by_name,
 CASE WHEN n IN ('一级标题', 'h1') THEN 1 WHEN n = '二级标题' THEN 2 WHEN n = '三级标题' THEN 3 END::BIGINT AS by_chapter, CASE WHEN contains(n, '一级标题') THEN 1 WHEN contains(n, '二级标题') THEN 2 WHEN contains(n, '三级标题') THEN 3 WHEN regexp_matches(text, '^第[一二三四五六七八九十]+章') THEN 1 WHEN regexp_matches(text, '^\\d+[.、]') THEN 2 END::BIGINT AS by_outline
 FROM (SELECT *, CASE para_index % 5 WHEN 0 THEN 'Heading 1x' WHEN 1 THEN 'h1' WHEN 2 THEN 'my heading 1' WHEN 3 THEN style_name || '（新）' ELSE style_name END AS n FROM h)""")
def heading_levels_by_mode(spark, sf):
    n = F.expr("CASE para_index % 5 WHEN 0 THEN 'Heading 1x' WHEN 1 THEN 'h1' WHEN 2 THEN 'my heading 1' WHEN 3 THEN style_name || '（新）' ELSE style_name END")
    h = G.HEADINGS.df(spark, sf).withColumn("n", n)
    level = lambda mode: long(T.heading_level(F.col("n"), F.col("text"), mode), f"by_{mode}")
    return h.select("doc_id", long("para_index"), level("contains").alias("by_name"), level("chapter"), level("outline"))


@query(f"""WITH {_CT}, c AS (SELECT doc_id, para_index, size_pt, count(*) AS n FROM r WHERE size_pt IS NOT NULL GROUP BY ALL), b AS (SELECT doc_id, para_index, arg_max(size_pt, n * 1000 + size_pt) AS base FROM c GROUP BY ALL)
 SELECT cp.doc_id, round(avg(cp.size_pt / base), 2) AS ratio, count(*)::BIGINT AS n FROM cp JOIN b USING (doc_id, para_index) WHERE superscript AND cp.size_pt IS NOT NULL GROUP BY 1""")
def citation_size_ratio(spark, sf):
    return V.size_ratio(cites(spark, sf), G.RUNS.df(spark, sf)).select("doc_id", "ratio", long("n"))


_FONTS = ["ABCDEF+SimSun", "NSimSun", "STKaiti-Regular", "MicrosoftYaHei Bold", "Arial", "FZ-FangSong_GB", "MSYH"]


@query(f"WITH f AS (SELECT doc_id, {G.pick('doc_id', *G.q(*_FONTS))} AS font, {G.pick('doc_id', *G.q('完成 3次观察', '12 次机构观察，2次课', '没有'))} AS said FROM documents) SELECT doc_id, font, CASE WHEN contains(lower(font), 'simsun') THEN '宋体' WHEN contains(lower(font), 'kaiti') THEN '楷体' WHEN contains(lower(font), 'fangsong') THEN '仿宋' WHEN regexp_matches(lower(font), 'yahei|msyh') THEN '微软雅黑' ELSE font END AS cn, CASE WHEN contains(said, '观察') THEN regexp_extract(said, '\\d+')::BIGINT END AS observed FROM f")
def fonts_and_observations(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", f"{G.pick('doc_id', *G.q(*_FONTS))} AS font", f"{G.pick('doc_id', *G.q('完成 3次观察', '12 次机构观察，2次课', '没有'))} AS said")
    return docs.select("doc_id", "font", T.chinese_font(F.col("font")).alias("cn"), long(T.observations(F.col("said")), "observed"))


@query(f"""WITH b AS ({G.CAPTIONS.sql()}), p AS (SELECT doc_id, para_index, coalesce(sum((para_index % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS section_index FROM b WHERE kind = 'p')
 SELECT doc_id, section_index::BIGINT AS section_index, min(para_index)::BIGINT AS para_index FROM p GROUP BY ALL""")
def section_starts(spark, sf):
    b = G.CAPTIONS.df(spark, sf).withColumn("ends_section", F.coalesce(F.col("para_index") % 5 == 0, F.lit(False)))
    return D.section_starts(D.section_of(b)).select("doc_id", long("section_index"), long("para_index"))


@query(f"WITH h AS ({G.THESIS_HEADS.sql()}) SELECT doc_id, min(para_index)::BIGINT AS para_index, arg_min(text, para_index) AS text FROM h WHERE contains(text, '讨论') GROUP BY 1")
def first_headings(spark, sf):
    return D.first_holding(G.THESIS_HEADS.df(spark, sf), "讨论").select("doc_id", long("para_index"), "text")


@query(f"WITH {_CT} SELECT doc_id, coalesce(u.anchor, b.name) AS anchor, coalesce(uses, 0)::BIGINT AS uses, b.name IS NOT NULL AS there FROM (SELECT doc_id, anchor, count(*) AS uses FROM r WHERE anchor IS NOT NULL GROUP BY ALL) u FULL JOIN (SELECT DISTINCT doc_id, name, name AS anchor FROM bm) b USING (doc_id, anchor)")
def anchor_tally(spark, sf):
    return DX.anchor_tally(G.RUNS.df(spark, sf), G.BOOKMARKS.df(spark, sf)).select("doc_id", "anchor", long("uses"), "there")


_STATES = f"SELECT concat('t', CAST(doc_id AS STRING)) AS template, {G.pick('doc_id', *G.q('draft', 'confirmed', 'applied'), G.NULL_S)} AS status, CAST(doc_id % 5 AS INT) % 2 AS open_questions, {G.pick('doc_id * 3', *G.q('confirmed', 'applied', 'draft', 'lost'), G.NULL_S, G.NULL_S, G.NULL_S)} AS want FROM documents"


@query(f"WITH t AS ({_STATES}), r AS (SELECT *, coalesce(want IS NOT NULL AND (want NOT IN ('draft', 'confirmed', 'applied') OR (open_questions > 0 AND want <> 'draft')), false) AS refused FROM t) SELECT template, CASE WHEN want IS NOT NULL AND NOT refused THEN want WHEN want IS NULL AND open_questions > 0 THEN 'draft' ELSE coalesce(status, 'draft') END AS status, refused FROM r")
def template_states(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = docs.selectExpr(*[e.strip() for e in ("concat('t', CAST(doc_id AS STRING)) AS template", f"{G.pick('doc_id', *G.q('draft', 'confirmed', 'applied'), G.NULL_S)} AS status", "CAST(doc_id % 5 AS INT) % 2 AS open_questions", f"{G.pick('doc_id * 3', *G.q('confirmed', 'applied', 'draft', 'lost'), G.NULL_S, G.NULL_S, G.NULL_S)} AS want")])
    return TP.advanced(t.drop("want"), t.filter("want is not null").select("template", F.col("want").alias("status")))
