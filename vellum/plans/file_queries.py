"""Queries whose relations pass through files: packed into word-processor files, parsed from their bytes, checked by SQL.

Each document of the table becomes one file of varying size: paragraphs of runs, links and link fields, tables, sections with
headers and page fields, styles and bookmarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import conventions as V
from vellum.operators import derive as D
from vellum.plans import generated as G
from vellum.plans.document_queries import _AFTER, _SIZES
from vellum.plans.registry import long, query
from vellum.sinks import docx as X
from vellum.sinks import patch
from vellum.sinks import pdf as PX
from vellum.sources import docx as S
from vellum.sources import pdf as PS

#: Paragraphs of one run: from none to some hundred a document; of a few documents many more.
SIZED = G.Made(400, {
    "para_index": "k + 1", "run_ord": "0", "superscript": "((doc_id + k) % 5 = 0)", "text": f"concat('段', {G.text('doc_id * 31 + k')}, CASE WHEN k % 7 = 0 THEN concat(' <&> ', repeat('长', CAST(k % 50 AS INT))) ELSE '' END)",
    "style_name": G.pick("doc_id + k", *G.q("Normal", "一级标题", "另外"), G.NULL_S), "border": "CASE WHEN k % 11 = 3 THEN 'bottom=single,6' END",
}, "k < CASE WHEN doc_id % 50 = 7 THEN 400 ELSE doc_id % 23 END")
CELLS = G.Made(6, {"after_para": "1 + CAST(doc_id % 4 AS INT)", "row": "CAST(floor(k / 2) AS INT)", "col": "k % 2", "text": f"concat('格', {G.text('doc_id + k')}, CASE WHEN k = 3 THEN concat(chr(10), '二行') ELSE '' END)"}, "doc_id % 3 <> 0")
BODY = G.Made(5, {"para_index": "k + 1", "run_ord": "0", "text": f"concat('文', {G.text('k')})", "superscript": "false", "style_name": G.NULL_S})
ENDS = "CAST(CASE WHEN section_index < 3 THEN section_index * 2 - 1 END AS INT)"
MARKS = G.Made(4, {"para_index": "1 + k", "name": f"concat('ref', {G.text('k * 2')})"}, "(doc_id + k) % 3 <> 0")


def named(files: DataFrame) -> DataFrame:
    return files.select(F.col("doc_id").cast("string").alias("path"), "content")


def parsed(files: DataFrame, kind: str) -> DataFrame:
    """One relation of files(doc_id, content), with the document that each was made of."""
    return S.relation_of(named(files), kind).withColumn("doc_id", F.col("path").cast("long"))


def parsed_once(files: DataFrame, *kinds: str) -> dict[str, DataFrame]:
    """Several relations of files(doc_id, content), by one making and one parse of each file."""
    return {kind: rows.withColumn("doc_id", F.col("path").cast("long")) for kind, rows in S.relations_of(named(files), kinds=set(kinds)).items()}


def no_styles(spark, sf) -> DataFrame:
    return G.STYLES.df(spark, sf).limit(0)


def run_files(spark, sf) -> DataFrame:
    r = G.RUNS.df(spark, sf)
    return X.as_files(r.select("doc_id", "para_index").distinct(), r, no_styles(spark, sf))


_RUN_ORD = "row_number() OVER (PARTITION BY doc_id, para_index ORDER BY run_ord) - 1"


@query(f"SELECT doc_id, para_index::BIGINT AS para_index, ({_RUN_ORD})::BIGINT AS run_ord, text, superscript, anchor, CASE WHEN anchor IS NOT NULL THEN link_kind END AS link_kind, size_pt, font_ea FROM ({G.RUNS.sql()}) WHERE text <> ''")
def file_runs(spark, sf):
    """Visible runs with formats and links, out of hyperlinks and link fields."""
    return parsed(run_files(spark, sf), "runs").select("doc_id", long("para_index"), long("run_ord"), "text", "superscript", "anchor", "link_kind", "size_pt", "font_ea")


@query(f"""WITH r AS (SELECT *, ({_RUN_ORD})::BIGINT AS o FROM ({G.RUNS.sql()}) WHERE text <> ''), c AS (SELECT * FROM r WHERE regexp_matches(text, '^\\s*[\\[［（(]\\s*[0-9]+(\\s*[-–—~,，、]\\s*[0-9]+)*\\s*[\\]］）)]\\s*$') OR (superscript AND regexp_matches(text, '^[0-9]+$')))
 SELECT doc_id, para_index::BIGINT AS para_index, text, superscript, anchor FROM c""")
def file_citations(spark, sf):
    """Citations scanned in files' runs."""
    return D.citations(parsed(run_files(spark, sf), "runs")).select("doc_id", long("para_index"), "text", "superscript", "anchor")


def sized_files(spark, sf) -> DataFrame:
    p = G.Made.df(SIZED, spark, sf)
    marks = MARKS.df(spark, sf).join(p.groupBy("doc_id").agg(F.max("para_index").alias("n")), "doc_id").filter("para_index <= n")
    cells = CELLS.df(spark, sf).join(p.groupBy("doc_id").agg(F.max("para_index").alias("n")), "doc_id").filter("after_para <= n")
    return X.as_files(p, p, G.STYLES.df(spark, sf), bookmarks=marks, cells=cells)


_SIZED = f"p AS ({SIZED.sql()}), n AS (SELECT doc_id, max(para_index) AS n FROM p GROUP BY 1), m AS (SELECT m.* FROM ({MARKS.sql()}) m JOIN n USING (doc_id) WHERE para_index <= n), c AS (SELECT c.* FROM ({CELLS.sql()}) c JOIN n USING (doc_id) WHERE after_para <= n)"
_TABLES = "t AS (SELECT doc_id, after_para, string_agg(replace(text, chr(10), ''), chr(10) ORDER BY row, col) AS text FROM c GROUP BY ALL)"


@query(f"""WITH {_SIZED}, {_TABLES}, o AS (SELECT doc_id, 'p' AS kind, para_index, text, style_name, border, para_index * 2 AS place FROM p UNION ALL SELECT doc_id, 'tbl', NULL, text, NULL, NULL, after_para * 2 + 1 FROM t)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place)::BIGINT AS ord, kind, para_index::BIGINT AS para_index, text, style_name, border FROM o""")
def file_blocks(spark, sf):
    """Paragraphs and tables in order, with styles by name and borders; documents of no to 400 paragraphs."""
    return parsed(sized_files(spark, sf), "blocks").select("doc_id", long("ord"), "kind", long("para_index"), "text", "style_name", "border")


@query(f"WITH {_SIZED} SELECT doc_id, row::BIGINT AS row, col::BIGINT AS col, text FROM c")
def file_cells(spark, sf):
    """Cells, whose lines are paragraphs."""
    return parsed(sized_files(spark, sf), "cells").select("doc_id", long("row"), long("col"), "text")


@query(f"""WITH {_SIZED}, {_TABLES}, r AS (SELECT doc_id, row, string_agg(text, ' | ' ORDER BY col) AS line FROM c GROUP BY ALL), l AS (SELECT doc_id, 0 AS part, row AS i, line FROM r UNION ALL SELECT doc_id, 1, para_index, text FROM p)
 SELECT doc_id, string_agg(line, chr(10) ORDER BY part, i) AS text FROM l GROUP BY doc_id""")
def file_proposal_text(spark, sf):
    """A form's text, table rows first."""
    of = parsed_once(sized_files(spark, sf), "blocks", "cells")
    return S.proposal_text(of["blocks"], of["cells"])


@query(f"""WITH {_SIZED}, {_TABLES}, u AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT style_name)), ',') AS styles FROM p WHERE style_name IS NOT NULL GROUP BY 1), x AS (SELECT doc_id, sum(length(replace(text, chr(10), ''))) AS chars, sum(length(text)) AS with_ends FROM p GROUP BY 1)
 SELECT n.doc_id, n::BIGINT AS paragraphs, coalesce(tables, 0)::BIGINT AS tables, (with_ends + coalesce(table_chars, 0))::BIGINT AS chars, coalesce(styles, '') AS styles, coalesce(marks, 0)::BIGINT AS marks FROM n JOIN x USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS marks FROM m GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS tables, sum(length(text)) AS table_chars FROM t GROUP BY 1) USING (doc_id)""")
def file_summary(spark, sf):
    """A line for each document."""
    s = S.summary(parsed_once(sized_files(spark, sf), "blocks", "sections", "bookmarks"))
    return s.select("doc_id", long("paragraphs"), long("tables"), long("chars"), F.array_join("styles_used", ",").alias("styles"), long("bookmarks", "marks"))


@query(f"""WITH s AS ({G.SECTIONS.sql()}) SELECT doc_id, section_index::BIGINT AS section_index, CASE WHEN has_pgnumtype THEN page_fmt END AS page_fmt, has_pgnumtype, has_page_field, nullif(header_text, '') AS header_text, coalesce(header_has_rule, CASE WHEN header_text <> '' THEN false END) AS header_has_rule, round(width_cm, 1) AS width_cm, round(top_cm, 2) AS top_cm FROM s""")
def file_sections(spark, sf):
    """S8, 2.14: sections with page numbers, fields in footers, headers and their lines."""
    body = BODY.df(spark, sf)
    files = X.as_files(body, body, no_styles(spark, sf), G.SECTIONS.df(spark, sf).withColumn("last_para", F.expr(ENDS)))
    return parsed(files, "sections").select("doc_id", long("section_index"), "page_fmt", "has_pgnumtype", "has_page_field", "header_text", "header_has_rule", F.round("width_cm", 1).alias("width_cm"), F.round("top_cm", 2).alias("top_cm"))


@query(f"SELECT doc_id, style_id, name, based_on, link, is_default, CASE WHEN size_pt IS NOT NULL THEN round(size_pt * 2) / 2 END AS size_pt, font_ea FROM ({G.STYLES.sql()})")
def file_styles(spark, sf):
    """The style table."""
    body = BODY.df(spark, sf)
    return parsed(X.as_files(body, body, G.STYLES.df(spark, sf)), "styles").select("doc_id", "style_id", "name", "based_on", "link", "is_default", "size_pt", "font_ea")


@query(f"""WITH {_SIZED}, s AS ({G.STYLES.sql()}), u AS (SELECT DISTINCT p.doc_id, s.style_id FROM p JOIN s ON s.doc_id = p.doc_id AND s.name = p.style_name) SELECT s.doc_id, s.name FROM s LEFT JOIN u ON u.doc_id = s.doc_id AND u.style_id = s.style_id WHERE u.style_id IS NOT NULL OR s.is_default""")
def file_used_styles(spark, sf):
    """Styles that paragraphs use, and the default one."""
    of = parsed_once(sized_files(spark, sf), "styles", "blocks")
    return S.used_styles(of["styles"], of["blocks"]).select("doc_id", "name")


def repaired_runs(spark, sf) -> DataFrame:
    return patch.repaired(run_files(spark, sf).withColumn("path", F.col("doc_id").cast("string")), G.ITEMS.df(spark, sf).withColumn("params", F.expr(G.PARAMS)))


@query(f"""WITH {_AFTER}, v AS (SELECT doc_id, (para_index - CASE WHEN doc_id % 3 = 0 AND para_index > 3 THEN 1 ELSE 0 END)::BIGINT AS para_index, run_ord, text, superscript, size_pt, anchor FROM d WHERE text <> '')
 SELECT doc_id, para_index, ({_RUN_ORD})::BIGINT AS run_ord, text, superscript, size_pt, anchor FROM v""")
def file_repair(spark, sf):
    """Files after a plan's edits, carried into their trees."""
    return parsed(repaired_runs(spark, sf), "runs").select("doc_id", long("para_index"), long("run_ord"), "text", "superscript", "size_pt", "anchor")


@query(f"""WITH i AS ({G.ITEMS.sql()}) SELECT doc_id, count(*)::BIGINT AS items, count(*) FILTER (loc_index = 99)::BIGINT AS failed FROM i WHERE enabled GROUP BY doc_id""")
def file_repair_journal(spark, sf):
    each = repaired_runs(spark, sf).select("doc_id", F.explode("journal").alias("j"))
    return each.groupBy("doc_id").agg(long(F.count(F.lit(1)), "items"), long(F.count_if(F.col("j.status") == "failed: no such paragraph"), "failed"))


def page_spans(spark, sf) -> DataFrame:
    """Spans read from the bytes of page documents, one of each document."""
    given = G.SPANS.df(spark, sf)
    files = PX.as_pages(given.withColumn("ord", F.monotonically_increasing_id()))
    return PS.spans(files.select(F.col("doc_id").cast("string").alias("path"), "content")).withColumn("doc_id", F.col("path").cast("long"))


@query(f"SELECT doc_id, text, font, size, bold, round(x0, 3) AS x0, round(x1, 3) AS x1, page_width FROM ({G.SPANS.sql()})")
def file_page_spans(spark, sf):
    return page_spans(spark, sf).select("doc_id", "text", "font", "size", "bold", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), "page_width")


@query(_SIZES)
def file_page_sizes(spark, sf):
    """A12 over page documents: roles of the sizes that their spans have."""
    return V.sizes_of_spans(page_spans(spark, sf)).select(long("doc_id"), "size", long("chars"), "role", "bold", "font", "centred")
