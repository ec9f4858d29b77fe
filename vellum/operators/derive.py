"""Relations derived from blocks: regions, the reference list, contents region, headings, captions, sections, citations.

Everything is partitioned by doc_id, so a document's blocks are shuffled once and windows share that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

CAPTION = r"^(图|表)\s*([0-9]+)[-—.]([0-9]+)"
FIGURE_REF = r"(?:图|表)\s*[0-9]+[-—.][0-9]+"


def by_doc(upto: int | None = None, ordered: bool = False):
    """A document's rows; in paragraph order; or up to that many rows behind the current one."""
    w = Window.partitionBy("doc_id")
    if upto is None:
        return w.orderBy("para_index") if ordered else w
    return w.orderBy("para_index").rowsBetween(Window.unboundedPreceding, upto)


def first_where(condition: Column, value: str = "para_index") -> Column:
    return F.min(F.when(condition, F.col(value)))


def regions(blocks: DataFrame) -> DataFrame:
    """blocks with region: front before the first chapter heading, ref from the reference heading on, appendix behind it."""
    p, t = F.col("kind") == "p", T.strip("text")
    marks = blocks.select(
        "*",
        first_where(p & (F.col("style_name") == "一级标题"), "ord").over(by_doc()).alias("first_h1"),
        first_where(p & T.norm("text").isin(*T.REF_HEADINGS), "ord").over(by_doc()).alias("ref"),
        first_where(p & t.startswith(T.APPENDIX_PREFIX), "ord").over(by_doc()).alias("appendix"),
    )
    region = (
        F.when(F.col("ord") < F.col("first_h1"), "front")
        .when((F.col("ord") >= F.col("ref")) & (F.col("ord") >= F.col("appendix")), "appendix")
        .when(F.col("ord") >= F.col("ref"), "ref")
        .otherwise("body")
    )
    return marks.withColumn("region", region).drop("first_h1", "ref", "appendix")


def references(blocks: DataFrame) -> DataFrame:
    """(doc_id, order, number, text, para_index): entries from the reference heading to acknowledgements or an appendix."""
    t, n = T.strip("text"), T.norm("text")
    paras = blocks.filter("kind = 'p'").select("doc_id", "para_index", t.alias("text"), n.alias("n"))
    head = first_where((F.length("text") <= 20) & F.col("n").isin(*T.REF_HEADINGS)).over(by_doc())
    inside = paras.withColumn("head", head).filter("para_index > head")
    stop = first_where(F.col("n").isin(*T.ACK_HEADINGS) | F.col("n").startswith(T.APPENDIX_PREFIX)).over(by_doc())
    entries = inside.withColumn("stop", stop).filter("(stop is null or para_index < stop) and text <> ''")
    entries = entries.filter((F.length("text") <= 250) | F.col("text").rlike(T.REF_NUM))
    return entries.select("doc_id", F.row_number().over(by_doc(ordered=True)).alias("order"), T.number_after(F.col("text"), T.REF_NUM).alias("number"), "text", "para_index")


def contents_region(blocks: DataFrame) -> DataFrame:
    """(doc_id, para_index) of the table of contents: from the first marker on, blanks included, up to the first other line.

    Needs the flag column is_marker (dot leader, field or tab). At most 400 paragraphs from the heading are looked at, as
    a table of contents isn't longer.
    """
    paras = blocks.filter("kind = 'p'")
    head = first_where((F.length(T.strip("text")) <= 20) & T.norm("text").isin(*T.TOC_HEADINGS)).over(by_doc())
    near = paras.withColumn("head", head).filter("para_index >= head and para_index < head + 400")
    marker, blank = F.col("is_marker"), T.strip("text") == ""
    started = near.withColumn("started", F.max(marker.cast("int")).over(by_doc(0)) == 1)
    stop = first_where(F.col("started") & ~marker & ~blank).over(by_doc())
    return started.withColumn("stop", stop).filter("started and (stop is null or para_index < stop)").select("doc_id", "para_index")


def body_only(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Paragraphs that text rules look at: outside the reference list and the table of contents."""
    last = entries.groupBy("doc_id").agg(F.min("para_index").alias("lo"), F.max("para_index").alias("hi"))
    out = blocks.filter("kind = 'p'").join(last, "doc_id", "left")
    toc = F.lower("style_name").contains("toc") | (F.col("style_name") == "目录标题")
    return out.filter(~F.coalesce(toc, F.lit(False)) & ~F.coalesce(F.col("para_index").between(F.col("lo"), F.col("hi")), F.lit(False))).drop("lo", "hi")


def headings(blocks: DataFrame, mode: str = "exact") -> DataFrame:
    """(doc_id, para_index, style_level, num, num_level, text) of paragraphs in heading styles."""
    out = blocks.filter("kind = 'p'").select("doc_id", "para_index", T.heading_level(F.col("style_name"), F.col("text"), mode).alias("style_level"), T.heading_number(F.col("text")).alias("num"), T.number_level(F.col("text")).alias("num_level"), T.strip("text").alias("text"))
    return out.filter("style_level is not null")


def captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, type, ch, seq, para_index, text, ord) of figure and table captions; the separator is required."""
    t = T.strip("text")
    out = blocks.filter((F.col("kind") == "p") & t.rlike(CAPTION))
    part = lambda k: F.regexp_extract(t, CAPTION, k)
    return out.select("doc_id", part(1).alias("type"), part(2).cast("int").alias("ch"), part(3).cast("int").alias("seq"), "para_index", t.alias("text"), "ord")


def section_of(blocks: DataFrame) -> DataFrame:
    """Paragraphs with section_index: a paragraph that ends a section still belongs to it (needs the flag ends_section)."""
    ended = F.coalesce(F.sum(F.col("ends_section").cast("int")).over(by_doc(-1)), F.lit(0))
    front = F.col("style_name").rlike("摘要|目录|(?i)abstract") | T.norm("text").rlike("^(摘要|目录|abstract)")
    paras = blocks.filter("kind = 'p'").withColumn("section_index", (ended + 1).cast("int")).withColumn("front_para", front)
    return paras.withColumn("is_front", F.max("front_para").over(Window.partitionBy("doc_id", "section_index")))


def citations(runs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Citations (T3) from runs: a run whose whole text is a citation token; bare digits need superscript.

    runs(doc_id, para_index, run_ord, text, superscript, anchor, link_kind); excluded(doc_id, para_index) aren't scanned.
    """
    by_para = Window.partitionBy("doc_id", "para_index")
    upto = by_para.orderBy("run_ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "text")).over(by_para)), lambda x: x["text"]), "")
    if excluded is not None:
        runs = runs.join(excluded, ["doc_id", "para_index"], "left_anti")
    placed = runs.withColumn("start", F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0)).cast("int")).withColumn("para_text", whole)
    placed = placed.withColumn("end", F.col("start") + F.length("text")).withColumn("bracket", T.bracket_of(F.col("text")))
    cites = placed.filter("bracket is not null and (bracket <> 'none' or superscript)")
    return cites.withColumn("refs", T.cited_numbers(F.col("text"))).withColumn("position", T.position_of(F.col("para_text"), F.col("start"), F.col("end")))


def citations_in_text(blocks: DataFrame) -> DataFrame:
    """Citations as tokens inside running text, for sources without runs: bracketed numbers, by their order in a paragraph."""
    token = r"\[\s*\d+(?:\s*[-–—~,，、]\s*\d+)*\s*\]"
    found = blocks.select("doc_id", "para_index", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"({token})"), F.lit(1))).alias("nth", "token"))
    return found.select("doc_id", "para_index", "nth", "token", T.bracket_of(F.col("token")).alias("bracket"), T.cited_numbers(F.col("token")).alias("refs"))


def occurrences(rows: DataFrame) -> DataFrame:
    """rows(doc_id, para_index, start, text) with nth: how often an equal text came before in the document."""
    w = Window.partitionBy("doc_id", T.norm("text")).orderBy("para_index", "start")
    return rows.withColumn("nth", F.row_number().over(w) - 1)


def section_starts(paras: DataFrame) -> DataFrame:
    """(doc_id, section_index, para_index): the first paragraph of each section, from section_of()."""
    return paras.groupBy("doc_id", "section_index").agg(F.min("para_index").alias("para_index"))


def first_holding(rows: DataFrame, piece: str) -> DataFrame:
    """(doc_id, para_index, text): the first of each document's rows(doc_id, para_index, text) that holds a piece of text."""
    found = rows.filter(F.contains("text", F.lit(piece))).groupBy("doc_id").agg(F.min(F.struct("para_index", "text")).alias("f"))
    return found.select("doc_id", "f.*")
