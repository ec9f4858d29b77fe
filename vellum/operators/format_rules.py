"""Format rules (L1): page setup and numbering, headers, fonts, styles, table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.issues import as_issues
from vellum.operators.standards import source_of

# Fixed values of the checks.
PAGES = {"A4": (21.0, 29.7), "A3": (29.7, 42.0), "A5": (14.8, 21.0), "B5": (17.6, 25.0), "Letter": (21.59, 27.94), "16K": (18.4, 26.0)}
FORMATS = {"decimal": "arabic"}
SPECIAL = ("参考文献条目", "参考文献标题", "表题", "图片来源", "关键词", "英文关键词", "摘要标题", "英文摘要标题", "目录标题", "致谢标题")
TOLERANCE_CM, TOLERANCE_PT = 0.05, 0.5


def is_body_style(name: Column) -> Column:
    return name.isNull() | ~(F.lower(name).startswith("toc") | name.contains("标题") | name.isin(*SPECIAL))


def is_chapter_style(name: Column) -> Column:
    return F.coalesce(name.rlike("^[一二三四五六]级标题$") | name.isin("h1", "h2", "h3", "h4", "h5", "h6"), F.lit(False))


def page_setup(sections: DataFrame, std: dict) -> DataFrame:
    """Sections whose paper or margins aren't the standard's. Margins are [top, right, bottom, left] in cm."""
    paper = PAGES.get(std.get("page_size"))
    off = lambda c, v: F.abs(F.col(c) - F.lit(v)) > TOLERANCE_CM
    wrong = sections.filter(off("width_cm", paper[0]) | off("height_cm", paper[1])) if paper else sections.limit(0)
    out = as_issues(wrong, "page-setup", "size", "L1", "error", F.concat_ws("x", "width_cm", "height_cm"), F.col("section_index"), std.get("page_size"), kind="section", source=source_of(std, "page_size"))
    margins = std.get("page_margins_cm")
    if not margins:
        return out
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_cm").alias("is"), F.lit(float(v)).alias("want")) for side, v in zip(("top", "right", "bottom", "left"), margins, strict=True)]))
    each = sections.select("doc_id", "section_index", sides.alias("m")).filter(F.abs(F.col("m.is") - F.col("m.want")) > TOLERANCE_CM)
    return out.unionByName(as_issues(each, "page-setup", "margin", "L1", "error", F.concat_ws(":", "m.side", "m.is"), F.col("section_index"), F.col("m.want").cast("string"), kind="section", source=source_of(std, "page_margins_cm")))


def page_format(fmt: Column) -> Column:
    return F.when(fmt == "decimal", "arabic").otherwise(fmt)


def page_numbering(sections: DataFrame, std: dict) -> DataFrame:
    """Sections without numbers, of another format than the scheme, Arabic in front, or unnumbered among numbered ones.

    Without a scheme the first front section with Arabic numbers ends a document's check: its later sections aren't judged.
    """
    bare = sections.filter("not has_pgnumtype and not has_page_field")
    index = F.col("section_index")
    out = as_issues(bare.filter("is_front"), "page-numbering", "no-front", "L1", "warn", F.lit("none"), index, kind="section")
    out = out.unionByName(as_issues(bare.filter("not is_front"), "page-numbering", "no-body", "L1", "error", F.lit("none"), index, kind="section", suppressible=False))
    fmt = page_format(F.col("page_fmt"))
    scheme = std.get("page_numbering_scheme")
    if scheme is not None:
        return out.unionByName(as_issues(sections.filter("has_pgnumtype").filter(fmt != scheme), "page-numbering", "format", "L1", "error", fmt, index, scheme, kind="section", source=source_of(std, "page_numbering_scheme")))
    w = Window.partitionBy("doc_id")
    several = sections.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("any", F.max("has_pgnumtype").over(w)).filter("n > 1")
    arabic = F.coalesce(F.col("is_front") & F.col("has_pgnumtype") & (fmt == "arabic"), F.lit(False))
    several = several.withColumn("arabic", arabic).withColumn("stop", F.min(F.when(arabic, index)).over(w)).filter("stop is null or section_index <= stop")
    out = out.unionByName(as_issues(several.filter("arabic"), "page-numbering", "front-arabic", "L1", "warn", fmt, index, kind="section"))
    return out.unionByName(as_issues(several.filter("any and not has_pgnumtype"), "page-numbering", "missing", "L1", "warn", F.lit("no type"), index, kind="section"))


def header(sections: DataFrame, std: dict) -> DataFrame:
    """Lines under headers against the standard, or among each other; and header texts. A line that isn't known isn't judged."""
    headed = sections.filter("header_text is not null and header_text <> ''")
    index, rule = F.col("section_index"), std.get("header_rule")
    judged = headed.filter("header_has_rule is not null")
    wrong = judged.filter(F.col("header_has_rule") != F.lit(bool(rule))) if rule is not None else judged.limit(0)
    action = "para.border" if rule else None
    out = as_issues(wrong, "header", "line", "L1", "warn", F.col("header_has_rule"), index, str(rule).lower(), kind="section", action=action, params=F.create_map(F.lit("part"), F.lit("header")), source=source_of(std, "header_rule"))
    mixed = sections.groupBy("doc_id").agg(F.bool_or(F.coalesce("header_has_rule", F.lit(False))).alias("some"), F.bool_and(F.coalesce("header_has_rule", F.lit(False))).alias("all")).filter("some and not all")
    out = out.unionByName(as_issues(mixed, "header", "line-mixed", "L1", "warn", F.lit("mixed"), kind="document"))
    want = std.get("header_content")
    if want is not None:
        other = headed.filter(T.norm("header_text") != T.norm(F.lit(want)))
        out = out.unionByName(as_issues(other, "header", "text", "L1", "warn", F.col("header_text"), index, want, kind="section", source=source_of(std, "header_content")))
    texts = headed.groupBy("doc_id").agg(F.countDistinct(T.norm("header_text")).alias("n")).filter("n > 1")
    return out.unionByName(as_issues(texts, "header", "text-mixed", "L1", "warn", F.col("n"), kind="document"))


def effective(paras: DataFrame, runs: DataFrame, styles: DataFrame) -> DataFrame:
    """paras with size_pt and font: the paragraph's own value, else the first run's that has one, else the style's."""
    w = Window.partitionBy("doc_id", "para_index").orderBy("run_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = runs.select("doc_id", "para_index", F.first("size_pt", ignorenulls=True).over(w).alias("r_size"), F.first("font_ea", ignorenulls=True).over(w).alias("r_font")).distinct()
    named = styles.select("doc_id", F.col("name").alias("style_name"), F.col("size_pt").alias("s_size"), F.col("font_ea").alias("s_font"))
    out = paras.join(first, ["doc_id", "para_index"], "left").join(named, ["doc_id", "style_name"], "left")
    return out.withColumn("size_pt", F.coalesce("r_size", "s_size")).withColumn("font", F.coalesce("r_font", "s_font")).drop("r_size", "s_size", "r_font", "s_font")


def fonts(paras: DataFrame, std: dict) -> DataFrame:
    """Body styles whose paragraphs differ in size or font, and sizes off the standard. paras(.., size_pt, font)."""
    body = paras.filter(is_body_style(F.col("style_name")))
    out = None
    for sub, column in (("size", F.round("size_pt", 3)), ("font", F.col("font"))):
        groups = body.withColumn("v", column).filter("v is not null").groupBy("doc_id", "style_name").agg(F.array_sort(F.collect_set("v")).alias("vs")).filter(F.size("vs") > 1)
        part = as_issues(groups, "fonts", sub, "L1", "warn", F.concat_ws(":", "style_name", F.array_join(F.col("vs").cast("array<string>"), "/")), kind="style")
        out = part if out is None else out.unionByName(part)
    want = std.get("body_size_pt")
    if want is None:
        return out
    off = body.filter(F.abs(F.col("size_pt") - F.lit(float(want))) > TOLERANCE_PT)
    return out.unionByName(as_issues(off, "fonts", "standard", "L1", "warn", F.col("size_pt"), F.col("para_index"), str(want), source=source_of(std, "body_size_pt")))


def style_compliance(paras: DataFrame, runs: DataFrame, declared: DataFrame | None) -> DataFrame:
    """Styles that aren't declared (by display name), long paragraphs in heading styles, formatting set by hand in body text."""
    used = paras.filter("style_name is not null").select("doc_id", "style_name").distinct()
    unknown = used.join(declared.select(F.col("name").alias("style_name")).distinct(), "style_name", "left_anti") if declared is not None else used.limit(0)
    out = as_issues(unknown, "style-compliance", "unknown", "L1", "warn", F.col("style_name"), kind="style")
    long_ = paras.filter(is_chapter_style(F.col("style_name")) & (F.length(T.strip("text")) > 40))
    out = out.unionByName(as_issues(long_, "style-compliance", "heading-misuse", "L1", "warn", F.length(T.strip("text")), F.col("para_index"), text=F.col("text")))
    w = Window.partitionBy("doc_id", "para_index").orderBy("run_ord")
    body = paras.filter(is_body_style(F.col("style_name"))).select("doc_id", "para_index")
    direct = runs.filter("size_pt is not null or font_ea is not null").withColumn("k", F.row_number().over(w)).filter("k = 1").join(body, ["doc_id", "para_index"], "left_semi")
    sized = as_issues(direct.filter("size_pt is not null"), "style-compliance", "direct-size", "L1", "warn", F.col("size_pt"), F.col("para_index"), kind="run", action="run.clear_size")
    return out.unionByName(sized).unionByName(as_issues(direct.filter("size_pt is null"), "style-compliance", "direct-font", "L1", "warn", F.col("font_ea"), F.col("para_index"), kind="run"))


def contents(paras: DataFrame, region: DataFrame) -> DataFrame:
    """The table of contents: there at all, a field, unbroken, and as long as the headings. region(doc_id, para_index)."""
    docs = paras.groupBy("doc_id").agg(
        F.max((F.length(T.strip("text")) <= 20) & T.norm("text").isin(*T.TOC_HEADINGS)).alias("has"), F.count_if(is_chapter_style(F.col("style_name"))).alias("heads")
    )
    inside = paras.join(region, ["doc_id", "para_index"], "left_semi").groupBy("doc_id").agg(
        F.max("has_toc_field").alias("field"), F.count_if(F.col("has_toc_anchor")).alias("entries"), F.max(F.col("text").rlike("未定义书签|(?i)bookmark not defined")).alias("broken")
    )
    all_ = docs.join(inside, "doc_id", "left").fillna(0, ["entries"]).fillna(False, ["field", "broken"])
    doc = {"kind": "document"}
    out = as_issues(all_.filter("not has"), "toc", "none", "L1", "info", F.lit("none"), **doc)
    out = out.unionByName(as_issues(all_.filter("has and not field"), "toc", "no-field", "L1", "error", F.lit("text"), suppressible=False, **doc))
    out = out.unionByName(as_issues(all_.filter("has and broken"), "toc", "broken", "L1", "error", F.lit("broken"), suppressible=False, **doc))
    out = out.unionByName(as_issues(all_.filter("has and heads > 0 and entries = 0"), "toc", "empty", "L1", "error", F.col("heads"), **doc))
    return out.unionByName(as_issues(all_.filter("has and entries > 0 and entries < heads"), "toc", "mismatch", "L1", "warn", F.concat_ws("<", "entries", "heads"), **doc))
