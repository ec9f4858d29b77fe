"""Conventions inferred from sample documents, with a confidence for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.durable import dealt_anew


def most_used(rows: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """For each group the value met most, the smallest among equals, with its count and the group's total."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = F.struct(F.col("c"), F.transform(F.split(F.col(value).cast("string"), ""), lambda x: -F.ascii(x)))
    return counted.groupBy(*keys).agg(F.max_by(value, w).alias(value), F.max("c").alias("most"), F.sum("c").alias(n))


def confidence(n: Column) -> Column:
    return F.when(n >= 10, "high").when(n >= 3, "medium").otherwise("low")


def citation(cites: DataFrame) -> DataFrame:
    """Form, position and multi style that a document's citations use most, over all its citations."""
    multi = F.when(F.size("refs") > 1, F.when(F.col("text").rlike("[-–—~]"), "merged").otherwise("separate")).otherwise("single")
    form = F.concat(F.when(F.col("superscript"), "superscript").otherwise("inline"), F.lit("-"), F.col("bracket"))
    rows = cites.select("doc_id", form.alias("form"), "position", multi.alias("multi"))
    out = most_used(rows, ["doc_id"], "form").select("doc_id", "form", "n", confidence(F.col("n")).alias("confidence"))
    for c in ("position", "multi"):
        out = out.join(most_used(rows, ["doc_id"], c).select("doc_id", c), "doc_id", "left")
    return out


def size_ratio(cites: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, ratio, n): the mean size of raised citations against the commonest size of their paragraph's runs, over all that have both.

    Of sizes that are equally common the larger counts. Documents whose raised citations have no size of their own have no row.
    """
    common = runs.filter("size_pt is not null").groupBy("doc_id", "para_index", "size_pt").agg(F.count(F.lit(1)).alias("c"))
    base = common.groupBy("doc_id", "para_index").agg(F.max_by("size_pt", F.struct("c", "size_pt")).alias("base"))
    sized = cites.filter("superscript and size_pt is not null").select("doc_id", "para_index", "size_pt").join(base, ["doc_id", "para_index"])
    return sized.groupBy("doc_id").agg(F.round(F.avg(F.col("size_pt") / F.col("base")), 2).alias("ratio"), F.count(F.lit(1)).alias("n"))


STYLE_OF_FORM = {"superscript-square": "superscript-bracket", "superscript-none": "superscript", "superscript-paren": "superscript", "inline-square": "bracket", "inline-paren": "bracket"}


def audit_style(form: Column) -> Column:
    """An inferred form in the words that the citation rules use."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLE_OF_FORM.items() for x in kv]), form)


def bibliography(entries: DataFrame) -> DataFrame:
    """Whether entries are numbered or by author and year, and whether at least half carry a type code."""
    typed = F.col("text").rlike(r"\[(M|J|D|C|N|R|S|P|A|Z|G|EB/OL|DB/OL|J/OL)\]")
    dated = F.col("number").isNull() & F.col("text").rlike(r"[（(,，]\s*(19|20)\d{2}")
    sums = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("numbered"), F.count_if(dated).alias("dated"), F.count_if(typed).alias("typed"))
    system = F.when(F.col("numbered") >= F.greatest("dated", F.lit(1)), "sequence").when(F.col("dated") > 0, "author-year").otherwise("unknown")
    return sums.select("doc_id", system.alias("system"), F.when(F.col("typed") * 2 >= F.col("n"), "GB/T 7714").alias("standard"), confidence(F.col("n")).alias("confidence"), "n")


def header(sections: DataFrame, bodies: DataFrame) -> DataFrame:
    """Whether headers repeat what the body says, and whether most have a line. bodies(doc_id, body): normalised text."""
    text = F.regexp_replace(F.lower("header_text"), r"\s+", "")
    known = sections.filter("header_text is not null and header_text <> ''").join(bodies, "doc_id", "left")
    inside = F.coalesce(F.contains("body", F.substring(text, 1, 10)), F.lit(False))
    sums = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"), F.count_if(F.col("header_has_rule")).alias("ruled"), F.count_if(~F.col("header_has_rule")).alias("bare"))
    rule = F.when(F.col("ruled") > F.col("bare"), True).when(F.col("bare") > F.col("ruled"), False)
    return sums.select("doc_id", F.when(F.col("inside") > 0, "paper-title").otherwise("custom").alias("content"), rule.alias("rule"), "n")


def page_numbering(sections: DataFrame) -> DataFrame:
    formats = sections.groupBy("doc_id").agg(F.count_distinct("page_fmt").alias("k"))
    return formats.select("doc_id", F.when(F.col("k") == 0, "unknown").when(F.col("k") == 1, "single").otherwise("multi-section").alias("scheme"))


def caption(blocks: DataFrame) -> DataFrame:
    """Captions with what stands within two blocks before and behind: blocks(doc_id, ord, is_caption, type, is_object)."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.max(F.col("is_object").cast("int")).over(w.rowsBetween(-2, -1))
    behind = F.max(F.col("is_object").cast("int")).over(w.rowsBetween(1, 2))
    placed = blocks.withColumn("position", F.when(F.coalesce(behind, F.lit(0)) == 1, "above").when(F.coalesce(before, F.lit(0)) == 1, "below").otherwise("unknown"))
    return placed.filter("is_caption").groupBy("doc_id", "type").agg(F.count_if(F.col("position") == "above").alias("above"), F.count_if(F.col("position") == "below").alias("below"))


def abstract(parts: DataFrame, words) -> DataFrame:
    """Sizes of the abstracts that are there: parts(doc_id, part, text) and a function that counts each part's units."""
    return parts.groupBy("doc_id", "part").agg(F.sum(words).alias("n"))


def roll_up(groups: DataFrame) -> DataFrame:
    """What to ask a person: groups(doc_id, name, confidence) to the low ones, and an overall confidence."""
    sums = dealt_anew(groups).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("confidence") == "low", F.col("name")))), ",").alias("ask"), F.count_if(F.col("confidence") == "low").alias("low"), F.count_if(F.col("confidence") == "high").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return sums.select("doc_id", "ask", F.when(F.col("low") * 2 > F.col("n"), "low").when(F.col("high") == F.col("n"), "high").otherwise("medium").alias("confidence"))


def sizes_of_spans(spans: DataFrame) -> DataFrame:
    """Roles of font sizes in a page document: the size of most characters is the body, larger ones are h1 to h4.

    spans(doc_id, size, font, bold, text), and for centred also x0, x1, page_width. Sizes within 0.4 of the body's are the
    body's. A size's font is the one of most characters, without a subset prefix; it is bold or centred if most characters
    are. A span is centred if its middle is the page's and it doesn't fill the lines.
    """
    chars = F.length("text")
    middle = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_width") / 2) <= 0.02 * F.col("page_width")
    centred = middle & (F.col("x1") - F.col("x0") < 0.6 * F.col("page_width")) if "page_width" in spans.columns else F.lit(False)
    rows = spans.select("doc_id", F.round("size", 1).alias("size"), F.regexp_replace("font", r"^[A-Z]{6}\+", "").alias("font"), "bold", centred.alias("mid"), chars.alias("n"))
    by_font = rows.groupBy("doc_id", "size", "font").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)).alias("bold"), F.sum(F.when(F.col("mid"), F.col("n")).otherwise(0)).alias("mid"))
    first = F.min(F.struct((-F.col("n")).alias("m"), "font")).alias("f")
    by_size = by_font.groupBy("doc_id", "size").agg(F.sum("n").alias("chars"), F.sum("bold").alias("bold"), F.sum("mid").alias("mid"), first)
    w = Window.partitionBy("doc_id")
    body = by_size.withColumn("body", F.first("size").over(w.orderBy(F.desc("chars"), "size")))
    larger = F.col("size") > F.col("body") + 0.4
    ranked = body.withColumn("k", F.when(larger, F.row_number().over(Window.partitionBy("doc_id", larger).orderBy(F.desc("size")))))
    role = F.when(F.col("size") == F.col("body"), "body").when(F.col("k") <= 4, F.concat(F.lit("h"), F.col("k").cast("string"))).otherwise("other")
    most = lambda c: F.col(c) * 2 > F.col("chars")
    return ranked.select("doc_id", "size", "chars", role.alias("role"), most("bold").alias("bold"), F.col("f.font").alias("font"), most("mid").alias("centred"))
