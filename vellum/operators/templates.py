"""Templates: their state from draft to applied, the rules for writers that follow from a specification, and its styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("draft", "confirmed", "applied")


def advanced(templates: DataFrame, wanted: DataFrame) -> DataFrame:
    """(template, status, refused): templates(template, status, open_questions) after wanted(template, status).

    A template with open questions can't be confirmed or applied, and falls back to draft if it was; an unknown state is
    refused. Without a wish, or with a refused one, the state stays otherwise. A new template is a draft.
    """
    both = templates.join(wanted.select("template", F.col("status").alias("want")), "template", "left")
    now, asked = F.coalesce("status", F.lit("draft")), F.col("want").isNotNull()
    is_open = F.coalesce("open_questions", F.lit(0)) > 0
    refused = asked & (~F.col("want").isin(*STATES) | (is_open & (F.col("want") != "draft")))
    status = F.when(asked & ~refused, F.col("want")).when(is_open & ~asked, F.lit("draft")).otherwise(now)
    return both.select("template", status.alias("status"), refused.alias("refused"))


def constraints(standards: DataFrame) -> DataFrame:
    """(doc_id, text): what a writer has to keep to, a line for each standard that is set: standards(doc_id, key, value, source)."""
    line = F.concat(F.lit("- "), F.regexp_replace("key", "_", " "), F.lit(": "), "value", F.when(F.col("source") == "default", F.lit(" (by default)")).otherwise(F.lit("")))
    rows = standards.filter("value is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))).alias("rows"))
    return rows.select("doc_id", F.concat(F.lit("# Constraints\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


STYLE = "name:string,based_on:string,size_pt:double,font_cn:string,font_en:string,bold:boolean,align:string,space_before_pt:double,space_after_pt:double,line_spacing:double,first_line_indent_chars:double"


def styles_of_spec(specs: DataFrame) -> DataFrame:
    """The styles that specs(doc_id, spec) define, as a relation that can be written: {"styles": {role: {"name": .., ..}}}.

    A style without a name has its role's. Ids are the names; the style that nothing else is based on first is the default.
    """
    parsed = specs.select("doc_id", F.explode(F.from_json(F.get_json_object("spec", "$.styles"), f"map<string,struct<{STYLE}>>")).alias("role", "s"))
    name = F.coalesce("s.name", "role")
    return parsed.select(
        "doc_id", name.alias("style_id"), name.alias("name"), F.col("s.based_on").alias("based_on"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("next"), (F.col("role") == "body").alias("is_default"),
        "s.size_pt", F.col("s.font_cn").alias("font_ea"), F.col("s.font_en").alias("font_ascii"), "s.bold", "s.align", "s.space_before_pt", "s.space_after_pt", "s.line_spacing", "s.first_line_indent_chars",
        F.when(F.col("role").rlike("^h[1-6]$"), F.substring("role", 2, 1).cast("int") - 1).alias("outline_level"),
    )


def sample_paragraphs(styles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, runs): one paragraph in each style, which says its name, so that a template can be looked at."""
    from pyspark.sql import Window

    numbered = styles.withColumn("para_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("outline_level", "name")))
    paras = numbered.select("doc_id", "para_index", F.col("name").alias("style_name"), F.lit(None).cast("string").alias("border"))
    runs = numbered.select("doc_id", "para_index", F.lit(0).alias("run_ord"), F.col("name").alias("text"), F.lit(False).alias("superscript"))
    return paras, runs
