"""The issue relation: one schema for every rule, suppression, order, tallies and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.durable import dealt_anew

LAYERS, SEVERITIES = ("L1", "L2", "L3", "L4", "L4·26"), ("error", "warn", "info")
SOURCES = ("template", "config", "default")
COLUMNS = ("issue_key", "id", "doc_id", "rule", "sub_check", "layer", "skill", "severity", "loc_kind", "loc_index", "excerpt", "expected", "actual", "standard_source", "suppressible", "action", "params")
SKILL_OF = {"L1": "format-audit", "L2": "cite-doctor", "L3": "text-style", "L4": "structure-length", "L4·26": "proposal-consistency"}


def as_issues(found: DataFrame, rule: str, sub: str | Column, layer: str, severity: str | Column, actual: Column, index: Column | None = None, expected: str | Column | None = None, text: Column | None = None, kind: str | Column = "paragraph", suppressible: bool | Column = True, action: str | Column | None = None, params: Column | None = None, source: str | Column = "default") -> DataFrame:
    """found as issues. Each row of found is one finding; it needs doc_id, and what the given columns refer to."""
    lit = lambda v, t="string": v if isinstance(v, Column) else F.lit(v).cast(t)
    where = (index if index is not None else F.lit(None)).cast("int")
    doc, said = F.col("doc_id").cast("string"), actual.cast("string")
    return found.select(
        T.issue_key(doc, F.lit(rule), lit(sub), where, said).alias("issue_key"),
        T.issue_id(F.lit(rule), doc, lit(sub), where.cast("string"), said).alias("id"),
        "doc_id",
        F.lit(rule).alias("rule"),
        lit(sub).alias("sub_check"),
        F.lit(layer).alias("layer"),
        F.lit(SKILL_OF[layer]).alias("skill"),
        lit(severity).alias("severity"),
        lit(kind).alias("loc_kind"),
        where.alias("loc_index"),
        F.substring(lit(text), 1, 46).alias("excerpt"),
        lit(expected).alias("expected"),
        said.alias("actual"),
        lit(source).alias("standard_source"),
        lit(suppressible, "boolean").alias("suppressible"),
        lit(action).alias("action"),
        (params if params is not None else F.create_map()).cast("map<string,string>").alias("params"),
    )


FINDING = "rule string, sub string, severity string, expected string, actual string, source string"


def finding(rule: str, sub: str, severity: str, actual: Column, expected: str | None = None, source: str = "default") -> Column:
    """One finding about a row, as a struct of FINDING."""
    return F.struct(F.lit(rule).alias("rule"), F.lit(sub).alias("sub"), F.lit(severity).alias("severity"), F.lit(expected).cast("string").alias("expected"), actual.cast("string").alias("actual"), F.lit(source).alias("source"))


def of_findings(rows: DataFrame, findings: list[tuple[Column, Column]], layer: str) -> DataFrame:
    """Issues of rows(doc_id, para_index, text), with findings as (condition, finding): each row is looked at once, by all of them."""
    each = F.explode(F.array_compact(F.array(*[F.when(c, f) for c, f in findings])))
    found = rows.select("doc_id", "para_index", "text", each.alias("f"))
    doc, where = F.col("doc_id").cast("string"), F.col("para_index").cast("int")
    return found.select(
        T.issue_key(doc, F.col("f.rule"), F.col("f.sub"), where, F.col("f.actual")).alias("issue_key"),
        F.format_string("%s-%04d", F.col("f.rule"), T.hex_mod(F.sha1(F.concat_ws("|", F.col("f.rule"), doc, F.col("f.sub"), where.cast("string"), F.col("f.actual")).cast("binary")), 10000)).alias("id"),
        "doc_id", F.col("f.rule").alias("rule"), F.col("f.sub").alias("sub_check"), F.lit(layer).alias("layer"), F.lit(SKILL_OF[layer]).alias("skill"), F.col("f.severity").alias("severity"),
        F.lit("paragraph").alias("loc_kind"), where.alias("loc_index"), F.substring("text", 1, 46).alias("excerpt"), F.col("f.expected").alias("expected"), F.col("f.actual").alias("actual"),
        F.col("f.source").alias("standard_source"), F.lit(True).alias("suppressible"), F.lit(None).cast("string").alias("action"), F.create_map().cast("map<string,string>").alias("params"),
    )


def merged(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return dealt_anew(out)


def broken(issues: DataFrame) -> DataFrame:
    """Issues that break the contract: unknown enums or missing fields."""
    required = F.array(*[F.col(c).isNull() for c in ("id", "rule", "layer", "skill", "severity", "loc_kind", "standard_source", "suppressible")])
    return issues.filter(F.exists(required, lambda x: x) | ~F.col("severity").isin(*SEVERITIES) | ~F.col("layer").isin(*LAYERS) | ~F.col("standard_source").isin(*SOURCES))


def suppressed(issues: DataFrame, ignore: DataFrame) -> DataFrame:
    """issues with the flag suppressed: suppressible ones whose id or rule is on the list. None is dropped.

    The list is a person's file; it joins by hash, and Spark broadcasts it when it is small.
    """
    ids = ignore.filter("kind = 'id'").select(F.col("value").alias("id")).distinct().withColumn("by_id", F.lit(True))
    rules = ignore.filter("kind = 'rule'").select(F.col("value").alias("rule")).distinct().withColumn("by_rule", F.lit(True))
    hit = F.coalesce(F.col("by_id"), F.col("by_rule"), F.lit(False))
    return issues.join(ids, "id", "left").join(rules, "rule", "left").withColumn("suppressed", F.col("suppressible") & hit).drop("by_id", "by_rule")


def rank(severity: Column | str = "severity") -> Column:
    s = T.col(severity)
    return F.when(s == "error", 0).when(s == "warn", 1).when(s == "info", 2).otherwise(3)


def in_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy(rank(), F.coalesce("loc_index", F.lit(0)), "rule", "issue_key")


def tallies(issues: DataFrame) -> DataFrame:
    """Counts by severity, by skill, by source and in all, in one pass: (dimension, value, n)."""
    sets = issues.groupingSets([["severity"], ["skill"], ["standard_source"], []], "severity", "skill", "standard_source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "skill").when(F.col("g") == 6, "source").otherwise("all")
    return sets.select(name.alias("dimension"), F.coalesce("severity", "skill", "standard_source", F.lit("")).alias("value"), "n")


def by_rule(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule")


def markdown(issues: DataFrame) -> DataFrame:
    """A report for each document, as one Markdown text. A report is read by a person, so a document's issues fit a row."""
    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("rule"), F.lit(" @"), F.coalesce(F.col("loc_index").cast("string"), F.lit("document")), F.lit(": "), F.coalesce("actual", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct(rank().alias("r"), F.coalesce("loc_index", F.lit(0)).alias("i"), line.alias("line"))))
    return issues.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.concat(F.lit("# "), F.size("rows").cast("string"), F.lit(" findings\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("report"))
