"""Audit and plan files: what an audit found, as JSON, and a plan that a person switches on and off, as YAML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.durable import dealt_anew
from vellum.operators.issues import COLUMNS, rank

ISSUE = "struct<issue_key:string,id:string,rule:string,sub_check:string,layer:string,skill:string,severity:string,loc_kind:string,loc_index:int,excerpt:string,expected:string,actual:string,standard_source:string,suppressible:boolean,action:string,params:map<string,string>>"
PLAN = "doc_id long, sha256 string, issue_key string, enabled boolean"


def audit_json(issues: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): one object for each document, its issues by severity and place; also for documents(doc_id) without any."""
    place = F.struct(rank().alias("r"), F.coalesce("loc_index", F.lit(0)).alias("i"), "issue_key")
    in_order = F.transform(F.sort_array(F.collect_list(place)), lambda x: x["issue_key"])
    keyed = F.map_from_entries(F.collect_list(F.struct(F.col("issue_key").alias("key"), F.struct(*[c for c in COLUMNS if c != "doc_id"]).alias("issue"))))
    known = issues.groupBy("doc_id").agg(in_order.alias("keys"), keyed.alias("of")).select("doc_id", F.to_json(F.struct(F.col("doc_id"), F.transform("keys", lambda k: F.element_at("of", k)).alias("issues"))).alias("json"))
    if documents is None:
        return known
    none = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"issues":[]}'))
    return documents.select("doc_id").distinct().join(known, "doc_id", "left").select("doc_id", F.coalesce("json", none).alias("json"))


def issues_of_json(audits: DataFrame) -> DataFrame:
    """The issues of audits(json), as audit_json() writes them."""
    parsed = audits.select(F.from_json("json", f"struct<doc_id:long,issues:array<{ISSUE}>>").alias("a"))
    return parsed.select("a.doc_id", F.explode("a.issues").alias("i")).select("doc_id", "i.*")


def read_audits(spark: SparkSession, path: str) -> DataFrame:
    """The issues of audit files, one JSON object a file, however it is laid out."""
    return issues_of_json(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def plan_yaml(items: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, yaml): a plan of items(doc_id, issue_key, rule, action, loc_index, enabled) for a person to switch on and off.

    Parameters aren't written: they are taken from the audit again, so that nothing an editor does to the file can change them.
    headers(doc_id, sha256) say which state of a document the plan is for.
    """
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("v")))  # noqa: E731  a JSON string is a YAML string
    text = lambda c: F.substring(quoted(c), F.lit(6), F.length(quoted(c)) - 6)
    entry = F.concat(
        F.lit("\n  # "), F.coalesce("rule", F.lit("")), F.lit(" @"), F.coalesce(F.col("loc_index").cast("string"), F.lit("document")), F.lit("\n  - issue_key: "), text("issue_key"),
        F.lit("\n    action: "), text("action"), F.lit("\n    enabled: "), F.col("enabled").cast("string"), F.lit("\n"),
    )
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("enabled")).alias("off"), "rule", "issue_key", entry.alias("entry")))).alias("rows"))
    all_ = headers.select("doc_id", "sha256").join(rows, "doc_id", "left")
    body = F.when(F.size("rows") > 0, F.concat(F.lit("items:\n"), F.array_join(F.transform("rows", lambda r: r["entry"]), ""))).otherwise(F.lit("items: []\n"))
    head = F.concat(F.lit("# Switch items on or off with enabled; delete those that you don't want to see.\nversion: 1\ndoc_id: "), F.col("doc_id").cast("string"), F.lit("\nsha256: "), F.coalesce(F.concat(F.lit('"'), "sha256", F.lit('"')), F.lit("null")), F.lit("\n"))
    return all_.select("doc_id", F.concat(head, body).alias("yaml"))


def toggles_of_yaml(plans: DataFrame) -> DataFrame:
    """PLAN rows of plans(yaml): what a person left of each plan, and switched. A file that isn't a plan gives no rows.

    An item whose `enabled` is missing or no truth value is off. A plan of a document without items gives one row without a key.
    """
    names = [c.split()[0] for c in PLAN.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for text in batch["yaml"]:
                try:
                    plan = yaml.safe_load(text or "")
                except yaml.YAMLError:
                    continue
                if not isinstance(plan, dict) or not isinstance(plan.get("doc_id"), int):
                    continue
                items = [i for i in plan.get("items") or [] if isinstance(i, dict) and i.get("issue_key")] if isinstance(plan.get("items"), list) else []
                sha = str(plan["sha256"]) if plan.get("sha256") else None
                rows += [(plan["doc_id"], sha, str(i["issue_key"]), i.get("enabled") is True) for i in items] or [(plan["doc_id"], sha, None, False)]
            yield pd.DataFrame(rows, columns=names)

    return plans.select("yaml").mapInPandas(parse, PLAN)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    return toggles_of_yaml(spark.read.text(path, wholetext=True).withColumnRenamed("value", "yaml"))


def items_of(toggles: DataFrame, issues: DataFrame) -> DataFrame:
    """A plan's items with what the audit says of them: (doc_id, issue_key, action, params, loc_index, enabled, stale)."""
    known = issues.select("doc_id", "issue_key", "rule", "action", "params", "loc_index").dropDuplicates(["doc_id", "issue_key"]).withColumn("known", F.lit(True))
    both = toggles.filter("issue_key is not null").select("doc_id", "issue_key", "enabled").join(known, ["doc_id", "issue_key"], "left")
    return both.withColumn("stale", F.col("known").isNull()).drop("known")


def evidence(cards: DataFrame) -> DataFrame:
    """(doc_id, report): the cards of a document as one Markdown text, for a person to judge."""
    show = lambda c: F.coalesce(F.concat(F.lit("> "), F.col(c)), F.lit("> -"))
    card = F.concat(F.lit("## "), "anchor", F.lit(" ("), "verdict", F.lit(")\n"), "question", F.lit("\n"), show("proposal_excerpt"), F.lit("\n"), show("thesis_excerpt"), F.lit("\n"), F.coalesce(F.concat(F.lit("@"), F.col("para_index").cast("string"), F.lit(" "), "thesis_heading", F.lit("\n")), F.lit("")))
    return dealt_anew(cards).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("anchor", card.alias("card")))).alias("cards")).select("doc_id", F.array_join(F.transform("cards", lambda c: c["card"]), "\n").alias("report"))
