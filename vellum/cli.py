"""Command line: audit word-processor files, then repair them by the plans that a person edited, list versions and go back.

    python -m vellum.cli audit DOCS WORK [--spec FILE] [--config FILE] [--ignore FILE] [--proposal FILE_OR_FOLDER] [--anchors FILE]
        [--terms FILE] [--only RULES_OR_LAYERS] [--optional]
    python -m vellum.cli apply WORK [--dry-run] [--lenient] [--stamp STAMP]
    python -m vellum.cli list WORK
    python -m vellum.cli rollback WORK STAMP

`audit` leaves in WORK the findings (audit/*.json) and plans to edit (plans/*.yaml). `apply` repairs the files and writes those
that changed to documents/; the files that were audited stay as they are. It ends with 2 if a plan was refused or items were
stale; nothing of such a document is changed. Every command but `list` makes one version of all tables in WORK/versions.
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import repair as R
from vellum.operators.durable import durable
from vellum.plans.audit import audit
from vellum.sinks import docx as X
from vellum.sinks import patch
from vellum.sinks import reports as P
from vellum.sinks.versions import Versions
from vellum.sources import docx as D
from vellum.sources import tables as B

NAME = r"[^/]*$"


def named(df: DataFrame, content: str, suffix: str) -> DataFrame:
    return df.select(F.format_string(f"%d{suffix}", "doc_id").alias("name"), F.encode(content, "utf-8").alias("content"))


def parts(relations: dict[str, DataFrame]) -> DataFrame:
    """What edits work on of parsed files: with the lines of headers by section, where there is a header."""
    headers = relations["sections"].filter("header_has_rule is not null").select("doc_id", F.col("section_index").alias("para_index"), F.col("header_border").alias("border"))
    return R.parts_of(relations["runs"], relations["blocks"].filter("kind = 'p'"), relations["bookmarks"], headers)


def proposals(spark: SparkSession, at: str, documents: DataFrame) -> DataFrame:
    """(doc_id, proposal): the text of a proposal for every document, or of each from a folder for the document of its file name."""
    relations = D.read_docx(spark, at)
    texts = D.proposal_text(relations["blocks"], relations["cells"]).withColumnRenamed("text", "proposal")
    names = relations["blocks"].select("doc_id", F.regexp_extract("path", NAME, 0).alias("file")).distinct()
    texts = texts.join(names, "doc_id").select("file", "proposal")
    if at.lower().endswith(".docx"):
        return documents.select("doc_id").join(F.broadcast(texts.select("proposal").limit(1)))
    return documents.select("doc_id", F.regexp_extract("path", NAME, 0).alias("file")).join(texts, "file").select("doc_id", "proposal")


def run_audit(spark: SparkSession, docs: str, work: str, spec: str | None = None, config: str | None = None, ignore: str | None = None, optional: bool = False, proposal: str | None = None, anchors: str | None = None, terms: str | None = None, only: tuple[str, ...] = ()) -> list[str]:
    relations = D.read_docx(spark, docs)
    documents = durable(relations["blocks"].select("doc_id", "path", "sha256").distinct())
    tables = {k: v for k, v in relations.items() if k != "errors"}
    if proposal:
        tables["proposals"] = durable(proposals(spark, proposal, documents))
    if anchors:
        tables["anchors"] = B.read_anchors(spark, anchors)
    if terms:
        tables["terms"] = B.read_terms(spark, terms)
    listed = B.read_ignore(spark, ignore) if ignore else None
    issues, notes = audit(tables, B.load_spec(spark, spec), B.load_spec(spark, config), only=only, ignore=listed, optional=optional or bool(terms), settle=durable)
    versions = Versions(spark, f"{work}/versions")
    version = versions.commit(versions.read(), {"issues": issues, "state": parts(relations), "documents": documents.withColumn("content", F.lit(None).cast("binary")), "errors": relations["errors"]}, operation="audit")
    issues = versions.table(version, "issues")
    heads = R.state_hash(versions.table(version, "state"))
    X.write_files(named(P.audit_json(issues.drop("suppressed"), documents), "json", ".json"), f"{work}/audit")
    X.write_files(named(P.plan_yaml(R.plan(issues.filter("not suppressed")), heads), "yaml", ".yaml"), f"{work}/plans")
    return notes + [f"not read: {r['path']} ({r['message']})" for r in versions.table(version, "errors").orderBy("path").limit(100).collect()]


def contents(spark: SparkSession, documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, path, content) of the documents wanted: as they were last repaired, else the files that were audited."""
    of = documents.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    folders = [r[0] for r in of.filter("content is null").select(F.regexp_replace("path", "/" + NAME, "")).distinct().collect()]
    own = of.filter("content is not null").select("doc_id", "path", "content")
    if not folders:
        return own
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folders).select("path", "content")
    return own.unionByName(of.filter("content is null").select("doc_id", "path").join(files, "path").select("doc_id", "path", "content"))


def run_apply(spark: SparkSession, work: str, stamp: str, dry_run: bool = False, lenient: bool = False) -> tuple[DataFrame, bool]:
    """(journal, whether all plans could run)."""
    versions = Versions(spark, f"{work}/versions")
    last = versions.read()
    toggles = durable(P.read_plans(spark, f"{work}/plans/*.yaml"))
    items = durable(P.items_of(toggles, versions.table(last, "issues")))
    documents, made = versions.table(last, "documents"), {}

    def edit(of: DataFrame, todo: DataFrame) -> DataFrame:
        made["files"] = files = durable(patch.repaired(contents(spark, documents, todo), todo))
        each = files.select("doc_id", F.explode("journal").alias("j")).select("doc_id", "j.*")
        journal = each.select(*[F.col(c) if c in each.columns else F.lit("journal" if c == "kind" else None).cast(t).alias(c) for c, t in R._FIELDS])
        return parts(D.relations_of(files)).unionByName(journal)

    done = R.apply(versions.table(last, "state"), items.filter("not stale").drop("stale"), toggles.select("doc_id", "sha256").distinct(), stamp, versions.table(last, "ledger"), versions.table(last, "snapshots"), dry_run, not lenient, edit=edit)
    journal = durable(done.journal)
    whole = done.refused.filter(~F.col("reason").startswith("warn")).isEmpty() and items.filter("stale and enabled").isEmpty()
    if not dry_run:
        changed = durable(made["files"].join(journal.filter("status = 'applied'").select("doc_id").distinct(), "doc_id", "left_semi"))
        now = documents.join(changed, "doc_id", "left_anti").unionByName(changed.select("doc_id", "path", "sha256", "content"))
        old = documents.join(changed, "doc_id", "left_semi").withColumn("stamp", F.lit(stamp))
        kept = versions.table(last, "old_documents")
        tables = {"state": done.parts, "ledger": done.ledger, "snapshots": done.snapshots, "documents": now, "old_documents": old if kept is None else kept.filter(F.col("stamp") != stamp).unionByName(old), "journal": journal}
        versions.commit(last, tables, operation="apply", stamp=stamp, documents=str(changed.count()))
        X.write_files(changed.select(file_name(), "content"), f"{work}/documents")
    return journal, whole


def file_name():
    """A repaired file's name: that of the file that was audited, with the document's number as names may repeat."""
    return F.concat(F.regexp_replace(F.regexp_extract("path", NAME, 0), r"\.docx$", ""), F.lit("."), F.format_string("%016x", "doc_id"), F.lit(".docx")).alias("name")


def run_rollback(spark: SparkSession, work: str, stamp: str) -> int:
    """Puts documents back to what they were before a stamp, and keeps what they were until now; says how many."""
    versions = Versions(spark, f"{work}/versions")
    last = versions.read()
    snapshots, state, documents = (versions.table(last, n) for n in ("snapshots", "state", "documents"))
    if snapshots is None:
        return 0
    ids = durable(snapshots.filter(F.col("stamp") == stamp).select("doc_id").distinct())
    version, kept = R.rollback(snapshots, state.join(ids, "doc_id", "left_semi"), stamp)
    new = state.join(ids, "doc_id", "left_anti").unionByName(version.drop("stamp", "dup_no"))
    old = durable(versions.table(last, "old_documents").filter(F.col("stamp") == stamp).drop("stamp").join(ids, "doc_id", "left_semi"))
    n = ids.count()
    versions.commit(last, {"state": new, "snapshots": kept, "documents": documents.join(old, "doc_id", "left_anti").unionByName(old)}, operation="rollback", stamp=stamp, documents=str(n))
    X.write_files(contents(spark, old, old).select(file_name(), "content"), f"{work}/documents")
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("audit")
    one.add_argument("docs")
    one.add_argument("work")
    for name in ("--spec", "--config", "--ignore", "--proposal", "--anchors", "--terms"):
        one.add_argument(name)
    one.add_argument("--only", default="", help="rules or layers, parted by commas")
    one.add_argument("--optional", action="store_true")
    two = commands.add_parser("apply")
    two.add_argument("work")
    two.add_argument("--dry-run", action="store_true")
    two.add_argument("--lenient", action="store_true")
    two.add_argument("--stamp", default=datetime.datetime.now().strftime("%Y%m%dT%H%M%S"))
    commands.add_parser("list").add_argument("work")
    back = commands.add_parser("rollback")
    back.add_argument("work")
    back.add_argument("stamp")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("vellum").getOrCreate()
    if a.command == "audit":
        only = tuple(x.strip() for x in a.only.split(",") if x.strip())
        print("\n".join(run_audit(spark, a.docs, a.work, a.spec, a.config, a.ignore, a.optional, a.proposal, a.anchors, a.terms, only)))
        return 0
    if a.command == "apply":
        journal, whole = run_apply(spark, a.work, a.stamp, a.dry_run, a.lenient)
        for r in journal.groupBy("status").count().orderBy("status").collect():
            print(f"{r['count']} {r['status']}")
        return 0 if whole else 2
    if a.command == "list":
        for v in Versions(spark, f"{a.work}/versions").log():
            print(" ".join([str(v.number), v.about["operation"], *(v.about[k] for k in ("stamp", "documents") if k in v.about)]))
        return 0
    print(run_rollback(spark, a.work, a.stamp))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
