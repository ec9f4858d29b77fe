"""Audits that keep up with documents that change: what is unchanged isn't audited again, what changed retracts its findings.

State is a log, as each batch writes folders of its own: `seen` has the hash and version of each document that a batch took in
and the batch that audited this text, `issues` what a batch found in those that it audited.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import issues as I
from vellum.operators.durable import durable
from vellum.plans.audit import audit
from vellum.sources.tables import blocks_of_text, first_there

SEEN = "doc_id long, version long, sha256 string, deleted boolean, audited long, batch long"


def seen(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """What each batch took in, of all batches or those before one."""
    if first_there(spark, [f"{folder}/seen"]) is None:
        return spark.createDataFrame([], SEEN)
    out = spark.read.schema(SEEN).parquet(f"{folder}/seen")
    return out if before is None else out.filter(F.col("batch") < before)


def holding(rows: DataFrame) -> DataFrame:
    """The newest version of each document among rows of SEEN; of equal versions that of the first batch."""
    return rows.groupBy("doc_id").agg(F.max(F.struct("version", (-F.col("batch")).alias("first"), "sha256", "deleted", "audited")).alias("m")).select("doc_id", "m.*").drop("first")


def relations_of_text(docs: DataFrame) -> dict[str, DataFrame]:
    return {"blocks": blocks_of_text(docs)}


def absorb(docs: DataFrame, batch: int, folder: str, relations: Callable[[DataFrame], dict[str, DataFrame]] = relations_of_text, **rules) -> None:
    """Takes in a batch of docs(doc_id, version, text[, deleted]): audits the documents that are new or changed.

    Of several versions of a document the highest counts, one that isn't above the version known is ignored, and one with the
    same text isn't audited again: its findings are those of the batch that audited it. A deleted document has none. A batch
    that is repeated overwrites its own folders and looks only at those before it, so that it ends the same.
    """
    spark = docs.sparkSession
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in docs.columns else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("long").alias("version"), "text", gone.alias("deleted"))
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("version", "deleted", "text")).alias("m")).select("doc_id", "m.*").withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = holding(seen(spark, folder, batch)).select("doc_id", F.col("version").alias("old"), F.col("sha256").alias("old_sha"), F.col("deleted").alias("old_deleted"), F.col("audited").alias("before"))
    both = newest.join(known, "doc_id", "left").filter("old is null or version > old")
    same = F.coalesce((F.col("sha256") == F.col("old_sha")) & (F.col("deleted") == F.col("old_deleted")), F.lit(False))
    taken = durable(both.withColumn("audited", F.when(same, F.col("before")).otherwise(batch)))
    found, _ = audit(relations(taken.filter((F.col("audited") == batch) & ~F.col("deleted")).select("doc_id", "text")), **rules)
    found.drop("suppressed").write.mode("overwrite").parquet(f"{folder}/issues/batch={batch}")
    taken.select("doc_id", "version", "sha256", "deleted", "audited").write.mode("overwrite").parquet(f"{folder}/seen/batch={batch}")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The findings that hold: of each document, those of the batch that audited its newest text."""
    if first_there(spark, [f"{folder}/issues"]) is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'map<string,string>' if c == 'params' else 'boolean' if c == 'suppressible' else 'int' if c == 'loc_index' else 'long' if c == 'doc_id' else 'string'}" for c in I.COLUMNS))
    last = holding(seen(spark, folder)).filter("not deleted").select("doc_id", F.col("audited").alias("batch"))
    return spark.read.parquet(f"{folder}/issues").join(last, ["doc_id", "batch"], "left_semi").select(*I.COLUMNS)


def incremental_stream(docs: DataFrame, folder: str, checkpoint: str, relations: Callable[[DataFrame], dict[str, DataFrame]] = relations_of_text, trigger: dict | None = None, **rules) -> StreamingQuery:
    """Takes in the batches of streaming docs(doc_id, version, text[, deleted]), each once."""
    def batch(df: DataFrame, k: int) -> None:
        absorb(df, k, folder, relations, **rules)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
