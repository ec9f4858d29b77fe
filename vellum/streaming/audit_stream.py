"""Audits of documents as they arrive. Rules look at one document at a time, so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.plans.audit import audit
from vellum.sources.tables import blocks_of_text


def audit_stream(docs: DataFrame, out: str, checkpoint: str, only: tuple[str, ...] = ("L3",), profile: str = "latin", **trigger) -> StreamingQuery:
    """Appends the issues of each batch of the streaming docs(doc_id, text) to Parquet at `out`, once each.

    A batch writes to its own folder, which a repeated batch overwrites, so that a lost driver or executor doubles nothing.
    """
    def batch(df: DataFrame, k: int) -> None:
        issues, _ = audit({"blocks": blocks_of_text(df)}, only=only, profile=profile)
        issues.write.mode("overwrite").parquet(f"{out}/batch={k}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def documents_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
