"""From raw documents to packed sequences: language, lines, near-duplicates, benchmark passages, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. A stage but the last returns the columns of
documents. run() applies all of them to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, langid, line_dup, near_dup, pack
from vellum.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts and those without a letter go. Repeated rows stay or go together."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that resemble an earlier one; those go that lose lines and have no word left.

    Null, empty and wordless texts stay, as they lose no line. Repeated rows lose the same lines; an empty table gives no rows.
    """
    rest = line_dup.without_lines(docs, line_dup.later_lines(docs), "__removed")
    return rest.filter((F.size("__removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("__removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, by its own text; texts without words, and null ones, resemble none and stay."""
    return near_dup.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Null and empty texts stay; each row is judged by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. A null or empty text is its end token; an empty table gives no pieces."""
    return pack.digest(pack.pack(docs))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("packing", packing)]

#: No SQL expresses tokenization and packing; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
