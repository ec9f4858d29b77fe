"""The registered queries, the SQL that another engine checks each by, and what both share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from vellum.functions import text as T
from vellum.operators import standards as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STD = S.defaults()


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str | Column, name: str | None = None) -> Column:
    return T.col(c).cast("long").alias(name or c)


def brief(issues: DataFrame) -> DataFrame:
    return issues.select(long("doc_id"), "rule", "sub_check", "severity", long("loc_index"), "actual")


def found(sql_from: str, rule: str, sub: str, severity: str, index: str, actual: str) -> str:
    """SELECT of issues in the columns of brief()."""
    return f"SELECT doc_id::BIGINT AS doc_id, '{rule}' AS rule, '{sub}' AS sub_check, {severity if severity.startswith('CASE') else repr(severity)} AS severity, ({index})::BIGINT AS loc_index, ({actual})::VARCHAR AS actual {sql_from}"


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)
