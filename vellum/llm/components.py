"""Connected components of a graph of links, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours link to its smallest one. Small star: its smaller ones do, and itself.

    Minima come from partial aggregates, and the join back has one row a node on one side, so a node of very many
    links is no single task's work.
    """
    if large:
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return arcs.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b")
    return linked.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node of its component.

    Ends when a round changes no link; a round's links are kept in the shared folder, only until the next has its own. No links
    give no rows.
    """
    scratch, k = Scratch(links.sparkSession), 0
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "0")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    before = mark(edges)
    while before[0]:
        edges, k = scratch.keep(_stars(_stars(edges, True), False), f"{k + 1}"), k + 1
        scratch.drop(f"{k - 1}")
        if (now := mark(edges)) == before:
            break
        before = now
    # by now every link leads from a root to a node
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
