"""Styles as a graph: inherited values, styles that nothing needs, and a specification against what is there."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.durable import dealt_anew

INHERITED = ("size_pt", "font_ea", "font_ascii", "bold", "align", "space_before_pt", "space_after_pt", "line_spacing", "first_line_indent_chars")


def by_document(rows: DataFrame, columns: str, step) -> DataFrame:
    """step(list of a document's rows) -> rows of `columns`, document by document.

    A document's styles are few, however many documents there are: one shuffle brings them together, and a task holds one
    document at a time.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, at = [], [], None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and row.doc_id != at:
                    out += step(held)
                    held = []
                at = row.doc_id
                held.append(row)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if held:
            out += step(held)
        yield pd.DataFrame(out, columns=names, dtype=object)

    return dealt_anew(rows).sortWithinPartitions("doc_id").mapInPandas(run, columns)


def known(value) -> bool:
    return value is not None and value == value


def inherited(styles: DataFrame, fields: Iterable[str] = ("size_pt", "font_ea")) -> DataFrame:
    """(doc_id, style_id, fields): the first value of each field up the based_on chain, however long; a cycle ends where it began.

    styles(doc_id, style_id, based_on, fields). Each style is resolved once, from what its base has become.
    """
    fields = list(fields)
    types = dict(styles.dtypes)

    def resolve(rows: list) -> list[tuple]:
        of = {r.style_id: r for r in rows}
        out = []
        for row in rows:
            values = {f: None for f in fields}
            seen, at = set(), row
            while at is not None and at.style_id not in seen and any(v is None for v in values.values()):
                seen.add(at.style_id)
                for f in fields:
                    if values[f] is None and known(v := getattr(at, f)):
                        values[f] = v
                at = of.get(at.based_on) if known(at.based_on) else None
            out.append((row.doc_id, row.style_id, *values.values()))
        return out

    columns = ", ".join(f"{c} {types[c]}" for c in ("doc_id", "style_id", *fields))
    return by_document(styles.select("doc_id", "style_id", "based_on", *fields), columns, resolve)


def reachable(styles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, style_id, needed): whether a style is wanted, the default, or one that such a style is based on, linked to or followed by.

    Each style is visited once, so mutual links cost nothing. The column `next` may be absent.
    """
    follow = [c for c in ("based_on", "link", "next") if c in styles.columns]
    marked = styles.join(wanted.select("doc_id", "style_id").distinct().withColumn("wanted", F.lit(True)), ["doc_id", "style_id"], "left")

    def visit(rows: list) -> list[tuple]:
        of = {r.style_id: r for r in rows}
        seen: set = set()
        waiting = [r.style_id for r in rows if r.wanted is True or r.is_default is True]
        while waiting:
            at = waiting.pop()
            if at in seen or at not in of:
                continue
            seen.add(at)
            waiting += [v for c in follow if known(v := getattr(of[at], c))]
        return [(r.doc_id, r.style_id, r.style_id in seen) for r in rows]

    t = dict(styles.dtypes)
    return by_document(marked.select("doc_id", "style_id", "is_default", "wanted", *follow), f"doc_id {t['doc_id']}, style_id {t['style_id']}, needed boolean", visit)


def needed(styles: DataFrame, wanted: DataFrame) -> DataFrame:
    return reachable(styles, wanted).filter("needed").select("doc_id", "style_id")


def dead(styles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, style_id) of styles that nothing needs."""
    return reachable(styles, wanted).filter("not needed").select("doc_id", "style_id")


def pruned(styles: DataFrame, wanted: DataFrame, numbering: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(styles that stay, with `hidden`; numbering that stays): the clean-up of a template in one pass.

    Styles that nothing needs go, and with them numbering(doc_id, num_id, abstract_id) that only they used; of those that
    stay, all but the wanted ones and the default are hidden. styles may name its numbering in num_id.
    """
    kept = styles.join(reachable(styles, wanted).filter("needed").select("doc_id", "style_id"), ["doc_id", "style_id"], "left_semi")
    shown = wanted.select("doc_id", "style_id").distinct().withColumn("shown", F.lit(True))
    kept = kept.join(shown, ["doc_id", "style_id"], "left").withColumn("hidden", ~(F.coalesce("shown", F.lit(False)) | F.coalesce("is_default", F.lit(False)))).drop("shown")
    if numbering is None:
        return kept, styles.sparkSession.createDataFrame([], "doc_id long, num_id string, abstract_id string")
    used = kept.filter("num_id is not null").select("doc_id", "num_id").distinct() if "num_id" in kept.columns else kept.select("doc_id", F.lit(None).cast("string").alias("num_id")).limit(0)
    return kept, numbering.join(used, ["doc_id", "num_id"], "left_semi")


def removable(styles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, before, after): how many styles a document has, and how many a clean-up leaves."""
    return reachable(styles, wanted).groupBy("doc_id").agg(F.count(F.lit(1)).alias("before"), F.count_if("needed").alias("after"))


def resolved_names(names: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, name, style_id): a wanted name's style, by the exact name, else by the name with a number behind it."""
    exact = names.join(styles.select("doc_id", "name", "style_id"), ["doc_id", "name"], "left")
    near = styles.select("doc_id", F.regexp_replace("name", r"\d+$", "").alias("name"), F.col("name").alias("full"), F.col("style_id").alias("near_id")).filter("name <> full")
    best = near.groupBy("doc_id", "name").agg(F.min_by("near_id", "full").alias("near_id"))
    return exact.join(best, ["doc_id", "name"], "left").select("doc_id", "name", F.coalesce("style_id", "near_id").alias("style_id"))


TOLERANCES = {"size_pt": 0.01, "space_before_pt": 0.06, "space_after_pt": 0.06, "line_spacing": 0.02, "first_line_indent_chars": 0.06}


def unpivoted(styles: DataFrame, fields: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return styles.select("doc_id", "name", pairs.alias("f")).select("doc_id", "name", "f.field", "f.value")


def differences(spec: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, name, field, want, have) where a specified value isn't there, numbers within their field's tolerance."""
    want = unpivoted(spec, fields).filter("value is not null").withColumnRenamed("value", "want")
    have = unpivoted(actual, fields).withColumnRenamed("value", "have")
    tolerance = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOLERANCES.items() for x in kv]), F.col("field")), F.lit(0.0))
    a, b = F.col("want").try_cast("double"), F.col("have").try_cast("double")
    same = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance).otherwise(F.col("want").eqNullSafe(F.col("have")))
    return want.join(have, ["doc_id", "name", "field"], "left").filter(~same)


def usage(styles: DataFrame, paras: DataFrame, reserved: list[str]) -> DataFrame:
    """(doc_id, name, state): referenced by a paragraph, reserved, or unused."""
    used = paras.select("doc_id", F.col("style_name").alias("name")).distinct().withColumn("used", F.lit(True))
    state = F.when(F.col("used"), "referenced").when(F.col("name").isin(*reserved), "reserved").otherwise("unused")
    return styles.select("doc_id", "name").distinct().join(used, ["doc_id", "name"], "left").select("doc_id", "name", state.alias("state"))
