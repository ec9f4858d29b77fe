"""Standards: what rules compare against, from template, configuration or default, with the source of each value."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Key, default (JSON), and path in a template's conventions or a configuration.
STANDARDS = (
    ("cite_style", '"superscript-bracket"', "citation.style"),
    ("cite_position", '"before-punct"', "citation.position"),
    ("cite_allow_explicit_size", "false", "citation.superscript_size_ratio"),
    ("bib_system", '"sequence"', "bibliography.system"),
    ("bib_standard", '"GB/T 7714"', "bibliography.standard"),
    ("page_size", '"A4"', "page.size"),
    ("page_margins_cm", None, "page.margins_cm"),
    ("page_numbering_scheme", None, "page_numbering.scheme"),
    ("header_content", None, "header.content"),
    ("header_rule", None, "header.rule"),
    ("body_font_cn", None, "styles.body.font_cn"),
    ("body_size_pt", None, "styles.body.size_pt"),
    ("body_line_spacing", None, "styles.body.line_spacing"),
    ("quote_style", '"straight"', "text.quote_style"),
    ("dash_per_1000_max", "6.0", "text.dash_per_1000_max"),
    ("heading_max_chars", "25", "text.heading_max_chars"),
    ("max_h3_per_h2", "3", "text.max_h3_per_h2"),
    ("abstract_cn_max_chars", "1000", "abstract.cn.max_chars"),
    ("abstract_en_max_words", "500", "abstract.en.max_words"),
    ("caption_figure_position", '"below"', "caption.figure.position"),
    ("caption_table_position", '"above"', "caption.table.position"),
    ("body_min_chars", None, "length.body_min_chars"),
)


def resolve(specs: DataFrame) -> DataFrame:
    """(doc_id, key, value, source) for every standard of each row of specs(doc_id, template, config), both JSON texts.

    A configuration wins over a template, and that over the default. Empty text, lists and objects count as unset; false
    and 0 don't. A size ratio, wherever it is given, means that explicit sizes are allowed. source is null for what no one set.
    """
    def at(column: str, path: str):
        v = F.get_json_object(column, f"$.{path}")
        if path.endswith("size_ratio"):
            return F.when(v.isNotNull(), F.lit("true"))
        return F.when(F.trim(v).isin("", "[]", "{}", "null"), None).otherwise(v)

    rows = []
    for key, default, path in STANDARDS:
        text = json.loads(default) if default and default.startswith('"') else default
        config, template = at("config", path), at("template", path)
        value = F.coalesce(config, template, F.lit(text))
        source = F.when(config.isNotNull(), "config").when(template.isNotNull(), "template").when(F.lit(text).isNotNull(), "default")
        rows.append(F.struct(F.lit(key).alias("key"), value.alias("value"), source.alias("source")))
    return specs.select("doc_id", F.explode(F.array(*rows)).alias("s")).select("doc_id", "s.*")


def notes(standards: DataFrame) -> DataFrame:
    """(doc_id, note): what isn't judged, as nothing sets it."""
    unset = standards.filter("value is null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))
    return unset.select("doc_id", F.concat(F.lit("not judged: "), "keys").alias("note"))


def described(standards: DataFrame) -> DataFrame:
    """(doc_id, line): key=value (source) of all that is set, on one line."""
    part = F.concat(F.col("key"), F.lit("="), F.col("value"), F.lit(" ("), F.col("source"), F.lit(")"))
    return standards.filter("value is not null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("line"))


def defaults() -> dict:
    return {key: json.loads(default) if default is not None else None for key, default, _ in STANDARDS}


def source_of(std: dict, *keys: str) -> str:
    """Which tier set a standard, of several the first that isn't the default; what for_job() didn't make is the default."""
    found = [std.get("sources", {}).get(k) or "default" for k in keys]
    return next((x for x in found if x != "default"), "default")


def for_job(template: str | None = None, config: str | None = None) -> dict:
    """The standards of one job as a dict, from the JSON texts of its template and configuration; `sources` has each one's tier."""
    def dig(text: str | None, path: str):
        node = json.loads(text) if text else None
        for part in path.split("."):
            node = node.get(part) if isinstance(node, dict) else None
        return None if node in ("", [], {}) and node is not False and node != 0 else node

    out: dict = {"sources": {}}
    for key, default, path in STANDARDS:
        found, tier = next(((v, tier) for v, tier in ((dig(config, path), "config"), (dig(template, path), "template")) if v is not None), (None, "default"))
        out["sources"][key] = tier if found is not None or default is not None else None
        if path.endswith("size_ratio") and found is not None:
            found = True
        out[key] = found if found is not None else json.loads(default) if default is not None else None
    return out
