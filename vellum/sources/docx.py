"""Word-processor files: one parse of each into relations, by the standard library, on the executors."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.batches import lots
from vellum.operators.durable import scratch_folder

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A link field: the word, then switches with or without an argument in any order; \\l names the place, which may be quoted.
FIELD = re.compile(r'"([^"]*)"|(\S+)')
RELATION = "kind string, path string, sha256 string, row string"

SCHEMAS = {
    "blocks": "ord int, kind string, para_index int, text string, style_id string, style_name string, ends_section boolean, is_marker boolean, has_toc_field boolean, has_toc_anchor boolean, images int, border string",
    "runs": "para_index int, run_ord int, text string, superscript boolean, anchor string, link_kind string, size_pt double, font_ea string, font_ascii string, bold boolean",
    "bookmarks": "para_index int, name string",
    "styles": "style_id string, name string, type string, based_on string, link string, next string, is_default boolean, size_pt double, font_ea string, font_ascii string, bold boolean, align string, space_before_pt double, space_after_pt double, line_spacing double, first_line_indent_chars double, num_id string, outline_level int",
    "numbering": "num_id string, abstract_id string",
    "cells": "ord int, row int, col int, text string",
    "sections": "section_index int, page_fmt string, page_start int, has_pgnumtype boolean, has_page_field boolean, header_text string, first_header_text string, header_has_rule boolean, header_border string, width_cm double, height_cm double, top_cm double, right_cm double, bottom_cm double, left_cm double",
    "errors": "message string",
}


def value(node, path: str, attribute: str = "val"):
    found = node.find(path) if node is not None else None
    return found.get(f"{W}{attribute}") if found is not None else None


def number(text, scale: float = 1.0):
    try:
        return float(text) / scale
    except (TypeError, ValueError):
        return None


def counted(text) -> int | None:
    """A whole number, null for anything else."""
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def on(node, path: str):
    """Whether a switch is on: it is there, and not turned off; null if it isn't there."""
    found = node.find(path) if node is not None else None
    return None if found is None else found.get(f"{W}val") not in ("0", "false", "none", "off")


def linked_place(code: str) -> str | None:
    """The place that a field's code links to; null for other fields."""
    words = [a or b for a, b in FIELD.findall(code)]
    if not words or words[0].upper() != "HYPERLINK":
        return None
    at = next((k for k, w in enumerate(words) if w.lower() == "\\l"), None)
    return words[at + 1] if at is not None and at + 1 < len(words) else None


def spacing_of(p) -> dict:
    """Alignment and spacing of a paragraph's properties."""
    gap, indent = (p.find(f"{W}{t}") if p is not None else None for t in ("spacing", "ind"))
    get = lambda node, a, scale=20: number(node.get(f"{W}{a}"), scale) if node is not None else None
    exact = gap is not None and gap.get(f"{W}lineRule") in ("exact", "atLeast")
    return {"align": value(p, f"{W}jc"), "space_before_pt": get(gap, "before"), "space_after_pt": get(gap, "after"), "line_spacing": get(gap, "line", 20 if exact else 240), "first_line_indent_chars": get(indent, "firstLineChars", 100)}


def placed_runs(paragraph) -> Iterator[tuple]:
    """(run element, anchor, link kind) of the visible runs; field codes hide their instructions.

    Inserted, tagged and wrapped content is looked into, to any depth. Runs in the result of a HYPERLINK field carry its anchor.
    """
    fields: list[dict] = []
    stack = [(iter(paragraph), None)]
    while stack:
        child = next(stack[-1][0], None)
        if child is None:
            stack.pop()
            continue
        tag, anchor = child.tag.removeprefix(W) if isinstance(child.tag, str) else "", stack[-1][1]
        if tag == "hyperlink":
            stack.append((iter(child), child.get(f"{W}anchor") or anchor))
        elif tag in ("ins", "smartTag", "sdt", "sdtContent"):
            stack.append((iter(child), anchor))
        if tag != "r":
            continue
        mark, code = child.find(f"{W}fldChar"), child.find(f"{W}instrText")
        if mark is not None:
            kind = mark.get(f"{W}fldCharType")
            if kind == "begin":
                fields.append({"code": "", "result": False})
            elif kind == "separate" and fields:
                fields[-1]["result"] = True
            elif kind == "end" and fields:
                fields.pop()
        elif code is not None:
            if fields:
                fields[-1]["code"] += code.text or ""
        elif all(f["result"] for f in fields) and run_text(child):
            linked = next((place for f in reversed(fields) if (place := linked_place(f["code"]))), None)
            yield child, anchor or linked, "hyperlink" if anchor else "field" if linked else None


def run_text(run) -> str:
    return "".join("\t" if t.tag == f"{W}tab" else t.text or "" for t in run if t.tag in (f"{W}t", f"{W}tab"))


def run_values(run, anchor: str | None, kind: str | None) -> dict:
    """Text, format and link of a visible run. The complex size and font stand in where the plain ones aren't given."""
    p = run.find(f"{W}rPr")
    size = value(p, f"{W}sz") or value(p, f"{W}szCs")
    return {
        "text": run_text(run), "superscript": value(p, f"{W}vertAlign") == "superscript", "anchor": anchor, "link_kind": kind, "size_pt": number(size, 2),
        "font_ea": value(p, f"{W}rFonts", "eastAsia"), "font_ascii": value(p, f"{W}rFonts", "ascii") or value(p, f"{W}rFonts", "cs"), "bold": on(p, f"{W}b"),
    }


def sections_of(body) -> list:
    """The section properties in order: those that end a paragraph's section, and the body's own."""
    found = []
    for child in body:
        if child.tag == f"{W}sectPr":
            found.append(child)
        elif child.tag == f"{W}p" and (ends := child.find(f"{W}pPr/{W}sectPr")) is not None:
            found.append(ends)
    return found


def relationships(package: zipfile.ZipFile, names: set[str]) -> dict[str, str]:
    """The main part's links: id to target."""
    name = "word/_rels/document.xml.rels"
    return {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(package.read(name))} if name in names else {}


def header_parts(section, links: dict[str, str], kind: str = "header") -> list[str]:
    """Names of a section's header (or footer) parts."""
    ids = [r.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") for r in section.findall(f"{W}{kind}Reference")]
    return [f"word/{links[i]}" for i in ids if re.fullmatch(kind + r"\w*\.xml", links.get(i) or "")]


def style_names(styles) -> dict[str, str | None]:
    """Names of styles by id."""
    return {s.get(f"{W}styleId"): value(s, f"{W}name") for s in styles.iter(f"{W}style")} if styles is not None else {}


def pictures(node) -> int:
    return sum(1 for t in node.iter() if t.tag in (f"{W}drawing", f"{W}pict"))


def cell_text(cell) -> str:
    """A cell's paragraphs, a line each, and behind them those of the tables in it."""
    lines = lambda node: ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in node.findall(f"{W}p")]
    return "\n".join(lines(cell) + [x for table in cell.findall(f"{W}tbl") for inner in table.iter(f"{W}tc") for x in lines(inner)])


def border_of(p) -> str | None:
    """Borders of a paragraph, as repair writes them: edge=kind,size by edges."""
    edges = p.find(f"{W}pPr/{W}pBdr")
    return ";".join(f"{e.tag.removeprefix(W)}={e.get(f'{W}val')},{e.get(f'{W}sz')}" for e in edges) or None if edges is not None else None


def parsed(content: bytes, kinds: set[str] | None = None) -> Iterator[tuple[str, dict]]:
    """(relation, row) for everything that the rules need of one file, or for the relations named."""
    wanted = lambda *of: kinds is None or any(k in kinds for k in of)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        root = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
        body = root("word/document.xml").find(f"{W}body") if wanted("blocks", "runs", "bookmarks", "cells", "sections") else ()
        styles = root("word/styles.xml") if wanted("styles", "blocks") else None
        numbering = root("word/numbering.xml") if wanted("numbering") else None
        links = relationships(z, names) if wanted("sections") else {}
        sections = sections_of(body) if wanted("sections") else []
        parts = {name: root(name) for s in sections for kind in ("header", "footer") for name in header_parts(s, links, kind) if name in names}
    if wanted("styles"):
        yield from (("styles", row) for row in style_rows(styles))
    for n in numbering.iter(f"{W}num") if numbering is not None else ():
        yield "numbering", {"num_id": n.get(f"{W}numId"), "abstract_id": value(n, f"{W}abstractNumId")}
    if wanted("blocks", "runs", "bookmarks", "cells"):
        yield from body_rows(body, style_names(styles), wanted)
    for k, s in enumerate(sections, 1):
        yield "sections", {"section_index": k, **section_values(s, links, parts)}


def style_rows(styles) -> Iterator[dict]:
    for s in styles.iter(f"{W}style") if styles is not None else ():
        p, pp = s.find(f"{W}rPr"), s.find(f"{W}pPr")
        row = {"style_id": s.get(f"{W}styleId"), "name": value(s, f"{W}name"), "type": s.get(f"{W}type"), "based_on": value(s, f"{W}basedOn"), "link": value(s, f"{W}link")}
        look = {"size_pt": number(value(p, f"{W}sz"), 2), "font_ea": value(p, f"{W}rFonts", "eastAsia"), "font_ascii": value(p, f"{W}rFonts", "ascii"), "bold": on(p, f"{W}b")}
        yield row | look | spacing_of(pp) | {"is_default": s.get(f"{W}default") == "1", "next": value(s, f"{W}next"), "num_id": value(pp, f"{W}numPr/{W}numId"), "outline_level": counted(value(pp, f"{W}outlineLvl"))}


def body_rows(body, display: dict[str, str | None], wanted: Callable[..., bool]) -> Iterator[tuple[str, dict]]:
    para = 0
    for k, child in enumerate(body, 1):
        if child.tag == f"{W}tbl":
            if wanted("blocks"):
                cells = ["".join(t.text or "" for t in c.iter(f"{W}t")) for c in child.iter(f"{W}tc")]
                yield "blocks", {"ord": k, "kind": "tbl", "text": "\n".join(cells), "images": pictures(child)}
            for i, tr in enumerate(child.findall(f"{W}tr") if wanted("cells") else ()):
                for j, tc in enumerate(tr.findall(f"{W}tc")):
                    yield "cells", {"ord": k, "row": i, "col": j, "text": cell_text(tc)}
        if child.tag != f"{W}p":
            continue
        para += 1
        runs = [run_values(*r) for r in placed_runs(child)] if wanted("blocks", "runs") else []
        if wanted("blocks"):
            style = value(child.find(f"{W}pPr"), f"{W}pStyle")
            codes = "".join(t.text or "" for t in child.iter(f"{W}instrText"))
            dotted = any(t.get(f"{W}leader") == "dot" for t in child.iter(f"{W}tab"))
            text = "".join(r["text"] for r in runs)
            anchors = [h.get(f"{W}anchor") or "" for h in child.iter(f"{W}hyperlink")]
            yield "blocks", {
                "ord": k, "kind": "p", "para_index": para, "text": text, "style_id": style, "style_name": display.get(style, style), "ends_section": child.find(f"{W}pPr/{W}sectPr") is not None,
                "is_marker": dotted or bool(codes) or "\t" in text, "has_toc_field": bool(re.search(r"\bTOC\b", codes)), "has_toc_anchor": any(a.startswith("_Toc") for a in anchors) or "_Toc" in codes, "images": pictures(child), "border": border_of(child),
            }
        if wanted("runs"):
            yield from (("runs", {"para_index": para, "run_ord": n, **r}) for n, r in enumerate(runs))
        if wanted("bookmarks"):
            yield from (("bookmarks", {"para_index": para, "name": mark.get(f"{W}name")}) for mark in child.iter(f"{W}bookmarkStart"))


def section_values(s, links: dict[str, str], parts: dict) -> dict:
    size, margin, pages = s.find(f"{W}pgSz"), s.find(f"{W}pgMar"), s.find(f"{W}pgNumType")
    get = lambda node, a: number(node.get(f"{W}{a}"), 567) if node is not None else None  # noqa: E731  twentieths of a point
    heads, feet = ([parts[n] for n in header_parts(s, links, kind) if parts.get(n) is not None] for kind in ("header", "footer"))
    lines = ["".join(t.text or "" for t in p.iter(f"{W}t")) for h in heads for p in h.iter(f"{W}p")]
    borders = [value(b, f"{W}bottom") for h in heads for b in h.iter(f"{W}pBdr")]
    edges = next((b for p in (heads[0].iter(f"{W}p") if heads else ()) if (b := border_of(p))), None)
    return {
        "page_fmt": pages.get(f"{W}fmt") if pages is not None else None, "page_start": counted(pages.get(f"{W}start")) if pages is not None else None, "has_pgnumtype": pages is not None,
        "has_page_field": any("PAGE" in (t.text or "") for f in feet for t in f.iter(f"{W}instrText")), "header_text": next((x for x in reversed(lines) if x.strip()), None),
        "first_header_text": next((x for x in lines if x.strip()), None), "header_has_rule": any(b not in (None, "none", "nil") for b in borders) if heads else None, "header_border": edges,
        "width_cm": get(size, "w"), "height_cm": get(size, "h"), **{f"{side}_cm": get(margin, side) for side in ("top", "right", "bottom", "left")},
    }


def rows_of(batches: Iterator[pd.DataFrame], kinds: set[str] | None = None) -> Iterator[pd.DataFrame]:
    import json

    encode = json.JSONEncoder(ensure_ascii=False).encode

    def rows_in(path: str, content: bytes) -> list[tuple]:
        sha = hashlib.sha256(content or b"").hexdigest()
        try:
            return [(kind, path, sha, encode({c: v for c, v in row.items() if v is not None})) for kind, row in parsed(content, kinds) if kinds is None or kind in kinds]
        except Exception as e:  # whatever is odd about a file is a finding, not the job's end
            return [("errors", path, sha, json.dumps({"message": f"{type(e).__name__}: {e}"}))]

    files = ((path, content) for batch in batches for path, content in zip(batch["path"], batch["content"], strict=True))
    yield from lots((row for file in files for row in rows_in(*file)), ["kind", "path", "sha256", "row"])


def unpacked(rows: DataFrame, kind: str) -> DataFrame:
    """One relation of rows_of(), with doc_id (a hash of the path), path and sha256."""
    of = rows.filter(F.col("kind") == kind).select(F.xxhash64("path").alias("doc_id"), "path", "sha256", F.from_json("row", SCHEMAS[kind]).alias("r"))
    return of.select("doc_id", "path", "sha256", "r.*")


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the word-processor files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path", "content")


def relations_of(files: DataFrame, folder: str | None = None, kinds: set[str] | None = None) -> dict[str, DataFrame]:
    """Relations by name (see SCHEMAS), or those named alone, of files(path, content), wherever their content comes from.

    Each file is parsed once: the rows are written to `folder` (by default one of the shared scratch folder), parted by
    relation, and a relation reads its own part. A file that can't be read is a row of `errors`.
    """
    folder = folder or scratch_folder(files.sparkSession, "parsed")
    files.select("path", "content").mapInPandas(lambda it: rows_of(it, kinds), RELATION).write.partitionBy("kind").parquet(folder)
    all_ = files.sparkSession.read.schema(RELATION).parquet(folder)
    return {kind: unpacked(all_, kind) for kind in SCHEMAS if kinds is None or kind in kinds}


def relation_of(files: DataFrame, kind: str) -> DataFrame:
    """One relation of files(path, content), in one pass that looks at the parts which it needs alone and writes nothing."""
    return unpacked(files.select("path", "content").mapInPandas(lambda it: rows_of(it, {kind}), RELATION), kind)


def read_docx(spark: SparkSession, path: str, folder: str | None = None) -> dict[str, DataFrame]:
    """relations_of() the word-processor files below a path."""
    return relations_of(files_at(spark, path), folder)


def proposal_text(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, text): a form's text, as people fill in proposals: table rows, their cells parted by bars, then the paragraphs."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " | ").alias("line")
    rows = cells.groupBy("doc_id", "ord", "row").agg(line).select("doc_id", F.lit(0).alias("part"), "ord", "row", "line")
    paras = blocks.filter("kind = 'p'").select("doc_id", F.lit(1).alias("part"), "ord", F.lit(0).alias("row"), F.coalesce("text", F.lit("")).alias("line"))
    all_ = rows.unionByName(paras).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "row", "line"))).alias("rows"))
    return all_.select("doc_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def summary(relations: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, paragraphs, tables, images, chars, styles_used, sections, bookmarks): a line for each document."""
    b = relations["blocks"].groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "p").alias("paragraphs"), F.count_if(F.col("kind") == "tbl").alias("tables"), F.coalesce(F.sum("images"), F.lit(0)).alias("images"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.array_sort(F.collect_set("style_name")).alias("styles_used"),
    )
    for name in ("sections", "bookmarks"):
        b = b.join(relations[name].groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left").fillna(0, [name])
    return b


def anchor_tally(runs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(doc_id, anchor, uses, there): how often each place is linked to, and whether it exists; places without links, too."""
    used = runs.filter("anchor is not null").groupBy("doc_id", "anchor").agg(F.count(F.lit(1)).alias("uses"))
    names = bookmarks.select("doc_id", F.col("name").alias("anchor")).distinct().withColumn("there", F.lit(True))
    both = used.join(names, ["doc_id", "anchor"], "full")
    return both.select("doc_id", "anchor", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("there", F.lit(False)).alias("there"))


def used_styles(styles: DataFrame, blocks: DataFrame) -> DataFrame:
    """The styles that paragraphs of their document use, by id or name, and the default ones."""
    used = blocks.select("doc_id", F.col("style_id")).filter("style_id is not null").distinct().withColumn("__used", F.lit(True))
    return styles.join(used, ["doc_id", "style_id"], "left").filter("__used or is_default").select(styles.columns)
