"""Word-processor files from relations: a document's parts become one file, made on the executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.batches import FILES, lots
from vellum.operators.durable import dealt_for_work

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
W, R = f"{{{NS}}}", f"{{{REL}}}"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: What the writer takes of each relation: kind, then the columns that are used.
TAKEN = {
    "para": ("para_index", "style_name", "border"), "run": ("para_index", "run_ord", "text", "superscript", "anchor", "link_kind", "size_pt", "font_ea", "font_ascii", "bold"), "bookmark": ("para_index", "name"),
    "style": ("style_id", "name", "based_on", "link", "next", "is_default", "size_pt", "font_ea", "font_ascii", "bold", "align", "space_before_pt", "space_after_pt", "line_spacing", "first_line_indent_chars", "outline_level"),
    "cell": ("after_para", "row", "col", "text"),
    "section": ("section_index", "last_para", "page_fmt", "page_start", "has_pgnumtype", "has_page_field", "header_text", "header_has_rule", "width_cm", "height_cm", "top_cm", "right_cm", "bottom_cm", "left_cm"),
}


def add(parent, tag: str, text: str | None = None, **attributes):
    """A child element; attributes that are None are left out."""
    node = E.SubElement(parent, f"{W}{tag}", {f"{W}{k}": str(v) for k, v in attributes.items() if v is not None})
    node.text = text
    return node


def whole(value, scale: float = 1.0) -> int | None:
    return None if value is None else round(value * scale)


def looks(parent, row: dict) -> None:
    """Run properties, in the order that the format wants."""
    p = E.Element(f"{W}rPr")
    if row.get("font_ascii") or row.get("font_ea"):
        add(p, "rFonts", ascii=row.get("font_ascii"), hAnsi=row.get("font_ascii"), eastAsia=row.get("font_ea"))
    if row.get("bold") is not None:
        add(p, "b", val=None if row["bold"] else "0")
    if row.get("size_pt") is not None:
        add(p, "sz", val=whole(row["size_pt"], 2))
        add(p, "szCs", val=whole(row["size_pt"], 2))
    if row.get("superscript"):
        add(p, "vertAlign", val="superscript")
    if len(p):
        parent.append(p)


def styles_xml(styles: list[dict]) -> bytes:
    root = E.Element(f"{W}styles")
    for s in styles:
        node = add(root, "style", type="paragraph", styleId=s["style_id"], default="1" if s.get("is_default") else None)
        for tag, column in (("name", "name"), ("basedOn", "based_on"), ("next", "next"), ("link", "link")):
            if s.get(column):
                add(node, tag, val=s[column])
        p = E.Element(f"{W}pPr")
        if any(s.get(c) is not None for c in ("space_before_pt", "space_after_pt", "line_spacing")):
            add(p, "spacing", before=whole(s.get("space_before_pt"), 20), after=whole(s.get("space_after_pt"), 20), line=whole(s.get("line_spacing"), 240))
        if s.get("first_line_indent_chars") is not None:
            add(p, "ind", firstLineChars=whole(s["first_line_indent_chars"], 100))
        if s.get("align"):
            add(p, "jc", val=s["align"])
        if s.get("outline_level") is not None:
            add(p, "outlineLvl", val=int(s["outline_level"]))
        if len(p):
            node.append(p)
        looks(node, s)
    return E.tostring(root, "utf-8", xml_declaration=True)


def section_xml(parent, s: dict, links: dict[str, str]) -> None:
    """links: ids of the section's header and footer parts, by kind."""
    node = add(parent, "sectPr")
    for kind in ("header", "footer"):
        if kind in links:
            E.SubElement(node, f"{W}{kind}Reference", {f"{W}type": "default", f"{R}id": links[kind]})
    if s.get("width_cm"):
        add(node, "pgSz", w=whole(s["width_cm"], 567), h=whole(s.get("height_cm"), 567))
    if any(s.get(f"{side}_cm") is not None for side in ("top", "right", "bottom", "left")):
        add(node, "pgMar", **{side: whole(s.get(f"{side}_cm"), 567) for side in ("top", "right", "bottom", "left")})
    if s.get("has_pgnumtype"):
        add(node, "pgNumType", fmt=s.get("page_fmt"), start=whole(s.get("page_start")))


def run_xml(parent, row: dict) -> None:
    node = add(parent, "r")
    looks(node, row)
    pieces = (row.get("text") or "").split("\t")
    for k, piece in enumerate(pieces):
        if k:
            add(node, "tab")
        if piece or len(pieces) == 1:
            add(node, "t", piece).set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def linked_run(parent, row: dict) -> None:
    """A run, in a link or in the result of a link field if it has a place to lead to."""
    if not row.get("anchor"):
        run_xml(parent, row)
    elif row.get("link_kind") == "field":
        for kind in ("begin", "code", "separate", "result", "end"):
            if kind == "result":
                run_xml(parent, row)
            elif kind == "code":
                add(add(parent, "r"), "instrText", f' HYPERLINK \\l "{row["anchor"]}" ')
            else:
                add(add(parent, "r"), "fldChar", fldCharType=kind)
    else:
        run_xml(add(parent, "hyperlink", anchor=row["anchor"]), row)


def table_xml(parent, cells: list[dict]) -> None:
    """A table of text cells; a cell's lines are paragraphs of it."""
    node = add(parent, "tbl")
    add(node, "tblPr")
    by_row: dict[int, list[dict]] = {}
    for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
        by_row.setdefault(c["row"], []).append(c)
    for of in by_row.values():
        row = add(node, "tr")
        for c in of:
            cell = add(row, "tc")
            for line in (c.get("text") or "").split("\n"):
                run_xml(add(cell, "p"), {"text": line})


def grouped(rows: list[dict], key: str = "para_index") -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def document_xml(rows: dict[str, list[dict]], links: dict[int, dict[str, str]]) -> bytes:
    root = E.Element(f"{W}document")
    body = add(root, "body")
    ids = {s["name"]: s["style_id"] for s in rows["style"]}
    paras, runs, marks, tables = grouped(rows["para"]), grouped(rows["run"]), grouped(rows["bookmark"]), grouped(rows["cell"], "after_para")
    sections = sorted(rows["section"], key=lambda s: s["section_index"])
    last = {s["last_para"]: s for s in sections[:-1] if s.get("last_para") is not None}
    number = 0
    for i in sorted({*paras, *runs, *marks} - {None}):
        node, look = add(body, "p"), (paras.get(i) or [{}])[0]
        p = E.Element(f"{W}pPr")
        if look.get("style_name"):
            add(p, "pStyle", val=ids.get(look["style_name"], look["style_name"]))
        if look.get("border"):
            edges = add(p, "pBdr")
            for edge in look["border"].split(";"):
                name, _, kind = edge.partition("=")
                add(edges, name, val=kind.partition(",")[0], sz=kind.partition(",")[2], space="1", color="auto")
        if i in last:
            section_xml(p, last[i], links.get(last[i]["section_index"], {}))
        if len(p):
            node.append(p)
        for m in marks.get(i, ()):
            add(node, "bookmarkStart", id=number, name=m["name"])
            add(node, "bookmarkEnd", id=number)
            number += 1
        for r in sorted(runs.get(i, ()), key=lambda r: r["run_ord"]):
            linked_run(node, r)
        if i in tables:
            table_xml(body, tables[i])
    if sections:
        section_xml(body, sections[-1], links.get(sections[-1]["section_index"], {}))
    return E.tostring(root, "utf-8", xml_declaration=True)


def file_of(rows: dict[str, list[dict]]) -> bytes:
    """The file of one document's rows by kind. The same rows give the same bytes."""
    E.register_namespace("w", NS)
    E.register_namespace("r", REL)
    heads = {s["section_index"]: s for s in rows["section"] if s.get("header_text") or s.get("header_has_rule") is not None}
    feet = [s["section_index"] for s in rows["section"] if s.get("has_page_field")]
    rid = {s["section_index"]: {kind: f"rId{kind[0].upper()}{s['section_index']}" for kind, of in (("header", heads), ("footer", feet)) if s["section_index"] in of} for s in rows["section"]}
    parts = {"word/document.xml": document_xml(rows, rid), "word/styles.xml": styles_xml(sorted(rows["style"], key=lambda s: s["style_id"]))}
    for i, s in sorted(heads.items()):
        root = E.Element(f"{W}hdr")
        node = add(root, "p")
        if s.get("header_has_rule"):
            add(add(add(node, "pPr"), "pBdr"), "bottom", val="single", sz=6, space="1", color="auto")
        run_xml(node, {"text": s["header_text"]})
        parts[f"word/header{i}.xml"] = E.tostring(root, "utf-8", xml_declaration=True)
    for i in feet:
        root = E.Element(f"{W}ftr")
        node = add(root, "p")
        for kind in ("begin", "code", "separate", "end"):
            add(add(node, "r"), "instrText", " PAGE ") if kind == "code" else add(add(node, "r"), "fldChar", fldCharType=kind)
        parts[f"word/footer{i}.xml"] = E.tostring(root, "utf-8", xml_declaration=True)
    office = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    kinds = {"word/document.xml": "document.main", "word/styles.xml": "styles"} | {f"word/header{i}.xml": "header" for i in heads} | {f"word/footer{i}.xml": "footer" for i in feet}
    types = "".join(f'<Override PartName="/{name}" ContentType="{office}.{kind}+xml"/>' for name, kind in kinds.items())
    parts["[Content_Types].xml"] = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'.encode()
    links = lambda *of: ('<?xml version="1.0" encoding="UTF-8"?>' + f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{target}"/>' for i, t, target in of) + "</Relationships>").encode()
    parts["_rels/.rels"] = links(("rId1", "officeDocument", "word/document.xml"))
    parts["word/_rels/document.xml.rels"] = links(("rId1", "styles", "styles.xml"), *((rid[i]["header"], "header", f"header{i}.xml") for i in sorted(heads)), *((rid[i]["footer"], "footer", f"footer{i}.xml") for i in feet))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), parts[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tagged(kind: str, rows: DataFrame) -> DataFrame:
    there = [c for c in TAKEN[kind] if c in rows.columns]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(kind).alias("kind"), F.to_json(F.struct(*there)).alias("row"))


def as_files(paragraphs: DataFrame, runs: DataFrame, styles: DataFrame, sections: DataFrame | None = None, bookmarks: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): each document's file, from paragraphs(doc_id, para_index, style_name, border) and the like.

    A document's rows meet in one task, as its file is one value. sections(.., last_para) name the paragraph that ends each but
    the last of them; cells(.., after_para, row, col, text) make a table behind that paragraph. Text, character formats, links,
    bookmarks, styles, tables and pages are written; what no relation holds isn't.
    """
    import json

    rows = tagged("para", paragraphs).union(tagged("run", runs)).union(tagged("style", styles))
    if sections is not None:
        rows = rows.union(tagged("section", sections))
    if bookmarks is not None:
        rows = rows.union(tagged("bookmark", bookmarks))
    if cells is not None:
        rows = rows.union(tagged("cell", cells))

    blank = {kind: dict.fromkeys(columns) for kind, columns in TAKEN.items()}

    def content(rows: str) -> bytes:
        of: dict[str, list[dict]] = {kind: [] for kind in TAKEN}
        for kind, row in json.loads(rows):
            of[kind].append(blank[kind] | row)
        return file_of(of)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = ((doc_id, content(rows)) for batch in batches for doc_id, rows in zip(batch["doc_id"], batch["rows"], strict=True))
        return lots(made, ["doc_id", "content"], FILES, dtype=object)

    # Spark gathers a document's rows, so that Python takes many documents at a time: a call for each costs more than its file
    entry = F.concat(F.lit('["'), "kind", F.lit('",'), "row", F.lit("]"))
    of = dealt_for_work(rows).groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("rows"))
    return of.mapInPandas(build, "doc_id long, content binary")


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes files(name, content) to a folder, each by the executor that has it, and says how many.

    Each is written beside its place and then moved there, so that a reader never sees half a file and a repeated task changes
    nothing. The folder is one of a file system that pyarrow knows (local ones are shared by all executors); others are written
    to by save_files().
    """
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toString()
    local = uri.removeprefix("file:") if uri.startswith("file:") else None
    if local is None:
        from pyarrow import fs

        try:
            fs.FileSystem.from_uri(uri)
        except Exception:  # a file system that only Spark knows
            return save_files(files, folder, name, content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        there, base = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local is not None else fs.FileSystem.from_uri(uri)
        there.create_dir(base, recursive=True)
        for batch in batches:
            for file, data in zip(batch["name"], batch["content"], strict=True):
                part = f"{base}/.{uuid.uuid4().hex}.part"
                with there.open_output_stream(part) as out:
                    out.write(data)
                there.move(part, f"{base}/{file}")
            yield pd.DataFrame({"n": [len(batch)]})

    system.mkdirs(path)
    written = files.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes files(name, content) to a folder of any file system that Spark knows, one at a time, and says how many.

    Each is written beside its place and then moved there, so that a reader never sees half a file. Rows pass the driver one by
    one, which is for few files: write_files() is the way for a corpus.
    """
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(conf)

    def rows() -> Iterator:
        yield from files.select(name, content).toLocalIterator(prefetchPartitions=True)

    n = 0
    for row in rows():
        target, part = path(f"{folder}/{row[0]}"), path(f"{folder}/.{row[0]}.part")
        out = system.create(part, True)
        out.write(bytearray(row[1]))
        out.close()
        system.delete(target, False)
        system.rename(part, target)
        n += 1
    return n
