"""Repair of given word-processor files: a plan's edits in place, every other byte of content as it was.

The edits are those of `operators.repair`: a document's fold runs over what its file holds, and what the fold has changed is
then carried into the file's tree, where every paragraph and run of the fold knows its element. Elements that no edit
concerns, and all other parts (tables, pictures, notes, settings), keep their bytes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.batches import FILES, lots
from vellum.operators import repair as R
from vellum.sources.docx import W, border_of, header_parts, linked_place, placed_runs, relationships, run_values, sections_of, style_names, value
from vellum.sources.tree import Node, parse, written

#: The order that the format wants of the properties that are written here and of those around them.
RUN_ORDER = ("rStyle", "rFonts", "b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "noProof", "snapToGrid", "vanish", "webHidden", "color", "spacing", "w", "kern", "position", "sz", "szCs", "highlight", "u", "effect", "bdr", "shd", "fitText", "vertAlign")
PARAGRAPH_ORDER = ("pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl", "numPr", "suppressLineNumbers", "pBdr", "shd", "tabs", "suppressAutoHyphens", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "bidi", "adjustRightInd", "snapToGrid", "spacing", "ind", "contextualSpacing", "mirrorIndents", "suppressOverlap", "jc", "textDirection", "textAlignment", "textboxTightWrap", "outlineLvl", "divId", "cnfStyle", "rPr", "sectPr", "pPrChange")


class Unwritable(Exception):
    """An edit that can't be carried into the file without breaking it."""


def properties(node: Node, tag: str) -> Node:
    """The element of properties that opens a paragraph or run; made if it isn't there."""
    found = node.find(W + tag)
    return found if found is not None else node.insert(0, node.made(W + tag))


def put(props: Node, tag: str, order: tuple[str, ...], **attributes: str | None) -> Node:
    """A property with these attributes, at its place in the order; attributes that are None go."""
    node = props.find(W + tag)
    if node is None:
        later = order[order.index(tag) + 1 :]
        before = next((k for k in props if k.tag.removeprefix(W) in later), None)
        node = props.insert(before.place() if before is not None else len(props.kids), props.made(W + tag))
    for name, of in attributes.items():
        if of is not None:
            node.set(W + name, of)
        elif node.get(W + name) is not None:
            node.attributes = {n: v for n, v in node.attributes.items() if node.clark(n) != W + name}
            node.touch()
    return node


def drop(props: Node | None, *tags: str) -> None:
    for tag in tags:
        for node in props.findall(W + tag) if props is not None else ():
            node.detach()


def set_text(run: Node, text: str) -> None:
    """The text of a run, its other content staying; tabs become elements."""
    old = [k for k in run if k.tag in (W + "t", W + "tab")]
    at = old[0].place() if old else len(run.kids)
    for k in old:
        k.detach()
    for n, piece in enumerate(text.split("\t")):
        if n:
            run.insert(at, run.made(W + "tab"))
            at += 1
        if piece:
            node = run.made(W + "t", piece)
            node.attributes["xml:space"] = "preserve"
            run.insert(at, node)
            at += 1


def set_looks(run: Node, now: dict, before: dict) -> None:
    """Character formats that differ."""
    changed = {c for c in ("superscript", "size_pt", "font_ea", "font_ascii", "bold") if now[c] != before.get(c)}
    if not changed:
        return
    props = properties(run, "rPr")
    if changed & {"font_ea", "font_ascii"}:
        fonts = {"eastAsia": now["font_ea"]} if "font_ea" in changed else {}
        put(props, "rFonts", RUN_ORDER, **fonts, **({"ascii": now["font_ascii"], "hAnsi": now["font_ascii"]} if "font_ascii" in changed else {}))
    if "bold" in changed:
        drop(props, "b") if now["bold"] is None else put(props, "b", RUN_ORDER, val=None if now["bold"] else "0")
    if "size_pt" in changed:
        drop(props, "sz", "szCs")
        for tag in ("sz", "szCs") if now["size_pt"] is not None else ():
            put(props, tag, RUN_ORDER, val=str(round(2 * now["size_pt"])))
    if "superscript" in changed:
        put(props, "vertAlign", RUN_ORDER, val="superscript") if now["superscript"] else drop(props, "vertAlign")


def mark_of(node: Node) -> str | None:
    return value(node, W + "fldChar", "fldCharType") if node.tag == W + "r" else None


class Field:
    """The field in whose result a run stands: its marks, all beside the run."""

    def __init__(self, run: Node):
        beside, self.head, self.tail = list(run.parent), [], None
        k = next(i for i, n in enumerate(beside) if n is run)
        depth, first = 0, None
        for i in range(k - 1, -1, -1):
            kind = mark_of(beside[i])
            depth += (kind == "end") - (kind == "begin")
            if depth < 0:
                first, depth = i, 0
                code = "".join(n.find(W + "instrText").text or "" for n in beside[i:k] if n.find(W + "instrText") is not None)
                if linked_place(code):
                    break
                first = None
        if first is None:
            raise Unwritable("a link field that begins elsewhere")
        level, opened = 0, False
        for n in beside[first:]:
            kind = mark_of(n)
            level += (kind == "begin") - (kind == "end")
            if not opened:
                self.head.append(n)
                opened = kind == "separate" and level == 1
            if kind == "end" and level == 0:
                self.tail = n
                break
        if self.tail is None or not opened:
            raise Unwritable("a link field that ends elsewhere")


def hyperlink_of(run: Node) -> Node | None:
    node = run.parent
    while node is not None and node.tag != W + "p":
        if node.tag == W + "hyperlink":
            return node
        node = node.parent
    return None


def visible(nodes: list[Node]) -> bool:
    return any(k.tag in (W + "t", W + "tab", W + "drawing", W + "pict") for n in nodes for k in n.iter())


def outside(run: Node) -> Node:
    """Takes a run out of all links around it, which stay around what is before and behind it. Returns the run."""
    while (link := hyperlink_of(run)) is not None:
        if run.parent is not link:
            raise Unwritable("a link around other elements")
        at, inner = link.place(), list(link)
        k = next(i for i, n in enumerate(inner) if n is run)
        rest = inner[k + 1 :]
        run.detach()
        behind = link.copied() if rest else None
        if behind is not None:
            behind.kids = []
            for n in rest:
                behind.append(n.detach())
        link.parent.insert(at + 1, run)
        if behind is not None:
            link.parent.insert(at + 2, behind)
        if not any(True for _ in link):
            link.detach()
    while in_link_field(run):
        field = Field(run)
        beside = list(run.parent)
        place = {id(n): i for i, n in enumerate(beside)}
        here, start, end = place[id(run)], place[id(field.head[-1])], place[id(field.tail)]
        before, behind = visible(beside[start + 1 : here]), visible(beside[here + 1 : end])
        if behind:
            at = run.place() + 1
            for i, n in enumerate(field.head):
                run.parent.insert(at + i, n.copied())
        else:
            field.tail.detach()
        if before:
            run.parent.insert(run.place(), field.tail.copied())
        else:
            for n in field.head:
                n.detach()
    return run


def in_link_field(run: Node) -> bool:
    paragraph = run
    while paragraph.tag != W + "p":
        paragraph = paragraph.parent
    return next((kind == "field" for node, _, kind in placed_runs(paragraph) if node is run), False)


def set_link(run: Node, anchor: str | None, kind: str | None) -> None:
    run = outside(run)
    if not anchor:
        return
    if kind == "field":
        at, holder = run.place(), run.parent
        mark = lambda of: with_kids(run.made(W + "r"), run.made(W + "fldChar", fldCharType=of))
        code = run.made(W + "instrText", f' HYPERLINK \\l "{anchor}" ')
        code.attributes["xml:space"] = "preserve"
        holder.insert(at + 1, mark("end"))
        for node in (mark("separate"), with_kids(run.made(W + "r"), code), mark("begin")):
            holder.insert(at, node)
    else:
        link, at, holder = run.made(W + "hyperlink", anchor=anchor, history="1"), run.place(), run.parent
        link.append(run.detach())
        holder.insert(at, link)


def with_kids(node: Node, *kids: Node) -> Node:
    for k in kids:
        node.append(k)
    return node


def block_of(run: Node) -> Node:
    """The last element of what belongs to a run: its link or its field's end, else the run."""
    if hyperlink_of(run) is not None:
        return hyperlink_of(run)
    return Field(run).tail if in_link_field(run) else run


def alone_behind(run: Node) -> None:
    """Ends the run's link behind it, so that a run may follow that isn't in it."""
    link = hyperlink_of(run)
    if link is not None:
        inner = list(link)
        if inner[-1] is not run:
            anchor, kind = link.get(W + "anchor"), "hyperlink"
            set_link(run, anchor, kind)
    elif in_link_field(run):
        field = Field(run)
        beside = list(run.parent)
        place = {id(n): i for i, n in enumerate(beside)}
        if visible(beside[place[id(run)] + 1 : place[id(field.tail)]]):
            code = "".join(n.find(W + "instrText").text or "" for n in field.head if n.find(W + "instrText") is not None)
            set_link(run, linked_place(code), "field")


class Document:
    """The main part of a file, its fold, and the parts that an edit may change."""

    def __init__(self, package: zipfile.ZipFile):
        self.names = set(package.namelist())
        self.package, self.trees = package, {}
        self.body = self.tree("word/document.xml").find(W + "body")
        styles = ElementTree.fromstring(package.read("word/styles.xml")) if "word/styles.xml" in self.names else None
        self.display = style_names(styles)
        self.links = relationships(package, self.names)
        nodes = [n for n in self.body if n.tag == W + "p"]
        self.runs: list[Node] = []
        rows, at = [], []
        for i, node in enumerate(nodes, 1):
            style = value(node.find(W + "pPr"), W + "pStyle")
            rows.append({"kind": "para", "para_index": i, "style_name": self.display.get(style, style), "border": border_of(node)})
            for k, (run, anchor, kind) in enumerate(placed_runs(node)):
                rows.append({"kind": "run", "para_index": i, "run_ord": k, **run_values(run, anchor, kind)})
                at.append((i, k, len(self.runs)))
                self.runs.append(run)
            rows += [{"kind": "bookmark", "para_index": i, "name": m.get(W + "name")} for m in node.iter(W + "bookmarkStart")]
        self.heads = {}
        for k, section in enumerate(sections_of(self.body), 1):
            for name in header_parts(section, self.links):
                if name in self.names:
                    self.heads.setdefault(k, name)
        for k, name in self.heads.items():
            rows.append({"kind": "header", "para_index": k, "border": self.header_border(name)})
        self.draft = R.Draft([{c: None for c, _ in R._FIELDS} | r for r in rows])
        self.before, self.original = {}, {}
        for i, k, n in at:
            run = self.draft.of[i].runs[k]
            run["at"] = n
            self.original[n], self.before[n] = run, dict(run)
        for i, node in enumerate(nodes, 1):
            p = self.draft.of[i]
            p.node, p.parts, p.was = node, [node], (p.style, p.border)
        self.was_headers = dict(self.draft.headers)

    def tree(self, name: str) -> Node:
        if name not in self.trees:
            self.trees[name] = parse(self.package.read(name))
        return self.trees[name][1]

    def header_border(self, name: str) -> str | None:
        return next((b for p in self.tree(name).iter(W + "p") if (b := border_of(p))), None)

    # from the fold to the tree

    def carry(self) -> None:
        nodes = [n for n in self.body if n.tag == W + "p"]
        kept = {id(n) for p in self.draft.paragraphs for n in getattr(p, "parts", ())}
        last: Node | None = None
        for p in self.draft.paragraphs:
            if p.index is None:
                p.node = self.body.made(W + "p")
                p.was, p.parts = (None, None), [p.node]
                self.body.insert(last.place() + 1 if last is not None else 0, p.node)
            elif p.parts != [p.node]:
                self.merge(p)
            last = p.node
        for node in nodes:
            if id(node) not in kept:
                self.remove(node)
        ids = {name: i for i, name in reversed(self.display.items())}
        for p in self.draft.paragraphs:
            if p.style != p.was[0]:
                put(properties(p.node, "pPr"), "pStyle", PARAGRAPH_ORDER, val=ids.get(p.style, p.style))
            if p.border != p.was[1]:
                self.set_border(p.node, p.border)
            self.set_names(p)
            self.set_runs(p)
        for section, border in self.draft.headers.items():
            if border != self.was_headers.get(section):
                name = next((self.heads[k] for k in range(section, 0, -1) if k in self.heads), None) if section else None
                if name is None:
                    raise Unwritable("no header")
                lines = list(self.tree(name).iter(W + "p"))
                self.set_border(next((x for x in lines if border_of(x)), next((x for x in reversed(lines) if visible([x])), lines[-1])), border)

    def set_border(self, node: Node, border: str | None) -> None:
        edges = put(properties(node, "pPr"), "pBdr", PARAGRAPH_ORDER)
        known = {k.tag.removeprefix(W): k for k in edges}
        wanted = [x.partition("=") for x in (border or "").split(";") if x]
        for k in list(edges):
            k.detach()
        for name, _, look in wanted:
            kind, _, size = look.partition(",")
            edge = known.get(name) or edges.made(W + name, space="1", color="auto")
            edges.append(edge)
            edge.set(W + "val", kind)
            edge.set(W + "sz", size)

    def leave_section(self, node: Node) -> None:
        """A paragraph that goes hands the section that it ends on to the one before it."""
        section = node.find(f"{W}pPr/{W}sectPr")
        if section is None:
            return
        before = None
        for n in self.body:
            if n is node:
                break
            before = n
        if before is None or before.tag != W + "p" or before.find(f"{W}pPr/{W}sectPr") is not None:
            raise Unwritable("the paragraph ends a section")
        props = properties(before, "pPr")
        later = next((k for k in props if k.tag == W + "pPrChange"), None)
        props.insert(later.place() if later is not None else len(props.kids), section.detach())

    def remove(self, node: Node) -> None:
        """Takes out a paragraph. Bookmarks that begin in it end nowhere else; those that only end in it end at its place."""
        marks = [mark_of(n) for n in node.iter(W + "r")]
        if marks.count("begin") != marks.count("end"):
            raise Unwritable("a field goes beyond the paragraph")
        self.leave_section(node)
        own = {m.get(W + "id") for m in node.iter(W + "bookmarkStart")}
        ends = {m.get(W + "id") for m in node.iter(W + "bookmarkEnd")}
        for m in list(self.body.iter(W + "bookmarkEnd")) if own - ends else ():
            if m.get(W + "id") in own - ends:
                m.detach()
        at = node.place()
        for i in sorted(ends - own):
            self.body.insert(at, self.body.made(W + "bookmarkEnd", id=i))
        node.detach()

    def merge(self, p) -> None:
        """Content of paragraphs that went into p: before or behind its own."""
        own = next(i for i, n in enumerate(p.parts) if n is p.node)
        props = p.node.find(W + "pPr")
        at = props.place() + 1 if props is not None else 0
        for k, node in enumerate(p.parts):
            if node is p.node:
                continue
            self.leave_section(node)
            for kid in [x for x in node if x.tag != W + "pPr"]:
                kid.detach()
                p.node.insert(at, kid) if k < own else p.node.append(kid)
                at += k < own
            node.detach()

    def set_names(self, p) -> None:
        there = {m.get(W + "name"): m for m in p.node.iter(W + "bookmarkStart")}
        for name, m in there.items():
            if name not in p.names:
                for e in [e for e in self.body.iter(W + "bookmarkEnd") if e.get(W + "id") == m.get(W + "id")]:
                    e.detach()
                m.detach()
        for name in dict.fromkeys(p.names):
            if name in there:
                continue
            used = [int(i) for m in self.body.iter(W + "bookmarkStart") if (i := m.get(W + "id") or "").isdigit()]
            number = str(max(used, default=-1) + 1)
            props = p.node.find(W + "pPr")
            p.node.insert(props.place() + 1 if props is not None else 0, p.node.made(W + "bookmarkStart", id=number, name=name))
            p.node.append(p.node.made(W + "bookmarkEnd", id=number))

    def set_runs(self, p) -> None:
        last: Node | None = None
        for run in p.runs:
            n = run.get("at")
            if n is not None and run is self.original[n]:
                node, before = self.runs[n], self.before[n]
            else:
                node = p.node.made(W + "r")
                before = {c: None for c in R._RUN} | {"superscript": False}
                if n is not None:
                    before = {**self.before[n], "text": None, "anchor": None, "link_kind": None}
                    look = self.runs[n].find(W + "rPr")
                    if look is not None:
                        node.append(look.copied())
                if last is None:
                    p.node.append(node)
                else:
                    alone_behind(last)
                    block = block_of(last)
                    block.parent.insert(block.place() + 1, node)
            if run["text"] != before["text"]:
                set_text(node, run["text"] or "")
            set_looks(node, run, before)
            if (run["anchor"], run["link_kind"]) != (before["anchor"], before["link_kind"]):
                set_link(node, run["anchor"], run["link_kind"])
            last = node

    def parts(self) -> dict[str, bytes]:
        return {name: head + written(root) + tail for name, (head, root, tail) in self.trees.items() if root.raw is None}


def patched(content: bytes, steps: list[dict]) -> tuple[bytes, list[dict]]:
    """The file after a plan's steps, and the journal. If the result can't be written, the file stays and every step failed."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        document = Document(package)
        journal = R.stepped(document.draft, steps)
        if not any(j["status"] == "applied" for j in journal):
            return content, journal
        try:
            document.carry()
            changed = document.parts()
        except Unwritable as e:
            return content, [{**j, "status": f"failed: {e}"} for j in journal]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for info in package.infolist():
                z.writestr(info, changed.get(info.filename) or package.read(info), info.compress_type)
        return out.getvalue(), journal


def repaired(files: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, path, content, sha256, journal) of files(doc_id, path, content) after the enabled items of each document.

    A file is one value, so its items come to it, as a list. Files without items come back as they are. One that can't be read
    stays as it is, with the reason in its journal.
    """
    import hashlib

    steps = R.ordered(items).groupBy("doc_id").agg(F.collect_list(F.struct("step", "issue_key", "action", F.col("loc_index").cast("int").alias("loc_index"), F.map_entries("params").alias("params"))).alias("steps"))
    entry = "array<struct<step:int,issue_key:string,action:string,status:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def after(doc_id: int, path: str, content: bytes, wanted: list | None) -> tuple:
            wanted = [dict(s) | {"params": {e["key"]: e["value"] for e in s["params"]} if s["params"] is not None else None} for s in wanted] if wanted is not None else []
            try:
                content, journal = patched(content, wanted) if wanted else (content, [])
            except Exception as e:  # an odd file is a finding, not the job's end
                journal = [{**s, "status": f"failed: {type(e).__name__}: {e}"} for s in wanted]
            journal = [{c: j[c] for c in ("step", "issue_key", "action", "status")} for j in journal]
            return doc_id, path, content, hashlib.sha256(content).hexdigest(), journal

        files = (file for batch in batches for file in zip(batch["doc_id"], batch["path"], batch["content"], batch["steps"], strict=True))
        return lots((after(*file) for file in files), ["doc_id", "path", "content", "sha256", "journal"], FILES, dtype=object)

    known = files.select("doc_id", "path", "content").join(steps, "doc_id", "left")
    return known.mapInPandas(run, f"doc_id long, path string, content binary, sha256 string, journal {entry}")
