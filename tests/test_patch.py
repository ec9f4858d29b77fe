"""Edits of given files: what the file holds afterwards equals the fold, and all that no edit concerns keeps its bytes."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import repair as R
from vellum.sinks import patch as P
from vellum.sources import docx as D
from vellum.sources.tree import parse, written

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'


def run(text, p=""):
    return f"<w:r>{f'<w:rPr>{p}</w:rPr>' if p else ''}<w:t xml:space='preserve'>{text}</w:t></w:r>"


def field(code, *results):
    mark = lambda k: f'<w:r><w:rPr><w:noProof/></w:rPr><w:fldChar w:fldCharType="{k}"/></w:r>'
    return mark("begin") + f"<w:r><w:instrText xml:space='preserve'> {code} </w:instrText></w:r>" + mark("separate") + "".join(results) + mark("end")


UP, TABLE = '<w:rStyle w:val="c"/><w:vertAlign w:val="superscript"/>', "<w:tbl><w:tblPr/><w:tr><w:tc><w:p w14:paraId='00'><w:r><w:t>a &gt; b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
PICTURE, NOTE = '<w:r><w:drawing><x:y xmlns:x="u" a="1>2"/></w:drawing></w:r>', '<w:r><w:footnoteReference w:id="2"/></w:r>'
BODY = [
    f'<w:p w14:paraId="7A"><w:pPr><w:pStyle w:val="h1"/><w:jc w:val="center"/></w:pPr><w:bookmarkStart w:id="4" w:name="top"/>{run("第1章 绪论", "<w:b/><w:sz w:val=&quot;32&quot;/>".replace("&quot;", chr(34)))}<w:bookmarkEnd w:id="4"/></w:p>',
    f'<w:p>{run("前人指出。")}<w:hyperlink w:anchor="ref1" w:history="1">{run("[1]", UP)}{run(" 与 ")}{run("[2]", UP)}</w:hyperlink>{run("。后文")}{NOTE}{run("完。")}</w:p>',
    TABLE,
    f'<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="4" w:space="1" w:color="auto"/></w:pBdr></w:pPr>{run("又有；")}{field("HYPERLINK " + chr(92) + "l ref2", run("[2]", UP), run("x"), run("[3]", UP))}{run("，以及")}{run("[7]")}{PICTURE}</w:p>',
    f'<w:p><w:ins w:id="9" w:author="a"><w:sdt><w:sdtContent>{run("深层")}</w:sdtContent></w:sdt></w:ins><!-- c -->{run("待补 &amp; &#x4E00;<![CDATA[x]]>".replace("<![CDATA[x]]>", ""))}<w:bookmarkStart w:id="5" w:name="across"/></w:p>',
    f'<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="rH1"/><w:pgSz w:w="11907" w:h="16840"/></w:sectPr></w:pPr>{field("PAGE", run("3"))}{run("节末")}</w:p>',
    f'<w:p><w:pPr><w:pStyle w:val="a"/></w:pPr><w:bookmarkEnd w:id="5"/>{run("参考文献")}</w:p>',
    f'<w:p><w:bookmarkStart w:id="1" w:name="ref1"/>{run("[1] 甲")}<w:bookmarkEnd w:id="1"/></w:p>',
    f'<w:p><w:bookmarkStart w:id="2" w:name="ref2"/><w:bookmarkEnd w:id="2"/>{run("[2]" + chr(9) + " 乙")}<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>',
]


def package(body=BODY):
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{n}"/></w:style>' for k, n in (("a", "Normal"), ("h1", "一级标题"), ("q", "正文")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n<w:document {NS}><w:body>{"".join(body)}<w:sectPr><w:headerReference w:type="default" r:id="rH2"/><w:pgSz w:w="11907" w:h="16840"/></w:sectPr></w:body></w:document>')
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rH1" Target="header1.xml"/><Relationship Id="rH2" Target="header2.xml"/></Relationships>')
        for k in (1, 2):
            z.writestr(f"word/header{k}.xml", f"<w:hdr {NS}><w:p><w:r><w:t>头{k}</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/media/image1.png", bytes(range(256)), zipfile.ZIP_STORED)
        z.writestr("word/footnotes.xml", f"<w:footnotes {NS}><w:footnote w:id='2'/></w:footnotes>")
    return out.getvalue()


def rows_of(content):
    rows = [(k, r) for k, r in D.parsed(content)]
    out = [{"kind": "para", "para_index": r["para_index"], "style_name": r["style_name"], "border": r["border"]} for k, r in rows if k == "blocks" and r["kind"] == "p"]
    out += [{"kind": "run", **r} for k, r in rows if k == "runs"] + [{"kind": "bookmark", **r} for k, r in rows if k == "bookmarks"]
    out += [{"kind": "header", "para_index": r["section_index"], "border": r["header_border"]} for k, r in rows if k == "sections" and r["header_text"]]
    return [{c: None for c, _ in R._FIELDS} | {"doc_id": 1} | r for r in out]


def shown(rows):
    """What a reader can see of PARTS rows: runs with text, in order."""
    runs, out = {}, {"para": {}, "bookmark": set(), "header": {}}
    for r in sorted((r for r in rows if r["kind"] == "run"), key=lambda r: r["run_ord"]):
        if r["text"]:
            runs.setdefault(r["para_index"], []).append(tuple(r[c] for c in R._RUN))
    for r in rows:
        if r["kind"] == "para" and (r["style_name"] or r["border"]):
            out["para"][r["para_index"]] = (r["style_name"], r["border"])
        elif r["kind"] == "header":
            out["header"][r["para_index"]] = r["border"]
        elif r["kind"] == "bookmark":
            out["bookmark"].add((r["para_index"], r["name"]))
    return runs, out


def steps(*items):
    return [{"step": k, "issue_key": f"k{k}", "action": a, "loc_index": i, "params": p} for k, (a, i, p) in enumerate(items, 1)]


def fold(content, items):
    out = R.folded(rows_of(content), items)
    return shown([{c: None for c, _ in R._FIELDS} | r for r in out]), [r["status"] for r in out if r["kind"] == "journal"]


def others(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: (z.read(i), i.compress_type, i.date_time) for i in z.infolist() if i.filename != "word/document.xml"}, [i.filename for i in z.infolist()]


def main_part(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read("word/document.xml").decode()


def test_a_tree_keeps_its_bytes():
    raw = main_part(package()).encode()
    head, root, tail = parse(raw)
    assert head + written(root) + tail == raw
    for node in list(root.iter()):
        node.touch()
    again = written(root)
    assert parse(again)[1].find("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}body") is not None and b'a="1&gt;2"' in again and b"<!-- c -->" in again
    deep = b"<a>" * 3000 + b"x" + b"</a>" * 3000
    assert written(parse(deep)[1]) == deep and parse('<?xml version="1.0" encoding="UTF-16"?><a>é</a>'.encode("utf-16"))[1].text == "é"


ONE_OF_EACH = [
    ("cite.superscript", 3, {"run_ord": "5"}), ("cite.superscript", 2, {"run_ord": "1", "on": "false"}), ("cite.size", 2, {"run_ord": "3", "size": "9.6"}), ("run.clear_size", 1, {}), ("cite.link", 3, {"run_ord": "2", "anchor": "ref1"}),
    ("cite.link", 2, {"run_ord": "2", "kind": "none"}), ("cite.link", 3, {"run_ord": "3", "kind": "none"}), ("cite.rewrite", 2, {"run_ord": "3", "text": "［2］"}), ("cite.move_before_punct", 2, {"run_ord": "1"}), ("cite.move_before_punct", 3, {"run_ord": "1"}), ("run.font", 4, {"font": "宋体", "ascii": "Arial", "size": "12", "bold": "false"}),
    ("para.style", 2, {"style": "正文"}), ("para.border", 1, {"edge": "top"}), ("para.border", 2, {"part": "header"}), ("ref.bookmark", 6, {"name": "ref1"}), ("para.delete", 7, {}), ("para.merge_into", 8, {"target": "6"}), ("para.insert_after", 3, {"text": "新\t段 <&>", "style": "正文"}),
    ("para.delete", 5, {}), ("para.fold", 1, {}), ("para.delete", 99, {}), ("cite.link", 1, {"anchor": "nowhere"}),
]


@pytest.mark.parametrize("item", ONE_OF_EACH, ids=lambda i: f"{i[0]}-{i[1]}")
def test_each_action_equals_the_fold(item):
    content = package()
    out, journal = P.patched(content, steps(item))
    want, status = fold(content, steps(item))
    assert shown(rows_of(out)) == want and [j["status"] for j in journal] == status
    assert main_part(out).count(TABLE) == 1 and NOTE in main_part(out) and PICTURE in main_part(out)
    untouched, order = others(content)
    now, same = others(out)
    assert order == same and {n for n in now if now[n] != untouched[n]} <= ({"word/header2.xml"} if item[2].get("part") else set())
    head, root, tail = parse(main_part(out).encode())
    assert head.endswith(b"\r\n") and len({m.get(P.W + "id") for m in root.iter(P.W + "bookmarkStart")}) == len(list(root.iter(P.W + "bookmarkStart")))
    # a second time changes nothing more, but for what is there anew each time
    if not item[0].startswith(("para.insert", "para.delete", "para.merge")):
        assert P.patched(out, steps(item))[0] == out or status[0].startswith("failed")


def test_all_actions_together_and_at_random():
    content = package()
    pick = random.Random(4)
    pools = {
        "cite.superscript": [{"on": "true"}, {"on": "false"}], "cite.size": [{"size": "8"}, {"size": "x"}], "run.clear_size": [{}], "cite.link": [{"anchor": "ref2"}, {"anchor": "ref1", "kind": "field"}, {"kind": "none"}, {"anchor": "no"}],
        "cite.rewrite": [{"text": "[9]"}, {"text": ""}, {"text": "a\tb"}], "cite.move_before_punct": [{}], "run.font": [{"font": "黑体"}, {"bold": "true"}, {"ascii": "Z", "size": "7"}, {}], "para.style": [{"style": "一级标题"}, {"style": "own"}],
        "para.border": [{"edge": "left"}, {"part": "header"}], "ref.bookmark": [{"name": "ref1"}, {"name": "neu"}, {"name": "across"}], "para.delete": [{}], "para.merge_into": [{}, {"target": "2"}], "para.insert_after": [{"text": "N"}, {"text": "", "style": "正文"}],
    }
    refused = 0
    for k in range(400):
        chosen = []
        for _ in range(pick.randint(1, 8)):
            action = pick.choice(list(pools))
            params = dict(pick.choice(pools[action]))
            if action.startswith(("cite", "run")) and pick.random() < 0.8:
                params["run_ord"] = str(pick.randint(0, 6))
            chosen.append((R.ACTIONS.index(action) > 9, action, pick.randint(1, 2 if "part" in params else 8), params))
        items = steps(*[c[1:] for c in sorted(chosen, key=lambda c: (c[0], -c[2] if c[0] else 0))])
        out, journal = P.patched(content, items)
        want, status = fold(content, items)
        if any("failed: the paragraph ends" in j["status"] or "failed: a " in j["status"] or j["status"] == "failed: no header" for j in journal):
            refused += 1
            assert out == content
            continue
        assert [j["status"] for j in journal] == status, (k, items)
        assert shown(rows_of(out)) == want, (k, items)
    assert refused < 40


def test_odd_files_are_findings(spark):
    deep = "<w:p>" + "<w:ins>" * 3000 + run("tief") + "</w:ins>" * 3000 + "</w:p>"
    odd = "<w:p><w:pPr><w:sectPr><w:pgNumType w:start='x'/></w:sectPr></w:pPr></w:p>"
    files = [("deep", package([deep])), ("odd", package([odd])), ("none", b""), ("half", package()[:300]), ("fine", package()), ("empty", None)]
    table = spark.createDataFrame(files, "path string, content binary").withColumn("kind", F.lit("clash"))
    relations = D.relations_of(table)
    assert {r.path for r in relations["errors"].collect()} == {"none", "half", "empty"}
    assert relations["runs"].filter("path = 'deep'").first().text == "tief" and relations["sections"].filter("path = 'odd' and section_index = 1").first().page_start is None
    for kind in D.SCHEMAS:
        if kind != "errors":
            assert sorted(map(str, D.relation_of(table, kind).collect())) == sorted(map(str, relations[kind].collect()))


def test_files_are_repaired_on_executors(spark):
    given = package()
    files = spark.createDataFrame([(k, f"f{k}", given if k != 3 else b"broken") for k in range(5)], "doc_id long, path string, content binary").repartition(3)
    items = [(k, s["issue_key"], s["action"], s["loc_index"], s["params"], k != 4) for k in (1, 3, 4) for s in steps(*ONE_OF_EACH[:3])]
    plan = spark.createDataFrame(items, "doc_id long, issue_key string, action string, loc_index int, params map<string,string>, enabled boolean")
    out = {r.doc_id: r for r in P.repaired(files, plan).collect()}
    assert len(out) == 5 and bytes(out[0].content) == bytes(out[4].content) == given and bytes(out[3].content) == b"broken"
    assert [j.status for j in out[1].journal] == ["applied"] * 3 and all(j.status.startswith("failed: BadZipFile") for j in out[3].journal) and out[4].journal == []
    whole = R.edited(R.parts_of(*[spark.createDataFrame([r for r in rows_of(given) if r["kind"] == k], R.PARTS).withColumn("doc_id", F.lit(1).cast("long")) for k in ("run", "para", "bookmark", "header")]), plan.filter("doc_id = 1"))
    assert shown(rows_of(bytes(out[1].content))) == shown([r.asDict() for r in whole.filter("kind <> 'journal'").collect()])
