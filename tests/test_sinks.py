"""Files that are written and read again: documents, audits, plans, specifications, templates."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import repair as R
from vellum.operators import templates as TP
from vellum.sinks import docx as X
from vellum.sinks import reports as P
from vellum.sources import docx as D
from vellum.sources import tables as B

PARAS = [(1, 1, "一级标题", None), (1, 2, "Normal", "bottom=single,6"), (1, 3, None, None), (2, 1, "Normal", None)]
RUNS = [
    (1, 1, 0, "第1章 绪论", False, None, None, 16.0, "黑体", "Arial", True), (1, 2, 0, "前人指出", False, None, None, None, None, None, None), (1, 2, 1, "[1]", True, "ref1", "hyperlink", None, None, None, None),
    (1, 2, 2, "[2]", True, "ref 2", "field", 9.5, None, None, False), (1, 3, 0, " 有空 格\t<&> ", False, None, None, None, None, None, None), (2, 1, 0, "另一篇", False, None, None, None, None, None, None),
]
RUN = "doc_id long, para_index int, run_ord int, text string, superscript boolean, anchor string, link_kind string, size_pt double, font_ea string, font_ascii string, bold boolean"
STYLES = [(d, s, n, b, s == "a", z) for d in (1, 2) for s, n, b, z in (("a", "Normal", None, 12.0), ("h", "一级标题", "a", 16.0))]


@pytest.fixture(scope="module")
def relations(spark):
    paras = spark.createDataFrame(PARAS, "doc_id long, para_index int, style_name string, border string")
    runs = spark.createDataFrame(RUNS, RUN)
    styles = spark.createDataFrame(STYLES, "doc_id long, style_id string, name string, based_on string, is_default boolean, size_pt double").withColumns({"space_after_pt": F.lit(6.0), "align": F.lit("center"), "first_line_indent_chars": F.lit(2.0), "line_spacing": F.lit(1.5)})
    sections = spark.createDataFrame([(1, 1, 2, "upperRoman", True, "论文", 21.0, 29.7), (1, 2, None, "decimal", True, None, 21.0, 29.7)], "doc_id long, section_index int, last_para int, page_fmt string, has_pgnumtype boolean, header_text string, width_cm double, height_cm double")
    marks = spark.createDataFrame([(1, 3, "ref1"), (1, 3, "ref 2")], "doc_id long, para_index int, name string")
    return paras, runs, styles, sections, marks


@pytest.fixture(scope="module")
def read_again(spark, relations, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docx"))
    files = X.as_files(*relations).withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".docx")))
    assert X.save_files(files, folder) == 2 and X.save_files(files, folder) == 2
    return D.read_docx(spark, folder)


def test_documents_come_back(read_again):
    known = {r.doc_id: r.path[-7:-5] for r in read_again["blocks"].select("doc_id", "path").distinct().collect()}
    number = lambda r: int(known[r.doc_id][-1])
    assert read_again["errors"].count() == 0
    got = sorted((number(r), r.para_index, r.run_ord, r.text, r.superscript, r.anchor, r.link_kind, r.size_pt, r.font_ea, r.font_ascii, r.bold) for r in read_again["runs"].collect())
    assert got == sorted(RUNS)
    blocks = sorted((number(r), r.para_index, r.style_name, r.border) for r in read_again["blocks"].collect())
    assert blocks == sorted(PARAS)
    assert sorted(r.name for r in read_again["bookmarks"].collect()) == ["ref 2", "ref1"]
    style = read_again["styles"].filter("name = '一级标题'").first()
    assert (style.based_on, style.size_pt, style.space_after_pt, style.line_spacing, style.first_line_indent_chars, style.align) == ("a", 16.0, 6.0, 1.5, 2.0, "center")
    sections = {(number(r), r.section_index): r for r in read_again["sections"].collect()}
    assert sections[1, 1].page_fmt == "upperRoman" and sections[1, 1].header_text == "论文" and sections[1, 2].page_fmt == "decimal" and round(sections[1, 1].width_cm, 1) == 21.0
    assert read_again["blocks"].filter("ends_section").count() == 1


def test_tallies_of_documents(read_again):
    uses = {r.anchor: (r.uses, r.there) for r in D.anchor_tally(read_again["runs"], read_again["bookmarks"]).collect()}
    assert uses == {"ref1": (1, True), "ref 2": (1, True)}
    s = {r.paragraphs: r for r in D.summary(read_again).collect()}
    assert s[3].images == 0 and s[3].sections == 2 and s[3].bookmarks == 2 and s[1].tables == 0 and "一级标题" in s[3].styles_used
    assert D.used_styles(read_again["styles"], read_again["blocks"]).count() == 3


def test_link_fields():
    assert D.linked_place(' HYPERLINK \\l "a b" ') == "a b" and D.linked_place("hyperlink \\h \\l ref1") == "ref1" and D.linked_place('HYPERLINK "http://x" \\t "_top"') is None
    assert D.linked_place("PAGEREF _Toc1 \\h") is None and D.linked_place("HYPERLINK \\l") is None and D.linked_place("") is None


def test_proposal_text(spark):
    blocks = spark.createDataFrame([(1, 3, "p", "尾"), (1, 1, "tbl", "x"), (1, 2, "p", "论文提纲")], "doc_id long, ord int, kind string, text string")
    cells = spark.createDataFrame([(1, 1, 0, 0, "题目"), (1, 1, 0, 1, "乡村\n教育"), (1, 1, 1, 0, "计划")], "doc_id long, ord int, row int, col int, text string")
    assert D.proposal_text(blocks, cells).first().text == "题目 | 乡村\n教育\n计划\n论文提纲\n尾"


def plan(spark):
    items = [
        ("k1", 2, "cite.superscript", {"on": "false", "run_ord": "1"}), ("k2", 1, "para.style", {"style": "Normal"}), ("k3", 3, "para.border", {"edge": "top"}), ("k4", 2, "ref.bookmark", {"name": "ref9"}),
        ("k5", 3, "para.merge_into", {"target": "1"}), ("k6", 1, "para.insert_after", {"text": "新段", "style": "Normal"}), ("k7", 2, "cite.link", {"anchor": "ref9", "run_ord": "1"}), ("k8", 2, "cite.link", {"anchor": "nowhere", "run_ord": "2"}),
        ("k9", 7, "para.delete", {}), ("l0", 1, "run.font", {"font": "宋体", "bold": "false"}), ("l1", 2, "run.clear_size", {"run_ord": "2"}), ("l2", 1, "para.border", {"part": "header"}), ("l3", 2, "cite.size", {}), ("l4", 2, "para.fold", {}),
    ]
    rows = [(1, k, a, i, p, True) for k, i, a, p in items if a != "para.fold"]
    return spark.createDataFrame(rows, "doc_id long, issue_key string, action string, loc_index int, params map<string,string>, enabled boolean")


def test_every_action_does_what_it_says(spark, relations):
    paras, runs, _, _, marks = relations
    out = R.edited(R.parts_of(runs, paras, marks), plan(spark)).collect()
    status = {r.issue_key: r.status for r in out if r.kind == "journal"}
    failed = {k: v for k, v in status.items() if v != "applied"}
    assert failed == {"k8": "failed: no such bookmark", "k9": "failed: no such paragraph", "l3": "failed: KeyError"}
    run = {(r.para_index, r.run_ord): r for r in out if r.kind == "run" and r.doc_id == 1}
    # the third paragraph went into the first, behind what that had; a new one stands behind it
    assert [run[1, k].text for k in (0, 1)] == ["第1章 绪论", " 有空 格\t<&> "] and run[2, 0].text == "新段" and run[1, 0].font_ea == "宋体" and run[1, 0].bold is False
    assert run[3, 1].superscript is False and run[3, 1].anchor == "ref9" and run[3, 2].size_pt is None and run[3, 2].anchor == "ref 2"
    para = {r.para_index: r for r in out if r.kind == "para" and r.doc_id == 1}
    assert para[1].style_name == "Normal" and para[2].style_name == "Normal" and para[3].border == "bottom=single,6" and len(para) == 3
    assert {(r.name, r.para_index) for r in out if r.kind == "bookmark"} == {("ref9", 3), ("ref1", 1), ("ref 2", 1)}
    assert [r.border for r in out if r.kind == "header"] == ["bottom=single,6"]


def test_merging_keeps_the_order_of_the_document(spark, relations):
    paras, runs, _, _, marks = relations
    items = spark.createDataFrame([(1, "a", "para.merge_into", 1, {"target": "3"}, True), (1, "b", "para.delete", 0, {}, True)], "doc_id long, issue_key string, action string, loc_index int, params map<string,string>, enabled boolean")
    out = R.edited(R.parts_of(runs, paras, marks), items).collect()
    assert [r.text for r in sorted((r for r in out if r.kind == "run" and r.doc_id == 1 and r.para_index == 2), key=lambda r: r.run_ord)] == ["第1章 绪论", " 有空 格\t<&> "]
    assert {r.issue_key: r.status for r in out if r.kind == "journal"} == {"a": "applied", "b": "failed: no such paragraph"}


def test_guarded_apply(spark, relations):
    paras, runs, _, _, marks = relations
    parts, items = R.parts_of(runs, paras, marks), plan(spark).filter("issue_key in ('k1', 'k4', 'k6', 'k9')")
    heads = R.state_hash(parts)
    dry = R.apply(parts, items, heads, "s1", dry_run=True)
    assert {r.status for r in dry.journal.collect()} == {"applied", "failed: no such paragraph"} and dry.parts is parts and dry.snapshots.count() == 0
    one = R.apply(parts, items, heads, "s1")
    assert R.state_hash(one.parts).exceptAll(heads).count() == 1 and one.snapshots.select("doc_id", "stamp").distinct().count() == 1 and one.ledger.count() == 3
    stale = R.apply(one.parts, items, heads, "s2", one.ledger, one.snapshots)
    assert {r.status for r in stale.journal.collect()} == {"failed: changed document"} and R.state_hash(stale.parts).exceptAll(R.state_hash(one.parts)).count() == 0
    again = R.apply(one.parts, items, R.state_hash(one.parts), "s2", one.ledger, one.snapshots)
    assert {r.issue_key: r.status for r in again.journal.collect()} == {"k1": "skipped: in ledger", "k4": "skipped: in ledger", "k6": "skipped: in ledger", "k9": "failed: no such paragraph"}
    assert R.state_hash(again.parts).exceptAll(R.state_hash(one.parts)).count() == 0 and again.snapshots.count() == one.snapshots.count()
    back, kept = R.rollback(one.snapshots, one.parts.filter("doc_id = 1"), "s1")
    assert R.state_hash(back.drop("stamp", "dup_no")).exceptAll(heads).count() == 0 and kept.filter("stamp = 's1-pre-restore'").count() > 0
    assert [(r.stamp, r.dup_no) for r in R.listed(kept).collect()] == [("s1-pre-restore", 0), ("s1", 0)]


def test_files_are_written_by_executors(spark, tmp_path):
    files = spark.range(20).select(F.format_string("f%d.bin", "id").alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")).repartition(3)
    for _ in range(2):
        assert X.write_files(files, f"{tmp_path}/deep/er") == 20
    assert {p.name: p.read_bytes() for p in (tmp_path / "deep" / "er").iterdir() if p.suffix == ".bin"} == {f"f{k}.bin": str(k).encode() for k in range(20)}
    assert not list((tmp_path / "deep" / "er").glob(".*.part")) and X.write_files(files.limit(0), f"{tmp_path}/none") == 0


ISSUES = [(1, "i1", "cite-form", "error", 5, "cite.superscript", {"on": "true"}), (1, "i2", "toc", "warn", None, None, {}), (2, 'odd "key"', "dash", "info", 3, "para.delete", {})]


def issues(spark):
    df = spark.createDataFrame(ISSUES, "doc_id long, issue_key string, rule string, severity string, loc_index int, action string, params map<string,string>")
    more = ("id", "sub_check", "layer", "skill", "loc_kind", "excerpt", "expected", "actual", "standard_source")
    return df.withColumns({c: F.lit(f"{c} of it") for c in more} | {"suppressible": F.lit(True)})


def test_audit_files(spark, tmp_path):
    made = P.audit_json(issues(spark))
    assert [i["issue_key"] for i in json.loads(made.filter("doc_id = 1").first().json)["issues"]] == ["i1", "i2"]
    X.save_files(made.select(F.format_string("%d.json", "doc_id").alias("name"), F.encode("json", "utf-8").alias("content")), f"{tmp_path}/audit")
    back = P.read_audits(spark, f"{tmp_path}/audit/*.json")
    cols = ["doc_id", "issue_key", "rule", "severity", "loc_index", "action", "excerpt"]
    plain = lambda df: sorted(map(str, df.select(cols).collect()))
    assert plain(back) == plain(issues(spark).withColumn("excerpt", F.lit("excerpt of it")))


def test_plan_files(spark, tmp_path):
    items = R.plan(issues(spark))
    heads = spark.createDataFrame([(1, "aa"), (2, None), (3, "cc")], "doc_id long, sha256 string")
    made = P.plan_yaml(items, heads)
    text = made.filter("doc_id = 1").first().yaml
    assert "enabled: true" in text and "params" not in text
    edited = made.withColumn("yaml", F.when(F.col("doc_id") == 1, F.replace("yaml", F.lit("enabled: true"), F.lit("enabled: false  # no"))).otherwise(F.col("yaml")))
    broken = spark.createDataFrame([("items: [",), ("- a",), (None,)], "yaml string")
    rows = {(r.doc_id, r.issue_key): (r.sha256, r.enabled) for r in P.toggles_of_yaml(edited.select("yaml").union(broken)).collect()}
    assert rows == {(1, "i1"): ("aa", False), (2, 'odd "key"'): (None, False), (3, None): ("cc", False)}
    known = P.items_of(P.toggles_of_yaml(edited), issues(spark).filter("doc_id = 1")).collect()
    assert {r.issue_key: (r.action, r.stale) for r in known} == {"i1": ("cite.superscript", False), 'odd "key"': (None, True)}


def test_specs_and_anchors_are_looked_for(spark, tmp_path):
    assert B.find_spec(spark, str(tmp_path)) is None and B.load_spec(spark, None) is None and B.load_spec(spark, f"{tmp_path}/no.json") is None
    (tmp_path / "spec.json").write_text('{"a": 1}', "utf-8")
    assert B.find_spec(spark, str(tmp_path)) == f"{tmp_path}/spec.json" and json.loads(B.load_spec(spark, f"{tmp_path}/spec.json")) == {"a": 1}
    (tmp_path / "paper-spec.json").write_text("{}", "utf-8")
    assert B.find_spec(spark, str(tmp_path)).endswith("paper-spec.json")
    (tmp_path / "default.yaml").write_text("A1_topic:\n  tokens: [甲, '', ' 乙 ']\nodd: 3\nA2_concept: {thesis_heading: }\n", "utf-8")
    assert B.find_anchors(spark, None, f"{tmp_path}/none.yaml", str(tmp_path), f"{tmp_path}/default.yaml") == f"{tmp_path}/default.yaml"
    assert [(r.section, r.field, r.tokens) for r in B.read_anchors(spark, f"{tmp_path}/default.yaml").collect()] == [("A1_topic", "tokens", ["甲", "乙"])]
    assert B.read_anchors(spark, None).count() == 0


def test_states_of_templates(spark):
    templates = spark.createDataFrame([("new", None, None), ("asked", "draft", 2), ("fell", "applied", 1), ("fine", "draft", 0), ("odd", "confirmed", 0)], "template string, status string, open_questions int")
    wanted = spark.createDataFrame([("asked", "confirmed"), ("fine", "applied"), ("odd", "lost")], "template string, status string")
    assert {r.template: (r.status, r.refused) for r in TP.advanced(templates, wanted).collect()} == {"new": ("draft", False), "asked": ("draft", True), "fell": ("draft", False), "fine": ("applied", False), "odd": ("confirmed", True)}


def test_a_template_is_built_from_a_specification(spark, tmp_path):
    spec = {"styles": {"body": {"name": "正文", "size_pt": 12.0, "font_cn": "宋体", "line_spacing": 1.5}, "h1": {"name": "一级标题", "based_on": "正文", "size_pt": 16.0, "bold": True}}}
    styles = TP.styles_of_spec(spark.createDataFrame([(1, json.dumps(spec))], "doc_id long, spec string"))
    paras, runs = TP.sample_paragraphs(styles)
    X.save_files(X.as_files(paras, runs, styles).select(F.lit("template.docx").alias("name"), "content"), str(tmp_path))
    back = D.read_docx(spark, str(tmp_path))
    got = {r.name: (r.based_on, r.size_pt, r.font_ea, r.bold, r.is_default, r.outline_level, r.line_spacing) for r in back["styles"].collect()}
    assert got == {"正文": (None, 12.0, "宋体", None, True, None, 1.5), "一级标题": ("正文", 16.0, None, True, False, 0, None)}
    assert {r.style_name: r.text for r in back["blocks"].collect()} == {"正文": "正文", "一级标题": "一级标题"}
    lines = TP.constraints(spark.createDataFrame([(1, "page_size", "A4", "default"), (1, "body_size_pt", "12", "template"), (1, "header_rule", None, None)], "doc_id long, key string, value string, source string")).first().text
    assert lines == "# Constraints\n- body size pt: 12\n- page size: A4 (by default)"


def test_cards_as_a_report(spark):
    cards = spark.createDataFrame([(1, "A2", "pending", "same?", "前文", None, "概念", 3), (1, "A6", "undecidable", "same?", None, None, None, None)], "doc_id long, anchor string, verdict string, question string, proposal_excerpt string, thesis_excerpt string, thesis_heading string, para_index int")
    assert P.evidence(cards).first().report == "## A2 (pending)\nsame?\n> 前文\n> -\n@3 概念\n\n## A6 (undecidable)\nsame?\n> -\n> -\n"


def test_unions_are_gathered_whole(spark):
    """Parts of a union that were dealt out by document before meet whole, however adaptive execution joins their partitions."""
    ids = spark.range(600).select(F.col("id").alias("doc_id"))
    runs = ids.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("para_index"), F.lit(0).alias("run_ord"), F.lit("text").alias("text"))
    paras, marks = ids.select("doc_id", F.lit(1).alias("para_index"), F.lit("Normal").alias("style_name")), ids.select("doc_id", F.lit(1).alias("para_index"), F.lit("m").alias("name"))
    parts = R.parts_of(runs, paras, marks)
    some = ids.filter("doc_id % 2 = 0").withColumn("k", F.rand(3)).repartition(3, "doc_id").select("doc_id")
    joined = parts.join(some.hint("merge"), "doc_id", "left_semi")
    whole, part = ({r.doc_id: r.sha256 for r in R.state_hash(p).collect()} for p in (parts, joined))
    assert R.state_hash(joined).count() == 300 and part == {i: h for i, h in whole.items() if i % 2 == 0}
    items = ids.select("doc_id", F.col("doc_id").cast("string").alias("issue_key"), F.lit("para.delete").alias("action"), F.lit(2).alias("loc_index"), F.lit(None).cast("map<string,string>").alias("params"), F.lit(True).alias("enabled"))
    out = R.edited(joined, items.join(some.hint("merge"), "doc_id", "left_semi"))
    assert out.filter("kind = 'journal' and status = 'applied'").count() == 300 and out.filter("kind = 'run'").count() == 1200
