"""The audit from a word-processor file to a repaired document, and the disciplines that every rule keeps."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import issues as I
from vellum.operators import repair as R
from vellum.operators import standards as S
from vellum.plans.audit import RULES, audit
from vellum.sources.docx import SCHEMAS, read_docx
from vellum.sources.tables import blocks_of_text, ignore_list, read_anchors
from vellum.streaming.audit_stream import audit_stream, documents_stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text, sup=False, size=None):
    p = ('<w:vertAlign w:val="superscript"/>' if sup else "") + (f'<w:sz w:val="{size}"/>' if size else "")
    return f'<w:r><w:rPr>{p}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def para(*runs, style=None, mark=None, extra=""):
    s = f'<w:pPr><w:pStyle w:val="{style}"/>{extra}</w:pPr>' if style or extra else ""
    m = f'<w:bookmarkStart w:id="1" w:name="{mark}"/><w:bookmarkEnd w:id="1"/>' if mark else ""
    return f"<w:p>{s}{m}{''.join(runs)}</w:p>"


FIELD = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK \\l "ref2" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>' + run("[2]", True) + '<w:r><w:fldChar w:fldCharType="end"/></w:r>'


def docx(body):
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"{" w:default=" + chr(34) + "1" + chr(34) if k == "a" else ""}><w:name w:val="{n}"/>{b}</w:style>' for k, n, b in (("a", "Normal", '<w:rPr><w:sz w:val="24"/></w:rPr>'), ("h1", "一级标题", '<w:basedOn w:val="a"/>'), ("h2", "二级标题", '<w:basedOn w:val="a"/>')))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS}><w:body>{body}<w:sectPr><w:pgSz w:w="11907" w:h="16840"/><w:pgMar w:top="1418" w:right="1418" w:bottom="1418" w:left="1701"/></w:sectPr></w:body></w:document>')
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
    return out.getvalue()


BODY = "".join((
    para(run("第1章 绪论"), style="h1"), para(run("1.2 浅析：背景"), style="h2"),
    para(run("前人指出"), '<w:hyperlink w:anchor="ref1">' + run("[1]", True) + "</w:hyperlink>", run("。后文。。错误")),
    para(run("又有"), FIELD, run("，以及"), run("[7]", False), run("；")),
    para(run("待补 一—二—三—四")),
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>单元</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
    para(run("参考文献")), para(run("[1] 甲. 题名[M]. 北京: 出版社, 2011."), mark="ref1"), para(run("[2] 乙. 题名. 刊名, 2025."), mark="ref2"),
))


@pytest.fixture(scope="module")
def relations(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docx")
    (folder / "one.docx").write_bytes(docx(BODY))
    (folder / "broken.docx").write_bytes(b"no zip")
    return read_docx(spark, f"file://{folder}")


def test_docx_relations(relations):
    assert set(relations) == set(SCHEMAS)
    runs = [(r.text, r.superscript, r.anchor, r.link_kind) for r in relations["runs"].filter("para_index in (3, 4)").orderBy("para_index", "run_ord").collect()]
    assert ("[1]", True, "ref1", "hyperlink") in runs and ("[2]", True, "ref2", "field") in runs and not any("HYPERLINK" in r[0] for r in runs)
    assert relations["blocks"].filter("kind = 'tbl'").first().text == "单元"
    assert [r.name for r in relations["bookmarks"].collect()] == ["ref1", "ref2"]
    assert round(relations["sections"].first().width_cm, 1) == 21.0
    assert relations["errors"].count() == 1


def test_audit_of_a_file(relations):
    issues, notes = audit(relations, optional=True)
    found = {(r.rule, r.sub_check, r.loc_index) for r in issues.collect()}
    for want in (("punctuation", "marks", 3), ("process-trace", "token", 5), ("dash-density", "paragraph", 5), ("heading-style", "each", 2), ("cite-form", "superscript", 4), ("cite-jump", "dangling", 4), ("ref-format", "type", 8), ("page-numbering", "no-body", 1)):
        assert want in found, want
    assert ("ref-coverage", "missing", None) in found and ("toc", "none", None) in found
    assert not any(rule == "audit-internal-error" for rule, _, _ in found)
    assert I.broken(issues).count() == 0
    assert any("page_margins_cm" in n for n in notes)
    actions = {r.action for r in issues.select("action").distinct().collect()} - {None}
    assert actions <= set(R.ACTIONS)


def test_ids_are_stable(relations):
    one, two = ({(r.issue_key, r.id) for r in audit(relations)[0].select("issue_key", "id").collect()} for _ in range(2))
    assert one == two and len({k for k, _ in one}) == len(one)


def test_repair_is_idempotent_and_ordered(relations):
    issues, _ = audit(relations)
    items = R.plan(issues, everything=True)
    runs = relations["runs"].select("doc_id", "para_index", "run_ord", "text", "superscript", "anchor", "link_kind", "size_pt", "font_ea")
    after, journal = R.apply_plan(runs, items)
    assert {r.status for r in journal.collect()} <= {"applied", "skipped"}
    assert after.filter("text = '[7]'").first().superscript
    again, second = R.apply_plan(after, items)
    assert again.exceptAll(after).count() == 0
    assert {r.status for r in second.filter("action = 'cite.superscript'").collect()} == {"skipped"}
    assert R.run_hash(after).first().sha256 != R.run_hash(runs).first().sha256
    assert R.run_hash(again).first().sha256 == R.run_hash(after).first().sha256


def test_stale_plans_are_rejected_and_versions_restored(spark, relations):
    docs = relations["blocks"].select("doc_id", "sha256").distinct()
    items = R.plan(audit(relations)[0])
    assert R.guard(items, docs, docs).count() == 0
    assert [r.reason for r in R.guard(items, docs.withColumn("sha256", F.lit("old")), docs).collect()] == ["changed document"]
    versions = spark.createDataFrame([(1, "s1", 0, "a"), (1, "s1", 1, "b"), (1, "s2", 0, "c")], "doc_id long, stamp string, dup_no int, sha256 string")
    version, after = R.rollback(versions, spark.createDataFrame([(1, "now")], "doc_id long, sha256 string"), "s1")
    assert [r.sha256 for r in version.collect()] == ["b"] and after.filter("stamp = 's1-pre-restore'").count() == 1


def test_unset_standards_judge_nothing(spark, relations):
    base = audit(relations, only=("page-setup", "header", "length"))[0]
    assert base.filter("sub_check in ('margin', 'line', 'text', 'short')").count() == 0
    strict = audit(relations, template='{"page":{"margins_cm":[9,9,9,9]},"length":{"body_min_chars":99999}}', only=("page-setup", "length"))[0]
    assert strict.filter("sub_check = 'margin'").count() == 4 and strict.filter("sub_check = 'short'").count() == 1
    assert S.for_job('{"text":{"heading_max_chars":9}}', '{"text":{"heading_max_chars":8}}')["heading_max_chars"] == 8


def test_a_broken_rule_is_an_issue(relations, monkeypatch):
    monkeypatch.setattr(RULES[0], "run", lambda t, s: 1 / 0)
    assert audit(relations, only=(RULES[0].name,))[0].first().rule == "audit-internal-error"


def test_suppression_keeps_everything(spark, relations):
    ignore = ignore_list(spark.createDataFrame([("- rule: ref-coverage",), ("# note",), ("- rule: process-trace  # why",)], "line string"))
    issues, _ = audit(relations, ignore=ignore)
    assert issues.count() == audit(relations)[0].count()
    hidden = {(r.rule, r.sub_check) for r in issues.filter("suppressed").collect()}
    assert ("process-trace", "token") in hidden and ("ref-coverage", "missing") not in hidden  # that one can't be suppressed


def test_inject_detect_fix(spark):
    docs = spark.createDataFrame([(1, "一句话。\n又一句。")], "doc_id long, text string")
    clean = audit({"blocks": blocks_of_text(docs)}, only=("L3",))[0].count()
    dirty = docs.withColumn("text", F.concat("text", F.lit("。。")))
    assert clean == 0 and audit({"blocks": blocks_of_text(dirty)}, only=("L3",))[0].count() == 1


def test_reports_and_tallies(relations):
    issues, _ = audit(relations)
    n = issues.count()
    t = {(r.dimension, r.value): r.n for r in I.tallies(issues).collect()}
    assert t["all", ""] == n == sum(v for (d, _), v in t.items() if d == "severity")
    assert I.markdown(issues).first().report.startswith(f"# {n} findings")
    ranks = [("error", "warn", "info").index(r.severity) for r in I.in_order(issues).collect()]
    assert ranks == sorted(ranks)


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "two,, marks"), (2, "clean")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = documents_stream(spark, f"{tmp_path}/in", "doc_id long, text string")
    audit_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]


def test_anchors_file(spark, tmp_path):
    (tmp_path / "anchors.yaml").write_text("A1_topic:\n  tokens: [甲, 乙]\nA2_concept:\n  thesis_heading: 概念\n", "utf-8")
    rows = {(r.section, r.field): r.tokens for r in read_anchors(spark, f"{tmp_path}/anchors.yaml").collect()}
    assert rows["A1_topic", "tokens"] == ["甲", "乙"] and rows["A2_concept", "thesis_heading"] == ["概念"]
