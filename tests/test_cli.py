"""From files to findings, an edited plan, repaired files, and back."""

import json
import pathlib

from pyspark.sql import functions as F

from tests.test_audit import BODY, docx, para, run
from vellum import cli
from vellum.operators import repair as R
from vellum.sinks.versions import Versions
from vellum.sources import docx as D


def state(spark, work, name="state"):
    versions = Versions(spark, f"{work}/versions")
    return versions.table(versions.read(), name)


def hashes(spark, work):
    return {r.doc_id: r.sha256 for r in R.state_hash(state(spark, work)).collect()}


def test_audit_apply_list_rollback(spark, tmp_path, capsys):
    docs, work = tmp_path / "docs", f"{tmp_path}/work"
    docs.mkdir()
    (docs / "one.docx").write_bytes(docx(BODY))
    (docs / "broken.docx").write_bytes(b"none")
    assert cli.main(["audit", f"file://{docs}", work], spark) == 0
    said = capsys.readouterr().out
    assert "not judged" in said and "not read: file:" in said
    assert cli.main(["audit", f"file://{docs}", work], spark) == 0  # a second time in the same folder
    capsys.readouterr()
    plans = list((tmp_path / "work" / "plans").glob("*.yaml"))
    assert len(plans) == 1 and "enabled: true" in plans[0].read_text("utf-8")
    before, original = hashes(spark, work), (docs / "one.docx").read_bytes()
    assert cli.main(["apply", work, "--dry-run", "--stamp", "s0"], spark) == 0
    assert hashes(spark, work) == before and not (tmp_path / "work" / "documents").exists()
    assert cli.main(["apply", work, "--stamp", "s1"], spark) == 0 and "applied" in capsys.readouterr().out
    assert state(spark, work).filter("kind = 'run' and text = '[7]'").first().superscript
    # the repaired file is a file, and what it holds is the state; the one that was audited is as it was
    (fixed,) = (tmp_path / "work" / "documents").glob("one.*.docx")
    again = D.relations_of(spark.createDataFrame([(r.path, bytearray(fixed.read_bytes())) for r in state(spark, work, "documents").collect()], "path string, content binary"))
    assert {r.doc_id: r.sha256 for r in R.state_hash(cli.parts(again)).collect()} == hashes(spark, work) != before
    assert (docs / "one.docx").read_bytes() == original
    # the plan was made for the document as it was
    assert cli.main(["apply", work, "--stamp", "s2"], spark) == 2 and "failed: changed document" in capsys.readouterr().out
    assert cli.main(["apply", work, "--lenient", "--stamp", "s3"], spark) == 0
    assert not state(spark, work, "journal").filter(F.col("status") == "applied").count()
    capsys.readouterr()
    assert cli.main(["list", work], spark) == 0 and capsys.readouterr().out.split("\n")[:-1] == ["5 apply s3 0", "4 apply s2 0", "3 apply s1 1", "2 audit", "1 audit"]
    assert cli.main(["rollback", work, "s1"], spark) == 0
    assert hashes(spark, work) == before and fixed.read_bytes() == original
    assert cli.main(["rollback", work, "never"], spark) == 0 and hashes(spark, work) == before


def test_edits_build_on_repaired_files(spark, tmp_path):
    docs, work = tmp_path / "docs", f"{tmp_path}/work"
    docs.mkdir()
    (docs / "one.docx").write_bytes(docx(BODY))
    cli.run_audit(spark, f"file://{docs}", work)
    cli.run_apply(spark, work, "s1")
    (plan,) = pathlib.Path(f"{work}/plans").glob("*.yaml")
    plan.write_text(plan.read_text("utf-8").replace("enabled: false", "enabled: true"), "utf-8")
    journal, _ = cli.run_apply(spark, work, "s2", lenient=True)
    done = journal.filter("status = 'applied'").count()
    (fixed,) = (tmp_path / "work" / "documents").glob("one.*.docx")
    texts = [r["text"] for k, r in D.parsed(fixed.read_bytes()) if k == "runs"]
    assert "[7]" in texts and done + journal.filter("status = 'skipped: in ledger'").count() + journal.filter("status like 'failed%' or status = 'skipped'").count() == journal.count()
    (again,) = [r["superscript"] for k, r in D.parsed(fixed.read_bytes()) if k == "runs" and r["text"] == "[7]"]
    assert again


def test_proposals_anchors_terms_and_choice_of_rules(spark, tmp_path, capsys):
    docs, plans, work = tmp_path / "docs", tmp_path / "plans", tmp_path / "work"
    docs.mkdir()
    plans.mkdir()
    (docs / "one.docx").write_bytes(docx(para(run("完成访谈 15 人，农村与乡村")) + BODY))
    (plans / "one.docx").write_bytes(docx(para(run("题目《乡村教育》，计划访谈 30-40人，不少于 9 条"))))
    (tmp_path / "anchors.yaml").write_text("A1_topic: {tokens: [绪论]}\n", "utf-8")
    (tmp_path / "terms.yaml").write_text("rural: [农村, 乡村]\n", "utf-8")

    def issues(*more):
        assert cli.main(["audit", f"file://{docs}", str(work), *more], spark) == 0
        (file,) = (work / "audit").glob("*.json")
        return {(i["rule"], i["sub_check"]) for i in json.loads(file.read_text("utf-8"))["issues"]}

    every = issues()
    assert not any(r == "prop-consistency" for r, _ in every) and "not run: prop-consistency" in capsys.readouterr().out
    for proposal in (plans, plans / "one.docx"):
        found = issues("--proposal", f"file://{proposal}", "--anchors", f"file://{tmp_path}/anchors.yaml", "--only", "prop-consistency")
        assert {r for r, _ in found} == {"prop-consistency"}
    assert issues("--terms", f"file://{tmp_path}/terms.yaml", "--only", "term-consistency") == {("term-consistency", "variants")}
    assert {r for r, _ in issues("--only", "L2,toc")} <= {r for r, _ in every} and not any(r.startswith("heading") for r, _ in issues("--only", "L2,toc"))
