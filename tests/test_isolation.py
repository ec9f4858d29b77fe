"""A rule that fails while it runs, and audits that keep up with changes."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import issues as I
from vellum.operators.durable import durable
from vellum.plans import audit as A
from vellum.sources.tables import blocks_of_text
from vellum.streaming import incremental as N

TEXTS = [f"Zeile {k}.. und\nTODO mehr,, davon {k}" for k in range(40)]


def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def keys(issues):
    return sorted((r.doc_id, r.rule, r.sub_check, r.loc_index or 0, r.actual) for r in issues.collect())


@pytest.mark.parametrize("bad", [[7], [3, 21], list(range(40))])
def test_a_rule_that_fails_at_some_documents(spark, monkeypatch, bad):
    def failing(t, std):
        broken = F.when(F.col("doc_id").isin(bad), F.raise_error(F.lit("no number here"))).otherwise(F.lit("fine"))
        return I.as_issues(t["body"].filter("para_index = 1"), "own", "each", "L3", "info", broken, F.col("para_index"))

    tables = {"blocks": blocks_of_text(documents(spark))}
    alone, _ = A.audit(tables, only=("L3",), profile="latin", settle=durable)
    rules = [*A.RULES, A.Rule("own", "L3", ("body",), failing)]
    monkeypatch.setattr(A, "RULES", rules)
    monkeypatch.setattr(A, "ATTEMPTS", 64 if len(bad) < 40 else 8)
    both, _ = A.audit(tables, only=("L3",), profile="latin", settle=durable)
    faults = both.filter("rule = 'audit-internal-error'").collect()
    assert sorted(r.doc_id for r in faults) == bad and {r.sub_check for r in faults} == {"own"} and all("no number here" in r.actual for r in faults)
    assert sorted(r.doc_id for r in both.filter("rule = 'own'").collect()) == [k for k in range(40) if k not in bad]
    assert keys(both.filter("rule not in ('own', 'audit-internal-error')")) == keys(alone)


def versions(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, version long, text string, deleted boolean")


def test_a_stream_of_versions_equals_an_audit_of_the_last(spark, tmp_path):
    batches = [
        [(1, 1, "a.. b", None), (2, 1, "TODO x", None), (3, 1, "fine", None), (1, 2, "a.. b\nc,, d", None)], [(2, 2, "TODO x", None), (3, 2, "now.. bad", None), (1, 1, "late..", None)],
        [(2, 3, None, True), (4, 1, None, None), (3, 3, "now.. bad", False)], [(2, 4, "back,, again", None), (1, 3, "clean", None), (3, 2, "late,, one", None)],
    ]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for k, rows in enumerate(batches):
        versions(spark, rows).coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema("doc_id long, version long, text string, deleted boolean").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    assert N.current(spark, out).count() == 0
    N.incremental_stream(stream, out, str(tmp_path / "check"), only=("L3",), profile="latin").awaitTermination()
    last = {}
    for doc_id, version, text, deleted in sorted((r for b in batches for r in b), key=lambda r: r[1]):
        last[doc_id] = None if deleted else text or ""
    whole, _ = A.audit({"blocks": blocks_of_text(spark.createDataFrame([(k, t) for k, t in last.items() if t is not None], "doc_id long, text string"))}, only=("L3",), profile="latin")
    assert keys(N.current(spark, out)) == keys(whole) and keys(whole)
    audited = {(r.doc_id, r.audited) for r in N.seen(spark, out).collect()}
    assert len([x for x in audited if x[0] == 3]) == 2 and len([x for x in audited if x[0] == 2]) == 3  # the same text isn't audited again
    N.absorb(versions(spark, batches[3]), 3, out, only=("L3",), profile="latin")  # a batch that is repeated
    assert keys(N.current(spark, out)) == keys(whole)
