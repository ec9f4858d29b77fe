"""Files are made and read many at a time, and once each; figures of each document stay what they were."""

import pandas as pd
import pytest

from vellum.functions.batches import lots
from vellum.plans import file_queries as Q
from vellum.plans import generated as G
from vellum.sinks import docx as X
from vellum.sinks import patch
from vellum.sinks import pdf as PX
from vellum.sources import docx as S
from vellum.sources import pdf as PS

RUN = {c: None for c in X.TAKEN["run"]} | {"para_index": 1, "run_ord": 0, "text": "文", "superscript": False}
FILE = X.file_of({kind: [] for kind in X.TAKEN} | {"run": [RUN]})


def test_lots_hold_no_more_than_asked():
    assert [len(t) for t in lots(((k,) for k in range(10)), ["k"], 4)] == [4, 4, 2]
    assert list(lots([], ["k"])) == []


def test_rows_of_many_files_come_in_one_table():
    files = pd.DataFrame({"path": [str(k) for k in range(50)], "content": [FILE] * 49 + [b"odd"]})
    tables = list(S.rows_of(iter([files]), {"runs"}))
    assert len(tables) == 1 and list(tables[0]["kind"]) == ["runs"] * 49 + ["errors"]


@pytest.mark.parametrize("made", [lambda spark: X.as_files(*[spark.sql("SELECT 1L AS doc_id, 1 AS para_index, 0 AS run_ord, 'a' AS text, false AS superscript, 's' AS style_name, 's' AS style_id, 's' AS name")] * 3), lambda spark: PX.as_pages(spark.sql("SELECT 1L AS doc_id, 0 AS ord, 'a' AS text, 'F' AS font, 9D AS size, false AS bold, 0D AS x0, 9D AS x1, 99D AS page_width"))])
def test_a_document_is_no_call_of_its_own(spark, made):
    files = made(spark)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert files.count() == 1


def test_numbers_are_worked_out_by_compiled_code(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    df = G.Made(4, {"x": "k * 10", "y": G.NULL_S}, "k > doc_id").df(spark, str(tmp_path))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(0, 10, None), (0, 20, None), (0, 30, None), (1, 20, None), (1, 30, None), (2, 30, None)]


def test_relations_named_together_are_parsed_once(spark):
    files = spark.createDataFrame([(7, bytearray(FILE))], "doc_id long, content binary")
    of = Q.parsed_once(files, "blocks", "runs")
    assert set(of) == {"blocks", "runs"}
    assert all("MapInPandas" not in df._jdf.queryExecution().executedPlan().toString() for df in of.values())
    assert [r["doc_id"] for r in of["runs"].collect()] == [7]


def test_one_table_of_repaired_files(spark):
    files = spark.range(1, 4, 1, 1).selectExpr("id AS doc_id", "string(id) AS path", "CAST('odd' AS binary) AS content")
    items = spark.createDataFrame([], "doc_id long, issue_key string, loc_index int, action string, enabled boolean, params map<string,string>")
    assert sorted((r["doc_id"], bytes(r["content"]), r["journal"]) for r in patch.repaired(files, items).collect()) == [(k, b"odd", []) for k in (1, 2, 3)]


def test_tokens_of_plain_and_odd_spelling():
    data = b"/Na#20me /Plain<</A 1/B -2.5>>[12 0 R<41 4>(a(b)\\051) +5 .5 5. true null%c >> 9\n]Tj T* <4142>< > /"
    lexer, out = PS.Lexer(data), []
    with pytest.raises(EOFError):
        while True:
            out.append(lexer.next())
    assert out == ["Na me", "Plain", {"A": 1, "B": -2.5}, [PS.Ref(12), b"A@", b"a(b))", 5, 0.5, 5.0, True, None], b"Tj", b"T*", b"AB", b"", ""]
    assert [type(x) for x in out[2].values()] == [int, float]


def test_fonts_share_one_character_map(monkeypatch):
    seen = []
    monkeypatch.setattr(PS, "character_map", lambda data, real=PS.character_map: seen.append(1) or real(data))
    spans = [{"text": "ab", "font": f, "size": 9.0, "bold": b, "x0": 0.0, "x1": 18.0, "page_width": 99.0} for f in "FG" for b in (True, False)]
    assert [s["text"] for s in PS.spans_of(PX.page_file(spans))] == ["ab"] * 4
    assert len(seen) == 1
