"""What is held: on disk, no round of links but the last; by the driver, no object for each row of the language model."""

from pathlib import Path

from vellum.llm import components as C
from vellum.llm import langid
from vellum.llm.common import Scratch


def test_rounds_of_links_are_dropped(spark, monkeypatch):
    made = []

    class Noted(Scratch):
        def __init__(self, spark):
            super().__init__(spark)
            made.append(self)

    monkeypatch.setattr(C, "Scratch", Noted, raising=False)
    chain = spark.range(20).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in C.components(chain).collect()} == {0}
    assert len(made) == 1
    assert len(list(Path(made[0].root.removeprefix("file:")).iterdir())) == 1


def test_model_is_fitted_without_collecting_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, lang) for k in range(12) for t, lang in (("das ist gut", "de"), ("this is good", "en"))], "doc_id long, text string, lang string")

    def none(self):
        raise AssertionError("rows were collected")

    monkeypatch.setattr(type(docs), "collect", none)
    model = langid.fit(docs)
    assert model.langs == ["de", "en"] and model.words == sorted(model.words) and {"das", "this"} <= set(model.words)
    assert model.predict("das gut")[0] == "de" and model.predict("this good")[0] == "en"
