"""Styles as graphs that are deep, circular or linked both ways."""

from vellum.operators import styles as Y

SCHEMA = "doc_id long, style_id string, based_on string, link string, is_default boolean, size_pt double, font_ea string"


def test_long_chains_and_circles(spark):
    rows = [(1, f"s{k}", f"s{k - 1}" if k else None, None, k == 0, 12.0 if k == 0 else None, "宋体" if k == 40 else None) for k in range(200)]
    rows += [(2, "a", "b", None, False, None, None), (2, "b", "a", None, False, 9.0, None), (2, "c", "gone", None, False, None, None)]
    got = {(r.doc_id, r.style_id): (r.size_pt, r.font_ea) for r in Y.inherited(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, "s199"] == (12.0, "宋体") and got[1, "s39"] == (12.0, None) and got[2, "a"] == (9.0, None) and got[2, "c"] == (None, None)


def test_mutual_links_cost_nothing(spark):
    rows = [(d, f"s{k}", f"s{k - 1}" if k else None, f"s{k + 1 - 2 * (k % 2)}", k == 0, None, None) for d in range(20) for k in range(160)]
    styles = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([(0, "s24")], "doc_id long, style_id string")
    dead = {(r.doc_id, r.style_id) for r in Y.dead(styles, wanted).collect()}
    assert {s for d, s in dead if d == 0} == {f"s{k}" for k in range(26, 160)} and {s for d, s in dead if d == 7} == {f"s{k}" for k in range(2, 160)}
    kept, numbering = Y.pruned(styles, wanted)
    assert kept.filter("doc_id = 0 and not hidden").count() == 2 and numbering.count() == 0


def test_numbering_goes_with_its_styles(spark):
    styles = spark.createDataFrame([(1, "a", None, None, True, None, None, "1"), (1, "b", None, None, False, None, None, "2")], SCHEMA + ", num_id string")
    numbering = spark.createDataFrame([(1, "1", "7"), (1, "2", "8")], "doc_id long, num_id string, abstract_id string")
    wanted = spark.createDataFrame([], "doc_id long, style_id string")
    assert [r.num_id for r in Y.pruned(styles, wanted, numbering)[1].collect()] == ["1"]
