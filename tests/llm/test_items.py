"""Test items of several texts or none's id, and rows that share an id."""

import numpy as np

from vellum.llm import decontaminate

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
ONE = " ".join(f"alpha{k}" for k in range(20))
TWO = " ".join(f"beta{k}" for k in range(20))
LARGE = (1 << 53) + 1


def test_every_text_of_an_item_is_searched(spark):
    docs = spark.createDataFrame([(1, f"x {ONE} y"), (2, f"x {TWO} y"), (3, "nothing of it")], DOCS)
    items = spark.createDataFrame([(LARGE, ONE), (LARGE, TWO), (LARGE, TWO), (LARGE, None)], ITEMS)
    assert sorted((r.doc_id, r.item_id, r.matched) for r in decontaminate.overlaps(docs, items).collect()) == [(1, LARGE, 20), (2, LARGE, 20)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, f"x {ONE} y"), (2, f"x {TWO} {ONE}")], DOCS)
    items = spark.createDataFrame([(None, ONE), (None, " ".join(TWO.split()[:15])), (LARGE, TWO)], ITEMS)
    out = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(docs, items).collect()}
    assert out == {(1, None): 20, (2, None): 20, (2, LARGE): 20}
    assert decontaminate.clean(docs, items).count() == 0


def test_many_texts_of_an_item_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(12)], DOCS)
    items = docs.selectExpr("7L AS item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()) == [(k, 7) for k in range(12)]


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(5, f"x {ONE} y"), (5, "clean text"), (None, f"z {ONE} y"), (None, "also clean"), (None, None), (6, None)]
    rest = decontaminate.clean(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, ONE)], ITEMS)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in rest) == [(0, ""), (0, "also clean"), (5, "clean text"), (6, "")]


def test_a_verbatim_part_counts_whatever_follows():
    """14 equal words before a tail of which 70 % are equal, against all stretches."""
    rng, found, want = np.random.default_rng(11), 0, 0
    for n in [200] * 60 + [30] * 60:
        equal = np.concatenate((np.ones(14 * (n > 100), bool), rng.random(n) < 0.7))
        item = np.arange(len(equal))
        got = decontaminate.overlap(np.where(equal, item, -1), item, 0)
        count = np.concatenate(([0], np.cumsum(equal)))
        exists = any(count[b] - count[a] >= 13 and count[b] - count[a] >= 0.75 * (b - a) for a in range(len(equal)) for b in range(a + 13, len(equal) + 1))
        assert (got is not None) == exists
        if got:
            same, length, start = got
            assert same >= 13 and same >= 0.75 * length and same == equal[start : start + length].sum()
        found, want = found + (got is not None), want + exists
    assert found == want >= 60


def test_the_share_is_exact():
    equal = np.array(([True] * 3 + [False]) * 6)
    assert decontaminate.fullest_stretch(equal) == (0, 23)
    assert decontaminate.fullest_stretch(np.zeros(5, bool)) == (0, 0)


def test_items_that_are_too_short_are_named(spark):
    items = spark.createDataFrame([(1, "one two"), (2, None), (None, "a b c d"), (3, "a b c d e")], "item_id long, text string")
    assert sorted((r.item_id or 0, r.n_words) for r in decontaminate.not_searched(items).collect()) == [(0, 4), (1, 2), (2, 0)]


def test_hits_of_equal_words_are_found_at_once():
    import time

    import numpy as np

    words = np.full(3000, 7, np.uint64)
    index = decontaminate.Index({0: words})
    start = time.process_time()
    hits = index.hits(words)
    assert {d for _, d in hits} == set(range(-2994, 2995)) and time.process_time() - start < 20
    assert index.hits(words, most=1000) == hits
