"""Repeated passages without stops."""

import numpy as np

from vellum.llm import sentence_spans


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 10**9, n)]


def test_every_passage_without_stops_holds_a_span(spark):
    """51 words within longer runs of words; the second copy goes but for its ends."""
    rng, rows = np.random.default_rng(9), []
    for k in range(400):
        passage = words(rng, 51)
        for copy in range(2):
            before, behind = (words(rng, int(n)) for n in rng.integers(0, 40, 2))
            rows.append((2 * k + copy, " ".join([*before, *passage, *behind]), len(before), len(behind)))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out = {r.doc_id: r for r in sentence_spans.without_repeats(table, window=sentence_spans.WINDOW).collect()}
    for doc, text, before, behind in rows:
        rest = out[doc].text.split()
        if doc % 2 == 0:
            assert out[doc].text == text and out[doc].removed == 0
        else:
            all_words = text.split()
            assert rest[:before] == all_words[:before] and (not behind or rest[-behind:] == all_words[-behind:])
            assert len(rest) <= before + behind + 51 - 20


def test_cuts_are_close_and_local():
    rng = np.random.default_rng(10)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    cut = np.flatnonzero(sentence_spans.least_of_window(hashes, np.zeros(5000, int), 8))
    assert np.diff(cut).max() <= 8 and cut[0] < 8 and cut[-1] >= 5000 - 8
    part = np.flatnonzero(sentence_spans.least_of_window(hashes[100:200], np.zeros(100, int), 8)) + 100
    assert [c for c in part if 107 <= c < 193] == [c for c in cut if 107 <= c < 193]
    assert not sentence_spans.least_of_window(hashes[:5], np.zeros(5, int), 8).any()
