"""Lines of under five words are compared like all others."""

import numpy as np
import pandas as pd

from tests.conftest import DATA
from vellum.llm import line_dup


def test_short_lines_against_brute_force(spark):
    texts = pd.read_parquet(f"{DATA}/sf0.001/documents.parquet").sort_values("doc_id").text.tolist()[:120]
    rng = np.random.default_rng(8)
    texts += ["\n".join(" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 7))) for _ in range(12)) for _ in range(60)]
    texts += ["All rights reserved.\nfirst of two", "one two three four\nAll rights reserved.", "one two three four five\ntwo first of"]
    rows, kept, want = list(enumerate(texts)), [], {}
    for i, text in rows:
        want[i] = []
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.encode().split())
            if words and any(100 * len(words & x) >= 80 * len(words | x) for x in kept):
                want[i].append(k)
            elif words:
                kept.append(words)
            if words and want[i][-1:] == [k] and words not in kept:
                kept.append(words)  # an earlier line that goes itself still counts
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dup.removed(table).collect()} == want
    assert 0 in want[len(rows) - 1] and 1 in want[len(rows) - 1] and 1 in want[len(rows) - 2]
    rest = {r.doc_id: r.text for r in line_dup.deduplicated(table).collect()}
    assert rest[len(rows) - 1] == ""


def test_copies_that_hold_short_lines_go_whole(spark):
    text = "A title here\nA line of more than five plain words\nThe end"
    rest = line_dup.deduplicated(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rest} == {1: text, 2: ""}
