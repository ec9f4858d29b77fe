"""Source divergence, vector codes and license scans against plain versions, and on unusual tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_queries import rows
from vellum.llm import codes, divergence, licenses
from vellum.llm import queries as llm

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_yinyang_codes"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(llm.queries()[name](spark, SF).toPandas()) == rows(duck.sql(llm.oracle_sql()[name]).df())


# source divergence


def plain_audit(docs, least, ranks):
    docs = [((text or ""), lang or "", source or "") for text, lang, source in docs]
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    split = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), lang, s) for t, lang, s in docs]
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for words, lang, _ in split:
        documents[lang].update(set(words))
    for words, lang, source in split:
        counts[lang, source].update(w for w in words if documents[lang][w] >= least)
    out = set()
    for lang in {x[1] for x in split}:
        kept = sorted((t for t, n in documents[lang].items() if n >= least), key=str.encode)
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        whole = sum(groups.values(), Counter())
        for s, c in groups.items():
            pairs = [(-sum(abs(p(c, t) - p(groups[o], t)) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(p(whole, t) - p(c, t), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:ranks])}
    return out


def some_documents(n=240):
    pick = random.Random(5)
    terms = ["the", "The", "éa", "ÉA", "zß", "a'b", "x1y", "日本", "q" * 100, "Q" * 100, *("w" + chr(97 + k) * (1 + k % 3) for k in range(26))]
    out = [(" ".join(pick.choices(terms[: 5 + k % 30], k=pick.randint(0, 40))), ["en", "de", None][k % 3], [None, "s1", "s2", "", "s3"][k % 5]) for k in range(n)]
    return [*out, (None, "en", "empty"), ("", "xx", "a"), ("once", "xx", "b"), (" ".join(f"uniq{chr(97 + i % 26)}" for i in range(3000)), "en", "long")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_plain(spark, monkeypatch, small):
    if small:  # many blocks of terms and sources, parts of texts and of counts
        for name, value in (("BLOCK_BYTES", 200), ("ENTRIES", 7), ("PIECE", 20), ("SOURCES", 1), ("TERMS", 3)):
            monkeypatch.setattr(divergence, name, value)
    docs = some_documents()
    table = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "share", "block", "raw")})
    got = divergence.audit(table, least=5, ranks=4).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain_audit(docs, 5, 4)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 7_000_000_000_001, 9_000_000_000_000_007, 123_457
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# vector codes


def plain_codes(vectors, parts, entries, rounds):
    kept = [(i, v) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = sorted((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in kept)
    x = np.array([v for _, v in whole]).reshape(len(whole), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        code = np.stack([((x[:, p][:, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
        if k < rounds:
            for p, e in itertools.product(range(parts), range(books.shape[1])):
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
    return {(i, "".join(f"{c:02x}" for c in row), int(e)) for (i, _), row, e in zip(whole, code, error, strict=True)}, books


def test_codes_equal_plain_and_sums_by_label(spark):
    pick = np.random.default_rng(3)
    data = [(k, [float(x) for x in pick.integers(-3, 4, 32) / 256] if k % 2 else [float(x) for x in pick.normal(0, 1, 32)], [0, 1, None][k % 3]) for k in range(700)]
    data += [(1000, None, 0), (1001, [float("nan")] * 32, 0), (1002, [None] * 32, 0), (1003, [float("inf")] * 32, 1), (1004, [], 1), (699, data[699][1], 2)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("x", "codes", "of", "error")})
    coded, books = codes.compress(table.repartition(3))
    got = codes.digest(coded, books).collect()
    want, want_books = plain_codes([(i, v) for i, v, _ in data if i != 1004], 16, 64, 2)
    assert {(r.vec_id, r.code, r.error) for r in got} == want and len(got) == 701 and (books == want_books).all()
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, want_books.ravel())).encode()).hexdigest()}
    sums, label = Counter(), {i: of for i, _, of in data[:700]}
    for r in got:
        sums[r.label_error] += r.error
    assert len(sums) == 4 and all(a == b for a, b in sums.items()) and label


@pytest.mark.parametrize("rows_, width", [(5, 20), (64, 16), (0, 16), (40, 1)])
def test_codes_of_small_tables_and_uneven_parts(spark, rows_, width):
    pick = np.random.default_rng(1)
    data = [(k, [float(x) for x in pick.normal(0, 2, width)], None) for k in range(rows_)]
    coded, books = codes.compress(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    got = codes.digest(coded, books).collect()
    padded = [(i, v + [0.0] * (-width % 16)) for i, v, _ in data]
    assert {(r.vec_id, r.code, r.error) for r in got} == (plain_codes(padded, 16, 64, 2)[0] if data else set())


@pytest.mark.parametrize("spread", [2, 40, 1 << 26])
def test_bounds_skip_groups_and_change_no_result(spread):
    """Rounds of moved entries, with many ties at a small spread, and numbers that floating point doesn't hold at a large one."""
    pick = np.random.default_rng(spread)
    x = pick.integers(-spread, spread, (3000, 1, 4))
    books = x[:64].transpose(1, 0, 2).copy()
    groups, state, old, scans = [codes.grouped(books[0])], (), None, 0
    for k in range(5):
        code, error, low, work = codes.Coder(books, groups, old).assign(x, *state)
        d = ((x[:, 0][:, None] - books[0]) ** 2).sum(2)
        assert (code[:, 0] == d.argmin(1)).all() and (error == d.min(1)).all()
        scans += work
        state, old, books = (code, low), books, books + pick.integers(-max(1, spread // 50), max(2, spread // 50), books.shape) * (pick.random((1, 64, 1)) < 0.3)
    assert 0 < scans < 0.6 * 4 * 3000 * (groups[0].max() + 1) or spread != 40


# license scans


def test_interval_containment_equals_plain():
    pick = random.Random(2)
    for _ in range(300):
        hits = [(pick.randint(0, 3), a := pick.randint(0, 30), a + pick.randint(1, 12), k) for k in range(pick.randint(0, 25))]
        rank = lambda h: (h[0], h[1] - h[2], h[3], h[1])
        plain = [not any(rank(o) < rank(h) and o[1] <= h[1] and h[2] <= o[2] for o in hits) for h in hits]
        assert licenses.unsuppressed(hits) == plain


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    joined, hits = " " + " ".join(words) + " ", []
    for k, rule in enumerate(licenses.rules()):
        for m in re.finditer(rf"(?<= )(?:{rule.pattern})(?= )", joined):
            hits.append((list(licenses.KINDS).index(rule.kind), m.start(), m.end(), k))
    rank = lambda h: (h[0], h[1] - h[2], h[3], h[1])
    stand = {licenses.rules()[h[3]].label for h in hits if not any(rank(o) < rank(h) and o[1] <= h[1] and h[2] <= o[2] for o in hits)}
    base = sorted({x for _, x in places})
    first = [k for k, _ in places]
    return len(words), len(places), min(first, default=None), max(first, default=None), ",".join(base), ",".join(sorted({*base, *stand}))


TEXTS = [
    None, "", " .- ", "plain words only", "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", "MIT License\nmit license, Apache License 2.0 (the \"License\")",
    "This work is licensed under the GNU General Public License, version 3 or any later version.", "SPDX-License-Identifier: BSD-3-Clause", "GPLv2+, LGPL v2.1 and AGPL-3.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "https://creativecommons.org/licenses/by-sa/4.0/legalcode", "é mit licenseé mit é license",
    "simple compliance of employees", "mit license " * 3000, "x" * 300000 + " Apache License",
]


def test_scan_equals_plain(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumns({c: F.lit(1) for c in ("raw", "matches", "n_words", "base")})
    short = [t for t in TEXTS if len(t or "") < 10000]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(table)).collect()}
    for k, text in enumerate(short):
        assert tuple(got[k])[1:7] == plain_scan(text), text
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got.values())
    assert (got[15].n_base, got[15].first_word, got[15].last_word, got[15].labels) == (3000, 0, 5998, "mit")
    assert (got[16].n_words, got[16].n_base, got[16].first_word) == (3, 1, 1)
    assert got[4].labels == "cc-by,cc-by-nc-4.0" and got[8].labels == "bsd-3-clause" and got[12].labels == "cc-by-sa-4.0" and got[14].labels == ""


def test_scan_of_the_table_equals_plain(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    pick = [r for r in licenses.digest(licenses.scan(table)).collect() if r.labels or r.doc_id % 10 == 0]
    assert sum(r.n_base > 0 for r in pick) > 1
    for r in pick:
        assert tuple(r)[1:7] == plain_scan(texts[r.doc_id])


def test_every_rule_has_its_keyword():
    """A rule's keyword stands, at the start of a word, in whatever the rule matches: shown on one text for each rule."""
    scanner = licenses.Scanner()
    assert 300 < len(scanner.rules) and not any(re.search(r"[^a-z0-9 ]", r.keyword) for r in scanner.rules)
    for k, rule in enumerate(scanner.rules):
        bare = re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\(\?:[^()]*\)\?", "", rule.pattern.removeprefix(licenses.GIVEN)))
        bare = re.sub(r"\(\?:\\S\+ \)\{0,\d+\}\?", "", bare).replace("[cs]", "s").replace(r"\S+", "x")
        bare = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", re.sub(r".\?", "", bare))
        assert f" {rule.keyword}" in f" {bare}", rule
        assert scanner.pattern(k)
