"""Rows are judged one by one, whichever ids they share; stages and verdicts on unusual tables and against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from vellum.llm import near_dup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n=60):
    return " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))


def test_near_duplicates_by_row(spark):
    rng = np.random.default_rng(21)
    a, b, c, d = (words(rng) for _ in range(4))
    near = a.replace(a.split()[5], "other", 1)
    rows = [(1, a), (1, b), (2, near), (2, c), (3, c), (3, c), (None, d), (None, d), (None, a), (4, None), (4, None), (5, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("component_id", F.lit("x"))
    out = near_dup.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    # the near copy under id 2 and the copy without an id go; both texts of id 1 stay, and the other text of id 2
    assert got == sorted([(1, a), (1, b), (2, c), (0, d), (4, ""), (4, ""), (5, ""), (6, "")])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([], SCHEMA)
    out = stage(spark, docs, f"{DATA}/sf0.001")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_unusual_rows(spark, name):
    """Nulls in any column, repeated rows and clashing names: texts without words never go but in the first stage."""
    rng = np.random.default_rng(22)
    text = words(rng)
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, words(rng), "en", None, 5), (2, None, None, "s", None), (3, "", "de", "s", 0), (4, " \n\t", None, "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("mark", "hash", "later", "root", "gone", "removed")})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, f"{DATA}/sf0.001")
    ids = sorted((r.doc_id or 0) for r in out.collect())
    assert out.columns == docs.columns
    assert ids == {"language": [0, 1, 1], "lines": [0, 1, 1, 2, 3, 4], "near_duplicates": [0, 1, 2, 3, 4], "benchmark_free": [0, 1, 1, 2, 3, 4]}[name]


def plain_cutoffs(rows, half_of):
    """Choice on one half and exact certification on the other, in plain loops."""
    langs = {r["stratum"] for r in rows}
    chosen, out = {}, {}
    for s in langs:
        one = [r for r in rows if r["stratum"] == s and half_of[r["doc_id"]] == 0]
        good, bad = [r for r in one if r["quality"] == 1], [r for r in one if r["quality"] == 0]
        if not one:
            continue
        best = []
        for rule in quality.RULES:
            gains = []
            for c in quality.GRID:
                gains.append((sum(r[rule] > c for r in bad) / max(len(bad), 1) - quality.COST * sum(r[rule] > c for r in good) / max(len(good), 1), c, rule))
            best.append(max(gains))
        chosen[s] = [(rule, c) for g, c, rule in sorted(best, reverse=True) if g > 0]
    for s, of in chosen.items():
        good = [r for r in rows if r["stratum"] == s and half_of[r["doc_id"]] == 1 and r["quality"] == 1]
        for k in range(len(of), 0, -1):
            hit = sum(any(r[rule] > c for rule, c in of[:k]) for r in good)
            exact = sum(math.comb(len(good), i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (len(good) - i) for i in range(hit + 1))
            if good and hit <= quality.ALPHA * len(good) and exact <= quality.DELTA / len(chosen) / len(quality.RULES):
                out[s] = dict(of[:k])
                break
    return out


def test_cutoffs_equal_a_plain_version(spark):
    rng, rows = np.random.default_rng(23), []
    for k in range(6000):
        stratum, q = ["en", "de", "other"][k % 3], int(rng.random() < 0.7)
        values = [int(v) for v in rng.integers(0, 300 if q else 1000, 6) * (rng.random(6) < (0.05 if q else 0.4))]
        rows.append({"doc_id": k, "stratum": stratum, "quality": q, **dict(zip(quality.RULES, values, strict=True))})
    table = spark.createDataFrame(pd.DataFrame(rows)).select("doc_id", "stratum", F.col("quality").cast("int").alias("quality"), *[F.col(r).cast("int").alias(r) for r in quality.RULES])
    half = {r.doc_id: r.h for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(2)).alias("h")).collect()}
    want = plain_cutoffs(rows, half)
    assert quality.cutoffs(table) == want and want


def test_strata_come_from_the_labels(spark):
    rows = [(k, "pt" if k % 2 else ("xx" if k < 40 else None), 1) for k in range(600)]
    labelled = spark.createDataFrame(rows, "doc_id long, lang string, quality int")
    assert quality.strata(labelled) == ["pt"] and quality.strata(labelled.limit(0)) == []


def test_verdicts_follow_the_cutoffs(spark):
    out = quality.judge(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")).toPandas()
    docs = pd.read_parquet(f"{DATA}/sf0.01/documents.parquet").set_index("doc_id").text
    for r in out.itertuples():
        n, *_ = quality.measure(docs[r.doc_id])
        base = n < 50 or 100 * quality.measure(docs[r.doc_id])[4] > 50 * n
        assert r.base_failed == base and r.kept == (not base and len(r.rejected_by) == 0)
