"""The bound on false rejection holds for all rules of a stratum together."""

from vellum.llm import quality


def test_rules_are_certified_together(spark):
    """Each of six rules rejects 2 % of the good texts, no two the same ones, and all bad texts."""
    rows = []
    for k in range(12000):
        hit, good = k % 50, k % 3 != 0
        rows.append((k, "en", int(good), *(900 if r == hit or not good else 0 for r in range(6))))
    table = spark.createDataFrame(rows, "doc_id long, stratum string, quality int, " + ", ".join(f"{r} int" for r in quality.RULES))
    found = quality.cutoffs(table)["en"]
    good = table.filter("quality = 1").collect()
    joint = sum(any(r[rule] > c for rule, c in found.items()) for r in good) / len(good)
    assert 1 <= len(found) < 6 and joint <= quality.ALPHA


def test_few_labels_certify_nothing(spark):
    rows = [(k, "en", k % 2, *[900 * (k % 2 == 0)] * 6) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, stratum string, quality int, " + ", ".join(f"{r} int" for r in quality.RULES))
    assert quality.cutoffs(table) == {}
