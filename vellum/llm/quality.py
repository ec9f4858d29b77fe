"""Quality rules whose cutoffs are risk-controlled.

Each rule rejects a text whose signal exceeds a cutoff, and a text goes if any rule rejects it. Of a labelled holdout, one
half (by a hash of the id) chooses for every stratum and rule the cutoff of a fixed grid that best separates bad from good,
or none, and the order of the rules. The other half then certifies the rules together: as many of them, in that order, as
an exact binomial test shows to reject good texts at a joint rate of at most `alpha`, with the error probability `delta`
shared out over all strata and numbers of rules that are tested (Bonferroni).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import settled, small_batches

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes that don't begin a code point

#: signal of each rule and its grid of cutoffs, in thousandths; a text is rejected above the cutoff
RULES = ("symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "long_word_share", "short_line_share")
GRID = (20, 50, 100, 200, 300, 400, 600, 800)
#: Most good texts that the rules of a stratum may reject together, as a rate, and the probability that any stratum exceeds it
ALPHA, DELTA = 0.05, 0.05
#: The best cutoff is sought; a good text that is rejected counts as so many bad ones that are kept
COST = 20
#: A language is a stratum of its own from so many labelled good texts on, of which half can certify rules; others share one.
LEAST_GOOD, OTHER = 250, "other"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, capital_share int, long_word_share int, short_line_share int"


def measure(text: str | None) -> tuple[int, ...]:
    """The signals of SCHEMA. A null or wordless text has 0 in all."""
    raw = (text or "").encode("utf-8", "replace")
    ws = raw.split()
    n = len(ws)
    if not n:
        return 0, 0, len(raw.translate(None, NOT_SYMBOLS)), 0, 0, 0, 0, 0, 0
    body = b"".join(ws)
    chars = len(body.translate(None, CONTINUED))
    seen: set[bytes] = set()
    dup = lines = short = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            short += len(line) < 12
            if line in seen:
                dup += 1
            seen.add(line)
    repeated = 0
    if n >= 3:
        windows = list(zip(ws, ws[1:], ws[2:], strict=False))
        if len(set(windows)) < len(windows):
            count, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    capital = sum(1 for w in ws if len(w) > 1 and w.isupper())
    long_ = sum(1 for w in ws if len(w) > 30)
    return n, chars, len(raw.translate(None, NOT_SYMBOLS)), dup, repeated, lines, 1000 * capital // n, 1000 * long_ // n, 1000 * short // lines


def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=names)


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang and signals for every row of docs(doc_id, text, lang), in thousandths."""
    measure_of = F.pandas_udf(measured, SCHEMA)
    m = docs.select("doc_id", "lang", measure_of("text").alias("m")).select("doc_id", "lang", "m.*")
    n = F.greatest("n_words", F.lit(1))
    return m.select(
        "*",
        F.least(F.floor(1000 * F.col("n_symbols") / n), F.lit(1000)).cast("int").alias("symbols_per_word"),
        F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).cast("int").alias("dup_line_share"),
        F.floor(1000 * F.col("n_repeat_words") / n).cast("int").alias("repeat_share"),
    )


def strata(labelled: DataFrame) -> list[str]:
    """The languages with LEAST_GOOD good texts or more among labelled(lang, quality): at most one for so many labels."""
    good = labelled.filter("quality = 1 AND lang IS NOT NULL").groupBy("lang").count()
    return sorted(r["lang"] for r in good.filter(F.col("count") >= LEAST_GOOD).collect())


def stratum(lang: Column, langs: list[str]) -> Column:
    return F.when(lang.isin(*langs), lang).otherwise(F.lit(OTHER)) if langs else F.lit(OTHER)


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly from logarithms."""
    if k >= n:
        return 1.0
    head = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return math.fsum(math.exp(head(i)) for i in range(k + 1))


def certified(rejected: int, n: int, alpha: float, error: float) -> bool:
    """Whether rejected of n good texts show, at that error, a rate of at most alpha (exact one-sided bound)."""
    return n > 0 and rejected <= alpha * n and tail(rejected, n, alpha) <= error


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """{stratum: {rule: cutoff}} from labelled rows: doc_id, stratum, the rules' signals and quality 0 or 1.

    All labelled rows are counted on the executors; the driver gets strata * rules * cutoffs counts. Of equal gains the higher
    cutoff, which rejects less, is taken, and rules of equal gain go by their cutoffs and names, last first.
    """
    over = [F.sum(((F.col(r) > c) & (F.col("quality") == q)).cast("long")).alias(f"{r}:{c}:{q}") for r in RULES for c in GRID for q in (0, 1)]
    half = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(2))
    known = labelled.filter(F.col("quality").isin(0, 1)).withColumn("half", half)
    counts = known.filter("half = 0").groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), *over).collect()
    chosen: dict[str, list[tuple[str, int]]] = {}
    for row in counts:
        gain = lambda rule, c: row[f"{rule}:{c}:0"] / max(row["bad"], 1) - COST * row[f"{rule}:{c}:1"] / max(row["good"], 1)  # noqa: E731, B023
        best = [max((gain(rule, c), c, rule) for c in GRID) for rule in RULES]
        chosen[row["stratum"]] = [(rule, c) for g, c, rule in sorted(best, reverse=True) if g > 0]
    joint = []
    for k in range(1, len(RULES) + 1):
        any_of = F.lit(False)
        for s, of in sorted(chosen.items()):
            for rule, c in of[:k]:
                any_of = any_of | ((F.col("stratum") == s) & (F.col(rule) > c))
        joint.append(F.count_if(any_of).alias(f"first{k}"))
    error = delta / max(1, len(counts)) / len(RULES)
    out: dict[str, dict[str, int]] = {}
    for row in known.filter("half = 1 AND quality = 1").groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *joint).collect():
        of = chosen.get(row["stratum"], [])
        most = max((k for k in range(1, len(of) + 1) if certified(row[f"first{k}"], row["good"], alpha, error)), default=0)
        if most:
            out[row["stratum"]] = dict(of[:most])
    return out


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Signals and verdicts (base_failed, rejected_by, kept) for every row of docs(doc_id, text, lang).

    labels(doc_id, quality) may cover some rows; those with a null id or quality count for nothing, and without labels
    no rule has a cutoff, so that the base rules alone decide. Null and empty texts have no words and fail the base
    rules; a very long text is measured whole. A repeated row gets a verdict each time, and of several labels of a document
    the lowest counts. Only the named columns are read, so others can't clash.
    """
    small_batches(docs.sparkSession)
    found = settled(signals(docs))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = settled(found.filter(~failed()).join(known, "doc_id"))
    langs = strata(labelled)
    found = found.withColumn("stratum", stratum(F.col("lang"), langs))
    limits = cutoffs(labelled.withColumn("stratum", stratum(F.col("lang"), langs)), alpha, delta)
    broken = [
        F.when((F.col("stratum") == s) & (F.col(rule) > cut), F.lit(rule)) for s, of in sorted(limits.items()) for rule, cut in sorted(of.items())
    ]
    rules = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return found.withColumn("base_failed", failed()).withColumn("rejected_by", rules).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))
