"""Routing of requests to skills by weighted bigrams of an index of phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

LOW, TIE, BLOCK = 0.12, 0.08, 0.30
#: Bigrams that this share of the skills' triggers have tell skills apart no more, as those of function words do.
COMMON = 0.5


def common_bigrams(phrases: DataFrame, share: float = COMMON, least: int = 2) -> DataFrame:
    """(g): bigrams in the triggers of at least that share of the skills, and of so many."""
    triggers = phrases.filter("kind = 'trigger'")
    skills = triggers.agg(F.count_distinct("skill").alias("skills"))
    used = triggers.select("skill", F.explode(T.bigrams(F.col("phrase"))).alias("g")).groupBy("g").agg(F.count_distinct("skill").alias("k"))
    return used.join(F.broadcast(skills)).filter((F.col("k") >= least) & (F.col("k") >= share * F.col("skills"))).select("g")


def weights(phrases: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(g, w): ln((n + 1) / (df + 0.5)) of each bigram over the n phrases; 0 for those in stop(g), by default the common ones."""
    n = phrases.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    df = phrases.select(F.explode(T.bigrams(F.col("phrase"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    idle = (stop if stop is not None else common_bigrams(phrases)).select("g").distinct().withColumn("idle", F.lit(True))
    weight = F.when(F.col("idle"), 0.0).otherwise(F.log((F.col("n") + 1) / (F.col("df") + 0.5)))
    return df.join(F.broadcast(n)).join(idle, "g", "left").select("g", weight.alias("w"))


def similarities(prompts: DataFrame, phrases: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(prompt, skill, kind, phrase, score): weighted Dice of each prompt and phrase that share a bigram.

    An equi-join on bigrams finds the pairs; those that share none score 0 and don't arise. A prompt's bigram that no phrase
    has weighs as the rarest does, unless it is in stop.
    """
    w = weights(phrases, stop)
    n = phrases.agg(F.log((F.greatest(F.count(F.lit(1)), F.lit(1)) + 1) / F.lit(0.5)).alias("most"))
    idle = stop.select("g").distinct().withColumn("idle", F.lit(True)) if stop is not None else None

    def exploded(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
        g = rows.select(*keys, F.explode(T.bigrams(F.col(text))).alias("g")).join(w, "g", "left").join(F.broadcast(n))
        g = g.join(idle, "g", "left") if idle is not None else g.withColumn("idle", F.lit(None).cast("boolean"))
        return g.select(*keys, "g", F.when(F.col("idle"), 0.0).otherwise(F.coalesce("w", "most")).alias("w"))

    keys = ["skill", "kind", "phrase"]
    a, b = exploded(prompts.select("prompt").distinct(), ["prompt"], "prompt"), exploded(phrases.select(*keys).distinct(), keys, "phrase")
    sum_a, sum_b = a.groupBy("prompt").agg(F.sum("w").alias("wa")), b.groupBy(*keys).agg(F.sum("w").alias("wb"))
    shared = a.join(b.drop("w"), "g").groupBy("prompt", *keys).agg(F.sum("w").alias("both"))
    out = shared.join(sum_a, "prompt").join(sum_b, keys)
    return out.select("prompt", *keys, F.when(F.col("wa") + F.col("wb") > 0, 2 * F.col("both") / (F.col("wa") + F.col("wb"))).otherwise(0.0).alias("score"))


def route(prompts: DataFrame, phrases: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(prompt, choice): the skill whose trigger is nearest; not_covered, or ambiguous if two are close.

    phrases(skill, kind 'trigger', 'not_for' or 'out_of_scope', phrase). A skill is blocked by a not_for phrase that is at
    least as near as its best trigger, and at least BLOCK. An out-of-scope phrase that beats every trigger comes first.
    """
    s = similarities(prompts, phrases, stop)
    best = s.groupBy("prompt", "skill").agg(F.coalesce(F.max(F.when(F.col("kind") == "trigger", F.col("score"))), F.lit(0.0)).alias("hit"), F.coalesce(F.max(F.when(F.col("kind") == "not_for", F.col("score"))), F.lit(0.0)).alias("block"), F.coalesce(F.max(F.when(F.col("kind") == "out_of_scope", F.col("score"))), F.lit(0.0)).alias("out"))
    open_ = best.filter((F.col("hit") > 0) & ~(F.col("block") >= F.greatest("hit", F.lit(BLOCK))))
    w = Window.partitionBy("prompt").orderBy(F.desc("hit"), "skill")
    top = open_.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("hit").over(w)).filter("k = 1").select("prompt", "skill", "hit", "second")
    outs = best.groupBy("prompt").agg(F.max("out").alias("out"))
    all_ = prompts.select("prompt").distinct().join(top, "prompt", "left").join(outs, "prompt", "left")
    choice = (
        F.when(F.coalesce("out", F.lit(0.0)) > F.greatest(F.coalesce("hit", F.lit(0.0)), F.lit(LOW)), "not_covered")
        .when(F.coalesce("hit", F.lit(0.0)) < LOW, "not_covered")
        .when(F.col("hit") - F.coalesce("second", F.lit(0.0)) < TIE, "ambiguous")
        .otherwise(F.col("skill"))
    )
    return all_.select("prompt", choice.alias("choice"))
