"""Proposal consistency (L4·26): a plan's text against the finished text, anchor by anchor.

An anchor that isn't configured, or whose number can't be read, is undecidable and never passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.durable import dealt_anew
from vellum.operators.issues import as_issues

SEVERITY = {"missing": "error", "changed": "warn", "deviates": "warn", "undecidable": "info"}
OUTLINE = ((1, r"^[一二三四五六七八九十]+、\s*"), (2, r"^[（(][一二三四五六七八九十]+[）)]\s*"), (3, r"^\d+[.．、]\s*"))


def outline(proposals: DataFrame, start: str, stop: str) -> DataFrame:
    """(doc_id, k, level, text) of the outline between the first line that starts with `start` and the first `stop` behind it."""
    lines = proposals.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw")).withColumn("raw", T.strip("raw"))
    w = Window.partitionBy("doc_id")
    lo = F.min(F.when(F.col("raw").startswith(start), F.col("k"))).over(w)
    inside = lines.withColumn("lo", lo).filter("k > lo")
    hi = F.min(F.when(F.col("raw").startswith(stop), F.col("k"))).over(w)
    inside = inside.withColumn("hi", hi).filter("hi is null or k < hi")
    level, body = F.lit(None).cast("int"), F.col("raw")
    for n, pattern in reversed(OUTLINE):
        level = F.when(F.col("raw").rlike(pattern), n).otherwise(level)
        body = F.regexp_replace(body, pattern, "")
    return inside.select("doc_id", "k", level.alias("level"), body.alias("text")).filter("level is not null")


def conclusions(found: DataFrame, anchor: str) -> DataFrame:
    """found(doc_id, conclusion, value) as (doc_id, anchor, conclusion, value)."""
    return found.select("doc_id", F.lit(anchor).alias("anchor"), "conclusion", F.col("value").cast("string").alias("value"))


def given(anchors: DataFrame, section: str, *fields: str) -> dict[str, list[str]]:
    """The tokens of a section's fields in an anchors file. It is small: a person wrote it."""
    rows = anchors.filter((F.col("section") == section) & F.col("field").isin(*fields)).collect()
    return {f: [] for f in fields} | {r["field"]: [t for t in r["tokens"] if t and t.strip()] for r in rows}


def holds_all(c: str, tokens: list[str]) -> Column:
    out = F.lit(True)
    for t in tokens:
        out = out & F.coalesce(F.contains(F.col(c), F.lit(t)), F.lit(False))
    return out


def topic(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """A1: all tokens in both texts. pairs(doc_id, proposal, thesis); without configured tokens the first title in 《》 counts."""
    tokens = given(anchors, "A1_topic", "tokens")["tokens"]
    title = F.trim(F.regexp_extract("proposal", "《([^》]+)》", 1))
    used = F.array(*map(F.lit, tokens)) if tokens else F.when(title != "", F.array(title))
    both = pairs.withColumn("tokens", used)
    lacks = lambda c: F.exists("tokens", lambda t: ~F.coalesce(F.contains(F.col(c), t), F.lit(False)))
    state = F.when(F.col("tokens").isNull(), "undecidable").when(lacks("proposal"), "missing").when(lacks("thesis"), "deviates").otherwise("passed")
    return conclusions(both.select("doc_id", state.alias("conclusion"), F.coalesce(F.array_join("tokens", ","), F.lit("")).alias("value")), "A1")


def method(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """A4: configured elements of the method in both texts; undecidable where none is configured."""
    tokens = given(anchors, "A4_method", "tokens")["tokens"]
    if not tokens:
        return conclusions(pairs.select("doc_id", F.lit("undecidable").alias("conclusion"), F.lit("not configured").alias("value")), "A4")
    state = F.when(~holds_all("proposal", tokens), "missing").when(~holds_all("thesis", tokens), "deviates").otherwise("passed")
    return conclusions(pairs.select("doc_id", state.alias("conclusion"), F.lit(",".join(tokens)).alias("value")), "A4")


def sample(pairs: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """A4: the sample that was reached against the one that was planned, behind the configured words or the default ones."""
    words = given(anchors, "A4_method", "plan_anchor", "actual_anchor") if anchors is not None else {"plan_anchor": [], "actual_anchor": []}
    lo, hi = T.planned_sample(F.col("proposal"), tuple(words["plan_anchor"]) or T.PLAN_WORDS)
    got = T.actual_sample(F.col("thesis"), tuple(words["actual_anchor"]) or T.DONE_WORDS)
    state = F.when(lo.isNull() | got.isNull(), "undecidable").when(got.between(lo, hi), "passed").otherwise("changed")
    value = F.concat(F.coalesce(lo.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(hi.cast("string"), F.lit("?")), F.lit(":"), F.coalesce(got.cast("string"), F.lit("?")))
    return conclusions(pairs.select("doc_id", state.alias("conclusion"), value.alias("value")), "A4")


def any_of(c: str, tokens: list[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.coalesce(F.contains(F.col(c), F.lit(t)), F.lit(False))
    return out


def structure(plan: DataFrame, heads: DataFrame, anchors: DataFrame) -> DataFrame:
    """A5: what an anchors file says to look at in the outline and among the headings; undecidable where it says nothing.

    plan(doc_id, text, level) is the outline, heads(doc_id, para_index, style_level, text) the thesis' headings. Labels on both
    sides pass; a planned chapter that is no chapter of the thesis has changed (merged into a section); second-level sections of
    one chapter deviate if they hold a token that the outline lacks; a planned entry without any heading is missing.
    """
    a = given(anchors, "A5_outline", "expect_passed", "merged_chapter", "merged_target", "extra_tokens", "chapter_heading", "missing_section", "missing_fallback")
    docs = plan.select("doc_id").union(heads.select("doc_id")).distinct()
    if not (a["merged_chapter"] or a["extra_tokens"] and a["chapter_heading"] or a["missing_section"]):
        return conclusions(docs.select("doc_id", F.lit("undecidable").alias("conclusion"), F.lit("not configured").alias("value")), "A5")
    first = lambda name: a[name][0] if a[name] else None
    has = lambda c, token: F.bool_or(F.contains(F.col(c), F.lit(token)))
    out = None

    def add(rows: DataFrame) -> None:
        nonlocal out
        part = conclusions(rows, "A5")
        out = part if out is None else out.unionByName(part)

    for token in a["expect_passed"]:
        both = plan.groupBy("doc_id").agg(has("text", token).alias("p")).join(heads.groupBy("doc_id").agg(has("text", token).alias("t")), "doc_id")
        add(both.filter("p and t").select("doc_id", F.lit("passed").alias("conclusion"), F.lit(token).alias("value")))
    if token := first("merged_chapter"):
        planned = plan.filter("level = 1").filter(F.contains("text", F.lit(token))).select("doc_id").distinct()
        own = heads.filter("style_level = 1").filter(F.contains("text", F.lit(token))).select("doc_id").distinct()
        into = F.min(F.when(any_of("text", a["merged_target"][:1] or [token]), F.struct("para_index", "text")))
        where = heads.groupBy("doc_id").agg(into.alias("into"))
        rows = planned.join(own, "doc_id", "left_anti").join(where, "doc_id", "left")
        add(rows.select("doc_id", F.lit("changed").alias("conclusion"), F.concat_ws(">", F.lit(token), "into.text").alias("value")))
    if a["extra_tokens"] and (chapter := first("chapter_heading")):
        lo = heads.filter("style_level = 1").filter(F.contains("text", F.lit(chapter))).groupBy("doc_id").agg(F.min("para_index").alias("lo"))
        hi = heads.filter("style_level = 1").join(lo, "doc_id").filter("para_index > lo").groupBy("doc_id").agg(F.min("para_index").alias("hi"))
        inside = heads.filter("style_level = 2").join(lo, "doc_id").join(hi, "doc_id", "left").filter("para_index > lo and (hi is null or para_index < hi)").filter(any_of("text", a["extra_tokens"]))
        planned = plan.filter(any_of("text", a["extra_tokens"])).select("doc_id").distinct()
        add(inside.join(planned, "doc_id", "left_anti").select("doc_id", F.lit("deviates").alias("conclusion"), F.col("text").alias("value")))
    if token := first("missing_section"):
        planned = plan.filter(F.contains("text", F.lit(token))).select("doc_id").distinct()
        there = heads.filter(F.contains("text", F.lit(token))).select("doc_id").distinct()
        near = heads.groupBy("doc_id").agg(F.min(F.when(any_of("text", a["missing_fallback"]), F.struct("para_index", "text"))).alias("near"))
        rows = planned.join(there, "doc_id", "left_anti").join(near, "doc_id", "left")
        add(rows.select("doc_id", F.lit("missing").alias("conclusion"), F.concat_ws("~", F.lit(token), "near.text").alias("value")))
    return out


def promised_entries(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """As many entries as promised; without a promise there is nothing to break."""
    n = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("want", T.promised(F.col("proposal")))
    state = F.when(F.col("want").isNull() | (F.col("n") >= F.col("want")), "passed").otherwise("missing")
    return conclusions(both.select("doc_id", state.alias("conclusion"), F.concat_ws("/", "n", F.coalesce(F.col("want").cast("string"), F.lit("-"))).alias("value")), "A7")


CARDS = {"A2": "A2_concept", "A3": "A3_theory", "A6": "A6_conclusion"}
QUESTIONS = {"A2": "same concept?", "A3": "same theory?", "A6": "same conclusion?"}


def snippet(text: Column, token: Column) -> Column:
    """12 characters before a token and 34 from it on; null without it."""
    at = F.instr(text, token)
    lo = F.greatest(at - 12, F.lit(1))
    return F.when(at > 0, F.substring(text, lo, at - lo + 34))


def cards(pairs: DataFrame, anchors: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(doc_id, anchor, verdict, question, proposal_excerpt, thesis_excerpt, thesis_heading, para_index): A2, A3, A6.

    Evidence for a reader to judge, as pending; undecidable where neither tokens nor a heading are configured. The token shown is
    the first that both texts hold, else the first; the heading is the first one that holds the configured piece.
    """
    out = None
    for anchor, section in CARDS.items():
        a = given(anchors, section, "tokens", "proposal_token", "thesis_heading")
        tokens, piece = a["tokens"] or a["proposal_token"], (a["thesis_heading"] or [None])[0]
        both = pairs
        if heads is not None and piece:
            found = heads.filter(F.contains("text", F.lit(piece))).groupBy("doc_id").agg(F.min(F.struct("para_index", "text")).alias("h"))
            both = both.join(found, "doc_id", "left")
        else:
            both = both.withColumn("h", F.lit(None).cast("struct<para_index:int,text:string>"))
        shared = [F.when(holds_all("proposal", [t]) & holds_all("thesis", [t]), F.lit(t)) for t in tokens]
        token = F.coalesce(*shared, F.lit(tokens[0])) if tokens else F.lit(None).cast("string")
        configured = bool(tokens or piece)
        part = both.withColumn("token", token).select(
            "doc_id", F.lit(anchor).alias("anchor"), F.lit("pending" if configured else "undecidable").alias("verdict"), F.lit(f"{QUESTIONS[anchor]} {'/'.join(tokens)}".strip()).alias("question"),
            snippet(F.col("proposal"), F.col("token")).alias("proposal_excerpt"), snippet(F.col("thesis"), F.col("token")).alias("thesis_excerpt"),
            F.col("h.text").alias("thesis_heading"), F.col("h.para_index").cast("int").alias("para_index"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def check(pairs: DataFrame, heads: DataFrame, entries: DataFrame, anchors: DataFrame, start: str = "论文提纲", stop: str = "进度安排") -> DataFrame:
    """(doc_id, anchor, conclusion, value): all anchors of pairs(doc_id, proposal, thesis); those of A2, A3 and A6 are pending or undecidable."""
    plan = outline(pairs.select("doc_id", F.col("proposal").alias("text")), start, stop)
    read = cards(pairs, anchors, heads).select("doc_id", "anchor", F.col("verdict").alias("conclusion"), F.coalesce("proposal_excerpt", F.lit("")).alias("value"))
    parts = [topic(pairs, anchors), method(pairs, anchors), sample(pairs, anchors), structure(plan, heads, anchors), promised_entries(pairs, entries), read]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_conclusion(all_: DataFrame) -> DataFrame:
    """(doc_id, conclusion, n): how many anchors of each document ended how."""
    return dealt_anew(all_).groupBy("doc_id", "conclusion").agg(F.count(F.lit(1)).alias("n"))


def proposal_issues(all_: DataFrame) -> DataFrame:
    """Conclusions other than passed as issues, which can be suppressed like any other."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return as_issues(all_.filter("conclusion not in ('passed', 'pending')"), "prop-consistency", "anchor", "L4·26", F.try_element_at(severity, F.col("conclusion")), F.concat_ws(":", "anchor", "conclusion", "value"), kind="document")


def scores(reported: DataFrame, golden: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, misses and extra findings of reported against golden, and both totals, by one full join on distinct keys."""
    r, g = reported.select(*keys).distinct().withColumn("r", F.lit(1)), golden.select(*keys).distinct().withColumn("g", F.lit(1))
    both = r.join(g, keys, "full")
    return both.agg(F.count_if(F.col("r").isNotNull() & F.col("g").isNotNull()).alias("hits"), F.count("g").alias("golden"), F.count("r").alias("reported"), F.count_if(F.col("g").isNull()).alias("extra"), F.count_if(F.col("r").isNull()).alias("missed"))


def located_scores(reported: DataFrame, golden: DataFrame, paragraphs: DataFrame, reach: int = 2) -> DataFrame:
    """Recall, false findings and right places of reported(doc_id, anchor, conclusion, para_index) against golden(doc_id, anchor,
    conclusion, keywords).

    A hit is in the right place if a keyword stands in paragraphs(doc_id, para_index, text) at most `reach` from where it says. The
    interval join is an equi-join on buckets of 2 * reach + 1 paragraphs, of which a place lies in its own and both neighbours.
    Findings without a place have no right one, and neither have those whose golden entry has no keyword. Rates over nothing are null.
    """
    keys, width = ["doc_id", "anchor", "conclusion"], 2 * reach + 1
    said = reported.select(*keys, "para_index").distinct()
    wanted = golden.select(*keys, "keywords").dropDuplicates(keys)
    around = F.explode(F.array(*[F.floor(F.col("para_index") / width) + d for d in (-1, 0, 1)])).alias("bucket")
    places = said.filter("para_index is not null").join(wanted, keys).select(*keys, "keywords", F.col("para_index").alias("at"), around)
    texts = paragraphs.select("doc_id", "para_index", "text", F.floor(F.col("para_index") / width).alias("bucket"))
    near = places.join(texts, ["doc_id", "bucket"]).filter(F.abs(F.col("para_index") - F.col("at")) <= reach)
    right = near.filter(F.exists("keywords", lambda k: F.contains(F.col("text"), k))).select(*keys).distinct().withColumn("right", F.lit(True))
    both = said.select(*keys).distinct().withColumn("r", F.lit(1)).join(wanted.select(*keys).withColumn("g", F.lit(1)), keys, "full").join(right, keys, "left")
    hit = F.col("r").isNotNull() & F.col("g").isNotNull()
    sums = both.agg(F.count_if(hit).alias("hits"), F.count("g").alias("golden"), F.count("r").alias("reported"), F.count_if(F.col("g").isNull()).alias("extra"), F.count_if(hit & F.col("right")).alias("located"))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return sums.select("*", rate("hits", "golden").alias("recall"), rate("extra", "reported").alias("false_rate"), rate("located", "hits").alias("located_rate"))
