"""Text rules (L3): quotes, punctuation, dashes, headings, traces of work, spacing, widths, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.issues import as_issues, finding, of_findings
from vellum.operators.standards import source_of

# Fixed values of the checks.
CURVED, EM_DASH = "[“”‘’]", "—"
REPEATED, CROSSED, HALF_BETWEEN, DOTS, STOPS = r"([。，！？；：、])\1+", "(?:，。|。，)", r"[一-鿿][,.;?!][一-鿿]", r"\.\.\.+", "。{3,}"
LATIN_REPEATED = r"([.,!?;:])\1+"
HEDGES = ("浅析", "初探", "试论", "刍议", "略论")
HEADING_MARK, HEADING_TRAIL = "[：:？?！!]", r"[。！？；，、：]\s*$"
TRACES = ("TODO", "TBD", "FIXME", "XXX", "待补", "待定", "待核实", "此处省略", "（略）", "【】", "？？？", "@@", "<<", ">>")
HAN_ASCII, HAN_SPACE_ASCII = "(?:[一-鿿][A-Za-z0-9]|[A-Za-z0-9][一-鿿])", "(?:[一-鿿] +[A-Za-z0-9]|[A-Za-z0-9] +[一-鿿])"


def first_match(pattern: str) -> Column:
    """(position from 0, text) of the first match in text, or null."""
    return F.when(F.col("text").rlike(pattern), F.struct((F.regexp_instr("text", F.lit(pattern)) - 1).alias("at"), F.regexp_extract("text", pattern, 0).alias("hit")))


def labelled(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def curved(source: str = "default") -> tuple[Column, Column]:
    n, at = F.regexp_count("text", F.lit(CURVED)), F.regexp_instr("text", F.lit(CURVED)) - 1
    return F.col("text").rlike(CURVED), finding("quote-style", "curved", "warn", F.concat(n.cast("string"), F.lit("@"), at.cast("string")), "straight", source)


PUNCTUATION = {"repeated": REPEATED, "crossed": CROSSED, "half-width": HALF_BETWEEN, "dots": DOTS, "stops": STOPS}
#: Any of the detectors, or any bracket: what most paragraphs lack, so that one pattern settles them.
SUSPECT = "|".join(["([。，！？；：、])\\1+" if n == "repeated" else p for n, p in PUNCTUATION.items()] + ["[（）]"])


def marks(profile: str = "cjk") -> tuple[Column, Column]:
    """Which detectors hit a paragraph, and the first place. Profile latin looks for repeated Latin marks only."""
    if profile == "latin":
        m = first_match(LATIN_REPEATED)
        return F.col("text").rlike(LATIN_REPEATED), finding("punctuation", "repeated", "warn", F.concat(m["hit"], F.lit("@"), m["at"].cast("string")))
    checks = {name: F.col("text").rlike(p) for name, p in PUNCTUATION.items()}
    checks["mixed-brackets"] = F.col("text").rlike("[（）]") & F.col("text").rlike("[()]")
    any_ = checks["mixed-brackets"]
    for name in PUNCTUATION:
        any_ = any_ | checks[name]
    at = F.least(*[F.when(F.col("text").rlike(p), F.regexp_instr("text", F.lit(p)) - 1) for p in PUNCTUATION.values()])
    actual = F.concat(F.array_join(labelled(checks), ","), F.lit("@"), F.coalesce(at.cast("string"), F.lit("-")))
    return F.col("text").rlike(SUSPECT) & any_, finding("punctuation", "marks", "warn", actual)


def traces() -> tuple[Column, Column]:
    """Tokens of unfinished work, in the order in which they stand."""
    places = F.array(*[F.struct(F.instr("text", token).alias("at"), F.lit(token).alias("token")) for token in TRACES])
    hits = F.array_sort(F.filter(places, lambda x: x["at"] > 0))
    return F.greatest(*[F.contains("text", F.lit(t)) for t in TRACES]), finding("process-trace", "token", "warn", F.array_join(F.transform(hits, lambda x: x["token"]), ","))


def spacing() -> tuple[Column, Column]:
    """A space between Han and Latin in one place and none in another."""
    tight, spaced = F.regexp_count("text", F.lit(HAN_ASCII)), F.regexp_count("text", F.lit(HAN_SPACE_ASCII))
    return F.col("text").rlike(HAN_ASCII) & F.col("text").rlike(HAN_SPACE_ASCII), finding("cjk-spacing", "mixed", "info", F.concat_ws(":", tight, spaced))


def widths() -> tuple[Column, Column]:
    return F.col("text").rlike("[０-９Ａ-Ｚａ-ｚ]") & F.col("text").rlike("[0-9A-Za-z]"), finding("fullwidth-halfwidth", "mixed", "info", F.lit("both"))


#: Rules about one paragraph: a condition and a finding each, from the standards.
ROW_RULES = {
    "quote-style": lambda std: curved(source_of(std, "quote_style")) if std.get("quote_style") == "straight" else None,
    "punctuation": lambda std: marks(std.get("profile", "cjk")),
    "process-trace": lambda std: traces(),
    "cjk-spacing": lambda std: spacing(),
    "fullwidth-halfwidth": lambda std: widths(),
}


def row_rules(body: DataFrame, std: dict, names: list[str]) -> DataFrame:
    """Issues of the named rules about single paragraphs, in one look at each."""
    findings = [f for n in names if (f := ROW_RULES[n](std)) is not None]
    return of_findings(body if findings else body.limit(0), findings or [widths()], "L3")


def quote_style(body: DataFrame, std: dict) -> DataFrame:
    return row_rules(body, std, ["quote-style"])


def punctuation(body: DataFrame, std: dict, profile: str = "cjk") -> DataFrame:
    """One issue a paragraph: which detectors hit, and the first place."""
    return row_rules(body, std | {"profile": profile}, ["punctuation"])


def dash_density(body: DataFrame, std: dict, profile: str = "cjk") -> DataFrame:
    """Paragraphs of three dashes or more; and documents whose dashes per 1000 Han (or letters) exceed the standard.

    Each text is counted once: a document's paragraphs with dashes are gathered, as numbers, beside its sums.
    """
    limit = std.get("dash_per_1000_max")
    chars = T.han_count("text") if profile == "cjk" else F.length(F.regexp_replace("text", r"\P{L}+", ""))
    dashes = F.length("text") - F.length(F.replace("text", F.lit(EM_DASH), F.lit("")))
    counted = body.select("doc_id", "para_index", F.when(dashes >= 3, F.substring("text", 1, 46)).alias("text"), dashes.alias("d"), (chars if limit is not None else F.lit(0)).alias("c"))
    dense = F.struct((-F.col("d") / F.greatest("c", F.lit(1))).alias("rate"), "para_index", "d", "text")
    doc = counted.groupBy("doc_id").agg(F.sum("d").alias("d"), F.sum("c").alias("c"), F.array_sort(F.collect_list(F.when(F.col("d") > 0, dense))).alias("rows")).filter("d > 0")
    top = F.array_join(F.transform(F.slice("rows", 1, 3), lambda x: x["para_index"].cast("string")), ",")
    over = F.lit(False) if limit is None else (F.col("c") > 0) & (F.col("d") * 1000 > F.lit(limit) * F.col("c"))
    paras = F.transform(F.filter("rows", lambda x: x["d"] >= 3), lambda x: F.struct(F.lit("paragraph").alias("sub"), F.lit("info").alias("severity"), F.lit("paragraph").alias("kind"), x["para_index"].cast("int").alias("i"), x["text"].alias("text"), x["d"].cast("string").alias("actual"), F.lit(None).cast("string").alias("expected")))
    whole = F.struct(F.lit("document").alias("sub"), F.lit("warn").alias("severity"), F.lit("document").alias("kind"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("text"), F.concat_ws(":", "d", "c", top).alias("actual"), F.lit(str(limit)).alias("expected"))
    found = doc.select("doc_id", F.explode(F.concat(paras, F.when(over, F.array(whole)).otherwise(F.array().cast("array<struct<sub:string,severity:string,kind:string,i:int,text:string,actual:string,expected:string>>")))).alias("f")).select("doc_id", "f.*")
    return as_issues(found, "dash-density", F.col("sub"), "L3", F.col("severity"), F.col("actual"), F.col("i"), F.col("expected"), F.col("text"), kind=F.col("kind"), source=F.when(F.col("kind") == "document", source_of(std, "dash_per_1000_max")).otherwise("default"))


def heading_style(heads: DataFrame, std: dict) -> DataFrame:
    """Headings that are long, marked, hedged or end in a mark; and second-level headings with many of the third level."""
    t = F.col("text")
    checks = {"hedge": F.greatest(*[t.contains(h) for h in HEDGES]), "mark": t.rlike(HEADING_MARK), "trailing": t.rlike(HEADING_TRAIL)}
    if std.get("heading_max_chars") is not None:
        checks = {"long": F.length(t) > std["heading_max_chars"]} | checks
    each = heads.withColumn("labels", labelled(checks)).filter(F.size("labels") > 0)
    out = as_issues(each, "heading-style", "each", "L3", "warn", F.array_join("labels", ","), F.col("para_index"), None, t, source=F.when(F.array_contains("labels", "long"), source_of(std, "heading_max_chars")).otherwise("default"))
    most = std.get("max_h3_per_h2")
    if most is None:
        return out
    w = Window.partitionBy("doc_id").orderBy("para_index").rowsBetween(Window.unboundedPreceding, 0)
    under = heads.withColumn("h2", F.last(F.when(F.col("style_level") == 2, F.col("para_index")), ignorenulls=True).over(w))
    many = under.filter("style_level = 3 and h2 is not null").groupBy("doc_id", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return out.unionByName(as_issues(many, "heading-style", "h3-per-h2", "L3", "warn", F.col("n"), F.col("h2"), str(most), source=source_of(std, "max_h3_per_h2")))


def process_trace(body: DataFrame, std: dict) -> DataFrame:
    return row_rules(body, std, ["process-trace"])


def cjk_spacing(body: DataFrame, std: dict) -> DataFrame:
    return row_rules(body, std, ["cjk-spacing"])


def width_mix(body: DataFrame, std: dict) -> DataFrame:
    return row_rules(body, std, ["fullwidth-halfwidth"])


def term_consistency(body: DataFrame, variants: DataFrame, inline: int = 200) -> DataFrame:
    """Concepts of which a document uses several variants: variants(concept, variant). Lists the first paragraphs of each.

    The term map is a person's file. Up to so many variants become one expression, so that each paragraph is looked at once;
    more are broadcast as one array, which is read once a paragraph, too.
    """
    known = variants.select("concept", "variant").distinct()
    terms = [(r["concept"], r["variant"]) for r in known.orderBy("concept", "variant").limit(inline + 1).collect()]
    if not terms:
        return as_issues(body.limit(0), "term-consistency", "variants", "L3", "warn", F.lit(""), kind="document")
    if len(terms) <= inline:
        hits = F.array_compact(F.array(*[F.when(F.col("text").contains(v), F.struct(F.lit(c).alias("concept"), F.lit(v).alias("variant"))) for c, v in terms]))
        used = body.select("doc_id", "para_index", F.explode(hits).alias("t"))
    else:
        all_ = known.agg(F.collect_list(F.struct("concept", "variant")).alias("terms"))
        used = body.join(F.broadcast(all_)).select("doc_id", "para_index", F.explode(F.filter("terms", lambda t: F.contains(F.col("text"), t["variant"]))).alias("t"))
    used = used.groupBy("doc_id", "t.concept", "t.variant").agg(F.slice(F.array_sort(F.collect_set("para_index")), 1, 3).alias("paras"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "paras"))), lambda x: F.concat(x["variant"], F.lit("@"), F.array_join(x["paras"].cast("array<string>"), "/"))), ",")
    several = used.groupBy("doc_id", "concept").agg(F.count(F.lit(1)).alias("n"), shown.alias("shown")).filter("n > 1")
    return as_issues(several, "term-consistency", "variants", "L3", "warn", F.concat_ws("=", "concept", "shown"), kind="document")
