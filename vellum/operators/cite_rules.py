"""Citation rules (L2): position, form, jumps, numbering, coverage, entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.issues import as_issues
from vellum.operators.standards import source_of

# Fixed patterns of the checks.
TYPE_CODE = r"\[(M|J|D|C|N|R|S|P|A|Z|G|EB/OL|DB/OL|J/OL|M/CD|C/OL|N/OL)\]"
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
PAGES = r"[:：]\s*\d"
STYLES = ("superscript-bracket", "superscript", "bracket")


def cite_position(cites: DataFrame, std: dict) -> DataFrame:
    if std.get("cite_position") != "before-punct":
        cites = cites.limit(0)
    after = as_issues(cites.filter("position = 'after-punct'"), "cite-position", "after", "L2", "error", F.col("text"), F.col("para_index"), "before-punct", kind="run", action="cite.move_before_punct", source=source_of(std, "cite_position"))
    end = as_issues(cites.filter("position = 'end-of-paragraph'"), "cite-position", "paragraph-end", "L2", "warn", F.col("text"), F.col("para_index"), "before-punct", kind="run", source=source_of(std, "cite_position"))
    return after.unionByName(end)


def cite_form(cites: DataFrame, std: dict) -> DataFrame:
    """Superscript and brackets as the style wants them; sizes set by hand, unless allowed."""
    style, source = std.get("cite_style"), source_of(std, "cite_style")
    if style not in STYLES:
        return as_issues(cites.select("doc_id").distinct(), "cite-form", "unsupported", "L2", "info", F.lit(str(style)), kind="document", source=source)
    raised, square = style.startswith("superscript"), style.endswith("bracket")
    wrong = cites.filter(F.col("superscript") != F.lit(raised))
    out = as_issues(wrong, "cite-form", "superscript" if raised else "no-superscript", "L2", "error", F.col("text"), F.col("para_index"), style, kind="run", action="cite.superscript", params=F.create_map(F.lit("on"), F.lit(str(raised).lower())), source=source)
    if square:
        other = cites.filter("bracket <> 'square'")
        params = F.create_map(F.lit("text"), F.concat(F.lit("["), F.array_join(F.col("refs").cast("array<string>"), ","), F.lit("]")))
        out = out.unionByName(as_issues(other, "cite-form", "bracket", "L2", "error", F.concat_ws(":", "text", "bracket"), F.col("para_index"), style, kind="run", action="cite.rewrite", params=params, source=source))
    if not std.get("cite_allow_explicit_size") and "size_pt" in cites.columns:
        sized = cites.filter("size_pt is not null")
        out = out.unionByName(as_issues(sized, "cite-form", "explicit-size", "L2", "warn", F.col("size_pt"), F.col("para_index"), style, kind="run", action="run.clear_size", source=source_of(std, "cite_allow_explicit_size", "cite_style")))
    return out


def link_kind(cites: DataFrame) -> DataFrame:
    """(doc_id, kind): the link kind most used, the first met among equals; hyperlink where there is none."""
    used = cites.filter("link_kind is not null").groupBy("doc_id", "link_kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("para_index", "start")).alias("first"))
    best = used.groupBy("doc_id").agg(F.max_by("link_kind", F.struct("n", -F.col("first.para_index"), -F.col("first.start"))).alias("kind"))
    return cites.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("kind", F.lit("hyperlink")).alias("kind"))


def jump_state(cites: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """cites with state: ok, dangling, wrong, nolink, or multi for a token of several numbers."""
    one = cites.withColumn("target", F.when(F.size("refs") == 1, F.concat(F.lit("ref"), F.col("refs")[0].cast("string"))))
    names = bookmarks.select("doc_id", F.col("name").alias("target")).distinct().withColumn("there", F.lit(True))
    known = one.join(names, ["doc_id", "target"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    right = F.col("anchor") == F.col("target")
    return known.withColumn(
        "state",
        F.when(F.size("refs") > 1, "multi").when(right & F.col("there"), "ok").when(right, "dangling").when(F.col("anchor").isNotNull(), "wrong").when(F.col("there"), "nolink").otherwise("dangling"),
    )


def cite_jump(cites: DataFrame, entries: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Entries without their bookmark, and citations that lead nowhere or elsewhere."""
    name = F.concat(F.lit("ref"), F.col("number").cast("string"))
    own = bookmarks.select("doc_id", "para_index", F.col("name").alias("own")).distinct()
    numbered = entries.filter("number is not null").withColumn("own", name)
    missing = numbered.join(own, ["doc_id", "para_index", "own"], "left_anti")
    out = as_issues(missing, "cite-jump", "bookmark", "L2", "error", F.col("own"), F.col("para_index"), suppressible=False, action="ref.bookmark", params=F.create_map(F.lit("name"), F.col("own")))
    states = jump_state(cites, bookmarks).join(link_kind(cites), "doc_id")
    # one look at each citation: the joins above aren't worked out for every state
    state, multi, mendable = F.col("state"), F.col("state") == "multi", F.col("state").isin("wrong", "nolink")
    link = F.when(mendable, F.create_map(F.lit("anchor"), F.col("target"), F.lit("kind"), F.col("kind"))).otherwise(F.create_map().cast("map<string,string>"))
    severity = F.when(multi, "warn").otherwise("error")
    return out.unionByName(as_issues(states.filter("state <> 'ok'"), "cite-jump", state, "L2", severity, F.col("text"), F.col("para_index"), kind="run", suppressible=multi, action=F.when(mendable, "cite.link"), params=link))


def cited(cites: DataFrame) -> DataFrame:
    """(doc_id, number, first): each cited number with its first place, counted over (paragraph, offset, place in the token)."""
    each = cites.select("doc_id", "para_index", "start", F.posexplode("refs").alias("k", "number"))
    return each.groupBy("doc_id", "number").agg(F.min(F.struct("para_index", "start", "k")).alias("first"))


def cite_numbering(cites: DataFrame, entries: DataFrame, std: dict) -> DataFrame:
    by_doc = Window.partitionBy("doc_id").orderBy("order")
    none = entries.filter("number is null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("order")).cast("array<string>"), ",").alias("which"))
    out = as_issues(none, "cite-numbering", "none", "L2", "error", F.col("which"), kind="document", suppressible=False)
    ranked = entries.filter("number is not null").withColumn("k", F.row_number().over(by_doc))
    shown = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("k", "number"))), lambda x: x["number"].cast("string")), 1, 12), ",")
    gaps = ranked.groupBy("doc_id").agg(F.bool_or(F.col("number") != F.col("k")).alias("bad"), shown.alias("shown")).filter("bad")
    out = out.unionByName(as_issues(gaps, "cite-numbering", "discontinuous", "L2", "error", F.col("shown"), kind="document", suppressible=False))
    if std.get("bib_system") == "sequence":
        w = Window.partitionBy("doc_id").orderBy("first")
        steps = cited(cites).withColumn("before", F.lag("number").over(w)).filter("before > number").withColumn("k", F.row_number().over(w)).filter("k <= 8")
        wrong = steps.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "before", "number"))), lambda x: F.concat(x["before"].cast("string"), F.lit(">"), x["number"].cast("string"))), ",").alias("shown"))
        out = out.unionByName(as_issues(wrong, "cite-numbering", "first-cite-order", "L2", "warn", F.col("shown"), kind="document", source=source_of(std, "bib_system")))
    return out


def ref_coverage(cites: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that are never cited, and cited numbers without an entry; only where a document has both."""
    used, listed = cited(cites).select("doc_id", "number"), entries.filter("number is not null").select("doc_id", "number").distinct()
    both = used.select("doc_id").intersect(listed.select("doc_id"))
    as_list = F.array_join(F.array_sort(F.collect_list("number")).cast("array<string>"), ",").alias("which")
    unused = listed.join(both, "doc_id", "left_semi").join(used, ["doc_id", "number"], "left_anti").groupBy("doc_id").agg(as_list)
    missing = used.join(both, "doc_id", "left_semi").join(listed, ["doc_id", "number"], "left_anti").groupBy("doc_id").agg(as_list)
    out = as_issues(unused, "ref-coverage", "unused", "L2", "warn", F.col("which"), kind="document")
    return out.unionByName(as_issues(missing, "ref-coverage", "missing", "L2", "error", F.col("which"), kind="document", suppressible=False))


def ref_format(entries: DataFrame) -> DataFrame:
    t = F.col("text")
    behind_year = F.substring(t, F.regexp_instr(t, F.lit(YEAR)) + 4, 100000)
    journal = t.contains("[J]") & t.rlike(YEAR) & ~behind_year.rlike(PAGES)
    out = None
    for sub, wrong in (("type", ~t.rlike(TYPE_CODE)), ("year", ~t.rlike(YEAR)), ("pages", journal)):
        part = as_issues(entries.filter(wrong), "ref-format", sub, "L2", "warn", F.col("order"), F.col("para_index"), text=t)
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_key(text="text"):
    """The first 30 characters of the normalised text without its number. Of a long text only its beginning is normalised."""
    beginning = F.regexp_extract(F.regexp_replace(text, T.REF_NUM, ""), r"(?U)^[\s　]*(?:[^\s　][\s　]*+){0,30}+", 0)
    return F.substring(T.norm(beginning), 1, 30)


def ref_duplicate(entries: DataFrame) -> DataFrame:
    """Entries whose key an earlier entry has. The window is over one document's entries with one key."""
    w = Window.partitionBy("doc_id", "key").orderBy("order")
    ranked = entries.withColumn("key", duplicate_key()).filter("key <> ''").withColumn("k", F.row_number().over(w)).withColumn("first", F.first(F.coalesce("number", "order")).over(w))
    return as_issues(ranked.filter("k > 1"), "ref-duplicate", "key", "L2", "error", F.concat(F.lit("="), F.col("first").cast("string")), F.col("para_index"), suppressible=False, text=F.col("text"))
