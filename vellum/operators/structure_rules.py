"""Structure and length rules (L4): heading sequence, captions, abstract, lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.derive import FIGURE_REF
from vellum.operators.issues import as_issues
from vellum.operators.standards import source_of


def dotted(num: str = "num"):
    return F.array_join(F.col(num).cast("array<string>"), ".")


def gaps(numbers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and each number missing between the least and the most of the group: gaps and islands as an array difference."""
    seen = numbers.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.collect_set(value).alias("seen"))
    return seen.select(*keys, F.explode(F.array_except(F.sequence("lo", "hi"), "seen")).alias("missing"))


def repeats(numbers: DataFrame, keys: list[str]) -> DataFrame:
    return numbers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def heading_sequence(heads: DataFrame) -> DataFrame:
    """Levels that style and number disagree on, prefixes that don't exist, gaps between siblings, repeated numbers."""
    numbered = heads.filter("num is not null")
    wrong = numbered.filter("style_level <> num_level")
    out = as_issues(wrong, "heading-sequence", "level", "L4", "error", F.concat_ws(":", dotted(), "style_level", "num_level"), F.col("para_index"), text=F.col("text"))
    parts = numbered.filter(F.size("num") > 1).select("doc_id", "para_index", "num", "text", F.explode(F.sequence(F.lit(1), F.size("num") - 1)).alias("k"))
    wanted = parts.withColumn("prefix", F.slice("num", 1, F.col("k")))
    known = numbered.select("doc_id", F.col("num").alias("prefix")).distinct()
    jumps = wanted.join(known, ["doc_id", "prefix"], "left_anti")
    out = out.unionByName(as_issues(jumps, "heading-sequence", "jump", "L4", "warn", F.concat_ws("<", dotted("prefix"), dotted()), F.col("para_index"), text=F.col("text")))
    siblings = numbered.select("doc_id", F.slice("num", 1, F.size("num") - 1).alias("prefix"), "num_level", F.element_at("num", -1).alias("last"))
    missing = gaps(siblings, ["doc_id", "prefix", "num_level"], "last").withColumn("num", F.concat("prefix", F.array("missing")))
    out = out.unionByName(as_issues(missing, "heading-sequence", "gap", "L4", "error", dotted(), kind="document"))
    twice = repeats(numbered, ["doc_id", "num"])
    return out.unionByName(as_issues(twice, "heading-sequence", "repeat", "L4", "error", F.concat_ws("x", dotted(), "n"), kind="document"))


def nearest_caption(blocks: DataFrame, caps: DataFrame, reach: int = 4) -> DataFrame:
    """Each table with its nearest table caption within `reach` blocks, the earlier of equals.

    The range join is an equi-join on buckets of 2 * reach blocks, of which a caption lies in its own and both neighbours,
    so that it costs the same however many tables a document has.
    """
    width = 2 * reach
    tables = blocks.filter("kind = 'tbl'").select("doc_id", F.col("ord").alias("t_ord"), F.floor(F.col("ord") / width).alias("bucket"))
    near = caps.filter("type = '表'").select("doc_id", "ch", "seq", F.col("ord").alias("c_ord"), F.explode(F.expr(f"array(floor(ord / {width}) - 1, floor(ord / {width}), floor(ord / {width}) + 1)")).alias("bucket"))
    both = tables.join(near, ["doc_id", "bucket"]).filter(F.abs(F.col("c_ord") - F.col("t_ord")) <= reach)
    w = Window.partitionBy("doc_id", "t_ord").orderBy(F.abs(F.col("c_ord") - F.col("t_ord")), "c_ord")
    return both.withColumn("k", F.row_number().over(w)).filter("k = 1").select("doc_id", "t_ord", "c_ord", "ch", "seq", F.when(F.col("c_ord") < F.col("t_ord"), "above").otherwise("below").alias("position"))


def figure_table(blocks: DataFrame, caps: DataFrame, std: dict) -> DataFrame:
    want = std.get("caption_table_position")
    placed = nearest_caption(blocks, caps).filter(F.lit(False) if want is None else F.col("position") != want)
    label = F.concat(F.col("type"), F.col("ch").cast("string"), F.lit("-"), F.col("seq").cast("string"))
    out = as_issues(placed, "figure-table", "position", "L4", "warn", F.concat(F.col("ch").cast("string"), F.lit("-"), F.col("seq").cast("string"), F.lit(" "), F.col("position")), F.col("t_ord"), want, kind="table", source=source_of(std, "caption_table_position"))
    missing = gaps(caps, ["doc_id", "type", "ch"], "seq").withColumn("seq", F.col("missing"))
    out = out.unionByName(as_issues(missing, "figure-table", "gap", "L4", "error", label, kind="document"))
    out = out.unionByName(as_issues(repeats(caps, ["doc_id", "type", "ch", "seq"]), "figure-table", "repeat", "L4", "error", label, kind="document"))
    return out.unionByName(as_issues(dangling_figures(blocks, caps), "figure-table", "dangling", "L4", "warn", F.col("ref"), kind="document"))


def dangling_figures(blocks: DataFrame, caps: DataFrame) -> DataFrame:
    """(doc_id, ref) of figures and tables that text refers to and no caption has, in documents with any caption."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s", ""), "[—.]", "-")
    paras = blocks.filter("kind = 'p'").join(caps.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    used = paras.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({FIGURE_REF})"), F.lit(1))).alias("r")).select("doc_id", clean(F.col("r")).alias("ref")).distinct()
    known = caps.select("doc_id", F.concat(F.col("type"), F.col("ch").cast("string"), F.lit("-"), F.col("seq").cast("string")).alias("ref")).distinct()
    return used.join(known.select("doc_id").distinct(), "doc_id", "left_semi").join(known, ["doc_id", "ref"], "left_anti")


def abstract_parts(blocks: DataFrame) -> DataFrame:
    """Paragraphs of the abstracts with part: cn from its title to the English title or keywords, en behind its own, and kw."""
    w = Window.partitionBy("doc_id")
    first = lambda c: F.min(F.when(c, F.col("para_index"))).over(w)
    t = T.strip("text")
    marks = blocks.filter("kind = 'p'").select("doc_id", "para_index", t.alias("text"), first(F.col("style_name") == "摘要标题").alias("cn"), first(F.col("style_name") == "英文摘要标题").alias("en"), first(t.startswith("关键词")).alias("kw"), first(T.norm("text") == "目录").alias("toc"), first(F.col("style_name") == "一级标题").alias("h1"))
    far = F.lit(1 << 30)
    end_cn = F.least(*[F.coalesce(F.when(F.col(c) > F.col("cn"), F.col(c)), far) for c in ("en", "kw", "toc", "h1")])
    end_en = F.least(*[F.coalesce(F.when(F.col(c) > F.col("en"), F.col(c)), far) for c in ("cn", "toc", "h1")])
    i = F.col("para_index")
    part = F.when(i == F.col("kw"), "kw").when((i > F.col("cn")) & (i < end_cn), "cn").when((i > F.col("en")) & (i < end_en) & ~F.lower("text").rlike(r"^key\s*words?"), "en")
    return marks.withColumn("part", part).filter("part is not null").select("doc_id", "para_index", "text", "part")


def abstract_layout(blocks: DataFrame, std: dict) -> DataFrame:
    """Lengths of both abstracts (an abstract that isn't there isn't judged), keywords, and what shouldn't be inside."""
    parts = abstract_parts(blocks)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x.rlike("[A-Za-z]")))
    sizes = parts.filter("part <> 'kw'").groupBy("doc_id", "part").agg(F.sum(F.when(F.col("part") == "cn", T.han_count("text")).otherwise(words)).alias("n"))
    limit = F.when(F.col("part") == "cn", F.lit(std.get("abstract_cn_max_chars"))).otherwise(F.lit(std.get("abstract_en_max_words")))
    limit_source = F.when(F.col("part") == "cn", source_of(std, "abstract_cn_max_chars")).otherwise(source_of(std, "abstract_en_max_words"))
    judged = sizes.withColumn("limit", limit.cast("int")).filter("limit is not null")
    out = as_issues(judged, "abstract-layout", "length", "L4", F.when(F.col("n") > F.col("limit"), "error").otherwise("info"), F.concat_ws(":", "part", "n"), kind="document", expected=F.col("limit").cast("string"), source=limit_source)
    keys = parts.filter("part = 'kw'").withColumn("marks", F.array_distinct(F.regexp_extract_all("text", F.lit("([；;，,])"), F.lit(1)))).withColumn("words", T.keywords("text"))
    out = out.unionByName(as_issues(keys, "abstract-layout", "keywords", "L4", F.when(F.size("marks") > 1, "warn").otherwise("info"), F.concat(F.size("words").cast("string"), F.lit(":"), F.array_join("marks", "")), F.col("para_index")))
    heads = blocks.filter("kind = 'p'").groupBy("doc_id").agg(F.bool_or(F.col("style_name").isin("摘要标题", "英文摘要标题")).alias("has"), F.bool_or(T.strip("text").startswith("关键词")).alias("kw")).filter("has and not kw")
    out = out.unionByName(as_issues(heads, "abstract-layout", "no-keywords", "L4", "warn", F.lit("none"), kind="document"))
    inside = parts.filter("part <> 'kw'")
    out = out.unionByName(as_issues(inside.filter(F.col("text").rlike(r"\[\s*\d+")), "abstract-layout", "citation", "L4", "warn", F.col("part"), F.col("para_index")))
    return out.unionByName(as_issues(inside.filter(F.col("text").rlike(FIGURE_REF)), "abstract-layout", "figure", "L4", "warn", F.col("part"), F.col("para_index")))


def chapter_lengths(blocks: DataFrame) -> DataFrame:
    """Han, full-width and visible characters by (doc_id, chapter), with the body's sum as chapter null, in one pass.

    blocks need region; a chapter is a running count of first-level headings.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumn("chapter", F.sum((F.col("style_name") == "一级标题").cast("int")).over(w)).filter("region = 'body' and kind = 'p'")
    sums = [F.sum(f("text")).alias(n) for f, n in ((T.han_count, "han"), (T.fullwidth_count, "fullwidth"), (T.visible_count, "visible"))]
    return placed.groupingSets([["doc_id", "chapter"], ["doc_id"]], "doc_id", "chapter").agg(*sums, F.grouping("chapter").alias("total"))


def chapter_shares(sums: DataFrame) -> DataFrame:
    """(doc_id, chapter, share): each chapter's share of the body's Han characters, from chapter_lengths()."""
    whole = sums.filter("total = 1 and han > 0").select("doc_id", F.col("han").alias("all"))
    return sums.filter("total = 0").join(whole, "doc_id").select("doc_id", "chapter", (F.col("han") / F.col("all")).alias("share"))


def length(blocks: DataFrame, std: dict) -> DataFrame:
    sums = chapter_lengths(blocks)
    whole = sums.filter("total = 1")
    out = as_issues(whole, "length", "summary", "L4", "info", F.concat_ws("/", "han", "fullwidth", "visible"), kind="document")
    least = std.get("body_min_chars")
    if least is None:
        return out
    return out.unionByName(as_issues(whole.filter(F.col("han") < least), "length", "short", "L4", "warn", F.col("han"), kind="document", expected=str(least), source=source_of(std, "body_min_chars")))
