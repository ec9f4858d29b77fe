"""Queries over the driver's tables, each with the SQL that another engine checks it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cite_rules as C
from vellum.operators import derive as D
from vellum.operators import issues as I
from vellum.operators import proposal_rules as P
from vellum.operators import standards as S
from vellum.operators import structure_rules as ST
from vellum.operators import text_rules as X
from vellum.operators.durable import scratch_folder
from vellum.plans import fixtures as L
from vellum.plans.registry import ORACLES, QUERIES, STD, brief, found, long, query, table
from vellum.sources import tables as B
from vellum.streaming import incremental as N


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks_of_text(table(spark, sf_dir, "documents"))


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks_of_text(table(spark, sf_dir, "documents").select("doc_id", F.expr(L.INJECTED).alias("text")))


BL = "bl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)"
BI = f"bl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM (SELECT doc_id, {L.INJECTED} AS text FROM documents))"


REPEATED_LATIN = "(\\.{2,}|,{2,}|!{2,}|\\?{2,}|;{2,}|:{2,})"


@query(f"WITH {BL} SELECT doc_id, p::BIGINT AS para_index, length(text)::BIGINT AS n_chars, length(regexp_replace(text, '[\\s\\x{{3000}}\\x{{00A0}}]', '', 'g'))::BIGINT AS n_visible FROM bl")
def text_blocks(spark, sf):
    return blocks(spark, sf).select("doc_id", long("para_index"), long(F.length("text"), "n_chars"), long(T.visible_count("text"), "n_visible"))


@query(f"WITH {BL} " + found(f"FROM bl WHERE regexp_matches(text, '{REPEATED_LATIN}')", "punctuation", "repeated", "warn", "p", f"regexp_extract(text, '{REPEATED_LATIN}', 0) || '@' || (strpos(text, regexp_extract(text, '{REPEATED_LATIN}', 0)) - 1)"))
def punctuation_latin(spark, sf):
    return brief(X.punctuation(blocks(spark, sf), STD, "latin"))


@query(f"""WITH {BL}, hits AS (SELECT doc_id FROM bl WHERE regexp_matches(text, '{REPEATED_LATIN}'))
SELECT 'severity' AS dimension, 'warn' AS value, count(*)::BIGINT AS n FROM hits UNION ALL SELECT 'skill', 'text-style', count(*)::BIGINT FROM hits
UNION ALL SELECT 'source', 'default', count(*)::BIGINT FROM hits UNION ALL SELECT 'all', '', count(*)::BIGINT FROM hits""")
def issue_tallies(spark, sf):
    return I.tallies(X.punctuation(blocks(spark, sf), STD, "latin"))


@query("SELECT coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def length_by_lang_source(spark, sf):
    sums = table(spark, sf, "documents").groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("docs"), long(F.sum(F.length("text")), "chars"))
    return sums.select(F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"), "docs", "chars")


CJK_CHECKS = {"repeated": "(。{2,}|，{2,}|！{2,}|？{2,}|；{2,}|：{2,}|、{2,})", "crossed": "(，。|。，)", "half-width": "[一-鿿][,.;?!][一-鿿]", "dots": "\\.{3,}", "stops": "。{3,}"}
_LABELS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in CJK_CHECKS.items())
_AT = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN strpos(text, regexp_extract(text, '{p}', 0)) - 1 END" for p in CJK_CHECKS.values())
_PUNCT = found("FROM (SELECT *, concat_ws(',', " + _LABELS + ", CASE WHEN regexp_matches(text, '[（）]') AND regexp_matches(text, '[()]') THEN 'mixed-brackets' END) AS labels, least(" + _AT + ") AS pos0 FROM bl) WHERE labels <> ''", "punctuation", "marks", "warn", "p", "labels || '@' || coalesce(pos0::VARCHAR, '-')")


@query(f"WITH {BI} {_PUNCT}")
def punctuation_cjk(spark, sf):
    return brief(X.punctuation(injected(spark, sf), STD))


_COUNT = "length(regexp_replace(text, '[^{0}]', '', 'g'))"


@query(f"WITH {BI} " + found("FROM bl WHERE regexp_matches(text, '[“”‘’]')", "quote-style", "curved", "warn", "p", f"{_COUNT.format('“”‘’')} || '@' || (strpos(text, regexp_extract(text, '[“”‘’]', 0)) - 1)"))
def quote_style(spark, sf):
    return brief(X.quote_style(injected(spark, sf), STD))


@query(f"WITH {BI}, c AS (SELECT doc_id, p, {_COUNT.format('—')} AS d, length(regexp_replace(text, '[^\\pL]', '', 'g')) AS c FROM bl), "
       "t AS (SELECT doc_id, string_agg(p::VARCHAR, ',' ORDER BY k) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d::DOUBLE / greatest(c, 1) DESC, p) AS k FROM c WHERE d > 0) WHERE k <= 3 GROUP BY doc_id), "
       "s AS (SELECT doc_id, sum(d)::BIGINT AS d, sum(c)::BIGINT AS c FROM c GROUP BY doc_id) "
       + found("FROM c WHERE d >= 3", "dash-density", "paragraph", "info", "p", "d") + " UNION ALL "
       + found("FROM s JOIN t USING (doc_id) WHERE c > 0 AND d * 1000 > 6.0 * c", "dash-density", "document", "warn", "NULL", "d || ':' || c || ':' || top"))
def dash_density(spark, sf):
    return brief(X.dash_density(injected(spark, sf), STD, "latin"))


@query(f"""WITH {BI}, c AS (SELECT doc_id, {_COUNT.format('—')} AS d, length(regexp_replace(text, '[^\\pL]', '', 'g')) AS c FROM bl), s AS (SELECT doc_id, sum(d) AS d, sum(c) AS c FROM c GROUP BY doc_id),
 i AS (SELECT 'quote-style' AS rule, 'warn' AS severity, 'template' AS source FROM bl WHERE regexp_matches(text, '[“”‘’]') UNION ALL SELECT 'dash-density', 'info', 'default' FROM c WHERE d >= 3 UNION ALL SELECT 'dash-density', 'warn', 'config' FROM s WHERE c > 0 AND d * 1000 > 9.5 * c UNION ALL SELECT rule, severity, 'default' FROM ({_PUNCT}))
 SELECT 'severity' AS dimension, severity AS value, count(*)::BIGINT AS n FROM i GROUP BY severity UNION ALL SELECT 'skill', CASE WHEN rule IN ('quote-style', 'dash-density', 'punctuation') THEN 'text-style' END AS skill, count(*)::BIGINT FROM i GROUP BY skill
 UNION ALL SELECT 'source', source, count(*)::BIGINT FROM i GROUP BY source UNION ALL SELECT 'all', '', count(*)::BIGINT FROM i""")
def tallies_of_three_tiers(spark, sf):
    """Findings by the tier that set their standard: a template's quotes, a configuration's dashes, the rest by default."""
    std = S.for_job('{"text": {"quote_style": "straight", "dash_per_1000_max": 4}}', '{"text": {"dash_per_1000_max": 9.5}}')
    body = injected(spark, sf)
    return I.tallies(I.merged([X.quote_style(body, std), X.dash_density(body, std, "latin"), X.punctuation(body, std)]))


_LAST = "CASE WHEN doc_id % 3 = 0 THEN concat('neu。。', CAST(doc_id AS STRING)) ELSE text END"


@query(f"WITH bi AS (SELECT doc_id, {L.INJECTED} AS text FROM documents), v AS (SELECT doc_id, {_LAST} AS text FROM bi WHERE doc_id % 5 <> 1), bl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM v) {_PUNCT}")
def incremental_audit(spark, sf):
    """Findings after three batches of versions: all documents; a third changed, all others again; a fifth deleted."""
    first = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), F.expr(L.INJECTED).alias("text"), F.lit(False).alias("deleted"))
    folder = scratch_folder(spark, "incremental")
    N.absorb(first, 0, folder, only=("punctuation",))
    N.absorb(first.withColumn("version", F.lit(2)).withColumn("text", F.expr(_LAST)), 1, folder, only=("punctuation",))
    N.absorb(first.filter("doc_id % 5 = 1").withColumn("version", F.lit(3)).withColumn("deleted", F.lit(True)), 2, folder, only=("punctuation",))
    return brief(N.current(spark, folder))


_TRACE = ", ".join(f"{{'at': strpos(text, '{t}'), 'token': '{t}'}}" for t in X.TRACES)


@query(f"WITH {BI}, h AS (SELECT doc_id, p, list_sort(list_filter([{_TRACE}], lambda x: x.at > 0)) AS hits FROM bl) " + found("FROM h WHERE len(hits) > 0", "process-trace", "token", "warn", "p", "array_to_string(list_transform(hits, lambda x: x.token), ',')"))
def process_trace(spark, sf):
    return brief(X.process_trace(injected(spark, sf), STD))


_N = "len(regexp_extract_all(text, '{0}'))"


@query(f"WITH {BI} " + found(f"FROM bl WHERE regexp_matches(text, '{X.HAN_ASCII}') AND regexp_matches(text, '{X.HAN_SPACE_ASCII}')", "cjk-spacing", "mixed", "info", "p", f"{_N.format(X.HAN_ASCII)} || ':' || {_N.format(X.HAN_SPACE_ASCII)}"))
def cjk_spacing(spark, sf):
    return brief(X.cjk_spacing(injected(spark, sf), STD))


@query(f"WITH {BI} " + found("FROM bl WHERE regexp_matches(text, '[０-９Ａ-Ｚａ-ｚ]') AND regexp_matches(text, '[0-9A-Za-z]')", "fullwidth-halfwidth", "mixed", "info", "p", "'both'"))
def fullwidth_mix(spark, sf):
    return brief(X.width_mix(injected(spark, sf), STD))


TERMS = L.values("concept, variant", "('art', ' the ')", "('art', ' The ')", "('von', 'tion')", "('von', 'ung')")


@query(f"WITH {BL}, v AS ({TERMS}), u AS (SELECT doc_id, concept, variant, list_sort(list_distinct(list(p)))[1:3] AS ps FROM bl JOIN v ON contains(text, variant) GROUP BY ALL), "
       "g AS (SELECT doc_id, concept, count(*) AS n, string_agg(variant || '@' || array_to_string(ps, '/'), ',' ORDER BY variant) AS shown FROM u GROUP BY ALL) "
       + found("FROM g WHERE n > 1", "term-consistency", "variants", "warn", "NULL", "concept || '=' || shown"))
def term_consistency(spark, sf):
    return brief(X.term_consistency(blocks(spark, sf), spark.sql(TERMS)))


_KEY = "substr(lower(regexp_replace(regexp_replace({0}, '^\\s*[\\[［]\\s*(\\d+)\\s*[\\]］]', ''), '\\s+', '', 'g')), 1, 30)"


@query(f"WITH k AS (SELECT doc_id, {_KEY.format('text')} AS key FROM documents) SELECT doc_id, first_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n, first_value(doc_id) OVER (PARTITION BY key ORDER BY doc_id) AS first_id FROM k WHERE key <> '') WHERE n > 1")
def duplicate_openings(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", C.duplicate_key().alias("key")).filter("key <> ''")
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return docs.join(first, "key").filter("doc_id <> first_id").select("doc_id", "first_id")


# the same operators on the star schema


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def coverage_unused_customers(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def coverage_missing_orders(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("WITH g AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, list(DISTINCT l_linenumber) AS seen FROM lineitem GROUP BY 1) SELECT l_orderkey, m::BIGINT AS missing FROM (SELECT l_orderkey, seen, unnest(range(lo, hi + 1)) AS m FROM g) WHERE NOT list_contains(seen, m::INT)")
def line_number_gaps(spark, sf):
    return ST.gaps(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", long("missing"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def line_number_repeats(spark, sf):
    return ST.repeats(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", long("l_linenumber"), "n")


@query("WITH f AS (SELECT user_id, event_type, min(struct_pack(t := ts, e := event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first)::BIGINT AS k, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY first) > event_type, false) AS out_of_order FROM f")
def first_seen_order(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    w = Window.partitionBy("user_id").orderBy("first")
    return first.select("user_id", "event_type", long(F.row_number().over(w), "k"), F.coalesce(F.lag("event_type").over(w) > F.col("event_type"), F.lit(False)).alias("out_of_order"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, lower(regexp_replace(text, '\\s+', '', 'g')) ORDER BY turn) - 1 AS nth FROM conversations")
def occurrence_counter(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_index"), F.lit(0).alias("start"), "text")
    return D.occurrences(turns).select(F.col("doc_id").alias("conv_id"), F.col("para_index").alias("turn"), long("nth"))


@query("WITH h AS (SELECT page_id, html FROM pages) SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g')) = trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title_is_h1, contains(html, '<nav') AS has_nav, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS links, (len(regexp_extract_all(html, '<p[ >]')) - len(regexp_extract_all(html, '</p>')))::BIGINT AS open_p, (len(regexp_extract_all(html, '<b>')) - len(regexp_extract_all(html, '</b>')))::BIGINT AS open_b FROM h")
def page_parts(spark, sf):
    p = B.page_parts(table(spark, sf, "pages"))
    return p.select("page_id", (F.col("title") == F.col("h1")).alias("title_is_h1"), "has_nav", "links", (F.col("p_open") - F.col("p_close")).alias("open_p"), (F.col("b_open") - F.col("b_close")).alias("open_b"))


@query("""SELECT target, count(*)::BIGINT AS n, count(DISTINCT page_id)::BIGINT AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1""")
def page_link_tally(spark, sf):
    return B.page_links(table(spark, sf, "pages")).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("WITH r AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '[#*$%&|<>]{3}')), g AS (SELECT doc_id FROM labels WHERE quality = 0), r2 AS (SELECT * FROM r SEMI JOIN labels USING (doc_id)) SELECT (SELECT count(*) FROM r2 SEMI JOIN g USING (doc_id))::BIGINT AS hits, (SELECT count(*) FROM g)::BIGINT AS golden, (SELECT count(*) FROM r2)::BIGINT AS reported, (SELECT count(*) FROM r2 ANTI JOIN g USING (doc_id))::BIGINT AS extra, (SELECT count(*) FROM g ANTI JOIN r2 USING (doc_id))::BIGINT AS missed")
def golden_scores(spark, sf):
    labels = table(spark, sf, "labels")
    flagged = table(spark, sf, "documents").filter(F.col("text").rlike("[#*$%&|<>]{3}")).join(labels, "doc_id", "left_semi")
    return P.scores(flagged, labels.filter("quality = 0"), ["doc_id"])


@query("SELECT doc_id, substr(sha1(lower(regexp_replace(text, '\\s+', '', 'g'))), 1, 12) AS fp, 'doc-' || lpad((('0x' || substr(sha1('doc|' || doc_id), 1, 8))::BIGINT % 10000)::VARCHAR, 4, '0') AS id FROM documents")
def fingerprints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fingerprint("text").alias("fp"), T.issue_id(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"))


from vellum.plans import document_queries, file_queries  # noqa: E402, F401  register their queries
