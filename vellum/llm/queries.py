"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import chat, codes, decontaminate, divergence, html_main, langid, licenses, line_dup, near_dup, pack, quality, sentence_spans, shard
from vellum.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.digest(shard.shard(table(spark, sf_dir, "documents"), 40, folder=shard.folder_of(spark, f"{sf_dir}/documents/40")))


def op3_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(near_dup.component_table(table(spark, sf_dir, "documents")))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.pairs(chat.own_replies(table(spark, sf_dir, "conversations"))))


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.digest(pack.pack(table(spark, sf_dir, "documents")))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op7_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.without_repeats(table(spark, sf_dir, "documents"), window=sentence_spans.WINDOW)


def op9_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op10_line_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dup.removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(*codes.compress(table(spark, sf_dir, "embeddings")))


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_spaced_seeds, op2_virtual_slots, op3_bayesian_minhash, op4_preference_pairs, op5_cost_balanced_packing, op6_risk_controlled_rules, op7_word_first_language,
            op8_sentence_spans, op9_text_to_tag_ratio, op10_line_similarity_join, op11_source_divergence, op12_yinyang_codes, op13_license_rules,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_preference_pairs": OP4_SQL, "op10_line_similarity_join": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_yinyang_codes": OP12_SQL}


#: Lines as sets of words; a later one goes if any earlier one is similar. Equal sets are one class, and classes of similar
#: sizes are compared whole.
OP10_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
sets AS (SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM lines),
firsts AS (SELECT s, len(s) AS n, min(struct_pack(d := doc_id, k := k)) AS first FROM sets WHERE len(s) > 0 GROUP BY s),
numbered AS (SELECT row_number() OVER (ORDER BY first) AS c, * FROM firsts),
words AS (SELECT c, n, first, unnest(s) AS w FROM numbered),
ranked AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY f, w) AS place FROM words JOIN (SELECT w, count(*) AS f FROM words GROUP BY w) USING (w)),
prefix AS (SELECT c, n, w FROM ranked WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT x.c AS x, y.c AS y FROM prefix x JOIN prefix y ON x.w = y.w AND x.c < y.c AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
near AS (SELECT y FROM pairs JOIN numbered a ON a.c = x JOIN numbered b ON b.c = y WHERE 180 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n)),
gone AS (
  SELECT doc_id, k FROM sets JOIN firsts USING (s) WHERE struct_pack(d := doc_id, k := k) <> first
  UNION SELECT (first).d, (first).k FROM numbered SEMI JOIN near ON y = c),
by_doc AS (SELECT doc_id, list_sort(list(k)) AS ks FROM gone GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ks, i - 1)), chr(10)) END AS text,
  coalesce(len(ks), 0)::BIGINT AS n_removed, coalesce(array_to_string(ks, ','), '') AS removed_lines
FROM documents LEFT JOIN by_doc USING (doc_id)
"""


OP4_SQL = """
WITH base AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS raw_role FROM conversations),
last AS (SELECT conv_id, max(turn) AS last FROM base WHERE raw_role = 'assistant' GROUP BY conv_id),
known AS (SELECT b.*, l.last FROM base b LEFT JOIN last l USING (conv_id)),
other AS (
  SELECT conv_id, coalesce(max_by(text, turn) FILTER (turn < last AND raw_role = 'assistant'), max_by(text, turn) FILTER (turn < last), '') AS other
  FROM known GROUP BY conv_id),
sides AS (
  SELECT k.conv_id, k.turn, k.role, k.text AS a,
    CASE WHEN k.turn = k.last AND k.raw_role = 'assistant' THEN o.other ELSE k.text END AS b,
    row_number() OVER (PARTITION BY k.conv_id ORDER BY k.turn, k.role, k.text) - 1 AS i
  FROM known k JOIN other o USING (conv_id)),
cut AS (SELECT *, coalesce(min(CASE WHEN a <> b THEN i END) OVER (PARTITION BY conv_id), count(*) OVER (PARTITION BY conv_id)) AS p FROM sides),
rendered AS (
  SELECT *, '<|' || role || '|>' || chr(10) || a || '<|end|>' || chr(10) AS ra, '<|' || role || '|>' || chr(10) || b || '<|end|>' || chr(10) AS rb FROM cut),
placed AS (
  SELECT *, sum(CASE WHEN i >= p THEN length(ra) ELSE 0 END) OVER w AS ea, sum(CASE WHEN i >= p THEN length(rb) ELSE 0 END) OVER w AS eb
  FROM rendered WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT conv_id,
  coalesce(string_agg(ra, '' ORDER BY i) FILTER (i < p), '') AS prompt,
  coalesce(string_agg(ra, '' ORDER BY i) FILTER (i >= p), '') AS chosen,
  coalesce(string_agg(rb, '' ORDER BY i) FILTER (i >= p), '') AS rejected,
  coalesce(string_agg((ea - 8 - length(a)  )::BIGINT::VARCHAR || '-' || (ea - 1)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (i >= p AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((eb - 8 - length(b)  )::BIGINT::VARCHAR || '-' || (eb - 1)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (i >= p AND role = 'assistant'), '') AS rejected_mask,
  max(p)::BIGINT AS prompt_turns, max(p) < count(*) AS has_preference
FROM placed GROUP BY conv_id
"""


#: Every kept term of a language against every group of it, without postings or automata.
OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
words AS (SELECT r, lang, source, unnest(found) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
lang_terms AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term),
lang_totals AS (SELECT lang, sum(n) AS total FROM counted GROUP BY lang),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.total + 5 * s.v) AS p
  FROM totals t JOIN kept k ON t.lang = k.lang JOIN sizes s ON t.lang = s.lang LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
lang_shares AS (
  SELECT k.lang, k.term, 1 + (1000000000 * (l.n + 5)) // (t.total + 5 * s.v) AS q
  FROM kept k JOIN lang_terms l ON l.lang = k.lang AND l.term = k.term JOIN lang_totals t ON t.lang = k.lang JOIN sizes s ON s.lang = k.lang),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
above AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - l.q)::BIGINT AS value
  FROM shares s JOIN lang_shares l ON s.lang = l.lang AND s.term = l.term WHERE s.n > 0 AND s.p > l.q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_sql() -> str:
    """Two rounds of plain Lloyd, every part against every entry of its codebook."""
    rounds, book = "", "book0"
    for k in (0, 1, 2):
        rounds += f"""
near{k} AS (
  SELECT vec_id, r, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d
  FROM (SELECT x.vec_id, x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN {book} b ON x.p = b.p)
  GROUP BY vec_id, r, p),"""
        if k < 2:
            rounds += f"""
mean{k} AS (
  SELECT p, e, list(s ORDER BY i) AS v
  FROM (SELECT n.p, n.e, i, floor(sum(x.v[i])::DOUBLE / count(*))::BIGINT AS s FROM near{k} n JOIN parts x ON n.r = x.r AND n.p = x.p, range(1, 5) t(i) GROUP BY n.p, n.e, i)
  GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e),"""
            book = f"book{k + 1}"
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, r, p, v[4 * p + 1 : 4 * p + 4] AS v FROM kept, range(16) t(p)),
book0 AS (SELECT p, r AS e, v FROM parts WHERE r < 64),{rounds}
coded AS (SELECT vec_id, r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id, r),
labelled AS (SELECT c.*, k.label FROM coded c JOIN kept k ON c.r = k.r),
flat AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS books FROM {book})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256 FROM labelled, flat
"""


OP12_SQL = op12_sql()
