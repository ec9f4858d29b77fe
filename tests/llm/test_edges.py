"""Unusual tables: every operator and stage has a defined result for each and crashes on none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import chat, decontaminate, html_main, langid, line_dup, near_dup, pack, quality, sentence_spans, shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"Line number {i} of a very long text goes on with word{i} and more{i * 7}." for i in range(20000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, "s", 4),
    (4, "one", "en", None, 3),
    (5, "Same text of a few plain words that comes twice. It does so here.", "en", "s", 66),
    (5, "Same text of a few plain words that comes twice. It does so here.", "en", "s", 66),
    (6, "Same text of a few plain words that comes twice. It does so here.", "de", "s", 66),
    (7, "Ein anderer Satz mit manchen Wörtern   und \x1c Zeichen \U0001f600.", "de", "s", 50),
    (None, "A row without an id has some words of its own, too.", "en", "s", 51),
    (8, LONG, "en", "s", len(LONG)),
    (9, "123 456 ² ---", None, "s", 12),
]
TESTS = [(1, "Line number 77 of a very long text goes on with word77 and more539."), (2, None), (3, ""), (4, "one")]


def documents(spark, rows=ROWS):
    clash = ["hash", "mark", "line", "later", "kept", "component_id", "vslot", "slot", "group", "id", "a", "b", "n", "root", "p", "stratum", "first", "where", "n_words", "rest", "__x"]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(c) for c in clash])


def test_order_of_rows_does_not_matter_for_ids(spark):
    docs = documents(spark)
    out = {r.doc_id: r for r in near_dup.digest(near_dup.component_table(docs)).collect()}
    assert out[5].component_id == out[6].component_id == 5 and not out[6].kept
    assert out[1].n_shingles == out[2].n_shingles == out[3].n_shingles == 0 and out[1].kept and out[3].component_id == 3
    assert out[4].n_shingles == 1 and out[None].component_id is None and out[None].kept
    kept = [r.doc_id for r in near_dup.deduplicated(docs).collect()]
    assert sorted(x or 0 for x in kept) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert near_dup.deduplicated(docs).columns == docs.columns


def test_shards_hold_every_row(spark):
    out = shard.digest(shard.shard(documents(spark), 3)).collect()
    assert len(out) == len(ROWS)
    assert [r["size"] for r in out if r.doc_id == 1] == [16] and [r.text_crc32 for r in out if r.doc_id == 1] == [0]
    for k in {r["shard"] for r in out}:
        assert sorted(r.slot for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))


def test_a_repeated_row_is_spread(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("equal text").alias("text"))
    loads = shard.shard(docs, 8).groupBy("shard").count().collect()
    assert len(loads) == 8 and max(r["count"] for r in loads) < 1.1 * 3000 / 8


def test_lines(spark):
    docs = documents(spark)
    out = line_dup.deduplicated(docs).collect()
    assert len(out) == len(ROWS)
    texts = {}
    for r in out:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[5] == [ROWS[4][1]] * 2 and texts[6] == [""] and texts[1] == [None] and texts[3] == [" \n\t "] and texts[8][0] != ""
    assert next(r for r in out if r.doc_id == 6).n_chars == 0


def test_spans(spark):
    rows = [*ROWS, (20, "New. " + "This passage is long enough to be found, as it has many plain words in it. And it has another sentence with some words. ", "en", "s", 1)]
    rows += [(21, "Before it. " + rows[-1][1] + "After.", "en", "s", 1), (22, None, None, None, None)]
    out = {r.doc_id: r for r in sentence_spans.without_repeats(documents(spark, rows)).collect()}
    assert out[20].removed == 0 and out[20].text == rows[-3][1]
    assert out[21].text == "Before it. New. After." or out[21].text == "Before it. After."
    assert out[22].text is None and out[8].text == LONG


def test_overlaps(spark):
    bench = spark.createDataFrame(TESTS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.overlaps(documents(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.short_item) for r in out) == [(4, 4, True), (8, 1, False)]
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(documents(spark), bench).collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 9]


def test_packing_keeps_every_id(spark):
    import numpy as np

    out = pack.pack(documents(spark)).collect()
    encode = pack.Encoder(*pack.vocabulary())
    want = sorted((r[0] or 0, [*encode(r[1] or ""), 1]) for r in ROWS)
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id or 0, r.start)):
        got.setdefault(r.doc_id or 0, []).append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
    for doc, ids in want:
        pieces = [p for s, p in got[doc]]
        assert sum(map(len, pieces)) == len(ids) * sum(d == doc for d, _ in want)
        if doc != 5:
            assert [x for p in pieces for x in p] == ids


def test_quality(spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    out = quality.digest(quality.judge(documents(spark), labels)).collect()
    assert len(out) == len(ROWS) and next(r for r in out if r.doc_id == 1).n_words == 0
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 50)


def test_language(spark):
    out = {r.doc_id: r for r in langid.identify(documents(spark)).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[9].lang_pred == "und" and out[1].score == 0
    assert all(0 <= r.score <= 1 for r in out.values())


def test_html(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>A &amp; b<p>c<br>d"), (4, "u", "<article><p>x</p></article><![broken <p>y"), (4, "u", "plain"), (5, "u", "<p>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_main.extract(pages).collect()
    assert [r.text for r in out][:3] == ["", "", "A & b\nc d"] and out[4].text == "plain" and out[5].text == "deep" and out[0].n_chars == 0


def test_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", None), (None, 3, None, "x"), (3, 0, "user", "q"), (3, 0, "user", "q"), (3, 5, "assistant", "a")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash"))
    out = {r.conv_id: r for r in chat.digest(chat.pairs(chat.own_replies(table))).collect()}
    assert out[1].prompt == "<|user|>\nhi<|end|>\n" and out[1].rejected == "<|assistant|>\nhi<|end|>\n" and out[1].rejected_mask == "14-23"
    assert out[2].prompt_turns == 1 and out[2].chosen == out[2].rejected == ""
    assert out[3].prompt_turns == 2 and out[None].prompt_turns == 1


@pytest.mark.parametrize("name", ["documents", "pages", "turns"])
def test_empty_tables(spark, name):
    docs = documents(spark).limit(0)
    if name == "pages":
        assert html_main.extract(docs.select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.col("text").alias("html"))).count() == 0
    elif name == "turns":
        assert chat.pairs(chat.own_replies(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    else:
        bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
        for out in (
            near_dup.component_table(docs), near_dup.deduplicated(docs), shard.shard(docs), line_dup.deduplicated(docs), sentence_spans.without_repeats(docs), pack.pack(docs),
            decontaminate.overlaps(docs, bench), decontaminate.clean(docs, bench), quality.judge(docs, labels), langid.identify(docs), langid.accepted(docs),
        ):
            assert out.count() == 0
        assert decontaminate.overlaps(documents(spark), bench).count() == 0


def test_stages_keep_columns(spark, tmp_path):
    spark.createDataFrame(TESTS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        docs = after
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).count() > 0
