"""Test items of a few words, and shards of tables that are written anew."""

from pyspark.sql import functions as F

from vellum.llm import decontaminate, shard


def test_short_items_are_found_word_for_word_and_flagged(spark):
    docs = spark.createDataFrame([(1, "So the quick brown fox jumps."), (2, "The QUICK, brown fox"), (3, "quick the brown fox"), (4, "fox"), (5, None), (6, "the quick brown")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "the quick brown fox"), (11, "fox"), (12, "brown, fox!"), (13, "The quick; brown fox"), (14, "..."), (15, None), (16, "fox jumps over it all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.start_word, r.short_item) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {
        (1, 10): (4, 1, True), (1, 13): (4, 1, True), (1, 11): (1, 4, True), (1, 12): (2, 3, True), (2, 10): (4, 0, True), (2, 13): (4, 0, True), (2, 11): (1, 3, True), (2, 12): (2, 2, True),
        (3, 11): (1, 3, True), (3, 12): (2, 2, True), (4, 11): (1, 0, True),
    }
    assert decontaminate.clean(docs, bench).count() == 6


def where(df, folder):
    return sorted((r.doc_id, r.text_crc32, r["shard"], r.vslot, r.part, r.version) for r in shard.shard(df, 6, folder=folder).collect())


def test_a_table_that_is_written_anew_moves_no_record(spark, tmp_path):
    """A third of all rows have one id, and half of these one text, so that their slot is split."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 6 == 0, "same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    folder = str(tmp_path / "maps")
    docs.repartition(2).write.parquet(f"{tmp_path}/a")
    first = where(spark.read.parquet(f"{tmp_path}/a"), folder)
    assert len({x[4] for x in first if x[0] == 7}) > 20
    docs.orderBy(F.rand(5)).repartition(7).write.parquet(f"{tmp_path}/b")
    assert where(spark.read.parquet(f"{tmp_path}/b"), folder) == first
    more = spark.read.parquet(f"{tmp_path}/b").unionByName(docs.limit(0).unionByName(spark.range(1).select(F.lit(90001).cast("long").alias("doc_id"), F.lit("new").alias("text"))))
    grown = [x[:5] for x in where(more, folder)]
    assert len(set(grown) - {x[:5] for x in first}) == 1


def test_equal_rows_are_numbered_in_chunks(spark, monkeypatch):
    docs = spark.range(100).select(F.lit(5).alias("doc_id"), F.lit("x").alias("text"))
    whole = sorted(map(tuple, shard.records(docs).collect()))
    monkeypatch.setattr(shard, "CHUNK", 7)
    assert sorted(map(tuple, shard.records(docs).collect())) == whole and len(whole) == 100
