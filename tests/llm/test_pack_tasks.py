"""Packing spreads over all cores, and joins what is small."""

from pyspark.sql import functions as F

from vellum.llm import pack


def test_long_documents_use_all_cores_and_small_tables_one_task(spark):
    cores = spark.sparkContext.defaultParallelism
    long_ = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many words "), 9000).alias("text"))
    assert pack.dealt(long_.coalesce(1)).rdd.getNumPartitions() == cores
    assert pack.dealt(long_.repartition(19)).rdd.getNumPartitions() == min(19, 400 * 99016 // pack.TASK_BYTES)
    short = spark.range(4000).repartition(64).select(F.col("id").alias("doc_id"), F.lit("one").alias("text"))
    assert pack.dealt(short).rdd.getNumPartitions() == 1 and pack.dealt(short.limit(0)).rdd.getNumPartitions() == 1


def test_pieces_are_whole_after_dealing_out(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words of it "), 1500).alias("text")).coalesce(1)
    out = pack.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert len(out) == 300 and all(r.n == r["of"] for r in out)
    sequences = pack.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padding = sequences.agg(F.sum(2048 - F.col("n")).alias("p"), F.sum("n").alias("n")).first()
    assert padding["p"] < 0.01 * padding["n"]
