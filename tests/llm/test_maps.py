"""The stored map of slots: built as by a plain greedy choice, loaded, edited, never written over."""

import tempfile
from collections import defaultdict

from pyspark.sql import functions as F

from vellum.llm import shard


def docs(spark, n, size=100):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr(f"repeat('x', cast(id * 37 % {size} as int))").alias("text"))


def where(out):
    return {r.doc_id: r["shard"] for r in out.collect()}


def test_map_is_the_greedy_one(spark):
    loads = shard.slot_loads(shard.with_parts(shard.records(docs(spark, 3000), 64), 7))
    units = sorted((-r.bytes, r.vslot, r.part) for r in loads.collect())
    held, want = [0] * 7, {}
    for b, slot, part in units:
        at = held.index(min(held))
        held[at] -= b
        want[slot, part] = at
    assert {(r.vslot, r.part): r["shard"] for r in shard.build_map(loads, 7).collect()} == want


def test_a_second_run_moves_nothing(spark):
    folder = tempfile.mkdtemp()
    one = shard.shard(docs(spark, 2000), 5, folder=folder)
    first = where(one)
    assert {r.version for r in one.select("version").distinct().collect()} == {1} and shard.versions(spark, folder) == [1]
    again = shard.shard(docs(spark, 2000), 5, folder=folder)
    assert where(again) == first and {r.version for r in again.select("version").distinct().collect()} == {1} and shard.versions(spark, folder) == [1]


def test_a_grown_table_edits_the_map(spark):
    folder = tempfile.mkdtemp()
    first = where(shard.shard(docs(spark, 2000), 5, folder=folder))
    # one shard's records become heavier: it gives up slots, and the others keep theirs
    heavy = docs(spark, 2000).withColumn("text", F.when(F.col("doc_id").isin([d for d, s in first.items() if s == 2]), F.repeat("text", 3)).otherwise(F.col("text")))
    out = shard.shard(heavy, 5, folder=folder)
    now = where(out)
    moved = {d for d in first if now[d] != first[d]}
    assert moved and {first[d] for d in moved} == {2} and shard.versions(spark, folder) == [1, 2]
    assert {r.version for r in out.select("version").distinct().collect()} == {2}
    loads = defaultdict(int)
    for r in out.collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.05 * sum(loads.values()) / 5
    for s in range(5):
        assert sorted(r.slot for r in out.collect() if r["shard"] == s) == list(range(sum(v == s for v in now.values())))
    assert {(r.vslot, r.part): r["shard"] for r in shard.load_map(spark, folder, 1).collect()} != {(r.vslot, r.part): r["shard"] for r in shard.load_map(spark, folder).collect()}


def test_maps_of_empty_tables(spark):
    folder = tempfile.mkdtemp()
    for _ in range(2):
        assert shard.shard(docs(spark, 0), 5, folder=folder).count() == 0
    assert shard.shard(docs(spark, 100), 5, folder=folder).count() == 100


def test_fewer_shards_take_all_slots(spark):
    folder = tempfile.mkdtemp()
    first = where(shard.shard(docs(spark, 500), 5, folder=folder))
    now = where(shard.shard(docs(spark, 500), 4, folder=folder))
    assert set(now.values()) == {0, 1, 2, 3} and len(first) == len(now)
