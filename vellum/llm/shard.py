"""Sharding by fixed virtual slots [native: DataFrame functions only].

Records are hashed into thousands of slots, bytes are summed per slot, and a small versioned map from slots to shards
says where each slot lives. The map is stored, a folder a version, and a later run loads it: records stay where they are.
Only the map is edited when shards are rebalanced or added; records never hash anew. A slot that one hot key has made large
is split by salt, and the map then holds its parts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, base_dir, settled

SLOTS = 4096
#: A shard gives up slots once it holds so much more than an even shard.
TOLERANCE = 0.01
MAP = "vslot int, part int, bytes long, n long, shard int"
#: Parts of a hot slot. A slot is hot if it outweighs a quarter of an even shard, so fewer than 4 per shard are.
PARTS = 64
PER_RECORD = 16
#: Equal rows that are numbered in one task at a time.
CHUNK = 100_000


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, salt) of docs(doc_id, text). A null text has no bytes and the crc 0."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(PER_RECORD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # equal rows are counted and numbered, so that the salt depends on what the table holds and not on how it lies in files
    same = ["doc_id", "size", "text_crc32"]
    chunks = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("times")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK))))
    first = F.col("chunk") * CHUNK
    numbered = chunks.repartition("doc_id", "chunk").select(*same, F.explode(F.sequence(first, F.least(first + CHUNK, F.col("times")) - 1)).alias("nth"))
    return numbered.select(
        *same, F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("vslot"), F.pmod(F.xxhash64(*same, "nth"), F.lit(PARTS)).cast("int").alias("salt")
    )


def with_parts(rows: DataFrame, shards: int) -> DataFrame:
    """rows with the part of their slot: 0, or the salt in slots over a quarter of an even shard."""
    loads = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    total = loads.agg(F.sum("bytes").alias("total"))
    hot = loads.join(F.broadcast(total), F.col("bytes") * (4 * shards) > F.col("total")).select("vslot", F.lit(True).alias("is_hot"))
    return rows.join(F.broadcast(hot), "vslot", "left").withColumn("part", F.when(F.col("is_hot"), F.col("salt")).otherwise(0)).drop("is_hot", "salt")


def slot_loads(parted: DataFrame) -> DataFrame:
    """(vslot, part, bytes, n): at most SLOTS + 4 * PARTS * shards rows, whatever the input."""
    return parted.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def build_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (version, vslot, part, bytes, n, shard): all slots of loads are dealt out."""
    units = loads.select("vslot", "part", "bytes", "n", F.lit(None).cast("int").alias("shard"), F.lit(True).alias("leaves"))
    return dealt(units, shards).select(F.lit(1).alias("version"), "*")


def dealt(units: DataFrame, shards: int) -> DataFrame:
    """(vslot, part, bytes, n, shard): slots that leave go, the largest first, to the shard that is lightest then, the first of equals.

    units has at most SLOTS + 4 * PARTS * shards rows, whatever the input, so the choice is a fold over one array and stays
    one SQL expression. Slots of equal size go by number.
    """
    all_ = units.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "vslot", "part", "n", "shard", "leaves"))).alias("all"))
    folded = all_.select("all", F.expr("filter(all, u -> u.leaves)").alias("units")).select("all", "units", F.expr(f"""
        aggregate(units, named_struct('loads', transform(sequence(0, {int(shards) - 1}), i -> aggregate(filter(all, u -> not u.leaves and u.shard = i), 0L, (x, u) -> x - u.b)), 'picks', cast(array() as array<int>)),
          (acc, u) -> named_struct(
            'loads', transform(acc.loads, (x, i) -> if(i = array_position(acc.loads, array_min(acc.loads)) - 1, x - u.b, x)),
            'picks', concat(acc.picks, array(cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)))),
          acc -> acc.picks)""").alias("picks"))
    new = folded.select(F.explode(F.arrays_zip("units", "picks")).alias("u")).select("u.units.vslot", "u.units.part", (-F.col("u.units.b")).alias("bytes"), "u.units.n", F.col("u.picks").alias("shard"))
    return units.filter("not leaves").select("vslot", "part", "bytes", "n", "shard").unionByName(new)


def edited(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for loads as they are now.

    Slots stay in their shard, but those that a shard over TOLERANCE gives up, in hash order and while they fit in what is
    over, and those that are new or whose shard isn't there any more. They go, the largest first, to the lightest shard.
    """
    last = slot_map.select("version", "vslot", "part", F.when(F.col("shard") < shards, F.col("shard")).alias("shard"))
    known = loads.join(F.broadcast(last.drop("version")), ["vslot", "part"], "left")
    by_shard = Window.partitionBy("shard")
    order = by_shard.orderBy(F.xxhash64("vslot", "part"), "vslot", "part").rowsBetween(Window.unboundedPreceding, 0)
    total = loads.agg((F.sum("bytes") / shards).alias("fair"))
    over = F.sum("bytes").over(by_shard) - F.col("fair")
    leaves = F.col("shard").isNull() | (over > TOLERANCE * F.col("fair")) & (F.sum("bytes").over(order) <= over)
    units = settled(known.join(F.broadcast(total)).withColumn("leaves", leaves).select("vslot", "part", "bytes", "n", "shard", "leaves"))
    version = last.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return dealt(units, shards).join(F.broadcast(version)).select("version", "vslot", "part", "bytes", "n", "shard")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of the map in a folder, those that were written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path)]
    return sorted(int(p.getName().rpartition("-")[2]) for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """A version of the map, the last unless given; None if the folder has none."""
    there = versions(spark, folder)
    return spark.read.schema("version int, " + MAP).parquet(f"{folder}/version-{version or there[-1]:06d}") if there else None


def store_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Writes a map as a version of the folder's, and reads it. Versions are never written over."""
    slot_map.withColumn("version", F.lit(version)).coalesce(1).write.parquet(f"{folder}/version-{version:06d}")
    return load_map(slot_map.sparkSession, folder, version)


def current_map(loads: DataFrame, shards: int, folder: str | None) -> DataFrame:
    """The stored map, edited for the loads and stored anew if slots have to move or are new; else a map of its own."""
    if folder is None:
        return settled(build_map(loads, shards))
    there = versions(loads.sparkSession, folder)
    if not there:
        return store_map(settled(build_map(loads, shards)), folder, 1)
    last = load_map(loads.sparkSession, folder, there[-1])
    made = settled(edited(last, loads, shards))
    where = ["vslot", "part", "shard"]
    if made.select(where).join(last.select(where), where, "left_anti").isEmpty():
        return made.withColumn("version", F.lit(there[-1]))  # as it was; bytes and rows are today's
    return store_map(made, folder, there[-1] + 1)


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map of that many shards, with one shard more.

    Every shard gives up slots, in hash order, while they fit in what it holds above the new even share. Slots move
    only into the new shard.
    """
    by_shard = Window.partitionBy("shard")
    order = by_shard.orderBy(F.xxhash64("vslot", "part"), "vslot", "part").rowsBetween(Window.unboundedPreceding, 0)
    fair = slot_map.agg((F.sum("bytes") / (shards + 1)).alias("fair"))
    out = slot_map.join(F.broadcast(fair)).withColumn("over", F.sum("bytes").over(by_shard) - F.col("fair")).withColumn("upto", F.sum("bytes").over(order))
    return out.select((F.col("version") + 1).alias("version"), "vslot", "part", "bytes", "n", F.when(F.col("upto") <= F.col("over"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def place(parted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard, by a join with the bounded map, and its place there, gapless from 0.

    A place is the record's rank in its slot, behind the shard's earlier slots: no task sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    lookup = slot_map.select("version", "vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return parted.withColumn("rank", rank).join(F.broadcast(lookup), ["vslot", "part"]).withColumn("slot", F.col("base") + F.col("rank") - 1)


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot, part, version) for every row of docs(doc_id, text).

    Sizes of shards come out nearly equal (law `bytes`); a text larger than an even shard can't be halved. With a folder, its
    map is used, edited and stored as a new version where the table has changed. Null texts have no bytes, null ids share a slot,
    repeated rows are placed as often as they occur and in no order among each other, a very long text counts whole, an empty
    table gives no rows. No other column is read, so names can't clash.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(records(docs, slots), "records")
    parted = with_parts(rows, shards)
    return place(parted, current_map(slot_loads(parted), shards, folder)).select("doc_id", "size", "text_crc32", "shard", "slot", "vslot", "part", "version")


def folder_of(spark: SparkSession, name: str) -> str:
    """Where maps of that name are stored: in the cluster's shared folder."""
    return f"{base_dir(spark)}/slot-maps/{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "part", F.col("version").alias("map_version"))
