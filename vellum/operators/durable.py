"""Results that are used more than once, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where none is set and Spark runs on this machine alone."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellum-"))
    return context.getCheckpointDir().get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by a hash of the keys, doc_id unless given, as what a union needs before rows of a key are gathered.

    Spark 4.1 takes a union of parts that are each dealt out by a key for one that is, too, and gathers without a shuffle; but
    adaptive execution may have joined the partitions of each part otherwise, so that rows of a key lie in several. It can't
    know that of another hash.
    """
    return df.repartition(F.xxhash64(*(keys or ("doc_id",))))


def dealt_for_work(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by the keys into spark.sql.shuffle.partitions parts, for work that weighs more than its bytes.

    Adaptive execution joins parts by their bytes; a document's file takes milliseconds for some hundred of these, and a few
    tasks would do all the work. As the shuffle is asked for by number, it is done whatever a union claims (see dealt_anew), and
    rows of a key are gathered without another.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or ("doc_id",)))


def durable(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder of spark.checkpoint.dir, which a lost executor doesn't take along."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
