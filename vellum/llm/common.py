"""What the operators of this subpackage share: word splitting, hashing, and tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are hashed at a time; a longer text is taken in pieces cut between words.
CHUNK = 1 << 16
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64, for at least n exponents."""
    size = max(CHUNK, 1 << max(n - 1, 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (_BASE, _BASE_INVERSE))
    return _powers[size]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], by differences of one running polynomial."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_table(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of raw: runs of bytes other than space and \\x09-\\x0D."""
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw):  # cut between words; one word longer than a chunk is taken whole
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < at and end < len(raw):
                end = min(len(raw), end + CHUNK)
                cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut >= at else len(raw)
        data = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        parts.append((starts + at, ends + at, run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def in_chunks(texts: Iterable[str | bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, UTF-8 bytes of each) for runs of texts of about limit bytes; null is empty."""
    first, run, size = 0, [], 0
    for text in texts:
        raw = b"" if not text else text if isinstance(text, bytes) else text.encode("utf-8", "replace")
        if run and size + len(raw) > limit:
            yield first, run
            first, run, size = first + len(run), [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def joined(run: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a line end after each, and where each starts (and the end)."""
    bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in run])))
    return b"\n".join(run) + b"\n", bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over the whole word (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of all runs of width words, A-Z in lower case.

    A text of fewer words has one, of its whole sequence; one without words has none.
    """
    for _, run in in_chunks(texts):
        raw, bounds = joined(run)
        starts, _, hashes = word_table(raw.lower())
        cuts = np.searchsorted(starts, bounds)
        first = np.arange(len(hashes))
        windows = run_hashes(hashes, first, np.minimum(first + width, len(hashes)))
        for lo, hi in itertools.pairwise(cuts):
            if hi - lo >= width:
                yield np.unique(windows[lo : hi - width + 1])
            else:
                yield run_hashes(hashes, np.array([lo]), np.array([hi])) if hi > lo else hashes[:0]


def base_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of this machine only where Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="vellum-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Rows of texts that a Python worker takes at a time. Spark's default of 10000 costs it hundreds of MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Makes this session hand at most BATCH_ROWS rows at a time to Python workers; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: its result is in the shared folder, and nothing reads them again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


class Scratch:
    """Intermediate tables in the shared folder. They outlive lost executors, and drop() removes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{base_dir(spark)}/vellum-{uuid.uuid4().hex}"
        small_batches(spark)
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, distinct: bool = False) -> DataFrame:
        """Writes df and returns a DataFrame that reads it, without df's lineage. If hardly a value comes twice, no dictionaries are tried."""
        path = f"{self.root}/{name}"
        with shuffles_freed(self.spark):
            df.write.option("parquet.enable.dictionary", str(not distinct).lower()).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # at exit the JVM may be gone; the folder is the cluster's scratch space
            return


def settled(df: DataFrame) -> DataFrame:
    """df without its lineage: a reliable checkpoint, for results that are small beside the input."""
    base_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.checkpoint(eager=True)


def give_back() -> None:
    """Returns memory that was freed to the system. Python workers are used again and would keep it beside the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere the allocator does so itself
        ctypes.CDLL(None).malloc_trim(0)


def lean(batches: Iterable) -> Iterator:
    """Hands on what a task makes, and at its end gives back its memory."""
    try:
        yield from batches
    finally:
        give_back()


def planes(values: np.ndarray) -> bytes:
    """The bytes of whole numbers, those of equal weight together, so that leading zeros compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: memoryview, dtype: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, n).T).view(dtype)[:, 0]


def blob(sorted_: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of equal length as bytes; the first is in ascending order and written as differences."""
    return b"".join([planes(np.diff(sorted_, prepend=sorted_.dtype.type(0))), *map(planes, others)])


def unblob(data: bytes, *dtypes: type) -> list[np.ndarray]:
    """The columns of blob()."""
    sizes = [np.dtype(d).itemsize for d in dtypes]
    n, at, out, view = len(data) // sum(sizes), 0, [], memoryview(data)
    for dtype, size in zip(dtypes, sizes, strict=True):
        out.append(from_planes(view[at : at + n * size], dtype, n))
        at += n * size
    return [np.cumsum(out[0], dtype=dtypes[0]), *out[1:]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
