"""Cost-balanced packing of documents into token sequences.

The cost of a piece of n tokens is estimated as linear * n + quadratic * n * n, as attention grows with the square of
a segment and all else with its length. Whole runs of `capacity` tokens make sequences of their own. The rests are
gathered in groups of bounded size; in a group, pieces go in descending order to the sequence of lowest cost that can
still hold them. What fits nowhere whole is cut to fill the room that is left, so that a group pads fewer than
`capacity` tokens in all. Groups are formed where the documents are read, so that nothing is shuffled, unless there are
fewer partitions than cores.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import lean, small_batches

#: Documents that are packed together at most. A group holds one rest of less than `capacity` tokens of each.
GROUP_DOCS = 4096
#: Bytes of text that a task gets at least, where there are so many: then the padding of its last group is under half a percent.
TASK_BYTES = 2 << 20
END_ID = 1
SPECIAL = "<|endoftext|>"
PIECE = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids as the tokenizers library gives them for byte_bpe_50k.json with add_special_tokens=False.

    The same vocabulary as ranks is read by tiktoken, which gives equal ids several times faster. Texts that hold the
    special token's string, which tokenizers turns into its one id, go to tokenizers itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.json_path, self.slow = json_path, None
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


def vocabulary() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def balanced(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for pieces shorter than capacity, in the order of each sequence."""
    total = sum(lengths)
    n = -(-total // capacity)
    room, cost = np.full(n, capacity), np.zeros(n)
    out, left = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        at = int(np.where(room >= size, cost, np.inf).argmin())
        if room[at] < size:
            left.append(i)
            continue
        out.append((i, 0, size, at))
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    open_ = [int(k) for k in np.lexsort((cost, -room)) if room[k]]
    for i in left:  # cut: the widest rooms first, so that few pieces arise
        start = 0
        while start < lengths[i]:
            at = open_[0]
            take = int(min(room[at], lengths[i] - start))
            out.append((i, start, take, at))
            room[at] -= take
            start += take
            if not room[at]:
                open_.pop(0)
    return out


def packed(batches: Iterator[pd.DataFrame], paths: tuple[str, str, str], capacity: int, linear: float, quadratic: float, group_docs: int) -> Iterator[pd.DataFrame]:
    """PIECE rows of a task's documents. Sequences are numbered within the task, and by the task."""
    encode, names = Encoder(*paths), [x.split()[0] for x in PIECE.split(", ")]
    number = itertools.count(TaskContext.get().partitionId() << 32)
    rests: list[tuple] = []

    def group() -> Iterator[tuple]:
        ids_of = {}
        used: dict[int, int] = {}
        for i, at, size, k in balanced([len(r[2]) for r in rests], capacity, linear, quadratic):
            doc_id, start, ids, total = rests[i]
            if k not in ids_of:
                ids_of[k] = next(number)
            yield doc_id, start + at, size, ids[at : at + size].tobytes(), total, ids_of[k], used.get(k, 0)
            used[k] = used.get(k, 0) + size
        rests.clear()

    rows: list[tuple] = []
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = np.array([*encode(text or ""), END_ID], "<u2")
            whole = len(ids) // capacity * capacity
            rows += [(doc_id, s, capacity, ids[s : s + capacity].tobytes(), len(ids), next(number), 0) for s in range(0, whole, capacity)]
            if whole < len(ids):
                rests.append((doc_id, whole, ids[whole:], len(ids)))
            if len(rests) >= group_docs:
                rows += group()
            if len(rows) >= 5000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    rows += group()
    if rows:
        yield pd.DataFrame(rows, columns=names)


def dealt(docs: DataFrame) -> DataFrame:
    """docs in as many tasks as their bytes allow: partitions are joined without a shuffle, or dealt out anew if cores would idle."""
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    most, there, cores = max(1, size // TASK_BYTES), docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    if there < min(most, cores):
        return docs.repartition(min(most, cores))
    return docs.coalesce(min(most, there))


def pack(docs: DataFrame, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 6144, group_docs: int = GROUP_DOCS, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of docs(doc_id, text).

    A null text is empty and so is a document of the end id alone; repeated rows are packed as often as they occur; a
    null doc_id stays null; an empty table gives no pieces. Only doc_id and text are read, so other columns can't clash.
    ids holds the token ids as little-endian unsigned 16-bit values. A very long text is encoded whole and cut into runs. Of
    pieces of equal size the one read first goes first, and of sequences of equal cost the first takes it. A group has at most
    group_docs documents of one task, whichever source they are of.
    """
    small_batches(docs.sparkSession)
    paths = paths or vocabulary()
    texts = dealt(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    # ids pass through pandas as strings, where a null would turn whole numbers into floating ones
    pieces = texts.mapInPandas(lambda it: lean(packed(it, paths, capacity, linear, quadratic, group_docs)), PIECE)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def crc(ids: pd.Series) -> pd.Series:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit values."""
    return ids.map(lambda b: zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes())).astype("int64")


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of ids."""
    crc_of = F.pandas_udf(crc, "long")
    return pieces.select("doc_id", "start", "length", crc_of("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
