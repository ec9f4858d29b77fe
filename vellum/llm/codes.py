"""Product codes of vectors, with codebooks that Yinyang Lloyd fits.

A vector's components become whole numbers and are cut into equal parts; each part is coded by the nearest entry of its
position's codebook. The entries of a codebook are clustered into groups. A part keeps, between rounds, its entry and one
lower bound of the distance to the other entries of each group. When entries have moved, a bound less the group's largest
drift is still one, and only groups whose bound fails against the exact distance to the part's own entry are scanned. Scans
work in floating point; entries that come within its error of the best are told apart by whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, lean, settled

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a codebook a group, on average, and rounds that group them.
PER_GROUP, GROUP_ROUNDS = 10, 5
#: Labels whose sums are sent to every executor; more are joined by a shuffle.
SENT_LABELS = 100_000

#: By which rounding may carry a bound above the true distance, relatively.
SLACK = 1e-6


def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label and the whole components x of rows whose vector has only finite ones, none too large for its squared
    distances to fit a long."""
    for batch in batches:
        column = batch.column("embedding")
        length = column.value_lengths().fill_null(0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(length)))
        values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
        most = np.floor((1 << 30) / np.sqrt(np.maximum(length, 1)))
        with np.errstate(invalid="ignore"):
            bad = np.concatenate(([0], np.cumsum(~(np.abs(values) <= np.repeat(most, length)))))
        fits = (bad[ends[1:]] == bad[ends[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
        x = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(length[fits]))).astype(np.int32), pa.array(values[np.repeat(fits, length)].astype(np.int64)))
        mask = pa.array(fits)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(mask), batch.column("label").filter(mask), x], ["vec_id", "label", "x"])


def grouped(book: np.ndarray) -> np.ndarray:
    """Groups of the entries of one codebook: a few rounds of plain Lloyd from evenly spaced entries, ties to the first."""
    k = max(1, -(-len(book) // PER_GROUP))
    points = book.astype(float)
    centres = points[np.arange(k) * len(book) // k]
    for _ in range(GROUP_ROUNDS):
        group = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([points[group == g].mean(0) if (group == g).any() else centres[g] for g in range(k)])
    return group


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the rows of book that stand at the same place."""
    return ((x - book) ** 2).sum(-1)


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of x, their distances to all entries, the nearest entry (the first of equals) and its exact squared distance."""
    xf, bf = x.astype(float), book.astype(float)
    xx, bb = (xf**2).sum(1), (bf**2).sum(1)
    d = xx[:, None] + bb - 2 * (xf @ bf.T)
    error = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (xx[:, None] + bb)
    near = d - error <= (d + error).min(1, keepdims=True)
    best = near.argmax(1)
    exact = squared(x, book[best])
    unsure = np.flatnonzero(near.sum(1) > 1)
    if len(unsure):
        row, entry = np.nonzero(near[unsure])
        true = squared(x[unsure[row]], book[entry])
        first = np.lexsort((entry, true, row))
        first = first[np.concatenate(([True], np.diff(row[first]) > 0))]
        best[unsure], exact[unsure] = entry[first], true[first]
    low = np.sqrt(np.maximum(d - error, 0))
    return low, best, exact


def lowered(bound: np.ndarray) -> np.ndarray:
    """Bounds as half floats that aren't above them; what exceeds their range becomes their largest value."""
    half = np.minimum(bound, 60000.0).astype(np.float16)
    above = half.astype(float) > bound
    half[above] = np.nextafter(half[above], np.float16(-1))
    return np.maximum(half, np.float16(0))


def bounds(low: np.ndarray, best: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Lower bounds of each row to each group without the row's own entry."""
    low = low.copy()
    low[np.arange(len(low)), best] = np.inf
    return np.stack([low[:, group == g].min(1, initial=np.inf) for g in range(n_groups)], 1)


def first_pass(x: np.ndarray, book: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, exact squared distance and bounds of rows that have none yet."""
    low, best, exact = scanned(x, book)
    return best, exact, bounds(low, best, group, int(group.max()) + 1)


def next_pass(x: np.ndarray, own: np.ndarray, low: np.ndarray, old: np.ndarray, book: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved from old to book; also how many groups of rows were scanned.

    own is the row's entry and low its bounds. A group is passed over only where its bound is strictly above the distance to
    the row's entry, so that a tie with an entry of lower index is seen.
    """
    drift = np.sqrt(squared(book, old).astype(float)) * (1 + SLACK)
    n_groups = int(group.max()) + 1
    low = np.maximum(low - np.array([drift[group == g].max(initial=0) for g in range(n_groups)]), 0)
    exact = squared(x, book[own])
    fails = low * (1 - SLACK) <= np.sqrt(exact.astype(float))[:, None]
    best, least, work = own.copy(), exact.copy(), 0
    new_low = low.copy()
    for g in range(n_groups):
        rows, members = np.flatnonzero(fails[:, g]), np.flatnonzero(group == g)
        if not len(rows) or not len(members):
            continue
        work += len(rows)
        near, entry, value = scanned(x[rows], book[members])
        entry = members[entry]
        better = (value < least[rows]) | ((value == least[rows]) & (entry < best[rows]))
        # bounds leave out the row's former entry, which is added at the end where the row has another one now
        near[members == own[rows][:, None]] = np.inf
        second = near.copy()
        second[members == entry[:, None]] = np.inf
        new_low[rows, g] = np.where(better, second.min(1), near.min(1))
        changed = rows[better]
        # an entry that was the best until now is among those that its group's bound covers
        before, distance = best[changed], np.sqrt(least[changed].astype(float)) * (1 - SLACK)
        new_low[changed, group[before]] = np.minimum(new_low[changed, group[before]], distance)
        best[changed], least[changed] = entry[better], value[better]
    left = np.flatnonzero(best != own)
    new_low[left, group[own[left]]] = np.minimum(new_low[left, group[own[left]]], np.sqrt(exact[left].astype(float)) * (1 - SLACK))
    return best, least, new_low, work


class Coder:
    """Assigns blocks of rows: to `books` alone, or after a move from `old`, by the groups of entries."""

    def __init__(self, books: np.ndarray, groups: list[np.ndarray], old: np.ndarray | None = None):
        self.books, self.groups, self.old = books, groups, old
        self.counts = [int(g.max()) + 1 for g in groups]
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def assign(self, x: np.ndarray, codes: np.ndarray | None = None, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes, errors and bounds of rows of x (rows * parts * width), and the number of groups scanned after the first pass."""
        out, error, work = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x), np.int64), 0
        bound = np.zeros((len(x), self.starts[-1]), np.float16)
        for p, book in enumerate(self.books):
            at = slice(self.starts[p], self.starts[p + 1])
            if self.old is None:
                best, exact, below = first_pass(x[:, p], book, self.groups[p])
            else:
                best, exact, below, n = next_pass(x[:, p], codes[:, p].astype(np.int64), low[:, at].astype(float), self.old[p], book, self.groups[p])
                work += n
            out[:, p], bound[:, at] = best, lowered(below)
            error += exact
        return out, error, bound, work


def numbers(column: pa.Array, parts: int) -> np.ndarray:
    """Lists of equal length as rows * parts * width; zeros fill the last part."""
    flat = column.flatten().to_numpy()
    rows = flat.reshape(len(column), len(flat) // max(len(column), 1))
    width = -(-rows.shape[1] // parts)
    out = np.zeros((len(rows), parts * width), np.int64)
    out[:, : rows.shape[1]] = rows
    return out.reshape(len(rows), parts, width)


def cells(data: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in data], pa.binary())


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """The rows of cells()."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def assigned(batches: Iterator[pa.RecordBatch], coder: Coder, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with codes and bounds for the next round or, in the last one, with codes and errors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, first = numbers(batch.column("x"), len(coder.books)), coder.old is None
        codes, error, low, _ = coder.assign(x, *(() if first else (matrix(batch.column("codes"), np.uint8), matrix(batch.column("low"), np.float16))))
        known = {"vec_id": batch.column("vec_id"), "label": batch.column("label")}
        more = {"codes": cells(codes), "error": pa.array(error)} if last else {"x": batch.column("x"), "codes": cells(codes), "low": cells(low)}
        yield pa.RecordBatch.from_pydict(known | more)


def summed(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Number and sum of the parts of each entry, over all rows of a task."""
    parts, entries, width = shape
    n, total = np.zeros(parts * entries, np.int64), np.zeros(parts * entries * width, np.int64)
    for batch in batches:
        x, codes = numbers(batch.column("x"), parts), matrix(batch.column("codes"), np.uint8).astype(np.int64)
        at = codes + entries * np.arange(parts)
        np.add.at(n, at.ravel(), 1)
        np.add.at(total, (at[..., None] * width + np.arange(width)).ravel(), x.ravel())
    used = np.flatnonzero(n)
    sums = pa.array(total.reshape(parts * entries, width)[used].tolist(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_pydict({"entry": pa.array(used), "n": pa.array(n[used]), "total": sums})


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of its parts' mean; unused ones stay. The driver gets one row an entry."""
    parts = state.select("x", "codes").mapInArrow(lambda it: summed(it, books.shape), "entry long, n long, total array<long>")
    mean = [F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(books.shape[2])]
    out = books.reshape(-1, books.shape[2]).copy()
    for r in parts.groupBy("entry").agg(F.sum("n").alias("n"), *mean).collect():
        out[r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(books.shape[2])]
    return out.reshape(books.shape)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) for vectors(vec_id, embedding, label), and the codebooks: parts * entries * width.

    Rows go whose vector is null, has a null or non-finite component, has another length than that of the smallest vec_id, or
    has a component beyond 2^30 / sqrt(length) / 256, whose squared distances wouldn't fit a long. If the parts aren't equal,
    zeros fill the last one. With fewer rows than entries, codebooks are smaller; without rows they are empty. Null ids come
    last among the first entries, rows of equal ids by their components. Repeated rows get equal codes, each with a row of its
    own. Other columns aren't read.
    """
    scratch = Scratch(vectors.sparkSession)
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    known = vectors.select("vec_id", "label", "embedding").mapInArrow(wholes, kinds + ", x array<long>")
    order = [F.asc_nulls_last("vec_id"), F.asc("x")]
    chosen = [r["x"] for r in known.orderBy(*order).limit(entries).collect()]
    size = len(chosen[0]) if chosen else 0
    known = known.filter(F.size("x") == size)
    if any(len(x) != size for x in chosen):
        chosen = [r["x"] for r in known.orderBy(*order).limit(entries).collect()]
    books = numbers(pa.array(chosen, pa.list_(pa.int64())), parts).transpose(1, 0, 2)
    if not chosen:
        return known.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), books
    groups = [grouped(b) for b in books]
    state, old = known, None
    for k in range(rounds + 1):
        coder, last = Coder(books, groups, old), k == rounds
        made = state.mapInArrow(lambda it, c=coder, e=last: lean(assigned(it, c, e)), kinds + ", " + ("codes binary, error long" if last else "x array<long>, codes binary, low binary"))
        state = scratch.keep(made, f"round{k}")
        if k:
            scratch.drop(f"round{k - 1}")
        if not last:
            old, books = books, moved(state, books)
    return state, books


def digest(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes in hex, errors summed by label, and a checksum of the codebooks."""
    sums = settled(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    sums = F.broadcast(sums) if sums.count() <= SENT_LABELS else sums
    checksum = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(checksum).alias("codebooks_sha256"))
