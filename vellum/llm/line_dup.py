"""Near-equal lines, by an exact set-similarity join, and their removal.

A line is the set of its words. Words are ordered by rarity over the whole corpus. Two sets whose Jaccard similarity reaches
the threshold differ in few words, and these part the words they have in common, in that order, into few runs: so they share
RUN consecutive words among the first of each (prefix filter; with RUN = 1 it would be a single word, which many lines
share by chance). Sizes must be similar (length filter), and enough words must lie before and behind the shared ones
(positional filter). Whatever passes is verified on the whole sets. All filters are lossless. A line goes if any earlier
line, by document, text and line number, is similar to it.

Lines with equal sets are one class, and only its first line goes on; classes are what is joined. Of the classes that share a
run of words, each is paired with the first PARTNERS alone, as one similar line is enough. Classes that stay after that, and
share a run with more than these, meet all of its classes in a second step, where pairs are decided on the spot and none is
emitted. The rows of the join are packed by the thousand into a few columns of bytes for each range of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, blob, in_chunks, joined, lean, mixed, run_hashes, settled, unblob, word_table

PERCENT, RUN, PARTNERS = 80, 2, 4
#: So many of the most frequent words are broadcast, with their order, 8 bytes each. All others come before them, by hash.
FREQUENT, SLOTS = 1 << 19, 1 << 22
#: Steps of the logarithm by which words are ordered, to a doubling of their count.
STEPS = 8
#: Rows that a task packs, or takes apart, at a time, and words that it counts; words of sets for each partition of the join, and
#: for each range of keys in it, which is what a task holds at a time; and ranges of words in a partition.
ROWS, COUNTED, PER_TASK, PER_RANGE, WORD_RANGES = 1 << 18, 1 << 19, 1 << 24, 1 << 19, 2
#: Lines of which a task remembers the first place, and rows in a frame that it hands on.
SEEN, FRAME = 100_000, 20_000
#: Rows of one run of words from which on they needn't be held together.
HOT = 64
#: Rows of one run up to which it is looked up whether further ones pass the filters.
HELD = 1024
KNOWN, CODE = np.uint64(1 << 47), np.uint64((1 << 48) - 1)
SALT = np.uint64(0xD6E8FEB86659FD93)
LINE_END = 10
#: Stands for a null id, which comes first.
NO_ID = -(1 << 63)


def lines_of(texts, fewest: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk of texts: document and line number of each line of so many words, bounds of its words, and their hashes."""
    for first, run in in_chunks(texts):
        raw, bounds = joined(run)
        starts, _, hashes = word_table(raw)
        if not len(hashes):
            continue
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == LINE_END)
        line = np.searchsorted(ends, starts)  # of the chunk
        cuts = np.concatenate(([0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(line)]))
        size = np.diff(cuts)
        kept = size >= fewest
        if not kept.any():
            continue
        number, hashes, size = line[cuts[:-1]][kept], hashes[np.repeat(kept, size)], size[kept]
        doc = np.searchsorted(bounds, ends[number], side="right") - 1
        before = np.searchsorted(ends, bounds[:-1])  # lines of earlier documents
        yield doc + first, number - before[doc], np.concatenate(([0], np.cumsum(size))), hashes


def summed(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and the sums of their counts."""
    x, n = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[first], np.add.reduceat(n, first)


def ranges_of(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The rows of each range of ascending 64-bit keys, of which there are so many; ranges without a row are left out."""
    at = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi > lo:
            yield int(at[lo]), slice(lo, hi)


def packed(rows) -> pa.RecordBatch:
    """(range, data) rows."""
    ranges, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(data, pa.binary())], ["range", "data"])


def counted(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, data): the words of a task's lines and how often they occur."""

    def handed(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return packed((k, blob(words[x], counts[x])) for k, x in ranges_of(words, ranges))

    raw, size, words, counts = [], 0, [], []

    def counted_now() -> None:
        nonlocal size
        x = np.sort(np.concatenate(raw))
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        words.append(x[first])
        counts.append(np.diff(first, append=len(x)))
        raw.clear()
        size = 0

    for batch in batches:
        for _, run in in_chunks(texts_of(batch)):
            raw.append(word_table(joined(run)[0])[2])
            size += len(raw[-1])
            if size > COUNTED:
                counted_now()
                if sum(map(len, words)) > COUNTED:
                    x, n = summed(words, counts)
                    words, counts = [x], [n]
                    if len(x) > COUNTED // 2:
                        yield handed(x, n)
                        words, counts = [], []
    if size:
        counted_now()
    if words:
        yield handed(*summed(words, counts))


def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(level, n, data): the words of each level, a logarithm of their count, that occur more than once. Rows come by range."""
    held: dict[str, list] = {"words": [], "counts": []}

    def done() -> Iterator[pd.DataFrame]:
        x, n = summed(held["words"], held["counts"])
        level = np.floor(STEPS * np.log2(n)).astype(np.int64)
        yield pd.DataFrame([(k, int((level == k).sum()), x[level == k].tobytes()) for k in np.unique(level[n > 1]).tolist()], columns=["level", "n", "data"])
        held.update(words=[], counts=[])

    at = None
    for batch in batches:
        for k, data in zip(batch["range"], batch["data"], strict=True):
            if held["words"] and k != at:
                yield from done()
            at = k
            x, n = unblob(data, np.uint64, np.int64)
            held["words"].append(x)
            held["counts"].append(n)
    if held["words"]:
        yield from done()


def frequent_words(texts: DataFrame, scratch: Scratch, most: int) -> np.ndarray:
    """Hashes of at most so many words, rarest first: those of all the highest levels that they hold whole."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = texts.mapInArrow(lambda it: lean(counted(it, parts * WORD_RANGES)), "range int, data binary")
    found = scratch.keep(words.repartitionById(parts, F.col("range") % parts).sortWithinPartitions("range").mapInPandas(levels, "level int, n long, data binary"), "words")
    chosen, total = [], 0
    for row in found.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        if total + row["n"] > most:
            break
        chosen.append(row["level"])
        total += row["n"]
    rows = found.filter(F.col("level") >= chosen[-1]).select("level", "data").collect() if chosen else []
    by_level = {k: np.sort(np.concatenate([np.frombuffer(r["data"], np.uint64) for r in rows if r["level"] == k])) for k in chosen}
    scratch.drop("words")
    return np.concatenate([np.zeros(0, np.uint64), *(by_level[k] for k in sorted(by_level))])


class Codes:
    """Words as 48-bit numbers, rarest first: 47 bits of the hash, or behind these the place among the frequent words."""

    def __init__(self, frequent: bytes):
        self.words = np.frombuffer(frequent, np.uint64) if frequent else np.zeros(1, np.uint64)
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[(self.words >> np.uint64(42)).astype(np.int64)] = np.arange(len(self.words))  # of equals the last, most frequent, stays

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots[(hashes >> np.uint64(42)).astype(np.int64)]
        return np.where(self.words[at] == hashes, KNOWN + at.astype(np.uint64), hashes >> np.uint64(17))


def sets_of(cuts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and distinct codes, in order, of each line."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(cuts) - 1, 1 << 16):  # 16 bits of line and 48 of code make one sort
        here = cuts[lo : lo + (1 << 16) + 1]
        line = np.repeat(np.arange(len(here) - 1, dtype=np.uint64), np.diff(here))
        x = np.sort((line << np.uint64(48)) | codes[here[0] : here[-1]])
        x = x[np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]]
        sizes.append(np.bincount((x >> np.uint64(48)).astype(np.int64), minlength=len(here) - 1))
        parts.append(x & CODE)
    return np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(parts)


def as_bytes(values: np.ndarray, cuts: np.ndarray, width: int) -> np.ndarray:
    """The ascending values from cut to cut as the low bytes of their differences, those of equal weight together."""
    size = np.diff(cuts)
    row = np.repeat(np.arange(len(size)), size)
    steps = np.diff(values, prepend=np.uint64(0))
    first = cuts[:-1][size > 0]
    steps[first] = values[first]
    at, out = (width - 1) * cuts[row] + np.arange(len(row)), np.empty(width * len(row), np.uint8)
    for k in range(width):
        out[at + k * size[row]] = (steps >> np.uint64(8 * k)) & np.uint64(255)
    return out


def from_bytes(raw: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Values of as_bytes(), so many for each size."""
    cuts, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    at, steps = (width - 1) * cuts[row] + np.arange(len(row)), np.zeros(len(row), np.uint64)
    for k in range(width):
        steps |= raw[at + k * size[row]].astype(np.uint64) << np.uint64(8 * k)
    total = np.cumsum(steps)
    return total - (total - steps)[cuts[row]] if len(row) else total


RARE, COMMON = 6, 3


def encoded(cuts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each set as bytes of its rare words, 6 a word, and of its frequent ones, 3 a word: sizes and bytes of both, set after set."""
    known = np.concatenate(([0], np.cumsum(codes >= KNOWN)))[cuts]
    return RARE * np.diff(cuts - known), as_bytes(codes[codes < KNOWN], cuts - known, RARE), COMMON * np.diff(known), as_bytes(codes[codes >= KNOWN] - KNOWN, known, COMMON)


def decoded(rare_size: np.ndarray, rare: np.ndarray, common_size: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and codes of the sets that encoded() made."""
    n, m = rare_size // RARE, common_size // COMMON
    x, y = from_bytes(rare, n, RARE), from_bytes(common, m, COMMON)
    cuts = np.concatenate(([0], np.cumsum(n + m)))
    out, first = np.empty(cuts[-1], np.uint64), np.repeat(np.arange(len(n)), n)
    is_rare = np.zeros(cuts[-1], bool)
    is_rare[np.arange(len(x)) - (np.cumsum(n) - n)[first] + cuts[first]] = True
    out[is_rare], out[~is_rare] = x, y + KNOWN
    return cuts, out


def of_objects(rare: pd.Series, common: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """decoded() for columns of bytes."""
    parts = [(np.array([len(x) for x in c], np.int64), np.frombuffer(b"".join(c), np.uint8)) for c in (rare, common)]
    return decoded(*parts[0], *parts[1])


def of_arrow(rare: pa.Array, common: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """decoded() for Arrow's columns, whose bytes aren't taken apart."""

    def part(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = c.cast(pa.binary()).buffers()
        ends = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        return np.diff(ends), np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(c) else np.zeros(0, np.uint8)

    return decoded(*part(rare), *part(common))


def binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


LINE = "repeat boolean, a long, b long, doc long, mark long, line int, n int, rare binary, common binary"


def scan(batches: Iterator[pa.RecordBatch], frequent: bytes, fewest: int) -> Iterator[pa.RecordBatch]:
    """LINE rows. Of the lines with one set (a, b: its hashes) that a task sees, those go on that come before all seen so far,
    with their words. So the first of all does, and a line of very many copies arrives few times. The others are repeats.
    """
    code_of, seen, waiting = Codes(frequent), {}, []
    names, types = zip(*(c.split() for c in LINE.split(", ")), strict=True)
    types = [{"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32()}.get(t) for t in types]

    def framed() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
        waiting.clear()
        plain = [pa.array(c, t) for c, t in zip(columns[:7], types[:7], strict=True)]
        return pa.RecordBatch.from_arrays([*plain, binary(*columns[7:9]), binary(*columns[9:11])], list(names))

    for batch in batches:
        ids, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
        for doc, number, cuts, hashes in lines_of(texts_of(batch), fewest):
            cuts, codes = sets_of(cuts, code_of(hashes))
            a, b = run_hashes(mixed(codes), cuts[:-1], cuts[1:]).view(np.int64), run_hashes(mixed(codes ^ SALT), cuts[:-1], cuts[1:]).view(np.int64)
            new, same = np.zeros((2, len(doc)), bool)
            if len(seen) > SEEN:
                seen.clear()
            for k, (x, y, *place) in enumerate(zip(a.tolist(), b.tolist(), ids[doc].tolist(), marks[doc].tolist(), number.tolist(), strict=True)):
                best = seen.get((x, y))
                if best is None or place < best:
                    seen[x, y] = place
                    new[k] = True
                same[k] = not new[k] and place == best  # of a repeated row
            a = np.where(new, a, mixed((ids[doc] + number).astype(np.uint64)).view(np.int64))  # a repeat belongs to no class any more
            rare_size, rare, common_size, common = encoded(*sets_of_lines(new, cuts, codes))
            sizes = np.zeros((2, len(doc)), np.int64)
            sizes[0][new], sizes[1][new] = rare_size, common_size
            kept = ~same
            waiting.append((~new[kept], a[kept], b[kept], ids[doc][kept], marks[doc][kept], number[kept], np.diff(cuts)[kept], sizes[0][kept], rare, sizes[1][kept], common))
            if sum(len(p[0]) for p in waiting) >= FRAME:
                yield framed()
        if waiting:
            yield framed()


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    """The column `text` as UTF-8, without a string in between."""
    return batch.column("text").cast(pa.binary()).to_pylist()


def sets_of_lines(keep: np.ndarray, cuts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and codes of the sets to keep."""
    size = np.diff(cuts)
    return np.concatenate(([0], np.cumsum(size[keep]))), codes[np.repeat(keep, size)]


def needed(n, m, percent: int):
    """The fewest common words of sets of n and m that reach the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_runs(n: int, percent: int, width: int = RUN) -> int:
    """How many of the runs of a set of n words, the rarest first, hold one that a similar set has, too.

    Of n words, o = needed(n, m) or more are common with a set of m. Its other words and those of the other set, k together,
    part the common ones into k + 1 runs at most. If no run before the first shared one holds `width` words, that one ends
    behind at most n - o words of its own and k * (width - 1) + width common ones.
    """
    return max((n - o + (n + m - 2 * o) * (width - 1) + 1 for m in range(-(-percent * n // 100), n * 100 // percent + 1) for o in (needed(n, m, percent),)), default=1)


def has_runs(percent: int, width: int = RUN) -> bool:
    """Whether unequal sets that reach the threshold always have a run of `width` words in common."""
    sizes = ((n, m) for n in range(1, 200) for m in range(n, n * 100 // percent + 1) if needed(n, m, percent) <= n and (n, needed(n, m, percent)) != (m, m))
    return all(needed(n, m, percent) >= (n + m - 2 * needed(n, m, percent)) * (width - 1) + width for n, m in sizes)


def runs_of(sizes: np.ndarray, percent: int, known: dict[int, int]) -> np.ndarray:
    """prefix_runs of each size, but 0 where only equal sets reach the threshold, and at most all runs."""
    distinct, at = np.unique(sizes, return_inverse=True)
    for n in distinct.tolist():
        if n not in known:
            alone = all(needed(n, m, percent) >= max(n, m) for m in range(-(-percent * n // 100), n * 100 // percent + 1))
            known[n] = 0 if alone else min(n - RUN + 1, prefix_runs(n, percent))
    return np.array([known[n] for n in distinct.tolist()], np.int64)[at]


#: A packed row: key of the run, class, its document and line, its size, the place of the run in it.
TYPES = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32)
NAMES = ("key", "uid", "doc", "line", "n", "at")


def packed_runs(batches: Iterator[pa.RecordBatch], percent: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, data): the runs of words of the prefix of each class, in ranges of their keys."""
    known: dict[int, int] = {}
    parts: list[tuple] = []

    def handed() -> pa.RecordBatch:
        x = [np.concatenate(c) for c in zip(*parts, strict=True)]
        parts.clear()
        order = np.argsort(x[0])
        x = [c[order].astype(t) for c, t in zip(x, TYPES, strict=True)]
        return packed((k, blob(*(c[rows] for c in x))) for k, rows in ranges_of(x[0], ranges))

    for batch in batches:
        cuts, codes = of_arrow(batch.column("rare"), batch.column("common"))
        n = np.diff(cuts)
        count = runs_of(n, percent, known)
        row = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = cuts[row] + at
        key = np.zeros(len(row), np.uint64)
        for k in range(RUN):
            key = mixed(key + codes[start + k])
        parts.append((key, *(batch.column(c).to_numpy()[row] for c in ("uid", "doc", "line")), n[row], at))
        if sum(len(p[0]) for p in parts) >= ROWS:
            yield handed()
    if sum(len(p[0]) for p in parts):
        yield handed()


MET = "part int, data binary, key long, uid long, further boolean"


def partnered(x: dict[str, np.ndarray], percent: int, partners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of shared keys, in the order of (key, doc, line, uid): pairs i, j of rows that pass the filters, with i one of the
    first `partners` of its key; which rows may have earlier partners than these; and which rows these and their partners are.
    """
    first = np.concatenate(([True], x["key"][1:] != x["key"][:-1]))
    start = np.flatnonzero(first)
    size = np.diff(np.concatenate((start, [len(first)])))
    place, start = np.arange(len(first)) - np.repeat(start, size), np.repeat(start, size)
    i, j = [], []
    for k in range(partners):
        later = np.flatnonzero(place > k)
        i.append(start[later] + k)
        j.append(later)
    i, j = np.concatenate(i), np.concatenate(j)
    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, m = x["n"][i], x["n"][j]
        before, behind = np.minimum(x["at"][i], x["at"][j]), np.minimum(n - x["at"][i], m - x["at"][j])
        return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (before + behind >= needed(n, m, percent))  # length and positional filter

    tie = np.concatenate((~first[1:] & (x["doc"][1:] == x["doc"][:-1]) & (x["line"][1:] == x["line"][:-1]), [False]))  # one id, several texts
    size, fit = np.repeat(size, size), fits(i, j)
    further = (size > partners + 1) & ((place > partners) | tie)
    # of keys of few rows it is known which others pass the filters, and only these and their partners go on
    rows, met_again = np.flatnonzero(further & (size <= HELD) & ~tie), (size > HELD) | tie
    width = place[rows] - partners
    total = np.cumsum(width)
    for part in np.split(np.arange(len(rows)), np.searchsorted(total, np.arange(1 << 17, total[-1], 1 << 17)) if len(rows) else []):
        b = np.repeat(rows[part], width[part])
        a = b - 1 - (np.arange(len(b)) - np.repeat(np.cumsum(width[part]) - width[part], width[part]))
        pass_ = fits(a, b)
        met_again[a[pass_]] = met_again[b[pass_]] = True
        hit = np.bincount(np.searchsorted(rows[part], b[pass_]), minlength=len(part)) > 0
        further[rows[part][~hit]] = False
    tied = np.unique(x["key"][tie & (size > partners + 1)])
    return i[fit], j[fit], further, (size > partners + 1) & (met_again | np.isin(x["key"], tied))


def met(batches: Iterator[pd.DataFrame], percent: int, parts: int, partners: int) -> Iterator[pd.DataFrame]:
    """MET rows from packed runs that come by range: packed pairs of classes (part: of the second one); and rows of keys of more
    classes than are paired: those that may have further partners before them, and these partners."""
    held: list[list[np.ndarray]] = []
    limit, at = 2 * ROWS, None
    names = [c.split()[0] for c in MET.split(", ")]

    def done(last: bool) -> Iterator[pd.DataFrame]:
        """Handles what is held. Unless it is the range's last, keys of few rows are held on, and of others the first."""
        nonlocal limit
        x = dict(zip((*NAMES, "hot"), (np.concatenate(c) for c in zip(*held, strict=True)), strict=True))
        held.clear()
        order = np.argsort(x["key"], kind="stable")
        key = x["key"][order]
        same = key[1:] == key[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if not last:
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            size = np.diff(np.concatenate((start, [len(key)])))
            hot = np.repeat(size > HOT, size)
            held.append([c[order[~hot]] for c in x.values()])
            shared = hot
        rows = order[shared]
        x = {c: v[rows] for c, v in x.items()}
        rows = np.lexsort((x["uid"], x["line"], x["doc"], x["key"]))
        x = {c: v[rows] for c, v in x.items()}
        if not len(rows):
            limit = max(limit, 2 * sum(len(h[0]) for h in held))
            return
        i, j, further, crowded = partnered(x, percent, partners)
        if not last:
            first = np.concatenate(([True], x["key"][1:] != x["key"][:-1]))
            place = np.arange(len(first)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            held.append([c[place < partners] for c in x.values()])
            held[-1][-1] = np.ones(len(held[-1][0]), bool)
            further, crowded = np.ones((2, len(rows)), bool)
            limit = max(limit, 2 * sum(len(h[0]) for h in held))
        elif x["hot"].any():  # other rows of these keys were handled before
            hot = np.isin(x["key"], x["key"][x["hot"]])
            further, crowded = further | hot, crowded | hot
        a, b = x["uid"][i], x["uid"][j]
        keep = a != b
        a, b = a[keep], b[keep]
        if len(a):
            to = (mixed(b.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((b, a, to))
            a, b, to = a[order], b[order], to[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, to = a[new], b[new], to[new]
            cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])).tolist()
            yield pd.DataFrame({"part": to[cuts[:-1]], "data": [blob(a[p:q], b[p:q]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]}).reindex(columns=names)
        if crowded.any():
            row = {"key": x["key"].view(np.int64), "uid": x["uid"], "further": further}
            yield pd.DataFrame({c: v[crowded] for c, v in row.items()}).reindex(columns=names)

    for batch in batches:
        for k, data in zip(batch["range"], batch["data"], strict=True):
            if held and k != at:
                yield from done(True)
                limit = 2 * ROWS
            at = k
            x = unblob(data, *TYPES)
            held.append([*x, np.zeros(len(x[0]), bool)])
            if sum(len(h[0]) for h in held) > limit:
                yield from done(False)
    if held:
        yield from done(True)


def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct pairs (x, y) of packed ones; a pair may come again if a task has very many."""
    held: list[list[np.ndarray]] = []

    def done() -> pd.DataFrame:
        a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return pd.DataFrame({"x": a[new], "y": b[new]})

    for batch in batches:
        for data in batch["data"]:
            held.append(unblob(data, np.int64, np.int64))
            if sum(len(h[0]) for h in held) > ROWS:
                yield done()
    if held:
        yield done()


def similar(percent: int):
    """Whether two sets are, as a function of columns of encoded ones."""

    def test(rare: pa.Array, common: pa.Array, rare2: pa.Array, common2: pa.Array) -> pa.Array:
        (cuts, codes), (cuts2, codes2) = of_arrow(rare, common), of_arrow(rare2, common2)
        n, m = np.diff(cuts), np.diff(cuts2)
        equal = np.zeros(len(n), np.int64)
        for lo in range(0, len(n), 1 << 16):  # 16 bits of pair and 48 of code make one sort
            hi = min(lo + (1 << 16), len(n))
            pair = np.concatenate((np.repeat(np.arange(hi - lo), n[lo:hi]), np.repeat(np.arange(hi - lo), m[lo:hi]))).astype(np.uint64)
            x = np.sort((pair << np.uint64(48)) | np.concatenate((codes[cuts[lo] : cuts[hi]], codes2[cuts2[lo] : cuts2[hi]])))
            twice = x[1:][x[1:] == x[:-1]]
            equal[lo:hi] = np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=hi - lo)
        return pa.array(100 * equal >= percent * (n + m - equal))

    return F.arrow_udf(test, "boolean")


def gathered(batches: Iterator[pd.DataFrame], least: int = 8192) -> Iterator[pd.DataFrame]:
    """Batches put together to so many rows, of which a window is cheap to compare."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= least:
            yield pd.concat(waiting, ignore_index=True)
            waiting = []
    if sum(map(len, waiting)):
        yield pd.concat(waiting, ignore_index=True)


def settle(batches: Iterator[pd.DataFrame], percent: int, lanes: int = 4, most: int = 1 << 17) -> Iterator[pd.DataFrame]:
    """(uid) of the asked among rows (key, n, uid, asked, doc, mark, line, rare, common), sorted by (key, n), to which an earlier
    row of their key is similar.

    A row is compared with those of its key that pass the length filter, of which alone a window is held. Parity bitmaps, whose
    bits differ in at most as many places as sets have words of their own, drop most pairs before the sets are compared; a row
    that is decided isn't compared any more.
    """
    held: dict[str, np.ndarray] = {}
    for batch in gathered(batches):
        cuts, codes = of_objects(batch["rare"], batch["common"])
        bit = mixed(codes)
        one, lane = np.uint64(1) << (bit & np.uint64(63)), (bit >> np.uint64(6)) & np.uint64(lanes - 1)
        sets = np.empty(len(batch), object)
        sets[:] = np.split(codes, cuts[1:-1])
        new = {c: batch[c].to_numpy() for c in ("key", "n", "uid", "doc", "mark", "line")} | {"asked": batch["asked"].to_numpy(bool), "sets": sets}
        new["bits"] = np.stack([np.bitwise_xor.reduceat(np.where(lane == k, one, np.uint64(0)), cuts[:-1]) for k in range(lanes)], axis=1)
        lo = len(held.get("n", ()))
        x = {c: np.concatenate((held[c], v)) if held else v for c, v in new.items()}
        group = np.cumsum(np.concatenate(([0], x["key"][1:] != x["key"][:-1]))) * (int(x["n"].max()) + 1)
        least = np.searchsorted(group + x["n"], group + -(-percent * x["n"] // 100))  # length filter: the first row that is long enough
        rows = np.arange(lo, len(group))
        width = rows - least[rows]
        total = np.cumsum(width)
        done = np.zeros(len(group), bool)
        for part in np.split(np.arange(len(rows)), np.searchsorted(total, np.arange(most, total[-1], most))):
            w = width[part]
            j = np.repeat(rows[part], w)
            i = j - 1 - (np.arange(len(j)) - np.repeat(np.cumsum(w) - w, w))
            open_ = x["asked"] & ~done
            fit = open_[i] | open_[j]
            i, j = i[fit], j[fit]
            before = (x["doc"][i] < x["doc"][j]) | (x["doc"][i] == x["doc"][j]) & ((x["mark"][i] < x["mark"][j]) | (x["mark"][i] == x["mark"][j]) & (x["line"][i] < x["line"][j]))
            late, early = np.where(before, j, i), np.where(before, i, j)
            fit = open_[late] & (x["uid"][late] != x["uid"][early])
            late, early = late[fit], early[fit]
            need = needed(x["n"][late], x["n"][early], percent)
            near = np.bitwise_count(x["bits"][late] ^ x["bits"][early]).sum(axis=1, dtype=np.int64) <= x["n"][late] + x["n"][early] - 2 * need
            for a, b, common in zip(late[near].tolist(), early[near].tolist(), need[near].tolist(), strict=True):
                if not done[a] and len(np.intersect1d(x["sets"][a], x["sets"][b], assume_unique=True)) >= common:
                    done[a] = True
        if done.any():
            yield pd.DataFrame({"uid": x["uid"][done]})
        keep = (x["key"] == x["key"][-1]) & (100 * x["n"] >= percent * x["n"][-1])
        x["asked"] &= ~done
        held = {c: v[keep] for c, v in x.items()}


def later_lines(docs: DataFrame, percent: int = PERCENT, fewest: int = 1) -> DataFrame:
    """(doc, mark, line) of every line of docs(doc_id, text) that is similar to an earlier one.

    doc is the id, or NO_ID for a null one, and mark the text's hash. Lines are numbered from 0 and ordered by
    (doc, mark, line), so that there are no ties. Only lines of `fewest` words are compared. Rows with one id and one text are
    one document. Null and empty texts have no lines, very long texts are taken in pieces and long lines whole, an empty table
    gives no rows, and other columns aren't read. percent must be one at which unequal similar sets always share a run: 75 is.
    """
    if not has_runs(percent):
        raise ValueError(f"at {percent} % some similar lines share no run of {RUN} words")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = marked(docs.select("doc_id", "text").filter("text is not null")).drop("doc_id")
    sent = spark.sparkContext.broadcast(frequent_words(texts, scratch, FREQUENT).tobytes())
    lines = texts.mapInArrow(lambda it: lean(scan(it, sent.value, fewest)), LINE)
    placed = Window.partitionBy("a", "b").orderBy("doc", "mark", "line")
    ranked = lines.withColumn("later", F.col("repeat") | (F.rank().over(placed) > 1)).withColumn("nth", F.row_number().over(placed))
    known = ranked.filter("later or nth = 1").select("later", "doc", "mark", "line", "n", *[F.when(~F.col("later"), F.col(c)).alias(c) for c in ("rare", "common")])
    known = scratch.keep(known.withColumn("uid", F.monotonically_increasing_id()), "lines", distinct=True)
    classes, repeats = known.filter("not later").drop("later"), known.filter("later").select("doc", "mark", "line")

    size = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_TASK))
    partners, ranges = PARTNERS, parts * max(1, -(-size // parts // PER_RANGE))
    runs = classes.mapInArrow(lambda it: lean(packed_runs(it, percent, ranges)), "range int, data binary")
    found = runs.repartitionById(parts, F.col("range") % parts).sortWithinPartitions("range").mapInPandas(lambda it: lean(met(it, percent, parts, partners)), MET)
    found = scratch.keep(found, "met")
    pairs = found.filter("part is not null").select("part", "data").repartitionById(parts, F.col("part")).mapInPandas(pairs_of, "x long, y long")
    pairs = scratch.keep(pairs, "pairs")
    crowd = found.filter("key is not null").drop("part", "data")
    # few classes are in any pair, so that their sets are picked out once
    compared = pairs.select(F.col("x").alias("uid")).union(pairs.select("y")).union(crowd.select("uid")).distinct()
    sets = scratch.keep(classes.join(compared.hint("shuffle_hash"), "uid", "left_semi"), "sets", distinct=True)
    # a partition's share of the sets is looked up, as it is small beside the classes; sorting it and the pairs costs more
    side = lambda k: sets.select(*[F.col(c).alias(f"{c}_{k}") for c in ("doc", "mark", "line", "rare", "common")], F.col("uid").alias(k)).hint("shuffle_hash")
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(similar(percent)("rare_x", "common_x", "rare_y", "common_y"))
    before = F.struct("doc_x", "mark_x", "line_x") < F.struct("doc_y", "mark_y", "line_y")
    gone = settled(both.select(F.when(before, F.col("y")).otherwise(F.col("x")).alias("uid")).distinct())

    # classes that stay, and may have further partners, meet all of these
    left = settled(crowd.filter("further").join(gone, "uid", "left_anti").select("key", "uid").distinct())
    if not left.isEmpty():
        asked = left.select("uid").distinct().withColumn("asked", F.lit(True))
        rows = crowd.select("key", "uid").join(left.select("key").distinct(), "key", "left_semi")
        rows = rows.join(sets.join(asked.hint("shuffle_hash"), "uid", "left").fillna(False, ["asked"]).hint("shuffle_hash"), "uid")
        near = rows.repartition("key").sortWithinPartitions("key", "n")
        gone = settled(gone.union(near.mapInPandas(lambda it: lean(settle(it, percent)), "uid long").distinct()))
    out = settled(classes.join(gone.distinct(), "uid", "left_semi").select("doc", "mark", "line").union(repeats).distinct())
    scratch.drop()
    return out


def marked(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "mark": F.xxhash64("text")})


def gone_by_document(later: DataFrame) -> DataFrame:
    return later.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def removed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text, removed): for every row of docs(doc_id, text), what stays of the text, and the numbers of the lines that go."""
    return without_lines(docs.select("doc_id", "text"), later_lines(docs, percent), "removed")


def without_lines(docs: DataFrame, later: DataFrame, removed: str = "") -> DataFrame:
    """docs without those lines; n_chars, if there, is counted anew. Documents that lose no line come out as they are.

    A document whose every line goes stays, with an empty text; a null text stays null. docs may have further columns of any
    name. With a name for them, the numbers of the lines that go are another column.
    """
    gone = gone_by_document(later).select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("gone").alias("__gone"))
    gone = gone.hint("shuffle_hash")  # texts needn't be sorted
    cut = docs.join(gone, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__mark")), "left")
    # between two lines that go, and before the first and behind the last, a slice of lines stays
    kept = F.flatten(F.transform(F.arrays_zip(F.concat(F.array(F.lit(-1)), "__gone").alias("p"), F.concat("__gone", F.array(F.size("__lines"))).alias("q")), lambda x: F.slice("__lines", x["p"] + 2, x["q"] - x["p"] - 1)))
    rest = F.array_join(kept, "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest)
    new = {"text": text} | ({"n_chars": F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(rest)).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    cut = cut.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1)))
    numbers = [F.coalesce("__gone", F.array().cast("array<int>")).alias(removed)] if removed else []
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns], *numbers)


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without lines that are similar to an earlier one; see later_lines and without_lines for the unusual cases."""
    return without_lines(docs, later_lines(docs, percent))
