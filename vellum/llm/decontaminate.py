"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words that ignores some positions, so that a hit outlives a word that was
replaced there. Hashes of the test items under every mask are joined with those of all windows of the documents, and
around each hit document and item are laid side by side: the overlap is the best-scoring stretch, replaced words
included, and counts if it is long and equal enough. Where it isn't, that stretch does which has the most equal words of
those that are equal enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import in_chunks, joined, lean, mixed, run_hashes, settled, small_batches, word_table

#: Fixed masks; each looks at six words.
MASKS = ("111111", "11101011", "110100111", "1100101011", "11010001011")
#: An overlap counts from so many equal words on (or this share of a shorter item's), with this share of equal words.
MATCHED, ITEM_SHARE, EQUAL_SHARE = 13, 0.8, 0.75
#: Items of fewer words are found where they stand word for word, and flagged; clean() removes nothing for them, as a few common
#: words prove nothing.
LEAST_ITEM = 5
#: Words of test items that are looked for at a time. Larger test sets are searched in several passes.
BLOCK_WORDS = 1_000_000
#: A replaced word costs so much; an equal one gains 1.
REPLACED = 2
_FACTORS = mixed(np.arange(1, 17, dtype=np.uint64))
_FOLD = bytes.maketrans(bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F)), b" " * 32)


def folded(text: str | None) -> str:
    return text.lower() if text else ""


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-case bytes, ASCII punctuation parting them."""
    starts, _, hashes = word_table(raw.translate(_FOLD))
    return starts, hashes


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of the mask's length."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, MASKS.index(mask) + 1, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += hashes[k : k + n] * _FACTORS[k]
    return mixed(out)


class Index:
    """Seeds of test items: sorted hashes with item and position, and a bitmap that most windows fail at once."""

    def __init__(self, items: dict[int, np.ndarray]):
        self.items, self.short = items, {}
        parts: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        for item, hashes in items.items():
            if len(hashes) < max(map(len, MASKS)):  # a short item must be there whole
                self.short.setdefault(len(hashes), {}).setdefault(int(run_hashes(hashes, np.array([0]), np.array([len(hashes)]))[0]), []).append(item)
            for mask in MASKS:
                h = seeds(hashes, mask)
                parts.append((h, item, np.arange(len(h)), np.concatenate(([np.uint64(0)], h[:-1]))[: len(h)]))
        self.hash = np.concatenate([np.zeros(0, np.uint64), *(h for h, *_ in parts)])
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.concatenate([np.zeros(0, np.int32), *(np.full(len(h), i, np.int32) for h, i, *_ in parts)])[order]
        self.at = np.concatenate([np.zeros(0, np.int32), *(k.astype(np.int32) for _, _, k, _ in parts)])[order]
        self.before = np.concatenate([np.zeros(0, np.uint64), *(b for *_, b in parts)])[order]  # the item's seed one place before
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, most: int = 1 << 20) -> set[tuple[int, int]]:
        """(item, diagonal): places where a document's window and an item's agree under a mask.

        Of hits that follow each other on a diagonal only the first is kept, so that long runs of equal words give few.
        """
        found: set[tuple[int, int]] = set()
        for mask in MASKS:
            h = seeds(hashes, mask)
            p = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.hash, h[p], side) for side in ("left", "right"))
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total, behind = np.cumsum(n), np.concatenate(([np.uint64(0xFFFFFFFFFFFFFFFF)], h[:-1]))[: len(h)]
            for part in np.split(np.arange(len(p)), np.searchsorted(total, np.arange(most, total[-1], most)) if len(p) else []):
                row = np.repeat(part, n[part])
                at = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                first = self.before[at] != behind[p[row]]
                row, at = row[first], at[first]
                found.update(zip(self.item[at].tolist(), (p[row] - self.at[at]).tolist(), strict=True))
        return found


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The stretch [start, end) with the highest score, the first of equals."""
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -REPLACED))))
    low = np.minimum.accumulate(score)
    end = int((score - low).argmax())
    start = int(np.flatnonzero(score[: end + 1] == low[end])[-1]) if end else 0
    return start, end


def fullest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The stretch [start, end) with the most equal words of those with EQUAL_SHARE of them; the first of equals."""
    count = np.concatenate(([0], np.cumsum(equal)))
    over = count - EQUAL_SHARE * np.arange(len(count))  # a stretch has the share if this doesn't fall over it
    start = np.searchsorted(-np.minimum.accumulate(over), -over)  # the first place from which it doesn't
    end = int((count - count[start]).argmax())
    return int(start[end]), end


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(equal words, length, start in the document) of the overlap on that diagonal, if it counts."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    equal = doc[diagonal + lo : diagonal + hi] == item[lo:hi]
    least = min(MATCHED, -(-int(100 * ITEM_SHARE) * len(item) // 100))
    if equal.sum() < least:
        return None
    start, end = best_stretch(equal)
    same = int(equal[start:end].sum())
    if same < least or same < EQUAL_SHARE * (end - start):  # a part of it, or a longer one, may still count
        start, end = fullest_stretch(equal)
        same = int(equal[start:end].sum())
        if same < least:
            return None
    return same, end - start, diagonal + lo + start


def search(batches: Iterator[pd.DataFrame], index: Index, names: list[int | None]) -> Iterator[pd.DataFrame]:
    """FOUND rows; names: the item_id of each text of the index."""
    for batch in batches:
        rows = []
        ids, marks = batch["doc_id"].to_numpy(object), batch["mark"].tolist()
        for first, run in in_chunks(map(folded, batch["text"])):
            raw, bounds = joined(run)
            starts, hashes = words_of(raw)
            cuts = np.searchsorted(starts, bounds)
            hit = index.hits(hashes)  # over the whole chunk: overlaps that cross documents fail below
            for size, of in index.short.items():
                at = np.arange(max(0, len(hashes) - size + 1))
                h = run_hashes(hashes, at, at + size) if len(at) else np.zeros(0, np.uint64)
                hit |= {(item, int(k)) for k in np.flatnonzero(np.isin(h, np.fromiter(of, np.uint64, len(of)))) for item in of[int(h[k])]}
            done = set()
            for item, diagonal in hit:
                words = index.items[item]
                lo, hi = np.searchsorted(cuts, [diagonal, diagonal + len(words)], side="right") - 1
                for d in range(max(0, lo), min(hi, len(run) - 1) + 1):
                    if (d, item, diagonal) in done:
                        continue
                    done.add((d, item, diagonal))
                    if found := overlap(hashes[cuts[d] : cuts[d + 1]], words, diagonal - int(cuts[d])):
                        rows.append((ids[first + d], marks[first + d], names[item], *found, len(words)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")], dtype=object)  # else ids beside a null would be floats


FOUND = "doc_id string, mark long, item_id long, matched long, overlap_words long, start_word long, item_words long"


def found_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_ITEM) -> DataFrame:
    """FOUND rows of every document (mark: its text's hash) and every text of an item of `least` words. Blocks are shared out by id and text."""
    spark = docs.sparkSession
    small_batches(spark)
    n_words = F.size(F.split(F.trim("text"), "\\s+"))
    items = settled(benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    total = items.agg(F.coalesce(F.sum(n_words), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_WORDS))
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).filter("text is not null")
    found = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        words = ((r["item_id"], words_of(folded(r["text"]).encode("utf-8", "replace"))[1]) for r in block.toLocalIterator())
        sent = spark.sparkContext.broadcast([(i, w.tobytes()) for i, w in words if len(w) >= least])
        part = texts.mapInPandas(lambda it, s=sent: lean(search(it, Index({k: np.frombuffer(w, np.uint64) for k, (_, w) in enumerate(s.value)}), [i for i, _ in s.value])), FOUND)
        found = part if found is None else found.union(part)
    return found


def not_searched(benchmark: DataFrame, least: int = LEAST_ITEM) -> DataFrame:
    """(item_id, n_words) of the texts of benchmark(item_id, text) that are too short for clean(), those without a word included."""

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [len(words_of(folded(t).encode("utf-8", "replace"))[1]) for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], "n_words": n})[np.array(n, np.int64) < least]

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(short, "item_id string, n_words long").select(F.col("item_id").cast("long").alias("item_id"), "n_words")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, overlap_words, start_word, item_words, short_item): the best overlap of each document and test item.

    docs(doc_id, text), benchmark(item_id, text). Null, empty and wordless texts overlap with nothing. Items of fewer than
    LEAST_ITEM words overlap only where all their words stand, and are flagged as short_item. All texts of an item are looked for, and the best overlap of any
    counts; items without an id are one. Very long texts are searched whole, piece by piece of several texts. Of equal overlaps the first counts; repeated rows count once. Empty tables on either side give no rows, null
    ids stay null, and other columns aren't read.

    A pass broadcasts the seeds of at most about BLOCK_WORDS words of test items; more items take more passes over the
    documents, each for its own share of the items.
    """
    best = F.max(F.struct("matched", (-F.col("overlap_words")).alias("o"), (-F.col("start_word")).alias("s"), "item_words"))
    return found_overlaps(docs, benchmark, 1).groupBy("doc_id", "item_id").agg(best.alias("m")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "item_id", "m.matched", (-F.col("m.o")).alias("overlap_words"), (-F.col("m.s")).alias("start_word"), "m.item_words", (F.col("m.item_words") < LEAST_ITEM).alias("short_item")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that overlap with no test item. Each is judged by its own text.

    So of rows that share an id, or have none, only those go that overlap themselves. Null, empty and wordless texts stay, as
    all do without test items; repeated rows go or stay together; an empty table gives no rows, and columns of any name are kept.
    """
    hit = settled(found_overlaps(docs, benchmark).select(F.col("doc_id").cast("long").alias("__hit"), F.col("mark").alias("__mark")).distinct())
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("__hit")) & (F.xxhash64(docs["text"]) == F.col("__mark")), "left_anti")
