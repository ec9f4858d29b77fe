"""Repeated passages: every run of several consecutive sentences is hashed, and later repeats are removed.

A sentence ends at a line end, or at a word that ends in . ! or ? (closing quotes and brackets may follow). One of more than
LONG words is parted behind words whose hash is the least of any WINDOW consecutive words of it, wherever it began, so that
passages that begin or end within a sentence, or have no stops, are found as well: two cuts are at most WINDOW words apart,
and from WINDOW - 1 words within a passage on they depend on it alone. A passage of over 50 words without stops so holds a
span. Without a window, sentences are parted behind words whose hash begins with ZEROS zero bits. A span is
the shortest run from a sentence on that has at least SENTENCES sentences and WORDS words. Of the places of a span the
first by (doc_id, text hash, sentence) stays; sentences that any other place covers are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, in_chunks, joined, lean, run_hashes, settled, word_table

SENTENCES, WORDS, LONG, ZEROS = 2, 20, 30, 3
#: Long sentences are cut at least every so many words.
WINDOW = 8
_STOP, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE[list(b"\"')]}")] = True


def least_of_window(hashes: np.ndarray, sentence: np.ndarray, window: int) -> np.ndarray:
    """Which words have the least hash of any `window` consecutive words that lie in one sentence."""
    n = len(hashes) - window + 1
    out = np.zeros(len(hashes), bool)
    if n <= 0:
        return out
    least = hashes[:n].copy()
    for k in range(1, window):
        np.minimum(least, hashes[k : k + n], out=least)
    whole = sentence[:n] == sentence[window - 1 :]
    for k in range(window):
        out[k : k + n] |= whole & (hashes[k : k + n] == least)
    return out


def sentence_starts(raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, window: int = 0) -> np.ndarray:
    """Numbers of the words that begin a sentence. Documents end in a line end."""
    data = np.frombuffer(raw, np.uint8)
    last = ends - 1
    for _ in range(3):  # closing marks behind the stop
        back = _CLOSE[data[last]] & (last > starts)
        if not back.any():
            break
        last = last - back
    lines = np.searchsorted(np.flatnonzero(data == 10), starts)
    fresh = np.concatenate(([True], _STOP[data[last[:-1]]] | (lines[1:] != lines[:-1])))
    sentence = np.cumsum(fresh) - 1
    long_ = np.bincount(sentence)[sentence] > LONG
    cut = least_of_window(hashes, sentence, window) if window else hashes >> np.uint64(64 - ZEROS) == 0
    fresh[1:] |= (long_ & cut)[:-1]
    return np.flatnonzero(fresh)


def spans_of(texts, sentences: int = SENTENCES, words: int = WORDS, window: int = 0) -> Iterator[tuple]:
    """Per chunk: bytes, document bounds, word starts, first word of each sentence, and spans (document, sentence there, end, hash).

    Documents and sentences count from the chunk's first; `end` is the sentence behind the span.
    """
    for first, run in in_chunks(texts):
        raw, bounds = joined(run)
        starts, ends, hashes = word_table(raw)
        if not len(starts):
            yield first, raw, bounds, starts, np.zeros(0, np.int64), np.zeros((3, 0), np.int64), np.zeros(0, np.uint64)
            continue
        heads = sentence_starts(raw, starts, ends, hashes, window)
        doc = np.searchsorted(bounds, starts[heads], side="right") - 1
        tails = np.concatenate((heads[1:], [len(starts)]))
        k = np.arange(len(heads))
        end = np.maximum(k + sentences, np.searchsorted(tails, heads + words) + 1)
        fits = end <= len(heads)
        fits[fits] = doc[end[fits] - 1] == doc[k[fits]]
        k, end = k[fits], end[fits]
        span_hash = run_hashes(hashes, heads[k], tails[end - 1]) if len(k) else np.zeros(0, np.uint64)
        yield first, raw, bounds, starts, heads, np.stack((doc[k], k, end)), span_hash


def hashed(batches: Iterator[pd.DataFrame], sentences: int, words: int, window: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, marks = batch["doc_id"].to_numpy(object), batch["mark"].to_numpy()
        for first, _, bounds, starts, heads, (doc, k, _), h in spans_of(batch["text"], sentences, words, window):
            if len(h):
                base = np.searchsorted(starts[heads], bounds[:-1])  # sentences of earlier documents
                yield pd.DataFrame({"hash": h.view(np.int64), "doc_id": ids[doc + first], "mark": marks[doc + first], "at": k - base[doc]})


def cleaned(batches: Iterator[pd.DataFrame], sentences: int, words: int, window: int) -> Iterator[pd.DataFrame]:
    """Texts without the sentences that spans starting at `later` cover; sentences go with the white space behind them."""
    for batch in batches:
        later = batch["later"].tolist()
        out, counts = [], []
        for first, raw, bounds, starts, heads, (doc, k, end), _ in spans_of(batch["text"], sentences, words, window):
            base = np.searchsorted(starts[heads], bounds[:-1])
            at = k - base[doc]
            for d in range(len(bounds) - 1):
                lo, hi = base[d], base[d + 1] if d + 2 < len(bounds) else len(heads)
                gone = np.zeros(hi - lo + 1, np.int64)
                mine = slice(*np.searchsorted(doc, [d, d + 1]))
                hit = np.isin(at[mine], later[first + d])
                np.add.at(gone, at[mine][hit], 1)
                np.add.at(gone, end[mine][hit] - lo, -1)
                gone = np.cumsum(gone)[:-1] > 0
                cuts = [*starts[heads[lo:hi]].tolist(), int(bounds[d + 1]) - 1]
                kept = [raw[int(bounds[d]) : cuts[0]]] + [raw[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(~gone)]
                out.append(b"".join(kept).decode("utf-8"))
                counts.append(int(gone.sum()))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": batch["mark"], "rest": out, "removed": counts})


def later_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, window: int = 0) -> DataFrame:
    """(doc_id, mark, later): for documents with any, the sentences at which a span starts that occurs earlier, too.

    docs(doc_id, text); mark is a hash of the text. Rows with one id and one text are one document. Null and empty texts
    have no spans, an empty table gives no rows, null ids come first in the order, and other columns aren't read.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).filter("text is not null")
    schema = "hash long, doc_id string, mark long, at int"
    spans = texts.mapInPandas(lambda it: lean(hashed(it, sentences, words, window)), schema).select("hash", F.struct(F.col("doc_id").cast("long").alias("doc_id"), "mark", "at").alias("place"))
    scratch = Scratch(docs.sparkSession)
    repeated = scratch.keep(spans.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("hash", "first"), "repeated")
    later = spans.join(repeated, "hash").filter("place > first")
    out = settled(later.groupBy("place.doc_id", "place.mark").agg(F.collect_set("place.at").alias("later")))
    scratch.drop()
    return out


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, window: int = 0) -> DataFrame:
    """doc_id, text, removed (sentences) for every row of docs(doc_id, text); see later_spans for the unusual cases.

    A null text stays null. A document all of whose sentences repeat stays, with what white space stood before them.
    """
    found = later_spans(docs, sentences, words, window)
    d, s = docs.select("doc_id", "text").alias("d"), found.alias("s")
    both = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.mark")), "left").select("d.doc_id", "d.text", "s.mark", "s.later")
    same = both.filter("later is null").select("doc_id", "text", F.lit(0).cast("long").alias("removed"))
    named = both.filter("later is not null").withColumn("doc_id", F.col("doc_id").cast("string"))
    cut = named.mapInPandas(lambda it: lean(cleaned(it, sentences, words, window)), "doc_id string, mark long, rest string, removed long")
    return same.union(cut.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]), "rest", "removed"))
