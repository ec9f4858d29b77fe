"""How far the sources of a language differ in their words.

Two passes over the documents. The first counts exactly in how many documents of a language each term stands, and keeps the
frequent ones. The second counts their occurrences: an automaton of kept terms, each with a delimiter on both sides, runs
over texts whose other characters are delimiters. What it finds becomes postings (language, source, term, count). Shares of
terms are smoothed, so a source has one share for all terms that it lacks, and postings alone give all distances.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, lean

#: Documents of a language in which a kept term stands at least, and the ranks of terms that a source reports.
LEAST_DOCUMENTS, TERM_RANKS = 30, 50
#: Shares are in parts of a thousand million, every count being raised by SMOOTHING.
UNIT, SMOOTHING = 1_000_000_000, 5
#: An automaton holds terms of up to so many bytes in all (a longer vocabulary takes more passes); terms of more than LONG bytes
#: are counted without it.
BLOCK_BYTES, LONG = 4 << 20, 64
#: Entries that a task counts before it hands them on, and bytes of a text that it takes at a time.
ENTRIES, PIECE = 200_000, 1 << 20
#: Sources and terms of a group of postings that is compared at a time, on average.
SOURCES, TERMS = 128, 1024

DELIMITER = b" "
#: Bytes outside terms become the delimiter. Those of all characters beyond ASCII belong to terms.
TERM_BYTES = bytes(b if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))


def pieces(raw: bytes | None) -> Iterator[bytes]:
    """The text in lower case with delimiters for all that isn't a term, cut between terms."""
    clean = (raw or b"").lower().translate(TERM_BYTES)
    at = 0
    while at < len(clean):
        end = clean.find(DELIMITER, at + PIECE) if len(clean) - at > PIECE else -1
        end = len(clean) if end < 0 else end
        yield clean[at:end]
        at = end


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) of the rows of a task, by parts of ENTRIES."""
    found: defaultdict[str, Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        out = [(lang, term, n) for lang, of in found.items() for term, n in of.items()]
        found.clear()
        langs, terms, n = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64())], ["lang", "term", "documents"])

    for batch in batches:
        for lang, raw in columns(batch, "lang", "raw"):
            terms: set[bytes] = set()
            for piece in pieces(raw):
                terms.update(piece.split())
            found[lang].update(terms)
        if sum(map(len, found.values())) > ENTRIES:
            yield rows()
    if any(found.values()):
        yield rows()


def automaton(terms: list[bytes]):
    """Finds the terms between delimiters; what it returns are their numbers. Bytes are characters, so no text is decoded."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        out.add_word((DELIMITER + term + DELIMITER).decode("latin-1"), k)
    out.make_automaton()
    return out


def occurrences(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, list[bytes]], long_terms: bool) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n) of the rows of a task. With long_terms also every term of more than LONG bytes, kept or not."""
    machines: dict[str, object] = {}
    found: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        out = [(lang, source, vocabulary[lang][k] if isinstance(k, int) else k, n) for (lang, source), of in found.items() for k, n in of.items()]
        found.clear()
        langs, sources, terms, n = zip(*out, strict=True)
        arrays = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n"])

    size = 0
    for batch in batches:
        for lang, source, raw in columns(batch, "lang", "source", "raw"):
            if lang in vocabulary and lang not in machines:
                machines[lang] = automaton(vocabulary[lang])
            of = found[lang, source]
            before = len(of)
            for piece in pieces(raw):
                if lang in machines:
                    of.update(map(itemgetter(1), machines[lang].iter((DELIMITER + piece + DELIMITER).decode("latin-1"))))
                if long_terms:
                    of.update(t for t in piece.split() if len(t) > LONG)
            size += len(of) - before
            if size > ENTRIES:
                yield rows()
                size = 0
    if any(found.values()):
        yield rows()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly for any count."""
    above = F.lit(UNIT).cast("decimal(19,0)") * (count + SMOOTHING).cast("decimal(19,0)")
    return F.call_function("div", above, (total + SMOOTHING * terms).cast("decimal(19,0)")) + 1


def postings(docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, documents) of kept terms, and (lang, source, term, n) of their occurrences, both written out."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("raw"))
    counted = named.select("lang", "raw").mapInArrow(lambda it: lean(document_counts(it)), "lang string, term binary, documents long")
    vocabulary = scratch.keep(counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least), "vocabulary")
    length = F.octet_length("term")
    short = F.when(length <= LONG, length + 16)
    size, long_ = vocabulary.agg(F.coalesce(F.sum(short), F.lit(0)), F.count_if(length > LONG)).first()
    blocks = max(1, -(-size // BLOCK_BYTES))
    spot = F.pmod(F.xxhash64("lang", "term"), F.lit(blocks))
    found = None
    for k in range(blocks):
        terms: defaultdict[str, list[bytes]] = defaultdict(list)
        for r in vocabulary.filter((length <= LONG) & (spot == k)).select("lang", "term").toLocalIterator():
            terms[r["lang"]].append(bytes(r["term"]))
        sent = docs.sparkSession.sparkContext.broadcast(dict(terms))  # about BLOCK_BYTES, whatever the corpus
        with_long = bool(long_) and k == 0
        part = named.mapInArrow(lambda it, s=sent, w=with_long: lean(occurrences(it, s.value, w)), "lang string, source string, term binary, n long")
        found = part if found is None else found.unionAll(part)
    summed = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    if long_:
        kept_long = vocabulary.filter(length > LONG).select("lang", "term")
        summed = summed.filter(length <= LONG).unionByName(summed.filter(length > LONG).join(kept_long, ["lang", "term"], "left_semi"))
    return vocabulary, scratch.keep(summed, "postings")


def distances(key: tuple, here: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of absolute differences of shares over the terms of one group of postings, for each ordered pair of sources.

    `seen` is the number of those terms, and `gap` the difference for each term that neither source has.
    """
    lang, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
    order = sorted(zip(groups["source"].to_pylist(), groups["block"].to_pylist(), groups["lacking"].to_pylist(), strict=True))
    names, block = [x[0] for x in order], np.array([x[1] for x in order])
    lacking = np.array([x[2] for x in order], np.int64)
    terms = here["term"].combine_chunks().dictionary_encode()
    shares = np.tile(lacking, (len(terms.dictionary), 1))
    at = {s: k for k, s in enumerate(names)}
    sources = here["source"].combine_chunks().dictionary_encode()
    if len(here):
        column = np.array([at[s] for s in sources.dictionary.to_pylist()])[sources.indices.to_numpy()]
        shares[terms.indices.to_numpy(), column] = here["share"].to_numpy()
    shares = np.ascontiguousarray(shares.T)
    out: list[tuple[str, str, int, int]] = []
    for k, name in enumerate(names):
        others = np.flatnonzero((block == (high if block[k] == low else low)) & (np.arange(len(names)) != k))
        values = np.abs(shares[others] - shares[k]).sum(axis=1)
        out += [(name, names[i], int(v), int(g)) for i, v, g in zip(others, values, np.abs(lacking[others] - lacking[k]), strict=True)]
    source, item, value, gap = zip(*out, strict=True) if out else ([], [], [], [])
    kinds = {"lang": pa.string(), "source": pa.string(), "item": pa.string(), "value": pa.int64(), "gap": pa.int64(), "seen": pa.int64()}
    data = [[lang] * len(out), source, item, value, gap, [len(terms.dictionary)] * len(out)]
    return pa.table([pa.array(x, t) for x, t in zip(data, kinds.values(), strict=True)], list(kinds))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs(text, lang, source): the distance of each source to every other one of
    its language (`pair`), and the terms whose share in it exceeds their share in the language most (`term`).

    Nulls count as ''. A source without kept terms has equal shares for all; a language without kept terms has distances of
    0 and no terms. Equal values are ranked by item. Repeated rows count each time, texts of any length whole, an empty table
    gives no rows, and other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary, found = postings(docs, scratch, least)
    by_lang = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    group_totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(by_lang, "lang", "left")
    all_totals = found.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    sizes = named.join(group_totals, ["lang", "source"], "left").join(of_lang.join(all_totals, "lang", "left"), "lang").fillna(0)
    block = F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / SOURCES)).cast("int")
    lacking = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    groups = scratch.keep(sizes.select("*", block.alias("block"), lacking.alias("lacking"), F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).alias("chunks")), "groups")
    known = found.join(groups, ["lang", "source"]).withColumn("term", F.col("term").cast("string"))
    known = known.withColumn("share", share(F.col("n"), F.col("total"), F.col("terms")))

    blocks = F.sequence(F.lit(0), F.ceil(F.col("sources") / SOURCES).cast("int") - 1)
    beside = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    cells = known.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks"))).withColumn("other", F.explode(blocks))
    cells = cells.select("lang", *beside, "chunk", "source", "term", "share")
    frame = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("other", F.explode(blocks))
    frame = frame.select("lang", *beside, "chunk", "source", "block", "lacking")
    keys = ["lang", "low", "high", "chunk"]
    compared = cells.groupBy(*keys).cogroup(frame.groupBy(*keys)).applyInArrow(distances, "lang string, source string, item string, value long, gap long, seen long")
    summed = compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.max("gap").alias("gap"), F.sum("seen").alias("seen"))
    value = F.col("value") + (F.col("terms") - F.col("seen")) * F.col("gap")
    pairs = summed.join(by_lang, "lang", "left").fillna(0, "terms").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    in_lang = share(F.sum("n").over(Window.partitionBy("lang", "term")), F.col("lang_total"), F.col("terms"))
    above = known.withColumn("value", F.col("share") - in_lang).filter("value > 0")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pairs.unionAll(terms)
