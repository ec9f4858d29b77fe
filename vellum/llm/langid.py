"""Language identification by words first, character n-grams second.

A known word scores its logarithmic frequency in each language. An unseen word scores by its longest n-grams that are
known, falling back to progressively shorter ones where they aren't. The best mean decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import give_back, lean, run_hashes, settled, small_batches

#: The classifier is fitted on about so many labelled rows of each language, chosen by a hash of the id. Every language is
#: learned. The most frequent words and n-grams of each language are kept, so many in all as long as each language has FEWEST.
SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_GRAMS, FEWEST = 1500, 40_000, 20_000, 400
ORDERS = (5, 4, 3, 2, 1)
#: An unseen word is weaker evidence than a known one.
GRAM_WEIGHT = 0.5
UNKNOWN = "und"
#: Places whose scores are summed at a time.
PLACES = 1 << 16
#: Runs of letters; numerals such as \u00b2, which \\w has as well, make the slower exact pattern decide.
WORDLIKE, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def tokens(text: str) -> list[str]:
    found = WORDLIKE.findall(text := text.lower())
    return found if "".join(found).isalpha() else LETTERS.findall(text)


def grams(word: str, order: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + order] for i in range(len(w) - order + 1)]


#: Unseen words, and scores of these, that a worker remembers at most; it starts anew beyond, which changes no result.
REMEMBERED, CELLS = 100_000, 1 << 24


class Model:
    """Logarithmic frequencies by language: rows of `scores` for known words, rows of `gram_scores` for known n-grams."""

    def __init__(self, langs: list[str], words: list[str], scores: np.ndarray, grams: list[str], gram_scores: np.ndarray):
        self.langs, self.words, self.known, self.grams = langs, words, len(words), grams
        self.row = {w: k for k, w in enumerate(words)}
        self.most = max(1000, min(REMEMBERED, CELLS // max(1, len(langs))))
        self.scores = np.zeros((self.known + self.most, len(langs)), np.float32)
        self.scores[: self.known] = scores
        self.gram_scores = np.asarray(gram_scores, np.float32)  # the last row is that of an unknown letter
        ends = np.cumsum([len(g) for g in grams], dtype=np.int64)
        hashes = self.hashed("".join(grams), np.concatenate((np.zeros(1, np.int64), ends))[: len(grams)], ends) if grams else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.gram_hashes, self.gram_rows = hashes[order], order
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.gram_hashes >> np.uint64(44)).astype(np.int64)] = True
        self.memory: dict[str, int] = {}

    @staticmethod
    def hashed(text: str, starts, ends) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        return run_hashes(codes, np.asarray(starts), np.asarray(ends))

    def parts(self) -> tuple:
        return self.langs, self.words, self.scores[: self.known], self.grams, self.gram_scores

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean scores over each word's places: at each, of the longest known n-gram there, else of shorter ones.

        Words are parted by single spaces, which n-grams have at their ends alone, so that none spans two words.
        """
        text = f" {' '.join(words)} "
        best = np.full(len(text) - 1, -1)
        for order in ORDERS:
            at = np.flatnonzero(best[: len(text) - order + 1] < 0)
            h = self.hashed(text, at, at + order)
            maybe = self.bits[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            place = np.minimum(np.searchsorted(self.gram_hashes, h), len(self.grams) - 1)
            hit = self.gram_hashes[place] == h
            best[at[hit]] = self.gram_rows[place[hit]]
        places = np.array([len(w) + 1 for w in words])
        sums, ends = np.zeros((len(words), len(self.langs))), np.cumsum(places)
        for at in range(0, len(best), PLACES):
            part = self.gram_scores[best[at : at + PLACES]]
            first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
            sums[first : last + 1] += np.add.reduceat(part, np.concatenate(([0], ends[first:last] - at)), axis=0)
        return GRAM_WEIGHT * sums / places[:, None]

    def rows(self, words: list[str]) -> list[int]:
        """The rows in `scores` of at most self.most words."""
        new = [w for w in words if w not in self.row and w not in self.memory]
        if len(self.memory) + len(new) > self.most:
            self.memory.clear()
            new = [w for w in words if w not in self.row]
        if new:
            at = self.known + len(self.memory)
            self.scores[at : at + len(new)] = self.unseen(new)
            self.memory.update(zip(new, range(at, at + len(new)), strict=True))
        return [self.row[w] if w in self.row else self.memory[w] for w in words]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the posterior over languages, between 0 and 1; of equals the first by name."""
        found = tokens(text) if text else []
        if not found or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        count = Counter(found)
        words, times = list(count), np.array(list(count.values()), float)
        for k in range(0, len(words), self.most):
            total += times[k : k + self.most] @ self.scores[self.rows(words[k : k + self.most])]
        total *= min(1.0, 30 / len(found))  # words of a text depend on each other: beyond 30, only their mean counts
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and n-grams of a sample's rows, counted by language before they are shuffled."""
    for batch in batches:
        found: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)
        runs: defaultdict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            runs[lang].update(tokens(text))
        for lang, of in runs.items():
            found[lang, 0].update(of)
            for word, k in of.items():
                for order in ORDERS:
                    table = found[lang, order]
                    for g in grams(word, order):
                        table[g] += k
        rows = [(lang, order, g, k) for (lang, order), c in found.items() for g, k in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])


def fit(docs: DataFrame) -> Model:
    """A model from the text and non-null lang of docs(doc_id, text, lang), without the held-out rows.

    Per language, rows are chosen whose id's hash is below a threshold that depends on the language's row count alone.
    Word and n-gram tables are cut to the most frequent entries of each language, so that what is sent to the driver and to
    each worker grows with the number of languages only.
    """
    train = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sizes = settled(train.groupBy("lang").count())
    languages = max(1, sizes.count())
    share = sizes.select("lang", (F.lit(SAMPLE_ROWS) / F.col("count")).alias("share"))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sample = train.join(F.broadcast(share), "lang").filter(bucket < F.col("share")).select("text", "lang")
    counted = sample.mapInPandas(lambda it: lean(counts(it)), "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    by_item = settled(counted.groupBy("kind", "item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"), F.sum("n").alias("total")).filter("total > 1").drop("total"))
    # the count from which on entries are among the most frequent ones of a language; of those with just that count, a part by hash
    quota = F.when(F.col("kind") > 0, max(FEWEST, SAMPLE_GRAMS // languages)).otherwise(max(FEWEST, SAMPLE_WORDS // languages))
    with_count = by_item.select("kind", F.explode("by_lang").alias("lang", "n")).groupBy("kind", "lang", "n").agg(F.count(F.lit(1)).alias("items"))
    before = F.sum("items").over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"))) - F.col("items")
    border = with_count.withColumn("before", before).filter((F.col("before") <= quota) & (F.col("before") + F.col("items") > quota))
    limit = F.struct("n", ((quota - F.col("before")) / F.col("items")).alias("share"))
    limits = border.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "lang"), limit))).alias("limits"))
    spot = F.pmod(F.xxhash64("item"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def fits(entry: Column) -> Column:
        of = F.try_element_at("limits", F.concat_ws("|", "kind", entry["key"]))
        return of.isNull() | (entry["value"] > of["n"]) | ((entry["value"] == of["n"]) & (F.col("spot") < of["share"]))

    by_item = by_item.withColumn("spot", spot).join(F.broadcast(limits)).filter(F.exists(F.map_entries("by_lang"), fits))
    # columns and one table of counts: objects for each row and its map would take the driver several times the memory
    got = by_item.select("kind", "item", F.map_keys("by_lang").alias("langs"), F.map_values("by_lang").alias("counts")).toArrow().combine_chunks()
    kind, items = got["kind"].to_numpy(), got["item"].to_pylist()
    lists = [got[c].combine_chunks() for c in ("langs", "counts")]
    of_row = np.repeat(np.arange(len(items)), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    names = lists[0].flatten().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    raw = np.zeros((len(items), len(langs)))
    raw[of_row, place[names.indices.to_numpy(zero_copy_only=False)]] = lists[1].flatten().to_numpy(zero_copy_only=False)
    at = {k: sorted(np.flatnonzero(kind == k).tolist(), key=items.__getitem__) for k in (0, *ORDERS)}
    scores = {k: np.log((raw[rows] + 0.1) / (raw[rows].sum(axis=0) + 0.1 * len(rows) + 1)) for k, rows in at.items()}
    floor = np.log(0.1 / (raw[at[1]].sum(axis=0) + 0.1 * len(at[1]) + 1))
    words, word_scores = [items[r] for r in at.pop(0)], scores.pop(0)
    grams = [items[r] for rows in at.values() for r in rows]  # orders differ in length, so none is there twice
    del got, lists, names, raw, items
    give_back()
    return Model(langs, words, word_scores, grams, np.concatenate((*scores.values(), floor[None])))


def predictor(docs: DataFrame, model: Model | None):
    """A pandas UDF from text to (lang_pred, score), and the model, which is fitted on docs unless given."""
    small_batches(docs.sparkSession)
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # bounded, see above

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])
        del own
        give_back()

    return F.pandas_udf(predicted, "lang_pred string, score double"), model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang).

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learned. Predictions
    look at the text alone. A null id counts as not held out. Repeated rows are predicted alike, an empty table gives no
    rows, and columns other than the three aren't read.
    """
    predict, _ = predictor(docs, model)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select("doc_id", out, predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of at least `least`.

    If no row has a language to learn from, nothing is known against a text, and only those without a letter go.
    """
    predict, model = predictor(docs, model)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    p = predict("text")
    judged = docs.select(*[F.col(f"`{c}`") for c in docs.columns], p.alias("__language"))
    return judged.filter((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= least)).drop("__language")
