"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal sets of word shingles are one class, of which one document goes on. Its signature is cut into bands,
and classes that agree in a band are candidates. Candidates are compared batch by batch of signature values; after each
batch a pair is dropped once the posterior probability that its similarity reaches the threshold is below the chosen
miss probability. Whatever survives is verified on the full sets, and components of the links are found.

A bucket of n classes isn't expanded into n * n pairs. Its members are first compared with two pivots of the bucket. Where
components still differ, members of different ones meet in blocks of bounded size, as long signatures, and only pairs that
outlive the test there become rows. A pair inside a component can't change the result, so none that matters is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, lean, settled, shingle_sets
from vellum.llm.components import components

WIDTH = 5
#: Bands of ROWS values each. A pair of similarity 0.75 shares none of them with probability 5e-6.
BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
BATCH, MISS = 16, 1e-5
#: Values of the signatures by which members of a bucket are compared across components, and members in a block.
LONG, BLOCK = 768, 1024

_SEEDS = np.random.default_rng(20240229)
FACTORS = _SEEDS.integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _SEEDS.integers(0, 1 << 63, LONG, dtype=np.uint64)


def signature(shingles: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """So many minima of multiply-shift hashes, 32 bits each; long sets are taken in slices of bounded memory."""
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] * FACTORS[:size, None]
        part += OFFSETS[:size, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> list[int]:
    """A hash of each band, which no other band has."""
    return [xxhash.xxh3_64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)]


def low_bytes(sig: np.ndarray) -> bytes:
    return (sig & np.uint32(255)).astype(np.uint8).tobytes()


def signed(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, s in zip(batch["doc_id"], shingle_sets(batch["text"], width), strict=True):
            if not len(s):
                rows.append((doc_id, 0, None, None, None))
                continue
            sig = signature(s)
            rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), low_bytes(sig), band_hashes(sig)))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "key", "sig", "bands"])


def needed(threshold: float, size: int) -> list[int]:
    """For 16, 32, .. compared values, the fewest matches at which a pair isn't dropped.

    With a uniform prior the posterior of the similarity after m matches among n is Beta(m + 1, n - m + 1), whose
    probability above t equals that of at most m successes in n + 1 trials at t.
    """
    out = []
    for n in range(BATCH, size + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append(m)
    return out


def outlive(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of rows x[i], y[j] outlive the sequential test. Values have 8 bits; chance matches only keep pairs."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, low in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (x[i[alive], part] == y[j[alive], part]).sum(axis=1)
        fit = matches >= low
        alive, matches = alive[fit], matches[fit]
    return alive


def survives(threshold: float):
    """The test as a function of two columns of signatures."""
    least = needed(threshold, SIGNATURE)

    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        if len(a):
            x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SIGNATURE) for s in (a, b))
            at = np.arange(len(a))
            out[outlive(x, at, y, at, least)] = True
        return pd.Series(out)

    return F.pandas_udf(test, "boolean")


def meet(batches: Iterator[pd.DataFrame], percent: int, least: list[int], most: int = 1 << 17) -> Iterator[pd.DataFrame]:
    """Pairs (a, b), a < b, of different components and similar sizes that outlive the test.

    Rows (bucket, lo, hi, side, id, root, n, sig, bands) are sorted by (bucket, lo, hi, n). Those of one (bucket, lo, hi)
    are two blocks, or one if lo = hi, of about BLOCK rows each; only they are held from batch to batch. A pair that shares
    several buckets comes out of that of its first common band alone.
    """
    names = ["bucket", "lo", "hi", "side", "id", "root", "n"]
    held, held_sig, held_bands = {c: np.zeros(0, np.int64) for c in names}, np.zeros((0, LONG), np.uint8), np.zeros((0, BANDS), np.int64)
    for batch in batches:
        if not len(batch):
            continue
        x = {c: np.concatenate((held[c], batch[c].to_numpy().astype(np.int64))) for c in names}
        sig = np.concatenate((held_sig, np.frombuffer(b"".join(batch["sig"]), np.uint8).reshape(-1, LONG)))
        bands = np.concatenate((held_bands, np.frombuffer(b"".join(batch["bands"]), np.int64).reshape(-1, BANDS)))
        new = (x["bucket"][1:] != x["bucket"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])
        group = np.cumsum(np.concatenate(([0], new))) * (x["n"].max() + 1)
        least_row = np.searchsorted(group + x["n"], group + -(-percent * x["n"] // 100))  # the first row that is large enough
        rows = np.arange(len(held["n"]), len(group))
        width = rows - least_row[rows]
        total = np.cumsum(width)
        for part in np.split(np.arange(len(rows)), np.searchsorted(total, np.arange(most, total[-1], most))):
            w = width[part]
            j = np.repeat(rows[part], w)
            i = j - 1 - (np.arange(len(j)) - np.repeat(np.cumsum(w) - w, w))
            fit = (x["root"][i] != x["root"][j]) & ((x["side"][i] != x["side"][j]) | (x["lo"][i] == x["hi"][i]))
            i, j = i[fit], j[fit]
            fit = outlive(sig, i, sig, j, least)
            i, j = i[fit], j[fit]
            first = (bands[i] == bands[j]).argmax(axis=1)
            fit = bands[i, first] == x["bucket"][i]
            a, b = x["id"][i[fit]], x["id"][j[fit]]
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        keep = group == group[-1]
        held, held_sig, held_bands = {c: v[keep] for c, v in x.items()}, sig[keep], bands[keep]


def set_rows(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            yield pd.DataFrame({"id": part["doc_id"].to_numpy(), "shingles": [s.view(np.int64) for s in shingle_sets(part["text"], width)]})


def long_signatures(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sigs = [signature(s, LONG) for s in shingle_sets(batch["text"], width)]
        yield pd.DataFrame({"id": batch["doc_id"], "sig": list(map(low_bytes, sigs)), "bands": [np.array(band_hashes(s), np.int64).tobytes() for s in sigs]})


def component_table(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    Links join documents with 100 * shared shingles >= percent * shingles of either. component_id is the smallest doc_id
    that links reach, the document's own included. Null, empty and wordless texts have no shingles and no links. Rows
    with a null id have a null component and aren't linked. Rows that share an id are one node, whichever texts they
    have. An empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    scratch, threshold = Scratch(spark), percent / 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = scratch.keep(
        texts.filter("doc_id is not null").mapInPandas(lambda it: lean(signed(it, width)), "doc_id long, n int, key binary, sig binary, bands array<long>"), "signed"
    )
    rows = known.filter("n > 0")
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("cid"))
    placed = scratch.keep(rows.select("doc_id", "n", "key").join(classes, "key").select("doc_id", "n", "cid", "key"), "classes")
    # one document of each class goes on; an id with several texts stands for several classes, which it links
    firsts = placed.filter("doc_id = cid").select("key", F.col("cid").alias("id")).distinct()
    found = rows.join(firsts, (rows["key"] == firsts["key"]) & (rows["doc_id"] == firsts["id"])).select("id", "n", "sig", "bands")
    reps = scratch.keep(found.groupBy("id", "sig").agg(F.first("n").alias("n"), F.first("bands").alias("bands")), "reps")
    several = placed.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a < z")
    same_id = placed.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("cid").alias("b")).filter("a < b")

    banded = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("p0"), F.max("id").alias("p1")).filter("size > 1")
    members = scratch.keep(banded.join(shared, "bucket").select("bucket", "id", "n", "p0", "p1"), "members")
    short, test = reps.select("id", "n", "sig"), survives(threshold)

    def near(a, b):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def promising(pairs: DataFrame) -> DataFrame:
        """pairs(a, b), a < b, of similar sizes that outlive the sequential test."""
        x, y = (short.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab")
        both = pairs.join(y, "b").join(x, "a").filter(near(F.col("n_a"), F.col("n_b")))
        return both.filter(test("sig_a", "sig_b")).select("a", "b").distinct()

    def of(ids: DataFrame) -> DataFrame:
        """The texts of ids(id), read anew."""
        return texts.join(ids, texts["doc_id"] == ids["id"], "left_semi")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs(a, b), by the full sets."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = scratch.keep(of(ids).mapInPandas(lambda it: lean(set_rows(it, width)), "id long, shingles array<long>"), f"sets{name}")
        b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        both = b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").withColumn("common", F.size(F.array_intersect("x", "y")))
        links = settled(both.filter(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b").distinct())
        scratch.drop(f"sets{name}")
        return links

    def resolved(links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Roots of the linked classes, and members, with their roots, of the buckets where components differ."""
        roots = scratch.keep(components(links), f"roots{name}")
        rooted = members.join(roots, members["id"] == roots["node"], "left").select(members["*"], F.coalesce("root", "id").alias("root"))
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi").select("bucket", "size")
        return roots, scratch.keep(rooted.join(mixed, "bucket"), f"mixed{name}")

    links, tested, mixed = same_id, None, members.withColumn("root", F.col("id"))
    for k in range(2):
        pivot = mixed.filter(F.col("id") != F.col(f"p{k}")).select("id", "root", F.col(f"p{k}").alias("pivot"))
        if k:
            at = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
            pivot = pivot.join(at, "pivot", "left").filter(F.col("root") != F.coalesce("pivot_root", "pivot"))
        pairs = pivot.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        if k:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settled(promising(pairs))
        tested = tested.union(pairs) if k else pairs
        links = settled(links.union(verified(pairs, str(k))))
        roots, mixed = resolved(links, str(k))
        if k:
            for name in ("mixed0", "members", "reps"):  # nothing reads them any more
                scratch.drop(name)
    sigs = of(mixed.select("id").distinct()).mapInPandas(lambda it: lean(long_signatures(it, width)), "id long, sig binary, bands binary")
    side = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))
    blocks = mixed.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).select("bucket", "id", "root", "n", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    meeting = blocks.join(sigs, "id").select("bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "id", "root", "n", "sig", "bands")
    least = needed(threshold, LONG)
    met = meeting.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "n").mapInPandas(lambda it: meet(it, percent, least), "a long, b long")
    pairs = settled(met.distinct().join(tested, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        links = links.union(verified(pairs, "last"))
        roots = scratch.keep(components(links), "roots")
    by_doc = placed.select("doc_id", "n", F.col("cid")).join(roots, F.col("cid") == roots["node"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "cid").alias("component_id"))
    wordless = known.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nameless = texts.filter("doc_id is null").mapInPandas(lambda it: lean(signed(it, width)), "doc_id long, n int, key binary, sig binary, bands array<long>").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "doc_id")
    out = settled(by_doc.union(wordless).union(nameless))
    scratch.drop()
    return out


def digest(found: DataFrame) -> DataFrame:
    """Adds kept: whether the document stands for its component. Rows without an id stand for themselves."""
    return found.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each group of near-duplicates: the first by (doc_id, hash of the text).

    Each row is judged by its own text: of rows that share an id, those stay whose texts resemble no earlier one, and repeated
    rows are copies of each other, of which one stays. Rows without an id come last, so that one whose text resembles that of
    a row with an id goes. Null, empty and wordless texts resemble nothing and all stay. A very long text is compared whole. docs
    may have further columns of any name; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    # a number for each row, by which rows are linked; it must not change, so the rows are written
    rows = scratch.keep(docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.monotonically_increasing_id().alias("__row")), "rows")
    groups = component_table(rows.select(F.col("__row").alias("doc_id"), "text"), percent)
    several = groups.filter("component_id is not null").groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    linked = settled(groups.join(several, "component_id").select(F.col("doc_id").alias("__linked"), F.col("component_id").alias("__of")))
    places = rows.select("doc_id", F.xxhash64("text").alias("__mark"), "__row").join(linked, F.col("__row") == F.col("__linked"))
    place = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), F.col("__mark").alias("m"), F.col("__row").alias("r"))
    first = places.groupBy("__of").agg(F.min(place).alias("first")).select("first.r")
    gone = settled(linked.select("__linked").join(first, F.col("__linked") == F.col("r"), "left_anti"))
    return rows.join(gone, F.col("__row") == F.col("__linked"), "left_anti").drop("__row")


