"""Operators against plain versions of the same definition, on the smallest tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tests.conftest import DATA
from vellum.llm import chat, components, decontaminate, html_main, langid, line_dup, near_dup, pack, quality, queries, sentence_spans, shard
from vellum.llm.common import run_hashes, shingle_sets, word_table

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)


def edited(docs):
    """The documents and copies of some with a word replaced here and there, so that near copies of every degree occur."""
    rows = list(zip(docs.doc_id, docs.text, strict=True))
    rng, n = np.random.default_rng(5), 10_000
    for doc_id, text in rows[:25]:
        for share in (0.01, 0.02, 0.04, 0.06, 0.1):
            words = text.split(" ")
            for k in rng.integers(0, len(words), max(1, int(share * len(words)))):
                words[k] = f"x{rng.integers(1000)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows


def shingles(text):
    w = text.encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def test_words_and_hashes():
    for raw in (b"", b" ", b"a", b"  ab c\n\x1cd\x0be ", b"x" * 200_000 + b" y " + b"z " * 10):
        s, e, h = word_table(raw)
        assert [raw[a:b] for a, b in zip(s, e, strict=True)] == raw.split()
        assert len(set(h.tolist())) == len(set(raw.split()))
    v = np.arange(9, dtype=np.uint64) % np.uint64(3)
    assert run_hashes(v, np.array([0, 3]), np.array([2, 5])).tolist()[0] == run_hashes(v, np.array([3]), np.array([5])).tolist()[0]
    assert [len(x) for x in shingle_sets(["a b c d e f", "A b", None, ""])] == [2, 1, 0, 0]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 80)]
    want = Sets()
    for a, b in links:
        want.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in {y for ab in links for y in ab}}


def test_near_duplicates(spark, docs):
    rows = edited(docs)
    sets, want = {i: shingles(t) for i, t in rows}, Sets()
    places = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            places[g].append(i)
    common = Counter((a, b) for of in places.values() for a in of for b in of if a < b)
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            want.join(a, b)
    out = near_dup.digest(near_dup.component_table(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (len(s), want.find(i), want.find(i) == i) for i, s in sets.items()}


def test_members_of_a_bucket_meet_once():
    """Blocks of one bucket and of two, batch by batch: the same pairs as by comparing all."""
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 3, (40, near_dup.LONG)).astype(np.uint8)
    sig[::2] = sig[0]
    bands = np.tile(np.arange(near_dup.BANDS, dtype=np.int64) * 7, (40, 1))
    side = rng.integers(0, 2, 40)
    rows = []
    for k in range(40):
        for other in (0, 1):
            rows.append((0, min(side[k], other), max(side[k], other), side[k], k, k % 5, 100, sig[k].tobytes(), bands[k].tobytes()))
    df = pd.DataFrame(rows, columns=["bucket", "lo", "hi", "side", "id", "root", "n", "sig", "bands"]).sort_values(["bucket", "lo", "hi", "n"])
    got = [(a, b) for part in near_dup.meet(iter(np.array_split(df, 7)), 75, near_dup.needed(0.75, near_dup.LONG), most=50) for a, b in zip(part.a, part.b, strict=True)]
    assert sorted(got) == sorted({(a, b) for a in range(0, 40, 2) for b in range(a + 2, 40, 2) if a % 5 != b % 5})


def test_miss_probability():
    """At the threshold itself, pairs are dropped about as seldom as chosen, at every batch together."""
    rng = np.random.default_rng(3)
    equal = rng.random((20000, near_dup.LONG)) < 0.75
    steps = equal.cumsum(axis=1)[:, near_dup.BATCH - 1 :: near_dup.BATCH]
    assert (steps < np.array(near_dup.needed(0.75, near_dup.LONG))).any(axis=1).mean() < 1e-3


@pytest.mark.parametrize("values", [{}, {"PARTNERS": 1}, {"PARTNERS": 1, "ROWS": 64, "HOT": 2}, {"FREQUENT": 0}, {"FREQUENT": 300, "SEEN": 5}])
def test_lines(spark, docs, monkeypatch, values):
    for name, value in values.items():
        monkeypatch.setattr(line_dup, name, value)
    rows = edited(docs)[: 200 + 40]
    lines = [((i, k), frozenset(x.encode().split())) for i, t in rows for k, x in enumerate(t.split("\n")) if x.encode().split()]
    want, index = set(), defaultdict(set)
    for n, (place, s) in enumerate(lines):
        near = Counter(m for w in s for m in index[w])
        if any(100 * c >= 80 * (len(s) + len(lines[m][1]) - c) for m, c in near.items()):
            want.add(place)
        for w in s:
            index[w].add(n)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    later = line_dup.later_lines(table)
    assert {(r.doc, r.line) for r in later.collect()} == want
    texts = {r.doc_id: r.text for r in line_dup.without_lines(table, later).collect()}
    assert texts == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want) for i, t in rows}


def test_random_near_lines(spark, monkeypatch):
    """Lines over few words, edited by degrees around the threshold, in rows that share ids or have none."""
    monkeypatch.setattr(line_dup, "ROWS", 256)
    monkeypatch.setattr(line_dup, "HOT", 8)
    rng, rows = np.random.default_rng(11), []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 40))]
        for _ in range(20):
            line = list(base)
            for _ in range(rng.integers(0, 5) if line else 0):
                k = rng.integers(0, len(line))
                line[k : k + 1] = [[] if line[1:] else line, [f"w{rng.integers(0, 60)}"], [line[k], f"v{rng.integers(0, 9)}"]][rng.integers(0, 3)]
            rows.append((None if rng.random() < 0.1 else int(rng.integers(0, 300)), " ".join(line)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sorted({(r.doc, r.mark, frozenset(r.text.split())) for r in line_dup.marked(table).collect()}, key=lambda r: r[:2])
    want = {(d, m) for k, (d, m, s) in enumerate(placed) if s and any(100 * len(s & t) >= 80 * len(s | t) for _, _, t in placed[:k])}
    assert {(r.doc, r.mark) for r in line_dup.later_lines(table).collect()} == want and 100 < len(want) < len(placed)


def sentences(text):
    """(start, end, words) of each sentence in characters, white space behind it included."""
    import re

    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out = []
    for a, b in words:
        word = text[a:b]
        fresh = not out or out[-1][3] or "\n" in text[out[-1][1] : a]
        bare = word
        for _ in range(3):
            if len(bare) > 1 and bare[-1] in "\"')]}":
                bare = bare[:-1]
        if fresh:
            out.append([a, b, [word], bare[-1] in ".!?"])
        else:
            out[-1][1], out[-1][3] = b, bare[-1] in ".!?"
            out[-1][2].append(word)
    parted = []
    for a, b, ws, stop in out:
        if len(ws) <= sentence_spans.LONG:
            parted.append([a, b, ws, stop])
            continue
        at = a
        for w, h in zip(ws, word_table(" ".join(ws).encode())[2].tolist(), strict=True):
            at = text.index(w, at)
            if not parted or parted[-1][0] < a or parted[-1][3] is None:
                parted.append([at, at + len(w), [w], False])
            else:
                parted[-1][1] = at + len(w)
                parted[-1][2].append(w)
            at += len(w)
            if h >> (64 - sentence_spans.ZEROS) == 0:
                parted[-1][3] = None  # the next word begins a part
    return parted


def test_sentence_spans(spark, docs):
    rows = edited(docs)[: 200 + 30] + [(20_000, "One two. " * 3 + " ".join(f"w{k}" for k in range(30)) + ". End"), (20_001, "Other. " + " ".join(f"w{k}" for k in range(30)) + ". End")]
    first, spans = {}, defaultdict(list)
    for i, t in rows:
        s = sentences(t)
        for k in range(len(s)):
            e = k + 2
            while e <= len(s) and sum(len(x[2]) for x in s[k:e]) < 20:
                e += 1
            if e <= len(s):
                key = tuple(w for x in s[k:e] for w in x[2])
                spans[i].append((key, k, e))
                first.setdefault(key, (i, k))
    want = {}
    for i, t in rows:
        s = sentences(t)
        gone = {x for key, k, e in spans[i] if first[key] != (i, k) for x in range(k, e)}
        cuts = [x[0] for x in s] + [len(t)]
        want[i] = ((t[: cuts[0]] if s else t) + "".join(t[cuts[k] : cuts[k + 1]] for k in range(len(s)) if k not in gone), len(gone))
    out = sentence_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.removed) for r in out} == want


def test_decontamination(spark, docs):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    fold = lambda t: t.lower().encode().translate(decontaminate._FOLD).split()
    rng, rows = np.random.default_rng(4), list(zip(docs.doc_id, docs.text, strict=True))
    for k, text in enumerate(bench.text):  # with one word in eight replaced
        words = text.split()
        for at in rng.choice(len(words), len(words) // 8, replace=False):
            words[at] = "zzz"
        rows.append((50_000 + k, "Some words before. " + " ".join(words) + " And some behind."))
    items = {i: fold(t) for i, t in zip(bench.item_id, bench.text, strict=True)}
    want = set()
    for i, t in rows:
        w = fold(t)
        for item, x in items.items():
            for d in range(-len(x) + 1, len(w)):
                lo, hi = max(0, -d), min(len(x), len(w) - d)
                equal = np.array([w[d + j] == x[j] for j in range(lo, hi)])
                if equal.sum() >= 8 and decontaminate.overlap(np.array(w, object), np.array(x, object), d):
                    want.add((i, item))
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert found <= want and len(found) >= 0.99 * len(want)
    assert {(50_000 + k, i) for k, i in enumerate(bench.item_id)} & want <= found


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = decontaminate.overlaps(d, b).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(decontaminate.overlaps(d, b).collect()) == sorted(whole) and whole


def test_shards(spark, docs):
    out = queries.queries()["op2_virtual_slots"](spark, f"{DATA}/sf0.01").toPandas()
    d = pd.read_parquet(f"{DATA}/sf0.01/documents.parquet").set_index("doc_id")
    assert len(out) == len(d) and (out["size"].to_numpy() == [len(d.text[i].encode()) + 16 for i in out.doc_id]).all()
    assert (out.text_crc32.to_numpy() == [zlib.crc32(d.text[i].encode()) for i in out.doc_id]).all()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 40 and loads.max() < 1.02 * loads.mean()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_grown_map_moves_slots_to_the_new_shard_only(spark):
    parted = shard.with_parts(shard.records(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")), 10)
    one = shard.build_map(shard.slot_loads(parted), 10)
    two = shard.grow(one, 10)
    a, b = ({(r.vslot, r.part): (r["shard"], r.bytes) for r in m.collect()} for m in (one, two))
    moved = [k for k in a if a[k][0] != b[k][0]]
    assert a.keys() == b.keys() and moved and all(b[k][0] == 10 for k in moved)
    new, total = sum(a[k][1] for k in moved), sum(v for _, v in a.values())
    assert 0.7 * total / 11 < new < 1.05 * total / 11 and {r.version for r in two.collect()} == {2}


def test_packing(spark, docs):
    out = queries.queries()["op5_cost_balanced_packing"](spark, SF).toPandas()
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(pack.vocabulary()[0])
    text = docs.set_index("doc_id").text
    for doc, part in out.sort_values("start").groupby("doc_id"):
        ids = tokens.encode(text[doc], add_special_tokens=False).ids + [1]
        assert part.doc_tokens.eq(len(ids)).all() and part.start.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() == len(ids)
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= 2048 and part.offset.tolist() == [0, *part.length.cumsum()[:-1]]
    assert out.sequence_id.nunique() * 2048 - out.length.sum() < 2048


def test_balance():
    sizes = np.random.default_rng(6).integers(1, 2047, 500).tolist()
    placed = pack.balanced(sizes, 2048, 1.0, 1 / 6144)
    rooms, costs = Counter(), Counter()
    for _, _, n, at in placed:
        rooms[at] += n
        costs[at] += n + n * n / 6144
    assert max(rooms.values()) <= 2048 and len(rooms) == math.ceil(sum(sizes) / 2048)
    assert max(costs.values()) < 1.3 * sum(costs.values()) / len(costs)


def test_special_token_text():
    encode = pack.Encoder(*pack.vocabulary())
    assert encode("a<|endoftext|>b").count(50256) == 1


def plain_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_signals(docs):
    for text in [*docs.text, "a b c a b c\n\nd\nd\n é#", "\x1cx \x85 y", ""]:
        assert quality.measure(text)[:5] == plain_quality(text)


def test_certified_cutoffs(spark):
    assert quality.tail(0, 100, 0.05) == pytest.approx(0.95**100) and quality.tail(100, 100, 0.5) == 1.0
    exact = sum(math.comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(4))
    assert quality.tail(3, 50, 0.1) == pytest.approx(exact)
    out = queries.queries()["op6_risk_controlled_rules"](spark, f"{DATA}/sf0.1").toPandas()
    labels = pd.read_parquet(f"{DATA}/sf0.1/labels.parquet")
    both = out[~out.base_failed].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert 1 - good.kept.mean() < quality.ALPHA and bad.kept.mean() < 0.2


def test_language_of_held_out_documents(spark):
    out = queries.queries()["op7_word_first_language"](spark, f"{DATA}/sf0.01").toPandas()
    d = pd.read_parquet(f"{DATA}/sf0.01/documents.parquet")[["doc_id", "lang"]]
    both = out.merge(d, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98


def test_unseen_words_back_off():
    """The vectorised backoff against a loop over places and orders."""
    model = langid.Model(["a", "b"], ["known"], np.array([[-1.0, -2.0]]), ["ab", "abc", " x", "c "], np.array([[-1, -5], [-2, -4], [-3, -3], [-4, -2], [-9, -9]], float))
    table = dict(zip(model.grams, model.gram_scores, strict=False))
    for word in ("abc", "x", "zabcz", "ab"):
        w, total = f" {word} ", np.zeros(2)
        for at in range(len(w) - 1):
            total += next((table[w[at : at + n]] for n in langid.ORDERS if w[at : at + n] in table and at + n <= len(w)), model.gram_scores[-1])
        assert model.unseen([word, "y"])[0] == pytest.approx(langid.GRAM_WEIGHT * total / (len(w) - 1))


def test_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B</h1><p>First   <b>bold</b> paragraph<p>Second &lt;one&gt;<div class="share">Share</div><section class="comments"><p>Nice!</p></section></article><aside>More</aside><form>Search<input></form><footer>(c)</footer></body></html>"""
    assert html_main.main_text(page) == "A & B\nFirst bold paragraph\nSecond <one>"
    plain = "<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div>" + "".join(f"<p>A paragraph with quite a few words in it, number {k}, to read.</p>" for k in range(6)) + "</div><div><a href=3>Back</a> <a href=4>Next</a></div></body>"
    assert html_main.main_text(plain).count("\n") == 5 and "Back" not in html_main.main_text(plain)


def test_preference_pairs(spark):
    turns = [(1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "why")]
    r = chat.pairs(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")).first()
    assert r.prompt_turns == 1 and r.prompt == "<|user|>\nq<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["yes<|end|>"] and [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["no<|end|>"]


def test_pipeline(spark):
    """Each stage keeps clean documents, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base, seen = docs.toPandas().set_index("doc_id"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, SF)
        docs = spark.createDataFrame(docs.toPandas(), before.schema)
        seen[name] = (before.toPandas(), docs.toPandas())
    assert set(seen["language"][1].doc_id) == {i for i, t in base.text.items() if any(c.isalpha() for c in t)}
    rows = seen["near_duplicates"]
    found = near_dup.digest(near_dup.component_table(spark.createDataFrame(rows[0]))).filter("kept").toPandas()
    assert set(found.doc_id) == set(rows[1].doc_id) and len(rows[1]) > 0
    rows = seen["benchmark_free"]
    bad = {r.doc_id for r in decontaminate.overlaps(spark.createDataFrame(rows[0]), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(rows[1].doc_id) == set(rows[0].doc_id) - bad
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == set(rows[1].doc_id)
    assert out.sequence_id.nunique() * 2048 - out.length.sum() < 2048
