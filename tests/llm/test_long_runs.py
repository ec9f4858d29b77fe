"""Language of texts without spaces, and of very many languages."""

import numpy as np
import pytest

from vellum.llm import langid


def run_of(rng, letters, n=120):
    return "".join(rng.choice(list(letters), n))


def test_whole_runs_are_scored(monkeypatch):
    model = langid.Model(["a", "b"], [], np.zeros((0, 2)), ["x", "y"], np.array([[-1.0, -2.0], [-3.0, -1.0], [-9.0, -9.0]]))
    runs = ["x" * 40 + "y" * 400, "y", "x" * 70]
    want = model.unseen(runs)
    assert want[0] == pytest.approx(langid.GRAM_WEIGHT * np.array([-40 - 1200 - 9, -80 - 400 - 9]) / 441)
    assert model.predict(runs[0])[0] == "b"
    for places in (1, 7, 64):
        monkeypatch.setattr(langid, "PLACES", places)
        assert model.unseen(runs) == pytest.approx(want, rel=1e-5)


def test_long_runs_are_learned(spark):
    rng = np.random.default_rng(12)
    rows = [(k, run_of(rng, letters), lang) for k in range(240) for lang, letters in [[("p", "abcde"), ("q", "vwxyz"), ("r", "klmno")][min(k % 5, 4) // 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert all(out[k] == lang for k, _, lang in rows)


def test_eighty_languages_are_learned(spark):
    """The smallest have the fewest rows, and keep words of their own; words of over 40 letters are words."""
    rng = np.random.default_rng(13)
    words = {f"l{k:02}": [run_of(rng, "abcdefghij", 45 if k % 2 else 6) for _ in range(30)] for k in range(80)}
    langs = [lang for k, lang in enumerate(words) for _ in range(80 - k // 2)]
    rows = [(n, " ".join(rng.choice(words[lang], 12)), lang) for n, lang in enumerate(langs)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(out[n] == lang for n, _, lang in rows) >= 0.99 * len(rows)


def test_predictions_equal_a_plain_predictor(spark):
    """Word by word, n-gram by n-gram, in plain loops over the same tables."""
    rng = np.random.default_rng(14)
    words = {"a": ["alpha", "beta", "gamma", "delta"], "b": ["alpha", "rho", "sigma", "tau"], "c": ["pi", "chi", "psi", "beta"]}
    rows = [(n, " ".join(rng.choice(words[lang], 8)), lang) for n in range(300) for lang in ["abc"[n % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    word = dict(zip(model.words, model.scores, strict=False))
    gram = dict(zip(model.grams, model.gram_scores, strict=False))
    tests = [(1, "alpha beta beta"), (2, "Sigmas and TAU"), (3, "zzz"), (4, "psi chiral"), (5, " ".join(["rho"] * 50 + ["beta"] * 40)), (6, None), (7, "12 ---")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(*t, None) for t in tests], "doc_id long, text string, lang string"), model).collect()}
    for k, text in tests:
        found = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
        if not found:
            assert got[k] == ("und", 0.0)
            continue
        total = np.zeros(3)
        for w in found:
            if w in word:
                total += word[w]
                continue
            padded, places = f" {w} ", np.zeros(3)
            for at in range(len(padded) - 1):
                places += next((gram[padded[at : at + n]] for n in (5, 4, 3, 2, 1) if at + n <= len(padded) and padded[at : at + n] in gram), model.gram_scores[-1])
            total += langid.GRAM_WEIGHT * places / (len(w) + 1)
        total *= min(1, 30 / len(found))
        p = np.exp(total - total.max())
        assert got[k][0] == model.langs[int(p.argmax())] and got[k][1] == pytest.approx(p.max() / p.sum(), rel=1e-4)
