import random
import re
import zlib

import numpy as np
import pytest

from gristmill.llm import quality, toxicity
from tests.llm.conftest import EDGES


def corpus(rng, n=600):
    rows, labels = [], []
    for i in range(100, 100 + n):
        w = [rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) for _ in range(rng.randint(5, 60))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["jerkface", "dumbo"]))
        text = " ".join(x + "%%" if bad else x for x in w)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, documents):
    rows, labels = corpus(random.Random(8))
    docs = documents(rows + EDGES)
    marks = spark.createDataFrame(labels + [(100, 1, 0), (None, 1, 1), (5_000_000, 0, 1), (101, None, None)], "doc_id long, quality int, toxic int")
    for module, label, limit in ((toxicity, 2, 0.5), (quality, 1, 0.3)):
        got = module.scored(docs, module.learn(docs, marks), limit).collect()
        assert len(got) == len(rows) + len(EDGES)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit) for r in got)
        truth = {x[0]: x[label] for x in labels}
        held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
        assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_no_labels(spark, documents):
    docs = documents(EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.learn(docs, none)).count() == len(EDGES)
    assert {r["score"] for r in quality.scored(docs, quality.learn(docs, none)).collect()} == {0.5}
    assert quality.scored(docs.where("doc_id < 0"), quality.learn(docs, none)).count() == 0


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "trash": 3.0, "tras": 1.0})
    for text in ("an IDIOT", "1d1ot", "іdіоt", "ídïot", "idiots"):
        assert lexicon.mass(toxicity.fold(text)) == 2.0, text
    assert lexicon.mass("trash") == 3.0
    assert lexicon.mass("put it in the trash can") == 0.0
    assert lexicon.mass("xidiot") == 0.0
    assert lexicon.score(None) == lexicon.score("")
    assert toxicity.Lexicon({}, ()).score("idiot") == toxicity.Lexicon({}, ()).score("")


def test_dual_descent_separates():
    r = np.ones(6)
    rows = [np.array([0, 1]), np.array([1, 2]), np.array([3, 4]), np.array([4, 5])]
    w, b = quality.dual_descent(rows, np.array([1.0, 1.0, -1.0, -1.0]), r, cost=10.0)
    margins = [w[x].sum() / np.sqrt(2) + b for x in rows]
    assert margins[0] > 0.9 and margins[1] > 0.9 and margins[2] < -0.9 and margins[3] < -0.9


def test_each_disguised_word_folds_by_itself():
    lexicon = toxicity.Lexicon({"stupid": 2.0, "asshole": 3.0, "ass": 1.0, "idiot": 4.0})
    for text, mass in (("$tupid", 2.0), ("you @sshole", 3.0), ("an a$$", 1.0), ("what, $tupid", 2.0), ("!diot", 4.0), ("!stupid", 2.0), ("|stupid|", 2.0), ("$tupid!!", 2.0), ("it costs $5 or 5 |", 0.0)):
        assert lexicon.mass(toxicity.fold(text)) == mass, text
        assert lexicon.mass(toxicity.fold(text + " n1ce")) == mass, text
    assert toxicity.fold("stupid! wow!!") == "stupid! wow!!"


def test_rare_and_short_insults_enter(spark, documents):
    rng = random.Random(6)
    plain = lambda n: [rng.choice(["lorem", "ipsum", "dolor", "amet", "sit", "assist"]) for _ in range(n)]
    rare = [f"{a}{b}word" for a in "bcdfghjk" for b in "aeiouy"]
    rows, toxic = [], {}
    for i in range(100, 4100):
        w = plain(30)
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice([*rare, "ass", "ho"])
        rows.append((i, " ".join(w)))
        toxic[i] = int(i % 4 == 0)
    docs = documents(rows)
    marks = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks)
    assert {"ass", "ho"} <= set(lexicon.weights)
    assert lexicon.mass("assist sit") == 0 < lexicon.mass("an ass!")
    held = [r for r in toxicity.scored(docs, lexicon).collect() if r["held_out"]]
    assert np.mean([r["predicted"] for r in held if toxic[r["doc_id"]]]) > 0.9
    assert np.mean([r["predicted"] for r in held if not toxic[r["doc_id"]]]) < 0.05


def naive_mass(weights, phrases, text, short=4):
    """Word by word: the longest entry that begins it, unless an exception phrase covers that entry."""
    total = 0.0
    for m in re.finditer(r"[^\W_]+", text):
        fits = [e for e in weights if m.group().startswith(e) and (len(e) >= short or e == m.group())]
        if fits:
            e = max(fits, key=len)
            lo, hi = m.start(), m.start() + len(e)
            covered = any(p.start() <= lo and hi <= p.end() for x in phrases for p in re.finditer(rf"(?<![^\W_])(?={re.escape(x)}(?![^\W_]))", text) for p in [re.compile(re.escape(x)).match(text, p.start())])
            total += 0.0 if covered else weights[e]
    return total


def test_matcher_against_a_naive_one():
    rng = random.Random(12)
    words = ["abc", "abcd", "abcde", "abcdefghi", "abcdefghijk", "xy", "xyz", "bcd", "trash", "can", "cans", "bin", "q"]
    weights = {"abcd": 1.0, "abcdefghi": 2.0, "xy": 4.0, "trash": 8.0, "bin": 16.0}
    phrases = ("trash can", "can trash", "xy q", "bin xy", "xyz abcd")
    lexicon = toxicity.Lexicon(weights, phrases)
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "_", "-", ""]) for _ in range(rng.randint(0, 12)))
        assert lexicon.mass(text) == naive_mass(weights, phrases, text), text


@pytest.mark.parametrize("phrase", toxicity.EXCEPTIONS)
def test_given_exceptions(phrase):
    lexicon = toxicity.Lexicon({"trash": 3.0, "clown": 2.0, "idiot": 1.0})
    assert lexicon.mass(f"a {phrase}, here") == 0.0 < lexicon.mass(f"a {phrase.split()[-2]}, {phrase.split()[-1]}")


def test_exceptions_are_learnt(spark, documents):
    rng = random.Random(13)
    rows, marks = [], []
    for i in range(100, 2100):
        w = [rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(20)]
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(20)] = "rotten"
        elif i % 15 == 1:
            w[5:6] = ["rotten", "apple"]
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    lexicon = toxicity.learn(documents(rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert "rotten" in lexicon.weights and "rotten apple" in lexicon.exceptions and not any(p.endswith("lorem") for p in lexicon.exceptions)
    assert lexicon.mass("a rotten apple fell") == 0.0 < lexicon.mass("a rotten lorem")


def test_long_words_have_entries_of_their_own():
    assert toxicity.entries_of("assassinations", (4, 8)) == ("assa", "assas", "assass", "assassi", "assassin", "assassinations")
    assert toxicity.entries_of("ass", (4, 8)) == ("ass",) and toxicity.entries_of("a", (4, 8)) == ()


def test_large_ids_beside_null(spark, documents):
    rows = [(9007199254740993, "a b"), (None, "c"), (9007199254740995, "")]
    got = toxicity.scored(documents(rows), toxicity.Lexicon({"abcd": 1.0})).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}


def test_descent_reaches_the_optimum():
    """Weights against subgradient descent on the same loss: half the squared norm plus the hinge losses."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)) for _ in range(80)]
    y, r = rng.choice([-1.0, 1.0], 80), rng.normal(size=12)
    x = np.zeros((80, 13))
    for k, row in enumerate(rows):
        x[k, row] = r[row] / np.linalg.norm(r[row])
    x[:, 12] = 1.0
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    w, shift = quality.dual_descent(rows, y, r, passes=2000)
    best, v = np.inf, np.zeros(13)
    for k in range(40_000):
        v = v - (v - (x * y[:, None])[y * (x @ v) < 1].sum(0)) / (k + 10)
        best = min(best, loss(v))
    assert loss(np.append(w, shift)) <= best * 1.001


def test_features_bound_the_fit(spark, documents):
    rows, labels = corpus(random.Random(9), 300)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    few, all_ = (quality.learn(documents(rows), marks, fit_features=n) for n in (8000, 20_000_000))
    assert (few.ratio == all_.ratio).all() and not (few.weights == all_.weights).all()
