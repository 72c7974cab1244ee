import random

import numpy as np
import pytest

from gristmill.llm import neardup
from tests.llm.conftest import EDGES


def shingles(text, n=5):
    w = (text or "").split()
    out = {}
    for p in range(max(1, len(w) - n + 1) if w else 0):
        k = tuple(w[p : p + n])
        out[k] = out.get(k, 0) + 1
    return out


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**62, 300).astype(np.uint64)
    y = x.copy()
    y[:60] = rng.integers(0, 2**62, 60).astype(np.uint64)
    wx = rng.integers(1, 9, 300) * 0.7
    wy = wx.copy()
    wy[100:180] *= 2.3
    darts = neardup.Darts(2000)
    true = np.minimum(wx, wy)[60:].sum() / (wx.sum() + wy.sum() - np.minimum(wx, wy)[60:].sum())
    assert (darts.signature(x, wx) == darts.signature(y, wy)).mean() == pytest.approx(true, abs=0.04)
    assert neardup.Darts(50).signature(x[:0], wx[:0]).sum() == 0
    assert neardup.Darts(50).signature(x[:1], np.array([5000.0])).all()


def test_classes_match_brute_force(documents):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randint(40, 150))]
        for c in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((g * 10 + c, " ".join(w)))
    rows += [(900 + i, rows[0][1]) for i in range(20)] + [(950, "one two three"), (951, "one  two\nthree"), (952, "one two"), (960, ""), (961, ""), (962, "\n")] + EDGES
    got = {r["doc_id"]: r["cluster_id"] for r in neardup.near_duplicates(documents(rows)).collect()}
    texts = {i: t for i, t in rows if i is not None}
    docs = sorted((i, shingles(t)) for i, t in texts.items())
    label = {i: i for i, _ in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(docs):
        for j, b in docs[k + 1 :]:
            if texts[i] is not None and (texts[i] == texts[j] or a and b and jaccard(a, b) >= 0.8):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    assert got == {i: root(i) for i, _ in docs}


def test_empty(documents):
    assert neardup.near_duplicates(documents([(1, "x")]).where("doc_id < 0")).count() == 0


def test_a_document_has_the_texts_of_all_its_rows(documents):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    got = {r["doc_id"]: (r["cluster_id"], r["kept"]) for r in neardup.near_duplicates(documents([(1, a), (1, b), (2, a), (3, b + " more"), (4, "alone")])).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True)}
