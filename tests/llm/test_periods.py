"""Periodic runs against every stretch of every period, and the query's contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gristmill.llm import periods
from tests.llm.conftest import EDGES

EMPTY = hashlib.sha256(b"").hexdigest()


def brute(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, 2 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def runs(w, least=12):
    return [tuple(r) for r in periods.runs(np.array(w, np.int32), least).tolist()]


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, letters = rng.randrange(0, 150), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randint(1, letters) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, n // 3)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 3, 7, 12, 20])
        assert runs(w, least) == brute(w, least), (w, least)


def test_runs_of_fibonacci_words_and_of_one_word():
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    assert runs(b, 4) == brute(b, 4) and len(runs(b, 4)) > 100
    assert runs([1] * 5000) == [(0, 5000, 1)] and runs([1] * 11) == [] and runs([]) == []


def test_texts_beyond_the_kept_grid(monkeypatch):
    rng = np.random.default_rng(5)
    w = rng.integers(1, 400, 3000)
    w[700:2500] = np.tile(w[700:1000], 6)
    w[2600:2640] = 7
    right = runs(w)
    monkeypatch.setattr(periods, "KEPT", 256)
    monkeypatch.setattr(periods, "SLICE", 640)
    periods._kept.cache_clear()
    assert runs(w) == right and (700, 1800, 300) in {(s, m, q) for s, m, q in right} and any(q == 1 for *_, q in right)
    monkeypatch.undo()
    periods._kept.cache_clear()


def test_every_difference_meets_the_cover():
    shift = periods._shifts()
    for i in range(40):
        for j in range(i, 40):
            s = int(shift[i % 13, (j - i) % 13])
            assert periods.DIRECT <= s < periods.DIRECT + 13 and {(i + s) % 13, (j + s) % 13} <= set(periods.COVER)


def test_extensions_equal_naive():
    rng = random.Random(9)
    w = [rng.randint(1, 2) for _ in range(80)] * 3
    one = periods.Extensions(np.array(w, np.int32))
    pairs = [(a, b) for a in range(len(w)) for b in range(a + 1, len(w))]
    got = one.of(*(np.array(x, np.int32) for x in zip(*pairs)))
    for (a, b), n in zip(pairs, got.tolist()):
        assert n == next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b)


def contract(doc, text, plant=True):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    if plant and doc is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_contract(documents):
    rng = random.Random(3)
    rows = EDGES + [(k, " ".join(rng.choice(["a", "be", "sea", "D", "é"]) for _ in range(rng.randrange(0, 120)))) for k in range(20, 140)]
    rows += [(200, "x y z\n" * 9), (201, "\tone\x0btwo " * 7 + "\x1ctail"), (202, "a b " * 20), (-5, "no end " * 30)]
    got = periods.collapsed(documents(rows), plant=True).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted((contract(*r) for r in rows), key=key)


def test_texts_are_collapsed_and_others_stay_as_they_are(documents):
    got = {r["doc_id"]: r for r in periods.collapsed(documents([(1, "so it goes\n" * 5), (2, "nothing  here\n"), (3, None)])).collect()}
    assert (got[1]["text"], got[1]["n_dropped"], got[1]["n_words"]) == ("so it goes", 12, 15)
    assert (got[2]["text"], got[2]["n_dropped"]) == ("nothing  here\n", 0)
    assert got[3]["n_runs"] == 0 and got[3]["start"] is None and got[3]["runs_sha256"] == got[3]["collapsed_sha256"] == EMPTY
    assert periods.collapsed(documents([])).count() == 0
