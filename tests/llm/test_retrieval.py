"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gristmill.llm import retrieval
from tests.llm.conftest import EDGES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, top=10):
    split = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, some in wanted.items():
        rows = []
        for d, c in split:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in some if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(i, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "item_id long, text string, rank int, term string")


def same(spark, documents, items, docs, **options):
    got = sorted(map(tuple, retrieval.search(table(spark, items), documents(docs), **options).collect()), key=repr)
    assert got == brute(items, docs, options.get("top", 10))
    return got


def corpus(seed, n=400, words=60):
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    docs = [(k, " ".join(rng.choices(common, weights, k=rng.choice([1, 3, 3, 8, 40, 200])))) for k in range(n)]
    items = [(k, " ".join(rng.choices(common, k=rng.choice([1, 4, 12])))) for k in range(25)]
    return items, docs


@pytest.mark.parametrize("seed,size", [(1, 4096), (2, 37)])
def test_equals_brute_force(spark, documents, monkeypatch, seed, size):
    monkeypatch.setattr(retrieval, "SEGMENT", size)
    items, docs = corpus(seed)
    assert len(same(spark, documents, items, docs)) > 200


def test_ties_repeats_and_odd_rows(spark, documents):
    docs = [(k, "same words here") for k in range(40, 10, -1)] + [(20, "same words here"), (None, "same words here"), (None, "same words")] + EDGES
    docs += [(900, "Ünï ÜNÏ ünï"), (901, "l33t_C0de,l33t"), (902, "x" * 70_000), (903, "KK İ ﻿")]
    items = [(1, "same Words"), (1, "here"), (2, None), (3, ""), (4, "absent terms"), (None, "words"), (5, "ÜNÏ"), (6, "L33T c0de"), (7, "x" * 70_000), (8, "k K"), (9, "lost words HERE one")]
    same(spark, documents, items, docs)
    same(spark, documents, items, docs, top=3)


def test_items_in_blocks(spark, documents):
    items, docs = corpus(5, 60, 30)
    same(spark, documents, items + [(99, " ".join(f"w{k}" for k in range(30)))], docs, block_terms=20)


def test_more_than_64_terms(spark, documents):
    rng = random.Random(8)
    docs = [(k, " ".join(f"t{j}" for j in rng.sample(range(150), rng.randrange(1, 100)))) for k in range(120)]
    same(spark, documents, [(1, " ".join(f"T{j}" for j in range(150))), (2, "t1 t2 t77")], docs)


def test_empty_tables(spark, documents):
    items, docs = corpus(6, 20)
    assert retrieval.search(table(spark, []), documents(docs)).count() == 0
    assert retrieval.search(table(spark, items), documents([])).count() == 0
    assert retrieval.search(table(spark, items), documents([(1, "..."), (2, None)])).count() == 0


def test_finishes_before_all_documents_are_scored():
    rng = np.random.default_rng(2)
    n, vocabulary = 4000, {b"rare": 1, b"usual": 2}
    items = retrieval.Items([1], vocabulary, [np.array([1, 2])])
    rare = np.flatnonzero(rng.random(n) < 0.01)
    segment = {"doc_id": np.arange(n), "no_id": np.zeros(n, bool), "n": np.full(n, 10), "term": np.array([1, 2]), "held": np.array([len(rare), n]), "place": np.concatenate([rare, np.arange(n)]), "tf": np.ones(len(rare) + n, int)}
    best = [retrieval.Best(10)]
    scored = retrieval.rank_segment(retrieval.Weighted(items, np.array([0, 5000, 40]), n, 10 * n), segment, best)
    assert scored == len(rare) and [d for *_, d in best[0].rows] == rare[:10].tolist()
