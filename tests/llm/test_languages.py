"""Hyperdimensional profiles against vectors bound letter by letter, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np

from gristmill.llm import languages as L
from tests.llm.conftest import EDGES
from tests.test_oracle import SF

SPOKEN = {
    "en": "the quick brown fox jumps over the lazy dog and then the other one thinks that this is what they wanted",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann denkt der andere dass sie es nicht wollten",
    "fi": "nopea ruskea kettu hyppää laiskan koiran yli ja sitten toinen ajattelee että tätä he halusivatkin aina",
}


def slow(space, text, size):
    """Bound and bundled one letter at a time."""
    letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    spelled = [c for k, c in enumerate(letters) if c != " " or k == 0 or letters[k - 1] != " "]
    out = np.zeros(space.width)
    for k in range(len(spelled) - size + 1):
        v = np.ones(space.width)
        for j, c in enumerate(spelled[k : k + size]):
            v = v * np.roll(space.letter(0 if c == " " else ord(c)), size - 1 - j)
        out += v
    return out


def test_bundles_equal_slow_ones():
    texts = ["Hello, World!", "", None, "a", "  ...  ", "Grüße aus 東京 123 – naïve Ὀδυσσεύς", "x\ny", "İstanbul ǅ", "end."]
    for sizes in ((1,), (2, 3), (4,)):
        space = L.Space(256, sizes)
        got = space.bundled(texts)
        for text, row in zip(texts, got):
            if text and any(map(str.isalpha, text)):
                assert (row == sum(slow(space, text, s) for s in sizes)).all()
            elif max(sizes) > 2:
                assert not row.any()
    group = np.array([0, 1, 1, 0, 0, 1, 0, 1, 1])
    both = L.Space(256, (3,))
    each = both.bundled(texts)
    assert (both.bundled(texts, group, 2) == np.stack([each[group == k].sum(0) for k in range(2)])).all()


def test_many_letters_and_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x5A00, 900))) for _ in range(3)] + ["plain words"]
    right = L.Space(128).bundled(texts)
    monkeypatch.setattr(L, "BLOCK", 100)
    assert (L.Space(128).bundled(texts) == right).all() and (right[3] == slow(L.Space(128), texts[3], 3)).all()


def test_slices_are_whole_and_bounded(monkeypatch):
    monkeypatch.setattr(L, "TOGETHER", 10)
    monkeypatch.setattr(L, "AT_ONCE", 3)
    texts = ["12345", None, "1", "", "", "", "x" * 40, "y"]
    cuts = list(L._slices(texts))
    assert [k for lo, hi in cuts for k in range(lo, hi)] == list(range(len(texts))) and all(hi - lo <= 3 for lo, hi in cuts)
    assert list(L._slices([])) == []


def rows(spark, more=()):
    made = [(k * 3 + n, t[k % 20 :] + f" {k}", lang) for n, (lang, t) in enumerate(SPOKEN.items()) for k in range(30)]
    return spark.createDataFrame([(*r, "s") for r in [*made, *more]], "doc_id long, text string, lang string, x string")


def test_learns_only_from_the_other_folds(spark):
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 == 2)
    more = [(held, "zzz qqq xxx", "held"), (5000, None, "silent"), (5001, "123 ...", "silent"), (5002, "zzz qqq", None)]
    made = L.learn(rows(spark, more))
    assert made.names == ["de", "en", "fi"]
    docs = rows(spark, more)
    got = {r["doc_id"]: r for r in L.predicted(docs, made).collect()}
    assert got[held]["held_out"] and not got[5002]["held_out"] and got[5002]["lang_pred"] in SPOKEN
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert [got[i]["lang_pred"] for i in (5000, 5001)] == ["und", "und"] and got[5000]["score"] == 0


def test_same_prototypes_whatever_the_partitions(spark):
    one, two = L.learn(rows(spark).repartition(1)), L.learn(rows(spark).repartition(7))
    assert one.names == two.names and (one.vectors == two.vectors).all()


def test_edges_and_empty_tables(spark, documents):
    made = L.learn(rows(spark))
    got = L.predicted(documents(EDGES), made).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in EDGES)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3) or r["doc_id"] is None and r["score"] == 0) for r in got)
    nothing = L.learn(rows(spark).limit(0))
    assert {(r["lang_pred"], r["score"]) for r in L.predicted(documents(EDGES), nothing).collect()} == {("und", 0.0)}
    assert L.predicted(documents([]), made).count() == 0


def test_held_out_accuracy(spark):
    from gristmill.llm import queries

    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    got = queries.op12_language(spark, SF.replace("0.001", "0.01")).join(docs, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
