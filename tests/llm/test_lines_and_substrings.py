import hashlib
import random
import re

import numpy as np
import pytest

from gristmill.llm import lines, substrings
from tests.llm.conftest import EDGES


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_lines(rows, least=10):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(lower)
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if i is None or len(h := holders.get(key(x), ())) < 2 or min(h) == i]
        out.append((i, len(parts), len(parts) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


def test_lines(documents):
    rng = random.Random(3)
    pool = ["A Common Line here", "  a common line HERE\r", "short", "ÄÖÜ äöü ß line", "İstanbul lines 12", "unique %d", "", "\x0bpadded line ok\x0c", "1234567890", "123456789"]
    rows = [(i, "\n".join(p % i if "%d" in p else p for p in rng.choices(pool, k=rng.randint(0, 6)))) for i in range(60)] + EDGES
    for most_bits in (lines.MOST_BITS, 1 << 6):
        got = lines.drop_repeated_lines(documents(rows), most_bits=most_bits)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == brute_lines(rows)


@pytest.mark.parametrize("n", [20, 2000])
def test_filters_grow_with_the_keys(documents, n):
    """Less than half of a filter is set at any size, and few single lines are suspects; beyond most_bits there is no filter."""
    rows = [(i, f"line number {i} alone\nthe line that all have\n  LINE number {i // 2 * 2} of two") for i in range(n)]
    docs = documents(rows).repartition(3)
    keys = lines.count_keys(docs)
    assert abs(keys - (n + n // 2 + 1)) < 0.2 * keys
    bits = lines.filter_bits(keys)
    assert 8 * keys <= bits <= max(16 * keys, 1 << 12)
    twice = np.unpackbits(lines.repeat_filter(docs, bits, together=100))
    repeats = lines.PROBES * (n // 2 + 1)
    assert 0.9 * repeats < twice.sum() < 1.25 * repeats + 40
    assert lines.filter_bits(int(0.4 * (1 << 20)), 1 << 20) is None and lines.filter_bits(int(0.3 * (1 << 20)), 1 << 20) == 1 << 20
    for most_bits in (lines.MOST_BITS, 1 << 8):
        got = lines.drop_repeated_lines(docs, most_bits=most_bits)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == brute_lines(rows)


def brute_windows(rows, window):
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def test_substrings(documents):
    rng = random.Random(4)
    for window in (2, 3, 10, 50):
        passage = [f"p{k}" for k in range(window + 7)]
        rows = []
        for i in range(40):
            w = [rng.choice("abc") if i % 4 == 0 else f"w{i}_{k}" for k in range(rng.randint(0, 2 * window))]
            if i % 3 == 0:
                cut = rng.randint(0, 9)
                at = rng.randint(0, len(w))
                w[at:at] = passage[cut:] if i % 2 else passage[: len(passage) - cut]
            rows.append((i, rng.choice([" ", "\n", "\x0c ", "  "]).join(w)))
        rows += [(100, rows[0][1]), (101, rows[3][1])] + EDGES
        got = substrings.drop_repeated_substrings(documents(rows), window)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_windows(rows, window)


@pytest.mark.parametrize("window", [4, 7, 12])
def test_substrings_of_few_words(documents, window):
    """Few different words, so that short windows repeat where longer ones don't, also inside one document."""
    rng = random.Random(window)
    rows = []
    for i in range(120):
        w = [rng.choice("abcd") for _ in range(rng.randint(0, 4 * window))]
        if i % 2 and rows:
            part = rng.choice(rows)[1].split()
            cut = rng.randint(0, len(part))
            w[rng.randint(0, len(w)) :] = part[cut : cut + rng.randint(0, 2 * window)]
        rows.append((i, " ".join(w)))
    got = substrings.drop_repeated_substrings(documents(rows), window)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_windows(rows, window)


def test_levels_double_and_end_early(documents, monkeypatch):
    assert substrings.lengths(50) == [13, 25, 50] and substrings.lengths(2) == [1, 2] and substrings.lengths(1) == [1]
    seen, plain = [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, name: seen.append(name) or plain(df, name))
    substrings.drop_repeated_substrings(documents([(i, " ".join(f"w{i}_{k}" for k in range(80))) for i in range(5)]))
    assert [x for x in seen if x.startswith("level")] == ["level_0"]


def test_empty(documents):
    empty = documents([(1, "x")]).where("doc_id < 0")
    assert lines.drop_repeated_lines(empty).count() == 0
    assert substrings.drop_repeated_substrings(empty).count() == 0
