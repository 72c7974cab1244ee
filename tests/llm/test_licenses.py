import random
import re

import pytest

from gristmill.llm import licenses
from tests.llm.conftest import EDGES

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def brute(text):
    """What one text alone gives: phrases by comparing words, notices by every diagonal."""
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(licenses.WORD, lower)
    starts, base, labels, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    for notice, label in licenses.NOTICES:
        p = notice.split()
        diagonals = {}
        for i in range(len(w) - 1):
            for k in range(len(p) - 1):
                if w[i : i + 2] == p[k : k + 2]:
                    diagonals.setdefault(i - k, set()).add(k)
        chain, last, spans = None, None, {}
        for d in sorted(d for d, met in diagonals.items() if len(met) >= 2):
            if last is None or d - last > licenses.SHIFT:
                chain = d
            last = d
            spans.setdefault((chain, (d - chain) // ((licenses.STRETCH - 1) * len(p))), set()).update(diagonals[d])
        for met in spans.values():
            cover = len(met) / (len(p) - 1)
            best = max(best, cover)
            labels |= {label} if cover >= licenses.COVER else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if starts else best


def test_every_row_for_itself(documents):
    rng = random.Random(9)
    pieces = [p for p, _ in licenses.PHRASES] + [n for n, _ in licenses.NOTICES] + ["of the", "the of the of", "Gnu General", "public license", "K mit license", "apache-LICENSE", "é cc by é", "gnu general public"]
    rows = []
    for _ in range(150):
        w = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))).split(" ")
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [rng.choice(["kind", "THE", "x"])]
        rows.append((rng.choice([None, 7, 7, 8, 9]), rng.choice([" ", "\n", ", "]).join(w)))
    rows += [(7, "gnu general"), (7, "zz general public license"), (None, "plain words"), (None, "apache license")] + EDGES
    got = sorted((tuple(r) for r in licenses.scan(documents(rows)).select(COLUMNS).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_template_length():
    with pytest.raises(ValueError):
        licenses.places(notices=[(" ".join("w" * 66), "long")])
    assert len(licenses.places((), [(" ".join("w" * 65), "fits")])) == 64
