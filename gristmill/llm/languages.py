"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram of letters is bound: the vector of each letter is permuted (rotated) by its
distance from the end of the n-gram, and the vectors are multiplied. A text is bundled: the sum of the vectors of all its n-grams (trigrams,
or of several ``sizes``), which is as long as one vector whatever the text. The prototype of a language is the sum of all its texts' vectors.
The prediction is the language whose prototype has the largest cosine with the text's vector, of equal ones the
one whose name comes first.

Vectors of n-grams are made once for all texts of a slice (about half a megabyte) and bundled by a product of matrices: counts by text times
vectors by n-gram, in blocks of n-grams. Learning adds up the counts of all texts of a language first, so it doesn't make a vector for each text. All
labelled texts outside the held-out fold are learnt from; a task hands on one vector for each language it met, and these are
summed by language and coordinate, before and after the shuffle. The prototypes (``most_languages`` at most, else ValueError) are broadcast.

Text: lower case; every stretch of other characters than letters is one blank, with a blank before and after the whole; a letter
is what Unicode calls one. An n-gram may hold a blank inside or at its ends.

score: the cosine with the language that is predicted, cut at 0 and 1.

Defined cases: ``und`` and score 0 for a null text, one without letters, and all texts where no language is learnt; rows without a lang
are not learnt from, but predicted; a null doc_id is not held out; rows that repeat a doc_id are each learnt from and predicted; columns
other than doc_id, text and lang are never read, and lang only in learning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import noise

#: Folds by crc32 of the doc_id and the one held out; the name of no language.
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
#: Coordinates of a vector, lengths of n-grams, characters and texts in a slice at most, n-grams of a block.
WIDTH, SIZES, TOGETHER, AT_ONCE, BLOCK = 1024, (3,), 1 << 19, 1 << 10, 1 << 12


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def held_out(ids: list[int | None]) -> list[bool]:
    return [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids]


def spelled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(letters' code points with 0 for a blank, text of each): each text begins and ends with one blank, or is one blank."""
    parts = [f" {t.lower()} " if t else "  " for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    letter = _letters()[code]
    stays = letter.copy()
    stays[1:] |= letter[:-1]  # the first blank after a letter
    stays[np.flatnonzero(np.diff(owner, prepend=-1))] = True
    return np.where(letter, code, 0)[stays], owner[stays]


def grams(letters: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct letters, index of each letter of each n-gram: n-grams x size, text of each): no n-gram reaches over two blanks in a row."""
    blank = letters == 0
    n = max(0, len(letters) - size + 1)
    fine = np.ones(n, bool)
    for k in range(size - 1):
        fine &= ~(blank[k : k + n] & blank[k + 1 : k + 1 + n])
    present = np.zeros(0x110000, bool)
    present[letters] = True
    known = np.flatnonzero(present)
    place = np.zeros(0x110000, np.int32)
    place[known] = np.arange(len(known))
    small = place[letters]
    return known, np.stack([small[k : k + n][fine] for k in range(size)], 1), owner[:n][fine]


def _tally(values: np.ndarray, top: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, how often each); values are below top."""
    if top <= most:
        counts = np.bincount(values, minlength=1)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(values, return_counts=True)


class Space:
    """The vectors of letters and n-grams of one seed and width."""

    def __init__(self, width: int = WIDTH, sizes: tuple[int, ...] = SIZES, seed: int = 12):
        self.width, self.sizes, self.seed = width, sizes, seed
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) > 1 << 14:
                self.known.clear()
            bits = noise(-(-self.width // 64), (self.seed << 24) + code).view(np.uint8)
            self.known[code] = np.unpackbits(bits)[: self.width].astype(np.int8) * 2 - 1
        return self.known[code]

    def bundled(self, texts: list[str | None], group: np.ndarray | None = None, groups: int | None = None) -> np.ndarray:
        """The sum of n-gram vectors of each text, or of the texts of each group."""
        letters, owner = spelled(texts)
        groups = len(texts) if group is None else groups
        out = np.zeros((groups, self.width))
        for size in self.sizes:
            known, at, whose = grams(letters, owner, size)
            if not len(at):
                continue
            whose = whose if group is None else group[whose]
            vectors = np.stack([self.letter(int(c)) for c in known])
            turned = [np.roll(vectors, size - 1 - k, axis=1) for k in range(size)]
            code, base = at[:, 0].astype(np.int64), len(known)
            if base**size < 1 << 62:
                for k in range(1, size):
                    code = code * base + at[:, k]
            else:
                code = np.unique(at, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int64)
            some, first, number = self._distinct(code, base**size)
            spelling = at[first]
            pairs, counts = _tally(number * groups + whose, len(some) * groups)
            for lo in range(0, len(some), BLOCK):
                hi = min(len(some), lo + BLOCK)
                a, b = np.searchsorted(pairs, [lo * groups, hi * groups])
                table = np.zeros((hi - lo) * groups, np.float32)
                table[pairs[a:b] - lo * groups] = counts[a:b]
                bound = turned[0][spelling[lo:hi, 0]]
                for k in range(1, size):
                    bound = bound * turned[k][spelling[lo:hi, k]]
                out += table.reshape(hi - lo, groups).T @ bound.astype(np.float32)
        return out

    @staticmethod
    def _distinct(code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct codes, where each stands, number of each code's value)."""
        if top > 1 << 22:
            return np.unique(code, return_index=True, return_inverse=True)
        first = np.full(top, -1, np.int64)
        first[code] = np.arange(len(code))
        some = np.flatnonzero(first >= 0)
        number = np.zeros(top, np.int64)
        number[some] = np.arange(len(some))
        return some, first[some], number[code]


@dataclass
class Prototypes:
    """Languages in the order of their names, and their unit vectors."""

    names: list[str]
    vectors: np.ndarray
    width: int = WIDTH
    sizes: tuple[int, ...] = SIZES
    space: Space | None = field(default=None, repr=False, compare=False)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        if not self.names or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        self.space = self.space or Space(self.width, self.sizes)
        x = self.space.bundled(texts)
        norm = np.sqrt((x * x).sum(1))
        cosine = x @ self.vectors.T / np.where(norm > 0, norm, 1)[:, None]
        best = cosine.argmax(1)
        spoken = [norm[k] > 0 or any(map(str.isalpha, t or "")) for k, t in enumerate(texts)]
        names = [self.names[k] if s else UNKNOWN for k, s in zip(best.tolist(), spoken)]
        return names, np.where(spoken, cosine[np.arange(len(texts)), best], 0).clip(0, 1)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of at most AT_ONCE texts of about TOGETHER characters, or one text."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and (size + len(t or "") > TOGETHER or k - lo == AT_ONCE):
            yield lo, k
            lo, size = k, 0
        size += len(t or "") + 2
    if lo < len(texts):
        yield lo, len(texts)


def learn(docs: DataFrame, width: int = WIDTH, sizes: tuple[int, ...] = SIZES, most_languages: int = 4096) -> Prototypes:
    """Prototypes from every row with a lang that isn't held out."""

    def add(batches):
        space, sums = Space(width, sizes), {}
        for batch in batches:
            ids, texts, langs = (batch.column(k).to_pylist() for k in range(3))
            at = [k for k, (held, text, lang) in enumerate(zip(held_out(ids), texts, langs)) if not held and text and lang is not None]
            texts = [texts[k] for k in at]
            for lo, hi in _slices(texts):
                names = sorted({langs[at[k]] for k in range(lo, hi)})
                group = np.array([names.index(langs[at[k]]) for k in range(lo, hi)])
                for name, x in zip(names, space.bundled(texts[lo:hi], group, len(names))):
                    sums[name] = sums.get(name, 0) + x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.astype(np.int64) for x in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    each = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    parts = each.mapInArrow(add, "lang string, v array<long>").select("lang", F.posexplode("v").alias("k", "x"))
    rows = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).limit(most_languages + 1).collect()  # a bounded number of languages
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rows = sorted((r["lang"], np.array([x["x"] for x in r["v"]], float)) for r in rows if any(x["x"] for x in r["v"]))
    vectors = np.stack([v / np.sqrt((v * v).sum()) for _, v in rows]) if rows else np.zeros((0, width))
    return Prototypes([name for name, _ in rows], vectors, width, sizes)


def predicted(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)  # languages x width numbers

    def run(batches):
        known = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            names, scores = [], [np.zeros(0)]
            for lo, hi in _slices(texts):
                some, score = known.predict(texts[lo:hi])
                names += some
                scores.append(score)
            yield pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist()), pa.bool_()), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
