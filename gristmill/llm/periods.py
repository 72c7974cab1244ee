"""Periodic runs of words: maximal repetitions of every text, and the text with all but their first period dropped.

A run is a stretch of words with smallest period q (words q apart are identical), at least max(``least``, 2 q) long, that no
neighbouring word extends. A stretch of period q and two periods or more holds two neighbouring points of the grid 0, q, 2q, ...,
so the runs come out of a harmonic grid: for every q and every pair of neighbouring points (n ln n pairs in all, the pairs (e - q, e) with
q dividing e) the longest common extension to the right of the two points and to the left of them
gives the whole stretch. A stretch found with several periods has the smallest of them, which divides the others.

**Longest common extensions.** A difference cover modulo 13 is {0, 1, 3, 9}: for any two places some shift of 6 to 18 words brings both
to residues of the cover. Only suffixes at those residues are sorted (ranks of 13 words, then of twice as many, until all differ); their common prefixes
with the next one in order are held in a sparse table. Two places are compared word by word up to their shift; those that still agree there have reached
synchronised samples, and one range minimum says how far they go on. The left side is the same on the reversed words. The table is built
only for texts in which some pair gets that far.

Every text is one row and is worked on alone, inside a scan: nothing is shuffled. Grid pairs are taken in bounded slices.
Memory of a text of n words is about that of its words and of 0.3 n log n numbers of four bytes.

Defined cases: a null or empty text has no word, no run (count 0, four nulls) and the digests of nothing; rows that repeat a doc_id or have none are each
worked on alone; of equally long runs the one with the smallest start, then period, is the longest; columns other than doc_id and text are
never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A difference cover and its modulus: every number modulo 13 is a difference of two of these residues; and the fewest words compared one by one.
COVER, MODULUS, DIRECT = (0, 1, 3, 9), 13, 6
#: Grid pairs of a slice, and the number of words up to which their list is kept.
SLICE, KEPT = 1 << 20, 1 << 16


@lru_cache(1)
def _shifts() -> np.ndarray:
    """(place modulo 13, distance modulo 13) -> least shift of DIRECT words or more that brings both ends to the cover."""
    out = np.zeros((MODULUS, MODULUS), np.int32)
    for i in range(MODULUS):
        for d in range(MODULUS):
            out[i, d] = next(s for s in range(DIRECT, DIRECT + MODULUS) if (i + s) % MODULUS in COVER and (i + d + s) % MODULUS in COVER)
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 1 in the order of their first occurrence."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words)) + np.int32(1)


class Extensions:
    """Longest common extensions to the right of pairs of places of one sequence of numbers from 1."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.ids = np.concatenate([ids, np.zeros(2 * MODULUS, np.int32)])
        self.table: list[np.ndarray] | None = None

    def _build(self) -> None:
        """Sort the suffixes at the residues of the cover; the common prefixes of neighbours, as a sparse table of minima."""
        n = self.n
        places = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER)).astype(np.int32)
        wide = max(1, int(self.ids.max()).bit_length())
        keys, at = [], 0
        while at < MODULUS:  # as many words in a key as fit
            key, bits = np.zeros(len(places), np.int64), 0
            while at < MODULUS and bits + wide <= 62:
                key = (key << wide) | self.ids[places + at]
                bits += wide
                at += 1
            keys.append(key)
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(places), bool)
        fresh[0] = True
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        ranks, span = [], MODULUS
        while True:
            rank = np.zeros(n + 1, np.int32)  # by place; 0 where no sample stands or the text has ended
            rank[places[order]] = np.cumsum(fresh)
            ranks.append((span, rank))
            if fresh.all() or span >= n:
                break
            then = rank[np.minimum(places + span, n)]
            key = rank[places].astype(np.int64) << 32 | then
            order = np.argsort(key, kind="stable")
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            span *= 2
        self.rank = ranks[-1][1]
        suffixes = places[order]
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(len(a), np.int32)
        for span, rank in reversed(ranks):
            same = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (a < n) & (b < n)
            common[same] += span
            a[same] += span
            b[same] += span
        alike = np.ones(len(a), bool)
        for k in range(MODULUS):  # what is left is shorter than one block of words
            left, right = self.ids[np.minimum(a + k, n)], self.ids[np.minimum(b + k, n)]
            alike &= (left == right) & (left > 0)
            common += alike
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least common prefix between neighbours lo to hi - 1 in the order of suffixes."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b (a < b) on are the same."""
        shift = _shifts()[a % MODULUS, (b - a) % MODULUS]
        out = np.zeros(len(a), np.int32)
        live = np.arange(len(a))
        for k in range(DIRECT + MODULUS - 1):
            live = live[shift[live] > k]
            one, two = self.ids[a[live] + k], self.ids[b[live] + k]
            live = live[(one == two) & (two > 0)]
            out[live] = k + 1
        reached = np.flatnonzero((out == shift) & (b + shift < self.n))
        if len(reached):
            if self.table is None:
                self._build()
            one, two = self.rank[a[reached] + shift[reached]] - 1, self.rank[b[reached] + shift[reached]] - 1
            out[reached] += self._minimum(np.minimum(one, two), np.maximum(one, two))
        return out


def _made(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(e, q): all q that divide e, q < e, for lo <= e < hi, by e."""
    q = np.arange(1, max(1, (hi - 1) // 2) + 1, dtype=np.int64)
    first = np.maximum(2, -(-lo // q))
    count = np.maximum(0, (hi - 1) // q - first + 1)
    period = np.repeat(q, count)
    step = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
    end = (np.repeat(first, count) + step) * period
    order = np.argsort(end, kind="stable")
    ends, periods = end[order], period[order]
    own = np.arange(max(lo, 1), hi)  # q = e: the pair (0, e)
    ends, periods = np.concatenate([ends, own]), np.concatenate([periods, own])
    order = np.argsort(ends, kind="stable")
    return ends[order].astype(np.int32), periods[order].astype(np.int32)


@lru_cache(1)
def _kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid pairs of texts of up to KEPT words, and how many of them end before each word."""
    ends, periods = _made(1, KEPT)
    return ends, periods, np.searchsorted(ends, np.arange(KEPT + 1))


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(e, q) of the harmonic grid of n words, in slices: the neighbouring grid points e - q and e."""
    ends, periods, upto = _kept()
    most = int(upto[min(n, KEPT)])
    for at in range(0, most, SLICE):
        yield ends[at : min(most, at + SLICE)], periods[at : min(most, at + SLICE)]
    step = max(1, SLICE // 16)
    for lo in range(KEPT, n, step):
        yield _made(lo, min(n, lo + step))


def runs(ids: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, length, period) of every run of a sequence of numbers from 1, by start, then period."""
    n = len(ids)
    right, left, found = Extensions(ids), None, []
    near = (least + 3) // 4
    around = np.concatenate([np.full(near, -1, np.int32), ids, np.full(near, -2, np.int32)])
    for end, period in grid(n) if n >= least else ():
        at = np.flatnonzero(ids[end] == ids[end - period])
        #: A stretch has max(q, least - q) words or more around its first pair; half of them, near / least, stand on one side.
        ahead, behind = np.ones(len(at), bool), np.ones(len(at), bool)
        e = end[at] + near
        i = e - period[at]
        for k in range(1, near + 1):
            if k < near:
                ahead &= around[e + k] == around[i + k]
            behind &= around[e - k] == around[i - k]
        at = at[ahead | behind]
        if not len(at):
            continue
        e, q = end[at], period[at]
        i = e - q
        ahead = right.of(i, e)
        fits = ahead >= np.maximum(q, least - q) - q + 1  # what stands before it in the stretch is less than a period
        i, e, q, ahead = i[fits], e[fits], q[fits], ahead[fits]
        if left is None:
            left = Extensions(ids[::-1])
        back = np.zeros(len(i), np.int32)
        inner = np.flatnonzero(i > 0)
        back[inner] = left.of(n - e[inner], n - i[inner])
        length = back + ahead + q
        good = (back < q) & (length >= 2 * q) & (length >= least)
        found.append(np.stack([(i - back)[good], length[good], q[good]], 1).astype(np.int64))
    if not found:
        return np.zeros((0, 3), np.int64)
    each = np.concatenate(found)
    each = each[np.lexsort((each[:, 2], each[:, 1], each[:, 0]))]
    first = np.ones(len(each), bool)
    first[1:] = (each[1:, :2] != each[:-1, :2]).any(1)  # the same stretch with a multiple of its period
    each = each[first]
    return each[np.lexsort((each[:, 2], each[:, 0]))]


def kept_words(n: int, each: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, each[:, 0] + each[:, 2], 1)
    np.add.at(edges, each[:, 0] + each[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document (by a hash of its id), made periodic from some place on; the others as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(docs: DataFrame, least: int = 12, plant: bool = False) -> DataFrame:
    """doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, n_dropped, text, collapsed_sha256 of every row of docs.

    ``text`` has the words that stay, joined by one space, where some go, else the input as it is. ``plant`` makes some texts periodic first.
    """
    kinds = {"doc_id": "long", "n_words": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "n_dropped": "long", "text": "string", "collapsed_sha256": "string"}

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                whole = text.as_py() or b""
                words = words_of(whole)
                if plant:
                    words = planted(words, doc)
                each = runs(numbered(words), least)
                longest = (None,) * 4
                stay = words
                if len(each):
                    start, length, period = each[np.lexsort((each[:, 2], each[:, 0], -each[:, 1]))[0]].tolist()
                    longest = (start, length, period, 1000 * length // period)
                    stay = [w for w, k in zip(words, kept_words(len(words), each).tolist()) if k]
                joined = b" ".join(stay)
                listed = "".join(f"{s},{m},{q}\n" for s, m, q in each.tolist()).encode()
                changed = len(stay) < len(words)
                rows.append((doc, len(words), len(each), *longest, hashlib.sha256(listed).hexdigest(), len(words) - len(stay), joined if changed else whole, hashlib.sha256(joined).hexdigest()))
            if rows:
                arrays = [pa.array(c, pa.binary()).cast(pa.string()) if k == "text" else pa.array(c, pa.int64() if kinds[k] == "long" else pa.string()) for k, c in zip(kinds, zip(*rows))]
                yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))
