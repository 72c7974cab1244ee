"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded before matching: lower case, accents and look-alike letters of other scripts mapped to Latin, then
digits and signs that stand for letters inside a word. The lexicon is learnt: word beginnings of four letters and more (stems), and
whole words from two letters on, that surely stand in a far larger share of the toxic than of the other
labelled rows, however few those are, get the logarithm of the ratio of their rates as weight. Exception phrases are two
words, one of them with a lexicon entry, that surely do not stand in such a share of toxic rows; a given table of them joins
those learnt. Lexicon and exception phrases go into one automaton; at each word start the longest
entry counts, unless it lies inside an exception phrase. The summed weight is normalised by the square root of
the number of words, and a fitted logistic line turns it into the score.

The lexicon is learnt from at most about ``learn_rows`` labelled rows outside the held-out fold and the line from at most
about ``fit_rows`` of them, chosen by a hash of doc_id; every document is scored whole. All entries that pass the test
enter; their number is bounded by the words of those rows.

Defined cases: null and empty texts have no match and get the score of none; rows with a null doc_id are scored and
held out of learning; label rows whose toxic is null or whose doc_id has no document are ignored, repeated label rows
count once for each document (the largest label); documents that repeat are each scored. Words of one letter never count.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import written

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмтвнαβεικνορτυχ", "aeopcyxijsdhkmtbhabeiknoptux")
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
#: Phrases in which a word of the lexicon is not an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "white trash can", "idiot proof")

WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"(?<![^\W_@$!|])(?=[^\s]*[^\W\d_])[\w@$!|]*[013457@$!|][\w@$!|]*")
_PHRASE_BEFORE, _PHRASE_AFTER = re.compile(r"(?<![^\W_])[^\W_]+ $"), re.compile(r" [^\W_]+")
_ACCENTS = {}


def _plain(match: re.Match) -> str:
    """! and | are punctuation at the end; at the start they may be that or a letter, so both readings stay."""
    word = match.group()
    body = word.rstrip("!|")
    bare = body.lstrip("!|")
    return (body if bare == body else f"{body} {bare}").translate(SUBSTITUTES) + word[len(body) :]


def fold(text: str) -> str:
    """Lower case without accents, look-alikes or digit substitutions inside words."""
    text = text.lower()
    if not text.isascii():
        text = "".join(_ACCENTS[c] if c in _ACCENTS else _ACCENTS.setdefault(c, _strip(c)) for c in text) if not _latin(text) else text.translate(_LATIN)
    return _MIXED.sub(_plain, text)


def _strip(c: str) -> str:
    c = c.translate(HOMOGLYPHS)
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).translate(HOMOGLYPHS).lower()


#: Latin letters with accents, by rule.
_LATIN = {c: _strip(chr(c)) for c in range(0xA0, 0x250)}


def _latin(text: str) -> bool:
    return max(text) < "ɐ"


class Lexicon:
    """Weighted words and exception phrases in one automaton; picklable as its lists.

    Entries of fewer than ``short`` letters match whole words only, and so do exception phrases at their end.
    """

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, line: tuple[float, float] = (1.0, 0.0), short: int = 4):
        self.weights, self.exceptions, self.line, self.short = weights, exceptions, line, short
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "line": self.line, "short": self.short, "_automaton": None}

    def _search(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                self._automaton.add_word(word, (len(word), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def mass(self, text: str) -> float:
        """Summed weight of the longest match at each word start of a folded text that no exception covers."""
        automaton = self._search()
        if not len(automaton):
            return 0.0
        found, spared = self._met(text)
        if spared:
            found = {lo: x for lo, x in found.items() if spared.get(lo, 0) < lo + x[0]}
        return sum(w for _, w in found.values())

    def _met(self, text: str) -> tuple[dict[int, tuple[int, float]], dict[int, int]]:
        """(start: (size, weight) of the longest entry there, start of a word: the end up to which exceptions spare it)."""
        found, spared = {}, {}
        for end, (size, weight) in self._search().iter(text):
            start = end + 1 - size
            if start and text[start - 1].isalnum():
                continue
            if (weight is None or size < self.short) and text[end + 1 : end + 2].isalnum():
                continue
            if weight is None:
                for word in WORD.finditer(text, start, end + 1):
                    spared[word.start()] = max(spared.get(word.start(), 0), end + 1)
            elif size > found.get(start, (0, 0.0))[0]:
                found[start] = size, weight
        return found, spared

    def words_met(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each word of a folded text that has an entry."""
        if not len(self._search()):
            return []
        return [(lo, WORD.match(text, lo).end()) for lo in sorted(self._met(text)[0]) if WORD.match(text, lo)]

    def feature(self, text: str | None) -> float:
        folded = fold(text or "")
        return math.log1p(self.mass(folded) / math.sqrt(max(1, len(folded.split()))))

    def score(self, text: str | None) -> float:
        slope, shift = self.line
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, slope * self.feature(text) + shift))))


def held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in ids], bool)


def _some(rows: DataFrame, total: int, most: int, seed: int = 7) -> DataFrame:
    """About ``most`` of the rows, by a hash of doc_id; all if there are no more."""
    parts = 1 << 20
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)) < int(parts * min(1.0, most / max(1, total))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, total: int, most: int) -> DataFrame:
    """(doc_id, text, y) of about ``most`` of the ``total`` labelled rows, none of them held out.

    As their number is bounded, these labels are broadcast to the scan and no text is shuffled. Label rows that repeat a
    document are reduced to the largest label.
    """
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    mine = mine.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(_some(mine, total, most)), "doc_id")


def entries_of(word: str, stems: tuple[int, int]) -> tuple[str, ...]:
    """The lexicon entries that a word stands for: its beginnings of ``stems`` lengths and the word itself."""
    short, long = stems
    if len(word) < short:
        return (word,) if len(word) > 1 else ()
    return (*(word[:k] for k in range(short, min(long, len(word)) + 1)), *((word,) if len(word) > long else ()))


def _counted(rows: DataFrame, find, name: str, together: int = 1 << 15) -> DataFrame:
    """stem, docs1, uses1, docs0, uses0: in how many rows, and how often, what ``find(text)`` gives stands, by label.

    The row of the empty stem has the numbers of rows and of words. A task hands its counts on whenever it holds ``together`` stems.
    """

    def count(batches):
        fresh = lambda: {y: [0, 0, Counter(), Counter()] for y in (0, 1)}
        counts = fresh()

        def rows():
            for y, (docs_, words_, in_docs, uses) in counts.items():
                columns = [["", *in_docs], [y] * (len(in_docs) + 1), [docs_, *in_docs.values()], [words_, *(uses[s] for s in in_docs)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["stem", "y", "docs", "uses"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                held = counts[int(y > 0)]
                n, here = find(text.as_py() or "")
                held[0] += 1
                held[1] += n
                held[2].update(here.keys())
                held[3].update(here)
                if len(held[2]) > together:
                    yield from rows()
                    counts = fresh()
        yield from rows()

    toxic = F.col("y") == 1
    sums = (F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k, side in ((1, toxic), (0, ~toxic)) for c in ("docs", "uses"))
    return written(rows.select("text", "y").mapInArrow(count, "stem string, y int, docs long, uses long").groupBy("stem").agg(*sums), name)


def _wilson(side: int, sure: float) -> F.Column:
    """The Wilson bound of the toxic part of a stem's rows, ``sure`` standard deviations below (side -1) or above (1)."""
    n = F.col("docs1") + F.col("docs0")
    part, z = F.col("docs1") / n, sure * sure / n
    return (part + z / 2 + side * F.sqrt(z * part * (1 - part) + z * z / 4)) / (1 + z)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", stems: tuple[int, int] = (4, 8), least_ratio: float = 4.0, sure: float = 2.0, least_docs: int = 3, learn_rows: int = 20_000, fit_rows: int = 4000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon, exception phrases and score line from the labelled rows outside the held-out fold.

    A stem enters if the lower Wilson bound, ``sure`` standard deviations below, of the toxic part of its rows is at least what
    a ``least_ratio`` of the two classes' shares gives; a phrase is an exception if its upper bound is below that.
    """
    total = labels.count()
    rows = written(training_rows(docs, labels, label, total, learn_rows), "toxic_rows")  # a bounded number of rows, read three times

    def stems_of(text):
        words = WORD.findall(fold(text))
        return len(words), Counter(e for w in words for e in entries_of(w, stems))

    table = _counted(rows, stems_of, "stems")
    whole = table.where("stem = ''").first()
    line = Lexicon({}, exceptions)
    if whole is not None and whole["docs1"]:
        share = lambda k, c: (F.col(f"{c}{k}") + 0.5) / (whole[f"{c}{k}"] + 1)
        least = least_ratio * whole["docs1"] / (least_ratio * whole["docs1"] + whole["docs0"])
        best = table.where((F.col("stem") != "") & (F.col("docs1") >= least_docs) & (_wilson(-1, sure) >= least)).select("stem", F.log(share(1, "uses") / share(0, "uses")).alias("w")).where("w > 0").collect()
        line = Lexicon({r["stem"]: float(r["w"]) for r in best}, exceptions, short=stems[0])

        def phrases_of(text):
            folded, found = fold(text), Counter()
            for start, end in line.words_met(folded):
                before, after = _PHRASE_BEFORE.search(folded, max(0, start - 40), start), _PHRASE_AFTER.match(folded, end)
                found.update(([folded[before.start() : end]] if before else []) + ([folded[start : after.end()]] if after else []))
            return 0, found

        if line.weights:
            spared = _counted(rows, phrases_of, "phrases").where((F.col("stem") != "") & (_wilson(1, sure) < least)).select("stem").orderBy("stem").collect()
            line = Lexicon(line.weights, (*exceptions, *(r["stem"] for r in spared if r["stem"] not in exceptions)), short=stems[0])

    def features(batches):
        for batch in batches:
            x, y = [line.feature(t) for t in batch.column(0).to_pylist()], [float(y > 0) for y in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], ["x", "y"])

    fit = _some(rows, total, fit_rows).select("text", "y").mapInArrow(features, "x double, y double").toPandas().sort_values(["x", "y"])  # two numbers for each of about fit_rows rows
    line.line = _logistic(fit["x"].to_numpy(float), fit["y"].to_numpy(float))
    return line


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and shift of a ridge logistic line, by Newton's method."""
    if not len(x):
        return 1.0, -1.0
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([ridge, 0.01]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 0.01])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def scored(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the rows learnt from

    def run(batches):
        lexicon = shared.value
        for batch in batches:
            score = np.array([lexicon.score(t) for t in batch.column(1).to_pylist()], float)
            held = held_out(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_column(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> Column:
    """The score of each row's text as a column, from a broadcast lexicon; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the rows learnt from

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for t in texts.to_pylist()], pa.float64())

    return score(F.coalesce(F.col(text), F.lit("")))
