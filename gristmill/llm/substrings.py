"""Substring dedup by level-wise doubling: words inside a window that a smaller doc_id also holds are removed.

Level one takes windows of a quarter of the length (13 of 50 words) and keeps those that occur in two documents; only windows around
these are looked at again at twice the length (25), and so on up to the full one. The loop ends with the full length, or as soon as no
candidate survives a level. A longer repeat is a run of full windows, so no candidate needs a level beyond.

No level has to look at every position: a full window is represented by its smallest hash of the level's length (all
positions that tie for it), which equal windows choose alike, so a repeated window meets its copy through that one at every
level. About a twentieth of the positions is shuffled at level one.

Along goes a hash of all the words that the windows represented by a hash can hold. If it is the same
wherever the hash occurs, all these windows are repeats at once: the hash is settled, and a document later than the first keeps it to find its
words; windows go on to the next level only around hashes whose surroundings differ.

A hash of 128 bits stands for a full window; shorter ones, which only select, have 64 bits.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none; texts shorter than the
window lose nothing; a row whose doc_id is null loses nothing and counts for nobody; rows that repeat a doc_id
count as one document; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import CARRIED, Roller, Words, carried, mix64, signed, split_by_ids, texts, unpacked, written

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """better() over values[i : i + width], for every i that has them all."""
    span, out = 1, values
    while span * 2 <= width:
        out = better(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = better(out[: len(out) - (width - span)], out[width - span :])
    return out


def lengths(window: int, levels: int = 3) -> list[int]:
    """The window lengths of the levels, each about twice the one before, up to the full one."""
    return sorted({-(-window // (1 << k)) for k in range(levels)})


class Windows:
    """Hashes of the windows of each level's length, of several texts at once."""

    def __init__(self, window: int):
        self.window, self.lengths = window, lengths(window)
        self.words, self.near, self.far = Words(11), Roller(12), Roller(13)

    def hashes(self, words: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the window of ``length`` at each position, the smallest one inside the full window at each position); top: no window."""
        n, w = len(words), self.window
        if n < w:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = np.arange(n - length + 1)
        own = np.minimum(self.near.ranges(self.near.sums(words), at, at + length), _TOP - np.uint64(1))
        least = _sliding(own, w - length + 1, np.minimum).copy()
        least[owner[: n - w + 1] != owner[w - 1 :]] = _TOP
        return own, least

    def anchors(self, words: np.ndarray, owner: np.ndarray, counts: np.ndarray, length: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, hash of the surroundings, owner) at each position that represents a full window.

        With ``wanted`` windows only the hashes that represent one of them, but each wherever it represents any, so that
        surroundings are compared with all that a hash stands for in a document.
        """
        own, least = self.hashes(words, owner, length)
        if not len(least):
            return least, least, owner[:0]
        reach = self.window - length
        low = np.where(least == _TOP, np.uint64(0), least)
        low = np.concatenate([np.zeros(reach, np.uint64), low, np.zeros(reach, np.uint64)])
        chosen = np.flatnonzero(_sliding(low, reach + 1, np.maximum) == own)
        if wanted is not None:
            chosen = chosen[np.isin(own[chosen], least[wanted])]
        whose = owner[chosen]
        start = np.maximum(chosen - reach, counts[whose])
        end = np.minimum(chosen + self.window, counts[whose + 1])
        around = mix64(self.far.ranges(self.far.sums(mix64(words)), start, end) + (chosen - start).astype(np.uint64))
        return own[chosen], around, whose


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, gone0 array<long>, gone1, ...): for each level the settled hashes of each document that a smaller doc_id holds too."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    sizes = lengths(window)

    def look(level):
        def run(batches):
            made = Windows(window)
            for batch in batches:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for lo, hi, data, offsets in texts(batch.column("text")):
                    words, owner, counts = made.words.of(data, offsets)
                    wanted = None
                    if level:
                        _, least = made.hashes(words, owner, sizes[level - 1])
                        wanted = np.zeros(len(least), bool)
                        bounds = np.searchsorted(owner[: len(least)], np.arange(hi - lo + 1))
                        for k in range(hi - lo):
                            part = slice(bounds[k], bounds[k + 1])
                            if part.stop > part.start:
                                wanted[part] = np.isin(least[part], batch.column("alive")[lo + k].values.to_numpy().view(np.uint64))
                    found, around, whose = made.anchors(words, owner, counts, sizes[level], wanted)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(signed(around)), pa.array(ids[lo + whose])], ["hash", "around", "doc_id"])

        return run

    settled, rows = [], base
    for level in range(len(sizes)):
        last = level == len(sizes) - 1
        found = written(rows.mapInArrow(look(level), "hash long, around long, doc_id long"), f"level_{level}")
        key = ["hash", "around"] if last else ["hash"]
        mixed = F.lit(False) if last else F.min("around") != F.max("around")
        twice = found.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), mixed.alias("mixed")).where("first < last").drop("last")
        judged = found.select("doc_id", *key).join(written(twice, f"twice_{level}"), key).where("mixed OR doc_id > first").groupBy("doc_id").agg(
            F.collect_set(F.when(~F.col("mixed"), F.col("hash"))).alias("gone"), F.collect_set(F.when(F.col("mixed"), F.col("hash"))).alias("alive"))
        judged = written(judged, f"judged_{level}")
        settled.append(judged.where("size(gone) > 0").select("doc_id", F.lit(level).alias("level"), "gone"))
        alive = judged.where("size(alive) > 0").select("doc_id", "alive")
        if last or not alive.limit(1).count():
            break
        some, _ = split_by_ids(base, alive)
        rows = some.join(alive, "doc_id")
    each = settled[0]
    for more in settled[1:]:
        each = each.union(more)
    return each.groupBy("doc_id").agg(*(F.first(F.when(F.col("level") == k, F.col("gone")), ignorenulls=True).alias(f"gone{k}") for k in range(len(sizes))))


def drop_repeated_substrings(docs: DataFrame, window: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, text, kept_sha256 of every row, and its ``carry`` columns.

    ``text`` is the input, unchanged (null too), where nothing is removed; else the kept words joined by one space.
    ``kept_sha256`` is always that of the kept words joined by one space.
    """
    gone = written(repeated_windows(docs, window), "gone")
    maybe, never = split_by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried(carry)), gone)
    columns = [f"gone{k}" for k in range(len(lengths(window)))]
    whole = never.select("doc_id", "text", CARRIED, *(F.lit(None).cast("array<bigint>").alias(c) for c in columns))
    both = maybe.join(gone, "doc_id", "left")

    def keep(batches):
        made = Windows(window)
        for batch in batches:
            n_words, n_removed, kept, sums = [], [], [], []
            for text, *gone in zip(batch.column("text").cast(pa.large_binary()), *(batch.column(c) for c in columns)):
                whole = text.as_py() or b""
                words = whole.split()
                removed = 0
                if any(g.is_valid for g in gone) and len(words) >= window:
                    hashes, owner, _ = made.words.of(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
                    hit = np.zeros(len(words) - window + 1, bool)
                    for g, length in zip(gone, made.lengths):
                        if g.is_valid:
                            hit |= np.isin(made.hashes(hashes, owner, length)[1], g.values.to_numpy().view(np.uint64))
                    edges = np.zeros(len(words) + 1, np.int64)
                    edges[:-window][hit] += 1
                    edges[window:][hit] -= 1
                    covered = np.cumsum(edges[:-1]) > 0
                    removed = int(covered.sum())
                joined = b" ".join([w for w, c in zip(words, covered) if not c] if removed else words)
                n_words.append(len(words))
                n_removed.append(removed)
                kept.append(joined if removed else whole if text.is_valid else None)
                sums.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums), batch.column(CARRIED)],
                ["doc_id", "n_words", "n_removed", "text", "kept_sha256", CARRIED],
            )

    schema = f"doc_id long, n_words long, n_removed long, text string, kept_sha256 string, {CARRIED} {dict(whole.dtypes)[CARRIED]}"
    return unpacked(both.mapInArrow(keep, schema).union(whole.mapInArrow(keep, schema)), carry)
