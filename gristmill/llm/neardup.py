"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles, the weight being how often one occurs; similarity is weighted
Jaccard (sum of smaller weights over sum of larger ones). DartMinHash throws darts: every region (element, weight
interval, rank interval) of a fixed grid holds a pseudo-random number of darts, a function of the region alone; a dart
that lands below the element's weight counts, each belongs to one of ``k`` coordinates, and a coordinate keeps its
earliest dart. Intervals double, so a document only visits regions up to the rank by which about k ln k darts have come,
whatever its size. Two documents agree in a coordinate with probability equal to their similarity.

Bands of the signature give buckets. Only different texts go on: exact copies are collapsed by a digest first.
Links are found in two steps. (1) In each bucket every text is compared with the bucket's first; verified links
are joined to classes. (2) What is left are texts of one bucket in different classes: these documents get a second, longer
signature, and each such pair that agrees in enough of it is compared, in blocks of a bucket against
blocks, so that no link of a shared bucket is lost and no group meets in one task. Comparisons are exact, on
whole texts, a few partners of one text at a time.

Chance of missing a link at similarity 0.8: (1 - 0.8**5)**25 = 5e-5 for the bands, and about 1e-4 for the longer
signature (512 coordinates, 0.065 below the threshold: 3.7 standard deviations).

Defined cases: words are separated by ``[\\x20\\x09-\\x0D]``; a text of one to four words has one shingle, all of it;
texts without words are copies of the same text only; a null text resembles nothing; a row whose doc_id is null takes no part and is
not returned; rows that repeat a doc_id are one document with several texts: each of them links
it, and it stays or goes as a whole; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Roller, Words, components, mix64, noise, signed, split_by_ids, texts, written

BANDS, ROWS, WIDTH, THRESHOLD, MARGIN, CLOSE = 25, 5, 5, 0.8, 0.2, 0.065


class Shingles:
    def __init__(self, width: int = WIDTH):
        self.width, self.words, self.roller = width, Words(21), Roller(22)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distinct shingle hashes, weights) of each text."""
        hashes, _, counts = self.words.of(data, offsets)
        sums = self.roller.sums(hashes)
        out = []
        for lo, hi in zip(counts[:-1].tolist(), counts[1:].tolist()):
            size = min(self.width, hi - lo)
            at = np.arange(lo, hi - size + 1) if size else np.zeros(0, np.int64)
            out.append(np.unique(self.roller.ranges(sums, at, at + size), return_counts=True))
        return out


class Darts:
    """Signatures of k coordinates of weighted sets."""

    def __init__(self, k: int, low: int = -12):
        self.k, self.low = k, low
        self.expected = k * math.log(k) + 2 * k
        self.levels = list(range(low, 64))
        self.edges = np.array([0.0, *(2.0**x for x in self.levels)])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53

    @lru_cache(maxsize=4096)  # noqa: B019
    def _poisson(self, first: int, last: int, heavy: int) -> np.ndarray:
        """Cumulative dart counts of the rank intervals first..last, each raised by its place so that one search serves all."""
        out = []
        for j, size in enumerate(np.diff(self.edges)[first : last + 1]):
            mean = size * (1.0 if heavy == 0 else 2.0 ** (heavy - 1))
            n = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
            logs = n * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
            out.extend(j + np.minimum(np.cumsum(np.exp(logs)), 1.0 - 2.0**-50))
            out.append(j + 1.0)
        return np.array(out)

    def _thrown(self, elements: np.ndarray, weights: np.ndarray, first: int, last: int, heavy: int) -> tuple[np.ndarray, np.ndarray]:
        """(rank, identity) of the darts that count in the rank intervals first..last and one interval of weights."""
        w_lo, w_size = (0.0, 1.0) if heavy == 0 else (2.0 ** (heavy - 1), 2.0 ** (heavy - 1))
        if heavy:
            inside = weights > w_lo
            elements, weights = elements[inside], weights[inside]
        levels = np.arange(first, last + 1)
        marks = noise(len(self.levels), 40 + heavy)[first : last + 1]
        region = mix64(elements[None, :] ^ marks[:, None])
        table = self._poisson(first, last, heavy)
        places = np.searchsorted(table, self._unit(region) + np.arange(len(levels))[:, None], "right")
        number = (places - np.searchsorted(table, np.arange(len(levels)), "right")[:, None]).ravel()
        owner = np.repeat(np.arange(len(number)), number)
        if not len(owner):
            return np.zeros(0), np.zeros(0, np.uint64)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        dart = mix64(region.ravel()[owner] + (nth + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        level = first + owner // len(elements)
        rank = self.edges[level] + (self.edges[level + 1] - self.edges[level]) * self._unit(dart * np.uint64(0x9FB21C651E98DF25))
        if heavy == 0:
            if weights.min() >= 1:
                return rank, dart
        return self._counting(rank, dart, weights, owner, w_lo, w_size)

    def _counting(self, rank, dart, weights, owner, w_lo, w_size):
        height = w_lo + w_size * self._unit(mix64(dart ^ np.uint64(0x5851F42D4C957F2D)))
        counts = height < weights[owner % len(weights)]
        return rank[counts], dart[counts]

    def signature(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The earliest dart of each coordinate; zeros for an empty set."""
        out = np.zeros(self.k, np.uint64)
        if not len(elements):
            return out
        heavy = math.ceil(math.log2(float(weights.max()))) if weights.max() > 1 else 0
        first, last = 0, max(0, math.ceil(math.log2(self.expected / float(weights.sum()))) - self.low)
        ranks, darts = [], []
        while True:
            for h in range(heavy + 1):
                rank, dart = self._thrown(elements, weights, first, last, h)
                ranks.append(rank)
                darts.append(dart)
            rank, dart = (np.concatenate(ranks), np.concatenate(darts)) if len(ranks) > 1 else (ranks[0], darts[0])
            order = np.argsort(-rank)
            dart = dart[order]
            out[(mix64(dart) % np.uint64(self.k)).astype(np.int64)] = dart
            if out.all():
                return out
            first = last = last + 1


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, digest, bands array<long>, signature binary (16 bits a coordinate); no bands for texts without words."""

    def run(batches):
        shingles, darts = Shingles(width), Darts(bands * rows)
        band = noise(rows * bands, 31).reshape(bands, rows)
        for batch in batches:
            ids, digest = batch.column(0), batch.column(2)
            keep, keys, small = [], [], []
            for lo, _, data, offsets in texts(batch.column(1)):
                for k, (elements, weights) in enumerate(shingles.of(data, offsets)):
                    keep.append(lo + k)
                    if not len(elements):
                        keys.append([])
                        small.append(b"")
                    else:
                        signature = darts.signature(elements, weights)
                        keys.append(signed(mix64((mix64(signature).reshape(bands, rows) * (band | np.uint64(1))).sum(1) + band[:, 0])))
                        small.append((mix64(signature) >> np.uint64(48)).astype("<u2").tobytes())
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([ids.take(at), digest.take(at), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary())], ["doc_id", "digest", "bands", "signature"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return base.mapInArrow(run, "doc_id long, digest binary, bands array<long>, signature binary")




def _agree(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Share of equal coordinates of signatures, row by row."""
    a, b = (np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1) for x in (left, right))
    return (a == b).mean(1)


def _near(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in a share of at least ``least``."""
    sig = reps.select("doc_id", "signature")
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                hit = pa.array(_agree(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()) >= least)
                yield batch.select(["a", "b"]).filter(hit)

    return both.mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, partners: int = 16) -> DataFrame:
    """The pairs (a, b) whose whole texts have a weighted Jaccard similarity of at least ``threshold``.

    The partners of one text are dealt into groups of about ``partners``; each group's task has the text itself and
    these partners, so a text with many partners is spread over many tasks.
    """
    number = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = written(pairs.join(number, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / partners)).alias("part")), "dealt")
    members = dealt.select("a", "part", F.col("b").alias("doc_id")).union(dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("doc_id")))
    compared = written(dealt.select(F.col("a").alias("doc_id")).union(dealt.select("b")).distinct(), "compared")
    wanted, _ = split_by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL"), compared)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles, sets = Shingles(width), {}
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            data = np.frombuffer(text.encode(), np.uint8)
            sets.setdefault(doc, []).extend(shingles.of(data, np.array([0, len(data)])))
        a = pdf["a"].iloc[0]
        hits = [b for b in sets if b != a and any(similarity(x, y) >= threshold for x in sets.get(a, ()) for y in sets[b])]
        return pd.DataFrame({"a": np.full(len(hits), a, np.int64), "b": np.array(hits, np.int64)})

    return members.join(wanted, "doc_id").select("a", "part", "doc_id", "text").groupBy("a", "part").applyInPandas(run, "a long, b long")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (distinct elements, weights); 0 if both are empty."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    return float(both / max(x[1].sum() + y[1].sum() - both, 1e-12))


#: Orders of the ids in which a bucket's first text is taken, as masks of bits to flip.
ORDERS = (0, 0x5555555555555555, 0x3333333333333333)


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): every text of a bucket with the bucket's first texts in several orders."""
    firsts = [F.min(F.col("doc_id").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"p{k}") for k, x in enumerate(ORDERS)]
    many = written(buckets.groupBy("key").agg(F.count("*").alias("n"), *firsts).where("n > 1").drop("n"), "buckets")
    joined = buckets.join(many, "key").select("doc_id", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(len(ORDERS)))))).alias("p")).where("doc_id <> p")
    return joined.select(F.least("doc_id", "p").alias("a"), F.greatest("doc_id", "p").alias("b")).distinct()


def _long_signatures(docs: DataFrame, ids: DataFrame, k: int, width: int) -> DataFrame:
    """(doc_id, long binary): signatures of k coordinates, 8 bits each, of the named documents."""
    wanted, _ = split_by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL"), ids)

    def run(batches):
        shingles, darts = Shingles(width), Darts(k)
        for batch in batches:
            out = []
            for _, _, data, offsets in texts(batch.column(1)):
                out += [(mix64(darts.signature(*x)) >> np.uint64(56)).astype(np.uint8).tobytes() for x in shingles.of(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "long"])

    return wanted.join(ids, "doc_id").select("doc_id", "text").mapInArrow(run, "doc_id long, long binary")


def _rest_pairs(docs: DataFrame, reps: DataFrame, buckets: DataFrame, classes: DataFrame, least: float, width: int, k: int = 512, block: int = 512) -> DataFrame:
    """(a, b): texts of one bucket in different classes whose longer signatures agree in a share of at least ``least``.

    The two texts of a bucket of two have been compared before. A pair comes only from the first of the buckets that it shares.
    """
    label = F.coalesce("component", "doc_id")
    many = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    rows = written(buckets.join(many, "key").join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", label.alias("label")), "members")
    mixed = written(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
    rows = written(rows.join(mixed, "key"), "mixed_members")
    longer = written(_long_signatures(docs, written(rows.select("doc_id").distinct(), "mixed_ids"), k, width), "long")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(longer, "doc_id").join(reps.select("doc_id", "bands"), "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "label", "long", "bands")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, label, own = (pdf[c].to_numpy() for c in ("doc_id", "label", "own"))
        sig = np.frombuffer(b"".join(pdf["long"]), np.uint8).reshape(len(pdf), -1)
        bands, key = np.stack(pdf["bands"]), pdf["key"].iloc[0]
        between = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(ids)):
            at = np.flatnonzero((ids > ids[i]) & (label != label[i]) & ((own != own[i]) if between else True))
            at = at[(sig[at] == sig[i]).mean(1) >= least]
            at = at[bands[i][(bands[at] == bands[i]).argmax(1)] == key]
            left.append(np.full(len(at), ids[i]))
            right.append(ids[at])
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).astype("int64")

    return rows.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, cluster_id (smallest doc_id that links reach), kept (doc_id = cluster_id) of every document."""
    sig = written(signatures(docs, bands, rows, width), "signatures")
    first = written(sig.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "texts")
    copies = written(sig.select("doc_id", "digest").join(first.where("n > 1"), "digest").select("doc_id", "rep"), "copies")
    others = copies.where("doc_id > rep").select("doc_id")
    later, ours = split_by_ids(sig.drop("digest"), others)
    reps = written(ours.union(later.join(others, "doc_id", "left_anti")), "reps")
    buckets = reps.select("doc_id", F.explode("bands").alias("key"))

    pairs = written(_near(_pivot_pairs(buckets), reps, threshold - MARGIN), "pairs")
    links = written(verified(docs, pairs, threshold, width), "links")
    classes = written(components(links), "classes")
    rest = _rest_pairs(docs, reps, buckets, classes, threshold - CLOSE, width).join(pairs, ["a", "b"], "left_anti")
    more = written(verified(docs, written(rest, "rest"), threshold, width), "more")
    if more.limit(1).count():
        classes = written(components(links.union(more)), "classes")

    joined = copies.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    found = joined.union(classes.select(F.col("id").alias("doc_id"), F.col("component").alias("c"))).groupBy("doc_id").agg(F.min("c").alias("c"))
    everyone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return everyone.join(found, "doc_id", "left").select("doc_id", F.coalesce("c", "doc_id").alias("cluster_id"), (F.coalesce("c", "doc_id") == F.col("doc_id")).alias("kept"))
