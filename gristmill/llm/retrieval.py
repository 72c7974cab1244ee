"""Ranked lexical search: the best documents for each of a set of items, by presence masks.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A document's score for an item is the sum, over the item's distinct terms,
of ``w * (10**9 tf div (1000 tf + 8 m))`` with ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 10 + (90 n N div L)``: N documents with a term, L terms in
them, n in this one, df documents that hold the term, tf times in this one. All but the logarithm is exact in integers.

1. One scan counts N and L and writes segments: for the terms that some item has, which documents of a segment hold them and how often. Nothing else of a text
   goes on, and no pair of an item and a document is made.
2. df is the sum of the segments' counts. In every segment an item's terms are bitmaps over its documents; together they give each document the mask of the
   item's terms that it holds, and documents are grouped by mask. No document of a group can score more than the sum of its terms' largest contributions in
   the segment. Groups are evaluated in falling order of that bound, and an item is finished when the next bound is below the score of
   its ``top``-th best document so far (an equal one is still evaluated, as ties go to the smaller doc_id). A task carries these scores from segment to segment.
3. The tasks' best of each item are merged: ``top`` rows for each task and item.

Items are broadcast in blocks of at most ``block_terms`` terms (a block has one item at least); further blocks repeat steps 1 to 3. So any number of items is answered.

Defined cases: a null or empty text has no term, as an item or as a document; such items, and items none of whose terms occurs, have no row; rows
that share an item_id (null too) are one item with the terms of all; rows that repeat a doc_id are documents of their own and rank one after
the other; a null doc_id comes after others of its score; a term that occurs in nearly all documents may weigh 0; columns other
than doc_id, text and item_id are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import written

#: Best documents of an item, terms of all items of a block, documents of a segment, documents that are scored at once.
TOP, BLOCK_TERMS, SEGMENT, AT_ONCE = 10, 1 << 20, 1 << 12, 64
#: Bytes of a term stay, A-Z in lower case; all others become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Items:
    """Items with their distinct terms, as numbers of a vocabulary."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]


@dataclass
class Weighted:
    """A block of items with the weight of each term and the counts of all documents."""

    items: Items
    weight: np.ndarray
    n_docs: int
    n_terms: int


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term binary): the distinct terms of each item."""

    def run(batches):
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())) for t in set(terms_of(text.as_py() or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def segments(docs: DataFrame, vocabulary: dict[bytes, int], size: int | None = None) -> DataFrame:
    """One row for every run of up to ``size`` documents: how many have a term and how many terms in all; of those that hold a term of the vocabulary the doc_id and
    number of terms; for each such term its number, how many of them hold it, and then which and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most block_terms terms, or one item's
    size = size or SEGMENT

    def run(batches):
        known = shared.value
        fields = [[] for _ in range(5)]
        n_docs = n_terms = seen = 0

        def flushed():
            ids, sizes, places, terms, counts = fields
            term, count = np.concatenate([*terms, np.zeros(0, np.int32)]), np.concatenate([*counts, np.zeros(0, np.int32)])
            place = np.repeat(np.arange(len(places), dtype=np.int32), places)
            order = np.argsort(term, kind="stable")
            some, held = np.unique(term, return_counts=True)
            lists = (np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], bool), np.array(sizes, np.int64), some.astype(np.int32), held.astype(np.int32), place[order], count[order].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *(pa.array([x.tolist()], pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())))], NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = terms_of(text.as_py() or b"")
                seen += 1
                if words:
                    n_docs += 1
                    n_terms += len(words)
                    got = Counter(filter(None, map(known.get, words)))
                    if got:
                        for field, value in zip(fields, (doc, len(words), len(got), np.fromiter(got, np.int32, len(got)), np.fromiter(got.values(), np.int32, len(got)))):
                            field.append(value)
                if seen == size:
                    yield flushed()
                    fields = [[] for _ in range(5)]
                    n_docs = n_terms = seen = 0
        if seen:
            yield flushed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


NAMES = ["docs", "terms", "doc_id", "no_id", "n", "term", "held", "place", "tf"]
SCHEMA = "docs long, terms long, doc_id array<long>, no_id array<boolean>, n array<long>, term array<int>, held array<int>, place array<int>, tf array<int>"


class Best:
    """The best documents of one item so far: (-score, has no doc_id, doc_id), ascending."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def least(self) -> int:
        """The score below which nothing enters; 1 while there is room."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, rows: list[tuple[int, bool, int]]) -> None:
        self.rows = sorted(self.rows + rows)[: self.top]


def rank_segment(known: Weighted, segment: dict[str, np.ndarray], best: list[Best], at_once: int = AT_ONCE) -> int:
    """Put the documents of a segment into the best of each item; how many documents were scored."""
    docs = len(segment["n"])
    if not docs:
        return 0
    m = np.array([10 + 90 * n * known.n_docs // known.n_terms for n in segment["n"].tolist()], np.int64)
    bounds = np.concatenate([[0], np.cumsum(segment["held"])])
    place, tf = segment["place"], segment["tf"].astype(np.int64)
    worth = np.repeat(known.weight[segment["term"]], segment["held"]) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
    most = np.maximum.reduceat(worth, bounds[:-1]) if len(worth) else np.zeros(0, np.int64)
    slot = np.full(len(known.weight), -1, np.int64)
    slot[segment["term"]] = np.arange(len(bounds) - 1)
    ids, no_id, scored = segment["doc_id"], segment["no_id"], 0
    for terms, mine in zip(known.items.terms, best):
        here = slot[terms]
        here = here[here >= 0]
        if int(most[here].sum()) < mine.least():
            continue
        present = np.zeros((len(here), docs), bool)
        value = np.zeros((len(here), docs), np.int64)
        for k, s in enumerate(here.tolist()):
            at = place[bounds[s] : bounds[s + 1]]
            present[k, at] = True
            value[k, at] = worth[bounds[s] : bounds[s + 1]]
        bitmaps = np.packbits(present, axis=0)  # the mask of each document is a column of bytes
        masks, group = np.unique(np.ascontiguousarray(bitmaps.T).view(f"V{len(bitmaps)}").reshape(-1), return_inverse=True)
        bits = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1, count=len(here))
        bound = bits.astype(np.int64) @ most[here]
        falling = np.argsort(-bound, kind="stable")
        members = np.argsort(np.argsort(falling)[group], kind="stable")  # documents by falling bound of their mask
        sizes = np.bincount(group, minlength=len(masks))[falling]
        ends, at, lo = np.cumsum(sizes), 0, 0
        while at < len(masks) and bound[falling[at]] >= mine.least():
            #: At least one group; several small ones are scored together, as long as each could enter.
            upto = max(at + 1, int(np.searchsorted(ends, lo + at_once, "right")))
            while upto > at + 1 and bound[falling[upto - 1]] < mine.least():
                upto -= 1
            some = members[lo : ends[upto - 1]]
            score = value[:, some].sum(0)
            enters = np.flatnonzero(score >= mine.least())
            if len(enters) > mine.top:  # the best, with all that tie with the last of them
                enters = enters[score[enters] >= np.partition(score[enters], -mine.top)[-mine.top]]
            mine.add(list(zip((-score[enters]).tolist(), no_id[some[enters]].tolist(), ids[some[enters]].tolist())))
            scored += len(some)
            lo, at = int(ends[upto - 1]), upto
    return scored


def _weighted(items: Items, written_segments: DataFrame) -> Weighted:
    n_docs, n_terms = written_segments.agg(F.sum("docs"), F.sum("terms")).first()
    held = written_segments.select(F.explode(F.arrays_zip("term", "held")).alias("x")).groupBy("x.term").agg(F.sum("x.held").alias("df")).collect()  # one row for each term of the block at most
    weight = np.zeros(len(items.vocabulary) + 1, np.int64)
    for term, df in held:
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return Weighted(items, weight, n_docs or 0, n_terms or 0)


def _ranked(docs: DataFrame, items: Items, top: int) -> DataFrame:
    made = written(segments(docs, items.vocabulary), "segments")
    shared = docs.sparkSession.sparkContext.broadcast(_weighted(items, made))

    def run(batches):
        known = shared.value
        best = [Best(top) for _ in known.items.ids]
        for batch in batches:
            for row in range(batch.num_rows):
                rank_segment(known, {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in NAMES[2:]}, best)
        rows = [(item, None if no_id else doc, -score) for item, mine in zip(known.items.ids, best) for score, no_id, doc in mine.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_id", "doc_id", "score"])

    return made.mapInArrow(run, "item_id long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``top`` best documents."""
    each = written(item_terms(items), "item_terms")
    spark = docs.sparkSession
    blocks = max(1, math.ceil(each.count() / block_terms))
    block = F.pmod(F.xxhash64("item_id", F.lit(13)), F.lit(blocks))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(blocks):
        rows = each.where(block == k).groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()  # about block_terms terms
        vocabulary = {t: n for n, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}), 1)}
        if rows:
            known = Items([r["item_id"] for r in rows], vocabulary, [np.array(sorted(vocabulary[bytes(t)] for t in r["terms"]), np.int64) for r in rows])
            found = found.union(_ranked(docs, known, top))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
