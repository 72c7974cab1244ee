"""Best-fit packing of tokenized documents into sequences under several capacities.

A sequence has a capacity of tokens, of documents and of attention cost (the sum of squared piece lengths).
Pieces are placed from the longest down, as vectors (tokens, 1, length**2) scaled by the capacities. A sequence
qualifies only if the piece fits under every capacity; among those the one with the largest weighted dot product of
piece and residual, or the smallest weighted norm of what would remain, takes it (``by``). Sequences with equal
residuals are interchangeable, so the choice is over the distinct residuals, a set bounded by the capacities. All three
dimensions have a weight: of two sequences that leave about as many tokens the one that is closer to its other limits is taken, which
keeps room for many documents, or for costly ones, where there still is some.

Only (doc_id, piece, length) is shuffled, into groups of about ``group_pieces`` rows chosen by a hash of the
document: each group has the same mix of lengths and is packed on its own, which costs at most a few part-filled
sequences for each group. Whole sequences (pieces of exactly the capacity) need no group.

Defined cases: a null or empty text is the end token alone; repeated rows are pieces of their own (a sequence
never mixes them up: rows, not ids, are placed); a null doc_id is kept as null. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import written

#: Characters whose classes are the same in every version of Unicode that the two tokenizer libraries may follow.
USUAL = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
SPECIAL = "<|"
#: Weights of tokens, documents and attention cost, as shares of their capacities, in the choice of a sequence.
WEIGHTS = (1.0, 0.1, 0.1)


class ByteLevelEncoder:
    """ids of whole texts as packed unsigned 32-bit integers, as ``tokenizers`` gives them.

    ``tokenizers`` defines the ids. Where the vocabulary's ranks are at hand as well (``ranks``, the same vocabulary
    for ``tiktoken``, which is about three times as fast), texts of usual characters without the opening of
    a special token go through those; tests hold both ways against each other.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and SPECIAL not in text and (text.isascii() or not USUAL.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document; only the first may be shorter."""

    def cut(batches):
        encoder = ByteLevelEncoder(tokenizer, ranks)
        tail = np.array([end], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = encoder.encode(text.as_py() or "") + tail
                n, start = len(packed) // 4, 0
                for k in range(-(-n // capacity)):
                    length = n % capacity or capacity if k == 0 else capacity
                    rows.append((doc, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, sequences numbered from 0, packed in the order of falling length.

    Of sequences that ``by`` judges alike, the one whose residual was first to come up takes the piece.
    """
    tokens, documents, attention = capacity
    caps, w = np.array(capacity, float), np.array(weights, float)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened: dict[tuple[int, int, int], list[int]] = {}
    made, keys, residuals, dirty = 0, [], np.zeros((0, 3)), False
    for i in order.tolist():
        n = int(lengths[i])
        need = np.array([n, 1, n * n], float)
        if dirty:
            keys, dirty = list(opened), False
            residuals = np.array(keys, float).reshape(-1, 3)
        best = None
        fits = np.flatnonzero((residuals >= need).all(1))
        if len(fits):
            if by == "dot":
                score = -((residuals[fits] / caps) * (need / caps) * w).sum(1)
            else:
                score = (w * ((residuals[fits] - need) / caps) ** 2).sum(1)
            best = keys[fits[int(np.argmin(score))]]
        if best is None:
            k, left = made, (tokens, documents, attention)
            made += 1
            if n > tokens or documents < 1 or n * n > attention:
                raise ValueError(f"a piece of {n} tokens fits no sequence")
        else:
            left = best
            k = opened[best].pop(0)
            if not opened[best]:
                del opened[best]
                dirty = True
        sequence[i], offset[i] = k, tokens - left[0]
        rest = (left[0] - n, left[1] - 1, left[2] - n * n)
        if min(rest) > 0:
            dirty |= rest not in opened
            opened.setdefault(rest, []).append(k)
    return sequence, offset


def pack(made: DataFrame, capacity: int = 1024, documents: int = 1024, attention: int = 1024 * 1024, group_pieces: int = 8192, by: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``made`` with sequence_id and offset: no sequence holds more than any capacity. ``made`` is counted and read again, so it should be a written table."""
    n = made.where(F.col("length") < capacity).count()
    groups = max(1, n // group_pieces)
    part = made.where(F.col("length") < capacity).withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))  # equal rows are dealt out too
    whole = made.where(F.col("length") == capacity)

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_fit(rows.column("length").to_numpy(), (capacity, documents, attention), weights, by)
        number = rows.column("grp").to_numpy().astype(np.int64) * (1 << 32) + sequence
        return rows.drop_columns("grp").append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = part.groupBy("grp").applyInArrow(place, schema)
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end: int = 2, **options: object) -> DataFrame:
    """Tokenize, cut and pack every document."""
    return pack(written(pieces(docs, tokenizer, ranks, end, capacity), "pieces"), capacity, **options)
