"""Line dedup: a line that several documents hold stays only in the one with the smallest doc_id.

Two Bloom filters find suspected repeats. Every task marks the hashes of its line keys in a
filter "seen once" and those it has met in a second row in a filter "seen twice"; what it marks travels as positions,
and one task for each slice of the bitmaps merges them: a position that is marked once more is marked twice.
Only lines that the second filter holds are shuffled, under a 128-bit digest of
their key, to confirm them and to choose the first document.

The filters follow the input: a HyperLogLog count of the distinct keys sets their size, eight bits or more a key, so that less than
a quarter of "once" is set. They grow up to ``most_bits``, as "twice" is broadcast (2**30 bits: 128 MB). When even
that would be more than half full (beyond some 370 million keys) a filter would sort out too little to be worth its marks; then
there is none, every key is a suspect, and confirmation does the work with 24 bytes a line in the shuffle. The answer is always the same.

Defined cases: a null or empty text is one empty line; a row whose doc_id is null keeps all its lines and
holds none for others; rows that repeat a doc_id count as one document and are each rewritten; columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import CARRIED, carried, mix64, split_by_ids, unpacked, written

#: Bits a key and at most in a filter, of a slice of it at least, number of slices at most, probes for a key.
BITS_A_KEY, MOST_BITS, SLICE, SLICES, PROBES = 8, 1 << 30, 1 << 19, 256, 2
SPACE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, least: int) -> bytes | None:
    """The stripped line with A-Z lower-cased; None if it has fewer than ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) >= 4 * least or len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
        return key
    return None


def _keys(batch: pa.RecordBatch, least: int) -> Iterator[tuple[int, list[bytes]]]:
    """(doc_id, distinct keys) of the rows with a doc_id."""
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
        if doc is not None and (whole := text.as_py()):
            keys = {key for line in whole.split(b"\n") if (key := key_of(line, least)) is not None}
            if keys:
                yield doc, list(keys)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = mix64(hashes) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((hashes + probes * step) & np.uint64(bits - 1)).astype(np.int64)


def _holds(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for places in _places(hashes, 8 * len(filter_)):
        found &= (filter_[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
    return found


def count_keys(docs: DataFrame, least: int = 10) -> int:
    """About how many distinct keys of ``least`` code points the lines of docs have; counted without shuffling lines."""
    line = docs.where("doc_id IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("line"))
    key = line.select(F.lower(F.btrim("line", F.lit(SPACE.decode()))).alias("key")).where(F.length("key") >= least)
    return key.agg(F.approx_count_distinct("key")).first()[0]


def filter_bits(keys: int, most_bits: int = MOST_BITS) -> int | None:
    """Bits of each filter for a number of keys; None where ``most_bits`` would be more than half full."""
    if PROBES * keys > np.log(2) * most_bits:
        return None
    return min(most_bits, 1 << max(12, int(BITS_A_KEY * keys - 1).bit_length()))


def repeat_filter(docs: DataFrame, bits: int, least: int = 10, together: int = 1 << 18) -> np.ndarray:
    """The merged "seen twice" filter over every line of docs, packed: bits / 8 bytes."""
    cut = min(bits, max(SLICE, bits // SLICES))

    def slices(places, kind):
        places = np.unique(places)
        bounds = np.flatnonzero(np.diff(places // cut, prepend=-1))
        for lo, part in zip(bounds.tolist(), np.split(places, bounds[1:])):
            yield int(places[lo]) // cut, kind, zlib.compress((part % cut).astype("<u4").tobytes(), 1)

    def flushed(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        rows = [*slices(_places(values, bits).ravel(), 1), *slices(_places(values[counts > 1], bits).ravel(), 2)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["slice", "kind", "places"])

    def mark(batches):
        held, n = [], 0
        for batch in batches:
            got = np.fromiter((xxhash.xxh3_64_intdigest(k) for _, keys in _keys(batch, least) for k in keys), np.uint64)
            if len(got):
                held.append(got)
                n += len(got)
            if n >= together:
                yield from flushed(held)
                held, n = [], 0
        if held:
            yield from flushed(held)

    def merge(batches):
        marked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = marked.setdefault(row["slice"], (np.zeros(cut, bool), np.zeros(cut, bool)))
                places = np.frombuffer(zlib.decompress(row["places"]), "<u4")
                if row["kind"] == 1:
                    twice[places[once[places]]] = True
                    once[places] = True
                else:
                    twice[places] = True
        for k, (_, twice) in marked.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "twice": [zlib.compress(np.packbits(twice).tobytes(), 1)]})

    marks = docs.select("doc_id", "text").mapInArrow(mark, "slice int, kind int, places binary")
    merged = marks.repartition(bits // cut, "slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # bits / 8 bytes at most, and never more than most_bits / 8
        part = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out[row["slice"] * len(part) : (row["slice"] + 1) * len(part)] = part
    return out


def repeated_lines(docs: DataFrame, least: int = 10, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, keys array<binary>): digests of the line keys that each document has to drop."""
    bits = filter_bits(count_keys(docs, least), most_bits)
    suspects = docs.sparkSession.sparkContext.broadcast(None if bits is None else repeat_filter(docs, bits, least))

    def suspect(batches):
        for batch in batches:
            found = list(_keys(batch, least))
            ids = np.repeat([doc for doc, _ in found], [len(keys) for _, keys in found]).astype(np.int64)
            keys = [k for _, keys in found for k in keys]
            if suspects.value is not None:
                hit = np.flatnonzero(_holds(suspects.value, np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))))
                ids, keys = ids[hit], [keys[i] for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(k) for k in keys], pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(suspect, "key binary, doc_id long"), "suspects")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return rows.join(written(first, "first_lines"), "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, least: int = 10, most_bits: int = MOST_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay, joined by \\n; null as it is), kept_sha256 of every row, and its ``carry`` columns."""
    dropped = written(repeated_lines(docs, least, most_bits), "dropped")
    maybe, never = split_by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried(carry)), dropped)
    whole = never.select("doc_id", "text", CARRIED, F.lit(None).cast("array<binary>").alias("keys"))
    both = maybe.join(dropped, "doc_id", "left")

    def keep(batches):
        for batch in batches:
            lines, gone, kept, shown = [], [], [], []
            for text, keys in zip(batch.column("text").cast(pa.large_binary()), batch.column("keys")):
                whole = text.as_py() or b""
                if keys.is_valid:
                    drop = set(keys.as_py())
                    parts = whole.split(b"\n")
                    stay = [x for x in parts if (k := key_of(x, least)) is None or xxhash.xxh3_128_digest(k) not in drop]
                    lines.append(len(parts))
                    gone.append(len(parts) - len(stay))
                    whole = b"\n".join(stay)
                else:
                    lines.append(whole.count(b"\n") + 1)
                    gone.append(0)
                kept.append(whole)
                shown.append(whole if text.is_valid else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(shown, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), batch.column(CARRIED)],
                ["doc_id", "n_lines", "n_dropped", "text", "kept_sha256", CARRIED],
            )

    schema = f"doc_id long, n_lines long, n_dropped long, text string, kept_sha256 string, {CARRIED} {dict(whole.dtypes)[CARRIED]}"
    return unpacked(both.mapInArrow(keep, schema).union(whole.mapInArrow(keep, schema)), carry)
