"""Helpers shared by the operators of this package: shared-folder tables, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
ODD = 0x9E3779B97F4A7C15
WORD = 1 << 64


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches; where it is unset, a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="gristmill-")
        _OWN[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again; the table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", least_bits: int = 1 << 20, most_bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key may be in ids, rows whose key is surely not in ids or is null).

    A bitmap of hashed keys, sixteen bits or more for each of ids, is broadcast to the scan, so
    that a following join has to shuffle only the first part. It has ``most_bits`` / 64 rows of 64 bits at most; beyond four million ids
    it fills up and the first part grows; nothing is lost. ids is counted, so it should be a written table.
    """
    bits = min(most_bits, max(least_bits, 1 << int(16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    mask = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = ids.select(place.alias("_place")).select(F.expr("shiftright(_place, 6)").alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_held"))
    marked = docs.withColumn("_place", place).withColumn("_word", F.expr("shiftright(_place, 6)")).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_held").bitwiseAND(mask) != 0, F.lit(False)) & F.col(key).isNotNull()
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


#: The column that holds what a row carries through an operator untouched, whatever its names.
CARRIED = "_carried"


def carried(names: tuple[str, ...]) -> Column:
    """The named columns as one, so that none of their names meets an operator's own."""
    return F.struct(F.lit(True).alias("_"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(names))).alias(CARRIED)


def unpacked(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with the carried columns under their own names; one that df has already raises ValueError."""
    own = [c for c in df.columns if c != CARRIED]
    if both := set(own) & set(names):
        raise ValueError(f"can't carry {sorted(both)}: the operator returns columns of these names")
    return df.select(*own, *(F.col(f"{CARRIED}.c{k}").alias(c) for k, c in enumerate(names)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def noise(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words from a seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64((ODD * (2 * seed + 1)) % WORD))


class Roller:
    """Polynomial hashes modulo 2**64 of any range of a sequence, from one running sum."""

    def __init__(self, seed: int):
        self.base = (ODD * (2 * seed + 3)) % WORD | 1
        self.inverse = pow(self.base, -1, WORD)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of several UTF-8 texts at once, with a 64-bit hash of each."""

    def __init__(self, seed: int = 1):
        self.letters, self.roller = noise(256, seed), Roller(seed)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, index of its text, number of words before each text)."""
        inner = ~_SPACE[data]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        breaks = offsets[1:-1]
        breaks = breaks[breaks < len(data)]
        first[breaks] = inner[breaks]
        last = inner.copy()
        last[:-1] &= ~inner[1:]
        before = breaks[breaks > 0] - 1
        last[before] = inner[before]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = self.roller.ranges(self.roller.sums(self.letters[data]), start, end)
        counts = np.searchsorted(start, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
        return hashes, owner, counts


def texts(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``most`` bytes, or one row; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, name: str = "components", most: int = 40) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): the smallest id that links reach.

    Alternating large and small stars: every round is two aggregations and two joins by node, each
    written to the shared folder, and stops when a round changes nothing. Nothing reaches the driver but
    a count and a checksum for each round.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    mark = None
    for _ in range(most):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct(), name)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = stars.select(F.col("v").alias("id")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
