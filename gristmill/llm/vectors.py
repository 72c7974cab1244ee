"""Embedding tables: near-duplicate links by a pivot-permutation index, and nearest neighbours by 4-bit codes.

Vectors that are null, empty, zero or hold null or non-finite components take no part in either; nor do vectors of another
length than most (of equally frequent lengths the larger).

**Pivot permutations.** Reference vectors (pivots) come from a bounded sample, none close to another, so that a dense
group cannot supply all the pivots near it. A vector is described by its ``prefix`` nearest pivots in order; vectors
of a label with the same nearest pivot and the same others behind it form a cell. Inverted lists say which cells hold a pivot: as cells are to have at least ``shared``
pivots in common, a list stands for so many of them together, and the lists on which two cells meet count what they share (s common pivots meet
on as many lists as there are choices of ``shared`` among s). Two cells are candidates if they share more than ``shared`` pivots, or just so many with the nearest pivot
of either among them: there the order of the permutation decides, as a pivot that is nearest to one of two close vectors is seldom far behind for the other.
Exact copies are collapsed first and counted. The number of pivots grows with the cube root of that of vectors,
which keeps the lists of three about as long at any size, and the prefix with the pivots; a list that is long all the same
meets itself in pairs of blocks, so no task has a whole one. Candidates are verified exactly, in double precision, block of a cell
against block of a cell.

**Anisotropic codes.** A vector is coded by its offset from the nearest of a bounded number of centres: the offset's direction in codes, its
length and what the centre adds as numbers beside them, so that the error of a score is small against the differences within a dense group, however near each other
its vectors are. A codebook of 16 words for every pair of dimensions is fitted to the directions of a bounded sample so as to minimise a
loss in which the part of the residual that is parallel to the direction weighs ``eta`` times the rest: that part is what
changes the largest inner products. Codes are four bits; a query scores all codes by its table of 16 inner products
for each pair and its distances from the centres; the best are reranked exactly. Queries and codes meet in a grid: a cell of it has one block of queries and one of codes.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import components, written


def usable(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """((key, v array<double>, other columns), their number): rows with a key whose vector can be compared."""
    v = F.col(column).cast("array<double>")
    fine = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.coalesce(fine, F.lit(False))).withColumn("v", v).drop(column)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0)), usual["count"] if usual else 0


def matrix(column: pd.Series | pa.Array) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    rows = np.stack(column.to_numpy()) if isinstance(column, pd.Series) else column.flatten().to_numpy().reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _sample(rows: DataFrame, key: str, most: int) -> np.ndarray:
    """At most ``most`` unit vectors, those with the smallest hash of their key."""
    some = rows.select(key, "v").orderBy(F.xxhash64(key, F.lit(3)), key).limit(most).toPandas()  # a fixed number of rows
    return matrix(some["v"]) if len(some) else np.zeros((0, 1))


def _pivots(rows: DataFrame, key: str, most: int, apart: float = 0.8) -> np.ndarray:
    """At most ``most`` vectors of a sample of four times as many, none with a cosine over ``apart`` to one before it."""
    sample, n = _sample(rows, key, 4 * most), 0
    kept = np.zeros((most, sample.shape[1]))
    for x in sample:
        if n < most and not (n and (kept[:n] @ x).max() > apart):
            kept[n] = x
            n += 1
    return kept[:n]


def index_size(vectors: int, least: int = 256, most: int = 4096, length: int = 64) -> tuple[int, int]:
    """(number of pivots, prefix) for a number of vectors: about ``length`` entries on a list of three pivots of eight, were all alike frequent."""
    pivots = min(most, max(least, int(np.ceil((336 * vectors / length) ** (1 / 3)))))
    return pivots, 8 + 2 * max(0, int(np.ceil(np.log2(pivots / 512))))


def _candidates(lists: DataFrame, list_block: int, shared: int) -> DataFrame:
    """(cell_id, other_id, lists): the cells that meet on lists (label, list), each pair once, and on how many; a long list meets itself block by block.

    A pair that shares no more than ``shared`` pivots (then it meets on one list) needs the nearest pivot of either among them.
    """
    many = lists.groupBy("label", "list").agg(F.ceil(F.count("*") / list_block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    dealt = lists.join(many, ["label", "list"]).withColumn("own", F.pmod(F.xxhash64("cell_id"), "blocks").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "list", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own", "cell_id", "nearest")
    other = dealt.withColumnsRenamed({"cell_id": "other_id", "own": "other_own", "nearest": "other_nearest"})
    met = dealt.join(other, ["label", "list", "lo", "hi"]).where("cell_id < other_id AND (lo = hi OR own <> other_own)")
    counted = met.groupBy("cell_id", "other_id").agg(F.count("*").alias("lists"), F.bool_or("nearest").alias("a"), F.bool_or("other_nearest").alias("b"))
    return counted.where((F.col("lists") > shared) | F.col("a") | F.col("b")).select("cell_id", "other_id", "lists")


def linked(df: DataFrame, threshold: float = 0.93, pivots: int | None = None, prefix: int | None = None, shared: int = 3, block: int = 512, together: int = 64, list_block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row with a vec_id.

    Links join rows with equal labels and a cosine of at least ``threshold`` that share more than ``shared`` of their ``prefix``
    nearest pivots, or ``shared`` with the nearest of either among them. Rows that repeat a vec_id are vectors of their own that count for it; a null label links nothing.
    """
    rows, n_rows = usable(df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where("label IS NOT NULL"))
    usual = index_size(n_rows)
    pivots, prefix = pivots or usual[0], prefix or usual[1]
    reference = df.sparkSession.sparkContext.broadcast(_pivots(rows, "vec_id", pivots))
    n_pivots = len(reference.value)
    top, need = min(prefix, n_pivots), min(shared, n_pivots)

    def describe(batches):
        for batch in batches:
            if batch.num_rows:
                unit = matrix(batch.column("v"))
                order = np.argsort(-(unit @ reference.value.T), axis=1, kind="stable")[:, :top].astype(np.int32)
                cell = np.concatenate([order[:, :1], np.sort(order[:, 1:], axis=1)], axis=1)  # the nearest pivot, then those behind it
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in unit]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digest, pa.binary()), pa.array(list(cell), pa.list_(pa.int32())), pa.array(list(unit), pa.list_(pa.float64()))], ["vec_id", "label", "digest", "cell", "unit"])

    label_type = dict(rows.dtypes)["label"]
    described = written(rows.select("vec_id", "label", "v").mapInArrow(describe, f"vec_id long, label {label_type}, digest binary, cell array<int>, unit array<double>"), "permutations")
    copies = written(described.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "copies")
    first = described.join(copies, ["label", "digest"]).where("vec_id = rep").withColumn("cell_id", F.xxhash64("label", "cell"))
    indexed = written(first.dropDuplicates(["vec_id", "label", "digest"]).select("vec_id", "label", "m", "cell", "cell_id", "unit"), "vectors")
    cells = written(indexed.groupBy("label", "cell_id", "cell").agg(F.count("*").alias("n")), "cells")

    def combine(batches):
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            sets = [list(combinations(sorted(cell), need)) for cell in cells]
            nearest = [cell[0] in some for cell, part in zip(cells, sets) for some in part]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            keys = np.array([x for part in sets for x in part], np.int64).reshape(-1, need) @ (max(1, n_pivots) ** np.arange(need))
            yield pa.RecordBatch.from_arrays([batch.column("label").take(at), batch.column("cell_id").take(at), pa.array(keys, pa.int64()), pa.array(nearest, pa.bool_())], ["label", "cell_id", "list", "nearest"])

    lists = written(cells.select("label", "cell_id", "cell").mapInArrow(combine, f"label {label_type}, cell_id long, list long, nearest boolean"), "lists") if need else cells.select("label", "cell_id", F.lit(0).alias("list"), F.lit(True).alias("nearest")).limit(0)
    pairs = written(_candidates(lists, list_block, need).select("cell_id", "other_id"), "candidates").union(cells.select("cell_id", F.col("cell_id").alias("other_id")))

    #: A cell's vectors are dealt into blocks of about ``block``; each pair of blocks meets once. A unit is a left block and about
    #: ``together`` / 4 blocks' worth of the vectors it meets, however many candidates its cell has; a group holds about ``together`` units and
    #: about as many vectors as one unit's most, so that neither a dense cell nor a dense label makes it larger.
    most = block * max(1, together // 4)
    sizes = cells.select("cell_id", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    others = sizes.select(F.col("cell_id").alias("other_id"), F.col("n").alias("other_n"), F.col("blocks").alias("other_blocks"))
    pairs = pairs.join(others, "other_id")
    chunks = written(pairs.groupBy("cell_id").agg(F.sum("other_n").alias("reach")).join(sizes, "cell_id").withColumn("chunks", F.ceil(F.col("reach") / most).cast("int")), "chunks")
    units, rows_met = chunks.agg(F.sum(F.col("blocks") * F.col("chunks")), F.sum(F.col("n") * F.col("chunks") + F.col("blocks") * F.col("reach"))).first()
    groups = (units or 0) // together + (rows_met or 0) // most + 1
    tasks = pairs.join(chunks.select("cell_id", "blocks", "chunks"), "cell_id")
    tasks = tasks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))).where("cell_id <> other_id OR i < j")
    tasks = written(tasks.select("cell_id", "i", F.pmod(F.xxhash64("other_id", "j"), "chunks").cast("int").alias("c"), "other_id", "j"), "block_pairs")
    dealt = written(indexed.join(chunks.select("cell_id", "blocks", "chunks"), "cell_id").select("cell_id", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("i"), "chunks", "vec_id", "m", "unit"), "dealt")
    group = F.pmod(F.xxhash64("cell_id", "i", "c"), F.lit(groups)).cast("int").alias("g")
    columns = ["g", "cell_id", "i", "c", "side", "vec_id", "m", "unit"]
    left = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(group, "cell_id", "i", "c", F.lit(0).alias("side"), "vec_id", "m", "unit")
    theirs = dealt.select(F.col("cell_id").alias("other_id"), F.col("i").alias("j"), "vec_id", "m", "unit")
    right = tasks.join(theirs, ["other_id", "j"]).select(group, "cell_id", "i", "c", F.lit(1).alias("side"), "vec_id", "m", "unit")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, m = matrix(pdf["unit"]), pdf["m"].to_numpy()
        own = pdf["side"].to_numpy() == 0
        parts = pdf.assign(at=np.arange(len(pdf))).groupby(["cell_id", "i", "c"], sort=False)["at"]
        nodes, place = np.unique(pdf["vec_id"].to_numpy(), return_inverse=True)
        counts, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))

        def meet(a, b, same=False):
            nonlocal root
            hit = unit[a] @ unit[b].T >= threshold
            if same:
                np.fill_diagonal(hit, False)
            x, y = np.nonzero(hit)
            if not len(x):
                return
            np.add.at(counts, place[a], hit @ m[b])
            if not same:
                np.add.at(counts, place[b], m[a] @ hit)
            x, y = place[a[x]], place[b[y]]
            while (apart := root[x] != root[y]).any():  # a larger root hangs on a smaller one that a link reaches
                x, y = x[apart], y[apart]
                np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
                while (root != root[root]).any():
                    root = root[root]

        for (_, _, c), at in parts:
            at = at.to_numpy()
            mine, far = at[own[at]], at[~own[at]]
            for lo in range(0, len(mine), block):
                some = mine[lo : lo + block]
                if c == 0:
                    meet(some, some, True)
                    for to in range(lo + block, len(mine), block):
                        meet(some, mine[to : to + block])
                for to in range(0, len(far), block):
                    meet(some, far[to : to + block])
        return pd.DataFrame({"vec_id": nodes, "n": counts, "to": nodes[root]}).query("n > 0")

    found = written(left.unionByName(right).select(columns).groupBy("g").applyInPandas(verify, "vec_id long, n long, to long"), "links")
    number = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    joined = components(found.where("vec_id <> to").select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    classes = number.join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "full").select(F.col("vec_id").alias("rep"), "n", "component")
    each = described.select("vec_id", "label", "digest").join(copies, ["label", "digest"]).join(classes, "rep", "left")
    each = each.groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    everyone = df.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    component = F.coalesce("component", "vec_id")
    return everyone.join(each, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


class Codebooks:
    """16 codewords for every pair of dimensions, fitted to unit vectors under the anisotropic loss."""

    def __init__(self, sample: np.ndarray, eta: float = 4.0, passes: int = 8, seed: int = 0):
        n, d = sample.shape
        self.dims = d + d % 2
        x = self._padded(sample)
        self.m, self.eta = self.dims // 2, eta
        pick = np.random.default_rng(seed)
        self.words = np.stack([x[pick.choice(n, 16, replace=n < 16), 2 * j : 2 * j + 2] for j in range(self.m)])
        for _ in range(passes):
            codes = self.encode(sample)
            total = ((x - self.decoded(codes)) * x).sum(1)
            for j in range(self.m):
                total = self._refit(x, codes, j, total)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.dims - x.shape[1])))

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (one number below 16 for each pair): each pair's best word given the others, in ``sweeps`` rounds.

        With the residual e and the unit vector x the loss is |e|**2 + (eta - 1) * (e . x)**2.
        """
        x = self._padded(vectors)
        codes = np.zeros((len(x), self.m), np.uint8)
        parallel = np.zeros((len(x), self.m))
        for sweep in range(sweeps):
            total = parallel.sum(1)
            for j in range(self.m):
                part = x[:, 2 * j : 2 * j + 2]
                rest = total - parallel[:, j]
                residual = part[:, None, :] - self.words[j][None]
                along = (residual * part[:, None, :]).sum(2)
                loss = (residual**2).sum(2) + (self.eta - 1) * ((rest[:, None] if sweep else 0.0) + along) ** 2
                codes[:, j] = loss.argmin(1)
                parallel[:, j] = along[np.arange(len(x)), codes[:, j]]
                total = rest + parallel[:, j]
        return codes

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[j][codes[:, j]] for j in range(self.m)], 1)

    def _refit(self, x: np.ndarray, codes: np.ndarray, j: int, total: np.ndarray) -> np.ndarray:
        """The words of pair j that minimise the loss with all other pairs fixed: a 2 x 2 system for each word.

        ``total`` holds the inner products of residuals and vectors, and is returned as it is with the new words.
        """
        own = slice(2 * j, 2 * j + 2)
        rest = total - ((x[:, own] - self.words[j][codes[:, j]]) * x[:, own]).sum(1)
        for k in range(16):
            at = np.flatnonzero(codes[:, j] == k)
            if len(at):
                p = x[at, own]
                a = len(at) * np.eye(2) + (self.eta - 1) * p.T @ p
                b = p.sum(0) + (self.eta - 1) * (p * (rest[at] + (p * p).sum(1))[:, None]).sum(0)
                self.words[j][k] = np.linalg.solve(a, b)
        return rest + ((x[:, own] - self.words[j][codes[:, j]]) * x[:, own]).sum(1)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two codes in a byte."""
        even = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
        return even[:, ::2] | even[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): inner products for every value of a byte of codes."""
        q = self._padded(queries).reshape(len(queries), self.m, 2)
        small = np.einsum("qjd,jkd->qjk", q, self.words).astype(np.float32)
        if self.m % 2:
            small = np.concatenate([small, np.zeros((len(q), 1, 16), np.float32)], 1)
        return (small[:, 1::2, :, None] + small[:, ::2, None, :]).reshape(len(q), -1, 256)


class Centres:
    """Reference points: the first rows of a sample, moved to the means of what is nearest to them."""

    def __init__(self, sample: np.ndarray, most: int, rounds: int = 4):
        self.points = sample[: max(1, most)].copy()
        for _ in range(rounds):
            at = self.of(sample)
            n, sums = np.bincount(at, minlength=len(self.points)), np.zeros_like(self.points)
            np.add.at(sums, at, sample)
            self.points[n > 0] = sums[n > 0] / n[n > 0, None]

    def of(self, vectors: np.ndarray, rows: int = 4096) -> np.ndarray:
        """The number of each vector's nearest point."""
        half = (self.points**2).sum(1) / 2
        return np.concatenate([(vectors[lo : lo + rows] @ self.points.T - half).argmax(1) for lo in range(0, max(1, len(vectors)), rows)])

    def offsets(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest point, length of the offset from it, its direction or zeros)."""
        at = self.of(vectors)
        offset = vectors - self.points[at]
        length = np.sqrt((offset * offset).sum(1))
        return at, length, offset / np.where(length > 0, length, 1)[:, None]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances from all points, from differences, so that small ones are right."""
        return np.stack([((self.points - x) ** 2).sum(1) for x in vectors])


#: A coded vector: its centre, its distance from that, and the inner product of the centre and the decoded direction; then the codes.
HEAD = [("centre", "<i4"), ("length", "<f4"), ("along", "<f4")]


def encoded(centres: Centres, books: Codebooks, unit: np.ndarray) -> np.ndarray:
    """Unit vectors as records of HEAD and codes."""
    at, length, direction = centres.offsets(unit)
    codes = books.encode(direction)
    packed = books.packed(codes)
    out = np.zeros(len(unit), [*HEAD, ("code", np.uint8, (packed.shape[1],))])
    out["centre"], out["length"], out["code"] = at, length, packed
    out["along"] = (books.decoded(codes)[:, : unit.shape[1]] * centres.points[at]).sum(1)
    return out


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, vectors) by looking codes up in the queries' tables."""
    out = np.zeros((len(tables), len(packed)), np.float32)
    for j in range(packed.shape[1]):
        out += tables[:, j, :][:, packed[:, j]]
    return out


def nearness(tables: np.ndarray, distances: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Approximate squared distances (queries, vectors) with the sign turned: those of the query and the vector's centre, and what the offset adds."""
    length = coded["length"]
    return 2 * length * (scan(tables, coded["code"]) - coded["along"]) - length * length - distances.astype(np.float32)[:, coded["centre"]]


def best_of(about: np.ndarray, ids: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, approximate score): for each query the ``most`` best codes not of its own id, with ties at the cut."""
    about[own[:, None] == ids[None, :]] = -np.inf
    if len(ids) > most:
        cut = np.partition(about, len(ids) - most, axis=1)[:, len(ids) - most]
        query, code = np.nonzero((about >= cut[:, None]) & (about > -np.inf))
    else:
        query, code = np.nonzero(about > -np.inf)
    return query, code, about[query, code]


def nearest(df: DataFrame, k: int = 5, every: int = 50, sample: int = 4000, rerank: int = 300, queries_block: int = 2048, codes_block: int = 1 << 18, centres: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine for every row whose vec_id is divisible by ``every``.

    Centres (a hundredth of the rows, but 16 at least and an eighth of the sample at most) and codebooks come from ``sample`` rows.
    All codes are scanned for every query, in cells of at most about ``queries_block`` queries and ``codes_block`` codes, which travel packed.
    Codes are dealt by a hash, so a cell has about its share of a query's ``rerank`` best; it gives twice that share (and 8 at least) by approximate
    score, ties included, which keeps what all cells give in proportion to the queries. Over all cells the best ``rerank`` are cut out, with ties,
    and the exact cosines of these decide. Of exact copies the k + 1 with the smallest vec_id
    are scanned, as no others can be among the k nearest.
    Rows that repeat a vec_id are one candidate (the nearest of them). No row of the query's own vec_id counts.
    """
    rows, n_rows = usable(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    if not n_rows:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = _sample(rows, "vec_id", sample)
    points = Centres(some, centres or min(max(16, n_rows // 100), max(1, len(some) // 8)))
    _, length, direction = points.offsets(some)
    books = Codebooks(direction[length > 0] if (length > 0).any() else some)
    fitted = df.sparkSession.sparkContext.broadcast((points, books))

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                unit = matrix(batch.column("v"))
                columns = ([x.tobytes() for x in encoded(*fitted.value, unit)], [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in unit])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(c, pa.binary()) for c in columns), pa.array(list(unit), pa.list_(pa.float64()))], ["vec_id", "code", "digest", "unit"])

    coded = written(rows.select("vec_id", "v").mapInArrow(code, "vec_id long, code binary, digest binary, unit array<double>"), "codes")
    asked = coded.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "digest"])
    n_codes = max(1, -(-n_rows // min(codes_block, max(2048, n_rows // 16))))
    n_queries = max(1, -(-asked.count() // queries_block))
    first = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    some = coded.select("vec_id", "code", "digest").dropDuplicates(["vec_id", "digest"]).withColumn("nth", first).where(F.col("nth") <= k + 1)

    def packed(rows: DataFrame, name: str, by: str, n: int, column: str, other: str, n_other: int, side: int) -> DataFrame:
        """One row for each block of rows and each block of the other side."""

        def pack(part: pa.Table) -> pa.Table:
            data = part.column(column).combine_chunks()
            data = np.array(data.flatten()).tobytes() if pa.types.is_list(data.type) else b"".join(data.to_pylist())
            return pa.Table.from_pydict({by: part.column(by).slice(0, 1), "ids": [part.column("vec_id").to_numpy().tobytes()], "data": [data]}, pa.schema([(by, pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        dealt = rows.select("vec_id", column, F.pmod(F.xxhash64("vec_id", "digest"), F.lit(n)).cast("int").alias(by))
        blocks = written(dealt.groupBy(by).applyInArrow(pack, f"{by} int, ids binary, data binary"), name)
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).select("qb", "cb", F.lit(side).alias("side"), "ids", "data")

    ours = packed(some, "code_blocks", "cb", n_codes, "code", "qb", n_queries, 0)
    theirs = packed(asked, "query_blocks", "qb", n_queries, "unit", "cb", n_codes, 1)

    share = max(8, -(-2 * rerank // n_codes)) if n_codes > 1 else rerank

    def look(part: pa.Table) -> pa.Table:
        sides = {r["side"]: (np.frombuffer(r["ids"], np.int64), r["data"]) for r in part.to_pylist()}
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if len(sides) == 2:
            (ids, codes), (queries, units) = sides[0], sides[1]
            points, books = fitted.value
            coded = np.frombuffer(codes, [*HEAD, ("code", np.uint8, (len(codes) // len(ids) - 12,))])
            units = np.frombuffer(units).reshape(len(queries), -1)
            for lo in range(0, len(queries), 16):
                own, unit = queries[lo : lo + 16], units[lo : lo + 16]
                query, code, about = best_of(nearness(books.tables(unit), points.distances(unit), coded), ids, own, share)
                found.append((own[query], ids[code], about))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "about"])

    seen = ours.union(theirs).groupBy("qb", "cb").applyInArrow(look, "query_id long, vec_id long, about float")
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("about")))
    best = written(seen.withColumn("place", place).where(F.col("place") <= rerank).select("query_id", "vec_id").distinct(), "scanned")
    full = coded.select("vec_id", "unit")
    pairs = best.join(full, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("unit").alias("q")), "query_id")
    score = F.aggregate(F.zip_with("unit", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    best = pairs.select("query_id", "vec_id", score.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", nth.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
