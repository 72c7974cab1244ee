"""Quality scores from a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

The n-grams are the runs of one to three bytes of the text, hashed into a fixed number of features; an indicator says that one occurs. Over the labelled rows learnt from
Spark counts in how many documents of each class every feature occurs; the ratio of the smoothed, normalised counts
gives r. A text is the vector of r over its features, scaled to length one, and a linear hinge-loss model is fitted
to such vectors by dual coordinate descent. The margin goes through a logistic line fitted on the same rows.

The counts are taken over about ``learn_rows`` labelled rows outside the held-out fold, chosen by a hash of doc_id, and
the hinge-loss model is fitted on about ``fit_rows`` of them; every document is scored whole.

Defined cases: null and empty texts have no feature and get the score of the shift alone; label rows whose label is
null or whose doc_id has no document are ignored, repeated ones count once (the largest label); rows with a null
doc_id are scored; with no labels at all every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import mix64, texts, written
from gristmill.llm.toxicity import _logistic, _some, held_out, training_rows

BITS = 16


class Grams:
    """Distinct hashed n-grams of each of several texts at once."""

    def __init__(self, most: int = 3, bits: int = BITS):
        self.most, self.bits = most, bits
        self.seen = np.zeros(1 << bits, np.int64)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        wide = data.astype(np.uint64)
        ids, value = [], np.zeros(len(data), np.uint64)
        for k in range(self.most):
            n = len(data) - k
            value = (value[:n] << np.uint64(8) | wide[k:]) if n > 0 else value[:0]
            ids.append((mix64(value + np.uint64((k + 1) << 56)) >> shift).astype(np.int64))
        out = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            mine = np.concatenate([ids[k][lo : max(lo, hi - k)] for k in range(self.most)])
            self.seen[mine] = np.arange(len(mine))
            out.append(mine[self.seen[mine] == np.arange(len(mine))])
        return out


def log_count_ratio(good: np.ndarray, bad: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = good + alpha, bad + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, passes: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and shift of the hinge-loss model over vectors r[row] scaled to length one, y of -1 and 1.

    The dual has a box 0 <= a <= cost for each row; a pass visits the rows in a fixed shuffled order and moves each a to
    the minimum along its coordinate, keeping w = sum of a * y * x up to date. The shift is a constant feature.
    """
    values = []
    for row in rows:
        x = r[row]
        values.append(x / max(np.sqrt((x * x).sum()), 1e-12))
    w, shift, a = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(rows)).tolist():
            row, x = rows[i], values[i]
            gradient = y[i] * (w[row] @ x + shift) - 1.0
            new = min(max(a[i] - gradient / (1.0 + float(len(row) > 0)), 0.0), cost)
            step = new - a[i]
            if step:
                w[row] += step * y[i] * x
                shift += step * y[i]
                a[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, shift


class Model:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray, shift: float, line: tuple[float, float]):
        self.weights, self.ratio, self.shift, self.line = weights, ratio, shift, line

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        product, square = self.weights * self.ratio, self.ratio**2
        return np.array([product[x].sum() / max(np.sqrt(square[x].sum()), 1e-12) + self.shift for x in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.line[0] * self.margins(rows) + self.line[1], -50, 50)))


def _rows(column: pa.Array, grams: Grams) -> list[np.ndarray]:
    return [x for _, _, data, offsets in texts(column) for x in grams.of(data, offsets)]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", learn_rows: int = 20_000, fit_rows: int = 6000, fit_features: int = 20_000_000, cost: float = 1.0) -> Model:
    """The model from the labelled rows outside the held-out fold.

    The hinge-loss fit takes about ``fit_rows`` rows, or fewer where these have more than ``fit_features`` features in all (four bytes each on the driver).
    """
    total = labels.count()
    rows = training_rows(docs, labels, label, total, learn_rows).select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y"))

    def count(batches):
        grams, held = Grams(), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for x, y in zip(_rows(batch.column(1), grams), batch.column(2).to_pylist()):
                held[y][x] += 1
        used = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[0][used]), pa.array(held[1][used])], ["f", "bad", "good"])

    counts = rows.mapInArrow(count, "f int, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # 2**BITS rows at most
    bad, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bad[counts["f"]], good[counts["f"]] = counts["bad"], counts["good"]
    ratio = log_count_ratio(good, bad)

    def vectors(batches):
        grams = Grams()
        for batch in batches:
            made = [x.astype(np.int32) for x in _rows(batch.column(1), grams)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(x) for x in made], pa.list_(pa.int32())), batch.column(2)], ["doc_id", "x", "y"])

    some = written(_some(rows, total, fit_rows).mapInArrow(vectors, "doc_id long, x array<int>, y int"), "fit_rows")
    features = some.agg(F.sum(F.size("x"))).first()[0] or 0
    fit = _some(some, features, fit_features, seed=8).toArrow()  # bounded in rows and in features
    order = np.argsort(fit.column("doc_id").to_numpy(), kind="stable")
    x = [v.values.to_numpy() if v.is_valid else np.zeros(0, np.int32) for v in fit.column("x")]
    x, y = [x[i] for i in order], fit.column("y").to_numpy()[order].astype(float)
    weights, shift = dual_descent(x, np.where(y > 0, 1.0, -1.0), ratio, cost)
    model = Model(weights, ratio, shift, (1.0, 0.0))
    model.line = _logistic(model.margins(x), y) if len(x) else (1.0, 0.0)
    return model


def scored(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2**BITS numbers

    def run(batches):
        grams = Grams()
        for batch in batches:
            score = shared.value.scores(_rows(batch.column(1), grams)) if batch.num_rows else np.zeros(0)
            held = held_out(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
