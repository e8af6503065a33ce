"""A head of two layers on frozen features: a pooling layer, then a classifier.

Every step is one job: the weights go out with the tasks, each task sums the gradient over its rows of
the step's batch, one vectorised pass per Arrow batch, and the sums, as many numbers as the head has
weights, come back. The number of steps is given, so the cost is. Sums travel as whole numbers of a
fixed point, so a fit does not depend on the order in which they are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import materialize

#: Fixed-point steps of one unit of the mean gradient.
_SCALE = 2.0**40


def _layers(weights: np.ndarray, wide: int, hidden: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    cut = (wide + 1) * hidden
    return weights[:cut].reshape(wide + 1, hidden), weights[cut:].reshape(hidden + 1, classes)


def _forward(rows: np.ndarray, pool: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values and class probabilities."""
    held = np.tanh(rows @ pool[1:] + pool[0])
    raw = held @ last[1:] + last[0]
    raw -= raw.max(axis=1, keepdims=True)
    odds = np.exp(raw)
    return held, odds / odds.sum(axis=1, keepdims=True)


def gradient(weights: np.ndarray, rows: np.ndarray, truth: np.ndarray, hidden: int, classes: int) -> np.ndarray:
    """The summed gradient of the cross entropy, and the summed loss as its last number."""
    pool, last = _layers(weights, rows.shape[1], hidden, classes)
    held, odds = _forward(rows, pool, last)
    here = np.arange(len(rows))
    loss = -np.log(np.maximum(odds[here, truth], 1e-300)).sum()
    wrong = odds.copy()
    wrong[here, truth] -= 1.0
    down = (wrong @ last[1:].T) * (1.0 - held**2)
    parts = [down.sum(axis=0), (rows.T @ down).ravel(), wrong.sum(axis=0), (held.T @ wrong).ravel(), [loss]]
    return np.concatenate(parts)


@dataclass(frozen=True)
class TwoLayerHead:
    """A fitted head; ``losses`` has the mean loss of every step's batch."""

    labels: list
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    hidden: int
    losses: list[float]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        rows = (rows - self.centre) / self.spread
        return _forward(rows, *_layers(self.weights, rows.shape[1], self.hidden, len(self.labels)))[1]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def train_two_layer_head(
    train: DataFrame,
    features: str = "features",
    label: str = "label",
    hidden: int = 32,
    steps: int = 60,
    batches: int = 1,
    rate: float = 0.05,
    ridge: float = 1e-4,
    seed: int = 42,
) -> TwoLayerHead:
    """Fit by ``steps`` gradient steps (Adam), each over one of ``batches`` parts of the rows, dealt by a hash.

    Rows without a label or features are left out; all features have one length. Labels, two numbers per
    feature and the gradient sums come to the driver.
    """
    spark = train.sparkSession
    known = train.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    rows = known.select(
        F.col(label).alias("y"),
        F.col(features).cast("array<double>").alias("x"),
        F.pmod(F.xxhash64(features), F.lit(batches)).cast("int").alias("part"),
    )
    rows = materialize(rows, "head-rows")
    labels = [r[0] for r in rows.select("y").distinct().orderBy("y").collect()]
    shape = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).orderBy("i").collect()
    sizes = dict(rows.groupBy("part").count().collect())
    if not labels:
        raise ValueError("a head needs labelled rows")
    # In few digits, which do not depend on the order of the sums.
    centre = np.array([r[1] for r in shape], np.float32).astype(np.float64)
    spread = np.maximum(np.array([r[2] for r in shape], np.float32).astype(np.float64), 1e-9)
    number = {value: i for i, value in enumerate(labels)}
    wide, classes = len(shape), len(labels)
    pick = np.random.default_rng(seed)
    pool = np.vstack([np.zeros(hidden), pick.normal(0, 1 / np.sqrt(max(1, wide)), (wide, hidden))])
    last = np.vstack([np.zeros(classes), pick.normal(0, 1 / np.sqrt(hidden), (hidden, classes))])
    weights = np.concatenate([pool.ravel(), last.ravel()])
    mean, square, losses = np.zeros_like(weights), np.zeros_like(weights), []

    def summed(now: np.ndarray, count: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now) + 1)
            for batch in batches:
                truth = np.array([number[y] for y in batch.column("y").to_pylist()], np.int64)
                total += gradient(now, (_matrix(batch.column("x")) - centre) / spread, truth, hidden, classes)
            whole = np.rint(total / count * _SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole)], ["i", "g"])

        return run

    for step in range(steps):
        part = step % batches
        if not sizes.get(part):
            continue
        sums = rows.where(F.col("part") == part).select("y", "x").mapInArrow(summed(weights, sizes[part]), "i int, g long")
        found = sums.groupBy("i").agg(F.sum("g").alias("g")).toPandas()
        got = np.zeros(len(weights) + 1)
        got[found["i"].to_numpy()] = found["g"].to_numpy() / _SCALE
        losses.append(float(got[-1]))
        slope = got[:-1] + ridge * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        sure, size = mean / (1 - 0.9 ** (step + 1)), square / (1 - 0.999 ** (step + 1))
        weights = weights - rate * sure / (np.sqrt(size) + 1e-8)
    return TwoLayerHead(labels, centre, spread, weights, hidden, losses)


def apply_two_layer_head(head: TwoLayerHead, df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``scores``, the class probabilities in the order of ``head.labels``; null where there are no
    features. Row-local, in Arrow batches."""

    def run(values: pa.Array) -> pa.Array:
        known = values.is_valid().to_numpy(zero_copy_only=False)
        out: list = [None] * len(values)
        if known.any():
            scores = head.probabilities(_matrix(values.drop_null())).tolist()
            for i, row in zip(np.flatnonzero(known).tolist(), scores):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return df.withColumn("scores", F.arrow_udf(run, "array<double>")(F.col(features).cast("array<double>")))
