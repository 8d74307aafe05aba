"""MLlib's multilayer perceptron, its gradients taken by matrix products on blocks of rows in Arrow batches.

Parameters, first weights, loss, optimizer, stopping rule and model are MLlib's. What differs: MLlib takes the mean over
blocks of 128 rows and counts the short last block of a part as much as a full one; here each row counts once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored

BLOCK_ROWS, BLOCK_BYTES = 500, 8_000_000
CLOSE_PARTS = 64  # sums of more parts than these are added up by tasks before the driver adds the rest
NO_FOLD = -1
SUMS = "fold int, loss double, n bigint, gradient binary"
Search = Generator[np.ndarray, tuple[float, np.ndarray], tuple]  # asks for the value and gradient at points


class BlockPerceptron(MultilayerPerceptronClassifier):
    """A ``MultilayerPerceptronClassifier`` that fits on blocks; only the solver ``gd`` is left to MLlib."""

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        return self._model(self._trained(dataset, F.lit(NO_FOLD), [0])[0], dataset)

    def fit_folds(self, dataset: DataFrame, fold: str, folds: list[int]) -> list[MultilayerPerceptronClassificationModel]:
        """A model per fold, fitted without its rows. All step together, so a scan serves the gradients of all."""
        def rest(f: int) -> DataFrame:
            return dataset.where(F.col(fold) != f)

        if self.getSolver() != "l-bfgs":
            return [self.fit(rest(f)) for f in folds]
        weights = self._trained(dataset.where(F.col(fold).isNotNull()), F.col(fold).cast("int"), folds)
        return [self._model(weights[f], rest(f)) for f in folds]

    def _trained(self, dataset: DataFrame, fold: Column, folds: list[int]) -> dict[int, np.ndarray]:
        layers, start = self.getLayers(), self._first_weights(dataset)
        # Written once: a scan per step is planned from its file, not from all that made the rows.
        blocks = stored(pack(dataset, self.getFeaturesCol(), self.getLabelCol(), fold, layers), "blocks").persist()
        try:
            parts = blocks.rdd.getNumPartitions()
            searches = {f: minimise(start, self.getMaxIter(), self.getTol()) for f in folds}
            ended = together(searches, lambda points: mean_gradients(blocks, parts, layers, points))
            return {f: weights for f, (weights, _) in ended.items()}
        finally:
            blocks.unpersist()

    def _model(self, weights: np.ndarray, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        """The model of these weights, made by MLlib's fit, which takes no step from them."""
        return self._copyValues(self._create_model(self._standing(weights)._fit_java(dataset)))

    def _standing(self, weights: np.ndarray | None = None) -> BlockPerceptron:
        return self.copy({self.maxIter: 0, **({} if weights is None else {self.initialWeights: Vectors.dense(weights)})})

    def _first_weights(self, dataset: DataFrame) -> np.ndarray:
        """The weights given, or those that MLlib draws."""
        if self.isSet(self.initialWeights):
            return self.getInitialWeights().toArray()
        row = (Vectors.dense([0.0] * self.getLayers()[0]), 0.0)
        one = dataset.sparkSession.createDataFrame([row], [self.getFeaturesCol(), self.getLabelCol()])
        return self._create_model(self._standing()._fit_java(one)).weights.toArray()


def pack(dataset: DataFrame, features: str, label: str, fold: Column, layers: list[int]) -> DataFrame:
    """The rows as blocks of one fold each: a matrix with a line per feature, one of ones and one of labels."""
    rows = dataset.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), fold.alias("fold"))
    return rows.mapInArrow(partial(_packed, layers[0], layers[-1]), "fold int, block binary")


def _packed(width: int, classes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (width + 2))))
    for batch in batches:
        x, y, folds = batch.column(0), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        if x.null_count or not (x.value_lengths().to_numpy(zero_copy_only=False) == width).all():
            raise ValueError(f"features must be vectors of {width} numbers, as the first layer")
        if not ((y >= 0) & (y < classes) & (y == np.floor(y))).all():
            raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}, as the last layer")
        lines = np.vstack([x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), width).T, np.ones(len(y)), y])
        for fold in np.unique(folds):
            held = lines[:, folds == fold]
            for at in range(0, held.shape[1], size):
                yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.int32()),
                                                  "block": pa.array([held[:, at:at + size].tobytes()], pa.binary())})


def together(searches: dict[int, Search], evaluate: Callable[[dict], dict]) -> dict[int, tuple]:
    """Runs searches side by side: each round evaluates the points that all of them ask for."""
    points, ended = {key: next(search) for key, search in searches.items()}, {}
    while points:
        found = evaluate(points)
        for key in list(points):
            try:
                points[key] = searches[key].send(found[key])
            except StopIteration as end:
                ended[key] = end.value
                del points[key]
    return ended


def mean_gradients(blocks: DataFrame, parts: int, layers: list[int],
                   points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """For each fold the mean loss of all other rows at its weights and the gradient, in one scan."""
    sums = blocks.mapInArrow(partial(_sums, layers, points), SUMS)
    if parts > CLOSE_PARTS:
        sums = sums.repartition(isqrt(parts)).mapInArrow(_added, SUMS)
    totals = {fold: (0.0, 0, np.zeros(len(weights))) for fold, weights in points.items()}
    for fold, *row, gradient in sums.collect():
        totals[fold] = _plus(totals[fold], (*row, np.frombuffer(gradient)))
    return {fold: (loss / n, gradient / n) if n else (np.nan, gradient) for fold, (loss, n, gradient) in totals.items()}


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _rows(totals: dict[int, tuple[float, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "fold": pa.array(list(totals), pa.int32()), "loss": pa.array([t[0] for t in totals.values()], pa.float64()),
        "n": pa.array([t[1] for t in totals.values()], pa.int64()),
        "gradient": pa.array([t[2].tobytes() for t in totals.values()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = {}
    for batch in batches:
        for fold, loss, n, gradient in zip(*(column.to_pylist() for column in batch.columns)):
            totals[fold] = _plus(totals.get(fold, (0.0, 0, 0.0)), (loss, n, np.frombuffer(gradient)))
    yield _rows(totals)


def _sums(layers: list[int], points: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    networks = {fold: Network(layers, weights) for fold, weights in points.items()}
    totals = {fold: (0.0, 0) for fold in points}
    for batch in batches:
        blocks = [(fold, np.frombuffer(block.as_buffer()).reshape(layers[0] + 2, -1))
                  for fold, block in zip(batch.column(0).to_pylist(), batch.column(1))]
        blocks = [(fold, lines[:-1], lines[-1].astype(int)) for fold, lines in blocks]
        for left_out, network in networks.items():  # one at a time, whose matrices stay in the cache
            for fold, lines, labels in blocks:
                if fold != left_out:
                    totals[left_out] = _plus(totals[left_out], (network.add(lines, labels), len(labels)))
    yield _rows({fold: (*totals[fold], network.gradient()) for fold, network in networks.items()})


class Network:
    """Sigmoid layers below a softmax with cross entropy, as in MLlib; adds up the gradients of blocks of rows.

    Values are matrices with a line per unit and a column per row. The last line of a layer's input is ones, so a
    layer's weights and intercepts are one matrix. Its weights come first in the flat vector, column by column.
    """

    def __init__(self, layers: list[int], weights: np.ndarray):
        self.layers, self.matrices, at = layers, [], 0
        for width, out in zip(layers, layers[1:]):
            flat = weights[at:at + (width + 1) * out]
            self.matrices.append(np.ascontiguousarray(flat.reshape(width + 1, out).T))
            at += (width + 1) * out
        self.negated = [-m for m in self.matrices[:-1]]
        self.back = [np.ascontiguousarray(m[:, :-1].T) for m in self.matrices]
        self.sums = [np.zeros_like(m) for m in self.matrices]
        self.rows = 0

    def _room(self, rows: int) -> None:
        if rows != self.rows:
            hidden, self.rows = self.layers[1:-1], rows
            self.values = [np.ones((width + 1, rows)) for width in hidden]
            self.slopes, self.errors = ([np.empty((width, rows)) for width in hidden] for _ in range(2))
            self.places = np.arange(rows)

    def add(self, x: np.ndarray, labels: np.ndarray) -> float:
        """The loss of the rows, their gradient added to the sums."""
        self._room(len(labels))
        given = [x, *self.values]
        with np.errstate(over="ignore"):
            for matrix, source, value in zip(self.negated, given, self.values):
                value = np.matmul(matrix, source, out=value[:-1])
                np.exp(value, out=value)
                value += 1
                np.reciprocal(value, out=value)
        error = self.matrices[-1] @ given[-1]
        error -= error.max(axis=0)
        picked = error[labels, self.places]
        np.exp(error, out=error)
        total = error.sum(axis=0)
        error /= total
        error[labels, self.places] -= 1
        for i in range(len(self.matrices) - 1, -1, -1):
            self.sums[i] += error @ given[i].T
            if i:
                value, slope = self.values[i - 1][:-1], self.slopes[i - 1]
                np.multiply(value, value, out=slope)
                np.subtract(value, slope, out=slope)
                error = np.matmul(self.back[i], error, out=self.errors[i - 1])
                error *= slope
        return float((np.log(total) - picked).sum())

    def gradient(self) -> np.ndarray:
        return np.concatenate([s.T.ravel() for s in self.sums])


class SearchFailed(Exception):
    """No step along the direction, or no direction."""


def minimise(x: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Search:
    """The point that limited-memory BFGS ends at and the values on its way, by the rules of Breeze's, which MLlib runs.

    It ends after ``max_iter`` steps, when the value is within ``tol`` of the first one below the largest of the last
    twenty, when the gradient is within ``tol`` of the value, or when a search fails twice.
    """
    value, gradient = yield x
    values, recent, steps, failed = [value], deque([np.inf], 20), deque(maxlen=memory), False
    while len(values) <= max_iter:
        if abs(value - max(recent)) <= tol * values[0] or np.linalg.norm(gradient) <= max(tol * abs(value), 1e-8):
            break
        try:
            direction = _direction(gradient, steps)
            first = 1.0 if len(values) > 1 else 1.0 / np.linalg.norm(direction)
            length, found, slope = yield from _search(x, value, gradient, direction, first)
            if length * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed = True
            steps.clear()
            continue
        failed = False
        step = direction * length
        steps.appendleft((step, slope - gradient))
        x, value, gradient = x + step, found, slope
        values.append(value)
        recent.append(value)
    return x, values


def _direction(gradient: np.ndarray, steps: deque) -> np.ndarray:
    """Downhill, by the two loops over the last steps and changes of the gradient."""
    direction, kept = gradient.copy(), []
    for step, change in steps:
        product = step @ change
        share = step @ direction / product if product else np.nan
        if np.isnan(share):
            raise SearchFailed
        direction -= share * change
        kept.append((share, product))
    if steps:
        step, change = steps[0]
        if step @ change < 0:
            raise SearchFailed
        direction *= (step @ change) / (change @ change)
    for (step, change), (share, product) in zip(reversed(steps), reversed(kept)):
        direction += (share - change @ direction / product) * step
    return -direction


def _search(x: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, t: float) -> Search:
    """A step that meets the strong Wolfe conditions, with its value and gradient."""
    start = gradient @ direction
    if not start <= 0:
        raise SearchFailed

    def at(t: float) -> Search:
        found, slope = yield x + direction * t
        return t, slope @ direction, found, slope

    def too_high(c: tuple) -> bool:
        return c[2] > value + 1e-4 * c[0] * start

    def flat(c: tuple) -> bool:
        return abs(c[1]) <= 0.9 * abs(start)

    def zoom(low: tuple, high: tuple) -> Search:
        for _ in range(10):
            c = yield from at(_between(low, high) if low[0] <= high[0] else _between(high, low))
            if too_high(c) or c[2] >= low[2]:
                high = c
                continue
            if flat(c):
                return c[0], c[2], c[3]
            if c[1] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    low = (0.0, start, value, gradient)
    for i in range(10):
        c = yield from at(t)
        if not np.isfinite(c[2]):
            t /= 2
            continue
        if too_high(c) or (c[2] >= low[2] and i > 0):
            return (yield from zoom(low, c))
        if flat(c):
            return c[0], c[2], c[3]
        if c[1] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    raise SearchFailed


def _between(left: tuple, right: tuple) -> float:
    """Where the cubic through both ends is least, a tenth of the way from either end at least."""
    (a, slope_a, value_a, _), (b, slope_b, value_b, _) = left, right
    middle = slope_a + slope_b - 3 * (value_a - value_b) / (a - b)
    with np.errstate(invalid="ignore", divide="ignore"):
        root = np.sqrt(np.float64(middle * middle - slope_a * slope_b))
        t = float(b - (b - a) * (slope_b + root - middle) / (slope_b - slope_a + 2 * root))
    lowest, highest = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return lowest if t < lowest else highest if t > highest else t
