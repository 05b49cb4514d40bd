"""Training of the multilayer perceptron in matrix blocks: the loss and steps of ``pyspark.ml``, with slopes from Arrow."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import one_thread

BLOCK = 128  # rows of a block: pyspark.ml's loss is the mean over blocks of the mean over a block's rows
CHUNK = 8 * BLOCK  # rows of one product
WIDE = 64  # tasks whose slopes are first added in tasks, not on the driver
MEMORY, TOLERANCE, VALUES = 10, 1e-6, 20  # steps remembered, and when to stop, as pyspark.ml has them


def unfolded(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs matrix, intercepts) of every layer, as views."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


class Room:
    """Arrays of one chunk's outputs and slopes, used again: fresh ones cost as much as the products."""

    def __init__(self, layers: Sequence[int], rows: int = CHUNK):
        self.outs = [np.empty((rows, n)) for n in layers]
        self.back = [np.empty((rows, n)) for n in layers]
        self.slopes = [np.empty((n, m)) for n, m in zip(layers, layers[1:])]


def add_slopes(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, share: float, into: np.ndarray, room: Room) -> float:
    """Sum over at most ``CHUNK`` rows of ``share`` times the cross entropy of sigmoid layers below a softmax; slopes are
    added to ``into``."""
    n = len(x)
    steps, slopes = unfolded(weights, layers), unfolded(into, layers)
    outs = [x, *[o[:n] for o in room.outs[1:]]]
    for k, (w, b) in enumerate(steps):
        z = np.matmul(outs[k], w, out=outs[k + 1])
        z += b
        if k < len(steps) - 1:
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
    z -= z.max(axis=1, keepdims=True)
    own = np.arange(n)
    picked = z[own, y]
    np.exp(z, out=z)
    whole = z.sum(axis=1)
    loss = share * float((np.log(whole) - picked).sum())
    z /= whole[:, None]
    z[own, y] -= 1.0
    z *= share
    back = z
    for k in range(len(steps) - 1, -1, -1):
        np.matmul(outs[k].T, back, out=room.slopes[k])
        np.add(slopes[k][0], room.slopes[k], out=slopes[k][0])
        np.add(slopes[k][1], back.sum(axis=0), out=slopes[k][1])
        if k:
            back = np.matmul(back, steps[k][0].T, out=room.back[k][:n])
            back *= outs[k]
            np.subtract(1.0, outs[k], out=outs[k])
            back *= outs[k]
    return loss


def loss_on(rows: DataFrame, layers: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and slopes over (features, label) at given weights. A task adds up its own rows; at most ``WIDE`` arrays of
    the size of the weights come to the driver."""
    layers = list(layers)
    size = sum((n + 1) * m for n, m in zip(layers, layers[1:]))
    data = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
    parts = data.rdd.getNumPartitions()
    schema = "sums binary"

    def give(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            for one in b.column(0):
                total += np.frombuffer(one.as_buffer())
        yield from give(total)

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, room = np.zeros(size + 2), Room(layers)
            kept_x, kept_y = np.zeros((0, layers[0])), np.zeros(0, dtype=np.int64)

            def add(x: np.ndarray, y: np.ndarray, rows_a_block: int) -> None:
                with np.errstate(over="ignore"):
                    sums[size] += add_slopes(weights, layers, x, y, 1.0 / rows_a_block, sums[:size], room)
                sums[size + 1] += len(x) // rows_a_block

            for b in batches:
                x = np.concatenate([kept_x, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), layers[0])])
                y = np.concatenate([kept_y, b.column(1).to_numpy()])
                full = len(x) // BLOCK * BLOCK
                for a in range(0, full, CHUNK):
                    add(x[a:min(a + CHUNK, full)], y[a:min(a + CHUNK, full)], BLOCK)
                kept_x, kept_y = x[full:], y[full:]
            if len(kept_x):
                add(kept_x, kept_y, len(kept_x))
            yield from give(sums)

        with one_thread(rows.sparkSession):
            got = data.mapInArrow(slopes, schema)
            if parts > WIDE:
                got = got.repartition(math.isqrt(parts)).mapInArrow(added, schema)
        total = np.sum([np.frombuffer(r[0]) for r in got.collect()], axis=0)
        return total[size] / total[size + 1], total[:size] / total[size + 1]

    return at


class Stuck(Exception):
    """No step along the direction lowers the loss."""


def _between(low: tuple, high: tuple) -> float:
    """Least point of the cubic through two (step, loss, slope), kept off the ends."""
    d1 = low[2] + high[2] - 3 * (low[1] - high[1]) / (low[0] - high[0])
    d2 = math.sqrt(d1 * d1 - low[2] * high[2]) if d1 * d1 >= low[2] * high[2] else math.nan
    bottom, wide = high[2] - low[2] + 2 * d2, high[0] - low[0]
    t = high[0] - wide * (high[2] + d2 - d1) / bottom if bottom else math.nan
    return min(max(t, low[0] + 0.1 * wide), low[0] + 0.9 * wide) if not math.isnan(t) else math.nan


def _step(phi: Callable[[float], tuple], start: tuple, t: float) -> float:
    """Step length that meets the strong Wolfe conditions."""
    _, loss, slope = low = start

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(10):
            c = phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > loss + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise Stuck

    if slope > 0:
        raise Stuck
    for i in range(10):
        c = phi(t)
        if math.isinf(c[1]) or math.isnan(c[1]):
            t /= 2.0
            continue
        if c[1] > loss + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, 1.5 * t
    raise Stuck


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int) -> np.ndarray:
    """Limited-memory quasi-Newton steps with the line search, restart and stopping rules of pyspark.ml's optimiser."""
    value, slopes = f(x)
    first, values, past, failed, k = value, [math.inf], [], False, 0
    while k < rounds:
        if len(values) >= 2 and abs(value - max(values)) <= TOLERANCE * first:
            break
        if np.linalg.norm(slopes) <= max(TOLERANCE * abs(value), 1e-8):
            break
        try:
            way, scale, shares = slopes.copy(), 1.0, []
            if past:
                s, g = past[0]
                if not s @ g >= 0:
                    raise Stuck
                scale = (s @ g) / (g @ g)
            for s, g in past:
                shares.append((s @ way) / (s @ g))
                if math.isnan(shares[-1]):
                    raise Stuck
                way -= shares[-1] * g
            way *= scale
            for (s, g), a in reversed([*zip(past, shares)]):
                way += (a - (g @ way) / (s @ g)) * s
            way = -way
            seen = {}

            def phi(t: float) -> tuple:
                seen[t] = f(x + t * way)
                return t, seen[t][0], float(seen[t][1] @ way)

            t = _step(phi, (0.0, value, float(slopes @ way)), 1.0 if k else 1.0 / float(np.linalg.norm(way)))
            if t * np.linalg.norm(slopes) < 1e-10:
                raise Stuck
            new = x + t * way
            new_value, new_slopes = seen[t]
            past = [(new - x, new_slopes - slopes), *past][:MEMORY]
            x, value, slopes = new, new_value, new_slopes
            values = [*values, value][-VALUES:]
            failed = False
            k += 1
        except Stuck:
            if failed:
                break
            failed, past = True, []
    return x


def fit_perceptron(rows: DataFrame, layers: Sequence[int], rounds: int, seed: int, weights: DenseVector | None = None) -> MultilayerPerceptronClassificationModel:
    """``MultilayerPerceptronClassifier`` on (features, label), which should be stored: each step reads them once or more."""
    def model(start: np.ndarray | None) -> MultilayerPerceptronClassificationModel:
        # No rounds: the model of given weights, or of the first ones that the seed draws.
        none = MultilayerPerceptronClassifier(layers=list(layers), maxIter=0, seed=seed)
        if start is not None:
            none.setInitialWeights(Vectors.dense(start))
        return none.fit(one)

    one = rows.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "label"]).coalesce(1)
    first = (weights if weights is not None else model(None).weights).toArray()
    return model(minimise(loss_on(rows, layers), first, rounds))
