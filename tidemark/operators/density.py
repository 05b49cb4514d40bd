"""Class densities by Gaussian kernels over ball trees of all labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import one_thread

SUPPORT = 20_000  # labelled rows that a task holds at once; up to so many are sent to every task, more stream past
HELD = 200_000  # rows to score that a task holds while labelled rows stream past
LEAF = 32
QUERIES = 2_048  # rows that walk a tree together
TILE = (256, 512)  # rows and kernels of one block of sums
ERROR = 1e-7  # share of a density that far nodes taken whole may add or miss


@dataclass
class BallTree:
    """Points in nested balls: every node knows its centre, its radius and the range of its points.

    Equal points are kept once, with their count.
    """

    points: np.ndarray
    centre: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    span: list[tuple[int, int]] = field(default_factory=list)
    parts: list[tuple[int, int] | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.points = np.ascontiguousarray(self.points, dtype=np.float64)
        self.size = len(self.points)
        if not self.size:
            return
        self.points, counts = np.unique(self.points + 0.0, axis=0, return_counts=True)
        self.logs = np.log(counts)
        self._grow(0, len(self.points))
        self.upto = np.concatenate([[0.0], np.exp(self.logs).round().cumsum()])
        gap = self.points - self.centre[0]
        # Kernel logs are products with (x, squared length of x, 1): rows of points, ones, and squared lengths.
        self.wide = np.concatenate([2.0 * gap, -np.ones((len(gap), 1)), -(gap * gap).sum(axis=1)[:, None]], axis=1).T.copy()

    def _grow(self, a: int, b: int) -> int:
        some = self.points[a:b]
        node = len(self.span)
        middle = some.mean(axis=0)
        self.centre.append(middle)
        self.radius.append(float(np.sqrt(((some - middle) ** 2).sum(axis=1).max())))
        self.span.append((a, b))
        self.parts.append(None)
        if b - a > LEAF and self.radius[node] > 0:
            wide = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
            half = (b - a) // 2
            order = np.argpartition(some[:, wide], half)
            self.points[a:b], self.logs[a:b] = some[order], self.logs[a:b][order]
            self.parts[node] = (self._grow(a, a + half), self._grow(a + half, b))
        return node

    def log_sums(self, x: np.ndarray, bandwidth: float) -> tuple[np.ndarray, int]:
        """Log of the kernel sum at every row of ``x``, and how many kernels were evaluated."""
        top, total = np.full(len(x), -np.inf), np.zeros(len(x))
        work = self.add_sums(x, bandwidth, top, total, self.size)
        return top + np.log(total), work

    def add_sums(self, x: np.ndarray, bandwidth: float, top: np.ndarray, total: np.ndarray, n_all: int) -> int:
        """Add the kernel sum at every row of ``x`` to ``total`` times the exponential of ``top``, in place; gives how
        many kernels were evaluated.

        The sum so far, or a first descent to the nearest leaf, gives a lower bound of the sum over all ``n_all``
        points, of which the tree may hold a part. Then a node is taken whole, at the middle of its bounds, where these
        differ by less than its share of ``ERROR`` of that lower bound. A node of which no point could be left out is
        evaluated at once, and so is one of few points whose centre would count: little of it could be left out.
        """
        scale = 2.0 * bandwidth * bandwidth
        work = 0
        gap = x - self.centre[0]
        square = (gap * gap).sum(axis=1)
        # Products lose digits where lengths are large against the bandwidth; differences do not.
        exact = 1e-15 * (square.max(initial=0.0) + self.radius[0] ** 2) > 0.01 * ERROR * scale
        wide = np.concatenate([gap, square[:, None], np.ones((len(x), 1))], axis=1) / scale

        def logs_of(at: np.ndarray, a: int, b: int) -> np.ndarray:
            if exact:
                far = x[at][:, None, :] - self.points[None, a:b]
                return self.logs[a:b] - np.einsum("ijk,ijk->ij", far, far) / scale
            return wide[at] @ self.wide[:, a:b] + self.logs[a:b]

        def add(at: np.ndarray, logs: np.ndarray) -> None:
            high = np.maximum(top[at], logs.max(axis=1))
            logs -= high[:, None]
            np.exp(logs, out=logs)
            total[at] = total[at] * np.exp(top[at] - high) + logs.sum(axis=1)
            top[at] = high

        least = top + np.log(np.maximum(total, 1e-300))
        walk = [(0, np.flatnonzero(total == 0))]
        while walk:
            node, at = walk.pop()
            if not len(at):
                continue
            if self.parts[node] is None:
                logs = logs_of(at, *self.span[node])
                work += logs.size
                high = logs.max(axis=1)
                least[at] = high + np.log(np.exp(logs - high[:, None]).sum(axis=1))
                continue
            left, right = self.parts[node]
            nearer = ((x[at] - self.centre[left]) ** 2).sum(axis=1) <= ((x[at] - self.centre[right]) ** 2).sum(axis=1)
            walk += [(left, at[nearer]), (right, at[~nearer])]

        walk = [(0, np.arange(len(x)))]
        while walk:
            node, at = walk.pop()
            a, b = self.span[node]
            count = self.upto[b] - self.upto[a]
            far = np.sqrt(((x[at] - self.centre[node]) ** 2).sum(axis=1))
            most = math.log(count) - np.maximum(far - self.radius[node], 0.0) ** 2 / scale
            fewest = math.log(count) - (far + self.radius[node]) ** 2 / scale
            allowed = least[at] + math.log(2 * ERROR * count / n_all)
            whole = most + np.log(-np.expm1(np.minimum(fewest - most, -1e-300))) <= allowed
            if whole.any():
                add(at[whole], (np.logaddexp(most[whole], fewest[whole]) - math.log(2))[:, None])
            near = ~whole & ((fewest > allowed) | (self.parts[node] is None))
            if b - a <= TILE[1]:
                near |= ~whole & (-far * far / scale > allowed - math.log(count))
            for i in range(0, int(near.sum()), TILE[0]):
                some = at[near][i:i + TILE[0]]
                for j in range(a, b, TILE[1]):
                    logs = logs_of(some, j, min(j + TILE[1], b))
                    work += logs.size
                    add(some, logs)
            at = at[~whole & ~near]
            if len(at):
                walk += [(part, at) for part in self.parts[node]]
        return work


class Streamed(dict):
    """Log priors of classes with more labelled rows than a task holds: their trees are empty here and are grown in the
    tasks, from ``rows`` (class number, features)."""

    def __init__(self, priors: dict, counts: dict, rows: DataFrame, held: int):
        super().__init__({c: (p, BallTree(np.zeros((0, len(rows.columns) - 1)))) for c, p in priors.items()})
        self.counts, self.rows, self.held = counts, rows, held


def kernel_trees(train: DataFrame, cols: Sequence[str], label: str, key: str, support: int = SUPPORT) -> dict:
    """Log prior and tree of each class over all its rows; with more than ``support`` rows in all the trees are grown in
    the tasks that score. Rows without a label are left out; null features count 0."""
    rows = train.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row a class
    whole = sum(counts.values())
    classes = sorted(counts)
    priors = {c: math.log(counts[c] / whole) for c in classes}
    number = F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(i)) for i, c in enumerate(classes)]) if classes else F.lit(None).cast("int")
    numbered = rows.select(number.alias("_cls"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)])
    if whole > support:
        return Streamed(priors, counts, numbered, support)
    got = numbered.toPandas().to_numpy(dtype=np.float64).reshape(-1, len(cols) + 1)  # at most ``support`` rows
    return {c: (priors[c], BallTree(got[got[:, 0] == i, 1:])) for i, c in enumerate(classes)}


def kernel_scores(df: DataFrame, trees: dict, cols: Sequence[str], bandwidth: float = 0.20) -> DataFrame:
    """``df`` with ``log_scores`` (log density plus log prior of each class, in the order of the classes), ``predicted``
    and ``kernels``, the mean number of kernels evaluated a row. Every row is a query, against every labelled row.

    Trees are sent to every task and nothing is shuffled; more labelled rows than a task holds stream past every
    part of ``df``. Log scores are within ``ERROR`` of the full sums. Ties go to the lower class; without classes there
    is no prediction; null features count 0.
    """
    spark = df.sparkSession
    classes = sorted(trees)
    priors = [trees[c][0] for c in classes]
    const = len(cols) * math.log(bandwidth) + len(cols) / 2.0 * math.log(2 * math.pi)
    names, width = df.columns, len(cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += ", log_scores array<double>, predicted int, kernels double"
    asked = df.select(*names, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)])

    def features(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(names):len(names) + width]], axis=1)

    def scored(b: pa.RecordBatch, sums: np.ndarray, sizes: list[int], work: float) -> pa.RecordBatch:
        logs = sums - np.log(sizes) - const + priors if classes else sums
        best = [classes[k] for k in logs.argmax(axis=1)] if classes else [None] * len(b)
        lists = pa.array([r.tolist() for r in logs], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays(
            [*b.columns[: len(names)], lists, pa.array(best, pa.int32()), pa.array(np.full(len(b), work))],
            names=[*names, "log_scores", "predicted", "kernels"])

    if isinstance(trees, Streamed):
        return _streamed(asked, trees, bandwidth, features, scored, schema)
    shared = spark.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), QUERIES):
                b = batch.slice(a, QUERIES)
                x = features(b)
                found = [shared.value[cls][1].log_sums(x, bandwidth) for cls in classes]
                sums = np.stack([s for s, _ in found], axis=1) if found else np.zeros((len(b), 0))
                yield scored(b, sums, [shared.value[cls][1].size for cls in classes], sum(n for _, n in found) / max(len(b), 1))

    with one_thread(spark):
        return asked.mapInArrow(score, schema)


def _streamed(asked: DataFrame, trees: Streamed, bandwidth: float, features, scored, schema: str) -> DataFrame:
    """Parts of the queries, each with all labelled rows behind it in the order of their classes. A task keeps its part and
    one tree of at most ``trees.held`` rows at a time."""
    spark = asked.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-asked.count() // HELD))
    classes = sorted(trees)
    sizes, held = [trees.counts[c] for c in classes], trees.held
    queries = asked.withColumns({"_cls": F.lit(-1), "_part": (F.monotonically_increasing_id() % parts).cast("int")})
    n_names = len(asked.columns) - len(trees.rows.columns) + 1
    support = trees.rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema.fields[:n_names]], *trees.rows.columns[1:], "_cls", "_part")
    dealt = queries.unionAll(support).repartitionById(parts, F.col("_part")).sortWithinPartitions("_cls").drop("_part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, waiting, n_waiting, now = [], [], 0, 0
        x = top = total = None
        work = 0

        def meet() -> None:
            nonlocal waiting, n_waiting, work
            if n_waiting and len(x):
                tree = BallTree(np.concatenate(waiting))
                for a in range(0, len(x), QUERIES):
                    s = slice(a, a + QUERIES)
                    work += tree.add_sums(x[s], bandwidth, top[now, s], total[now, s], sizes[now])
            waiting, n_waiting = [], 0

        def begin() -> None:
            nonlocal x, top, total
            x = np.concatenate([features(b) for b in mine]) if mine else np.zeros((0, 1))
            top, total = np.full((len(sizes), len(x)), -np.inf), np.zeros((len(sizes), len(x)))

        for batch in batches:
            cls = batch.column("_cls").to_numpy()
            cut = int(np.searchsorted(cls, 0))
            if cut:
                mine.append(batch.slice(0, cut))
            if cut == len(batch):
                continue
            if x is None:
                begin()
            points = features(batch.slice(cut))
            for k in np.unique(cls[cut:]):
                if k != now:
                    meet()
                    now = int(k)
                some = points[cls[cut:] == k]
                while len(some):
                    waiting.append(some[: held - n_waiting])
                    some = some[held - n_waiting:]
                    n_waiting += len(waiting[-1])
                    if n_waiting == held:
                        meet()
        if x is None:
            begin()
        meet()
        at = 0
        for batch in mine:
            for a in range(0, len(batch), QUERIES):
                b = batch.slice(a, QUERIES)
                sums = (top[:, at:at + len(b)] + np.log(total[:, at:at + len(b)])).T
                at += len(b)
                yield scored(b, sums, sizes, work / len(x))

    with one_thread(spark):
        return dealt.mapInArrow(score, schema)
