"""K-means from many starts at once, and the silhouette in plain distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import importable
from tidemark.sources.lineage import settle

ROUNDS = 30
REFERENCES = 1_000  # rows of a cluster that others are measured against; clusters up to this size are exact
GROUPS = 10  # parts of the references whose spread gives the error
AT_ONCE = 2_048


@dataclass
class Start:
    """One run: ``k`` centres from the rows that come first in the hash order of ``number``."""

    k: int
    number: int
    centres: np.ndarray
    cost: float = float("inf")
    done: bool = False


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows of a list column as a table of doubles."""
    lists = batch.column(column)
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, by differences, as near ties must not turn on rounding."""
    out = np.empty((len(x), len(centres)))
    for k, c in enumerate(centres):
        gap = x - c
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def _first_rows(data: DataFrame, vec: str, key: str, most: int, starts: Sequence[int]) -> dict[int, np.ndarray]:
    """The ``most`` rows of every start in the order of md5(key|start): a table of starts x ``most`` rows."""
    draws = F.array(*[F.struct(F.lit(s).alias("s"), F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{s}"))).alias("h")) for s in starts])
    long = data.select(key, vec, F.inline(draws))
    rank = F.row_number().over(Window.partitionBy("s").orderBy("h", key))
    rows = long.withColumn("_r", rank).where(F.col("_r") <= most).select("s", "_r", vec).collect()
    return {s: np.array([list(r[vec]) for r in sorted((r for r in rows if r["s"] == s), key=lambda r: r["_r"])], dtype=np.float64) for s in starts}


def fit_starts(df: DataFrame, vec: str, key: str, ks: Sequence[int], starts: Sequence[int] = tuple(range(20)), rounds: int = ROUNDS) -> list[Start]:
    """Lloyd's rounds for every k and start together: each round is one pass and one aggregate over all runs.

    Tasks bring back sums, counts and costs by centre, so what is collected depends on the runs alone. A run
    ends when its centres stand still, or after ``rounds``. An empty cluster keeps its centre; rows without a vector
    are left out; with fewer rows than k a run has as many centres as rows.
    """
    importable(df.sparkSession)
    data = settle(df.select(key, F.transform(F.col(vec), lambda x: x.cast("double")).alias(vec)).where(F.col(vec).isNotNull()))
    first = _first_rows(data, vec, key, max(ks), starts)
    runs = [Start(k, s, first[s][:k]) for k in ks for s in starts if len(first[s])]
    for _ in range(rounds):
        if not any(not r.done for r in runs):
            break
        _round([r for r in runs if not r.done], data, vec, move=True)
    _round(runs, data, vec, move=False)
    return runs


def _round(runs: list[Start], data: DataFrame, vec: str, move: bool) -> None:
    centres = [r.centres for r in runs]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), c.shape[1] + 2)) for c in centres]
        for batch in batches:
            x = matrix(batch, vec)
            for k, c in enumerate(centres):
                d = squared(x, c)
                own = d.argmin(axis=1)
                sums[k][:, 0] += np.bincount(own, minlength=len(c))
                sums[k][:, 1] += np.bincount(own, weights=d[np.arange(len(x)), own], minlength=len(c))
                if move:
                    np.add.at(sums[k][:, 2:], own, x)
        flat = [(k, j, row) for k, s in enumerate(sums) for j, row in enumerate(s) if row[0]]
        width = max((len(row) for _, _, row in flat), default=0) if move else 2
        for a in range(0, len(flat), 256):
            some = flat[a: a + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([k for k, _, _ in some], width)), pa.array(np.repeat([j for _, j, _ in some], width)),
                 pa.array(np.tile(np.arange(width), len(some))), pa.array(np.concatenate([row[:width] for _, _, row in some]))],
                names=["run", "centre", "place", "value"])

    got = data.select(vec).mapInArrow(step, "run long, centre long, place long, value double") \
        .groupBy("run", "centre", "place").agg(F.sum("value").alias("value")).toPandas()
    total = [np.zeros((len(c), c.shape[1] + 2)) for c in centres]
    for run, some in got.groupby("run"):
        total[run][some["centre"], some["place"]] = some["value"]
    for r, t in zip(runs, total):
        r.cost = float(t[:, 1].sum())
        if move:
            new = np.where(t[:, :1] > 0, t[:, 2:] / np.maximum(t[:, :1], 1), r.centres)
            r.done = bool(np.array_equal(new, r.centres))
            r.centres = new


def best_start(runs: Sequence[Start], k: int) -> Start:
    """The run of ``k`` with the least cost, the lowest start on ties."""
    return min((r for r in runs if r.k == k), key=lambda r: (r.cost, r.number))


def assign_clusters(start: Start, df: DataFrame, vec: str, out: str = "cluster") -> DataFrame:
    """``df`` with the nearest centre of each row (the lowest on ties); null where there is no vector."""
    importable(df.sparkSession)
    centres, names = start.centres, df.columns

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column("_v").is_valid()
            own = np.full(len(b), -1, dtype=np.int32)
            known = b.filter(there)
            if len(known):
                own[there.to_numpy(zero_copy_only=False)] = squared(matrix(known, "_v"), centres).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.int32(), mask=own < 0)], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*names, F.transform(F.col(vec), lambda x: x.cast("double")).alias("_v")).mapInArrow(nearest, f"{schema}, {out} int")


def silhouette(df: DataFrame, cluster: str, vec: str, key: str, references: int = REFERENCES) -> DataFrame:
    """Mean silhouette in plain distance by (scope): 'all' and every cluster, with ``n`` rows and ``error``.

    Every row is measured against at most ``references`` rows of each cluster, by the order of a hash of ``key``;
    those rows are what is sent to the tasks. A cluster of at most this size takes part whole, and where all do the
    result is exact and ``error`` 0. Else ``error`` is the standard error over ``GROUPS`` parts of the references.
    A row alone in its cluster counts 0; rows without cluster or vector are left out; repeated keys are one row.
    """
    spark = importable(df.sparkSession)
    rows = df.select(F.col(cluster).alias("c"), F.col(key).cast("string").alias("k"), F.transform(F.col(vec), lambda x: x.cast("double")).alias("v")) \
        .where("c IS NOT NULL AND v IS NOT NULL AND k IS NOT NULL").dropDuplicates(["k"])
    rows = settle(rows)
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.md5("k"), "k"))
    held = rows.withColumn("_r", rank).where(F.col("_r") <= references).select("c", "k", "_r", "v").collect()  # clusters x references
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(sizes)
    refs = {c: sorted((r for r in held if r["c"] == c), key=lambda r: r["_r"]) for c in classes}
    sampled = {c: sizes[c] > references for c in classes}
    parts = GROUPS if any(sampled.values()) else 0
    shared = spark.sparkContext.broadcast({c: (np.array([list(r["v"]) for r in v]), {r["k"]: i for i, r in enumerate(v)}) for c, v in refs.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                b = batch.slice(at, AT_ONCE)
                x, own, keys = matrix(b, "v"), b.column("c").to_pylist(), b.column("k").to_pylist()
                means = np.zeros((len(x), len(classes), parts + 1))
                mine = np.array([classes.index(c) for c in own])
                for j, c in enumerate(classes):
                    points, place = shared.value[c]
                    d = np.sqrt(np.maximum(squared(x, points), 0))
                    here = np.array([place.get(k, -1) if c == o else -1 for k, o in zip(keys, own)])
                    group = np.arange(len(points)) % GROUPS
                    for g in range(parts + 1):
                        some = np.ones(len(points), bool) if g == 0 or not sampled[c] else group == g - 1
                        self_in = (here >= 0) & some[np.maximum(here, 0)]
                        n = some.sum() - self_in
                        means[:, j, g] = np.where(n > 0, d[:, some].sum(axis=1) / np.maximum(n, 1), np.nan)
                a = np.take_along_axis(means, mine[:, None, None].repeat(parts + 1, 2), axis=1)[:, 0]
                np.put_along_axis(means, mine[:, None, None].repeat(parts + 1, 2), np.inf, axis=1)
                near = means.min(axis=1)
                with np.errstate(invalid="ignore"):
                    s = np.where(np.isnan(a), 0.0, (near - a) / np.maximum(np.maximum(a, near), 1e-300))
                s = np.where(np.isfinite(s), s, 0.0)
                yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(list(s), pa.list_(pa.float64()))], names=["c", "s"])

    kind = rows.schema["c"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"c {kind}, s array<double>").select("c", *[F.get("s", F.lit(g)).alias(f"s{g}") for g in range(parts + 1)])
    sums = scored.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{g}").alias(f"s{g}") for g in range(parts + 1)])
    per = sums.select(F.col("c").cast("string").alias("scope"), *[c for c in sums.columns if c != "c"])
    whole = per.agg(F.lit("all").alias("scope"), *[F.sum(c).alias(c) for c in per.columns if c != "scope"])
    both = per.unionByName(whole)
    values = [F.col(f"s{g}") / F.col("n") for g in range(1, parts + 1)]
    mean = sum(values, F.lit(0.0)) / max(parts, 1)
    spread = sum(((v - mean) * (v - mean) for v in values), F.lit(0.0))
    error = F.sqrt(spread / (parts * (parts - 1))) if parts else F.lit(0.0)
    return both.select("scope", (F.col("s0") / F.col("n")).alias("silhouette"), "n", error.alias("error"))
