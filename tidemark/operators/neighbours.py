"""Nearest-neighbour mutual information over cells of near points, without all pairs and without hot groups.

Points of one (feature, target) plane are cut into strips of x and these into cells of y, ``CELL_ROWS`` to twice
as many rows each, by their places in the sorted order, so ties and dense spots make no larger cells. The k nearest
neighbours inside a point's own cell bound the distance; a point whose square of that size touches other cells
visits them. Neighbour counts along one axis are differences of a running count over all sorted points. The work of
a row is a few cells; boxes of cells, one for ``CELL_ROWS`` rows, are what every task gets to know.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import ordered_rank
from tidemark.session import importable
from tidemark.sources.lineage import settle

CELL_ROWS = 1_024
AT_ONCE = 512  # queries compared with a cell at a time
JITTER = 1e-10
HAIR = 1e-13  # neighbours count when nearer than the k-th by more than this, in standard deviations
EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1 on."""
    x = n.cast("double")
    low = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(-EULER), lambda acc, q: acc + F.when(q < n, 1.0 / q).otherwise(0.0))
    x2 = x * x
    high = F.ln(x) - 1 / (2 * x) - 1 / (12 * x2) + 1 / (120 * x2 * x2) - 1 / (252 * x2 * x2 * x2) + 1 / (240 * x2 * x2 * x2 * x2)
    return F.when(n < 10, low).otherwise(high)


def running_count(df: DataFrame, order: Sequence[str], flag: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``flag`` over this row and all before it in the order of ``order``."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for b in batches:
            sums = so_far + np.cumsum(b.column(flag).to_numpy(zero_copy_only=False))
            so_far = int(sums[-1]) if len(sums) else so_far
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums.astype(np.int64))], names=[*b.schema.names, "_in"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    counted = settle(dealt.mapInArrow(count, f"{schema}, _in long"))
    sizes = counted.groupBy("_part").agg(F.sum(flag).alias("_n"))  # one row for each partition
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return counted.join(F.broadcast(first), "_part").withColumn("before", F.col("_first") + F.col("_in")).drop("_part", "_first", "_in")


def nearest(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Sorted Chebyshev distances from each (x, y) to its ``k`` nearest of the points; infinite where there are fewer."""
    out = np.full((len(x), k), np.inf)
    for a in range(0, len(x), AT_ONCE):
        b = min(a + AT_ONCE, len(x))
        d = np.maximum(np.abs(x[a:b, None] - px[None]), np.abs(y[a:b, None] - py[None]))
        if own:
            d[np.arange(b - a), np.arange(a, b)] = np.inf
        m = min(k, d.shape[1])
        out[a:b, :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
    return out


class Boxes:
    """Extents of the cells of every feature: strips in order of x, and in each its cells in order of y."""

    def __init__(self, rows: list):
        self.strips: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["feature"], r["strip"], r["cell"])):
            strips = self.strips.setdefault(r["feature"], [])
            if not strips or strips[-1]["strip"] != r["strip"]:
                strips.append({"strip": r["strip"], "x0": r["x0"], "x1": r["x1"], "cells": []})
            s = strips[-1]
            s["x0"], s["x1"] = min(s["x0"], r["x0"]), max(s["x1"], r["x1"])
            s["cells"].append((r["y0"], r["y1"], r["cell"]))
        self.edges = {f: (np.array([s["x0"] for s in v]), np.array([s["x1"] for s in v])) for f, v in self.strips.items()}
        self.cells = {f: [(np.array([c[0] for c in s["cells"]]), np.array([c[1] for c in s["cells"]])) for s in v]
                      for f, v in self.strips.items()}

    def touched(self, feature: str, x: float, y: float, d: float) -> Iterator[tuple[int, int]]:
        x0, x1 = self.edges[feature]
        for k in range(int(np.searchsorted(x1, x - d, "right")), int(np.searchsorted(x0, x + d, "left"))):
            y0, y1 = self.cells[feature][k]
            for j in range(int(np.searchsorted(y1, y - d, "right")), int(np.searchsorted(y0, y + d, "left"))):
                s = self.strips[feature][k]
                yield s["strip"], s["cells"][j][2]


def neighbour_radius(points: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(feature, id, x, y, radius): Chebyshev distance of every point to its ``k``-th nearest of the same feature.

    ``points``: feature string, id long, x and y double without nulls. Infinite where a feature has too few points.
    """
    importable(points.sparkSession)
    ranked = ordered_rank(points, [F.col("feature"), F.col("x"), F.col("id")])
    # One row a feature.
    sizes = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_low"))
    wide = F.ceil(F.sqrt(F.col("_n") * float(cell_rows)))
    strip = F.least(F.floor((F.col("rank") - F.col("_low")) / wide), F.greatest(F.floor(F.col("_n") / wide) - 1, F.lit(0))).cast("long")
    in_strips = ranked.join(sizes, "feature").withColumn("strip", strip).select("feature", "strip", "id", "x", "y")
    ranked = ordered_rank(in_strips, [F.col("feature"), F.col("strip"), F.col("y"), F.col("id")])
    sizes = ranked.groupBy("feature", "strip").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_low"))
    cell = F.least(F.floor((F.col("rank") - F.col("_low")) / cell_rows), F.greatest(F.floor(F.col("_n") / cell_rows) - 1, F.lit(0))).cast("long")
    placed = settle(ranked.join(sizes, ["feature", "strip"]).withColumn("cell", cell).select("feature", "strip", "cell", "id", "x", "y"))
    # One row for each cell, that is for ``cell_rows`` rows and more.
    boxes = Boxes(placed.groupBy("feature", "strip", "cell").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect())
    known = points.sparkSession.sparkContext.broadcast(boxes)

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        near = nearest(x, y, x, y, k, own=True)
        feature, home = pdf["feature"].iloc[0], (int(pdf["strip"].iloc[0]), int(pdf["cell"].iloc[0]))
        visits = [[c for c in known.value.touched(feature, a, b, d) if c != home] for a, b, d in zip(x, y, near[:, -1])]
        return pdf[["feature", "id", "x", "y"]].assign(
            near=list(near), strips=[[s for s, _ in v] for v in visits], cells=[[c for _, c in v] for v in visits])

    home = settle(placed.groupBy("feature", "strip", "cell").applyInPandas(
        at_home, "feature string, id long, x double, y double, near array<double>, strips array<long>, cells array<long>"))
    visits = home.select("feature", "id", "x", "y", F.get("near", F.lit(k - 1)).alias("d"),
                         F.inline(F.arrays_zip("strips", "cells"))).withColumnsRenamed({"strips": "strip", "cells": "cell"})

    def abroad(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({"feature": [], "id": [], "near": []}, dtype=object)
        near = nearest(asked["x"].to_numpy(), asked["y"].to_numpy(), there["x"].to_numpy(), there["y"].to_numpy(), k, own=False)
        return asked[["feature", "id"]].assign(near=[n[n < d] for n, d in zip(near, asked["d"])])

    more = visits.groupBy("feature", "strip", "cell").cogroup(placed.groupBy("feature", "strip", "cell")).applyInPandas(
        abroad, "feature string, id long, near array<double>").where(F.size("near") > 0)
    # At most k numbers from each cell that a point touches.
    met = more.groupBy("feature", "id").agg(F.flatten(F.collect_list("near")).alias("more"))
    every = F.sort_array(F.concat("near", F.coalesce("more", F.array().cast("array<double>"))))
    return home.join(met, ["feature", "id"], "left").select("feature", "id", "x", "y", F.get(every, F.lit(k - 1)).alias("radius"))


def standardised(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """``cols`` in standard deviations, ties parted by a tiny shift from a hash of key and column."""
    # One row of statistics.
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in cols for f, n in ((F.stddev_pop, "sd"), (lambda v: F.avg(F.abs(v)), "mean"))]).first()
    out = {}
    for c in cols:
        sd = stats[f"{c}__sd"] or 1.0
        size = JITTER * max(1.0, (stats[f"{c}__mean"] or 0.0) / sd)
        digits = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{c}"))), 1, 8), 16, 10).cast("double")
        out[c] = F.col(c).cast("double") / F.lit(sd) + F.lit(size) * (digits / 2147483647.5 - 1.0)
    return df.withColumns(out)


def neighbour_information(df: DataFrame, target: str, cols: Sequence[str], key: str, k: int = 5,
                          cell_rows: int = CELL_ROWS) -> DataFrame:
    """Mutual information (nats) of each feature with a numeric target by the k-nearest-neighbour estimate, not below 0.

    ``key`` names rows apart. Rows without the feature or the target do not count for it; features that have no
    more than ``k`` rows left are refused.
    """
    base = df.select(F.xxhash64(F.col(key)).alias("id"), F.col(key).cast("string").alias("_key"), target, *cols)
    z = settle(standardised(base, [target, *cols], "_key").drop("_key"))
    points = settle(z.where(F.col(target).isNotNull()).select("id", F.col(target).alias("y"), *cols)
                    .unpivot(["id", "y"], list(cols), "feature", "x").where(F.col("x").isNotNull()).select("feature", "id", "x", "y"))
    few = points.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    if few <= k:
        raise ValueError(f"{k} neighbours need more than {k} rows with a value, the shortest feature has {few}")
    radius = settle(neighbour_radius(points, k, cell_rows))
    reach = F.col("radius") - F.lit(HAIR)
    axis = lambda name, v: F.struct(F.lit(name).alias("axis"), F.col(v).alias("v"))
    ends = radius.withColumn("reach", reach).select("feature", "id", "reach", F.inline(F.array(axis("x", "x"), axis("y", "y"))))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    # Upper ends before equal points, lower ends after them: what is counted between lies strictly inside.
    lines = points.select("feature", F.lit("x").alias("axis"), F.col("x").alias("v"), F.lit(1).alias("kind"), one.alias("point"), none.alias("id")) \
        .unionAll(points.select("feature", F.lit("y").alias("axis"), F.col("y").alias("v"), F.lit(1).alias("kind"), one.alias("point"), none.alias("id"))) \
        .unionAll(ends.select("feature", "axis", (F.col("v") + F.col("reach")).alias("v"), F.lit(0).alias("kind"), zero.alias("point"), "id")) \
        .unionAll(ends.select("feature", "axis", (F.col("v") - F.col("reach")).alias("v"), F.lit(2).alias("kind"), zero.alias("point"), "id"))
    counted = running_count(lines, ["feature", "axis", "v", "kind", "id"], "point").where("id IS NOT NULL")
    within = counted.groupBy("feature", "axis", "id").agg(
        F.greatest(F.sum(F.when(F.col("kind") == 0, F.col("before")).otherwise(-F.col("before"))), F.lit(1)).alias("n"))
    means = within.groupBy("feature").agg((F.sum(digamma(F.col("n"))) / (F.count(F.lit(1)) / 2)).alias("both"), (F.count(F.lit(1)) / 2).cast("long").alias("n"))
    return means.select("feature", F.greatest(digamma(F.col("n")) + digamma(F.lit(k)) - F.col("both"), F.lit(0.0)).alias("mi"))
