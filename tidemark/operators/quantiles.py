"""Exact order statistics and running totals that never put a whole group in one task.

A window or ``percentile`` over one global (or one hot) group is a single-task
job.  Quantiles are selected by counting: see ``exact_quantiles``.  Where every
value is wanted, the input is collapsed to distinct values, which are dealt to
tasks by range and written once; each task sums its own range, and the totals of
the ranges before it are added.  The ranges only decide how work is split, so
both are exact.  There is one path for every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.sources.lineage import settle


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """Index of the bin a value falls in: the number of cut points below it."""
    array = F.array(*[F.lit(c) for c in cuts])
    return F.size(F.filter(array, lambda c: c < value))


def running_totals(df: DataFrame, by: Sequence[str], value: str, measures: Sequence[str], parts: int | None = None) -> DataFrame:
    """One row per (by, value) with ``m``, inclusive ``cum_m`` and group total ``tot_m``.

    ``parts`` fixes the number of ranges; by default Spark sizes them.
    """
    by = list(by)
    order = [F.col(c) for c in [*by, value]]
    collapsed = df.groupBy(*by, value).agg(*[F.sum(m).alias(m) for m in measures])
    dealt = collapsed.repartitionByRange(parts, *order) if parts else collapsed.repartitionByRange(*order)
    ranged = settle(dealt.withColumn("_part", F.spark_partition_id()))
    keys = [*by, "_part"]
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each range that a group has rows in.
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"off_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"tot_{m}") for m in measures],
        )
    )
    summed = ranged.select("*", *[F.sum(m).over(inside).alias(f"in_{m}") for m in measures])
    joined = summed.alias("s").join(
        offsets.alias("o"), [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return joined.select(
        *[F.col(f"s.{c}").alias(c) for c in [*by, value, *measures]],
        *[(F.col(f"s.in_{m}") + F.col(f"o.off_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"o.tot_{m}").alias(f"tot_{m}") for m in measures],
    )


FINE = 1_024  # buckets from each power of two to the next
SMALL = 4_096  # values of one bucket that are sorted in an array
STEPS = 4_096  # parts that a larger bucket is cut into


def magnitude_bucket(v: Column) -> Column:
    """A bucket number that never falls as ``v`` grows: sign and parts of the binary logarithm."""
    a = F.abs(v)
    step = F.floor(F.log2(F.least(a, F.lit(1.7e308))) * FINE) + 1_100 * FINE
    return (F.when(F.isnan(v), 2_500 * FINE).when(a == float("inf"), F.when(v > 0, 2_400 * FINE).otherwise(-2_400 * FINE))
            .when(v > 0, step).when(v < 0, -step).otherwise(0).cast("int"))


def _part_of(v: Column, lo: Column, hi: Column) -> Column:
    """Equal parts of [lo, hi]; the last holds ``hi`` alone, so a bucket of two values always splits."""
    return F.when(v >= hi, F.lit(STEPS)).otherwise(F.floor((v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5) * STEPS)).cast("int")


def _wanted(counts: DataFrame, groups: list[str], keys: list[str], probs: Sequence[float] | None) -> DataFrame:
    """Buckets of ``counts`` (n, lo, hi) that hold a wanted rank, with those ranks counted from the bucket's start.

    At the first level the ranks follow from the group's size ``total``; below it they come as ``ranks`` of the
    bucket that was cut. A group has at most as many rows here as there are bucket numbers.
    """
    inside = Window.partitionBy(*groups, *keys[:-1])
    before = F.coalesce(F.sum("n").over(inside.orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_before", before)
    if probs is not None:
        placed = placed.withColumn("total", F.sum("n").over(inside))
        spots = [f(F.lit(float(p)) * (F.col("total") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)]
        placed = placed.withColumn("ranks", F.array_distinct(F.array(*spots))).withColumn("base", F.lit(0).cast("long"))
    held = F.filter(F.transform("ranks", lambda r: r - F.col("_before")), lambda r: (r >= 0) & (r < F.col("n")))
    return placed.withColumn("base", F.col("base") + F.col("_before")).withColumn("ranks", held).where(F.size("ranks") > 0).drop("_before")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles per (by, feature) as rows (by..., feature, n, q ARRAY).

    Selection without sorting: values are counted by magnitude in one hash aggregate; only buckets that hold a
    wanted rank are looked at again, cut into equal parts until they have one value or at most ``SMALL``, which one
    array sorts. Two passes over ``df`` do up to some hundred thousand rows, each further one a factor of some
    thousand; what is written in between are the few buckets, never values. Settle a costly ``df`` before.
    """
    by = list(by)
    groups = [*by, "feature"]
    rows = (
        df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot(by, list(cols), "feature", "value")
        .where(F.col("value").isNotNull())
        .withColumn("_k0", magnitude_bucket(F.col("value")))
    )
    keys, found, level = ["_k0"], [], 0
    summary = (F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    single = F.col("lo").eqNullSafe(F.col("hi"))

    def kept(buckets: DataFrame) -> tuple[DataFrame, int]:
        """The buckets, written, and the size of the largest that has more than one value."""
        seen = Observation()
        out = settle(buckets.observe(seen, F.max(F.when(~single, F.col("n"))).alias("most")))
        return out, seen.get["most"] or 0

    wanted, most = kept(_wanted(rows.groupBy(*groups, *keys).agg(*summary), groups, keys, probs))
    while True:
        found.append(wanted.where(single).select(*groups, "total", F.explode("ranks").alias("rank"), "base", F.col("lo").alias("value"))
                     .withColumn("rank", F.col("rank") + F.col("base")).drop("base"))
        open_ = wanted.where(~single).select(*[F.col(c).alias(f"_{c}") for c in groups], *[F.col(k).alias(f"_{k}") for k in keys],
                                             "total", "ranks", "base", "n", "lo", "hi")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in groups] + [F.col(k) == F.col(f"_{k}") for k in keys]
        if most == 0:
            break
        near = rows.join(open_, same[0] if len(same) == 1 else _all(same)).drop(*[f"_{c}" for c in [*groups, *keys]])
        short = near.where(F.col("n") <= SMALL).groupBy(*groups, *keys).agg(
            F.sort_array(F.collect_list("value")).alias("_v"), *[F.first(c).alias(c) for c in ("total", "ranks", "base")])
        found.append(short.select(*groups, "total", "base", "_v", F.explode("ranks").alias("rank")).select(
            *groups, "total", (F.col("rank") + F.col("base")).alias("rank"), F.get("_v", F.col("rank").cast("int")).alias("value")))
        if most <= SMALL:
            break
        level += 1
        rows = near.where(F.col("n") > SMALL).withColumn(f"_k{level}", _part_of(F.col("value"), F.col("lo"), F.col("hi")))
        carried = [F.first(c).alias(c) for c in ("total", "ranks", "base")]
        keys = [*keys, f"_k{level}"]
        counts = rows.groupBy(*groups, *keys).agg(*summary, *carried)
        rows = rows.select(*groups, *keys, "value")
        wanted, most = kept(_wanted(counts, groups, keys, None))

    picked = found[0]
    for more in found[1:]:
        picked = picked.unionByName(more)

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank.cast("long"), F.col("value")))

    ends = [(F.lit(float(p)) * (F.col("total") - 1)) for p in probs]
    found_at = picked.groupBy(*groups).agg(F.max("total").alias("n"), *[
        at(f(pos)).alias(f"{name}{i}") for i, pos in enumerate(ends) for f, name in ((F.floor, "lo"), (F.ceil, "hi"))])

    def interpolate(i: int, p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)

    return found_at.select(
        *by, "feature", "n", F.array(*[interpolate(i, p) for i, p in enumerate(probs)]).alias("q"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def fitted_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Global quantiles as a dict feature -> values (one bounded row per column)."""
    rows = exact_quantiles(df, cols, probs).collect()
    found = {r["feature"]: list(r["q"]) for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def grouped_quantile_columns(
    df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Quantiles of one column per group as named columns."""
    q = exact_quantiles(df, [col], probs, by)
    return q.select(*by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def average_ranks(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Average (tie-shared) rank of each row per column, long form (key, feature, rank)."""
    long = (
        df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot([key], list(cols), "feature", "value")
        .where(F.col("value").isNotNull())
    )
    ranks = value_ranks(long)
    return long.join(ranks, ["feature", "value"]).select(key, "feature", "rank", "tot_w")


def value_ranks(long: DataFrame) -> DataFrame:
    """Average rank of every distinct (feature, value)."""
    cum = running_totals(long.withColumn("w", F.lit(1)), ["feature"], "value", ["w"])
    return cum.select(
        "feature", "value", "tot_w",
        (F.col("cum_w") - (F.col("w") - 1) / 2.0).alias("rank"),
    )
