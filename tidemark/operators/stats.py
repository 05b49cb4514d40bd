"""Aggregate reports: counts, moments, quantile tables, correlations, drift statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import (
    bucket_of, exact_quantiles, fitted_quantiles, running_totals, value_ranks)


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(ids..., feature, value) with one scan for all columns."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), "feature", "value")


def stacked(wide: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into a tall report."""
    return wide.select(F.inline(F.array(*[
        F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])))


def group_means(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def group_medians(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    q = exact_quantiles(df, cols, [0.5], [by])
    return q.groupBy(by).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in cols])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    n = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("t")).scalar()
    return n.withColumn("share", F.col("n") / whole)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column: one unpivot, so the de-duplication shuffles (column, value)."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    pairs = text.where("value IS NOT NULL").distinct()
    return pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column."""
    wide = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in [
        ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]])
    basics = stacked(wide, [{"feature": F.lit(c), "n": F.col(f"{c}__count"), "mean": F.col(f"{c}__mean"),
                             "std": F.col(f"{c}__std"), "lowest": F.col(f"{c}__min").cast("double"),
                             "highest": F.col(f"{c}__max").cast("double")} for c in cols])
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        "feature", *[F.col("q")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75"])])
    return basics.join(q, "feature", "left")


def missing_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return stacked(wide, [{"feature": F.lit(c), "pct_missing": F.col(c) * 100} for c in cols])


def range_audit(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    wide = df.agg(*[x for c, (lo, hi) in bounds.items() for x in (
        F.count_if(F.col(c) < lo).alias(f"{c}__b"), F.count_if(F.col(c) > hi).alias(f"{c}__a"),
        F.count_if(F.col(c).isNull()).alias(f"{c}__n"))])
    return stacked(wide, [{"feature": F.lit(c), "below": F.col(f"{c}__b"), "above": F.col(f"{c}__a"),
                           "missing": F.col(f"{c}__n")} for c in bounds])


def fill_audit(before: DataFrame, after: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Missing values repaired inside the key, and those left for the global median."""
    j = before.select(key, *[F.col(c).alias(f"{c}__x") for c in cols]).join(after.select(key, *cols), key)
    wide = j.agg(*[x for c in cols for x in (
        F.count_if(F.col(f"{c}__x").isNull() & F.col(c).isNotNull()).alias(f"{c}__k"),
        F.count_if(F.col(c).isNull()).alias(f"{c}__g"))])
    return stacked(wide, [{"feature": F.lit(c), "filled_in_key": F.col(f"{c}__k"),
                           "left_for_median": F.col(f"{c}__g")} for c in cols])


def records_per_key(df: DataFrame, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_records"))
    return per.groupBy("n_records").agg(F.count(F.lit(1)).alias("n_keys"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson for every unordered pair, in one aggregate over one scan.

    The number of expressions grows with the square of the *columns*, never the rows.
    """
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                    for i, (a, b) in enumerate(pairs)])
    return stacked(wide, [{"feature_a": F.lit(a), "feature_b": F.lit(b), "corr": F.col(f"c{i}")}
                          for i, (a, b) in enumerate(pairs)])


def correlated_pairs(corr: DataFrame, threshold: float) -> DataFrame:
    return corr.where(F.abs(F.col("corr")) > threshold)


def redundant_features(corr: DataFrame, threshold: float = 0.95) -> DataFrame:
    hot = corr.where(F.col("corr") > threshold)
    return hot.select(F.explode(F.array("feature_a", "feature_b")).alias("feature")).distinct()


def trimmed_histogram(df: DataFrame, col: str, bins: int = 10, log: bool = False) -> DataFrame:
    """Equal-width bins between the 1st and 99th percentile; the last bin is closed."""
    x = F.log1p(F.col(col)) if log else F.col(col).cast("double")
    data = df.select(x.alias("x")).where("x IS NOT NULL")
    lo, hi = fitted_quantiles(data, ["x"], [0.01, 0.99])["x"]
    width = (hi - lo) / bins
    inside = data.where(F.col("x").between(lo, hi))
    b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left_edge"), "n")


def coverage_report(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Count and share of rows meeting each named condition."""
    wide = df.agg(F.count(F.lit(1)).alias("t"), *[F.count_if(c).alias(f"c{i}")
                                                  for i, c in enumerate(flags.values())])
    return stacked(wide, [{"measure": F.lit(n), "n": F.col(f"c{i}"), "share": F.col(f"c{i}") / F.col("t")}
                          for i, n in enumerate(flags)])


def low_information_hotspots(df: DataFrame, by: str, mode: str, floor: float = 0.40,
                             n: int = 20) -> DataFrame:
    share = df.groupBy(by).agg(F.avg((F.col(mode) == 0).cast("double")).alias("share"))
    return share.where(F.col("share") >= floor).orderBy(F.col("share").desc(), by).limit(n)


def clamp_impact(df: DataFrame, category: str, ordinal: str,
                 bounds: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Per keyword: rows containing it, rows at the floor and at the ceiling.

    Keywords overlap, so each is its own conditional sum; the text tests run on the
    grouped (category, ordinal) counts and not once per row.
    """
    grouped = df.groupBy(F.lower(category).alias("_low"), F.col(ordinal).alias("_ord")).agg(
        F.count(F.lit(1)).alias("_n"))
    cells = []
    for i, (word, lo, hi) in enumerate(bounds):
        hit = F.contains(F.col("_low"), F.lit(word))
        for name, cond in (("n", hit), ("f", hit & (F.col("_ord") == lo)), ("c", hit & (F.col("_ord") == hi))):
            cells.append(F.sum(F.when(cond, F.col("_n")).otherwise(0)).alias(f"{name}{i}"))
    wide = grouped.agg(*cells)
    return stacked(wide, [{"keyword": F.lit(w), "n": F.col(f"n{i}"), "at_floor": F.col(f"f{i}"),
                           "at_ceiling": F.col(f"c{i}")} for i, (w, _, _) in enumerate(bounds)]).where("n > 0")


def shannon_entropy(df: DataFrame, group: Sequence[str], cls: str, k: int | None = None) -> DataFrame:
    """Natural-log entropy of the class mix per group, and divided by log(k or classes seen)."""
    n = df.groupBy(*group, cls).agg(F.count(F.lit(1)).alias("n"))
    # sum(p ln p) = sum(n ln n)/N - ln N, so no share has to be joined back.
    out = n.groupBy(*group).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"),
                                F.count(F.lit(1)).alias("k"))
    entropy = F.ln("t") - F.col("s") / F.col("t")
    classes = F.lit(k) if k else F.col("k")
    return out.select(*group, entropy.alias("entropy"),
                      F.when(classes > 1, entropy / F.ln(classes)).otherwise(0.0).alias("entropy_norm"))


def balanced_class_weights(df: DataFrame, cls: str) -> DataFrame:
    """N/(k*count), and inverse counts scaled to sum to one; one row per class."""
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # one row per class
    return n.select(cls, "n",
                    (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"),
                    (1 / F.col("n") / F.sum(1 / F.col("n")).over(whole)).alias("inverse_share"))


def bucket_distribution(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    label = (F.when(c < 0.1, "0-10%").when(c < 0.5, "10-50%").when(c < 0.9, "50-90%")
             .otherwise("90-100%"))
    return value_counts(df.where(c.isNotNull()).select(label.alias("bucket")), "bucket").withColumnRenamed(
        "value", "bucket")


def dtype_summary(df: DataFrame) -> list[tuple[str, int]]:
    """Columns per type; schema only."""
    kinds = [t for _, t in df.dtypes]
    return sorted({(k, kinds.count(k)) for k in kinds})


def density_curve(df: DataFrame, col: str, grid: Sequence[float], bandwidth: float,
                  group: str | None = None) -> DataFrame:
    """Gaussian density of a score at fixed grid points, overall or per class.

    The grid is a literal array exploded per row and averaged map-side; only one
    partial sum per (group, point) and task is shuffled.
    """
    by = [group] if group else []
    rows = df.where(F.col(col).isNotNull()).select(*by, F.col(col).alias("_x"), F.explode(
        F.array(*[F.lit(float(g)) for g in grid])).alias("at"))
    z = (F.col("at") - F.col("_x")) / bandwidth
    kernel = F.exp(-0.5 * z * z) / (bandwidth * math.sqrt(2 * math.pi))
    return rows.groupBy(*by, "at").agg(F.avg(kernel).alias("density"))


def five_number_by_group(df: DataFrame, col: str, by: str) -> DataFrame:
    q = exact_quantiles(df, [col], [0.0, 0.25, 0.5, 0.75, 1.0], [by])
    names = ["lowest", "q25", "q50", "q75", "highest"]
    return q.select(by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


# --- distribution drift -----------------------------------------------------

def psi(baseline: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = 10,
        min_rows: int = 10) -> DataFrame:
    """Population stability index per feature on baseline-quantile bins.

    Edges are unique baseline quantiles (a constant baseline gets equal-width
    bins); values outside the edges are ignored and the last bin is closed.
    """
    eps = 1e-8
    shares = [i / bins for i in range(bins + 1)]
    edges = {}
    for row in exact_quantiles(baseline, cols, shares).collect():  # one row per feature
        cuts = sorted(set(row["q"]))
        if row["n"] < min_rows:
            continue
        if len(cuts) < 3:
            lo, hi = cuts[0] - eps, cuts[-1] + eps
            cuts = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
        edges[row["feature"]] = cuts
    cells = []
    for c in cols:
        for i in range(len(edges.get(c, [0])) - 1):
            lo, hi = edges[c][i], edges[c][i + 1]
            last = i == len(edges[c]) - 2
            x = F.col(c).cast("double")
            hit = (x >= lo) & ((x <= hi) if last else (x < hi))
            cells.append((c, F.count_if(hit).alias(f"{c}__{i}")))
    counts = {name: df.agg(*[e for _, e in cells]).first().asDict()  # bins x features, one row
              for name, df in (("base", baseline), ("curr", current))} if cells else {}
    out = []
    for c in cols:
        k = len(edges.get(c, [0])) - 1
        if k < 1:
            out.append((c, None))
            continue
        b = [counts["base"][f"{c}__{i}"] for i in range(k)]
        q = [counts["curr"][f"{c}__{i}"] for i in range(k)]
        value = 0.0
        for x, y in zip(b, q):
            p0 = (x + eps) / (sum(b) + eps * k)
            p1 = (y + eps) / (sum(q) + eps * k)
            value += (p1 - p0) * math.log(p1 / p0)
        out.append((c, max(value, 0.0)))
    return baseline.sparkSession.createDataFrame(out, "feature string, psi double")


def ks_two_sample(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per feature.

    Both samples are collapsed to counts per distinct value and accumulated with
    ``running_totals``, which splits features into ordered ranges.
    """
    zero = F.lit(0)
    one = F.lit(1)
    both = (to_long(baseline, [], cols).select("feature", "value", one.alias("a"), zero.alias("b"))
            .unionByName(to_long(current, [], cols).select("feature", "value", zero.alias("a"), one.alias("b")))
            .where("value IS NOT NULL"))
    run = running_totals(both, ["feature"], "value", ["a", "b"])
    gap = F.abs(F.col("cum_a") / F.col("tot_a") - F.col("cum_b") / F.col("tot_b"))
    stat = run.groupBy("feature").agg(F.max(gap).alias("ks_statistic"), F.max("tot_a").alias("n_a"),
                                      F.max("tot_b").alias("n_b"))
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = en * F.col("ks_statistic")
    # The alternating series as a fold over its index: unrolled, the expression outgrows one
    # generated method.
    stat = stat.withColumn("_lam", lam)
    lam = F.col("_lam")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(
        k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return stat.withColumn("ks_pvalue", p).drop("_lam")


def spearman_with(df: DataFrame, target: str, cols: Sequence[str], key: str) -> DataFrame:
    """|rank correlation| of each feature with a target.

    Ranks are looked up by distinct value, then correlated in one grouped pass.
    """
    feats = to_long(df, [key, target], cols).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    ranks = value_ranks(feats.select("feature", "value"))
    ty = value_ranks(df.where(F.col(target).isNotNull()).select(
        F.lit(target).alias("feature"), F.col(target).cast("double").alias("value")))
    joined = (feats.join(ranks.select("feature", "value", F.col("rank").alias("rx")), ["feature", "value"])
              .join(ty.select(F.col("value").alias(target), F.col("rank").alias("ry")), target))
    return joined.groupBy("feature").agg(F.abs(F.corr("rx", "ry")).alias("spearman"))


def mutual_information(df: DataFrame, target: str, cols: Sequence[str], bins: int = 8) -> DataFrame:
    """Binned mutual information (nats) of each feature with a target, from joint counts."""
    shares = [i / bins for i in range(1, bins)]
    cuts = fitted_quantiles(df, [*cols, target], shares)

    def code(c: str) -> Column:
        return bucket_of(F.col(c).cast("double"), sorted(set(cuts[c])))

    coded = df.select(code(target).alias("ty"), *[code(c).alias(c) for c in cols])
    joint = coded.unpivot(["ty"], list(cols), "feature", "tx").groupBy("feature", "tx", "ty").agg(
        F.count(F.lit(1)).alias("n"))
    # At most bins x bins rows per feature from here on.
    f, x, y = (Window.partitionBy(*k) for k in (["feature"], ["feature", "tx"], ["feature", "ty"]))
    n, t = F.col("n"), F.sum("n").over(f)
    term = n / t * F.ln(n * t / (F.sum("n").over(x) * F.sum("n").over(y)))
    return joint.select("feature", term.alias("term")).groupBy("feature").agg(F.sum("term").alias("mi"))
