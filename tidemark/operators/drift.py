"""Per-key and population drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.joins import key_intersection
from tidemark.operators.stats import ks_two_sample, psi


def delta_array(cols: Sequence[str]) -> Column:
    return F.array(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in cols])


def detect_drift(current: DataFrame, baseline: DataFrame, cols: Sequence[str], key: str = "key",
                 threshold: float = 0.25) -> DataFrame:
    """Largest absolute change per key present on both sides, the feature behind it, all deltas."""
    both = key_intersection(current.select(key, *cols), baseline.select(key, *cols), key)
    return drift_columns(both, key, cols, threshold)


def drift_columns(both: DataFrame, key: str, cols: Sequence[str], threshold: float) -> DataFrame:
    deltas = both.withColumn("deltas", delta_array(cols))
    names = F.array(*[F.lit(c) for c in cols])
    top = F.array_max("deltas")
    return deltas.select(
        key, F.round(top, 4).alias("max_delta"),
        F.element_at(names, F.array_position("deltas", top).cast("int")).alias("top_feature"),
        (top > threshold).alias("drifted"), "deltas")


def population_drift(baseline: DataFrame, current: DataFrame, cols: Sequence[str],
                     psi_limit: float = 0.25, alpha: float = 0.05) -> DataFrame:
    joined = psi(baseline, current, cols).join(ks_two_sample(baseline, current, cols), "feature", "left")
    enough = (F.col("n_a") >= 10) & (F.col("n_b") >= 10)
    severity = F.when(F.col("psi") > psi_limit, "HIGH").when(F.col("psi") > 0.10, "MODERATE").otherwise("LOW")
    return joined.select(
        "feature", F.round("psi", 4).alias("psi"), F.coalesce(F.col("psi") > psi_limit, F.lit(False)).alias("psi_flag"),
        F.when(enough, F.round("ks_statistic", 4)).alias("ks_statistic"),
        F.when(enough, F.round("ks_pvalue", 4)).alias("ks_pvalue"),
        F.coalesce(enough & (F.col("ks_pvalue") < alpha), F.lit(False)).alias("ks_flag"), severity.alias("severity"))


def drift_message(drift: DataFrame, cols: Sequence[str], key: str = "key", threshold: float = 0.25) -> DataFrame:
    """One sentence per key naming the three largest drifted features; empty when nothing drifted."""
    names = F.array(*[F.lit(c) for c in cols])
    pairs = F.filter(F.arrays_zip(F.col("deltas").alias("d"), names.alias("n")), lambda p: p["d"] > threshold)
    # Descending by delta; equal deltas keep feature order because positions sort ascending.
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["d"] > b["d"], -1).when(a["d"] < b["d"], 1).otherwise(0))
    listed = F.array_join(F.transform(F.slice(ordered, 1, 3), lambda p: F.concat(F.lit("'"), p["n"], F.lit("' (+"), C.fixed2(p["d"]), F.lit(")"))), ", ")
    text = F.concat(
        F.lit("⚠ Customer "), F.col(key).cast("string"), F.lit(": risk profile may be stale. Significant changes detected in: "),
        listed, F.lit(". Largest shift: '"), F.col("top_feature"), F.lit("' moved "),
        F.format_string("%.0f", F.rint(F.array_max("deltas") * 100)),
        F.lit("% of feature range. Re-run FL inference to update risk label."))
    return drift.select(key, F.when(F.col("drifted"), text).otherwise("").alias("message"))
