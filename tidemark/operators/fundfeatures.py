"""Numeric fund features and training targets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators.catalogue import BENCHMARKS, RETURNS
from tidemark.operators.quantiles import fitted_quantiles

HISTORY = ["cagr_1yr", "cagr_3yr", "cagr_5yr", "vol_1yr", "sharpe_1yr", "max_drawdown",
           "recovery_time", "momentum_6m", "consistency_1y"]
HIST_COLS = [f"{m}_hist" for m in HISTORY]
EXCESS = ["excess_return_1y", "excess_return_3y", "excess_return_5y"]
INDEX_EXCESS = ["excess_vs_index_3y", "excess_vs_index_5y"]
BASE_COLS = [
    "log_aum", "log_price", "log_min_amt", "fund_age_years", "price_recency_days",
    "is_open_ended", "is_active", "is_growth", "risk_tier_ord", "amc_is_top", "amc_size_norm",
    "expense_norm", "expense_real_norm", "expense_missing", "has_returns", "quality_mode",
    "regime_beta",
]
SNAPSHOT_COLS = [*RETURNS, *BENCHMARKS, *EXCESS, *INDEX_EXCESS, "daily_aum", "recency_days",
                 "eligible", "benchmarked", "riskometer_ord"]
FEATURE_COLS = [*BASE_COLS, *HIST_COLS, *SNAPSHOT_COLS]
MASKED = [*BENCHMARKS, *EXCESS, *INDEX_EXCESS]


def log_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "log_aum": F.log1p(F.coalesce("aum", F.lit(0.0))),
        "log_price": F.log1p(F.coalesce("price", F.lit(0.0))),
        "log_min_amt": F.log1p(F.coalesce("min_amt", F.lit(500.0))),
    })


def age_and_recency(df: DataFrame, ref: dt.date) -> DataFrame:
    day = F.lit(ref).cast("date")
    age = F.greatest(F.datediff(day, "launch_date") / 365.25, F.lit(0.0))
    recency = F.greatest(F.datediff(day, "latest_date"), F.lit(0)).cast("double")
    return df.withColumns({
        "fund_age_years": F.when(F.col("launch_date").isNotNull(), age).otherwise(0.0),
        "price_recency_days": F.when(F.col("latest_date").isNotNull(), recency).otherwise(365.0),
    })


def contains_flags(df: DataFrame) -> DataFrame:
    def has(c: str, word: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word)).cast("int")

    return df.withColumns({"is_open_ended": has("scheme_type", "open"), "is_growth": has("nav_name", "growth"),
                           "is_active": F.col("closure_date").isNull().cast("int")})


def launch_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"launch_year": F.year("launch_date"),
                           "is_closed": F.col("closure_date").isNotNull().cast("int")})


def frequency_encode(df: DataFrame, col: str, top_k: int = 15, missing: str = "Other") -> DataFrame:
    """In-top-k flag and count over the largest count.

    Counts combine map-side; the value table is joined back on equality, so the
    planner broadcasts it when small and splits the skewed value when it is not.
    """
    value = F.coalesce(F.col(col), F.lit(missing))
    counts = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.col("_n").desc(), "_v").limit(top_k).select("_v", F.lit(1).alias("_t"))
    biggest = counts.agg(F.max("_n").alias("m")).scalar()
    table = counts.join(top, "_v", "left").select(
        "_v", F.coalesce("_t", F.lit(0)).alias(f"{col}_is_top"), (F.col("_n") / biggest).alias(f"{col}_size_norm"))
    return df.withColumn("_v", value).join(table, "_v").drop("_v")


def expense_features(df: DataFrame) -> DataFrame:
    def norm(c: str) -> Column:
        return F.coalesce(C.clip(F.col(c) / 2.5, 0, 1), F.lit(0.0))

    return df.withColumns({"expense_norm": norm("expense"), "expense_real_norm": norm("expense_real"),
                           "expense_missing": F.coalesce("expense_missing", F.lit(1))})


def expense_proxy(df: DataFrame) -> DataFrame:
    """Exploratory rate built from traits; never used for recommendations."""
    text = F.lower(F.coalesce("nav_name", F.lit("")))
    index = C.contains_any(text, ["index", "etf", "nifty", "sensex"]).cast("double")
    debt = (F.coalesce(F.col("tier_ord") <= 1, F.lit(False))).cast("double")
    raw = 1.5 - 1.2 * index - 0.7 * debt - 0.3 * F.col("amc_size_norm")
    return df.withColumn("expense_proxy", F.round(C.clip(raw, 0.05, 2.5), 3))


def attach_metrics_with_median(df: DataFrame, metrics: DataFrame,
                               cols: Sequence[str] = tuple(HISTORY)) -> DataFrame:
    """Left join metrics on the fund code; missing values take the metric table's median."""
    medians = fitted_quantiles(metrics, cols, [0.5])
    slim = metrics.select(F.col("key").alias("code"), *[F.col(c).cast("double").alias(f"{c}_hist") for c in cols])
    flag = "cagr_3yr_hist" if "cagr_3yr" in cols else f"{cols[0]}_hist"
    joined = df.join(slim, "code", "left").withColumn("has_history", F.col(flag).isNotNull().cast("int"))
    return joined.withColumns({
        f"{c}_hist": F.coalesce(F.col(f"{c}_hist"), F.lit(medians[c][0]).cast("double")) for c in cols})


def mask_benchmark_features(df: DataFrame) -> DataFrame:
    """Benchmark-relative columns are zero unless the fund is benchmarked; the other snapshot
    columns are median-filled; percentages become fractions."""
    filled = [*RETURNS, "daily_aum", "recency_days"]
    medians = fitted_quantiles(df, filled, [0.5])
    bench = F.coalesce("benchmarked", F.lit(0)) > 0
    out = {c: F.coalesce(F.when(bench, F.col(c)), F.lit(0.0)) for c in MASKED}
    out |= {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0]).cast("double"), F.lit(0.0)) for c in filled}
    return df.withColumns({c: e / 100.0 if "return" in c else e for c, e in out.items()})


def regime_beta(df: DataFrame) -> DataFrame:
    vol = F.coalesce("vol_1yr_hist", F.lit(0.05))
    return df.withColumn("regime_beta", C.clip(F.coalesce("excess_return_1y", F.lit(0.0)) / (vol + 1e-6), -2, 2))


def assemble_fund_features(funds: DataFrame, metrics: DataFrame, ref: dt.date) -> DataFrame:
    """The 42 model features of a built catalogue, one row per fund."""
    df = contains_flags(age_and_recency(log_features(funds), ref))
    df = expense_features(frequency_encode(df, "amc"))
    df = attach_metrics_with_median(df.drop("has_history"), metrics)
    any_return = F.coalesce(*RETURNS).isNotNull()
    df = df.withColumns({
        "risk_tier_ord": C.tier_ordinal(F.col("risk_tier"), rules.TIERS),
        "riskometer_ord": C.tier_ordinal(F.col("riskometer_tier"), rules.TIERS),
        "has_returns": any_return.cast("int"),
        "quality_mode": F.when(F.col("has_history") == 1, 2).when(any_return, 1).otherwise(0),
    })
    df = regime_beta(mask_benchmark_features(df))
    return df.select("code", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLS])


# --- training targets -------------------------------------------------------

def _shares(df: DataFrame, exprs: dict[str, Column], eps: float = 1e-9) -> dict[str, Column]:
    """Min-max share of each expression; the bounds are one fitted row."""
    row = df.agg(*[F.min(e).alias(f"{n}__lo") for n, e in exprs.items()],
                 *[F.max(e).alias(f"{n}__hi") for n, e in exprs.items()]).first()
    return {n: (e - F.lit(row[f"{n}__lo"])) / (F.lit(row[f"{n}__hi"]) - F.lit(row[f"{n}__lo"]) + eps)
            for n, e in exprs.items()}


def alpha_target(df: DataFrame) -> DataFrame:
    ret = F.coalesce(C.clip(F.col("cagr_1yr_hist"), -0.5, 1.5), F.lit(0.0))
    bench = F.coalesce(C.clip(F.col("benchmark_return_1y"), -0.5, 1.5), F.lit(0.0))
    return df.withColumn("alpha", C.clip(ret - bench - F.col("expense_norm") * 0.025, -0.5, 0.5))


def quality_target(df: DataFrame, mode: str = "history") -> DataFrame:
    """Quality score in [0, 1] from price history, from snapshots only, or from metadata."""
    clip, col = C.clip, F.col
    weight = 0.10 * (1.0 - 0.5 * clip(col("expense_missing"), 0, 1))
    exprs = {"er": col("expense_norm")}
    if mode in ("history", "snapshot"):
        exprs |= {"f1": clip(col("fund_return_1y"), -0.5, 1.5), "ex1": clip(col("excess_return_1y"), -0.8, 1.5),
                  "stale": clip(col("recency_days"), 0, 3650)}
    if mode == "history":
        exprs |= {"c1": clip(col("cagr_1yr_hist"), -0.5, 1), "c3": clip(col("cagr_3yr_hist"), -0.5, 1),
                  "sh": clip(col("sharpe_1yr_hist"), -3, 5), "dd": -col("max_drawdown_hist"),
                  "mo": clip(col("momentum_6m_hist"), -0.5, 1)}
    elif mode == "snapshot":
        exprs |= {"f3": clip(col("fund_return_3y"), -0.5, 1.5), "f5": clip(col("fund_return_5y"), -0.5, 2),
                  "ex3": clip(col("excess_return_3y"), -0.5, 1.5), "ex5": clip(col("excess_return_5y"), -0.5, 1.5),
                  "exn": clip(col("excess_vs_index_3y"), -1, 1)}
    else:
        exprs |= {"aum": col("log_aum"), "rec": -col("price_recency_days"), "age": col("fund_age_years")}
    s = _shares(df, exprs)
    if mode == "fallback":
        q = 0.5 * s["aum"] + 0.3 * s["rec"] + 0.2 * s["age"] - weight * s["er"]
        return df.withColumn("quality", clip(q, 0, 1))
    # The snapshot quality share is not a model feature, so it enters as zero confidence.
    confidence = 0.70 + 0.10 * (1.0 - s["stale"])
    if mode == "snapshot":
        core = (0.24 * s["f1"] + 0.16 * s["f3"] + 0.10 * s["f5"] + 0.22 * s["ex1"] + 0.14 * s["ex3"]
                + 0.08 * s["ex5"] + 0.06 * s["exn"])
        return df.withColumn("quality", clip((core - weight * s["er"]) * confidence, 0, 1))
    blend = 0.667 * s["c1"] + 0.333 * s["c3"]
    q = clip(0.35 * blend + 0.25 * s["sh"] + 0.25 * s["dd"] + 0.15 * s["mo"] - weight * s["er"], 0, 1)
    forward = (0.6 * s["f1"] + 0.4 * s["ex1"]) * confidence
    return df.withColumn("quality", clip(0.75 * q + 0.25 * forward, 0, 1))
