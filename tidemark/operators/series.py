"""Daily price-series metrics.

Input is (key, d, v) with at most one row per key and calendar day (see
``daily_close``), so a per-key window holds a few thousand rows however large
the feed is.  All metrics of a key come from one exchange and one sort; asking
for fewer metrics lets the optimizer drop the windows that are not needed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.joins import value_on_or_before
from tidemark.rules import DRAWDOWN_ENTRY, RECOVERY_SHARE, RISK_FREE, TRADING_DAYS, VOL_FLOOR

METRICS = [
    "cagr_1yr", "cagr_3yr", "cagr_5yr", "vol_1yr", "sharpe_1yr", "sortino_1yr", "max_drawdown",
    "recovery_time", "momentum_6m", "consistency_1y", "tracking_error_1y", "nav_recency",
    "record_count",
]
LOOKBACK_DAYS, MIN_YEAR_ROWS, MIN_FIVE_YEAR_ROWS = 400, 20, 260


def by_key() -> Window:
    return Window.partitionBy("key").orderBy("d")


def returns(series: DataFrame) -> DataFrame:
    """Previous-row simple and log returns."""
    prev = F.lag("v").over(by_key())
    return series.select("key", "d", "v", (F.col("v") / prev - 1).alias("ret"),
                         F.ln(F.col("v") / prev).alias("log_ret"))


def index_to_100(series: DataFrame) -> DataFrame:
    first = F.first("v").over(by_key().rowsBetween(Window.unboundedPreceding, 0))
    return series.select("key", "d", (F.col("v") / first * 100).alias("indexed"))


def cagr(start: Column, end: Column, years: float) -> Column:
    return F.when((start > 0) & end.isNotNull(), F.pow(end / start, F.lit(1.0 / years)) - 1)


def index_features(index: DataFrame, ref: dt.date) -> DataFrame:
    """Per date: 252-row return inside five years, log return inside the lookback."""
    # One row per calendar day, so the unkeyed window is a few thousand rows.
    w = Window.partitionBy(F.lit(1)).orderBy("d")
    day = F.lit(ref).cast("date")
    five, year = F.add_months(day, -60), F.date_sub(day, LOOKBACK_DAYS)
    long_ret = F.col("v") / F.lag("v", TRADING_DAYS).over(w) - 1
    day_ret = F.ln(F.col("v") / F.lag("v").over(w))
    return (index.where(F.col("d") <= day).select(
        "d",
        F.when(F.lag("d", TRADING_DAYS).over(w) >= five, long_ret).alias("idx_ret_252"),
        F.when(F.lag("d").over(w) >= year, day_ret).alias("idx_log_ret")))


def price_metrics(series: DataFrame, ref: dt.date, index: DataFrame | None = None) -> DataFrame:
    """All thirteen metrics per key as of ``ref``; keys without a positive price are dropped."""
    day = F.lit(ref).cast("date")
    y1, y3, y5 = (F.add_months(day, -12 * n) for n in (1, 3, 5))
    m6, lookback = F.add_months(day, -6), F.date_sub(day, LOOKBACK_DAYS)

    rows = series.where((F.col("d") <= day) & F.col("v").isNotNull())
    if index is not None:
        # Calendar-sized side: one row per day, planned as a broadcast by size.
        rows = rows.join(index_features(index, ref), "d", "left")
    else:
        rows = rows.withColumns({"idx_ret_252": F.lit(None).cast("double"),
                                 "idx_log_ret": F.lit(None).cast("double")})

    w = by_key()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "log_ret": F.when(F.lag("d").over(w) >= lookback, F.ln(F.col("v") / F.lag("v").over(w))),
        "ret_252": F.when(F.lag("d", TRADING_DAYS).over(w) >= y5,
                          F.col("v") / F.lag("v", TRADING_DAYS).over(w) - 1),
        "peak": F.max(F.when(F.col("d") >= y3, F.col("v"))).over(past),
    })
    rows = rows.withColumn("drawdown", F.when(F.col("d") >= y3, (F.col("v") - F.col("peak")) / F.col("peak")))
    rows = with_recovery_days(rows, w)

    year_rows = F.count_if(F.col("d") >= lookback)
    positive_rows = F.count_if(F.col("d") >= y3)
    five_rows = F.count_if(F.col("d") >= y5)
    active = F.col("log_ret") - F.col("idx_log_ret")
    annual = F.sqrt(F.lit(float(TRADING_DAYS)))
    downside = F.when(F.col("log_ret") < 0, F.col("log_ret"))
    agg = rows.groupBy("key").agg(
        F.max_by("v", "d").alias("v_ref"),
        value_on_or_before("v", "d", y1).alias("v_1y"),
        value_on_or_before("v", "d", y3).alias("v_3y"),
        value_on_or_before("v", "d", y5).alias("v_5y"),
        value_on_or_before("v", "d", m6).alias("v_6m"),
        year_rows.alias("n_year"), five_rows.alias("n_five"), positive_rows.alias("n_three"),
        (F.stddev_samp("log_ret") * annual).alias("vol"),
        F.count(downside).alias("n_down"),
        (F.stddev_samp(downside) * annual).alias("down"),
        F.min("drawdown").alias("dd"),
        F.percentile("recovery_days", 0.5).alias("recovery"),
        F.avg((F.col("ret_252") > F.col("idx_ret_252")).cast("double")).alias("beat_index"),
        F.avg((F.col("ret_252") > 0).cast("double")).alias("beat_zero"),
        (F.stddev_samp(active) * annual).alias("te"), F.count(active).alias("n_active"),
        F.max("d").alias("last_d"), F.count(F.lit(1)).alias("record_count"),
    ).where(F.col("v_ref") > 0)

    enough = F.col("n_year") >= MIN_YEAR_ROWS
    vol = F.when(enough, F.greatest("vol", F.lit(VOL_FLOOR)))
    down = F.greatest(F.when(F.col("n_down") > 1, F.col("down")).otherwise(0.0), F.lit(VOL_FLOOR))
    c1 = cagr(F.col("v_1y"), F.col("v_ref"), 1)
    return agg.select(
        "key",
        c1.alias("cagr_1yr"),
        cagr(F.col("v_3y"), F.col("v_ref"), 3).alias("cagr_3yr"),
        cagr(F.col("v_5y"), F.col("v_ref"), 5).alias("cagr_5yr"),
        vol.alias("vol_1yr"),
        C.clip((c1 - RISK_FREE) / vol, -10, 10).alias("sharpe_1yr"),
        F.when(enough, C.clip((c1 - RISK_FREE) / down, -10, 20)).alias("sortino_1yr"),
        F.when(F.col("n_three") >= 2, F.col("dd")).alias("max_drawdown"),
        F.when(F.col("n_three") >= 2, F.col("recovery")).alias("recovery_time"),
        F.when(F.col("v_6m") > 0, F.col("v_ref") / F.col("v_6m") - 1).alias("momentum_6m"),
        F.when(F.col("n_five") >= MIN_FIVE_YEAR_ROWS,
               F.coalesce("beat_index", "beat_zero")).alias("consistency_1y"),
        F.when(enough & (F.col("n_active") >= MIN_YEAR_ROWS), F.col("te")).alias("tracking_error_1y"),
        F.datediff(day, F.col("last_d")).alias("nav_recency"),
        "record_count",
    )


def with_recovery_days(rows: DataFrame, w: Window) -> DataFrame:
    """Add ``recovery_days`` on the row that closes a drawdown episode.

    Gaps and islands: a row below the entry threshold can only open an episode,
    a row back near the peak can only close one, and the two never coincide, so
    the state is the last such event and episodes start and end where it flips.
    """
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    event = (F.when(F.col("drawdown") < DRAWDOWN_ENTRY, 1)
             .when(F.col("v") >= F.col("peak") * RECOVERY_SHARE, 0))
    rows = rows.withColumn("_event", F.when(F.col("drawdown").isNotNull(), event))
    rows = rows.withColumn("_state", F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit(0)))
    opened = (F.col("_event") == 1) & (F.col("_state") == 0)
    rows = rows.withColumn("_opened", F.last(F.when(opened, F.col("d")), ignorenulls=True).over(past))
    closed = (F.col("_event") == 0) & (F.col("_state") == 1)
    return rows.withColumn("recovery_days", F.when(closed, F.datediff("d", "_opened"))).drop(
        "_event", "_state", "_opened")


def index_cagr(index: DataFrame, years: Sequence[int] = (3, 5)) -> DataFrame:
    """First value inside the window to the last value, per horizon (one row)."""
    end = index.agg(F.max("d").alias("m")).scalar()
    out = []
    for n in years:
        inside = F.col("d") >= F.add_months(end, -12 * n)
        start = F.min_by("v", F.when(inside, F.col("d")))
        rows = F.count_if(inside)
        out.append(F.when((rows >= 2) & (start > 0),
                          F.pow(F.max_by("v", "d") / start, F.lit(1.0 / n)) - 1).alias(f"index_cagr_{n}y"))
    return index.agg(*out)


def market_regime(series: DataFrame, ref: dt.date) -> DataFrame:
    """Median 12-month return over all keys: bull above 15 %, bear below zero, else sideways."""
    from tidemark.operators.quantiles import exact_quantiles

    day = F.lit(ref).cast("date")
    per_key = series.groupBy("key").agg(
        value_on_or_before("v", "d", F.add_months(day, -12)).alias("v0"),
        value_on_or_before("v", "d", day).alias("v1"))
    ret = per_key.select((F.col("v1") / F.col("v0") - 1).alias("ret"))
    median = exact_quantiles(ret, ["ret"], [0.5]).agg(F.max(F.col("q")[0]).alias("median_return"))
    m = F.col("median_return")
    return median.select(m, F.when(m > 0.15, "bull").when(m < 0, "bear").otherwise("sideways").alias("regime"))
