"""Peer-group risk bands, quantile labels and score thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import catalogue as G
from tidemark.operators.ordering import ordered_rank
from tidemark.operators.quantiles import exact_quantiles, grouped_quantile_columns
from tidemark.sources.lineage import settle


def group_zscore(df: DataFrame, cols: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Add ``z_<col>``: sample-deviation z-score inside the group, 0 when it is constant.

    Moments are grouped aggregates joined back, not windows, so a group that
    holds a third of the rows is combined map-side instead of landing in one task.
    """
    stats = df.groupBy(*group).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    joined = df.join(stats, list(group))
    return joined.withColumns({
        f"z_{c}": F.when(F.col(f"_s_{c}") > 1e-9, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
        .otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in cols
    }).drop(*[f"_{k}_{c}" for k in "ms" for c in cols])


def quantile_band(score: Column, cuts: Sequence[Column]) -> Column:
    """0-based band: right-closed intervals between ascending cut points."""
    out = F.when(score <= cuts[0], 0)
    for i, cut in enumerate(cuts[1:], 1):
        out = out.when(score <= cut, i)
    return F.when(score.isNotNull(), out.otherwise(len(cuts)))


def risk_scores(funds: DataFrame, metrics: DataFrame, w_vol: float = 0.5, w_dd: float = 0.5,
                min_group: int = 5) -> DataFrame:
    """Weighted volatility/drawdown z-score of funds in peer groups of at least ``min_group``."""
    hist = metrics.select(F.col("key").alias("code"), "vol_1yr", F.abs("max_drawdown").alias("abs_dd"))
    valid = (funds.select("code", "category").join(hist, "code")
             .where("vol_1yr IS NOT NULL AND abs_dd IS NOT NULL AND category IS NOT NULL"))
    sizes = valid.groupBy("category").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_group)
    scored = group_zscore(valid.join(sizes, "category", "left_semi"), ["vol_1yr", "abs_dd"], ["category"])
    return scored.select("code", "category",
                         (w_vol * F.col("z_vol_1yr") + w_dd * F.col("z_abs_dd")).alias("risk_score"))


def group_quantile_band(scores: DataFrame, group: str = "category", score: str = "risk_score") -> DataFrame:
    """Add ``band_ord`` 0-4 from the P20/P40/P60/P80 of the group."""
    scores = settle(scores)  # the cut points and the banding both read it
    cuts = grouped_quantile_columns(scores, score, [0.2, 0.4, 0.6, 0.8], [group],
                                    ["p20", "p40", "p60", "p80"]).drop("n")
    joined = scores.join(cuts, group)
    return joined.withColumn(
        "band_ord", quantile_band(F.col(score), [F.col(f"p{p}") for p in (20, 40, 60, 80)])
    ).drop("p20", "p40", "p60", "p80")


def clamp_band(df: DataFrame, band: str = "band_ord", category: str = "category") -> DataFrame:
    """Clamp the band to the first matching category floor and ceiling and name it."""
    lo = G.bound_floor(F.col(category))
    hi = G.bound_ceiling(F.col(category))
    clamped = F.coalesce(F.greatest(lo, F.least(hi, F.col(band))), F.col(band))
    # greatest/least skip NULL bounds, which is exactly "no rule, keep the band".
    return df.withColumns({"band_ord": clamped, "band": C.tier_name(clamped, rules.TIERS)})


def fund_risk_bands(funds: DataFrame, metrics: DataFrame) -> DataFrame:
    return clamp_band(group_quantile_band(risk_scores(funds, metrics)))


# --- quantile labels --------------------------------------------------------

def label_by_quantiles(df: DataFrame, score: str, cuts: Sequence[float] = tuple(rules.LABEL_QUANTILES)) -> DataFrame:
    """Right-closed quantile bins (lowest included) as ``tier_ord`` and ``risk_label``."""
    q = exact_quantiles(df, [score], cuts).agg(F.max("q").alias("q")).scalar()
    band = quantile_band(F.col(score), [q[i] for i in range(len(cuts))])
    return df.withColumns({"tier_ord": band, "risk_label": C.tier_name(band, rules.TIERS)})


def bin_thresholds(labelled: DataFrame, score: str = "risk_score") -> DataFrame:
    """Lower score bound of classes 1-4 as one ARRAY, gaps linearly interpolated."""
    mins = labelled.agg(*[
        F.min(F.when(F.col("risk_label") == name, F.col(score))).alias(f"t{i}")
        for i, name in enumerate(rules.TIERS) if i > 0])
    n = len(rules.TIERS) - 1
    known = [F.col(f"t{i}") for i in range(1, n + 1)]
    filled = []
    for i in range(n):
        left = [(i - j, known[j]) for j in range(i - 1, -1, -1)]
        right = [(j - i, known[j]) for j in range(i + 1, n)]
        out = F.when(known[i].isNotNull(), known[i])
        for dl, lv in left:
            for dr, rv in right:
                between = [known[j] for j in range(i - dl + 1, i + dr) if j != i]
                empty = known[i].isNull()
                for b in between:
                    empty = empty & b.isNull()
                out = out.when(empty & lv.isNotNull() & rv.isNotNull(),
                               lv + (rv - lv) * (dl / (dl + dr)))
        # At the ends the nearest known bound is repeated; with none at all, spread over [0, 1].
        nearest = F.coalesce(*([lv for _, lv in left] + [rv for _, rv in right]))
        filled.append(out.otherwise(F.coalesce(nearest, F.lit(i / (n - 1)))))
    return mins.select(F.array(*filled).alias("thresholds"))


def label_from_thresholds(score: Column, thresholds: Column) -> Column:
    """Number of thresholds not above the score, as a tier name."""
    passed = sum(((thresholds[i] <= score).cast("int") for i in range(len(rules.TIERS) - 1)), F.lit(0))
    return C.tier_name(passed, rules.TIERS)


def label_encode(df: DataFrame, col: str, out: str, fitted: DataFrame | None = None,
                 fallback: str = "Medium") -> DataFrame:
    """Alphabetical integer codes; values unseen at fit time take the fallback's code.

    The codes come from the distinct values, so the ranking window sees one row
    per class and the join back is on a table of that size.
    """
    codes = label_codes(df, col) if fitted is None else fitted
    joined = df.join(codes.withColumnRenamed("value", col), col, "left")
    known = codes.where(F.col("value") == fallback).agg(F.max("code").alias("c")).scalar()
    return joined.withColumn(out, F.coalesce("code", known)).drop("code")


def label_codes(df: DataFrame, col: str) -> DataFrame:
    values = df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("value")
    return values.select("value", (F.row_number().over(w) - 1).alias("code"))


def rank_values(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Descending average rank over a small table (one row per feature)."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(col).desc())
    ties = Window.partitionBy(col)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def cohort_waves(df: DataFrame, key: str, n: int, seed: str = "waves") -> DataFrame:
    """Near-equal shuffled cohorts: hash order, placed by range, cut into n equal parts."""
    spread = df.select(key, F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed))).alias("_h"))
    placed = ordered_rank(spread, [F.col("_h"), F.col(key)], "_at")
    pos = placed.withColumn("_tot", placed.agg(F.count(F.lit(1))).scalar())
    at = F.col("_at")
    small = F.floor(F.col("_tot") / n)
    extra = F.col("_tot") % n
    edge = extra * (small + 1)
    wave = F.when(at < edge, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - edge) / small))
    return pos.select(key, (wave + 1).cast("int").alias("wave"))
