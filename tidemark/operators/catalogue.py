"""Fund catalogue: keyword classes, benchmark attachment, quality mode, feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import joins as J
from tidemark.sources.lineage import settle

RETURNS = ["fund_return_1y", "fund_return_3y", "fund_return_5y"]
BENCHMARKS = ["benchmark_return_1y", "benchmark_return_3y", "benchmark_return_5y"]


# --- keyword classes: one generated CASE per row, no join -------------------

def keyword_tier(category: Column) -> Column:
    return C.first_keyword(category, C.group_rules(rules.TIER_KEYWORDS))


def bound_floor(category: Column) -> Column:
    return C.first_keyword(category, [(w, lo) for w, lo, _ in rules.CATEGORY_BOUNDS])


def bound_ceiling(category: Column) -> Column:
    return C.first_keyword(category, [(w, hi) for w, _, hi in rules.CATEGORY_BOUNDS])


def asset_segment(category: Column) -> Column:
    return F.coalesce(C.first_keyword(category, C.group_rules(rules.SEGMENT_KEYWORDS)), F.lit("Other"))


def style_bucket(category: Column) -> Column:
    return F.coalesce(C.first_keyword(category, C.group_rules(rules.STYLE_KEYWORDS)), F.lit("other"))


def asset_class(category: Column) -> Column:
    return F.when(asset_segment(category) == "Equity", "equity").otherwise("debt")


def benchmark_eligible(category: Column, scheme_type: Column) -> Column:
    low = F.lower(F.coalesce(category, F.lit("")))
    is_open = F.contains(F.lower(F.coalesce(scheme_type, F.lit(""))), F.lit("open"))
    return F.when(is_open & C.contains_any(low, rules.BENCHMARK_KEYWORDS), 1).otherwise(0)


# --- benchmark snapshots ----------------------------------------------------

def snapshot_features(snapshots: DataFrame, order: Sequence[str],
                      index_cagr_3y: float | Column | None = None,
                      index_cagr_5y: float | Column | None = None) -> DataFrame:
    """Newest non-null value of each snapshot column per scheme, with excess returns."""
    cols = ["benchmark", "riskometer", "nav_date", "daily_aum", *RETURNS, *BENCHMARKS]
    # Collapse per raw name first: the join key is then cleaned once per scheme, not per row.
    raw = J.newest_values(snapshots, ["scheme_name"], order, cols)
    keyed = raw.withColumn("name_key", C.normalise_name(F.col("scheme_name")))
    merged = keyed.groupBy("name_key").agg(*[F.max(c).alias(c) for c in cols])
    # Read twice below (the newest date and the rows), aggregated once.
    last = settle(merged.select("name_key", *[F.col(c)["value"].alias(c) for c in cols]))
    newest = last.agg(F.max("nav_date").alias("m")).scalar()
    # Excess is taken before the returns are clipped.
    out = last.withColumns({
        f"excess_return_{h}y": F.col(f"fund_return_{h}y") - F.col(f"benchmark_return_{h}y")
        for h in (1, 3, 5)})
    out = out.withColumns({c: C.clip(F.col(c), -95, 300) for c in [*RETURNS, *BENCHMARKS]})

    def share(names: Sequence[str]) -> Column:
        return sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0)) / float(len(names))

    tiers = F.create_map(*[F.lit(x) for kv in rules.RISKOMETER_TIER.items() for x in kv])
    out = out.withColumns({
        "recency_days": F.greatest(F.datediff(newest, F.col("nav_date")), F.lit(0)),
        "benchmark_quality": share(BENCHMARKS),
        "snapshot_quality": share(RETURNS),
        "riskometer_tier": tiers[F.lower(F.trim("riskometer"))],
    })
    if index_cagr_3y is not None:
        c3 = index_cagr_3y if isinstance(index_cagr_3y, Column) else F.lit(index_cagr_3y)
        c5 = index_cagr_5y if isinstance(index_cagr_5y, Column) else F.lit(index_cagr_5y)
        out = out.withColumns({
            "excess_vs_index_3y": F.col("fund_return_3y") / 100.0 - c3,
            "excess_vs_index_5y": F.col("fund_return_5y") / 100.0 - c5,
        })
    return out


def attach_benchmark(funds: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Left join the snapshot on the normalised name and derive flags and the tier override."""
    keyed = funds.withColumn("name_key", C.normalise_name(F.col("name")))
    joined = keyed.join(snapshot, "name_key", "left").drop("name_key")
    zero = F.lit(0.0)
    out = joined.withColumns({
        "benchmark_quality": C.clip(F.coalesce("benchmark_quality", zero), 0, 1),
        "snapshot_quality": C.clip(F.coalesce("snapshot_quality", zero), 0, 1),
        "recency_days": F.greatest(F.coalesce(F.col("recency_days").cast("double"), F.lit(365.0)), zero),
        "eligible": benchmark_eligible(F.col("category"), F.col("scheme_type")),
    })
    out = out.withColumn(
        "benchmarked", F.when((F.col("eligible") == 1) & (F.col("benchmark_quality") >= 0.34), 1).otherwise(0))
    out = out.withColumn(
        "benchmark_status",
        F.when(F.col("benchmarked") == 1, "Benchmarked_With_Data")
        .when(F.col("eligible") == 1, "Eligible_No_Data").otherwise("Not_Eligible"))
    has_meter = F.col("riskometer_tier").isNotNull()
    return out.withColumns({
        "risk_tier": F.when(has_meter, F.col("riskometer_tier")).otherwise(F.col("risk_tier")),
        "risk_tier_source": F.when(has_meter, F.lit("riskometer")).otherwise(F.col("risk_tier_source")),
    })


def quality_mode(df: DataFrame) -> DataFrame:
    """2 = price history, 1 = performance snapshot only, 0 = neither."""
    any_return = F.coalesce(*[F.col(c) for c in RETURNS]).isNotNull()
    return df.withColumns({
        "has_history": F.coalesce(F.col("has_history"), F.lit(0)),
        "has_returns": any_return.cast("int"),
        "quality_mode": F.when(F.coalesce(F.col("has_history"), F.lit(0)) == 1, 2)
        .when(any_return, 1).otherwise(0),
    })


def build_catalogue(
    funds: DataFrame,
    bands: DataFrame | None = None,
    disclosures: DataFrame | None = None,
    disclosure_order: Sequence[str] = (),
    snapshot: DataFrame | None = None,
    history_keys: DataFrame | None = None,
) -> DataFrame:
    """Tagged catalogue: keyword tier, price-history band override, expense rate, benchmark
    flags with the published risk-o-meter on top, quality mode, priced funds only."""
    out = funds.withColumns({"risk_tier": keyword_tier(F.col("category")),
                             "risk_tier_source": F.lit("keyword")})
    if bands is not None:
        out = out.join(bands.select("code", F.col("band").alias("_band")), "code", "left").withColumns({
            "risk_tier": F.coalesce("_band", "risk_tier"),
            "risk_tier_source": F.when(F.col("_band").isNotNull(), F.lit("history"))
            .otherwise(F.col("risk_tier_source")),
        }).drop("_band")
    if disclosures is not None:
        out = J.attach_expense(out, disclosures, disclosure_order)
    if snapshot is not None:
        out = attach_benchmark(out, snapshot)
    if history_keys is not None:
        known = history_keys.select("code").distinct().withColumn("has_history", F.lit(1))
        out = out.join(known, "code", "left")
    else:
        out = out.withColumn("has_history", F.lit(0))
    if snapshot is None:
        out = out.withColumns({c: F.lit(None).cast("double") for c in RETURNS})
    return quality_mode(out).where(F.col("price").isNotNull())
