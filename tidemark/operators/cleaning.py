"""Row-level cleaning, gap filling, selection and customer feature building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators.quantiles import fitted_quantiles
from tidemark.sources.lineage import settle


def clean_numeric_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers of the text columns ``cols``. They are cleaned as one array: with an expression for each of many
    columns the generated stage ran slower than without code generation."""
    present = [c for c in cols if c in df.columns]
    if len(present) < 2:
        return df.withColumns({c: C.clean_numeric(F.col(c)) for c in present})
    cleaned = F.transform(F.array(*[F.col(c).cast("string") for c in present]), C.clean_numeric)
    return df.withColumn("_clean", cleaned).withColumns({c: F.get("_clean", F.lit(i)) for i, c in enumerate(present)}).drop("_clean")


def apply_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]],
                 non_negative: Sequence[str] = ()) -> DataFrame:
    """Clamp the floor-only columns, then blank values outside their valid range."""
    out = {c: C.clamp_floor(F.col(c)) for c in non_negative if c in df.columns}
    out |= {c: C.null_out_of_range(F.col(c), lo, hi)
            for c, (lo, hi) in bounds.items() if c in df.columns}
    return df.withColumns(out)


def neighbours(
    df: DataFrame,
    cols: Sequence[str],
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add ``prev_c`` and ``next_c``: nearest non-null value at or before / at or after each row.

    ``chunk`` is any column expression that is non-decreasing along ``order``
    (a month, an id range).  With it, a very large key is scanned chunk by chunk
    in parallel and only one summary row per (key, chunk) is carried across, so
    a key holding a third of all rows does not become one task.  ``exclusive``
    leaves the row itself out.
    """
    key = list(key)
    gap = 1 if exclusive else 0
    backwards = [F.col(o).desc() for o in order]

    def frames(*part: str):
        # Looking ahead is looking back in reverse order: both frames grow row by row, where
        # a frame open to the following side would be rescanned from every row.
        by = part or [F.lit(0)]
        grow = (Window.unboundedPreceding, -gap)
        return (Window.partitionBy(*by).orderBy(*order).rowsBetween(*grow),
                Window.partitionBy(*by).orderBy(*backwards).rowsBetween(*grow))

    if chunk is None:
        back, ahead = frames(*key)
        return df.withColumns({f"prev_{c}": F.last(c, ignorenulls=True).over(back) for c in cols}).withColumns(
            {f"next_{c}": F.last(c, ignorenulls=True).over(ahead) for c in cols})
    cut = df.withColumn("_chunk", chunk)
    keys = [*key, "_chunk"]
    back, ahead = frames(*keys)
    local = cut.withColumns(
        {f"_f_{c}": F.last(c, ignorenulls=True).over(back) for c in cols}
        | {"_i": F.row_number().over(Window.partitionBy(*keys).orderBy(*order))})
    local = local.withColumns(
        {f"_b_{c}": F.last(c, ignorenulls=True).over(ahead) for c in cols}
        | {"_j": F.row_number().over(Window.partitionBy(*keys).orderBy(*backwards))})
    # Chunk edges: the last row has seen every value looking back, the first row looking ahead.
    # Grouped on the windows' own partitioning, so the rows are not shuffled again.
    seen_back = {c: F.coalesce(c, f"_f_{c}") if exclusive else F.col(f"_f_{c}") for c in cols}
    seen_ahead = {c: F.coalesce(c, f"_b_{c}") if exclusive else F.col(f"_b_{c}") for c in cols}
    edges = local.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_j") == 1, seen_back[c])).alias(f"_l_{c}") for c in cols],
        *[F.max(F.when(F.col("_i") == 1, seen_ahead[c])).alias(f"_s_{c}") for c in cols],
    )
    across = key or [F.lit(0)]  # one row per (key, chunk)
    grow = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*across).orderBy("_chunk").rowsBetween(*grow)
    later = Window.partitionBy(*across).orderBy(F.col("_chunk").desc()).rowsBetween(*grow)
    carried = edges.select(
        *key, "_chunk",
        *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_p_{c}") for c in cols],
        *[F.last(f"_s_{c}", ignorenulls=True).over(later).alias(f"_n_{c}") for c in cols],
    )
    joined = local.join(carried, keys)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_f_{c}", f"_p_{c}").alias(f"prev_{c}") for c in cols],
        *[F.coalesce(f"_b_{c}", f"_n_{c}").alias(f"next_{c}") for c in cols])


HOT_KEY = 10_000  # rows from which a key is filled chunk by chunk


def fill_within_key(df: DataFrame, cols: Sequence[str], key: str, order: Sequence[str],
                    chunk: Column | None = None, hot: int = HOT_KEY) -> DataFrame:
    """Forward then backward fill inside each key, in the order given.

    Rows that find nothing looking back stand before the key's first value, so this value is what they find looking
    ahead: one sort serves both. With ``chunk`` (see ``neighbours``), keys of more than ``hot`` rows are filled chunk
    by chunk in parallel; rows without a key or a chunk are left out.
    """
    cols = list(cols)
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    past = (Window.unboundedPreceding, 0)

    def named(back: str, ahead: str) -> list[Column]:
        return [F.coalesce(f"{back}{c}", f"{ahead}{c}").alias(c) if c in cols else F.col(c) for c in df.columns]

    def at_once(rows: DataFrame) -> DataFrame:
        line = Window.partitionBy(key).orderBy(*order)
        return rows.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(line.rowsBetween(*past)) for c in cols}
                                | {f"_n_{c}": F.first(c, ignorenulls=True).over(line.rowsBetween(*whole)) for c in cols})

    if chunk is None:
        return at_once(df).select(*named("_f_", "_n_"))
    # At most one key in ``hot`` rows.
    large = F.broadcast(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(key))
    small = at_once(df.join(large, key, "left_anti").where(F.col(key).isNotNull()).withColumn("_chunk", chunk)) \
        .where("_chunk IS NOT NULL").select(*named("_f_", "_n_"))
    cut = df.join(large, key, "left_semi").withColumn("_chunk", chunk)
    keys = [key, "_chunk"]
    line = Window.partitionBy(*keys).orderBy(*order)
    back = [F.last(c, ignorenulls=True).over(line.rowsBetween(*past)).alias(f"_f_{c}") for c in cols]
    # The last row of a chunk has seen all of it: one row per (key, chunk), without another sort or aggregate.
    edges = cut.select(*keys, *back, *[F.first(c, ignorenulls=True).over(line.rowsBetween(*past)).alias(f"_s_{c}") for c in cols],
                       F.lead(F.lit(1)).over(line).alias("_more")).where("_more IS NULL")
    chunks = Window.partitionBy(key).orderBy("_chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, *[F.coalesce(F.last(f"_f_{c}", ignorenulls=True).over(earlier),
                                               F.first(f"_s_{c}", ignorenulls=True).over(chunks.rowsBetween(*whole))).alias(f"_n_{c}") for c in cols])
    local = cut.select(*keys, *[c for c in df.columns if c not in (*keys, *cols)], *back)
    return small.unionByName(local.join(carried, keys).select(*named("_f_", "_n_")))


def fill_global_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    medians = fitted_quantiles(df, cols, [0.5])
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(medians[c][0]).cast("double")) for c in cols})


def winsorize(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    limits = fitted_quantiles(df, cols, [lo, hi])
    return df.withColumns({c: C.clip(F.col(c), *limits[c]) for c in cols})


def drop_columns_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def last_k_per_key(df: DataFrame, key: str, order: Sequence[str], k: int = 4) -> DataFrame:
    """Last k rows per key.  The rank filter is pushed below the shuffle as a group limit, so
    a hot key sends at most k rows per input task."""
    recent = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(recent)).where(F.col("_rn") <= k).drop("_rn")


def filter_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    keep = F.lit(True)
    for c, (lo, hi) in ranges.items():
        keep = keep & F.col(c).between(lo, hi)
    return df.where(keep)


def filter_funds(df: DataFrame, min_aum: float | None = None,
                 type_contains: str | None = None) -> DataFrame:
    """Priced funds, optionally above an AUM and with a scheme type containing a word."""
    out = df.where(F.col("price").isNotNull())
    if min_aum is not None:
        out = out.where(F.col("aum") >= min_aum)
    if type_contains:
        out = out.where(F.contains(F.lower("scheme_type"), F.lit(type_contains.lower())))
    return out


def clip_columns(df: DataFrame, cols: Sequence[str], lo: float, hi: float) -> DataFrame:
    return df.withColumns({c: C.clip(F.col(c), lo, hi) for c in cols})


# --- scaling ---------------------------------------------------------------

def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per feature (feature, lo, hi); persist it with a sink to reuse at inference."""
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    wide = df.agg(*[F.min(zero[c]).alias(f"{c}__lo") for c in cols],
                  *[F.max(zero[c]).alias(f"{c}__hi") for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__lo").alias("lo"),
                               F.col(f"{c}__hi").alias("hi")) for c in cols])
    return wide.select(F.inline(pairs))


def apply_minmax(df: DataFrame, fitted: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Scale ``renames`` keys to [0,1] under their new names; a constant column becomes 0."""
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in fitted.collect()}
    out = {}
    for c, name in renames.items():
        lo, hi = bounds[c]
        value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        span = (hi or 0.0) - (lo or 0.0)
        out[name] = (value - F.lit(lo)) / F.lit(span if span > 0 else 1.0)
    return df.withColumns(out)


# --- customer pipeline -----------------------------------------------------

MEAN_COLUMNS = [c for c in rules.BANK_NUMERIC if c != "Age"] + [
    "Credit_Mix_Score", "Spending_Behaviour_Score", "Occupation_Stability_Score",
    "Credit_History_Months",
]

# raw column -> scaled feature name
FEATURE_SOURCES = {
    "Annual_Income": "Annual_Income_norm",
    "Monthly_Inhand_Salary": "Monthly_Inhand_Salary_norm",
    "Investment_Ratio": "Investment_Ratio",
    "Debt_Burden_Ratio": "Debt_Burden_Ratio",
    "Credit_Utilization_Ratio": "Credit_Utilization_Ratio",
    "Delay_Score": "Delay_Score",
    "Credit_Mix_Score": "Credit_Mix_Score",
    "Spending_Behaviour_Score": "Spending_Behaviour_Score",
    "Num_Bank_Accounts": "Num_Bank_Accounts_norm",
    "Interest_Rate": "Interest_Rate_norm",
    "Age_Risk_Proxy": "Age_Risk_Proxy",
    "Occupation_Stability_Score": "Occupation_Stability_Score",
    "EMI_Income_Ratio": "EMI_Income_Ratio",
    "Savings_Rate": "Savings_Rate",
    "Credit_History_Score": "Credit_History_Score",
}


def encode_categories(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Credit_Mix_Score": C.map_category(
            F.col("Credit_Mix"), rules.CREDIT_MIX_SCORE, rules.CREDIT_MIX_DEFAULT),
        "Spending_Behaviour_Score": C.map_category(
            F.col("Payment_Behaviour"), rules.PAYMENT_SCORE, rules.PAYMENT_DEFAULT),
        "Occupation_Stability_Score": C.map_category(
            F.col("Occupation"), rules.OCCUPATION_SCORE, rules.OCCUPATION_DEFAULT),
    })


RECORD_TEXTS = ["Credit_History_Age", "Credit_Mix", "Payment_Behaviour", "Occupation"]


def clean_bank_records(df: DataFrame, order: Sequence[str], chunk: Column | None = None,
                       key: str = "Customer_ID", texts: bool = True) -> DataFrame:
    """Dirty monthly text rows to clean numeric rows, still one row per record; without ``texts`` the texts that
    became months and scores are left out."""
    numeric = rules.BANK_NUMERIC
    typed = apply_bounds(clean_numeric_columns(df, numeric), rules.COLUMN_BOUNDS,
                         rules.NON_NEGATIVE)
    typed = typed.withColumn("Credit_History_Months",
                             C.parse_duration_months(F.col("Credit_History_Age")))
    typed = encode_categories(typed)
    # The texts are parsed once: filling reads its rows twice, for the chunks' edges and for the rows.
    typed = settle(typed if texts else typed.drop(*RECORD_TEXTS))
    # Medians and clip limits are fitted on the filled rows; settle them once so that each fit
    # is a column-pruned scan and not a repeat of the per-customer shuffle.
    filled = settle(fill_within_key(typed, numeric, key, order, chunk))
    filled = fill_global_median(filled, [*numeric, "Credit_History_Months"])
    return winsorize(filled, rules.WINSORISED)


def aggregate_per_customer(df: DataFrame, order: Sequence[str],
                           key: str = "Customer_ID") -> DataFrame:
    """First non-null age (rounded) and the mean of everything else; map-side combined."""
    pos = F.struct(*order)
    age = F.min_by("Age", F.when(F.col("Age").isNotNull(), pos))
    return df.groupBy(key).agg(
        F.bround(age, 0).cast("int").alias("Age"),
        *[F.avg(c).alias(c) for c in MEAN_COLUMNS],
    )


def raw_features(agg: DataFrame) -> DataFrame:
    """Unscaled ratios and scores on the per-customer aggregate."""
    zero = F.lit(0.0)
    salary = F.coalesce("Monthly_Inhand_Salary", zero)
    emi = F.coalesce("Total_EMI_per_month", zero)
    return agg.withColumns({
        "Investment_Ratio": C.safe_ratio(
            F.col("Amount_invested_monthly"), F.col("Monthly_Inhand_Salary"), 0, 5),
        "Debt_Burden_Ratio": C.safe_ratio(
            F.col("Outstanding_Debt"), F.col("Annual_Income"), 0, 5),
        "Delay_Score": F.coalesce("Delay_from_due_date", zero)
        + F.coalesce("Num_of_Delayed_Payment", zero),
        "Age_Risk_Proxy": C.age_proxy(F.col("Age")),
        "EMI_Income_Ratio": C.safe_ratio(emi, F.col("Monthly_Inhand_Salary"), 0, 3),
        "Savings_Rate": C.clip((salary - emi) / (salary + C.EPS), -1, 1),
        "Credit_History_Score": F.coalesce("Credit_History_Months", zero),
    })


def customer_features(
    records: DataFrame,
    order: Sequence[str],
    chunk: Column | None = None,
    fitted: DataFrame | None = None,
    key: str = "Customer_ID",
) -> DataFrame:
    """Dirty bank records to the fifteen scaled features, one row per customer."""
    raw = raw_features(aggregate_per_customer(
        clean_bank_records(records, order, chunk, key, texts=False), order, key))
    bounds = fit_minmax(raw, list(FEATURE_SOURCES)) if fitted is None else fitted
    scaled = apply_minmax(raw, bounds, FEATURE_SOURCES)
    return scaled.select(key, "Age", *rules.RISK_FEATURES)
