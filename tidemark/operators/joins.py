"""Keyed selection, prioritised lookups, as-of values, membership and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import columns as C
from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.lineage import settle


def _grouping(df: DataFrame, key: Sequence[str]) -> list[Column]:
    """``key``, led by a hash of its texts: aggregates that keep rows are sorted by group, and one number decides
    nearly every comparison that texts with a common start would be read for."""
    texts = [c for c in key if isinstance(df.schema[c].dataType, StringType)]
    return [*([F.xxhash64(*texts).alias("_hash")] if texts else []), *[F.col(c) for c in key]]


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key.  ``max_by`` combines map-side, so a hot key costs one row per task."""
    row = F.struct(*[c for c in df.columns if c not in key])
    best = df.groupBy(*_grouping(df, key)).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c not in key])
    best = df.groupBy(*_grouping(df, key)).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*")


def newest_values(df: DataFrame, key: Sequence[str], order: Sequence[str],
                  cols: Sequence[str]) -> DataFrame:
    """Per key, the last non-null value of each column with its position, as (at, value) structs.

    The structs combine further with ``max``, so keys can be merged later.
    """
    at = F.struct(*order)
    return df.groupBy(*_grouping(df, key)).agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c)
        for c in cols]).drop("_hash")


def last_non_null_per_key(df: DataFrame, key: str, order: Sequence[str],
                          cols: Sequence[str]) -> DataFrame:
    """Last non-null value of each column on its own."""
    newest = newest_values(df, [key], order, cols)
    return newest.select(key, *[F.col(c)["value"].alias(c) for c in cols])


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key with a stated order; a bare dropDuplicates keeps an arbitrary row."""
    pick = latest_per_key if keep == "last" else first_per_key
    return pick(df, key, order).select(*df.columns)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def value_on_or_before(value: str, date: str, at: Column) -> Column:
    """Aggregate: the value at the last date not after ``at``."""
    return F.max_by(value, F.when(F.col(date) <= at, F.col(date)))


def value_on_or_after(value: str, date: str, at: Column) -> Column:
    """Aggregate: the value at the first date not before ``at``."""
    return F.min_by(value, F.when(F.col(date) >= at, F.col(date)))


def asof_offset(key: str, date: str, value: str, months: int) -> Column:
    """Window column: the key's value ``months`` away from each row's date.

    Negative months look on or before, positive months on or after; month
    arithmetic clamps to month end and there is no staleness limit.
    """
    if months < 0:
        frame, pick = f"UNBOUNDED PRECEDING AND INTERVAL '{-months}' MONTH PRECEDING", "last_value"
    else:
        frame, pick = f"INTERVAL '{months}' MONTH FOLLOWING AND UNBOUNDED FOLLOWING", "first_value"
    return F.expr(f"{pick}({value}) OVER (PARTITION BY {key} ORDER BY {date} RANGE BETWEEN {frame})")


def align_series(a: DataFrame, b: DataFrame, date: str = "d") -> DataFrame:
    """Rows of ``a`` on dates ``b`` also has.  The index side has one row per calendar day, so
    the planner broadcasts it whenever its measured size is under the session threshold."""
    return a.join(b, date)


def membership(df: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides for keys present in both (suffixes _a, _b)."""
    left = a.select(key, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    right = b.select(key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    return left.join(right, key)


def join_coverage(df: DataFrame, ref: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Share of rows of ``df`` whose key occurs in ``ref``, per named key function."""
    out = []
    for name, (left, right) in keys.items():
        ours = df.select(left.alias("_k"))
        theirs = ref.select(right.alias("_k")).where(F.col("_k").isNotNull()).distinct()
        hit = ours.join(theirs.withColumn("_hit", F.lit(1)), "_k", "left")
        out.append(hit.agg(F.count(F.lit(1)).alias("n_rows"), F.count("_hit").alias("n_matched"))
                   .select(F.lit(name).alias("method"), "n_rows", "n_matched",
                           (F.col("n_matched") / F.col("n_rows")).alias("share")))
    return union_all(out)


def priority_lookup(
    df: DataFrame,
    sources: Sequence[tuple[str, DataFrame, Sequence[str]]],
    value: str,
    out: str = "value_real",
    tag: str = "source",
) -> DataFrame:
    """Look ``value`` up in several keyed tables; the first table with a hit wins.

    ``sources`` is (tag, table with unique keys and a ``value`` column, key columns).
    """
    found = df
    hits = []
    for i, (_, table, keys) in enumerate(sources):
        slim = table.select(*keys, F.col(value).alias(f"_v{i}"))
        found = found.join(slim, list(keys), "left")
        hits.append(F.col(f"_v{i}"))
    which = F.when(F.lit(False), F.lit(""))
    for (name, _, _), hit in zip(sources, hits):
        which = which.when(hit.isNotNull(), F.lit(name))
    return found.withColumns({
        out: C.half_even(F.coalesce(*hits), 2), tag: which,
    }).drop(*[f"_v{i}" for i in range(len(sources))])


def attach_expense(funds: DataFrame, disclosures: DataFrame, order: Sequence[str],
                   default: float = 1.0) -> DataFrame:
    """Real expense rate by code, name and category, or name; medians fill the rest, flagged."""
    pos = [f"_{o}" for o in order]
    raw_key = ["scheme_code", "scheme_name", "scheme_category"]
    # Newest rate per raw key first: it combines map-side, and the text keys are then
    # normalised on distinct schemes only.  The three lookups roll up this small result.
    newest = latest_per_key(disclosures.where(F.col("rate").isNotNull()).select(
        *raw_key, "rate", *[F.col(o).alias(p) for o, p in zip(order, pos)]), raw_key, pos)
    rates = newest.select(
        C.normalise_code(F.col("scheme_code")).alias("code_key"),
        C.normalise_name(F.col("scheme_name"), bonus=True).alias("cost_key"),
        F.lower(F.trim("scheme_category")).alias("cat_key"), "rate", *[F.col(p).alias(o) for o, p in zip(order, pos)])
    rates = settle(rates)
    named = rates.where("cost_key <> ''")
    sources = [
        ("code", latest_per_key(rates.where("code_key <> ''"), ["code_key"], order), ["code_key"]),
        ("name_category", latest_per_key(named.where("cat_key <> ''"), ["cost_key", "cat_key"], order),
         ["cost_key", "cat_key"]),
        ("name", latest_per_key(named, ["cost_key"], order), ["cost_key"]),
    ]
    keyed = funds.withColumns({
        "code_key": C.normalise_code(F.col("code")),
        "cost_key": C.normalise_name(F.col("name"), bonus=True),
        "cat_key": F.lower(F.trim(F.coalesce("category", F.lit("nan")))),
    })
    looked = settle(priority_lookup(keyed, sources, "rate", "expense_real", "expense_source").drop(
        "code_key", "cost_key", "cat_key"))
    # Medians per category and overall come from one exact pass each; both are tiny tables.
    real = looked.where("expense_real IS NOT NULL")
    per_cat = exact_quantiles(real.where("category IS NOT NULL"), ["expense_real"], [0.5], ["category"]).select(
        "category", F.col("q")[0].alias("_cat_median"))
    overall = exact_quantiles(real, ["expense_real"], [0.5]).select(
        F.max(F.col("q")[0]).alias("m")).scalar()
    filled = looked.join(per_cat, "category", "left")
    rate = F.coalesce("expense_real", "_cat_median", overall, F.lit(default))
    return filled.withColumns({
        "expense": C.half_even(C.clip(rate, 0.01, 5.0), 2),
        "expense_missing": F.col("expense_real").isNull().cast("int"),
        "expense_source": F.coalesce(
            "expense_source",
            F.when(F.col("_cat_median").isNotNull(), F.lit("imputed_category_median")),
            F.lit("imputed_global_median")),
    }).drop("_cat_median")
