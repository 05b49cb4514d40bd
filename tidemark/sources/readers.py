"""File readers for the wealth tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C

PRICE_SCHEMA = T.StructType([
    T.StructField("Scheme_Code", T.LongType()),
    T.StructField("Date", T.DateType()),
    T.StructField("NAV", T.DoubleType()),
])


def find_column(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """First column whose name matches the earliest pattern; names only, no data is read."""
    for pattern in patterns:
        for name in columns:
            if re.search(pattern, name.strip().lower()):
                return name
    return None


def read_dirty_csv(spark: SparkSession, path: str | list[str],
                   schema: T.StructType | None = None) -> DataFrame:
    """Header CSV with every field kept as text and column names trimmed.

    Give ``schema`` (all STRING) to skip the header probe on large inputs.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_price_history(spark: SparkSession, path: str, key: str = "Scheme_Code",
                       date: str = "Date", value: str = "NAV") -> DataFrame:
    """Parquet price rows as (key, d, v), without rows that lack a date or a price."""
    df = spark.read.parquet(path)
    return (df.select(F.col(key).alias("key"), F.col(date).cast("date").alias("d"),
                      C.null_if_nan(F.col(value).cast("double")).alias("v"))
            .dropna(subset=["d", "v"]))


def daily_close(prices: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Collapse to one price per (key, day), the last one in ``order``.

    After this step a key has at most one row per calendar day, which bounds
    every per-key window in the series operators no matter how skewed the feed is.
    """
    pos = F.struct(*[F.col(o) for o in order], F.col("v"))
    return prices.groupBy("key", "d").agg(F.max_by("v", pos).alias("v"))


def read_index_series(spark: SparkSession, paths: list[str], date_format: str = "d MMM yyyy",
                      date_patterns: Sequence[str] = (r"^date$",),
                      value_patterns: Sequence[str] = (r"total returns index", r"tri", r"close",
                                                       r"index value")) -> DataFrame:
    """Union index CSVs to one (d, v, ret) row per date; on overlap the first file name wins."""
    parts = None
    for path in sorted(paths):
        df = read_dirty_csv(spark, path)
        date, value = find_column(df.columns, date_patterns), find_column(df.columns, value_patterns)
        if date is None or value is None:
            continue
        part = df.select(C.parse_date(F.col(date), date_format).alias("d"),
                         F.col(value).try_cast("double").alias("v"),
                         F.lit(path).alias("file"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "d date, v double, ret double")
    kept = parts.dropna(subset=["d", "v"]).groupBy("d").agg(
        F.min_by("v", F.struct("file", "v")).alias("v"))
    return index_returns(kept)


def index_returns(index: DataFrame) -> DataFrame:
    """Add the previous-row simple return to a market index (d, v)."""
    # One row per calendar day: the window sees a few thousand rows at most.
    w = Window.partitionBy(F.lit(1)).orderBy("d")
    return index.select("d", "v", (F.col("v") / F.lag("v").over(w) - 1).alias("ret"))


PERFORMANCE_COLUMNS = {
    "Scheme Name": "scheme_name", "Benchmark": "benchmark", "Riskometer Scheme": "riskometer",
    "Riskometer Benchmark": "riskometer_benchmark", "NAV Date": "nav_date",
    "Daily AUM (Cr.)": "daily_aum",
    "Return 1 Year (%) Regular": "fund_return_1y", "Return 3 Year (%) Regular": "fund_return_3y",
    "Return 5 Year (%) Regular": "fund_return_5y",
    "Return 1 Year (%) Benchmark": "benchmark_return_1y",
    "Return 3 Year (%) Benchmark": "benchmark_return_3y",
    "Return 5 Year (%) Benchmark": "benchmark_return_5y",
}
NUMERIC_PERFORMANCE = ["daily_aum", "fund_return_1y", "fund_return_3y", "fund_return_5y",
                       "benchmark_return_1y", "benchmark_return_3y", "benchmark_return_5y"]


def read_performance_snapshots(export: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Normalise a performance export (all text) to the standard snapshot schema."""
    named = {ours: F.col(f"`{theirs}`") for theirs, ours in PERFORMANCE_COLUMNS.items()
             if theirs in export.columns}
    cols = []
    for ours in PERFORMANCE_COLUMNS.values():
        c = named.get(ours, F.lit(None).cast("string"))
        if ours == "nav_date":
            c = C.parse_date(c, date_format)
        elif ours in NUMERIC_PERFORMANCE:
            c = c.try_cast("double")
        cols.append(c.alias(ours))
    return export.select(*cols).dropna(subset=["scheme_name"])


def read_expense_disclosures(export: DataFrame, date_format: str = "dd-MM-yyyy") -> DataFrame:
    """Expense export (all text) to (scheme_code, scheme_name, scheme_category, rate_date, rate)."""
    return export.select(
        F.col("`NSDL Scheme Code`").alias("scheme_code"),
        F.col("`Scheme Name`").alias("scheme_name"),
        F.col("`Scheme Category`").alias("scheme_category"),
        C.parse_date(F.col("`TER Date`"), date_format).alias("rate_date"),
        F.col("`Regular Plan - Total TER (%)`").try_cast("double").alias("rate"),
    )


def dataset_stats(df: DataFrame, key: str, date: str) -> DataFrame:
    """Rows, date span and distinct keys in one pass; count/min/max come from parquet footers
    when aggregate push-down is on."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"),
                  F.max(date).alias("last_date"), F.count_distinct(key).alias("n_keys"))
