"""Views of the benchmark tables in the shape of the wealth tables.

The select lists are plain expressions that mean the same in Spark SQL and in
the checking database, so both sides of a check start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables, common

# --- daily price series and market index -----------------------------------
# Prices are cents, so sums are taken on integers and are exact in any order.
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
SERIES_VALUE = f"sum({CENTS}) / 100.0D / sum(CAST(l_quantity AS BIGINT))"

common("series", f"""
SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS d,
       CAST(CAST(sum({CENTS}) AS DOUBLE) / 100.0 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS DOUBLE) AS v
FROM lineitem GROUP BY 1, 2
""")
common("idx", f"""
SELECT CAST(l_shipdate AS DATE) AS d,
       CAST(CAST(sum({CENTS}) AS DOUBLE) / 100.0 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS DOUBLE) AS v
FROM lineitem GROUP BY 1
""")
common("refd", "SELECT CAST(max(l_shipdate) AS DATE) AS ref FROM lineitem")


def _unit_price() -> Column:
    return (F.sum(F.expr(CENTS)).cast("double") / 100.0
            / F.sum(F.col("l_quantity").cast("bigint")).cast("double"))


def series(t: Tables) -> DataFrame:
    """(key, d, v): one price per supplier and day, so a key never exceeds its calendar days."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("key"),
                              F.col("l_shipdate").cast("date").alias("d")).agg(
        _unit_price().alias("v"))


def index_series(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(
        _unit_price().alias("v"))


def reference_date(t: Tables):
    return t.lineitem.agg(F.max("l_shipdate").cast("date").alias("ref")).first()["ref"]


# --- bank records ----------------------------------------------------------
RECORDS = [
    "'CUS_' || CAST(o_custkey AS STRING) AS Customer_ID",
    "o_orderkey AS record_no",
    "CAST(o_orderdate AS DATE) AS rec_date",
    "CASE WHEN o_orderkey % 23 = 0 THEN '-500' WHEN o_orderkey % 29 = 0 THEN NULL "
    "WHEN o_orderkey % 7 = 0 THEN CAST(18 + o_custkey % 50 AS STRING) || '_' "
    "ELSE CAST(18 + o_custkey % 50 AS STRING) END AS Age",
    "CASE WHEN o_orderkey % 31 = 0 THEN '_______' "
    "ELSE CAST(20000 + (o_custkey * 7919) % 80000 AS STRING) || '.5_' END AS Annual_Income",
    "CASE WHEN o_orderkey % 13 = 0 THEN '' "
    "ELSE CAST(1000 + (o_custkey * 613) % 9000 AS STRING) || '.25' END AS Monthly_Inhand_Salary",
    "CAST(o_orderkey % 25 - 2 AS STRING) AS Num_Bank_Accounts",
    "CAST(o_custkey % 12 + o_orderkey % 3 AS STRING) AS Num_Credit_Card",
    "CASE WHEN o_orderkey % 41 = 0 THEN '5789' ELSE CAST(1 + o_custkey % 34 AS STRING) END AS Interest_Rate",
    "CASE WHEN o_custkey % 9 = 0 THEN '-100' ELSE CAST(o_custkey % 9 AS STRING) || '_' END AS Num_of_Loan",
    "CAST(o_orderkey % 67 - 5 AS STRING) AS Delay_from_due_date",
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 28 AS STRING) || '_' END AS Num_of_Delayed_Payment",
    "CASE WHEN o_orderkey % 19 = 0 THEN '_' ELSE CAST(o_orderkey % 30 AS STRING) || '.75' END AS Changed_Credit_Limit",
    "CASE WHEN o_orderkey % 11 = 0 THEN '1.2.3' ELSE CAST(o_orderkey % 15 AS STRING) END AS Num_Credit_Inquiries",
    "CAST(500 + (o_custkey * 37) % 4500 AS STRING) || '.12_' AS Outstanding_Debt",
    "CAST(20 + o_orderkey % 30 AS STRING) || '.5' AS Credit_Utilization_Ratio",
    "CAST(10 + (o_custkey * 11) % 900 AS STRING) || '.5' AS Total_EMI_per_month",
    "CASE WHEN o_orderkey % 16 = 0 THEN '__10000__' ELSE CAST(o_orderkey % 640 AS STRING) || '.1' END AS Amount_invested_monthly",
    "CAST(100 + o_orderkey % 900 AS STRING) || '.9' AS Monthly_Balance",
    "CASE WHEN o_orderkey % 14 = 0 THEN 'NA' ELSE CAST(o_custkey % 30 AS STRING) || ' Years and ' "
    "|| CAST(o_orderkey % 12 AS STRING) || ' Months' END AS Credit_History_Age",
    "CASE o_orderkey % 5 WHEN 0 THEN ' Good' WHEN 1 THEN 'Standard' WHEN 2 THEN 'BAD ' "
    "WHEN 3 THEN '_' ELSE 'Good' END AS Credit_Mix",
    "CASE o_orderkey % 7 WHEN 0 THEN 'High_spent_Large_value_payments' "
    "WHEN 1 THEN 'High_spent_Medium_value_payments' WHEN 2 THEN 'Low_spent_Medium_value_payments' "
    "WHEN 3 THEN 'Low_spent_Large_value_payments' WHEN 4 THEN 'High_spent_Small_value_payments' "
    "WHEN 5 THEN 'Low_spent_Small_value_payments' ELSE '!@9#%8' END AS Payment_Behaviour",
    "CASE o_custkey % 10 WHEN 0 THEN 'Doctor' WHEN 1 THEN 'Lawyer' WHEN 2 THEN 'Engineer ' "
    "WHEN 3 THEN 'Teacher' WHEN 4 THEN 'Mechanic' WHEN 5 THEN 'Media_Manager' WHEN 6 THEN '_______' "
    "WHEN 7 THEN 'Musician' WHEN 8 THEN 'Developer' ELSE 'Writer' END AS Occupation",
]
common("records", f"SELECT {', '.join(RECORDS)} FROM orders")
RECORD_ORDER = ["rec_date", "record_no"]


def records(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*RECORDS)


def record_chunk() -> Column:
    """Order-preserving slice of a customer's history, so one huge customer still fans out."""
    return F.year("rec_date") * 12 + F.month("rec_date")


# --- customer activity features ---------------------------------------------
def _order_aggs(where: str = "TRUE") -> list[str]:
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return [
        "CAST(count(*) AS DOUBLE) AS f1",
        f"CAST(sum({cents}) AS DOUBLE) / 100.0 AS f2",
        f"CAST(max({cents}) AS DOUBLE) / 100.0 AS f3",
        f"CAST(min({cents}) AS DOUBLE) / 100.0 AS f4",
        "CAST(count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS DOUBLE)"
        " / count(*) AS f5",
    ]


FEATURES = ["f1", "f2", "f3", "f4", "f5"]
common("features", f"SELECT o_custkey AS key, {', '.join(_order_aggs())} FROM orders GROUP BY 1")
CUT_DATE = "1998-06-01"
common("baseline", f"SELECT o_custkey AS key, {', '.join(_order_aggs())} FROM orders "
                   f"WHERE o_orderdate < TIMESTAMP '{CUT_DATE}' GROUP BY 1")
common("current", f"SELECT o_custkey AS key, {', '.join(_order_aggs())} FROM orders "
                  f"WHERE o_orderdate >= TIMESTAMP '{CUT_DATE}' GROUP BY 1")


def _grouped(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("o_custkey").alias("key")).agg(*[F.expr(e) for e in _order_aggs()])


def features(t: Tables) -> DataFrame:
    return _grouped(t.orders)


def baseline(t: Tables) -> DataFrame:
    return _grouped(t.orders.where(F.col("o_orderdate") < F.lit(CUT_DATE).cast("timestamp_ntz")))


def current(t: Tables) -> DataFrame:
    return _grouped(t.orders.where(F.col("o_orderdate") >= F.lit(CUT_DATE).cast("timestamp_ntz")))


# --- fund catalogue ---------------------------------------------------------
CATEGORIES = [
    "Debt Scheme - Liquid Fund", "Debt Scheme - Overnight Fund",
    "Debt Scheme - Ultra Short Duration Fund", "Debt Scheme - Money Market Fund",
    "Debt Scheme - Low Duration Fund", "Debt Scheme - Short Duration Fund",
    "Debt Scheme - Banking and PSU Fund", "Debt Scheme - Corporate Bond Fund",
    "Debt Scheme - Gilt Fund", "Debt Scheme - Dynamic Bond",
    "Hybrid Scheme - Balanced Advantage", "Hybrid Scheme - Aggressive Hybrid Fund",
    "Hybrid Scheme - Arbitrage Fund", "Hybrid Scheme - Equity Savings",
    "Other Scheme - Gold ETF", "Other Scheme - FoF Domestic",
    "Equity Scheme - Large & Mid Cap Fund", "Equity Scheme - Large Cap Fund",
    "Equity Scheme - Flexi Cap Fund", "Equity Scheme - Value Fund",
    "Equity Scheme - Mid Cap Fund", "Equity Scheme - Small Cap Fund",
    "Equity Scheme - ELSS", "Other Scheme - Index Funds", "Other Scheme - Other ETFs",
]
_category = "CASE p_size % 27 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " WHEN 25 THEN 'Unclassified' END"
_fund_name = ("p_brand || ' ' || p_name || ' Fund' || CASE p_partkey % 4 WHEN 0 THEN ' - Regular Plan - Growth' "
              "WHEN 1 THEN ' – Direct Plan' WHEN 2 THEN '  -IDCW Option' ELSE '' END")
CATALOGUE = [
    "p_partkey AS code",
    f"{_fund_name} AS name",
    "p_brand AS amc",
    "CASE WHEN p_partkey % 11 = 0 THEN 'Close Ended' ELSE 'Open Ended' END AS scheme_type",
    f"{_category} AS category",
    "p_name || CASE WHEN p_partkey % 2 = 0 THEN ' GROWTH' ELSE ' IDCW' END AS nav_name",
    "CASE p_partkey % 3 WHEN 0 THEN 500.0D WHEN 1 THEN 1000.0D END AS min_amt",
    "CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_retailprice END AS price",
    "CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE CAST(p_size * 97 + p_partkey % 1013 AS DOUBLE) END AS aum",
    "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE DATE '2001-09-01' + CAST(p_partkey % 60 AS INT) END AS latest_date",
    "CASE WHEN p_partkey % 47 = 0 THEN NULL ELSE DATE '1990-01-01' + CAST(p_partkey % 4000 AS INT) END AS launch_date",
    "CASE WHEN p_partkey % 19 = 0 THEN DATE '2000-01-01' END AS closure_date",
]
common("catalogue", "SELECT " + ", ".join(e.replace(".0D", ".0::DOUBLE") for e in CATALOGUE) + " FROM part")


def catalogue(t: Tables) -> DataFrame:
    return t.part.selectExpr(*CATALOGUE)


# --- performance snapshots and expense disclosures --------------------------
PERF = [
    # Names that no catalogue entry has stand for lookups that miss.
    f"CASE WHEN l_partkey % 3 = 0 THEN 'Unlisted ' || p_name ELSE {_fund_name} END AS scheme_name",
    "CAST(l_shipdate AS DATE) AS nav_date",
    "l_orderkey AS o1", "l_linenumber AS o2", "l_suppkey AS o3", "CAST(l_quantity AS INT) AS o4",
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'Index ' || l_returnflag END AS benchmark",
    "CASE l_partkey % 9 WHEN 0 THEN 'Low' WHEN 1 THEN 'Low to Moderate' WHEN 2 THEN ' Moderate ' "
    "WHEN 3 THEN 'Moderately High' WHEN 4 THEN 'Very High' WHEN 5 THEN 'unrated' END AS riskometer",
    "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_suppkey % 500 AS DOUBLE) END AS daily_aum",
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity * 8 - 60 AS DOUBLE) END AS fund_return_1y",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity - 10 AS DOUBLE) END AS fund_return_3y",
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_quantity / 2 AS DOUBLE) END AS fund_return_5y",
    "CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_suppkey % 30 AS DOUBLE) END AS benchmark_return_1y",
    "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 20 AS DOUBLE) END AS benchmark_return_3y",
    "CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE CAST(l_suppkey % 15 AS DOUBLE) END AS benchmark_return_5y",
]
PERF_ORDER = ["nav_date", "o1", "o2", "o3", "o4"]
common("perf_raw", f"SELECT {', '.join(PERF)} FROM lineitem JOIN part ON l_partkey = p_partkey")


def performance(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*PERF)


_listed = "l_partkey % 5 < 3 AND p_size % 27 <> 7"
DISCLOSURES = [
    f"CASE WHEN l_partkey % 4 = 1 AND {_listed} THEN ' ' || CAST(l_partkey AS STRING) || '-' ELSE 'X' || CAST(l_partkey AS STRING) END AS scheme_code",
    f"CASE WHEN {_listed} THEN {_fund_name} ELSE 'Unlisted ' || p_name END AS scheme_name",
    f"CASE WHEN p_size % 27 = 7 THEN 'Unlisted' ELSE {_category} END AS scheme_category",
    "CAST(l_shipdate AS DATE) AS rate_date",
    "l_orderkey AS o1", "l_linenumber AS o2", "l_suppkey AS o3", "CAST(l_quantity AS INT) AS o4",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE "
    "CAST(CAST(round(l_tax * 100) AS INT) AS DOUBLE) / 4 + CAST(l_partkey % 7 AS DOUBLE) / 10 END AS rate",
]
RATE_ORDER = ["rate_date", "o1", "o2", "o3", "o4"]
common("disclosures", f"SELECT {', '.join(DISCLOSURES)} FROM lineitem JOIN part ON l_partkey = p_partkey")


def disclosures(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr(*DISCLOSURES)


# --- predictions ------------------------------------------------------------
_hit = "(c_custkey * 7919) % 100"
_yhat = (f"CASE WHEN {_hit} < 12 THEN (c_custkey + 1) % 5 WHEN {_hit} < 18 THEN (c_custkey + 3) % 5 "
         "ELSE c_custkey % 5 END")
_w = [f"(1 + (c_custkey * {31 * (i + 3)}) % 17 + CASE WHEN {_yhat} = {i} THEN 23 ELSE 0 END)" for i in range(5)]
_wsum = " + ".join(_w)
PREDICTIONS = [
    "c_custkey AS key",
    "CAST(c_custkey % 5 AS INT) AS y",
    f"CAST({_yhat} AS INT) AS yhat",
    f"CAST(CASE WHEN {_hit} BETWEEN 10 AND 20 THEN (c_custkey + 2) % 5 ELSE c_custkey % 5 END AS INT) AS yhat2",
    "CAST(18 + (c_custkey * 13) % 60 AS INT) AS age",
    *[f"CAST({w} AS DOUBLE) / ({_wsum}) AS p{i}" for i, w in enumerate(_w)],
]
common("predictions", f"SELECT {', '.join(PREDICTIONS)} FROM customer")


def predictions(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*PREDICTIONS)
