"""Sources, sinks, cleaning and customer-feature queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import cleaning as K
from tidemark.operators.quantiles import fitted_quantiles
from tidemark.plans import adapters as A
from tidemark.plans.registry import common, query
from tidemark.sources import readers as R
from tidemark.sources import sinks as S
from tidemark.sources.lineage import shared_folder

KEY, NO = "Customer_ID", "record_no"


def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/tidemark/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------

@query("src_read_dirty_csv", "SELECT Customer_ID, record_no::VARCHAR AS record_no, Age, Annual_Income, "
       "nullif(Monthly_Inhand_Salary, '') AS Monthly_Inhand_Salary FROM records", ["records"])
def _(t):
    cols = [KEY, NO, "Age", "Annual_Income", "Monthly_Inhand_Salary"]
    path = scratch(t, "dirty")
    raw = A.records(t).select(*[F.col(c).alias(f" {c} ") for c in cols])
    S.write_table(raw, path, "csv")
    return R.read_dirty_csv(t.spark, path)


@query("src_read_price_history", "SELECT key, d, v FROM series WHERE key % 7 <> 3", ["series"])
def _(t):
    path = scratch(t, "prices")
    prices = A.series(t).select(
        F.col("key").alias("Scheme_Code"), F.col("d").alias("Date"),
        F.when(F.col("key") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("v")).alias("NAV"))
    S.write_table(prices, path)
    return R.read_price_history(t.spark, path)


@query("src_daily_close", """
SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS d,
  arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_extendedprice)) AS v
FROM lineitem GROUP BY 1, 2""")
def _(t):
    raw = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("date").alias("d"),
                            F.col("l_extendedprice").alias("v"), "l_orderkey", "l_linenumber")
    return R.daily_close(raw, ["l_orderkey", "l_linenumber"])


@query("src_read_index_series", """
SELECT d, v, v / lag(v) OVER (ORDER BY d) - 1 AS ret
FROM (SELECT d, CASE WHEN year(d) = 1998 THEN v + 1 ELSE v END AS v FROM idx)""", ["idx"])
def _(t):
    idx = A.index_series(t)
    text = idx.select(F.date_format("d", "dd MMM yyyy").alias("Date"), F.year("d").alias("y"), "v")
    paths = []
    # Three overlapping files; 1998 is in the first two and the first one wins.
    for i, (lo, hi, add) in enumerate([(1990, 1997, 0.0), (1998, 1998, 1.0), (1998, 2010, 0.0)]):
        path = scratch(t, f"index{i}")
        part = text.where(F.col("y").between(lo, hi)).select(
            "Date", (F.col("v") + add).alias("Total Returns Index"))
        paths.append(S.write_table(part, f"{path}", "csv"))
    by_name = sorted(paths)
    assert by_name == paths, "file order decides overlaps"
    return R.read_index_series(t.spark, paths)


@query("src_performance_snapshots", """
SELECT scheme_name, benchmark, riskometer, NULL::VARCHAR AS riskometer_benchmark, nav_date, daily_aum,
 fund_return_1y, fund_return_3y, fund_return_5y, benchmark_return_1y, benchmark_return_3y, benchmark_return_5y
FROM perf_raw""", ["perf_raw"])
def _(t):
    perf = A.performance(t)
    back = {ours: theirs for theirs, ours in R.PERFORMANCE_COLUMNS.items()}
    export = perf.select(*[F.col(c).cast("string").alias(back[c]) for c in back if c in perf.columns])
    return R.read_performance_snapshots(export)


@query("src_expense_disclosures",
       "SELECT scheme_code, scheme_name, scheme_category, rate_date, rate FROM disclosures", ["disclosures"])
def _(t):
    export = A.disclosures(t).select(
        F.col("scheme_code").alias("NSDL Scheme Code"), F.col("scheme_name").alias("Scheme Name"),
        F.col("scheme_category").alias("Scheme Category"),
        F.date_format("rate_date", "dd-MM-yyyy").alias("TER Date"),
        F.coalesce(F.col("rate").cast("string"), F.lit("n/a")).alias("Regular Plan - Total TER (%)"))
    return R.read_expense_disclosures(export)


@query("src_dataset_stats", """
SELECT count(*) AS n_rows, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date,
 count(DISTINCT l_suppkey) AS n_keys FROM lineitem""")
def _(t):
    return R.dataset_stats(t.lineitem.withColumn("d", F.col("l_shipdate").cast("date")), "l_suppkey", "d")


@query("snk_write_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = S.write_table(t.nation, scratch(t, "nation"), partition_by=["n_regionkey"])
    return t.spark.read.parquet(path)


@query("snk_write_metrics", "SELECT 'orders' AS metric, o_orderstatus AS key, CAST(count(*) AS DOUBLE) AS value "
       "FROM orders GROUP BY 2")
def _(t):
    report = t.orders.groupBy(F.col("o_orderstatus").alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("orders").alias("metric"), "key", "value")
    return t.spark.read.schema("metric string, key string, value double").json(
        S.write_metrics(report, scratch(t, "metrics")))


@query("snk_materialise", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    path = scratch(t, "cached")

    def build():
        return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))

    S.materialise(t.spark, path, build)
    return S.materialise(t.spark, path, build)


# --- cleaning ---------------------------------------------------------------
def _num(c):
    return f"TRY_CAST(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


NUMERIC_SQL = ", ".join(f"{_num(c)} AS {c}" for c in rules.BANK_NUMERIC)


@query("cln_clean_numeric", f"SELECT record_no, {NUMERIC_SQL} FROM records", ["records"])
def _(t):
    return K.clean_numeric_columns(A.records(t), rules.BANK_NUMERIC).select(NO, *rules.BANK_NUMERIC)


DURATION_SQL = ("nullif(coalesce(TRY_CAST(regexp_extract(Credit_History_Age, '([0-9]+)\\s*[Yy]ear', 1) AS INT), 0) * 12 + "
                "coalesce(TRY_CAST(regexp_extract(Credit_History_Age, '([0-9]+)\\s*[Mm]onth', 1) AS INT), 0), 0)::DOUBLE")


@query("cln_parse_duration", f"SELECT record_no, {DURATION_SQL} AS months FROM records", ["records"])
def _(t):
    return A.records(t).select(NO, C.parse_duration_months(F.col("Credit_History_Age")).alias("months"))


common("bank_num", f"SELECT Customer_ID, record_no, rec_date, Credit_Mix, Payment_Behaviour, Occupation, "
                   f"{DURATION_SQL} AS Credit_History_Months, {NUMERIC_SQL} FROM records", ["records"])


def _bounded(c):
    if c in rules.COLUMN_BOUNDS:
        lo, hi = rules.COLUMN_BOUNDS[c]
        return f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}"
    if c in rules.NON_NEGATIVE:
        return f"CASE WHEN {c} < 0 THEN 0 ELSE {c} END AS {c}"
    return c


common("bank_typed", "SELECT Customer_ID, record_no, rec_date, Credit_Mix, Payment_Behaviour, Occupation, "
       "Credit_History_Months, " + ", ".join(_bounded(c) for c in rules.BANK_NUMERIC) + " FROM bank_num", ["bank_num"])


@query("cln_clamp_floor", "SELECT record_no, Delay_from_due_date FROM bank_typed", ["bank_typed"])
def _(t):
    x = K.clean_numeric_columns(A.records(t), ["Delay_from_due_date"])
    return K.apply_bounds(x, {}, rules.NON_NEGATIVE).select(NO, "Delay_from_due_date")


@query("cln_null_out_of_range", "SELECT record_no, " + ", ".join(rules.COLUMN_BOUNDS) + " FROM bank_typed", ["bank_typed"])
def _(t):
    x = K.clean_numeric_columns(A.records(t), list(rules.COLUMN_BOUNDS))
    return K.apply_bounds(x, rules.COLUMN_BOUNDS).select(NO, *rules.COLUMN_BOUNDS)


def _fill(c):
    w = "(PARTITION BY Customer_ID ORDER BY rec_date, record_no ROWS BETWEEN "
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER {w} UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER {w} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")


common("bank_filled", "SELECT Customer_ID, record_no, rec_date, Credit_Mix, Payment_Behaviour, Occupation, "
       "Credit_History_Months, " + ", ".join(_fill(c) for c in rules.BANK_NUMERIC) + " FROM bank_typed", ["bank_typed"])


@query("cln_fill_within_key", "SELECT record_no, " + ", ".join(rules.BANK_NUMERIC) + " FROM bank_filled", ["bank_filled"])
def _(t):
    x = K.apply_bounds(K.clean_numeric_columns(A.records(t), rules.BANK_NUMERIC),
                       rules.COLUMN_BOUNDS, rules.NON_NEGATIVE)
    return K.fill_within_key(x, rules.BANK_NUMERIC, KEY, A.RECORD_ORDER, A.record_chunk()).select(NO, *rules.BANK_NUMERIC)


@query("cln_fill_global_median", """
SELECT record_no, coalesce(Age, (SELECT median(Age) FROM bank_typed)) AS Age,
 coalesce(Num_of_Delayed_Payment, (SELECT median(Num_of_Delayed_Payment) FROM bank_typed)) AS Num_of_Delayed_Payment
FROM bank_typed""", ["bank_typed"])
def _(t):
    cols = ["Age", "Num_of_Delayed_Payment"]
    x = K.apply_bounds(K.clean_numeric_columns(A.records(t), cols), rules.COLUMN_BOUNDS)
    return K.fill_global_median(x, cols).select(NO, *cols)


@query("cln_winsorize", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 4) AS o_totalprice FROM orders, q""")
def _(t):
    return K.winsorize(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumn(
        "o_totalprice", F.round("o_totalprice", 4))


def _case(col, mapping, default):
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE lower(trim({col})) {whens} ELSE {default} END::DOUBLE"


ENCODED_SQL = (
    f"{_case('Credit_Mix', rules.CREDIT_MIX_SCORE, rules.CREDIT_MIX_DEFAULT)} AS Credit_Mix_Score, "
    f"{_case('Payment_Behaviour', rules.PAYMENT_SCORE, rules.PAYMENT_DEFAULT)} AS Spending_Behaviour_Score, "
    f"{_case('Occupation', rules.OCCUPATION_SCORE, rules.OCCUPATION_DEFAULT)} AS Occupation_Stability_Score")


@query("cln_map_categorical", f"SELECT record_no, {ENCODED_SQL} FROM records", ["records"])
def _(t):
    return K.encode_categories(A.records(t)).select(
        NO, "Credit_Mix_Score", "Spending_Behaviour_Score", "Occupation_Stability_Score")


@query("cln_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return K.drop_columns_if_present(t.customer, ["c_name", "c_acctbal", "SSN"])


@query("cln_last_k_per_key", """
SELECT Customer_ID, record_no, rec_date FROM records
QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY rec_date DESC, record_no DESC) <= 4""", ["records"])
def _(t):
    return K.last_k_per_key(A.records(t).select(KEY, NO, "rec_date"), KEY, A.RECORD_ORDER, 4)


def name_sql(col, words="regular|direct|growth|dividend|idcw|option|plan"):
    x = f"regexp_replace(lower(trim(coalesce({col}, ''))), '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s*[-–]\\s*({words}).*$', '')"
    return f"trim(regexp_replace({x}, '[^a-z0-9 ]', '', 'g'))"


BONUS_WORDS = "regular|direct|growth|dividend|idcw|bonus|option|plan"


@query("cln_normalise_name", f"SELECT code, {name_sql('name')} AS name_key, {name_sql('name', BONUS_WORDS)} AS cost_key FROM catalogue", ["catalogue"])
def _(t):
    return A.catalogue(t).select("code", C.normalise_name(F.col("name")).alias("name_key"),
                                 C.normalise_name(F.col("name"), bonus=True).alias("cost_key"))


def code_sql(col):
    return f"regexp_replace(lower(coalesce({col}::VARCHAR, '')), '[^a-z0-9]', '', 'g')"


@query("cln_normalise_code", f"SELECT DISTINCT scheme_code, {code_sql('scheme_code')} AS code_key FROM disclosures", ["disclosures"])
def _(t):
    return A.disclosures(t).select("scheme_code").distinct().select(
        "scheme_code", C.normalise_code(F.col("scheme_code")).alias("code_key"))


@query("cln_clip_returns", """
SELECT o1, o2, o3, o4, nav_date, CASE WHEN fund_return_1y > 300 THEN 300 WHEN fund_return_1y < -95 THEN -95 ELSE fund_return_1y END AS fund_return_1y,
 CASE WHEN fund_return_3y > 300 THEN 300 WHEN fund_return_3y < -95 THEN -95 ELSE fund_return_3y END AS fund_return_3y FROM perf_raw""", ["perf_raw"])
def _(t):
    cols = ["fund_return_1y", "fund_return_3y"]
    return K.clip_columns(A.performance(t), cols, -95, 300).select("o1", "o2", "o3", "o4", "nav_date", *cols)


@query("cln_extract_amount", """
SELECT p_partkey, TRY_CAST(regexp_extract(replace(s, ',', ''), '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS amount
FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'any amount' ELSE 'Rs. ' || CAST(p_partkey % 9 + 1 AS STRING) || ',' || '000.50/- min ' || p_name END AS s FROM part)""")
def _(t):
    text = F.expr("CASE WHEN p_partkey % 10 = 0 THEN 'any amount' ELSE 'Rs. ' || CAST(p_partkey % 9 + 1 AS STRING) || ',' || '000.50/- min ' || p_name END")
    return t.part.select("p_partkey", C.extract_amount(text).alias("amount"))


@query("cln_filter_valid_price", """
SELECT code, price, aum FROM catalogue WHERE price IS NOT NULL AND aum >= 1000 AND lower(scheme_type) LIKE '%open%'""", ["catalogue"])
def _(t):
    return K.filter_funds(A.catalogue(t), min_aum=1000, type_contains="Open").select("code", "price", "aum")


@query("cln_filter_ranges", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05""")
def _(t):
    return K.filter_ranges(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"),
                           {"l_quantity": (10, 20), "l_discount": (0.02, 0.05)})


@query("cln_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("31-02-1999")).otherwise(
        F.date_format("o_orderdate", "dd-MM-yyyy"))
    return t.orders.select("o_orderkey", C.parse_date(text).alias("d"))


# --- customer features ------------------------------------------------------
common("bank_medians", "SELECT " + ", ".join(
    f"median({c}) AS {c}" for c in [*rules.BANK_NUMERIC, "Credit_History_Months"]) + " FROM bank_filled", ["bank_filled"])
common("bank_whole", "SELECT Customer_ID, record_no, rec_date, " + ENCODED_SQL + ", " + ", ".join(
    f"coalesce(b.{c}, m.{c}) AS {c}" for c in [*rules.BANK_NUMERIC, "Credit_History_Months"])
       + " FROM bank_filled b, bank_medians m", ["bank_medians"])
common("bank_limits", "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in rules.WINSORISED)
       + " FROM bank_whole", ["bank_whole"])
_other = [c for c in [*rules.BANK_NUMERIC, "Credit_History_Months", "Credit_Mix_Score", "Spending_Behaviour_Score",
                      "Occupation_Stability_Score"] if c not in rules.WINSORISED]
common("bank_clean", "SELECT Customer_ID, record_no, rec_date, " + ", ".join(_other) + ", " + ", ".join(
    f"greatest(least({c}, {c}_hi), {c}_lo) AS {c}" for c in rules.WINSORISED) + " FROM bank_whole, bank_limits", ["bank_limits"])
common("bank_agg", "SELECT Customer_ID, CAST(round_even(arg_min(Age, row(rec_date, record_no)) FILTER (Age IS NOT NULL), 0) AS INTEGER) AS Age, "
       + ", ".join(f"avg({c}) AS {c}" for c in K.MEAN_COLUMNS) + " FROM bank_clean GROUP BY 1", ["bank_clean"])
common("bank_raw", """
SELECT *, greatest(0, least(5, Amount_invested_monthly / (Monthly_Inhand_Salary + 1e-6))) AS Investment_Ratio,
 greatest(0, least(5, Outstanding_Debt / (Annual_Income + 1e-6))) AS Debt_Burden_Ratio,
 coalesce(Delay_from_due_date, 0) + coalesce(Num_of_Delayed_Payment, 0) AS Delay_Score,
 greatest(0, least(1, (70.0 - greatest(18, least(70, coalesce(Age, 35)))) / 52.0)) AS Age_Risk_Proxy,
 greatest(0, least(3, coalesce(Total_EMI_per_month, 0) / (Monthly_Inhand_Salary + 1e-6))) AS EMI_Income_Ratio,
 greatest(-1, least(1, (coalesce(Monthly_Inhand_Salary, 0) - coalesce(Total_EMI_per_month, 0)) / (coalesce(Monthly_Inhand_Salary, 0) + 1e-6))) AS Savings_Rate,
 coalesce(Credit_History_Months, 0) AS Credit_History_Score
FROM bank_agg""", ["bank_agg"])
common("bank_minmax", "SELECT " + ", ".join(
    f"min(coalesce({c}, 0)) AS {c}_mn, max(coalesce({c}, 0)) AS {c}_mx" for c in K.FEATURE_SOURCES) + " FROM bank_raw", ["bank_raw"])
common("bank_features", "SELECT Customer_ID, Age, " + ", ".join(
    f"(coalesce({c}, 0) - {c}_mn) / CASE WHEN {c}_mx > {c}_mn THEN {c}_mx - {c}_mn ELSE 1 END AS {n}"
    for c, n in K.FEATURE_SOURCES.items()) + " FROM bank_raw, bank_minmax", ["bank_minmax"])


@query("agg_per_customer", "SELECT Customer_ID, Age, " + ", ".join(f"round({c}, 8) AS {c}" for c in K.MEAN_COLUMNS)
       + " FROM bank_agg", ["bank_agg"])
def _(t):
    clean = K.clean_bank_records(A.records(t), A.RECORD_ORDER, A.record_chunk())
    out = K.aggregate_per_customer(clean, A.RECORD_ORDER)
    return out.select(KEY, "Age", *[F.round(c, 8).alias(c) for c in K.MEAN_COLUMNS])


@query("fe_customer_features", "SELECT Customer_ID, Age, " + ", ".join(f"round({c}, 6) AS {c}" for c in rules.RISK_FEATURES)
       + " FROM bank_features", ["bank_features"])
def _(t):
    out = K.customer_features(A.records(t), A.RECORD_ORDER, A.record_chunk())
    return out.select(KEY, "Age", *[F.round(c, 6).alias(c) for c in rules.RISK_FEATURES])


@query("fe_safe_ratio", """
SELECT key, round(greatest(0, least(5, f3 / (f2 + 1e-6))), 6) AS top_share, round(greatest(-1, least(1, (f3 - f4) / (f3 + 1e-6))), 6) AS spread
FROM features""", ["features"])
def _(t):
    f = A.features(t)
    return f.select("key", F.round(C.safe_ratio(F.col("f3"), F.col("f2"), 0, 5), 6).alias("top_share"),
                    F.round(C.safe_ratio(F.col("f3") - F.col("f4"), F.col("f3"), -1, 1), 6).alias("spread"))


@query("fe_delay_and_age", """
SELECT record_no, coalesce(Delay_from_due_date, 0) + coalesce(Num_of_Delayed_Payment, 0) AS delay_score,
 round(greatest(0, least(1, (70.0 - greatest(18, least(70, coalesce(Age, 35)))) / 52.0)), 6) AS age_proxy FROM bank_typed""", ["bank_typed"])
def _(t):
    cols = ["Age", "Delay_from_due_date", "Num_of_Delayed_Payment"]
    x = K.apply_bounds(K.clean_numeric_columns(A.records(t), cols), rules.COLUMN_BOUNDS, rules.NON_NEGATIVE)
    zero = F.lit(0.0)
    return x.select(NO, (F.coalesce("Delay_from_due_date", zero) + F.coalesce("Num_of_Delayed_Payment", zero)).alias("delay_score"),
                    F.round(C.age_proxy(F.col("Age")), 6).alias("age_proxy"))


@query("fe_minmax", "SELECT key, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in A.FEATURES)
       + " FROM features", ["features"])
def _(t):
    f = A.features(t)
    fitted = K.fit_minmax(f, A.FEATURES)
    out = K.apply_minmax(f, fitted, {c: c for c in A.FEATURES})
    return out.select("key", *[F.round(c, 6).alias(c) for c in A.FEATURES])


@query("fe_saved_minmax", """
SELECT c.key, round((coalesce(c.f1, 0) - b.lo) / (b.hi - b.lo), 6) AS f1 FROM current c, (SELECT min(f1) AS lo, max(f1) AS hi FROM baseline) b""",
       ["baseline", "current"])
def _(t):
    path = scratch(t, "minmax")
    S.write_table(K.fit_minmax(A.baseline(t), ["f1"]), path)
    out = K.apply_minmax(A.current(t), t.spark.read.parquet(path), {"f1": "f1"})
    return out.select("key", F.round("f1", 6).alias("f1"))
