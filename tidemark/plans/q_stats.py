"""Aggregate-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import catalogue as G
from tidemark.operators import cleaning as K
from tidemark.operators import stats as S
from tidemark.plans import adapters as A
from tidemark.plans.q_cleaning import KEY, NO
from tidemark.plans.q_joins import TIER_SQL
from tidemark.plans.registry import common, query

FS = A.FEATURES


def rnd(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("ag_group_means", """
SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY 1""")
def _(t):
    out = S.group_means(t.customer.withColumnRenamed("c_mktsegment", "segment"), "segment", ["c_acctbal"])
    return out.select("segment", F.round("c_acctbal", 4).alias("balance"))


common("tiered", f"SELECT code, category, amc, price, aum, {TIER_SQL} AS tier FROM catalogue", ["catalogue"])


def tiered(t):
    return A.catalogue(t).withColumn("tier", G.keyword_tier(F.col("category")))


@query("ag_group_medians", "SELECT tier, round(median(aum), 4) AS aum, round(median(price), 4) AS price FROM tiered GROUP BY 1", ["tiered"])
def _(t):
    return rnd(S.group_medians(tiered(t), "tier", ["aum", "price"]), ["aum", "price"], 4)


@query("ag_value_counts", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def _(t):
    return rnd(S.value_counts(t.events, "event_type"), ["share"])


@query("ag_distinct_counts", """
SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS n_distinct FROM lineitem UNION ALL
SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem""")
def _(t):
    return S.distinct_counts(t.lineitem, ["l_returnflag", "l_suppkey", "l_quantity"])


@query("ag_describe_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS lowest, max({c}) AS highest, "
    f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75 FROM features" for c in FS), ["features"])
def _(t):
    return rnd(S.describe_columns(A.features(t), FS), ["mean", "std", "q25", "q50", "q75"], 4)


@query("ag_missing_rates", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS pct_missing FROM catalogue"
    for c in ["category", "price", "aum", "min_amt", "closure_date"]), ["catalogue"])
def _(t):
    return rnd(S.missing_rates(A.catalogue(t), ["category", "price", "aum", "min_amt", "closure_date"]), ["pct_missing"])


@query("ag_range_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} < {lo}) AS below, count(*) FILTER ({c} > {hi}) AS above, count(*) FILTER ({c} IS NULL) AS missing FROM bank_num"
    for c, (lo, hi) in rules.COLUMN_BOUNDS.items()), ["bank_num"])
def _(t):
    x = K.clean_numeric_columns(A.records(t), list(rules.COLUMN_BOUNDS))
    return S.range_audit(x, rules.COLUMN_BOUNDS)


AUDITED = ["Age", "Num_Bank_Accounts", "Interest_Rate", "Num_of_Delayed_Payment"]


@query("ag_fill_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (a.{c} IS NULL AND b.{c} IS NOT NULL) AS filled_in_key, count(*) FILTER (b.{c} IS NULL) AS left_for_median "
    "FROM bank_typed a JOIN bank_filled b USING (record_no)" for c in AUDITED), ["bank_typed", "bank_filled"])
def _(t):
    x = K.apply_bounds(K.clean_numeric_columns(A.records(t), AUDITED), rules.COLUMN_BOUNDS).select(KEY, *A.RECORD_ORDER, *AUDITED)
    return S.fill_audit(x, K.fill_within_key(x, AUDITED, KEY, A.RECORD_ORDER, A.record_chunk()), AUDITED, NO)


@query("ag_records_per_key", "SELECT n_records, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS n_records FROM orders GROUP BY 1) GROUP BY 1")
def _(t):
    return S.records_per_key(t.orders, "o_custkey")


_pairs = [(a, b) for i, a in enumerate(FS) for b in FS[i + 1:]]
common("corrs", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM features" for a, b in _pairs), ["features"])


@query("ag_correlation_matrix", "SELECT feature_a, feature_b, round(corr, 6) AS corr FROM corrs", ["corrs"])
def _(t):
    return rnd(S.correlation_matrix(A.features(t), FS), ["corr"])


@query("ag_correlated_pairs", "SELECT feature_a, feature_b, round(corr, 6) AS corr FROM corrs WHERE abs(corr) > 0.30", ["corrs"])
def _(t):
    return rnd(S.correlated_pairs(S.correlation_matrix(A.features(t), FS), 0.30), ["corr"])


@query("ag_redundant_features", """
SELECT DISTINCT unnest([feature_a, feature_b]) AS feature FROM corrs WHERE corr > 0.70""", ["corrs"])
def _(t):
    return S.redundant_features(S.correlation_matrix(A.features(t), FS), 0.70)


def _hist_sql(x):
    return f"""
WITH x AS (SELECT {x} AS x FROM orders), q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x),
b AS (SELECT lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin FROM x, q WHERE x BETWEEN lo AND hi)
SELECT bin, round(any_value(lo) + bin * any_value((hi - lo) / 10), 4) AS left_edge, count(*) AS n FROM b GROUP BY bin"""


@query("ag_trimmed_histogram", _hist_sql("o_totalprice"))
def _(t):
    return rnd(S.trimmed_histogram(t.orders, "o_totalprice"), ["left_edge"], 4)


@query("ag_log_histogram", _hist_sql("ln(1 + o_totalprice)"))
def _(t):
    return rnd(S.trimmed_histogram(t.orders, "o_totalprice", log=True), ["left_edge"], 4)


@query("ag_coverage_report", """
SELECT 'real_rate' AS measure, count(*) FILTER (expense_missing = 0) AS n, round(count(*) FILTER (expense_missing = 0) / count(*), 6) AS share FROM expensed
UNION ALL SELECT 'imputed_category', count(*) FILTER (expense_source = 'imputed_category_median'), round(count(*) FILTER (expense_source = 'imputed_category_median') / count(*), 6) FROM expensed
UNION ALL SELECT 'priced', count(price), round(count(price) / count(*), 6) FROM expensed""", ["expensed"])
def _(t):
    from tidemark.operators.joins import attach_expense
    e = attach_expense(A.catalogue(t), A.disclosures(t), A.RATE_ORDER)
    return rnd(S.coverage_report(e, {
        "real_rate": F.col("expense_missing") == 0,
        "imputed_category": F.col("expense_source") == "imputed_category_median",
        "priced": F.col("price").isNotNull()}), ["share"])


@query("ag_low_information_hotspots", """
SELECT category, round(avg(CASE WHEN p_partkey % 3 = 0 OR p_size % 27 < 4 THEN 1.0 ELSE 0 END), 6) AS share
FROM catalogue JOIN part ON code = p_partkey WHERE category IS NOT NULL GROUP BY 1 HAVING avg(CASE WHEN p_partkey % 3 = 0 OR p_size % 27 < 4 THEN 1.0 ELSE 0 END) >= 0.40
ORDER BY avg(CASE WHEN p_partkey % 3 = 0 OR p_size % 27 < 4 THEN 1.0 ELSE 0 END) DESC, category LIMIT 20""", ["catalogue"])
def _(t):
    c = t.part.selectExpr(*A.CATALOGUE, "CASE WHEN p_partkey % 3 = 0 OR p_size % 27 < 4 THEN 0 ELSE 1 END AS mode").where("category IS NOT NULL")
    return rnd(S.low_information_hotspots(c, "category", "mode"), ["share"])


common("ords", "SELECT category, CASE tier " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(rules.TIERS)) + " END AS ord FROM tiered", ["tiered"])


@query("ag_clamp_impact", " UNION ALL ".join(
    f"SELECT '{w}' AS keyword, count(*) AS n, count(*) FILTER (ord = {lo}) AS at_floor, count(*) FILTER (ord = {hi}) AS at_ceiling FROM ords WHERE contains(lower(category), '{w}') HAVING count(*) > 0"
    for w, lo, hi in rules.CATEGORY_BOUNDS), ["ords"])
def _(t):
    c = tiered(t).withColumn("ord", F.create_map(*[F.lit(x) for n, i in rules.TIER_ORD.items() for x in (n, i)])[F.col("tier")])
    return S.clamp_impact(c, "category", "ord", rules.CATEGORY_BOUNDS)


@query("ag_shannon_entropy", """
SELECT o_orderstatus AS g, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(5), 6) AS entropy_norm
FROM (SELECT o_orderstatus, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY 1""")
def _(t):
    return rnd(S.shannon_entropy(t.orders.withColumnRenamed("o_orderstatus", "g"), ["g"], "o_orderpriority", 5), ["entropy", "entropy_norm"])


@query("ag_balanced_class_weights", """
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight, round(1 / n / sum(1 / n) OVER (), 6) AS inverse_share
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)""".replace("SELECT label, n, round(sum(n) OVER ()", "SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE)"))
def _(t):
    return rnd(S.balanced_class_weights(t.embeddings, "label"), ["weight", "inverse_share"])


@query("ag_bucket_distribution", """
SELECT b AS bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM features), 6) AS share FROM
(SELECT CASE WHEN f5 < 0.1 THEN '0-10%' WHEN f5 < 0.5 THEN '10-50%' WHEN f5 < 0.9 THEN '50-90%' ELSE '90-100%' END AS b FROM features) GROUP BY 1""", ["features"])
def _(t):
    return rnd(S.bucket_distribution(A.features(t), "f5"), ["share"])


GRID = [i / 10 for i in range(11)]


@query("ag_density_curve", """
SELECT c_mktsegment AS segment, g AS at, round(avg(exp(-0.5 * ((g - x) / 0.1) * ((g - x) / 0.1)) / (0.1 * sqrt(2 * pi()))), 6) AS density
FROM (SELECT c_mktsegment, c_acctbal / 10000 AS x FROM customer), (SELECT unnest([""" + ", ".join(f"{g}::DOUBLE" for g in GRID) + """]) AS g) GROUP BY 1, 2""")
def _(t):
    c = t.customer.select(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") / 10000).alias("x"))
    return rnd(S.density_curve(c, "x", GRID, 0.1, "segment"), ["density"])


@query("ag_five_number_by_group", """
SELECT l_returnflag AS flag, count(*) AS n, min(l_extendedprice) AS lowest, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
 round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS highest FROM lineitem GROUP BY 1""")
def _(t):
    li = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rnd(S.five_number_by_group(li, "l_extendedprice", "flag"), ["q25", "q50", "q75"], 4)


# --- fund feature expressions -----------------------------------------------
@query("fe_label_encode", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer""")
def _(t):
    from tidemark.operators.bands import label_encode
    return label_encode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "encoded", fallback="MACHINERY").select(
        "c_custkey", F.col("encoded").alias("code"))
