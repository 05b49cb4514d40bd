"""Join, as-of, membership, top-k and set-operation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import joins as J
from tidemark.plans import adapters as A
from tidemark.plans.q_cleaning import BONUS_WORDS, code_sql, name_sql
from tidemark.plans.registry import common, query


def r(c, n=6):
    return F.round(c, n)


def case_sql(text: str, pairs) -> str:
    """CASE over ordered (keyword, SQL value) rules."""
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{w}') THEN {v}" for w, v in pairs) + " END"


@query("jn_latest_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(t):
    return J.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"),
                            ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_po = "row(nav_date, o1, o2, o3, o4)"
_perf_cols = ["benchmark", "riskometer", "daily_aum", "fund_return_1y", "fund_return_3y", "fund_return_5y",
              "benchmark_return_1y", "benchmark_return_3y", "benchmark_return_5y"]
common("perf_last", f"SELECT {name_sql('scheme_name')} AS name_key, max(nav_date) AS nav_date, " + ", ".join(
    f"arg_max({c}, {_po}) FILTER ({c} IS NOT NULL) AS {c}" for c in _perf_cols) + " FROM perf_raw GROUP BY 1", ["perf_raw"])


@query("jn_last_non_null_per_key", "SELECT name_key, " + ", ".join(_perf_cols) + " FROM perf_last", ["perf_last"])
def _(t):
    p = A.performance(t).withColumn("name_key", C.normalise_name(F.col("scheme_name")))
    return J.last_non_null_per_key(p, "name_key", A.PERF_ORDER, _perf_cols)


@query("jn_asof_fixed", """
SELECT key, arg_max(v, d) FILTER (d <= DATE '1999-06-30') AS v_before, arg_min(v, d) FILTER (d >= DATE '1999-06-30') AS v_after
FROM series GROUP BY key""", ["series"])
def _(t):
    at = F.lit("1999-06-30").cast("date")
    return A.series(t).groupBy("key").agg(J.value_on_or_before("v", "d", at).alias("v_before"),
                                          J.value_on_or_after("v", "d", at).alias("v_after"))


@query("jn_asof_per_row", """
SELECT key, d, last_value(v) OVER (PARTITION BY key ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 6 MONTH PRECEDING) AS v_6m_ago,
 first_value(v) OVER (PARTITION BY key ORDER BY d RANGE BETWEEN INTERVAL 12 MONTH FOLLOWING AND UNBOUNDED FOLLOWING) AS v_1y_on
FROM series""", ["series"])
def _(t):
    return A.series(t).select("key", "d", J.asof_offset("key", "d", "v", -6).alias("v_6m_ago"),
                              J.asof_offset("key", "d", "v", 12).alias("v_1y_on"))


@query("jn_align_series", "SELECT s.key, s.d, s.v, i.v AS index_v FROM series s JOIN idx i ON s.d = i.d", ["series", "idx"])
def _(t):
    return J.align_series(A.series(t), A.index_series(t).withColumnRenamed("v", "index_v")).select("key", "d", "v", "index_v")


@query("jn_membership", """
SELECT o_orderkey, 'in' AS side FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT o_orderkey, 'out' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = t.orders.select("o_custkey", "o_orderkey")
    return J.union_all([J.membership(o, ids, "o_custkey", True).select("o_orderkey", F.lit("in").alias("side")),
                        J.membership(o, ids, "o_custkey", False).select("o_orderkey", F.lit("out").alias("side"))])


_tier_rules = [(w, f"'{v}'") for w, v in C.group_rules(rules.TIER_KEYWORDS)]
_seg_rules = [(w, f"'{v}'") for w, v in C.group_rules(rules.SEGMENT_KEYWORDS)]
_style_rules = [(w, f"'{v}'") for w, v in C.group_rules(rules.STYLE_KEYWORDS)]
TIER_SQL = case_sql("category", _tier_rules)
SEGMENT_SQL = f"coalesce({case_sql('category', _seg_rules)}, 'Other')"
STYLE_SQL = f"coalesce({case_sql('category', _style_rules)}, 'other')"
FLOOR_SQL = case_sql("category", [(w, lo) for w, lo, _ in rules.CATEGORY_BOUNDS])
CEILING_SQL = case_sql("category", [(w, hi) for w, _, hi in rules.CATEGORY_BOUNDS])
ELIGIBLE_SQL = ("CASE WHEN contains(lower(scheme_type), 'open') AND (" + " OR ".join(
    f"contains(lower(coalesce(category, '')), '{w}')" for w in rules.BENCHMARK_KEYWORDS) + ") THEN 1 ELSE 0 END")


@query("jn_first_keyword_match", f"""
SELECT code, {TIER_SQL} AS tier, CAST({FLOOR_SQL} AS INTEGER) AS floor_ord, CAST({CEILING_SQL} AS INTEGER) AS ceiling_ord,
 {SEGMENT_SQL} AS segment, {STYLE_SQL} AS style, CAST({ELIGIBLE_SQL} AS INTEGER) AS eligible FROM catalogue""", ["catalogue"])
def _(t):
    from tidemark.operators import catalogue as G
    c = A.catalogue(t)
    cat = F.col("category")
    return c.select("code", G.keyword_tier(cat).alias("tier"), G.bound_floor(cat).alias("floor_ord"),
                    G.bound_ceiling(cat).alias("ceiling_ord"), G.asset_segment(cat).alias("segment"),
                    G.style_bucket(cat).alias("style"),
                    G.benchmark_eligible(cat, F.col("scheme_type")).alias("eligible"))


# --- expense lookup ---------------------------------------------------------
_ro = "row(rate_date, o1, o2, o3, o4)"
common("rates", f"SELECT {code_sql('scheme_code')} AS code_key, {name_sql('scheme_name', BONUS_WORDS)} AS cost_key, "
                "lower(trim(scheme_category)) AS cat_key, rate, rate_date, o1, o2, o3, o4 FROM disclosures WHERE rate IS NOT NULL", ["disclosures"])
common("expense_hits", f"""
SELECT c.*, round_even(coalesce(a.rate, b.rate, n.rate), 2) AS expense_real,
 CASE WHEN a.rate IS NOT NULL THEN 'code' WHEN b.rate IS NOT NULL THEN 'name_category' WHEN n.rate IS NOT NULL THEN 'name' END AS hit
FROM (SELECT *, {code_sql('code')} AS code_key, {name_sql('name', BONUS_WORDS)} AS cost_key, lower(trim(category)) AS cat_key FROM catalogue) c
LEFT JOIN (SELECT code_key, arg_max(rate, {_ro}) AS rate FROM rates GROUP BY 1) a ON c.code_key = a.code_key
LEFT JOIN (SELECT cost_key, cat_key, arg_max(rate, {_ro}) AS rate FROM rates GROUP BY 1, 2) b ON c.cost_key = b.cost_key AND c.cat_key = b.cat_key
LEFT JOIN (SELECT cost_key, arg_max(rate, {_ro}) AS rate FROM rates GROUP BY 1) n ON c.cost_key = n.cost_key
""", ["catalogue", "rates"])
common("expensed", """
SELECT h.*, coalesce(hit, CASE WHEN m.cm IS NOT NULL THEN 'imputed_category_median' ELSE 'imputed_global_median' END) AS expense_source,
 round_even(greatest(0.01, least(5.0, coalesce(expense_real, m.cm, (SELECT median(expense_real) FROM expense_hits), 1.0))), 2) AS expense,
 CASE WHEN expense_real IS NULL THEN 1 ELSE 0 END AS expense_missing
FROM expense_hits h LEFT JOIN (SELECT category, median(expense_real) AS cm FROM expense_hits WHERE category IS NOT NULL GROUP BY 1) m ON h.category = m.category
""", ["expense_hits"])


def funds_with_code(t):
    """Catalogue codes carry no prefix while one disclosure layout does: some only match by name."""
    return A.catalogue(t)


@query("jn_priority_lookup", "SELECT code, expense_real, expense, expense_missing, expense_source FROM expensed", ["expensed"])
def _(t):
    out = J.attach_expense(funds_with_code(t), A.disclosures(t), A.RATE_ORDER)
    return out.select("code", "expense_real", "expense", "expense_missing", "expense_source")


@query("jn_coverage", f"""
SELECT 'exact' AS method, count(*) AS n_rows, count(*) FILTER (name IN (SELECT scheme_name FROM disclosures)) AS n_matched,
 round(count(*) FILTER (name IN (SELECT scheme_name FROM disclosures)) / count(*), 6) AS share FROM catalogue
UNION ALL SELECT 'normalised', count(*), count(*) FILTER (k IN (SELECT {name_sql('scheme_name', BONUS_WORDS)} FROM disclosures)),
 round(count(*) FILTER (k IN (SELECT {name_sql('scheme_name', BONUS_WORDS)} FROM disclosures)) / count(*), 6)
FROM (SELECT {name_sql('name', BONUS_WORDS)} AS k FROM catalogue)""", ["catalogue", "disclosures"])
def _(t):
    keys = {"exact": (F.col("name"), F.col("scheme_name")),
            "normalised": (C.normalise_name(F.col("name"), True), C.normalise_name(F.col("scheme_name"), True))}
    return J.join_coverage(A.catalogue(t), A.disclosures(t), keys).withColumn("share", r("share"))


@query("jn_key_intersection", """
SELECT key, round(b.f2 - a.f2, 2) AS change FROM baseline a JOIN current b USING (key)""", ["baseline", "current"])
def _(t):
    j = J.key_intersection(A.baseline(t), A.current(t), "key")
    return j.select("key", F.round(F.col("f2_b") - F.col("f2_a"), 2).alias("change"))


# --- sort, top-k, set operations --------------------------------------------
@query("tk_top_n", """
SELECT key, n, vol FROM (SELECT l_suppkey AS key, count(*) AS n, round(stddev_samp(l_quantity), 6) AS vol FROM lineitem GROUP BY 1)
WHERE n >= 50 AND vol IS NOT NULL ORDER BY vol DESC, key LIMIT 5""")
def _(t):
    from tidemark.operators.ranking import top_n
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), r(F.stddev_samp("l_quantity")).alias("vol"))
    return top_n(m, "vol", 5, tie="key", min_count=("n", 50))


@query("tk_top_n_per_group", f"""
SELECT tier, amc, n, CAST(rnk AS INTEGER) AS rnk FROM (
 SELECT tier, amc, n, row_number() OVER (PARTITION BY tier ORDER BY n DESC, amc) AS rnk
 FROM (SELECT {TIER_SQL} AS tier, amc, count(*) AS n FROM catalogue GROUP BY 1, 2) WHERE tier IS NOT NULL) WHERE rnk <= 5""", ["catalogue"])
def _(t):
    from tidemark.operators import catalogue as G
    from tidemark.operators.ranking import top_n_per_group
    c = A.catalogue(t).select(G.keyword_tier(F.col("category")).alias("tier"), "amc").where("tier IS NOT NULL")
    n = c.groupBy("tier", "amc").agg(F.count(F.lit(1)).alias("n"))
    return top_n_per_group(n, ["tier"], [F.col("n").desc(), F.col("amc")], 5)


@query("tk_cap_per_group", """
WITH a AS (SELECT code, category, amc, aum FROM catalogue WHERE category IS NOT NULL AND aum IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY category ORDER BY aum DESC, code) <= 2)
SELECT code, category, amc FROM a QUALIFY row_number() OVER (PARTITION BY amc ORDER BY aum DESC, code) <= 2""", ["catalogue"])
def _(t):
    from tidemark.operators.ranking import cap_per_group
    c = A.catalogue(t).where("category IS NOT NULL AND aum IS NOT NULL").select("code", "category", "amc", "aum")
    best = [F.col("aum").desc(), F.col("code")]
    return cap_per_group(cap_per_group(c, ["category"], best, 2), ["amc"], best, 2).select("code", "category", "amc")


@query("tk_sort_by", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey""")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey")


@query("so_union_all", """
SELECT key, f1, NULL::DOUBLE AS f2 FROM baseline UNION ALL SELECT key, f1, f2 FROM current""", ["baseline", "current"])
def _(t):
    return J.union_all([A.current(t).select("key", "f1", "f2"), A.baseline(t).select("key", "f1")])


@query("so_dedupe", """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return J.dedupe(t.lineitem.select(*cols), ["l_orderkey"], cols[1:], "last").drop("l_linenumber")
