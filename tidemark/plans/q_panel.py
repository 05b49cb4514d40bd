"""Panel, label, threshold, rank and cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import bands as B
from tidemark.operators import panel as P
from tidemark.plans import adapters as A
from tidemark.plans.q_series import PEER, TIER_LIST, peers
from tidemark.plans.registry import common, query, shared
from tidemark.sources.lineage import settle


def rnd(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


common("months", "SELECT key, last_day(d) AS d, arg_max(v, d) AS v FROM series GROUP BY 1, 2", ["series"])


@query("wn_month_end_close", "SELECT key, d, v FROM months", ["months"])
def _(t):
    return P.month_end_close(A.series(t))


def _asof(m):
    if m < 0:
        return f"last_value(v) OVER (PARTITION BY key ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {-m} MONTH PRECEDING)"
    return f"first_value(v) OVER (PARTITION BY key ORDER BY d RANGE BETWEEN INTERVAL {m} MONTH FOLLOWING AND UNBOUNDED FOLLOWING)"


common("points", f"""
SELECT key, d AS as_of, vn / v - 1 AS future_return_3y, CASE WHEN v1 > 0 THEN v / v1 - 1 END AS cagr_1yr, CASE WHEN v3 > 0 THEN pow(v / v3, 1.0 / 3) - 1 END AS cagr_3yr,
 CASE WHEN v5 > 0 THEN pow(v / v5, 1.0 / 5) - 1 END AS cagr_5yr, CASE WHEN v6 > 0 THEN v / v6 - 1 END AS momentum_6m FROM (
SELECT key, d, v, count(*) OVER (PARTITION BY key) AS n, count(*) OVER (PARTITION BY key ORDER BY d ROWS UNBOUNDED PRECEDING) AS seen,
 {_asof(-12)} AS v1, {_asof(-36)} AS v3, {_asof(-60)} AS v5, {_asof(-6)} AS v6, {_asof(36)} AS vn FROM months)
WHERE month(d) IN (3, 6, 9, 12) AND n >= 48 AND seen >= 24 AND vn IS NOT NULL AND v > 0""", ["months"])
common("qends", "SELECT DISTINCT d AS as_of FROM months WHERE month(d) IN (3, 6, 9, 12)", ["months"])
common("dd1", """
SELECT key, as_of, d, v, peak, (v - peak) / peak AS dd, CASE WHEN (v - peak) / peak < -0.05 THEN 1 WHEN v >= peak * 0.98 THEN 0 END AS ev FROM (
SELECT key, as_of, d, v, max(v) OVER (PARTITION BY key, as_of ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak
FROM months JOIN qends ON d <= as_of AND d >= CAST(as_of - INTERVAL 36 MONTH AS DATE))""", ["months", "qends"])
common("dd2", "SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY key, as_of ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM dd1", ["dd1"])
common("dd3", """
SELECT *, CASE WHEN ev = 0 AND st = 1 THEN date_diff('day', last_value(CASE WHEN ev = 1 AND st = 0 THEN d END IGNORE NULLS)
 OVER (PARTITION BY key, as_of ORDER BY d ROWS UNBOUNDED PRECEDING), d) END AS rec FROM dd2""", ["dd2"])
common("trail_dd", "SELECT key, as_of, min(dd) AS max_drawdown, median(rec) AS recovery_time FROM dd3 GROUP BY 1, 2 HAVING count(*) >= 2", ["dd3"])
common("dlr", "SELECT key, d, lag(d) OVER w AS pd, ln(v / lag(v) OVER w) AS lr FROM series WINDOW w AS (PARTITION BY key ORDER BY d)", ["series"])
common("ilr", "SELECT d, lag(d) OVER (ORDER BY d) AS ipd, ln(v / lag(v) OVER (ORDER BY d)) AS lr FROM idx", ["idx"])
common("trail_vol", """
SELECT key, as_of, greatest(vol, 0.002) AS vol_1yr, CASE WHEN na >= 20 THEN te END AS tracking_error_1y FROM (
SELECT s.key, as_of, count(*) AS n, stddev_samp(CASE WHEN pd >= as_of - 400 THEN s.lr END) * sqrt(252) AS vol,
 stddev_samp(CASE WHEN pd >= as_of - 400 AND ipd >= as_of - 400 THEN s.lr - i.lr END) * sqrt(252) AS te,
 count(CASE WHEN pd >= as_of - 400 AND ipd >= as_of - 400 THEN s.lr - i.lr END) AS na
FROM dlr s LEFT JOIN ilr i ON s.d = i.d JOIN qends ON s.d <= as_of AND s.d >= as_of - 400 GROUP BY 1, 2) WHERE n >= 20""", ["dlr", "ilr", "qends"])
common("year_returns", "SELECT key, d, lag(d, 252) OVER w AS ld, v / lag(v, 252) OVER w - 1 AS r FROM series WHERE v IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY d)", ["series"])
common("index_year", "SELECT d, lag(d, 252) OVER (ORDER BY d) AS ld, v / lag(v, 252) OVER (ORDER BY d) - 1 AS r FROM idx", ["idx"])
common("trail_con", """
SELECT s.key, as_of, avg((s.r > i.r)::INT) FILTER (WHERE s.ld >= start AND i.ld >= start AND s.r IS NOT NULL AND i.r IS NOT NULL) AS beat_index,
 avg((s.r > 0)::INT) FILTER (WHERE s.ld >= start AND s.r IS NOT NULL) AS beat_zero
FROM year_returns s LEFT JOIN index_year i ON s.d = i.d JOIN (SELECT as_of, CAST(as_of - INTERVAL 60 MONTH AS DATE) AS start FROM qends) ON s.d <= as_of AND s.d >= start
GROUP BY 1, 2 HAVING count(*) >= 260""", ["year_returns", "index_year", "qends"])
common("idxfut", """
SELECT as_of, CASE WHEN n0 > 0 THEN n3 / n0 - 1 END AS index_future FROM (
SELECT as_of, arg_max(v, d) FILTER (d <= as_of) AS n0, arg_min(v, d) FILTER (d >= CAST(as_of + INTERVAL 36 MONTH AS DATE)) AS n3 FROM qends, idx GROUP BY 1)""", ["qends", "idx"])
_tier = "CASE s_suppkey % 5 WHEN 0 THEN 'Very_Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Very_High' WHEN 3 THEN 'High' ELSE 'Low' END"
_peer = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(PEER)) + " END"
PANEL_FUNDS = ["s_suppkey AS key", f"{_tier} AS risk_tier", f"{_peer} AS category", "CASE WHEN s_suppkey % 5 IN (2, 3) THEN 1 ELSE 0 END AS benchmarked"]
common("panel", f"""
SELECT p.key, p.as_of, risk_tier, category, benchmarked, future_return_3y, future_return_3y - index_future AS future_excess_3y, cagr_1yr, cagr_3yr, cagr_5yr, momentum_6m,
 max_drawdown, CAST(recovery_time AS DOUBLE) AS recovery_time, vol_1yr, tracking_error_1y,
 coalesce(CASE WHEN benchmarked > 0 THEN beat_index END, beat_zero) AS consistency_1y, greatest(-10, least(10, (cagr_1yr - 0.065) / vol_1yr)) AS sharpe_1yr
FROM points p LEFT JOIN trail_dd a ON p.key = a.key AND p.as_of = a.as_of LEFT JOIN trail_vol b ON p.key = b.key AND p.as_of = b.as_of
LEFT JOIN trail_con c ON p.key = c.key AND p.as_of = c.as_of LEFT JOIN idxfut i ON p.as_of = i.as_of JOIN (SELECT {', '.join(PANEL_FUNDS)} FROM supplier) f ON f.key = p.key""", ["points", "trail_dd", "trail_vol", "trail_con", "idxfut"])
PANEL_NUMS = ["future_return_3y", "future_excess_3y", "cagr_1yr", "cagr_3yr", "cagr_5yr", "momentum_6m", "max_drawdown", "recovery_time", "vol_1yr", "tracking_error_1y", "consistency_1y"]


def panel(t):
    return P.forward_panel(A.series(t), A.index_series(t), t.supplier.selectExpr(*PANEL_FUNDS))


def stored_panel(t):
    return shared(t, "panel", lambda: settle(panel(t)))


@query("wn_forward_panel", "SELECT key, as_of, risk_tier, category, benchmarked, " + ", ".join(f"round({c}, 6) AS {c}" for c in PANEL_NUMS)
       + ", CASE WHEN vol_1yr IS NOT NULL AND cagr_1yr IS NOT NULL THEN round(sharpe_1yr, 6) END AS sharpe_1yr FROM panel", ["panel"])
def _(t):
    return rnd(panel(t), [*PANEL_NUMS, "sharpe_1yr"])


common("labelled", """
SELECT *, CASE WHEN metric >= CASE WHEN count(*) OVER g > 2 THEN quantile_cont(metric, 0.8) OVER g ELSE max(metric) OVER g END THEN 1 ELSE 0 END AS label_best
FROM (SELECT *, CASE WHEN benchmarked > 0 AND future_excess_3y IS NOT NULL THEN future_excess_3y ELSE future_return_3y END AS metric FROM panel)
WINDOW g AS (PARTITION BY as_of, risk_tier, category)""", ["panel"])


@query("wn_label_top_quantile", "SELECT key, as_of, label_best FROM labelled", ["labelled"])
def _(t):
    return P.label_top_quantile(stored_panel(t)).select("key", "as_of", "label_best")


@query("ev_calibration_of_target", """
SELECT count(*) AS panel_rows, CAST(sum(label_best) AS BIGINT) AS panel_positive, count(DISTINCT key) AS panel_funds, round(avg(label_best), 6) AS positive_rate FROM labelled""", ["labelled"])
def _(t):
    return rnd(P.positive_rate(P.label_top_quantile(stored_panel(t))), ["positive_rate"])


# --- quantile labels and thresholds -----------------------------------------
common("qlabels", f"""
SELECT key, f2, CAST(o AS INTEGER) AS tier_ord, {TIER_LIST}[o + 1] AS risk_label FROM (
SELECT key, f2, CASE WHEN f2 <= q[1] THEN 0 WHEN f2 <= q[2] THEN 1 WHEN f2 <= q[3] THEN 2 WHEN f2 <= q[4] THEN 3 ELSE 4 END AS o
FROM features, (SELECT quantile_cont(f2, [0.125, 0.375, 0.625, 0.875]) AS q FROM features))""", ["features"])


@query("wn_quantile_bins", "SELECT key, tier_ord, risk_label FROM qlabels", ["qlabels"])
def _(t):
    return B.label_by_quantiles(A.features(t), "f2").select("key", "tier_ord", "risk_label")


@query("wn_bin_thresholds", """
SELECT min(f2) FILTER (tier_ord = 1) AS t1, min(f2) FILTER (tier_ord = 2) AS t2, min(f2) FILTER (tier_ord = 3) AS t3, min(f2) FILTER (tier_ord = 4) AS t4 FROM qlabels""", ["qlabels"])
def _(t):
    labelled = B.label_by_quantiles(A.features(t), "f2").withColumnRenamed("f2", "risk_score")
    th = B.bin_thresholds(labelled)
    return th.select(*[F.col("thresholds")[i].alias(f"t{i + 1}") for i in range(4)])


@query("wn_label_from_thresholds", f"""
SELECT c.key, {TIER_LIST}[1 + (c.f2 >= t1)::INT + (c.f2 >= t2)::INT + (c.f2 >= t3)::INT + (c.f2 >= t4)::INT] AS risk_label
FROM current c, (SELECT min(f2) FILTER (tier_ord = 1) AS t1, min(f2) FILTER (tier_ord = 2) AS t2, min(f2) FILTER (tier_ord = 3) AS t3, min(f2) FILTER (tier_ord = 4) AS t4 FROM qlabels)""", ["qlabels", "current"])
def _(t):
    labelled = B.label_by_quantiles(A.features(t), "f2").withColumnRenamed("f2", "risk_score")
    th = B.bin_thresholds(labelled).scalar()
    return A.current(t).select("key", B.label_from_thresholds(F.col("f2"), th).alias("risk_label"))


@query("wn_rank_features", """
SELECT feature, round(w, 6) AS w, rank() OVER (ORDER BY w DESC) + (count(*) OVER (PARTITION BY w) - 1) / 2.0::DOUBLE AS rank FROM
(SELECT p_brand AS feature, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1)""")
def _(t):
    w = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").cast("double").alias("w"))
    return B.rank_values(w, "w")


@query("wn_cohort_waves", """
SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY md5(c_custkey::VARCHAR || '|waves'), c_custkey) AS INTEGER) AS wave FROM customer""")
def _(t):
    return B.cohort_waves(t.customer, "c_custkey", 4)
