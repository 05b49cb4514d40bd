"""Price-series, index and peer-band queries, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import bands as B
from tidemark.operators import series as W
from tidemark.plans import adapters as A
from tidemark.plans.q_joins import CEILING_SQL, FLOOR_SQL
from tidemark.plans.registry import common, query


def rounded(df, cols, n=6):
    return df.select("key", *[F.round(c, n).alias(c) for c in cols])


common("idxf", """
SELECT d, CASE WHEN lag(d, 252) OVER (ORDER BY d) >= ref - INTERVAL 60 MONTH THEN v / lag(v, 252) OVER (ORDER BY d) - 1 END AS i252,
 CASE WHEN lag(d) OVER (ORDER BY d) >= ref - INTERVAL 400 DAY THEN ln(v / lag(v) OVER (ORDER BY d)) END AS ilr
FROM idx, refd WHERE d <= ref""", ["idx", "refd"])
common("m1", """
SELECT s.key, s.d, s.v, ref, i252, ilr,
 CASE WHEN lag(s.d) OVER w >= ref - INTERVAL 400 DAY THEN ln(s.v / lag(s.v) OVER w) END AS lr,
 CASE WHEN lag(s.d, 252) OVER w >= ref - INTERVAL 60 MONTH THEN s.v / lag(s.v, 252) OVER w - 1 END AS r252,
 max(CASE WHEN s.d >= ref - INTERVAL 36 MONTH THEN s.v END) OVER (PARTITION BY s.key ORDER BY s.d ROWS UNBOUNDED PRECEDING) AS peak
FROM series s CROSS JOIN refd LEFT JOIN idxf ON s.d = idxf.d WHERE s.d <= ref
WINDOW w AS (PARTITION BY s.key ORDER BY s.d)""", ["series", "refd", "idxf"])
common("m2", """
SELECT *, CASE WHEN dd IS NULL THEN NULL WHEN dd < -0.05 THEN 1 WHEN v >= peak * 0.98 THEN 0 END AS ev
FROM (SELECT *, CASE WHEN d >= ref - INTERVAL 36 MONTH THEN (v - peak) / peak END AS dd FROM m1)""", ["m1"])
common("m3", """
SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY key ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM m2""", ["m2"])
common("m4", """
SELECT *, CASE WHEN ev = 0 AND st = 1 THEN date_diff('day', last_value(CASE WHEN ev = 1 AND st = 0 THEN d END IGNORE NULLS)
 OVER (PARTITION BY key ORDER BY d ROWS UNBOUNDED PRECEDING), d) END AS rec FROM m3""", ["m3"])
common("m5", """
SELECT key, any_value(ref) AS ref, arg_max(v, d) AS vr,
 arg_max(v, d) FILTER (d <= ref - INTERVAL 12 MONTH) AS v1, arg_max(v, d) FILTER (d <= ref - INTERVAL 36 MONTH) AS v3,
 arg_max(v, d) FILTER (d <= ref - INTERVAL 60 MONTH) AS v5, arg_max(v, d) FILTER (d <= ref - INTERVAL 6 MONTH) AS v6,
 count(*) FILTER (d >= ref - INTERVAL 400 DAY) AS ny, count(*) FILTER (d >= ref - INTERVAL 36 MONTH) AS n3,
 count(*) FILTER (d >= ref - INTERVAL 60 MONTH) AS n5,
 stddev_samp(lr) * sqrt(252) AS vol, count(*) FILTER (lr < 0) AS nd, stddev_samp(lr) FILTER (lr < 0) * sqrt(252) AS dn,
 min(dd) AS mdd, median(rec) AS rec, avg(CASE WHEN r252 > i252 THEN 1.0 WHEN r252 <= i252 THEN 0.0 END) AS bi,
 avg(CASE WHEN r252 > 0 THEN 1.0 WHEN r252 <= 0 THEN 0.0 END) AS bz,
 stddev_samp(lr - ilr) * sqrt(252) AS te, count(lr - ilr) AS na, max(d) AS ld, count(*) AS n
FROM m4 GROUP BY key HAVING arg_max(v, d) > 0""", ["m4"])
common("metrics", """
SELECT *, CASE WHEN ny >= 20 THEN greatest(-10, least(10, (cagr_1yr - 0.065) / vol_1yr)) END AS sharpe_1yr,
 CASE WHEN ny >= 20 THEN greatest(-10, least(20, (cagr_1yr - 0.065) / greatest(0.002, CASE WHEN nd > 1 THEN dn ELSE 0 END))) END AS sortino_1yr FROM (
SELECT *, CASE WHEN v1 > 0 THEN vr / v1 - 1 END AS cagr_1yr, CASE WHEN v3 > 0 THEN pow(vr / v3, 1.0 / 3) - 1 END AS cagr_3yr,
 CASE WHEN v5 > 0 THEN pow(vr / v5, 1.0 / 5) - 1 END AS cagr_5yr, CASE WHEN ny >= 20 THEN greatest(vol, 0.002) END AS vol_1yr,
 CASE WHEN n3 >= 2 THEN mdd END AS max_drawdown, CASE WHEN n3 >= 2 THEN rec END AS recovery_time,
 CASE WHEN v6 > 0 THEN vr / v6 - 1 END AS momentum_6m, CASE WHEN n5 >= 260 THEN coalesce(bi, bz) END AS consistency_1y,
 CASE WHEN ny >= 20 AND na >= 20 THEN te END AS tracking_error_1y, CAST(date_diff('day', ld, ref) AS INTEGER) AS nav_recency, n AS record_count
FROM m5)""", ["m5"])
ROUNDED = {c: (f"CAST({c} AS DOUBLE)" if c == "recovery_time" else c) for c in W.METRICS}
INTS = ("nav_recency", "record_count")


def metric_sql(cols):
    return "SELECT key, " + ", ".join(
        c if c in INTS else f"round({ROUNDED[c]}, 6) AS {c}" for c in cols) + " FROM metrics"


def metrics(t, index=True):
    return W.price_metrics(A.series(t), A.reference_date(t), A.index_series(t) if index else None)


def _metric_query(name, cols, index=False):
    @query(name, metric_sql(cols), ["metrics"])
    def _(t):
        m = metrics(t, index)
        return m.select("key", *[F.col(c) if c in INTS else F.round(c, 6).alias(c) for c in cols])


_metric_query("wn_cagr", ["cagr_1yr", "cagr_3yr", "cagr_5yr"])
_metric_query("wn_volatility", ["vol_1yr"])
_metric_query("wn_sharpe_sortino", ["sharpe_1yr", "sortino_1yr"])
_metric_query("wn_max_drawdown", ["max_drawdown"])
_metric_query("wn_recovery_time", ["recovery_time"])
_metric_query("wn_momentum", ["momentum_6m"])
_metric_query("wn_consistency", ["consistency_1y"], index=True)
_metric_query("wn_tracking_error", ["tracking_error_1y"], index=True)
_metric_query("wn_recency_and_count", ["nav_recency", "record_count"])
_metric_query("wn_price_metrics", W.METRICS, index=True)


@query("wn_returns", """
SELECT key, d, round(v / lag(v) OVER w - 1, 6) AS ret, round(ln(v / lag(v) OVER w), 6) AS log_ret FROM series
WINDOW w AS (PARTITION BY key ORDER BY d)""", ["series"])
def _(t):
    return W.returns(A.series(t)).select("key", "d", F.round("ret", 6).alias("ret"), F.round("log_ret", 6).alias("log_ret"))


@query("wn_index_to_100", "SELECT key, d, round(v / first_value(v) OVER (PARTITION BY key ORDER BY d) * 100, 5) AS indexed FROM series", ["series"])
def _(t):
    return W.index_to_100(A.series(t)).withColumn("indexed", F.round("indexed", 5))


@query("ag_index_cagr", """
SELECT round(pow(arg_max(v, d) / arg_min(v, d) FILTER (d >= ref - INTERVAL 36 MONTH), 1.0 / 3) - 1, 6) AS index_cagr_3y,
 round(pow(arg_max(v, d) / arg_min(v, d) FILTER (d >= ref - INTERVAL 60 MONTH), 1.0 / 5) - 1, 6) AS index_cagr_5y FROM idx, refd""", ["idx", "refd"])
def _(t):
    return W.index_cagr(A.index_series(t)).select(*[F.round(f"index_cagr_{n}y", 6).alias(f"index_cagr_{n}y") for n in (3, 5)])


@query("ag_market_regime", """
SELECT round(m, 6) AS median_return, CASE WHEN m > 0.15 THEN 'bull' WHEN m < 0 THEN 'bear' ELSE 'sideways' END AS regime
FROM (SELECT median(v1 / v0 - 1) AS m FROM (SELECT arg_max(v, d) FILTER (d <= ref - INTERVAL 12 MONTH) AS v0, arg_max(v, d) AS v1
 FROM series, refd GROUP BY key))""", ["series", "refd"])
def _(t):
    return W.market_regime(A.series(t), A.reference_date(t)).withColumn("median_return", F.round("median_return", 6))


# --- peer bands -------------------------------------------------------------
# Supplier series act as funds; the five-way key hash gives peer groups of every size.
PEER = ["Debt Scheme - Liquid Fund", "Hybrid Scheme - Balanced Advantage", "Equity Scheme - Small Cap Fund",
        "Other Scheme - Index Funds", "Unclassified"]
_peer = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(PEER)) + " END"
PEERS = ["s_suppkey AS code", f"{_peer} AS category", "s_name AS name"]
common("peers", f"SELECT {', '.join(PEERS)} FROM supplier")


def peers(t):
    return t.supplier.selectExpr(*PEERS)


common("zscores", """
SELECT code, category, CASE WHEN stddev_samp(vol_1yr) OVER g > 1e-9 THEN (vol_1yr - avg(vol_1yr) OVER g) / stddev_samp(vol_1yr) OVER g ELSE 0 END AS zv,
 CASE WHEN stddev_samp(add) OVER g > 1e-9 THEN (add - avg(add) OVER g) / stddev_samp(add) OVER g ELSE 0 END AS zd, count(*) OVER g AS gn
FROM (SELECT code, category, vol_1yr, abs(max_drawdown) AS add FROM peers JOIN metrics ON code = key WHERE vol_1yr IS NOT NULL AND max_drawdown IS NOT NULL)
WINDOW g AS (PARTITION BY category)""", ["peers", "metrics"])
common("bands", f"""
SELECT code, category, risk_score, raw_ord, CAST(coalesce(greatest({FLOOR_SQL}, least({CEILING_SQL}, raw_ord)), raw_ord) AS INTEGER) AS band_ord FROM (
SELECT z.code, z.category, risk_score, CASE WHEN risk_score <= p[1] THEN 0 WHEN risk_score <= p[2] THEN 1 WHEN risk_score <= p[3] THEN 2 WHEN risk_score <= p[4] THEN 3 ELSE 4 END AS raw_ord
FROM (SELECT *, 0.5 * zv + 0.5 * zd AS risk_score FROM zscores WHERE gn >= 5) z
JOIN (SELECT category, quantile_cont(0.5 * zv + 0.5 * zd, [0.2, 0.4, 0.6, 0.8]) AS p FROM zscores WHERE gn >= 5 GROUP BY 1) q ON z.category = q.category)""", ["zscores"])
TIER_LIST = "[" + ", ".join(f"'{x}'" for x in rules.TIERS) + "]"


@query("wn_group_zscore", "SELECT code, round(zv, 6) AS z_vol_1yr, round(zd, 6) AS z_abs_dd FROM zscores", ["zscores"])
def _(t):
    m = metrics(t, False).select(F.col("key").alias("code"), "vol_1yr", F.abs("max_drawdown").alias("abs_dd"))
    j = peers(t).join(m.where("vol_1yr IS NOT NULL AND abs_dd IS NOT NULL"), "code")
    z = B.group_zscore(j, ["vol_1yr", "abs_dd"], ["category"])
    return z.select("code", F.round("z_vol_1yr", 6).alias("z_vol_1yr"), F.round("z_abs_dd", 6).alias("z_abs_dd"))


@query("wn_group_quantile_band", "SELECT code, round(risk_score, 6) AS risk_score, CAST(raw_ord AS INTEGER) AS band_ord FROM bands", ["bands"])
def _(t):
    b = B.group_quantile_band(B.risk_scores(peers(t), metrics(t, False)))
    return b.select("code", F.round("risk_score", 6).alias("risk_score"), "band_ord")


@query("wn_clamp_band", f"SELECT code, band_ord, {TIER_LIST}[band_ord + 1] AS band FROM bands", ["bands"])
def _(t):
    return B.fund_risk_bands(peers(t), metrics(t, False)).select("code", "band_ord", "band")


@query("flagship_top_funds", f"""
SELECT key, name, category, {TIER_LIST}[band_ord + 1] AS band, round(cagr_1yr, 6) AS cagr_1yr, round(vol_1yr, 6) AS vol_1yr,
 round(sharpe_1yr, 6) AS sharpe_1yr, round(max_drawdown, 6) AS max_drawdown, nav_recency
FROM metrics m JOIN peers p ON m.key = p.code LEFT JOIN bands b ON b.code = m.key WHERE sharpe_1yr IS NOT NULL
ORDER BY m.sharpe_1yr DESC, key LIMIT 10""".replace("SELECT key, name, category", "SELECT key, p.name AS name, p.category AS category"), ["metrics", "bands"])
def _(t):
    from tidemark.sources.lineage import settle
    m = settle(metrics(t))
    funds = peers(t)
    best = m.where("sharpe_1yr IS NOT NULL").orderBy(F.col("sharpe_1yr").desc(), "key").limit(10)
    bands = B.fund_risk_bands(funds, m).select("code", "band")
    out = best.join(funds.withColumnRenamed("code", "key"), "key").join(bands.withColumnRenamed("code", "key"), "key", "left")
    nums = ["cagr_1yr", "vol_1yr", "sharpe_1yr", "max_drawdown"]
    return out.orderBy(F.col("sharpe_1yr").desc(), "key").select("key", "name", "category", "band", *[F.round(c, 6).alias(c) for c in nums], "nav_recency")
