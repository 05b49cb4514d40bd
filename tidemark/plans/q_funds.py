"""Catalogue, fund-feature, target, recommendation and portfolio queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import bands as B
from tidemark.operators import catalogue as G
from tidemark.operators import fundfeatures as X
from tidemark.operators import joins as J
from tidemark.operators import recommend as R
from tidemark.operators import series as W
from tidemark.plans import adapters as A
from tidemark.plans.q_cleaning import name_sql
from tidemark.plans.q_joins import CEILING_SQL, ELIGIBLE_SQL, FLOOR_SQL, SEGMENT_SQL, STYLE_SQL, TIER_SQL
from tidemark.plans.q_series import TIER_LIST, metrics
from tidemark.plans.registry import common, query, shared
from tidemark.sources.lineage import settle

T5 = rules.TIERS


def rnd(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


# --- snapshots and benchmark attachment -------------------------------------
common("icagr", """
SELECT pow(arg_max(v, d) / arg_min(v, d) FILTER (d >= ref - INTERVAL 36 MONTH), 1.0 / 3) - 1 AS c3,
 pow(arg_max(v, d) / arg_min(v, d) FILTER (d >= ref - INTERVAL 60 MONTH), 1.0 / 5) - 1 AS c5 FROM idx, refd""", ["idx", "refd"])


def _clipsql(c):
    return f"CASE WHEN {c} > 300 THEN 300 WHEN {c} < -95 THEN -95 ELSE {c} END"


_meter = "CASE lower(trim(riskometer)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.RISKOMETER_TIER.items()) + " END"
common("snap", f"""
SELECT name_key, benchmark, riskometer, nav_date, daily_aum,
 {', '.join(f"{_clipsql(c)} AS {c}" for c in [*G.RETURNS, *G.BENCHMARKS])},
 {', '.join(f"fund_return_{h}y - benchmark_return_{h}y AS excess_return_{h}y" for h in (1, 3, 5))},
 greatest(date_diff('day', nav_date, (SELECT max(nav_date) FROM perf_last)), 0) AS recency_days,
 ((benchmark_return_1y IS NOT NULL)::INT + (benchmark_return_3y IS NOT NULL)::INT + (benchmark_return_5y IS NOT NULL)::INT) / 3.0::DOUBLE AS benchmark_quality,
 ((fund_return_1y IS NOT NULL)::INT + (fund_return_3y IS NOT NULL)::INT + (fund_return_5y IS NOT NULL)::INT) / 3.0::DOUBLE AS snapshot_quality,
 {_meter} AS riskometer_tier, {_clipsql('fund_return_3y')} / 100.0 - c3 AS excess_vs_index_3y, {_clipsql('fund_return_5y')} / 100.0 - c5 AS excess_vs_index_5y
FROM perf_last, icagr""", ["perf_last", "icagr"])


def snapshot(t):
    c = W.index_cagr(A.index_series(t)).first()
    return G.snapshot_features(A.performance(t), A.PERF_ORDER, c["index_cagr_3y"], c["index_cagr_5y"])


_snap_nums = ["excess_return_1y", "excess_return_3y", "excess_return_5y", "benchmark_quality", "snapshot_quality",
              "excess_vs_index_3y", "excess_vs_index_5y"]


@query("ag_excess_returns", "SELECT name_key, CAST(recency_days AS INTEGER) AS recency_days, riskometer_tier, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _snap_nums) + " FROM snap", ["snap"])
def _(t):
    return rnd(snapshot(t), _snap_nums).select("name_key", "recency_days", "riskometer_tier", *_snap_nums)


# --- catalogue --------------------------------------------------------------
common("cat_z", """
SELECT code, category, CASE WHEN stddev_samp(vol_1yr) OVER g > 1e-9 THEN (vol_1yr - avg(vol_1yr) OVER g) / stddev_samp(vol_1yr) OVER g ELSE 0 END AS zv,
 CASE WHEN stddev_samp(add) OVER g > 1e-9 THEN (add - avg(add) OVER g) / stddev_samp(add) OVER g ELSE 0 END AS zd, count(*) OVER g AS gn
FROM (SELECT code, category, vol_1yr, abs(max_drawdown) AS add FROM catalogue JOIN metrics ON code = key
 WHERE vol_1yr IS NOT NULL AND max_drawdown IS NOT NULL AND category IS NOT NULL) WINDOW g AS (PARTITION BY category)""", ["catalogue", "metrics"])
common("cat_bands", f"""
SELECT code, {TIER_LIST}[CAST(coalesce(greatest({FLOOR_SQL}, least({CEILING_SQL}, raw_ord)), raw_ord) AS INTEGER) + 1] AS band FROM (
SELECT z.code, z.category, CASE WHEN s <= p[1] THEN 0 WHEN s <= p[2] THEN 1 WHEN s <= p[3] THEN 2 WHEN s <= p[4] THEN 3 ELSE 4 END AS raw_ord
FROM (SELECT *, 0.5 * zv + 0.5 * zd AS s FROM cat_z WHERE gn >= 5) z
JOIN (SELECT category, quantile_cont(0.5 * zv + 0.5 * zd, [0.2, 0.4, 0.6, 0.8]) AS p FROM cat_z WHERE gn >= 5 GROUP BY 1) q ON z.category = q.category)""", ["cat_z"])
common("built", f"""
SELECT e.*, benchmark, riskometer, riskometer_tier, daily_aum, {', '.join(f's.{c} AS {c}' for c in [*G.RETURNS, *G.BENCHMARKS, *X.EXCESS, *X.INDEX_EXCESS])},
 coalesce(s.benchmark_quality, 0) AS benchmark_quality, coalesce(s.snapshot_quality, 0) AS snapshot_quality,
 greatest(coalesce(s.recency_days, 365.0), 0)::DOUBLE AS recency_days, {ELIGIBLE_SQL.replace('category', 'e.category')} AS eligible,
 CASE WHEN {ELIGIBLE_SQL.replace('category', 'e.category')} = 1 AND coalesce(s.benchmark_quality, 0) >= 0.34 THEN 1 ELSE 0 END AS benchmarked,
 coalesce(s.riskometer_tier, b.band, {TIER_SQL.replace('category', 'e.category')}) AS risk_tier,
 CASE WHEN s.riskometer_tier IS NOT NULL THEN 'riskometer' WHEN b.band IS NOT NULL THEN 'history' ELSE 'keyword' END AS risk_tier_source,
 CASE WHEN m.key IS NOT NULL THEN 1 ELSE 0 END AS has_history,
 CASE WHEN coalesce(s.fund_return_1y, s.fund_return_3y, s.fund_return_5y) IS NOT NULL THEN 1 ELSE 0 END AS has_returns,
 CASE WHEN m.key IS NOT NULL THEN 2 WHEN coalesce(s.fund_return_1y, s.fund_return_3y, s.fund_return_5y) IS NOT NULL THEN 1 ELSE 0 END AS quality_mode
FROM expensed e LEFT JOIN cat_bands b ON e.code = b.code LEFT JOIN snap s ON {name_sql('e.name')} = s.name_key LEFT JOIN metrics m ON m.key = e.code
WHERE e.price IS NOT NULL""", ["expensed", "cat_bands", "snap", "metrics"])


def stored_metrics(t):
    return shared(t, "metrics", lambda: settle(metrics(t)))


def built(t):
    return shared(t, "catalogue", lambda: _build(t))


def _build(t):
    m = stored_metrics(t)
    funds = A.catalogue(t)
    return settle(G.build_catalogue(funds, B.fund_risk_bands(funds, m), A.disclosures(t), A.RATE_ORDER, snapshot(t),
                                    m.select(F.col("key").alias("code"))))


@query("jn_attach_benchmark", f"""
SELECT e.code, {ELIGIBLE_SQL.replace('category', 'e.category')} AS eligible,
 CASE WHEN {ELIGIBLE_SQL.replace('category', 'e.category')} = 1 AND coalesce(s.benchmark_quality, 0) >= 0.34 THEN 1 ELSE 0 END AS benchmarked,
 CASE WHEN {ELIGIBLE_SQL.replace('category', 'e.category')} = 1 AND coalesce(s.benchmark_quality, 0) >= 0.34 THEN 'Benchmarked_With_Data'
  WHEN {ELIGIBLE_SQL.replace('category', 'e.category')} = 1 THEN 'Eligible_No_Data' ELSE 'Not_Eligible' END AS benchmark_status,
 greatest(coalesce(s.recency_days, 365.0), 0)::DOUBLE AS recency_days, coalesce(s.riskometer_tier, {TIER_SQL.replace('category', 'e.category')}) AS risk_tier,
 CASE WHEN s.riskometer_tier IS NOT NULL THEN 'riskometer' ELSE 'keyword' END AS risk_tier_source
FROM catalogue e LEFT JOIN snap s ON {name_sql('e.name')} = s.name_key""", ["catalogue", "snap"])
def _(t):
    funds = A.catalogue(t).withColumns({"risk_tier": G.keyword_tier(F.col("category")), "risk_tier_source": F.lit("keyword")})
    out = G.attach_benchmark(funds, snapshot(t))
    return out.select("code", "eligible", "benchmarked", "benchmark_status", "recency_days", "risk_tier", "risk_tier_source")


@query("rc_categorise_by_keyword", f"SELECT code, {TIER_SQL} AS tier FROM catalogue", ["catalogue"])
def _(t):
    return A.catalogue(t).select("code", G.keyword_tier(F.col("category")).alias("tier"))


@query("rc_build_catalogue", "SELECT code, risk_tier, risk_tier_source, expense, expense_source, benchmarked, has_history, has_returns, quality_mode FROM built", ["built"])
def _(t):
    return built(t).select("code", "risk_tier", "risk_tier_source", "expense", "expense_source", "benchmarked",
                           "has_history", "has_returns", "quality_mode")


@query("fe_data_quality_mode", "SELECT quality_mode, has_history, has_returns, count(*) AS n FROM built GROUP BY 1, 2, 3", ["built"])
def _(t):
    return built(t).groupBy("quality_mode", "has_history", "has_returns").agg(F.count(F.lit(1)).alias("n"))


@query("rc_segments_and_styles", f"""
SELECT code, {SEGMENT_SQL} AS segment, {STYLE_SQL} AS style, CASE WHEN {SEGMENT_SQL} = 'Equity' THEN 'equity' ELSE 'debt' END AS asset_class FROM catalogue""", ["catalogue"])
def _(t):
    c = F.col("category")
    return A.catalogue(t).select("code", G.asset_segment(c).alias("segment"), G.style_bucket(c).alias("style"), G.asset_class(c).alias("asset_class"))


# --- fund features ----------------------------------------------------------
@query("fe_log_and_dates", """
SELECT code, round(ln(1 + coalesce(aum, 0)), 6) AS log_aum, round(ln(1 + coalesce(price, 0)), 6) AS log_price, round(ln(1 + coalesce(min_amt, 500)), 6) AS log_min_amt,
 round(CASE WHEN launch_date IS NULL THEN 0 ELSE greatest(date_diff('day', launch_date, ref) / 365.25, 0) END, 6) AS fund_age_years,
 CASE WHEN latest_date IS NULL THEN 365.0 ELSE greatest(date_diff('day', latest_date, ref), 0) END::DOUBLE AS price_recency_days FROM catalogue, refd""", ["catalogue", "refd"])
def _(t):
    out = X.age_and_recency(X.log_features(A.catalogue(t)), A.reference_date(t))
    return rnd(out, ["log_aum", "log_price", "log_min_amt", "fund_age_years"]).select(
        "code", "log_aum", "log_price", "log_min_amt", "fund_age_years", "price_recency_days")


@query("fe_contains_flags", """
SELECT code, contains(lower(scheme_type), 'open')::INT AS is_open_ended, contains(lower(nav_name), 'growth')::INT AS is_growth, (closure_date IS NULL)::INT AS is_active,
 CAST(year(launch_date) AS INTEGER) AS launch_year, (closure_date IS NOT NULL)::INT AS is_closed FROM catalogue""", ["catalogue"])
def _(t):
    return X.launch_flags(X.contains_flags(A.catalogue(t))).select("code", "is_open_ended", "is_growth", "is_active", "launch_year", "is_closed")


TIER_CASE = "coalesce(CASE {c} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(T5)) + " END, 2)"


@query("fe_tier_ordinal", f"SELECT code, CAST({TIER_CASE.format(c='tier')} AS INTEGER) AS tier_ord FROM tiered", ["tiered"])
def _(t):
    from tidemark.functions.columns import tier_ordinal
    return A.catalogue(t).withColumn("tier", G.keyword_tier(F.col("category"))).select("code", tier_ordinal(F.col("tier"), T5).alias("tier_ord"))


common("amcs", """
SELECT amc, n, CASE WHEN row_number() OVER (ORDER BY n DESC, amc) <= 15 THEN 1 ELSE 0 END AS amc_is_top, n / max(n) OVER () AS amc_size_norm
FROM (SELECT amc, count(*) AS n FROM catalogue GROUP BY 1)""", ["catalogue"])


@query("fe_frequency_encode", "SELECT code, amc_is_top, round(amc_size_norm, 6) AS amc_size_norm FROM catalogue JOIN amcs USING (amc)", ["amcs"])
def _(t):
    return rnd(X.frequency_encode(A.catalogue(t), "amc"), ["amc_size_norm"]).select("code", "amc_is_top", "amc_size_norm")


@query("fe_expense_features", """
SELECT code, round(coalesce(greatest(0, least(1, expense / 2.5)), 0), 6) AS expense_norm,
 round(CASE WHEN expense_real IS NULL THEN 0 ELSE greatest(0, least(1, expense_real / 2.5)) END, 6) AS expense_real_norm, expense_missing FROM expensed""", ["expensed"])
def _(t):
    e = X.expense_features(J.attach_expense(A.catalogue(t), A.disclosures(t), A.RATE_ORDER))
    return rnd(e, ["expense_norm", "expense_real_norm"]).select("code", "expense_norm", "expense_real_norm", "expense_missing")


common("proxied", f"""
SELECT code, greatest(0.05, least(2.5, 1.5 - 1.2 * (CASE WHEN contains(lower(nav_name), 'index') OR contains(lower(nav_name), 'etf') OR contains(lower(nav_name), 'nifty') OR contains(lower(nav_name), 'sensex') THEN 1 ELSE 0 END)
 - 0.7 * (CASE WHEN tier IN ('Very_Low', 'Low') THEN 1 ELSE 0 END) - 0.3 * amc_size_norm)) AS p
FROM (SELECT c.*, {TIER_SQL} AS tier, amc_size_norm FROM catalogue c JOIN amcs USING (amc))""", ["catalogue", "amcs"])


@query("fe_expense_proxy", "SELECT code, round(p, 3) AS expense_proxy FROM proxied", ["proxied"])
def _(t):
    c = X.frequency_encode(A.catalogue(t), "amc").withColumn(
        "tier_ord", F.create_map(*[F.lit(x) for kv in rules.TIER_ORD.items() for x in kv])[G.keyword_tier(F.col("category"))])
    return X.expense_proxy(c).select("code", "expense_proxy")


_med = ", ".join(f"median({m}) AS {m}" for m in X.HISTORY)
common("hist", "SELECT c.code, CASE WHEN m.cagr_3yr IS NOT NULL THEN 1 ELSE 0 END AS has_hist, "
       + ", ".join(f"coalesce(m.{m}, d.{m})::DOUBLE AS {m}_hist" for m in X.HISTORY)
       + f" FROM catalogue c LEFT JOIN metrics m ON m.key = c.code, (SELECT {_med} FROM metrics) d", ["catalogue", "metrics"])


@query("fe_attach_metrics", "SELECT code, has_hist AS has_history, " + ", ".join(f"round({c}, 6) AS {c}" for c in X.HIST_COLS) + " FROM hist", ["hist"])
def _(t):
    m = stored_metrics(t)
    out = X.attach_metrics_with_median(A.catalogue(t), m)
    return rnd(out, X.HIST_COLS).select("code", "has_history", *X.HIST_COLS)


def _masked(c):
    s = f"coalesce(CASE WHEN benchmarked > 0 THEN b.{c} END, 0)" if c in X.MASKED else f"coalesce(b.{c}, d.{c}, 0)"
    return f"{s} / 100.0 AS {c}" if "return" in c else f"{s}::DOUBLE AS {c}"


_filled = [*G.RETURNS, "daily_aum", "recency_days"]
common("masked", "SELECT b.code, " + ", ".join(_masked(c) for c in [*X.MASKED, *_filled]) + " FROM built b, (SELECT "
       + ", ".join(f"median({c}) AS {c}" for c in _filled) + " FROM built) d", ["built"])


@query("fe_mask_benchmark", "SELECT code, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*X.MASKED, *_filled]) + " FROM masked", ["masked"])
def _(t):
    out = X.mask_benchmark_features(built(t))
    cols = [*X.MASKED, *_filled]
    return rnd(out, cols).select("code", *cols)


common("fund_features", f"""
SELECT b.code, ln(1 + coalesce(aum, 0)) AS log_aum, ln(1 + coalesce(price, 0)) AS log_price, ln(1 + coalesce(min_amt, 500)) AS log_min_amt,
 CASE WHEN launch_date IS NULL THEN 0 ELSE greatest(date_diff('day', launch_date, ref) / 365.25, 0) END AS fund_age_years,
 CASE WHEN latest_date IS NULL THEN 365.0 ELSE greatest(date_diff('day', latest_date, ref), 0) END AS price_recency_days,
 contains(lower(scheme_type), 'open')::INT AS is_open_ended, (closure_date IS NULL)::INT AS is_active, contains(lower(nav_name), 'growth')::INT AS is_growth,
 {TIER_CASE.format(c='risk_tier')} AS risk_tier_ord, CASE WHEN am.rk <= 15 THEN 1 ELSE 0 END AS amc_is_top, am.sz AS amc_size_norm,
 greatest(0, least(1, expense / 2.5)) AS expense_norm, CASE WHEN expense_real IS NULL THEN 0 ELSE greatest(0, least(1, expense_real / 2.5)) END AS expense_real_norm,
 expense_missing, b.has_returns, CASE WHEN has_hist = 1 THEN 2 WHEN b.has_returns = 1 THEN 1 ELSE 0 END AS quality_mode,
 greatest(-2, least(2, k.excess_return_1y / (vol_1yr_hist + 1e-6))) AS regime_beta, {', '.join(f'h.{c}' for c in X.HIST_COLS)},
 {', '.join(f'k.{c}' for c in [*G.RETURNS, *G.BENCHMARKS, *X.EXCESS, *X.INDEX_EXCESS, 'daily_aum', 'recency_days'])}, eligible, benchmarked,
 {TIER_CASE.format(c='riskometer_tier')} AS riskometer_ord
FROM built b JOIN hist h ON b.code = h.code JOIN masked k ON b.code = k.code
JOIN (SELECT amc, row_number() OVER (ORDER BY n DESC, amc) AS rk, n / max(n) OVER () AS sz FROM (SELECT amc, count(*) AS n FROM built GROUP BY 1)) am ON am.amc = b.amc, refd""",
       ["built", "hist", "masked", "refd"])


def fund_features(t):
    return X.assemble_fund_features(built(t), stored_metrics(t), A.reference_date(t))


@query("fe_regime_beta", "SELECT code, round(regime_beta, 5) AS regime_beta FROM fund_features", ["fund_features"])
def _(t):
    return fund_features(t).select("code", F.round("regime_beta", 5).alias("regime_beta"))


@query("fe_assemble_fund_features", "SELECT code, " + ", ".join(f"round({c}::DOUBLE, 5) AS {c}" for c in X.FEATURE_COLS) + " FROM fund_features", ["fund_features"])
def _(t):
    return rnd(fund_features(t), X.FEATURE_COLS, 5)


# --- targets ----------------------------------------------------------------
@query("rc_alpha_target", """
SELECT code, round(greatest(-0.5, least(0.5, greatest(-0.5, least(1.5, cagr_1yr_hist)) - greatest(-0.5, least(1.5, benchmark_return_1y)) - expense_norm * 0.025)), 6) AS alpha FROM fund_features""", ["fund_features"])
def _(t):
    return rnd(X.alpha_target(fund_features(t)), ["alpha"]).select("code", "alpha")


def _cl(c, lo, hi):
    return f"greatest({lo}, least({hi}, {c}))"


# The limits of each part.
_parts = {"er": "expense_norm", "f1": _cl("fund_return_1y", -.5, 1.5), "ex1": _cl("excess_return_1y", -.8, 1.5), "stale": _cl("recency_days", 0, 3650),
          "c1": _cl("cagr_1yr_hist", -.5, 1), "c3": _cl("cagr_3yr_hist", -.5, 1), "sh": _cl("sharpe_1yr_hist", -3, 5), "dd": "-max_drawdown_hist",
          "mo": _cl("momentum_6m_hist", -.5, 1), "f3": _cl("fund_return_3y", -.5, 1.5), "f5": _cl("fund_return_5y", -.5, 2), "ex3": _cl("excess_return_3y", -.5, 1.5),
          "ex5": _cl("excess_return_5y", -.5, 1.5), "exn": _cl("excess_vs_index_3y", -1, 1), "aum": "log_aum", "rec": "-price_recency_days", "age": "fund_age_years"}
common("pcts", "SELECT code, expense_missing, " + ", ".join(
    f"({e} - min({e}) OVER ()) / (max({e}) OVER () - min({e}) OVER () + 1e-9) AS {n}" for n, e in _parts.items()) + " FROM fund_features", ["fund_features"])
# Weights and limits of the quality targets.
_QUALITY = {
    "history": "greatest(0, least(1, 0.75 * greatest(0, least(1, 0.35 * (0.667 * c1 + 0.333 * c3) + 0.25 * sh + 0.25 * dd + 0.15 * mo - 0.10 * (1 - 0.5 * expense_missing) * er)) + 0.25 * (0.6 * f1 + 0.4 * ex1) * (0.7 + 0.1 * (1 - stale))))",
    "snapshot": "greatest(0, least(1, (0.24 * f1 + 0.16 * f3 + 0.10 * f5 + 0.22 * ex1 + 0.14 * ex3 + 0.08 * ex5 + 0.06 * exn - 0.10 * (1 - 0.5 * expense_missing) * er) * (0.7 + 0.1 * (1 - stale))))",
    "fallback": "greatest(0, least(1, 0.5 * aum + 0.3 * rec + 0.2 * age - 0.10 * (1 - 0.5 * expense_missing) * er))",
}


def _quality(mode):
    @query(f"rc_quality_target_{mode}", f"SELECT code, round({_QUALITY[mode]}, 6) AS quality FROM pcts", ["pcts"])
    def _(t):
        return rnd(X.quality_target(settle(fund_features(t)), mode), ["quality"]).select("code", "quality")


for _m in _QUALITY:
    _quality(_m)


# --- recommendations --------------------------------------------------------
def _norm(c):
    x = f"coalesce({c}, median({c}) OVER g, 0)"
    return f"({x} - coalesce(min({c}) OVER g, 0)) / (coalesce(max({c}) OVER g, 0) - coalesce(min({c}) OVER g, 0) + 1e-6)"


def score_sql(src, by):
    day = "date_diff('day', DATE '1970-01-01', latest_date)"
    return f"""SELECT *, 0.30 * {_norm('excess_return_3y')} + 0.20 * {_norm('excess_return_5y')} + 0.15 * {_norm('fund_return_3y')} + 0.05 * benchmarked
 + 0.20 * (coalesce(aum, 0) - min(coalesce(aum, 0)) OVER g) / (max(coalesce(aum, 0)) OVER g - min(coalesce(aum, 0)) OVER g + 1e-6)
 + 0.10 * coalesce(CASE WHEN max({day}) OVER g > min({day}) OVER g THEN ({day} - min({day}) OVER g) / (max({day}) OVER g - min({day}) OVER g) END, 0) AS score
FROM {src} WINDOW g AS (PARTITION BY {by})"""


_order_case = " ".join(f"WHEN '{t}' THEN ['" + "', '".join(o) + "']" for t, o in rules.SEGMENT_ORDER.items())


def define_recs(n: int) -> str:
    name = f"recs{n}"
    q1, q2 = max(1, math.ceil(n * .5)), max(1, math.ceil(n * .3))
    q3 = max(0, n - q1 - q2)
    per_amc = max(1, math.ceil(n * .4))
    common(f"pool{n}", f"""
SELECT p.*, p.risk_tier AS for_tier, {SEGMENT_SQL} AS segment, {STYLE_SQL} AS style FROM built p
JOIN (SELECT risk_tier, count(*) FILTER (quality_mode >= 1) AS nr FROM built GROUP BY 1) c ON p.risk_tier = c.risk_tier
WHERE p.risk_tier IN ('Very_Low', 'Low') OR c.nr < {max(3, n)} OR p.quality_mode >= 1""", ["built"])
    common(f"scored{n}", score_sql(f"pool{n}", "for_tier"), [f"pool{n}"])
    common(f"seg{n}", f"""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY for_tier, segment ORDER BY score DESC, code) <=
  coalesce([{q1}, {q2}, {q3}][list_position(CASE for_tier {_order_case} END, segment)], 0) THEN 1 ELSE 0 END AS picked, count(*) OVER (PARTITION BY for_tier) AS psize
FROM scored{n}""", [f"scored{n}"])
    common(f"short{n}", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY for_tier, picked ORDER BY score DESC, code) AS r, sum(picked) OVER (PARTITION BY for_tier) AS np FROM seg{n})
WHERE psize <= {n} OR picked = 1 OR r <= {3 * n} - np""", [f"seg{n}"])
    common(f"capped{n}", f"""
SELECT * FROM (SELECT * FROM short{n} WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY for_tier, category ORDER BY score DESC, code) <= 2)
QUALIFY row_number() OVER (PARTITION BY for_tier, amc ORDER BY score DESC, code) <= {per_amc}""", [f"short{n}"])
    common(name, f"""
SELECT *, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY for_tier ORDER BY pin DESC, score DESC, code) AS rk FROM (
 SELECT *, CASE WHEN {n} >= 4 AND for_tier IN ('Medium', 'High', 'Very_High') AND style IN ('core', 'growth')
  AND row_number() OVER (PARTITION BY for_tier, style ORDER BY score DESC, code) = 1 THEN 1 ELSE 0 END AS pin FROM capped{n})) WHERE rk <= {n}""", [f"capped{n}"])
    return name


for _n in (5, 3, 2):
    define_recs(_n)
common("ent5", """
SELECT for_tier, CASE WHEN n > 1 THEN round(e, 4) ELSE 0 END AS category_entropy, CASE WHEN n > 1 THEN round(e / (ln(k) + 1e-9), 4) ELSE 0 END AS category_entropy_norm
FROM (SELECT for_tier, -sum(c / n * ln(c / n + 1e-12)) AS e, any_value(n) AS n, count(*) AS k FROM
 (SELECT for_tier, category, count(*) AS c, sum(count(*)) OVER (PARTITION BY for_tier) AS n FROM recs5 GROUP BY 1, 2) GROUP BY 1)""", ["recs5"])


@query("rc_rule_score", "SELECT code, for_tier, round(score, 6) AS score FROM scored5", ["scored5"])
def _(t):
    pool, _sizes = R.tier_pool(built(t), 5, T5, None, None)
    return rnd(R.rule_score(pool, "for_tier"), ["score"]).select("code", "for_tier", "score")


@query("rc_recommend", """
SELECT r.for_tier, rank, code, category, amc, segment, round(score, 6) AS score, category_entropy, category_entropy_norm,
 CASE WHEN expense_missing = 0 THEN expense_real END AS expense_display FROM recs5 r JOIN ent5 e ON r.for_tier = e.for_tier""", ["recs5", "ent5"])
def _(t):
    out = R.display_rate(R.recommend(built(t), 5))
    return rnd(out, ["score"]).select("for_tier", "rank", "code", "category", "amc", "segment", "score", "category_entropy",
                                      "category_entropy_norm", "expense_display")


@query("rc_rationale_text", """
SELECT for_tier, rank, 'Matched to your ''' || for_tier || ''' risk profile (AUM+recency scored). Category: ' || category || '. ₹' || format('{:,}', CAST(round_even(coalesce(aum, 0), 0) AS BIGINT))
 || ' Cr AUM, NAV ₹' || printf('%.2f', price) || '.' AS rationale FROM recs5""", ["recs5"])
def _(t):
    return R.recommend(built(t), 5).select("for_tier", "rank", R.rationale_text().alias("rationale"))


common("alloc0", """
SELECT for_tier, rank, code, amc, category, asset_class, least(CASE WHEN asset_class = 'equity' THEN eq ELSE 1 - eq END / count(*) OVER (PARTITION BY for_tier, asset_class), 0.30) AS w
FROM (SELECT *, CASE WHEN segment = 'Equity' THEN 'equity' ELSE 'debt' END AS asset_class, CASE for_tier """
       + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.EQUITY_SHARE.items()) + " END AS eq FROM recs5)", ["recs5"])
for _i in range(20):
    common(f"alloc{_i + 1}", f"""
SELECT * REPLACE (CASE WHEN sh > 0.4 + 1e-6 THEN w * 0.4 / sh ELSE w END AS w) FROM (
SELECT for_tier, rank, code, amc, category, asset_class, w, sum(w) OVER (PARTITION BY for_tier, amc) AS sh FROM (
SELECT * REPLACE (w / sum(w) OVER (PARTITION BY for_tier) AS w) FROM (SELECT for_tier, rank, code, amc, category, asset_class, w FROM alloc{_i})))""", [f"alloc{_i}"])
common("allocated", "SELECT for_tier, rank, code, amc, category, asset_class, w / sum(w) OVER (PARTITION BY for_tier) AS w FROM alloc20", ["alloc20"])


def div_sql(src, by):
    return f"""
SELECT {by}, round(0.4 * (1 - sum(pa / n)) + 0.4 * (1 - sum(pc / n)) + 0.2 * least(sum(-log2(pe + 1e-10) / n), 1.0), 4) AS diversification_score FROM (
SELECT {by}, count(*) OVER (PARTITION BY {by}) AS n, count(*) OVER (PARTITION BY {by}, amc) / count(*) OVER (PARTITION BY {by}) AS pa,
 count(*) OVER (PARTITION BY {by}, category) / count(*) OVER (PARTITION BY {by}) AS pc, count(*) OVER (PARTITION BY {by}, ac) / count(*) OVER (PARTITION BY {by}) AS pe
FROM (SELECT *, CASE WHEN {SEGMENT_SQL} = 'Equity' THEN 'equity' ELSE 'debt' END AS ac FROM {src})) GROUP BY 1"""


common("div5", div_sql("recs5", "for_tier"), ["recs5"])


@query("rc_allocate", """
SELECT a.for_tier, rank, code, asset_class, round(w, 4) AS weight, CAST(round_even(w * 100000, 0) AS BIGINT) AS amount, diversification_score,
 max(s) OVER (PARTITION BY a.for_tier) <= 0.4 + 1e-6 AS cap_met
FROM (SELECT *, sum(w) OVER (PARTITION BY for_tier, amc) AS s FROM allocated) a JOIN div5 USING (for_tier)""", ["allocated", "div5"])
def _(t):
    out = R.allocate(R.recommend(built(t), 5))
    return out.select("for_tier", "rank", "code", "asset_class", "weight", "amount", "diversification_score", "cap_met")


@query("ag_hhi_diversification", "SELECT for_tier, diversification_score FROM div5", ["div5"])
def _(t):
    return R.diversification(R.recommend(built(t), 5), ["for_tier"])


_glide = "CASE {t} " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in rules.GLIDE_PATH.items()) + " END"
_slot = "CASE WHEN {h} <= 1 THEN 1 WHEN {h} <= 3 THEN 2 WHEN {h} <= 5 THEN 3 ELSE 4 END"


def glide_sql(t, h):
    return f"CAST(({_glide.format(t=t)})[{_slot.format(h=h)}] AS DOUBLE)"


@query("rc_glide_path", f"""
SELECT code, tier, h AS horizon_years, {glide_sql('tier', 'h')} AS equity_share FROM tiered, (SELECT unnest([1, 3, 5, 10]) AS h) WHERE tier IS NOT NULL""", ["tiered"])
def _(t):
    c = A.catalogue(t).select("code", G.keyword_tier(F.col("category")).alias("tier")).where("tier IS NOT NULL")
    return R.with_horizons(c).withColumn("equity_share", R.glide_path(F.col("tier"), F.col("horizon_years")))


def _ov(words):
    return "(" + " OR ".join(f"contains(lower(coalesce(category, '')), '{w}')" for w in words) + ")"


for _h, _words in rules.HORIZON_OVERRIDE.items():
    common(f"ov{_h}", f"SELECT *, row_number() OVER (ORDER BY score DESC, code) AS rk FROM ({score_sql(f'(SELECT * FROM built WHERE {_ov(_words)})', '1')}) QUALIFY rk <= 2", ["built"])
_two_below = {t: T5[max(0, i - 2)] for i, t in enumerate(T5)}
_tiers_values = "(VALUES " + ", ".join(f"('{t}', '{_two_below[t]}')" for t in T5) + ") AS m(tier, debt_tier)"
common("legs", f"""
SELECT tier, h, 'debt' AS bracket, code, rank FROM recs2 JOIN {_tiers_values} ON for_tier = debt_tier, (SELECT unnest([1, 3, 5, 10]) AS h)
UNION ALL SELECT for_tier, h, 'equity', code, rank FROM recs2, (SELECT unnest([5, 10]) AS h)
UNION ALL SELECT tier, 1, 'equity', code, CAST(rk AS INTEGER) FROM ov1, {_tiers_values}
UNION ALL SELECT tier, 3, 'equity', code, CAST(rk AS INTEGER) FROM ov3, {_tiers_values}""", ["recs2", "ov1", "ov3"])
common("legw", f"""
SELECT *, round_even(tg / count(*) OVER (PARTITION BY tier, h, bracket), 4) AS w0 FROM (
SELECT *, CASE WHEN bracket = 'equity' THEN {glide_sql('tier', 'h')} ELSE 1 - {glide_sql('tier', 'h')} END AS tg FROM legs) WHERE tg > 0""", ["legs"])


@query("rc_recommend_by_horizon", f"""
SELECT tier, h AS horizon_years, bracket, code, rank, weight, CAST(round_even(weight * 100000, 0) AS BIGINT) AS amount, {glide_sql('tier', 'h')} AS equity_share
FROM (SELECT *, round_even(w0 / sum(w0) OVER (PARTITION BY tier, h), 4) AS weight FROM legw)""", ["legw"])
def _(t):
    return R.recommend_by_horizon(built(t)).select("tier", "horizon_years", "bracket", "code", "rank", "weight", "amount", "equity_share")


_brackets = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d!r}::DOUBLE)" for a, b, c, d in R.bracket_table()) + ") AS m(tier, bracket, source, pct)"
common("cs0", f"SELECT tier, bracket, source, pct, code, name, amc, category, rank, round_even(pct / count(*) OVER (PARTITION BY tier, bracket), 4) AS w0 FROM recs3 JOIN {_brackets} ON for_tier = source", ["recs3"])
common("csat", "SELECT *, round_even(w0 / sum(w0) OVER (PARTITION BY tier), 4) AS weight FROM cs0", ["cs0"])
common("csdiv", div_sql("csat", "tier"), ["csat"])


def _cs_query(name, hs, amount, fn):
    @query(name, f"""
SELECT tier, h AS horizon_years, bracket, source AS bracket_tier, round(pct * 100, 1) AS bracket_pct, code, rank, weight, CAST(round_even(weight * {amount}, 0) AS BIGINT) AS amount,
 diversification_score, {glide_sql('tier', 'h')} AS equity_share FROM csat JOIN csdiv USING (tier), (SELECT unnest({hs}) AS h)""", ["csat", "csdiv"])
    def _(t):
        return fn(built(t)).select("tier", "horizon_years", "bracket", "bracket_tier", "bracket_pct", "code", "rank", "weight", "amount",
                                   "diversification_score", "equity_share")


_cs_query("rc_core_satellite", [5], 100000, lambda f: R.core_satellite(f))
_cs_query("rc_full_profile", [1, 3, 5, 10], 500000, lambda f: R.full_profile(f))


@query("rc_compare_rankings", """
WITH a AS (SELECT code, aum, price FROM catalogue WHERE aum IS NOT NULL AND price IS NOT NULL),
x AS (SELECT code, row_number() OVER (ORDER BY aum DESC, code) AS ra FROM a QUALIFY row_number() OVER (ORDER BY aum DESC, code) <= 10),
y AS (SELECT code, row_number() OVER (ORDER BY price DESC, code) AS rb FROM a QUALIFY row_number() OVER (ORDER BY price DESC, code) <= 10)
SELECT code, CAST(max(ra) AS INTEGER) AS rank_a, CAST(max(rb) AS INTEGER) AS rank_b FROM
(SELECT code, ra, NULL AS rb FROM x UNION ALL SELECT code, NULL, rb FROM y) GROUP BY code""", ["catalogue"])
def _(t):
    return R.compare_rankings(A.catalogue(t).where("aum IS NOT NULL AND price IS NOT NULL"), "aum", "price", 10)


@query("jn_top_performers_and_category_stats", """
SELECT category, count(*) AS n, round(avg(cagr_1yr), 6) AS cagr_1yr, round(avg(cagr_3yr), 6) AS cagr_3yr, round(avg(vol_1yr), 6) AS vol_1yr, round(avg(max_drawdown), 6) AS max_drawdown
FROM metrics JOIN catalogue ON key = code WHERE category IS NOT NULL GROUP BY 1""", ["metrics", "catalogue"])
def _(t):
    from tidemark.operators.stats import group_means
    j = metrics(t, False).join(A.catalogue(t).select(F.col("code").alias("key"), "category").where("category IS NOT NULL"), "key")
    cols = ["cagr_1yr", "cagr_3yr", "vol_1yr", "max_drawdown"]
    j = settle(j)
    return rnd(group_means(j, "category", cols), cols).join(j.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category")


@query("jn_top_performers", """
SELECT key, round(sharpe_1yr, 6) AS sharpe_1yr, name, amc, category FROM (SELECT * FROM metrics WHERE record_count >= 100 AND sharpe_1yr IS NOT NULL ORDER BY sharpe_1yr DESC, key LIMIT 20)
LEFT JOIN catalogue ON key = code""", ["metrics", "catalogue"])
def _(t):
    from tidemark.operators.ranking import top_n
    best = top_n(metrics(t, False), "sharpe_1yr", 20, "key", ("record_count", 100)).select("key", "sharpe_1yr")
    names = A.catalogue(t).select(F.col("code").alias("key"), "name", "amc", "category")
    return rnd(best.join(names, "key", "left"), ["sharpe_1yr"])
