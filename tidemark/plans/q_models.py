"""Risk score, drift and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import cleaning as K
from tidemark.operators import drift as D
from tidemark.operators import evaluate as E
from tidemark.operators import scoring as S
from tidemark.operators import stats as T
from tidemark.plans import adapters as A
from tidemark.plans.matrix_sql import eigen_sql
from tidemark.plans.registry import common, query, shared
from tidemark.sources.lineage import settle

P = [f"p{i}" for i in range(5)]
FS = A.FEATURES


def rnd(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def bank_features(t):
    return shared(t, "bank_features", lambda: settle(K.customer_features(A.records(t), A.RECORD_ORDER, A.record_chunk())))


_score = " + ".join(f"({w}) * {c}" for c, w in rules.FEATURE_WEIGHTS.items())


@query("rc_risk_score_weighted", f"SELECT Customer_ID, round({_score}, 6) AS risk_score FROM bank_features", ["bank_features"])
def _(t):
    return S.risk_score_weighted(bank_features(t)).select("Customer_ID", F.round("risk_score", 6).alias("risk_score"))


_dims = {d: " + ".join(f"({rules.FEATURE_WEIGHTS[c]}) * {c}" for c in cs) for d, cs in rules.RISK_DIMENSIONS.items()}
common("dims", "SELECT Customer_ID, " + ", ".join(
    f"(({e}) - min({e}) OVER ()) / (max({e}) OVER () - min({e}) OVER ()) AS {d}" for d, e in _dims.items()) + " FROM bank_features", ["bank_features"])


@query("rc_risk_matrix", "SELECT Customer_ID, " + ", ".join(f"round({d}, 6) AS {d}" for d in _dims)
       + f", round(({' + '.join(_dims)}) / 4, 6) AS composite FROM dims", ["dims"])
def _(t):
    return rnd(S.risk_matrix(bank_features(t)), [*_dims, "composite"]).select("Customer_ID", *_dims, "composite")


RF = rules.RISK_FEATURES
common("risk_rows", "SELECT Customer_ID, [" + ", ".join(f"coalesce({c}, 0)::DOUBLE" for c in RF) + "] AS x FROM bank_features", ["bank_features"])
common("risk_cov", "SELECT [" + ", ".join(f"covar_samp(x[{i + 1}], x[{j + 1}])" for i in range(15) for j in range(15)) + "] AS a FROM risk_rows", ["risk_rows"])
common("risk_eigen", eigen_sql("risk_cov", 15), ["risk_cov"])
_positive = [i + 1 for i, c in enumerate(RF) if rules.FEATURE_WEIGHTS[c] > 0]
common("risk_axes", f"""
SELECT k, share, [v * CASE WHEN k = 1 THEN CASE WHEN {' + '.join(f'load[{i}]' for i in _positive)} >= 0 THEN 1 ELSE -1 END
  WHEN list_filter(load, lambda u: abs(u) >= list_max([abs(y) for y in load]) / 2)[1] >= 0 THEN 1 ELSE -1 END for v in load] AS load
FROM (SELECT row_number() OVER (ORDER BY lam DESC) AS k, lam / sum(lam) OVER () AS share, load FROM risk_eigen)""", ["risk_eigen"])
common("risk_pca", """
SELECT Customer_ID, list_sum([(x[i] - m[i]) * load[i] for i in range(1, 16)]) AS risk_score FROM risk_rows,
 (SELECT load FROM risk_axes WHERE k = 1), (SELECT [""" + ", ".join(f"avg(x[{i + 1}])" for i in range(15)) + "] AS m FROM risk_rows)", ["risk_rows", "risk_axes"])


@query("rc_risk_score_pca", "SELECT Customer_ID, round(risk_score, 6) AS risk_score FROM risk_pca", ["risk_pca"])
def _(t):
    f = bank_features(t)
    return rnd(S.risk_score_pca(f, S.fit_pca(f, RF)), ["risk_score"]).select("Customer_ID", "risk_score")


_label = " + ".join(f"(risk_score > q[{i + 1}])::INT" for i in range(4))


@query("rc_assign_risk_label", f"""
SELECT Customer_ID, round(risk_score, 6) AS risk_score, {_label} AS tier_ord, {list(rules.TIERS)!r}[{_label} + 1] AS risk_label
FROM risk_pca, (SELECT quantile_cont(risk_score, {list(rules.LABEL_QUANTILES)}) AS q FROM risk_pca)""", ["risk_pca"])
def _(t):
    f = bank_features(t)
    return rnd(S.assign_risk_label(f, S.fit_pca(f, RF)), ["risk_score"]).select("Customer_ID", "risk_score", "tier_ord", "risk_label")


@query("ml_pca_summary", f"""
SELECT k::INT AS component, {RF!r}[i] AS feature, round(load[i], 5) AS loading, round(share, 6) AS explained,
  round((SELECT sum(share) FROM risk_axes b WHERE b.k <= a.k), 6) AS cumulative
FROM risk_axes a, (SELECT unnest(range(1, 16)) AS i) WHERE k <= 5""", ["risk_axes"])
def _(t):
    f = bank_features(t)
    return rnd(rnd(S.pca_summary(f, S.fit_pca(f, RF)), ["loading"], 5), ["explained", "cumulative"])


_hash = "(('0x' || substr(md5({k}::VARCHAR || '|{s}'), 1, 8))::BIGINT % 10000)"


@query("rc_holdout_split", f"""
SELECT c_custkey, CASE WHEN h < 6500 THEN 'central' WHEN h < 9500 THEN 'federated' ELSE 'demo' END AS split FROM (SELECT c_custkey, {_hash.format(k='c_custkey', s='split')} AS h FROM customer)""")
def _(t):
    return S.holdout_split(t.customer.select("c_custkey"), "c_custkey", {"central": 0.65, "federated": 0.30, "demo": 0.05})


@query("rc_stratified_split", """
SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || '|strata'), c_custkey) <= round_even(count(*) OVER (PARTITION BY c_mktsegment) * 0.8, 0)
 THEN 'train' ELSE 'validation' END AS split FROM customer""")
def _(t):
    return S.stratified_split(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment").select("c_custkey", "split")


# --- weight sensitivity -----------------------------------------------------
W15 = {c: rules.FEATURE_WEIGHTS[c] for c in RF}
_sc = " + ".join(f"coalesce({c}, 0) * ({w!r}::DOUBLE)" for c, w in W15.items())
common("base_cuts", f"SELECT quantile_cont({_sc}, [0.125, 0.375, 0.625, 0.875]) AS q FROM bank_features", ["bank_features"])


def _band(expr):
    return f"(({expr}) > q[1])::INT + (({expr}) > q[2])::INT + (({expr}) > q[3])::INT + (({expr}) > q[4])::INT"


def _trial_sql(scenarios, names):
    vals = ", ".join("('" + n + "', " + ", ".join(f"{s[c]!r}::DOUBLE" for c in W15) + ")" for n, s in zip(names, scenarios))
    expr = " + ".join(f"coalesce(f.{c}, 0) * s.{c}" for c in W15)
    return f"""SELECT scenario, {', '.join(f'avg((b = {i})::INT) AS share{i}' for i in range(5))} FROM (
SELECT scenario, {_band(expr)} AS b FROM bank_features f, base_cuts, (VALUES {vals}) AS s(scenario, {', '.join(W15)})) GROUP BY 1"""


common("trials", _trial_sql(S.scenario_weights(W15, 500), [str(i) for i in range(500)]), ["bank_features", "base_cuts"])


@query("jn_scenario_cross", "SELECT scenario, " + ", ".join(f"round(share{i}, 6) AS share{i}" for i in range(5)) + " FROM trials", ["trials"])
def _(t):
    f = bank_features(t)
    cuts = T.fitted_quantiles(f.withColumn("s", S.weighted_sum(W15)), ["s"], rules.LABEL_QUANTILES)["s"]
    out = S.scenario_shares(f, S.scenario_weights(W15, 500), cuts)
    return rnd(out, [f"share{i}" for i in range(5)]).drop("n")


_dev = "greatest(" + ", ".join(f"abs(share{i} - {x})" for i, x in enumerate(S.TARGET_SHARES)) + ")"


@query("ml_weight_sensitivity", f"SELECT count(*) AS trials, round(avg({_dev}), 6) AS mean_dev, round(quantile_cont({_dev}, 0.95), 6) AS p95_dev FROM trials", ["trials"])
def _(t):
    return rnd(S.weight_sensitivity(bank_features(t), W15), ["mean_dev", "p95_dev"])


_sweep, _names = [dict(W15)], ["base"]
for _c, _w in W15.items():
    for _side, _sg in (("minus", -1), ("plus", 1)):
        _sweep.append({**W15, _c: _w + _sg * 0.20 * abs(_w)})
        _names.append(f"{_side}|{_c}")
common("sweep", _trial_sql(_sweep, _names), ["bank_features", "base_cuts"])


@query("ml_single_feature_sweep", """
SELECT split_part(a.scenario, '|', 2) AS feature, round(max(CASE WHEN a.scenario LIKE 'minus%' THEN d END), 6) AS minus, round(max(CASE WHEN a.scenario LIKE 'plus%' THEN d END), 6) AS plus FROM (
SELECT a.scenario, greatest(""" + ", ".join(f"abs(a.share{i} - b.share{i})" for i in range(5)) + """) AS d FROM sweep a, sweep b WHERE b.scenario = 'base' AND a.scenario <> 'base') a GROUP BY 1""", ["sweep"])
def _(t):
    return rnd(S.single_feature_sweep(bank_features(t), W15), ["minus", "plus"])


# --- drift ------------------------------------------------------------------
SC = ["f1", "f5"]
common("matched", "SELECT a.key, abs(a.f1 / 10 - b.f1 / 10) AS d1, abs(a.f5 - b.f5) AS d5, abs(a.f3 / 500000 - b.f3 / 500000) AS d3 FROM current a JOIN baseline b USING (key)", ["current", "baseline"])


def scaled(df):
    return df.select("key", (F.col("f1") / 10).alias("f1"), "f5", (F.col("f3") / 500000).alias("f3"))


common("drifted", """
SELECT key, d1, d5, d3, greatest(d1, d5, d3) AS m, CASE WHEN d1 = greatest(d1, d5, d3) THEN 'f1' WHEN d5 = greatest(d1, d5, d3) THEN 'f5' ELSE 'f3' END AS top FROM matched""", ["matched"])
DC = ["f1", "f5", "f3"]


def drift(t):
    return D.detect_drift(scaled(A.current(t)), scaled(A.baseline(t)), DC)


@query("dr_detect_drift", "SELECT key, round(m, 4) AS max_delta, top AS top_feature, m > 0.25 AS drifted, round(d1, 4) AS delta_f1, round(d5, 4) AS delta_f5, round(d3, 4) AS delta_f3 FROM drifted", ["drifted"])
def _(t):
    return drift(t).select("key", "max_delta", "top_feature", "drifted", *[F.round(F.col("deltas")[i], 4).alias(f"delta_{c}") for i, c in enumerate(DC)])


@query("dr_drift_message", """
SELECT key, CASE WHEN m > 0.25 THEN '⚠ Customer ' || key || ': risk profile may be stale. Significant changes detected in: ' || l || '. Largest shift: ''' || top || ''' moved ' || printf('%.0f', round_even(m * 100, 0)) ||
 '% of feature range. Re-run FL inference to update risk label.' ELSE '' END AS message FROM (
SELECT d.key, any_value(m) AS m, any_value(top) AS top, string_agg('''' || n || ''' (+' || printf('%.2f', x) || ')', ', ' ORDER BY x DESC, o) FILTER (x > 0.25) AS l FROM drifted d JOIN (
 SELECT key, 'f1' AS n, d1 AS x, 1 AS o FROM matched UNION ALL SELECT key, 'f5', d5, 2 FROM matched UNION ALL SELECT key, 'f3', d3, 3 FROM matched) u ON d.key = u.key GROUP BY 1)""", ["drifted"])
def _(t):
    return D.drift_message(drift(t), DC)


def _psi_sql(c):
    return f"""SELECT '{c}' AS feature, greatest(sum((p1 - p0) * ln(p1 / p0)), 0) AS psi FROM (
SELECT (b + 1e-8) / (sum(b) OVER () + 1e-8 * count(*) OVER ()) AS p0, (q + 1e-8) / (sum(q) OVER () + 1e-8 * count(*) OVER ()) AS p1 FROM (
SELECT lo, (SELECT count(*) FROM baseline WHERE {c} >= lo AND ({c} < hi OR (last AND {c} <= hi))) AS b, (SELECT count(*) FROM current WHERE {c} >= lo AND ({c} < hi OR (last AND {c} <= hi))) AS q
FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, lead(e, 2) OVER (ORDER BY e) IS NULL AS last FROM (
SELECT DISTINCT unnest(quantile_cont({c}, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM baseline)) WHERE hi IS NOT NULL))"""


common("psis", " UNION ALL ".join(_psi_sql(c) for c in FS), ["baseline", "current"])
_ks_terms = " + ".join(f"{2.0 * (-1) ** (k - 1)} * exp(-2.0 * {k * k} * l * l)" for k in range(1, 101))


def _ks_sql(c):
    return f"""SELECT '{c}' AS feature, max(abs(a / ta - b / tb)) AS ks, any_value(ta) AS ta, any_value(tb) AS tb FROM (
SELECT v, sum(x) OVER (ORDER BY v) AS a, sum(y) OVER (ORDER BY v) AS b, sum(x) OVER () AS ta, sum(y) OVER () AS tb FROM (
SELECT v, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM (SELECT {c} AS v, 1 AS x, 0 AS y FROM baseline UNION ALL SELECT {c}, 0, 1 FROM current) GROUP BY 1))"""


common("kss", "SELECT feature, ks, CASE WHEN l < 0.2 THEN 1.0 ELSE least(greatest(" + _ks_terms + ", 0), 1) END::DOUBLE AS p FROM (SELECT feature, ks, ks * sqrt(ta * tb / (ta + tb)) AS l FROM ("
       + " UNION ALL ".join(_ks_sql(c) for c in FS) + "))", ["baseline", "current"])


@query("ag_psi", "SELECT feature, round(psi, 5) AS psi FROM psis", ["psis"])
def _(t):
    return rnd(T.psi(A.baseline(t), A.current(t), FS), ["psi"], 5)


@query("ag_ks_two_sample", "SELECT feature, round(ks, 6) AS ks_statistic, round(p, 5) AS ks_pvalue FROM kss", ["kss"])
def _(t):
    k = T.ks_two_sample(A.baseline(t), A.current(t), FS)
    return k.select("feature", F.round("ks_statistic", 6).alias("ks_statistic"), F.round("ks_pvalue", 5).alias("ks_pvalue"))


@query("dr_population_drift", """
SELECT feature, round(psi, 4) AS psi, psi > 0.25 AS psi_flag, round(ks, 4) AS ks_statistic, round(p, 4) AS ks_pvalue, p < 0.05 AS ks_flag,
 CASE WHEN psi > 0.25 THEN 'HIGH' WHEN psi > 0.10 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM psis JOIN kss USING (feature)""", ["psis", "kss"])
def _(t):
    return D.population_drift(A.baseline(t), A.current(t), FS)


# --- evaluation -------------------------------------------------------------
@query("ev_confusion_matrix", "SELECT y, yhat, count(*) AS n FROM predictions GROUP BY 1, 2", ["predictions"])
def _(t):
    return E.confusion_matrix(A.predictions(t))


common("perclass", """
SELECT c AS cls, count(*) FILTER (y = c) AS support, count(*) FILTER (yhat = c) AS pred, count(*) FILTER (y = c AND yhat = c) AS hits FROM predictions, (SELECT unnest([0, 1, 2, 3, 4]) AS c) GROUP BY 1""", ["predictions"])
common("prf", "SELECT cls, hits, support, CASE WHEN pred > 0 THEN hits / pred ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, CASE WHEN pred + support > 0 THEN 2 * hits / (pred + support) ELSE 0 END AS f1 FROM perclass", ["perclass"])


@query("ev_classification_report", """
SELECT cls::VARCHAR AS scope, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf UNION ALL
SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM prf UNION ALL
SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM prf UNION ALL
SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM prf""", ["prf"])
def _(t):
    return rnd(E.classification_report(A.predictions(t)), ["precision", "recall", "f1"])


def _auc_sql(i):
    return f"""SELECT {i} AS cls, sum(n / tn * (2.0 * cp - p) / (2.0 * tp)) AS auc, any_value(tp)::BIGINT AS support FROM (
SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS cp, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM (
SELECT p{i} AS s, sum((y = {i})::INT)::DOUBLE AS p, sum((y <> {i})::INT)::DOUBLE AS n FROM predictions GROUP BY 1))"""


common("aucs", " UNION ALL ".join(_auc_sql(i) for i in range(5)), ["predictions"])


@query("ev_roc_auc_ovr", "SELECT cls, round(auc, 6) AS auc, support FROM aucs", ["aucs"])
def _(t):
    return rnd(E.roc_auc_ovr(A.predictions(t), "y", P), ["auc"])


@query("ev_auc_summary", "SELECT round(avg(auc), 6) AS macro_auc, round(sum(auc * support) / sum(support), 6) AS weighted_auc FROM aucs", ["aucs"])
def _(t):
    return rnd(E.auc_summary(E.roc_auc_ovr(A.predictions(t), "y", P)), ["macro_auc", "weighted_auc"])


@query("ev_roc_points", " UNION ALL ".join(f"""
SELECT {i} AS cls, round(s, 6) AS threshold, round(cp / tp, 6) AS tpr, round(cn / tn, 6) AS fpr FROM (
SELECT s, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM (
SELECT p{i} AS s, sum((y = {i})::INT)::DOUBLE AS p, sum((y <> {i})::INT)::DOUBLE AS n FROM predictions GROUP BY 1))""" for i in range(5)), ["predictions"])
def _(t):
    return rnd(E.roc_points(A.predictions(t), "y", P), ["threshold", "tpr", "fpr"]).select("cls", "threshold", "tpr", "fpr")


def _curve_sql(i):
    return f"""SELECT {i} AS cls, cn / tn AS fpr, max(cp / tp) AS tpr FROM (
SELECT s, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM (
SELECT p{i} AS s, sum((y = {i})::INT)::DOUBLE AS p, sum((y <> {i})::INT)::DOUBLE AS n FROM predictions GROUP BY 1)) GROUP BY 1, 2"""


common("curves", " UNION ALL ".join(_curve_sql(i) for i in range(5)), ["predictions"])
common("curve_grid", """
SELECT cls, fpr, max(tpr) AS tpr FROM (SELECT c.cls, g.fpr, t.tpr FROM (SELECT DISTINCT fpr FROM curves) g CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS cls) c
LEFT JOIN curves t ON t.cls = c.cls AND t.fpr = g.fpr UNION ALL SELECT unnest([0, 1, 2, 3, 4]), 0.0, 0.0) GROUP BY 1, 2""", ["curves"])


@query("ev_macro_roc_auc", """
SELECT round(sum((fpr - pf) * (t + pt) / 2), 6) AS macro_auc FROM (SELECT fpr, t, lag(fpr) OVER (ORDER BY fpr) AS pf, lag(t) OVER (ORDER BY fpr) AS pt FROM (
SELECT fpr, sum(CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (fpr - x0) / (x1 - x0) ELSE y0 END) / 5 AS t FROM (SELECT fpr,
 last_value(CASE WHEN tpr IS NOT NULL THEN fpr END IGNORE NULLS) OVER b AS x0, last_value(tpr IGNORE NULLS) OVER b AS y0,
 first_value(CASE WHEN tpr IS NOT NULL THEN fpr END IGNORE NULLS) OVER a AS x1, first_value(tpr IGNORE NULLS) OVER a AS y1 FROM curve_grid
 WINDOW b AS (PARTITION BY cls ORDER BY fpr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cls ORDER BY fpr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) GROUP BY 1))""", ["curve_grid"])
def _(t):
    return rnd(E.macro_roc_auc(A.predictions(t), "y", P), ["macro_auc"])


@query("ev_brier_multiclass", "SELECT 'all' AS scope, round(avg(" + " + ".join(f"(p{i} - (y = {i})::INT) * (p{i} - (y = {i})::INT)" for i in range(5)) + "), 6) AS brier FROM predictions"
       + "".join(f" UNION ALL SELECT '{i}', round(avg((p{i} - (y = {i})::INT) * (p{i} - (y = {i})::INT)), 6) FROM predictions" for i in range(5)), ["predictions"])
def _(t):
    return rnd(E.brier_multiclass(A.predictions(t), "y", P), ["brier"])


common("groups", """
SELECT grp, avg((y = yhat)::INT) AS acc FROM (SELECT *, CASE WHEN age <= 30 THEN 'Young' WHEN age <= 50 THEN 'Middle' ELSE 'Senior' END AS grp FROM predictions) GROUP BY 1""", ["predictions"])


@query("ev_accuracy_parity", "SELECT round(min(acc) / max(acc), 6) AS parity, arg_min(grp, row(acc, grp)) AS worst_group, arg_max(grp, row(acc, grp)) AS best_group, min(acc) / max(acc) >= 0.90 AS passed FROM groups", ["groups"])
def _(t):
    return rnd(E.accuracy_parity(A.predictions(t), E.age_group(F.col("age"))), ["parity"])


@query("ev_model_gap", "SELECT round(a, 6) AS acc_a, round(b, 6) AS acc_b, round(abs(a - b) * 100, 6) AS gap_pp, abs(a - b) * 100 < 2 AS passed FROM (SELECT avg((y = yhat)::INT) AS a, avg((y = yhat2)::INT) AS b FROM predictions)", ["predictions"])
def _(t):
    return rnd(E.model_gap(A.predictions(t), "yhat", "yhat2"), ["acc_a", "acc_b", "gap_pp"])


@query("ev_prediction_change", "SELECT round(avg((yhat <> yhat2)::INT) * 100, 6) AS change_pct, avg((yhat <> yhat2)::INT) * 100 < 10 AS passed FROM predictions", ["predictions"])
def _(t):
    return rnd(E.prediction_change(A.predictions(t), "yhat", "yhat2"), ["change_pct"])


@query("ev_loss_variance", "SELECT round(var_pop(loss), 8) AS loss_variance FROM (SELECT avg((value)) / 1000 AS loss FROM events GROUP BY CAST(ts AS DATE))")
def _(t):
    rounds = t.events.groupBy(F.col("ts").cast("date").alias("round")).agg((F.avg("value") / 1000).alias("loss"))
    return rnd(E.loss_variance(rounds, "loss"), ["loss_variance"], 8)


@query("ev_metric_report", """
WITH m AS (SELECT 'macro_f1' AS metric, round((SELECT avg(f1) FROM prf), 6) AS value, 0.80::DOUBLE AS threshold, (SELECT avg(f1) FROM prf) >= 0.80 AS passed
UNION ALL SELECT 'brier', round((SELECT avg(""" + " + ".join(f"(p{i} - (y = {i})::INT) * (p{i} - (y = {i})::INT)" for i in range(5)) + """) FROM predictions), 6), 0.10, (SELECT avg(""" + " + ".join(f"(p{i} - (y = {i})::INT) * (p{i} - (y = {i})::INT)" for i in range(5)) + """) FROM predictions) < 0.10
UNION ALL SELECT 'parity', round((SELECT min(acc) / max(acc) FROM groups), 6), 0.90, (SELECT min(acc) / max(acc) FROM groups) >= 0.90
UNION ALL SELECT 'text_checks', NULL, NULL, NULL)
SELECT * FROM m UNION ALL SELECT 'total_passed', count(*) FILTER (passed), NULL, NULL FROM m UNION ALL SELECT 'total_failed', count(*) FILTER (NOT passed), NULL, NULL FROM m
UNION ALL SELECT 'total_skipped', count(*) FILTER (passed IS NULL), NULL, NULL FROM m""", ["prf", "groups", "predictions"])
def _(t):
    p = A.predictions(t)
    f1 = E.class_scores(E.confusion_matrix(p)).agg(F.avg("f1").alias("v"))
    brier = E.brier_multiclass(p, "y", P).where("scope = 'all'")
    parity = E.accuracy_parity(p, E.age_group(F.col("age")))
    skipped = p.agg(F.count(F.lit(1)).alias("n"))
    rows = [E.metric_row(f1, "macro_f1", F.col("v"), 0.80, F.col("v") >= 0.80),
            E.metric_row(brier, "brier", F.col("brier"), 0.10, F.col("brier") < 0.10),
            E.metric_row(parity, "parity", F.col("parity"), 0.90, F.col("passed")),
            E.metric_row(skipped, "text_checks", F.lit(None), None, None)]
    return rnd(E.metric_report(rows), ["value"])


@query("ev_per_customer_predictions", "SELECT key, ['" + "', '".join(rules.TIERS) + "'][y + 1] AS true_label, ['" + "', '".join(rules.TIERS) + "'][yhat + 1] AS predicted_label, round(greatest(p0, p1, p2, p3, p4), 6) AS confidence, y = yhat AS correct, "
       + ", ".join(f"round(p{i}, 6) AS p_{n}" for i, n in enumerate(rules.TIERS)) + " FROM predictions", ["predictions"])
def _(t):
    out = E.per_customer_predictions(A.predictions(t), "key", P, rules.TIERS)
    return rnd(out, ["confidence", *[f"p_{n}" for n in rules.TIERS]])


@query("ev_classifier_leaderboard", """
SELECT model, round(acc, 6) AS accuracy, CAST(row_number() OVER (ORDER BY acc DESC, model) AS INTEGER) AS place FROM (
SELECT 'first' AS model, avg((y = yhat)::INT) AS acc FROM predictions UNION ALL SELECT 'second', avg((y = yhat2)::INT) FROM predictions)""", ["predictions"])
def _(t):
    p = A.predictions(t)
    s = p.select(F.explode(F.array(*[F.struct(F.lit(n).alias("model"), (F.col("y") == F.col(c)).cast("double").alias("ok"))
                                     for n, c in (("first", "yhat"), ("second", "yhat2"))])).alias("m")).select("m.*")
    out = s.groupBy("model").agg(F.avg("ok").alias("accuracy"))
    return rnd(E.classifier_leaderboard(out, "accuracy"), ["accuracy"])


@query("ev_label_cross_check", """
SELECT bool_and(y = yhat) AS all_rule_match, bool_and(yhat2 = y) AS all_model_match, bool_and(yhat = yhat2) AS all_agree, bool_and(greatest(p0, p1, p2, p3, p4) >= 0.70) AS all_confident,
 count(DISTINCT yhat2) AS distinct_labels, (SELECT bool_and(s > p) FROM (SELECT s, lag(s) OVER (ORDER BY y) AS p FROM (SELECT y, avg(age) AS s FROM predictions GROUP BY 1)) WHERE p IS NOT NULL) AS scores_ordered FROM predictions""", ["predictions"])
def _(t):
    p = A.predictions(t).withColumn("conf", F.greatest(*P))
    return E.label_cross_check(p, "age", "y", "yhat", "yhat2", "y", "conf")
