"""Model-training, clustering and feature-ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import vectors as V
from tidemark.operators import bands as B
from tidemark.operators import clustering as CL
from tidemark.operators import density as KD
from tidemark.operators import fundfeatures as X
from tidemark.operators import ml as M
from tidemark.operators import neighbours as N
from tidemark.operators import panel as PN
from tidemark.operators import scoring as S
from tidemark.operators import stats as T
from tidemark.plans import adapters as A
from tidemark.plans.matrix_sql import factor_sql, information_sql, lloyd_sql
from tidemark.plans.q_cleaning import scratch
from tidemark.plans.q_funds import built, fund_features, stored_metrics
from tidemark.plans.q_models import P, bank_features
from tidemark.plans.q_panel import stored_panel
from tidemark.plans.q_text import updates
from tidemark.plans.registry import common, query, shared
from tidemark.sources import sinks
from tidemark.sources.lineage import settle

FS = A.FEATURES
RF = rules.RISK_FEATURES


def rnd(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def labelled(t):
    """Customers with the fifteen features and their quantile label."""
    def build():
        f = bank_features(t)
        out = S.assign_risk_label(f, S.fit_pca(f, RF))
        return settle(out.withColumn("key", F.regexp_replace("Customer_ID", "CUS_", "").cast("bigint")))
    return shared(t, "labelled", build)


# --- classifiers (rows only: trained models) --------------------------------
def _classifier(kind):
    @query(f"ml_train_{kind}")
    def _(t):
        data = S.holdout_split(labelled(t), "key", {"train": 0.7, "test": 0.3}, "ml")
        model = M.train_classifier(data.where("split = 'train'"), RF, "tier_ord", kind)
        pred = M.predict(model, data.where("split = 'test'"), "tier_ord")
        return pred.select("key", "tier_ord", F.col("prediction").cast("int").alias("predicted"))


for _k in ("mlp", "svm", "boosted", "tree", "forest", "logistic"):
    _classifier(_k)


@query("ml_mlp_rounds")
def _(t):
    data = S.holdout_split(labelled(t), "key", {"train": 0.8, "valid": 0.2}, "rounds")
    return M.train_until_best(data.where("split = 'train'"), data.where("split = 'valid'"), RF, "tier_ord")[1]


@query("ml_compare_classifiers")
def _(t):
    return M.compare_classifiers(labelled(t), RF, "tier_ord", "key", ["mlp", "svm", "boosted", "tree", "density", "forest", "vote", "logistic"], folds=5)


@query("snk_save_and_load_model", "SELECT CAST(o_custkey AS BIGINT) AS key, FALSE AS changed FROM orders GROUP BY 1")
def _(t):
    model = M.train_classifier(labelled(t), RF, "tier_ord", "tree")
    back = sinks.load_model(sinks.save_model(model, scratch(t, "model")))
    before = M.predict(model, labelled(t), "tier_ord").select("key", F.col("prediction").alias("before"), F.col("p").alias("p_before"))
    after = M.predict(back, labelled(t), "tier_ord").select("key", "prediction", "p")
    return before.join(after, "key").select(
        "key", (~F.col("before").eqNullSafe(F.col("prediction")) | ~F.col("p_before").eqNullSafe(F.col("p"))).alias("changed"))


@query("rc_advise_all")
def _(t):
    from tidemark.operators import recommend as R
    model = M.train_classifier(labelled(t), RF, "tier_ord", "forest")
    names = F.array(*[F.lit(n) for n in rules.TIERS])
    pred = M.predict(model, labelled(t), "tier_ord").select(
        "key", F.element_at(names, F.col("prediction").cast("int") + 1).alias("risk_label"), F.transform("p", lambda x: F.round(x, 4)).alias("probabilities"))
    return R.advise_all(pred, R.recommend(built(t), 5))


# --- density classifier and voting ------------------------------------------
_label = " + ".join(f"(risk_score > q[{i + 1}])::INT" for i in range(4))
common("risk_labels", f"SELECT Customer_ID, {_label} AS label FROM risk_pca, (SELECT quantile_cont(risk_score, {list(rules.LABEL_QUANTILES)}) AS q FROM risk_pca)", ["risk_pca"])
_gap = " + ".join(f"(a.x[{i + 1}] - b.x[{i + 1}]) ** 2" for i in range(15))
common("kernel_scores", f"""
SELECT id, label, ln(sum(exp(e - m))) + any_value(m) - ln(count(*)) - (15 * ln(0.2) + 7.5 * ln(2 * pi())) + ln(count(*) / any_value(n)) AS log_score
FROM (SELECT *, max(e) OVER (PARTITION BY id, label) AS m FROM (
  SELECT a.Customer_ID AS id, l.label, -({_gap}) / (2 * 0.2 * 0.2) AS e, n
  FROM risk_rows a, risk_rows b JOIN risk_labels l ON b.Customer_ID = l.Customer_ID, (SELECT count(*) AS n FROM risk_rows)))
GROUP BY 1, 2""", ["risk_rows", "risk_labels"])


def kernel_scores(t):
    """All customers against kernels on the fifteen features and the five risk classes."""
    def build():
        rows = labelled(t)
        return settle(KD.kernel_scores(rows.select("Customer_ID", "tier_ord", *RF), KD.kernel_trees(rows, RF, "tier_ord", "key"), RF))
    return shared(t, "kernel_scores", build)


@query("ml_kde_classifier", "SELECT id AS Customer_ID, label::INT AS label, round(log_score, 5) AS log_score FROM kernel_scores", ["kernel_scores"])
def _(t):
    long = kernel_scores(t).select("Customer_ID", F.posexplode("log_scores").alias("label", "log_score"))
    return rnd(long, ["log_score"], 5)


@query("ml_kde_predictions", """
SELECT s.id AS Customer_ID, any_value(l.label)::INT AS tier_ord, arg_max(s.label, row(s.log_score, -s.label))::INT AS predicted
FROM kernel_scores s JOIN risk_labels l ON l.Customer_ID = s.id GROUP BY 1""", ["kernel_scores", "risk_labels"])
def _(t):
    return kernel_scores(t).select("Customer_ID", "tier_ord", "predicted")


@query("ml_soft_vote", "SELECT key, " + ", ".join(f"round((3 * p{i} + 3 * p{(i + 1) % 5} + 2 * p{(i + 2) % 5} + 0.2) / 9, 6) AS v{i}" for i in range(5)) + " FROM predictions", ["predictions"])
def _(t):
    def shifted(k):
        return F.array(*[F.col(P[(i + k) % 5]) for i in range(5)])
    votes = {"boosted": shifted(0), "forest": shifted(1), "svm": shifted(2), "tree": F.array(*[F.lit(0.2)] * 5)}
    v = A.predictions(t).withColumn("v", M.soft_vote(votes, {"boosted": 3, "forest": 3, "svm": 2, "tree": 1}))
    return v.select("key", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(5)])


@query("ml_trained_vote")
def _(t):
    data = S.holdout_split(labelled(t), "key", {"train": 0.7, "test": 0.3}, "vote").select("key", "tier_ord", "split", *RF)
    voted = M.trained_vote(data.where("split = 'train'"), data.where("split = 'test'"), RF, "tier_ord", "key")
    return M.score_votes(settle(voted), "tier_ord")


@query("ml_sharpen_probabilities", "SELECT key, " + ", ".join(f"round(pow(p{i}, 5) / (" + " + ".join(f"pow(p{j}, 5)" for j in range(5)) + f"), 6) AS s{i}" for i in range(5)) + " FROM predictions", ["predictions"])
def _(t):
    s = A.predictions(t).select("key", F.array(*P).alias("p")).withColumn("s", V.sharpen(F.col("p"), 0.2))
    return s.select("key", *[F.round(F.col("s")[i], 6).alias(f"s{i}") for i in range(5)])


# --- fund ensemble on the forward panel -------------------------------------
PCOLS = ["cagr_1yr", "cagr_3yr", "momentum_6m", "max_drawdown", "vol_1yr", "sharpe_1yr", "benchmarked"]


def panel_rows(t):
    def build():
        lab = PN.label_top_quantile(stored_panel(t))
        filled = lab.withColumn("row_key", F.concat_ws("|", "key", "as_of"))
        med = T.fitted_quantiles(filled, PCOLS, [0.5])
        return settle(filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c][0]).cast("double"), F.lit(0.0)) for c in PCOLS}))
    return shared(t, "panel_rows", build)


@query("ml_fit_fund_ensemble")
def _(t):
    rows = panel_rows(t)
    models = M.fit_fund_ensemble(rows, PCOLS, "label_best", trees=20)
    return M.r2_table(M.base_predictions(models, rows, PCOLS), "label_best", [f"p_{n}" for n in models])


@query("ml_stack_ridge")
def _(t):
    oof = settle(M.out_of_fold(panel_rows(t), PCOLS, "label_best", "key", 5))
    names = list(M.base_models())
    stack = M.stack_ridge(oof, "label_best", [f"p_{n}" for n in names])
    rows = [*((n, float(w)) for n, w in zip(names, stack.coefficients)), ("intercept", float(stack.intercept))]
    return t.spark.createDataFrame(rows, "model string, weight double")


@query("ml_segment_scores")
def _(t):
    rows = panel_rows(t)
    eq = F.col("benchmarked") > 0
    seg = M.segment_models(rows, PCOLS, "label_best", eq, ["benchmarked"], trees=10)
    # A small catalogue has too few rows in a segment: the whole-panel blend scores it, and the result says so.
    whole = {} if len(seg) == 2 else M.fit_fund_ensemble(rows, PCOLS, "label_best", ["forest", "boosted", "boosted_deep"], trees=10)
    return M.score_funds(rows, PCOLS, "auto", models=whole, segments=seg, equity=eq, masked=["benchmarked"]).select("row_key", "score", "strategy")


@query("ml_score_funds")
def _(t):
    feats = settle(X.quality_target(fund_features(t), "history"))
    cols = X.FEATURE_COLS
    models = M.fit_fund_ensemble(feats, cols, "quality", ["forest", "boosted", "boosted_deep"], trees=20)
    return M.score_funds(feats, cols, "blend", models).select("code", "quality", "score")


common("imps", "SELECT l_returnflag AS model, l_linestatus || l_linenumber AS feature, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS importance FROM lineitem GROUP BY 1, 2")


@query("ml_importance_table", """
SELECT feature, round(mean_share, 6) AS mean_share, CAST(place AS INTEGER) AS place FROM (SELECT feature, mean_share, row_number() OVER (ORDER BY mean_share DESC, feature) AS place FROM (
SELECT feature, avg(share) AS mean_share FROM (SELECT model, feature, importance / sum(importance) OVER (PARTITION BY model) AS share FROM imps) GROUP BY 1)) WHERE place <= 10""", ["imps"])
def _(t):
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.concat("l_linestatus", "l_linenumber").alias("feature")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("importance"))
    return rnd(M.importance_table(rows), ["mean_share"])


# --- clustering -------------------------------------------------------------
DIMS = 64
common("vec_rows", "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings")
common("one_run", lloyd_sql("vec_rows", "vec_id", DIMS, [5], 1, CL.ROUNDS), ["vec_rows"])


# The best of twenty is checked against a loop in the tests: its SQL takes most of a minute.
@query("ml_fit_kmeans")
def _(t):
    u = updates(t)
    return CL.assign_clusters(CL.best_start(CL.fit_starts(u, "vec", "vec_id", [5]), 5), u, "vec").select("vec_id", "cluster")


@query("ml_kmeans_start", f"""
SELECT vec_id, (list_position(d, list_min(d)) - 1)::INT AS cluster FROM (
  SELECT vec_id, [list_distance(v, c[i * {DIMS} + 1: (i + 1) * {DIMS}]) for i in range(5)] AS d FROM vec_rows, one_run)""", ["vec_rows", "one_run"])
def _(t):
    u = updates(t)
    return CL.assign_clusters(CL.fit_starts(u, "vec", "vec_id", [5], [0])[0], u, "vec").select("vec_id", "cluster")


@query("ml_elbow_table")
def _(t):
    return M.elbow_table(updates(t), "vec", "vec_id", range(2, 11))


common("vec_pairs", "SELECT a.vec_id AS p, b.vec_id AS q, list_distance(a.v, b.v) AS d FROM vec_rows a, vec_rows b", ["vec_rows"])


@query("ml_plain_silhouette", """
SELECT scope, round(avg(s), 6) AS silhouette, count(*) AS n, 0.0::DOUBLE AS error FROM (
 SELECT unnest([own::VARCHAR, 'all']) AS scope, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM (
  SELECT p, own, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM (
   SELECT p, x.label AS own, y.label AS other, sum(d) AS s, count(*) AS n FROM vec_pairs JOIN embeddings x ON x.vec_id = p JOIN embeddings y ON y.vec_id = q
   GROUP BY 1, 2, 3) GROUP BY 1, 2)) GROUP BY 1""", ["vec_pairs"])
def _(t):
    return rnd(CL.silhouette(updates(t), "label", "vec", "vec_id"), ["silhouette"])


@query("ml_cluster_to_label", """
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(arg_max(label, row(n, -label)) AS INTEGER) AS label, round(max(n) / sum(n), 6) AS purity, CAST(sum(n) AS BIGINT) AS size
FROM (SELECT vec_id % 5 AS cluster, label, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    u = updates(t).withColumn("cluster", (F.col("vec_id") % 5).cast("int"))
    return rnd(M.cluster_to_label(u, "cluster", "label"), ["purity"])


@query("ev_cluster_accuracy", """
WITH m AS (SELECT cluster, arg_max(label, row(n, -label)) AS ml FROM (SELECT vec_id % 5 AS cluster, label, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY 1)
SELECT round(avg((e.label = m.ml)::INT), 6) AS accuracy FROM embeddings e JOIN m ON e.vec_id % 5 = m.cluster""")
def _(t):
    from tidemark.operators.evaluate import cluster_accuracy
    u = updates(t).withColumn("cluster", (F.col("vec_id") % 5).cast("int"))
    return rnd(cluster_accuracy(u.select("cluster", F.col("label").alias("y")), "cluster", "y", M.cluster_to_label(u, "cluster", "label")), ["accuracy"])


common("cents", "SELECT label AS c, i, avg(x) AS m FROM vecs GROUP BY 1, 2", ["vecs"])
common("spreads", "SELECT c, avg(d) AS s FROM (SELECT v.vec_id, v.label AS c, sqrt(sum((x - m) * (x - m))) AS d FROM vecs v JOIN cents ON v.label = c AND v.i = cents.i GROUP BY 1, 2) GROUP BY 1", ["vecs", "cents"])


@query("ml_davies_bouldin", """
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.c, max((sa.s + sb.s) / d) AS r FROM (
SELECT a.c, b.c AS c2, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM cents a JOIN cents b ON a.i = b.i AND a.c <> b.c GROUP BY 1, 2) a JOIN spreads sa ON sa.c = a.c JOIN spreads sb ON sb.c = a.c2 GROUP BY 1)""", ["cents", "spreads"])
def _(t):
    return rnd(M.davies_bouldin(updates(t), "label", "vec"), ["davies_bouldin"])


common("sil", """
SELECT p.vec_id, p.label AS c, q.label AS o, sum(list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2) AS s, count(*) AS n FROM embeddings p, embeddings q GROUP BY 1, 2, 3""")
common("silp", """
SELECT vec_id, c, max(CASE WHEN o = c AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN o <> c THEN s / n END) AS b FROM sil GROUP BY 1, 2""", ["sil"])


@query("ml_silhouette", """
SELECT c::VARCHAR AS scope, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette, count(*) AS n FROM silp GROUP BY 1
UNION ALL SELECT 'all', round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5), count(*) FROM silp""", ["silp"])
def _(t):
    return rnd(M.squared_silhouette(updates(t), "label", "vec"), ["silhouette"], 5)


# --- ranking ----------------------------------------------------------------
common("rank_pca", f"SELECT {RF!r}[i] AS feature, sum(share * abs(load[i])) AS pca FROM risk_axes, (SELECT unnest(range(1, 16)) AS i) WHERE k <= 8 GROUP BY 1", ["risk_axes"])


def pca_ranks(t):
    return M.rank_pca(S.fit_pca(bank_features(t), RF, 8), t.spark)


@query("ml_rank_pca", "SELECT feature, round(pca, 6) AS pca FROM rank_pca", ["rank_pca"])
def _(t):
    return rnd(pca_ranks(t), ["pca"])


common("rank_factors", factor_sql("risk_rows", M.nmf_start(RF, 5), M.NMF_ROUNDS, M.NMF_STEPS, M.TINY), ["risk_rows"])
common("rank_nmf", f"""
SELECT {RF!r}[j + 1] AS feature, sqrt(list_sum([(h[i * 15 + j + 1] ** 2) * sqrt(g[i * 6 + 1]) / sqrt(list_sum([y ** 2 for y in h[i * 15 + 1: i * 15 + 15]])) for i in range(5)])) AS nmf
FROM rank_factors, (SELECT unnest(range(15)) AS j)""", ["rank_factors"])


@query("ml_rank_nmf", "SELECT feature, round(nmf, 5) AS nmf FROM rank_nmf", ["rank_nmf"])
def _(t):
    return rnd(M.rank_nmf(bank_features(t), RF), ["nmf"], 5)


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


FX = ["f1", "f3", "f4", "f5"]
common("spear", " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr(a, b)) AS spearman FROM (SELECT {_rank(c)} AS a, {_rank('f2')} AS b FROM features)" for c in FX), ["features"])


@query("ml_rank_spearman", "SELECT feature, round(spearman, 6) AS spearman FROM spear", ["spear"])
def _(t):
    return rnd(T.spearman_with(A.features(t), "f2", FX, "key"), ["spearman"])


def _code(c):
    return f"len(list_filter(list_distinct(q_{c}), lambda e: e < {c}))"


common("mi_cuts", "SELECT " + ", ".join(f"quantile_cont({c}, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q_{c}" for c in FS) + " FROM features", ["features"])
common("mis", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM (
SELECT {_code(c)} AS x, {_code('f2')} AS y, count(*)::DOUBLE AS n FROM features, mi_cuts GROUP BY 1, 2))""" for c in FX), ["features", "mi_cuts"])


@query("ml_rank_binned_information", "SELECT feature, round(mi, 6) AS mi FROM mis", ["mis"])
def _(t):
    return rnd(T.mutual_information(A.features(t), "f2", FX), ["mi"])


# The fifteen features against the weighted score, as the ranking uses them.
_weighted = " + ".join(f"({w}) * {c}" for c, w in rules.FEATURE_WEIGHTS.items())
# Nine decimals: values that tie but for the order of their sums tie in both.
common("scored_rows", f"SELECT *, {_weighted} AS risk_score FROM (SELECT Customer_ID, {', '.join(f'round({c}, 9) AS {c}' for c in RF)} FROM bank_features)", ["bank_features"])
common("rank_mi", information_sql("scored_rows", "Customer_ID", "risk_score", RF, 5, N.JITTER, N.HAIR), ["scored_rows"])
common("rank_rho", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr(a, b)) AS spearman FROM (SELECT {_rank(c)} AS a, {_rank('risk_score')} AS b FROM scored_rows)" for c in RF), ["scored_rows"])


def scored_rows(t):
    return S.risk_score_weighted(rnd(bank_features(t), RF, 9))


@query("ml_rank_mutual_information", "SELECT feature, round(mi, 6) AS mi FROM rank_mi", ["rank_mi"])
def _(t):
    return rnd(N.neighbour_information(scored_rows(t), "risk_score", RF, "Customer_ID"), ["mi"])


common("rawrank", "SELECT * FROM rank_pca JOIN rank_nmf USING (feature) JOIN rank_mi USING (feature) JOIN rank_rho USING (feature)",
       ["rank_pca", "rank_nmf", "rank_mi", "rank_rho"])
_nm = {c: f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-12 THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END" for c in rules.RANK_WEIGHTS}


@query("ml_hybrid_rank", "SELECT feature, round(hybrid, 5) AS hybrid, CAST(row_number() OVER (ORDER BY hybrid DESC, feature) AS INTEGER) AS place FROM (SELECT feature, "
       + " + ".join(f"{w} * {_nm[c]}" for c, w in rules.RANK_WEIGHTS.items()) + " AS hybrid FROM rawrank)", ["rawrank"])
def _(t):
    f = scored_rows(t)
    raw = (pca_ranks(t).join(M.rank_nmf(bank_features(t), RF), "feature").join(N.neighbour_information(f, "risk_score", RF, "Customer_ID"), "feature")
           .join(T.spearman_with(f, "risk_score", RF, "Customer_ID"), "feature"))
    return rnd(M.hybrid_rank(raw), ["hybrid"], 5).select("feature", "hybrid", "place")


@query("ml_lr_sign_alignment")
def _(t):
    model = M.train_classifier(labelled(t), RF, "tier_ord", "logistic")
    return M.lr_sign_alignment(model, RF, rules.FEATURE_WEIGHTS, t.spark)


@query("ml_importance_alignment")
def _(t):
    model = M.train_classifier(labelled(t), RF, "tier_ord", "forest")
    imp = M.importance_rows({"forest": model.stages[-1]}, RF, t.spark)
    return M.importance_alignment(imp, rules.FEATURE_WEIGHTS)


@query("ev_generalisation_gaps")
def _(t):
    rows = panel_rows(t)
    names = ["forest", "boosted"]
    models = M.fit_fund_ensemble(rows, PCOLS, "label_best", names, trees=10)
    preds = [f"p_{n}" for n in names]
    inside = M.r2_table(M.base_predictions(models, rows, PCOLS), "label_best", preds)
    oof = M.r2_table(M.out_of_fold(rows, PCOLS, "label_best", "key", 5, names, trees=10), "label_best", preds)
    from tidemark.operators.evaluate import generalisation_gaps
    return generalisation_gaps(inside.join(oof.withColumnRenamed("r2", "cv_r2"), "model"))
