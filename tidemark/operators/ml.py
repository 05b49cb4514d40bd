"""Model training, ensembles, clustering and feature ranking on pyspark.ml."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
    OneVsRestModel, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.functions import vectors as V
from tidemark.operators import density as KD
from tidemark.operators.clustering import assign_clusters, best_start, fit_starts, silhouette
from tidemark.operators.perceptron import fit_perceptron
from tidemark.operators.scoring import assemble, holdout_split
from tidemark.session import importable
from tidemark.sources.lineage import settle

SEED = 42


# --- classifiers ------------------------------------------------------------

def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """N/(k*count) per row; the class table has one row per class."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    stats = n.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    weights = n.select(label, (F.lit(float(stats["t"])) / (stats["k"] * F.col("_n"))).alias(out))
    return df.join(F.broadcast(weights), label)  # k rows


def classifier_stage(kind: str, n_features: int, n_classes: int):
    """Estimator by name on the ``features``/``label``/``weight`` columns."""
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 256, 128, 64, 32, n_classes], maxIter=100, seed=SEED)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), weightCol="weight")
    if kind == "boosted":
        return OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.1, seed=SEED), weightCol="weight")
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=12, minInstancesPerNode=5, weightCol="weight", seed=SEED)
    if kind == "forest":
        return RandomForestClassifier(numTrees=60, maxDepth=8, featureSubsetStrategy="sqrt", minInstancesPerNode=3,
                                      weightCol="weight", seed=SEED)
    if kind == "logistic":
        return LogisticRegression(family="multinomial", maxIter=100, regParam=0.001, weightCol="weight")
    raise ValueError(f"unknown classifier {kind!r}")


def train_classifier(df: DataFrame, cols: Sequence[str], label: str, kind: str, n_classes: int = 5) -> PipelineModel:
    """Standardise, weight classes and fit; for the perceptron, which takes no weights, rare classes are
    oversampled by whole copies instead."""
    data = with_class_weight(df.withColumn("label", F.col(label).cast("double")), "label")
    if kind == "mlp":
        copies = F.greatest(F.rint("weight"), F.lit(1.0)).cast("int")
        data = data.withColumn("_c", F.explode(F.sequence(F.lit(1), copies))).drop("_c")
    prepared = [VectorAssembler(inputCols=list(cols), outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    last = classifier_stage(kind, len(cols), n_classes)
    if kind == "mlp" and many_rows(data):
        scaled = Pipeline(stages=prepared).fit(data)
        rows = settle(dealt_evenly(scaled.transform(data).select("features", "label")))
        return PipelineModel(stages=[*scaled.stages, fit_perceptron(rows, last.getLayers(), last.getMaxIter(), SEED)])
    return Pipeline(stages=[*prepared, last]).fit(data)


EVEN_ROWS = 10_000  # rows a core from which training rows are dealt evenly and perceptrons are trained in larger blocks


def many_rows(df: DataFrame) -> bool:
    return df.count() >= EVEN_ROWS * df.sparkSession.sparkContext.defaultParallelism


def dealt_evenly(df: DataFrame) -> DataFrame:
    """``df`` in equal parts, one a core, where it has many rows: every round of a fit waits for its largest part, and
    parts joined by size leave some cores one part more than others."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if many_rows(df) else df


def train_until_best(train: DataFrame, valid: DataFrame, cols: Sequence[str], label: str, n_classes: int = 5,
                     hidden: Sequence[int] = (256, 128, 64, 32), slice_rounds: int = 10, slices: int = 20,
                     patience: int = 4) -> tuple[PipelineModel, DataFrame]:
    """A perceptron trained in slices that start from the weights before, stopped when the validation loss has not
    fallen for ``patience`` slices, with the best slice's weights.

    Also returns (slice, rounds, loss, accuracy, best, last): one row a slice. Rare classes are oversampled as in
    ``train_classifier``; the loss is the mean of minus the log of the true class's probability on ``valid``.
    """
    prepared = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="raw"),
                                StandardScaler(inputCol="raw", outputCol="features", withMean=True)])
    data = with_class_weight(train.withColumn("label", F.col(label).cast("double")), "label")
    copies = F.greatest(F.rint("weight"), F.lit(1.0)).cast("int")
    scaled = prepared.fit(data)
    copied = scaled.transform(data.withColumn("_c", F.explode(F.sequence(F.lit(1), copies)))).select("features", "label")
    rows = settle(dealt_evenly(copied))
    check = settle(scaled.transform(valid.withColumn("label", F.col(label).cast("double"))).select("features", "label"))
    weights, best, history, layers = None, None, [], [len(cols), *hidden, n_classes]
    many = many_rows(rows)
    for k in range(slices):
        if many:
            model = fit_perceptron(rows, layers, slice_rounds, SEED, weights)
        else:
            step = MultilayerPerceptronClassifier(layers=layers, maxIter=slice_rounds, seed=SEED)
            if weights is not None:
                step.setInitialWeights(weights)
            model = step.fit(rows)
        weights = model.weights
        p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        got = model.transform(check).agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-15)))), F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()
        history.append((k + 1, (k + 1) * slice_rounds, got[0], got[1]))
        if best is None or got[0] < history[best][2]:
            best, kept = k, model
        if k - best >= patience:
            break
    table = [(*h, i == best, i == len(history) - 1) for i, h in enumerate(history)]
    return PipelineModel(stages=[*scaled.stages, kept]), train.sparkSession.createDataFrame(
        table, "slice int, rounds int, loss double, accuracy double, best boolean, last boolean")


def predict(model: PipelineModel, df: DataFrame, label: str | None = None) -> DataFrame:
    data = df if label is None else df.withColumn("label", F.col(label).cast("double"))
    if "weight" not in data.columns:
        data = data.withColumn("weight", F.lit(1.0))
    last = model.stages[-1]
    if isinstance(last, OneVsRestModel) and all(isinstance(m, LinearSVCModel) for m in last.models):
        out = PipelineModel(stages=model.stages[:-1]).transform(data)
        return _margins(last, out)
    out = model.transform(data)
    if "probability" in out.columns:
        return out.withColumn("p", vector_to_array("probability"))
    return out


def _margins(model: OneVsRestModel, df: DataFrame) -> DataFrame:
    """``df`` with every class's margin as ``rawPrediction`` and the class of the greatest as ``prediction``, as
    expressions: the fitted model's own transform fails with "Task not serializable"."""
    x = vector_to_array(F.col(model.getFeaturesCol()))
    values = F.array(*[V.dot(x, F.lit([float(w) for w in m.coefficients])) + float(m.intercept) for m in model.models])
    return df.withColumn("_margins", values).withColumns({
        "rawPrediction": array_to_vector("_margins"), "prediction": V.argmax(F.col("_margins")).cast("double")}).drop("_margins")


class KernelClassifier:
    """Gaussian-kernel margin classifier with probabilities.

    Random Fourier features stand for the kernel (their dot products approach it with more features): one array
    expression over the standardised columns. A linear margin classifier is fitted for each class against the rest.
    Its decision values become probabilities by a sigmoid fitted on values of folds that the margin was not fitted
    on, and the classes' probabilities are scaled to one.
    """

    def __init__(self, df: DataFrame, cols: Sequence[str], label: str, key: str, n_classes: int = 5, features: int = 128,
                 folds: int = 3, seed: int = SEED):
        self.cols, self.n_classes = list(cols), n_classes
        # One row of statistics.
        stats = df.agg(*[f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}__{n}") for c in cols
                         for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]).first()
        self.scale = [(stats[f"{c}__mean"] or 0.0, stats[f"{c}__sd"] or 1.0) for c in cols]
        rng = np.random.default_rng(seed)
        wave, shift = rng.normal(0, math.sqrt(2.0 / len(cols)), (features, len(cols))), rng.uniform(0, 2 * math.pi, features)
        self.waves = json.dumps([{"w": w.tolist(), "b": float(b)} for w, b in zip(wave, shift)])
        data = with_class_weight(df.withColumn("label", F.col(label).cast("double")), "label").select(
            "label", "weight", array_to_vector(self.features()).alias("features"), (C.hash_bucket(F.col(key), "margin") % folds).alias("fold"))
        data = settle(data)
        held = None
        for k in range(folds):
            margins = self._fit(data.where(F.col("fold") != k))
            part = self._decide(margins, data.where(F.col("fold") == k)).select("label", "weight", "decision")
            held = part if held is None else held.unionByName(part)
        held = settle(held)
        self.sigmoids = []
        for c in range(n_classes):
            one = held.select((F.col("label") == c).cast("double").alias("label"), "weight", array_to_vector(F.array(F.get("decision", F.lit(c)))).alias("features"))
            fit = LogisticRegression(maxIter=50, regParam=1e-6, weightCol="weight").fit(one)
            self.sigmoids.append((float(fit.coefficients[0]), float(fit.intercept)))
        self.margins = self._fit(data)

    def features(self) -> Column:
        x = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, (m, s) in zip(self.cols, self.scale)])
        waves = F.from_json(F.lit(self.waves), "array<struct<w: array<double>, b: double>>")
        return F.transform(waves, lambda v: F.cos(V.dot(v["w"], x) + v["b"]))

    def _fit(self, data: DataFrame) -> list:
        return [LinearSVC(maxIter=30, regParam=1e-3, weightCol="weight").fit(data.withColumn("label", (F.col("label") == c).cast("double")))
                for c in range(self.n_classes)]

    def _decide(self, margins: list, data: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        values = [V.dot(x, F.lit([float(w) for w in m.coefficients])) + float(m.intercept) for m in margins]
        return data.withColumn("decision", F.array(*values))

    def probabilities(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``df`` with an array of class probabilities."""
        data = self._decide(self.margins, df.withColumn("features", array_to_vector(self.features())))
        raw = F.array(*[1 / (1 + F.exp(-(F.get("decision", F.lit(c)) * a + b))) for c, (a, b) in enumerate(self.sigmoids)])
        return data.withColumn("_raw", raw).withColumn(out, F.transform("_raw", lambda p: p / V.total(F.col("_raw")))).drop("_raw", "decision", "features")


def boosted_probabilities(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Class probabilities of one-against-rest boosted trees: each tree sum is half the log odds of its class."""
    raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-2 * v)))
    scored = predict(model, df).withColumn("_raw", raw)
    return scored.withColumn(out, F.transform("_raw", lambda p: p / V.total(F.col("_raw")))).select(*df.columns, out)


def soft_vote(probabilities: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of probability arrays."""
    names = list(probabilities)
    return V.weighted_mean([probabilities[n] for n in names], [weights[n] for n in names])


VOTE_WEIGHTS = {"boosted": 3.0, "forest": 3.0, "svm": 2.0, "tree": 1.0}  # fixed values


def trained_vote(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, key: str, n_classes: int = 5) -> DataFrame:
    """``test`` with the class probabilities of four trained models (``p_*``) and of their weighted vote (``p_vote``)."""
    out = test
    for kind in ("forest", "tree"):
        model = train_classifier(train, cols, label, kind, n_classes)
        out = predict(model, out).select(*out.columns, F.col("p").alias(f"p_{kind}"))
    out = boosted_probabilities(train_classifier(train, cols, label, "boosted", n_classes), out, "p_boosted")
    out = KernelClassifier(train, cols, label, key, n_classes).probabilities(out, "p_svm")
    return out.withColumn("p_vote", soft_vote({n: F.col(f"p_{n}") for n in VOTE_WEIGHTS}, VOTE_WEIGHTS))


def score_votes(voted: DataFrame, label: str, names: Sequence[str] = ("boosted", "forest", "svm", "tree", "vote")) -> DataFrame:
    """(model, f1, accuracy, class_f1, support) of every probability column on rows with a known class.

    ``f1`` is the mean over the classes that occur; ``class_f1`` and ``support`` list them in their order.
    """
    rows = voted.select(F.col(label).cast("int").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), V.argmax(F.col(f"p_{n}")).cast("int").alias("yhat")) for n in names])))
    cells = rows.groupBy("model", "y", "yhat").agg(F.count(F.lit(1)).alias("n"))  # models x classes x classes rows
    sides = F.inline(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
                             F.struct(F.col("yhat").alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"))))
    per = cells.withColumn("hit", F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).select("model", F.col("y"), "hit", sides) \
        .groupBy("model", "c").agg(F.sum("real").alias("real"), F.sum("said").alias("said"),
                                   F.sum(F.when(F.col("y") == F.col("c"), F.col("hit")).otherwise(0)).alias("hits2"))
    # A hit is on both sides of its cell.
    per = per.withColumn("hits", F.col("hits2") / 2).withColumn("f1", 2 * F.col("hits") / (F.col("real") + F.col("said")))
    real = F.col("real") > 0
    listed = F.sort_array(F.collect_list(F.when(real, F.struct("c", "f1", "real"))))
    return per.groupBy("model").agg(F.avg(F.when(real, F.col("f1"))).alias("f1"), (F.sum("hits") / F.sum("real")).alias("accuracy"), listed.alias("_l")) \
        .select("model", "f1", "accuracy", F.col("_l.f1").alias("class_f1"), F.col("_l.real").alias("support"))


FITS = 4  # fits that run at once: each is many short jobs


def _fit_kind(train: DataFrame, cols: Sequence[str], label: str, key: str, kind: str, n_classes: int):
    if kind == "density":
        return KD.kernel_trees(train, cols, label, key)
    if kind == "svm":
        return KernelClassifier(train, cols, label, key, n_classes)
    return train_classifier(train, cols, label, kind, n_classes)


def _predict_kinds(models: Mapping[str, object], test: DataFrame, cols: Sequence[str], label: str, kinds: Sequence[str]) -> DataFrame:
    """(y, model, yhat) of every row and kind; the vote is taken over the models of its weights."""
    out = test.select(label, *cols)
    if "density" in models:
        out = KD.kernel_scores(out, models["density"], cols).withColumnRenamed("predicted", "yhat_density").drop("log_scores", "kernels")
    for kind in models:
        if kind == "svm":
            out = models[kind].probabilities(out, "p_svm").withColumn("yhat_svm", V.argmax(F.col("p_svm")))
        elif kind == "boosted":
            out = boosted_probabilities(models[kind], out, "p_boosted").withColumn("yhat_boosted", V.argmax(F.col("p_boosted")))
        elif kind != "density":
            out = predict(models[kind], out).select(*out.columns, F.col("p").alias(f"p_{kind}"), F.col("prediction").alias(f"yhat_{kind}"))
    if "vote" in kinds:
        out = out.withColumn("yhat_vote", V.argmax(soft_vote({n: F.col(f"p_{n}") for n in VOTE_WEIGHTS}, VOTE_WEIGHTS)))
    return out.select(F.col(label).cast("int").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"yhat_{n}").cast("int").alias("yhat")) for n in kinds])))


def _scores_of(cells: Mapping[tuple, int]) -> tuple[float, float, dict]:
    """Mean F1, accuracy and F1 by class from confusion counts, as ``class_scores`` has them."""
    real, said, hits = {}, {}, {}
    for (y, yhat), n in cells.items():
        real[y], said[yhat] = real.get(y, 0) + n, said.get(yhat, 0) + n
        if y == yhat is not None:
            hits[y] = n
    f1 = {c: 2.0 * hits.get(c, 0) / (real.get(c, 0) + said.get(c, 0)) for c in {*real, *said}}
    return math.fsum(f1.values()) / len(f1), sum(hits.values()) / sum(real.values()), f1


def compare_classifiers(df: DataFrame, cols: Sequence[str], label: str, key: str, kinds: Sequence[str],
                        folds: int = 3, n_classes: int = 5, valid: float = 0.2) -> DataFrame:
    """Scores of every kind of classifier, ranked by the cross-validated macro F1.

    ``f1`` and ``accuracy`` are means over the folds and ``f1_spread`` is the standard deviation between them; folds are
    hash buckets of the key. ``valid_f1``, ``valid_accuracy``, ``class_f1``, ``support`` and ``confusion`` (rows of true,
    columns of predicted classes) are those of models fitted without a share ``valid`` of the rows, on that share.
    """
    bucket = C.hash_bucket(F.col(key), "fold")
    data = settle(holdout_split(df.withColumn("fold", (bucket % folds).cast("int")), key, {"train": 1.0 - valid, "valid": valid}, "compare"))
    sides = [(data.where(F.col("fold") != k), data.where(F.col("fold") == k)) for k in range(folds)]
    sides.append((data.where("split = 'train'"), data.where("split = 'valid'")))
    # A vote needs its members' models, also where these are not asked for by themselves.
    fitted = [*dict.fromkeys([k for k in kinds if k != "vote"] + [k for k in VOTE_WEIGHTS if "vote" in kinds])]
    importable(df.sparkSession)
    with ThreadPoolExecutor(FITS) as pool:
        fit = inheritable_thread_target(df.sparkSession)(_fit_kind)
        waiting = [{kind: pool.submit(fit, train, cols, label, key, kind, n_classes) for kind in fitted} for train, _ in sides]
        models = [{kind: one.result() for kind, one in part.items()} for part in waiting]
    cells = []
    for part, (_, test) in zip(models, sides):
        counted = _predict_kinds(part, test, cols, label, kinds).groupBy("model", "y", "yhat").agg(F.count(F.lit(1)).alias("n")).collect()
        cells.append({kind: {(r.y, r.yhat): r.n for r in counted if r.model == kind} for kind in kinds})  # kinds x classes x classes rows
    rows = []
    for kind in kinds:
        scores = [_scores_of(part[kind]) for part in cells[:folds]]
        f1 = [s[0] for s in scores]
        mean = sum(f1) / folds
        last = cells[-1][kind]
        valid_f1, valid_accuracy, by_class = _scores_of(last)
        confusion = [[last.get((y, yhat), 0) for yhat in range(n_classes)] for y in range(n_classes)]
        rows.append((kind, mean, sum(s[1] for s in scores) / folds, math.sqrt(sum((x - mean) ** 2 for x in f1) / folds), valid_f1, valid_accuracy,
                     [by_class.get(c, 0.0) for c in range(n_classes)], [sum(r) for r in confusion], confusion))
    table = df.sparkSession.createDataFrame(rows, "model string, f1 double, accuracy double, f1_spread double, valid_f1 double, valid_accuracy double, "
                                                  "class_f1 array<double>, support array<bigint>, confusion array<array<bigint>>")
    return table.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("f1").desc(), "model")))


# --- fund ensemble ----------------------------------------------------------

def base_models(trees: int = 40) -> dict:
    common = dict(featuresCol="features", labelCol="label")
    return {
        "forest": RandomForestRegressor(numTrees=trees, maxDepth=8, minInstancesPerNode=5, featureSubsetStrategy="sqrt",
                                        seed=SEED, predictionCol="p_forest", **common),
        "boosted": GBTRegressor(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=SEED,
                                predictionCol="p_boosted", **common),
        "boosted_deep": GBTRegressor(maxIter=20, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, seed=SEED + 1,
                                     predictionCol="p_boosted_deep", **common),
        "extra": RandomForestRegressor(numTrees=trees, maxDepth=10, minInstancesPerNode=5, subsamplingRate=0.5,
                                       featureSubsetStrategy="onethird", seed=SEED + 7, predictionCol="p_extra", **common),
    }


def fit_fund_ensemble(df: DataFrame, cols: Sequence[str], label: str, names: Sequence[str] | None = None,
                      trees: int = 40) -> dict:
    data = settle(assemble(df.withColumn("label", F.col(label).cast("double")), cols).select("features", "label"))
    picked = {n: m for n, m in base_models(trees).items() if names is None or n in names}
    return {n: m.fit(data) for n, m in picked.items()}


def base_predictions(models: dict, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = assemble(df, cols)
    for m in models.values():
        out = m.transform(out)
    return out.drop("features")


def out_of_fold(df: DataFrame, cols: Sequence[str], label: str, key: str, folds: int = 3,
                names: Sequence[str] | None = None, trees: int = 20) -> DataFrame:
    """Every row predicted by models that never saw its fold; rows with equal ``key`` share a fold."""
    data = settle(df.withColumn("fold", (C.hash_bucket(F.col(key), "oof") % folds).cast("int")))
    parts = None
    for k in range(folds):
        models = fit_fund_ensemble(data.where(F.col("fold") != k), cols, label, names, trees)
        part = base_predictions(models, data.where(F.col("fold") == k), cols)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def r2_table(pred: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Coefficient of determination per prediction column in one aggregate."""
    y = F.col(label).cast("double")
    wide = pred.agg((F.var_pop(y) * F.count(y)).alias("ss"), *[F.sum((y - F.col(c)) * (y - F.col(c))).alias(c) for c in cols])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("model"), (1 - F.col(c) / F.col("ss")).alias("r2")) for c in cols])))


def stack_ridge(oof: DataFrame, label: str, preds: Sequence[str], alpha: float = 1.0):
    """Ridge on out-of-fold base predictions."""
    n = oof.count()
    data = VectorAssembler(inputCols=list(preds), outputCol="stack").transform(oof.withColumn("label", F.col(label).cast("double")))
    return LinearRegression(featuresCol="stack", labelCol="label", predictionCol="stacked", regParam=alpha / n,
                            elasticNetParam=0.0, standardization=False, solver="normal").fit(data)


def blend(models: Sequence[str]) -> Column:
    """0.40/0.35/0.25 of boosted, forest and deep boosted scores, or an even split of the first two."""
    if "boosted_deep" in models:
        return 0.40 * F.col("p_boosted") + 0.35 * F.col("p_forest") + 0.25 * F.col("p_boosted_deep")
    return 0.5 * F.col("p_boosted") + 0.5 * F.col("p_forest")


def segment_models(df: DataFrame, cols: Sequence[str], label: str, equity: Column, masked: Sequence[str],
                   min_rows: int = 200, trees: int = 40) -> dict:
    """Separate models for benchmarked and other funds; a segment under ``min_rows`` gets none, which the
    ``strategy`` column of ``score_funds`` shows."""
    data = df.withColumn("_eq", equity.cast("int"))
    counts = {r["_eq"]: r["n"] for r in data.groupBy("_eq").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = ["forest", "boosted", "boosted_deep"]
    out = {}
    for flag, name in ((1, "equity"), (0, "other")):
        if counts.get(flag, 0) < min_rows:
            continue
        part = data.where(F.col("_eq") == flag)
        if flag == 0:
            part = part.withColumns({c: F.lit(0.0) for c in masked if c in cols})
        out[name] = fit_fund_ensemble(part, cols, label, names, trees)
    return out


def score_funds(df: DataFrame, cols: Sequence[str], strategy: str, models: dict | None = None, segments: dict | None = None,
                stack=None, equity: Column | None = None, masked: Sequence[str] = ()) -> DataFrame:
    """Ensemble score by strategy: 'segment', 'stack', 'blend', or 'auto' for the first of these whose models
    were given. Input columns stay as they came; ``strategy`` names the one that scored."""
    if strategy == "auto":
        complete = bool(segments) and {"equity", "other"} <= set(segments)
        strategy = "segment" if complete else "stack" if stack is not None else "blend"
    if strategy == "segment":
        if not segments or {"equity", "other"} - set(segments):
            raise ValueError("segment strategy needs both segment models")
        data = df.withColumn("_eq", equity.cast("int"))
        parts = []
        for flag, name in ((1, "equity"), (0, "other")):
            part = data.where(F.col("_eq") == flag)
            hidden = [c for c in masked if c in cols] if flag == 0 else []
            part = part.withColumns({f"_own_{c}": F.col(c) for c in hidden}).withColumns({c: F.lit(0.0) for c in hidden})
            scored = base_predictions(segments[name], part, cols)
            parts.append(scored.withColumn("score", C.clip(blend(list(segments[name])), 0, 1)).select(
                *[F.col(f"_own_{c}" if c in hidden else c).alias(c) for c in df.columns], "score"))
        return parts[0].unionByName(parts[1]).withColumn("strategy", F.lit(strategy))
    scored = base_predictions(models, df, cols)
    if strategy == "stack":
        names = [f"p_{n}" for n in models]
        data = VectorAssembler(inputCols=names, outputCol="stack").transform(scored)
        return stack.transform(data).withColumn("score", C.clip(F.col("stacked"), -0.5, 1.0)).drop("stack", "stacked") \
            .withColumn("strategy", F.lit(strategy))
    if strategy == "blend":
        return scored.withColumns({"score": C.clip(blend(list(models)), 0, 1), "strategy": F.lit(strategy)})
    raise ValueError(f"unknown strategy {strategy!r}")


def importance_rows(models: dict, cols: Sequence[str], spark) -> DataFrame:
    """(model, feature, importance) from fitted tree models: models x features rows."""
    rows = [(n, c, float(m.featureImportances[i])) for n, m in models.items() for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def importance_table(rows: DataFrame, top: int = 10) -> DataFrame:
    """Normalise each model to one, average over models, rank; a models x features sized table."""
    per = Window.partitionBy("model")
    total = F.sum("importance").over(per)
    norm = rows.withColumn("share", F.when(total > 0, F.col("importance") / total).otherwise(0.0))
    mean = norm.groupBy("feature").agg(F.avg("share").alias("mean_share"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("mean_share").desc(), "feature")
    return mean.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


# --- clustering -------------------------------------------------------------

def cluster_to_label(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Majority label, purity and size per cluster (lowest label on ties)."""
    cells = df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # At most clusters x labels rows.
    return cells.groupBy("cluster").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"),
                                        (F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("size"))


def centroids(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """Mean vector per cluster: (cluster, center ARRAY, size)."""
    pos = df.select(F.col(cluster).alias("cluster"), F.posexplode(vec).alias("i", "x"))
    means = pos.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"), F.max("n").alias("size"))


def _gap(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def davies_bouldin(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance_ij ratio."""
    c = settle(centroids(df, cluster, vec))
    joined = df.select(F.col(cluster).alias("cluster"), vec).join(F.broadcast(c), "cluster")  # k rows
    spread = joined.groupBy("cluster").agg(F.avg(F.sqrt(V.total(_gap(F.col(vec), F.col("center"))))).alias("spread"))
    table = spread.join(c.select("cluster", "center"), "cluster")
    # One array entry per cluster, attached as a scalar: clusters are compared inside the row.
    everyone = table.agg(F.collect_list(F.struct("cluster", "spread", "center")).alias("t")).scalar()
    rows = table.withColumn("_all", everyone)
    worst = F.array_max(F.transform(
        F.filter("_all", lambda o: o["cluster"] != F.col("cluster")),
        lambda o: (F.col("spread") + o["spread"]) / F.sqrt(V.total(_gap(F.col("center"), o["center"])))))
    return rows.select(worst.alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def squared_silhouette(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """Exact silhouette with squared Euclidean distance, overall ('all') and per cluster.

    The mean squared distance from a point to a cluster follows from the
    cluster's size, vector sum and sum of squared norms, so no pairs are formed.
    """
    pos = df.select(F.col(cluster).alias("c"), F.posexplode(vec).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    sums = pos.groupBy("c", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    stats = sums.groupBy("c").agg(F.max("n").alias("n"), F.sum("q").alias("q"),
                                  F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
    table = stats.agg(F.collect_list(F.struct("c", "n", "q", "s")).alias("t")).scalar()  # one entry per cluster
    rows = df.select(F.col(cluster).alias("c"), F.transform(F.col(vec), lambda x: x.cast("double")).alias("v")).withColumn("t", table)
    rows = rows.withColumn("vv", V.dot(F.col("v"), F.col("v")))
    dist = F.transform("t", lambda k: F.struct(
        k["c"].alias("c"), (F.col("vv") * k["n"] - 2 * V.dot(F.col("v"), k["s"]) + k["q"]).alias("sum"), k["n"].alias("n")))
    rows = rows.withColumn("d", dist)
    own = F.filter("d", lambda k: k["c"] == F.col("c"))[0]
    a = F.when(own["n"] > 1, own["sum"] / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("d", lambda k: k["c"] != F.col("c")), lambda k: k["sum"] / k["n"]))
    rows = rows.select("c", a.alias("a"), b.alias("b"))
    s = rows.select("c", F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    per = s.groupBy(F.col("c").cast("string").alias("scope")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.lit("all").alias("scope"), (F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette"),
                    F.sum("n").alias("n"))
    return per.unionByName(whole)


def elbow_table(df: DataFrame, vec: str, key: str, ks: Sequence[int], starts: Sequence[int] = tuple(range(20))) -> DataFrame:
    """Least cost over all starts and the silhouette of that run, for every k; all runs share their passes."""
    runs = fit_starts(df, vec, key, ks, starts)
    rows = []
    for k in ks:
        best = best_start(runs, k)
        s = silhouette(assign_clusters(best, df, vec), "cluster", vec, key).where("scope = 'all'").first()
        rows.append((k, best.cost, s["silhouette"], s["error"]))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, error double")


# --- feature ranking --------------------------------------------------------

def rank_pca(pca: dict, spark) -> DataFrame:
    """Explained-share-weighted absolute loadings per feature, from a fitted component model."""
    rows = [(c, float(sum(e * abs(pca["loadings"][j][i]) for j, e in enumerate(pca["explained"]))))
            for i, c in enumerate(pca["columns"])]
    return spark.createDataFrame(rows, "feature string, pca double")


TINY = 1e-12
NMF_ROUNDS, NMF_STEPS = 40, 20


def nmf_start(cols: Sequence[str], rank: int) -> list[list[float]]:
    """Positive start of the feature factors, from a hash of factor and column."""
    return [[0.1 + int(hashlib.md5(f"{i}|{c}".encode()).hexdigest()[:8], 16) / 2 ** 32 for c in cols] for i in range(rank)]


def fit_nmf(df: DataFrame, cols: Sequence[str], rank: int = 5, rounds: int = NMF_ROUNDS, steps: int = NMF_STEPS) -> np.ndarray:
    """Feature factors (rank x columns) of a non-negative factorisation by multiplicative updates.

    For given feature factors the factors of a row depend on this row alone, so they are found by ``steps`` updates
    in the pass that needs them and never stored; there are no row ids. What a round brings back are two Gram sums
    of rank x columns and rank x rank numbers, added up in the tasks; the feature factors then take ``steps``
    updates. Each factor's size is split evenly between its two sides. Nulls count 0; negative values are refused.
    """
    importable(df.sparkSession)
    data = settle(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]))
    low = data.agg(F.min(F.least(*cols) if len(cols) > 1 else F.col(cols[0]))).first()[0]
    if low is None or low < 0:
        raise ValueError("the factorisation needs rows, and no negative values")
    h = np.array(nmf_start(cols, rank))
    for _ in range(rounds):
        p, g = _nmf_sums(data, h, steps)
        for _ in range(steps):
            h = h * p / (g @ h + TINY)
    sizes = np.sqrt(np.sqrt(np.diag(g)) / np.maximum(np.linalg.norm(h, axis=1), TINY))
    return h * sizes[:, None]


def _nmf_sums(data: DataFrame, h: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    k, m = h.shape
    square = h @ h.T

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (m + k))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            a, w = x @ h.T, np.ones((len(x), k))
            for _ in range(steps):
                w = w * a / (w @ square + TINY)
            total += np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    got = data.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(k * (m + k))
    for r in got:
        out[r["cell"]] = r["value"]
    return out[: k * m].reshape(k, m), out[k * m:].reshape(k, k)


def rank_nmf(df: DataFrame, cols: Sequence[str], rank: int = 5) -> DataFrame:
    """Euclidean norm of every feature's column of the feature factors."""
    norms = np.linalg.norm(fit_nmf(df, cols, rank), axis=0)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, norms)], "feature string, nmf double")


def hybrid_rank(scores: DataFrame, weights: Mapping[str, float] = rules.RANK_WEIGHTS) -> DataFrame:
    """Min-max every raw score (0.5 when constant), weighted sum, ranked; one row per feature."""
    one = Window.partitionBy(F.lit(1))
    norm = {}
    for c in weights:
        lo, hi = F.min(c).over(one), F.max(c).over(one)
        norm[f"{c}_norm"] = F.when(hi - lo < 1e-12, 0.5).otherwise((F.col(c) - lo) / (hi - lo))
    df = scores.withColumns(norm)
    df = df.withColumn("hybrid", sum((w * F.col(f"{c}_norm") for c, w in weights.items()), F.lit(0.0)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("hybrid").desc(), "feature")))


# --- weight checks ----------------------------------------------------------

def lr_sign_alignment(model: PipelineModel, cols: Sequence[str], weights: Mapping[str, float], spark) -> DataFrame:
    """Slope of the multinomial coefficients over the ordered classes against the design sign."""
    coef = model.stages[-1].coefficientMatrix.toArray()
    rows = [(c, float(k), float(coef[k, i]), float(weights[c])) for i, c in enumerate(cols) for k in range(coef.shape[0])]
    long = spark.createDataFrame(rows, "feature string, cls double, coef double, weight double")
    out = long.groupBy("feature").agg(F.regr_slope("coef", "cls").alias("slope"), F.max("weight").alias("weight"))
    return out.select("feature", "slope", F.signum("slope").cast("int").alias("model_sign"), F.signum("weight").cast("int").alias("design_sign"),
                      (F.signum("slope") == F.signum("weight")).alias("match"))


def importance_alignment(importance: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Rank table of importance against absolute design weight with their rank correlation."""
    from tidemark.operators.bands import rank_values

    spark = importance.sparkSession
    design = spark.createDataFrame([(c, abs(float(w))) for c, w in weights.items()], "feature string, design double")
    j = importance.select("feature", "importance").join(design, "feature")
    j = rank_values(rank_values(j, "importance", "importance_rank"), "design", "design_rank")
    rho = F.corr("importance_rank", "design_rank").over(Window.partitionBy(F.lit(1)))
    return j.withColumn("spearman", rho)
