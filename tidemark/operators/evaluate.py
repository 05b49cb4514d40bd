"""Model evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators.cleaning import neighbours
from tidemark.operators.quantiles import running_totals
from tidemark.sources.lineage import settle


def confusion_matrix(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts; 0 when undefined."""
    cells = cm.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("yhat").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")))).alias("c")).select("c.*")
    s = cells.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    p = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return s.select("cls", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "hits")


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages as tidy (scope, ...) rows."""
    s = class_scores(confusion_matrix(df, y, yhat))
    per = s.select(F.col("cls").cast("string").alias("scope"), "precision", "recall", "f1", "support")
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return (F.sum(F.col(c) * F.col("support")) / n).alias(c)

    acc = F.sum("hits") / n
    totals = [
        s.agg(F.lit("accuracy").alias("scope"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), n.alias("support")),
        s.agg(F.lit("macro").alias("scope"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], n.alias("support")),
        s.agg(F.lit("weighted").alias("scope"), *[weighted(c) for c in ("precision", "recall", "f1")], n.alias("support")),
    ]
    for t in totals:
        per = per.unionByName(t)
    return per


def score_long(df: DataFrame, y: str, probs: Sequence[str]) -> DataFrame:
    """(cls, score, pos, neg) for one-vs-rest curves."""
    cells = F.array(*[F.struct(F.lit(i).alias("cls"), F.col(p).alias("score"),
                               (F.col(y) == i).cast("bigint").alias("pos")) for i, p in enumerate(probs)])
    return df.select(F.inline(cells)).withColumn("neg", 1 - F.col("pos")).withColumn("score", -F.col("score"))


def roc_points(df: DataFrame, y: str, probs: Sequence[str]) -> DataFrame:
    """Curve points per class at every distinct score, highest score first."""
    run = running_totals(score_long(df, y, probs), ["cls"], "score", ["pos", "neg"])
    return run.select("cls", (-F.col("score")).alias("threshold"), (F.col("cum_pos") / F.col("tot_pos")).alias("tpr"),
                      (F.col("cum_neg") / F.col("tot_neg")).alias("fpr"), "pos", "neg", "cum_pos", "tot_pos", "tot_neg")


def roc_auc_ovr(df: DataFrame, y: str, probs: Sequence[str]) -> DataFrame:
    """Area under each one-vs-rest curve (trapezoids) with the class support."""
    pts = roc_points(df, y, probs)
    # Trapezoid from the previous point: its true-positive count is cum_pos - pos.
    strip = F.col("neg") / F.col("tot_neg") * (2.0 * F.col("cum_pos") - F.col("pos")) / (2.0 * F.col("tot_pos"))
    return pts.groupBy("cls").agg(F.sum(strip).alias("auc"), F.max("tot_pos").alias("support"))


def auc_summary(auc: DataFrame) -> DataFrame:
    return auc.agg(F.avg("auc").alias("macro_auc"),
                   (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("weighted_auc"))


def macro_roc_auc(df: DataFrame, y: str, probs: Sequence[str]) -> DataFrame:
    """Area of the mean curve: every class interpolated at the union of false-positive rates.

    Points are dealt to tasks by rate and only the edges of these ranges are carried,
    so no class is scanned by a single task.
    """
    n = len(probs)
    pts = roc_points(df, y, probs)
    # A repeated rate is a vertical step: interpolation takes its upper end.
    top = pts.groupBy("cls", "fpr").agg(F.max("tpr").alias("tpr"))
    classes = F.array(*[F.lit(i) for i in range(n)])
    marks = top.select("fpr").distinct().withColumn("cls", F.explode(classes))
    # Every curve starts at the origin unless its first point is already there.
    origin = df.limit(1).select(F.lit(0.0).alias("fpr"), F.explode(classes).alias("cls"), F.lit(0.0).alias("tpr"))
    known = marks.join(top, ["cls", "fpr"], "left").select("cls", "fpr", "tpr")
    known = known.unionByName(origin.select("cls", "fpr", "tpr")).groupBy("cls", "fpr").agg(F.max("tpr").alias("tpr"))
    known = settle(known.repartitionByRange("fpr").withColumn("slot", F.spark_partition_id()))
    slot = F.col("slot")
    at = known.withColumn("pt", F.when(F.col("tpr").isNotNull(), F.struct("fpr", "tpr")))
    near = neighbours(at, ["pt"], ["cls"], ["fpr"], slot)
    x0, y0, x1, y1 = (F.col(f"{s}_pt.{c}") for s in ("prev", "next") for c in ("fpr", "tpr"))
    value = F.when(x1 > x0, y0 + (y1 - y0) * (F.col("fpr") - x0) / (x1 - x0)).otherwise(y0)
    mean = near.select("fpr", "slot", value.alias("t")).groupBy("fpr", "slot").agg((F.sum("t") / n).alias("t"))
    steps = neighbours(mean.withColumn("pt", F.struct("fpr", "t")), ["pt"], [], ["fpr"], slot, exclusive=True)
    area = (F.col("fpr") - F.col("prev_pt.fpr")) * (F.col("t") + F.col("prev_pt.t")) / 2
    return steps.select(area.alias("a")).agg(F.sum("a").alias("macro_auc"))


def brier_multiclass(df: DataFrame, y: str, probs: Sequence[str]) -> DataFrame:
    """Mean summed squared error over classes (scope 'all') and per class."""
    def err(i: int, p: str) -> Column:
        gap = F.col(p) - (F.col(y) == i).cast("double")
        return gap * gap

    wide = df.agg(*[F.avg(err(i, p)).alias(p) for i, p in enumerate(probs)])
    rows = [F.struct(F.lit("all").alias("scope"), sum((F.col(p) for p in probs), F.lit(0.0)).alias("brier"))]
    rows += [F.struct(F.lit(str(i)).alias("scope"), F.col(p).alias("brier")) for i, p in enumerate(probs)]
    return wide.select(F.inline(F.array(*rows)))


def age_group(age: Column) -> Column:
    return F.when(age <= 30, "Young").when(age <= 50, "Middle").when(age > 50, "Senior")


def accuracy_parity(df: DataFrame, group: Column, y: str = "y", yhat: str = "yhat", floor: float = 0.90) -> DataFrame:
    """Lowest over highest group accuracy, and which groups they are."""
    per = (df.select(group.alias("grp"), (F.col(y) == F.col(yhat)).cast("double").alias("ok")).where("grp IS NOT NULL")
           .groupBy("grp").agg(F.avg("ok").alias("acc"), F.count(F.lit(1)).alias("n")))
    ratio = F.when((F.count(F.lit(1)) >= 2) & (F.max("acc") > 0), F.min("acc") / F.max("acc"))
    return per.agg(ratio.alias("parity"), F.min_by("grp", F.struct("acc", "grp")).alias("worst_group"),
                   F.max_by("grp", F.struct("acc", "grp")).alias("best_group"),
                   F.coalesce(ratio >= floor, F.lit(False)).alias("passed"))


def model_gap(df: DataFrame, a: str, b: str, y: str = "y", limit: float = 2.0) -> DataFrame:
    """Absolute accuracy difference of two models in percentage points."""
    row = df.agg(F.avg((F.col(y) == F.col(a)).cast("double")).alias("acc_a"),
                 F.avg((F.col(y) == F.col(b)).cast("double")).alias("acc_b"))
    gap = F.abs(F.col("acc_a") - F.col("acc_b")) * 100
    return row.select("acc_a", "acc_b", gap.alias("gap_pp"), (gap < limit).alias("passed"))


def prediction_change(df: DataFrame, a: str, b: str, limit: float = 10.0) -> DataFrame:
    pct = F.avg((F.col(a) != F.col(b)).cast("double")) * 100
    return df.agg(pct.alias("change_pct"), (pct < limit).alias("passed"))


def loss_variance(rounds: DataFrame, loss: str) -> DataFrame:
    return rounds.agg(F.var_pop(loss).alias("loss_variance"))


METRIC_SCHEMA = ["metric", "value", "threshold", "passed"]


def metric_row(df: DataFrame, name: str, value: Column, threshold: float | None, passed: Column | None) -> DataFrame:
    return df.select(F.lit(name).alias("metric"), value.cast("double").alias("value"),
                     F.lit(threshold).cast("double").alias("threshold"),
                     (passed if passed is not None else F.lit(None)).cast("boolean").alias("passed"))


def metric_report(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of one-row metrics plus a totals row per outcome."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    totals = rows.agg(F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
                      F.count_if(F.col("passed").isNull()).alias("skipped"))
    tall = totals.select(F.inline(F.array(*[
        F.struct(F.lit(f"total_{c}").alias("metric"), F.col(c).cast("double").alias("value"),
                 F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("boolean").alias("passed"))
        for c in ("passed", "failed", "skipped")])))
    return rows.unionByName(tall)


def per_customer_predictions(df: DataFrame, key: str, probs: Sequence[str], names: Sequence[str], y: str = "y",
                             yhat: str = "yhat") -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(key, F.element_at(labels, F.col(y) + 1).alias("true_label"),
                     F.element_at(labels, F.col(yhat) + 1).alias("predicted_label"),
                     F.greatest(*probs).alias("confidence"), (F.col(y) == F.col(yhat)).alias("correct"),
                     *[F.col(p).alias(f"p_{n}") for p, n in zip(probs, names)])


def classifier_leaderboard(scores: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Rank models (one row each) by a metric, best first."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(metric).desc(), "model")
    return scores.withColumn("place", F.row_number().over(w))


def generalisation_gaps(scores: DataFrame, limit: float = 0.20) -> DataFrame:
    """Flag models whose in-sample score exceeds the cross-validated one by too much."""
    gap = F.col("r2") - F.col("cv_r2")
    return scores.select("model", "r2", "cv_r2", gap.alias("gap"), (gap > limit).alias("overfit"), (F.col("r2") < 0.5).alias("underfit"))


def label_cross_check(df: DataFrame, score: str, tier: str, rule: str, model: str, expected: str, confidence: str) -> DataFrame:
    """Agreement of rule, model and expected labels, confidence, and score order across tiers."""
    flags = df.agg(F.bool_and(F.col(rule) == F.col(expected)).alias("all_rule_match"),
                   F.bool_and(F.col(model) == F.col(expected)).alias("all_model_match"),
                   F.bool_and(F.col(rule) == F.col(model)).alias("all_agree"),
                   F.bool_and(F.col(confidence) >= 0.70).alias("all_confident"),
                   F.count_distinct(model).alias("distinct_labels"))
    tiers = df.groupBy(tier).agg(F.avg(score).alias("s"))
    w = Window.partitionBy(F.lit(1)).orderBy(tier)  # one row per tier
    order = tiers.select((F.col("s") > F.lag("s").over(w)).alias("up")).agg(F.bool_and("up").alias("ok")).scalar()
    return flags.withColumn("scores_ordered", order)


def cluster_accuracy(df: DataFrame, cluster: str, y: str, mapping: DataFrame) -> DataFrame:
    hit = df.join(mapping.select(F.col("cluster").alias(cluster), "label"), cluster)
    return hit.agg(F.avg((F.col("label") == F.col(y)).cast("double")).alias("accuracy"))


def with_probability_array(df: DataFrame, probs: Sequence[str]) -> DataFrame:
    return df.withColumn("p", F.array(*probs)).withColumn("top", V.argmax(F.col("p")))
