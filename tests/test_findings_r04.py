"""What a reviewer's run of round 4 found."""

import math

import numpy as np
import pytest

from tidemark.operators import density as KD


def kernel_rows():
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 3) if i % 7 else None, *map(float, rng.random(3) + 0.4 * (i % 3))) for i in range(600)]
    return [*rows, (900, 2, None, 0.5, 0.5), (901, None, 4.0, 4.0, 4.0), rows[8], rows[8]]


def full_sums(rows, n_classes, h):
    """(log scores, class) of every row by key, over all labelled rows."""
    points = [np.array([[v or 0.0 for v in r[2:]] for r in rows if r[1] == c]) for c in range(n_classes)]
    n, out = sum(map(len, points)), {}
    for r in rows:
        logs = []
        for p in points:
            e = -((p - np.array([v or 0.0 for v in r[2:]])) ** 2).sum(axis=1) / (2 * h * h)
            logs.append(e.max() + math.log(np.exp(e - e.max()).sum()) - p.shape[1] * (math.log(h) + math.log(2 * math.pi) / 2) - math.log(n))
        out[r[0]] = (logs, int(np.argmax(logs)))
    return out


@pytest.mark.parametrize("support", [40, 10_000])
def test_densities_stand_on_all_labelled_rows(spark, support):
    """Also where a task holds fewer labelled rows than there are."""
    rows, cols = kernel_rows(), ["a", "b", "c"]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double, c double").repartition(3)
    got = KD.kernel_scores(df, KD.kernel_trees(df, cols, "y", "k", support=support), cols, 0.2).collect()
    want = full_sums(rows, 3, 0.2)
    assert sorted(r.k for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert np.allclose(r.log_scores, want[r.k][0], atol=1e-6) and r.predicted == want[r.k][1]


def test_labelled_rows_beyond_the_old_bound_count(spark):
    """The class of a query follows from 24,000 rows of one class, not from the same number of both by a draw."""
    n = KD.SUPPORT + 4_000
    df = spark.range(n + 10).selectExpr("id AS k", f"CAST(id >= {n} AS INT) AS y", f"IF(id < {n}, id / {n}.0D, 0.5D) AS x")
    trees = KD.kernel_trees(df, ["x"], "y", "k")
    ask = spark.createDataFrame([(1, 0.5), (2, 0.1)], "q int, x double")
    got = {r.q: r for r in KD.kernel_scores(ask, trees, ["x"], 0.01).collect()}
    grid = np.arange(n) / n
    for q, x in ((1, 0.5), (2, 0.1)):
        e = -((grid - x) ** 2) / 0.0002
        assert got[q].log_scores[0] == pytest.approx(math.log(np.exp(e).sum()) - math.log(0.01) - math.log(2 * math.pi) / 2 - math.log(n + 10), abs=1e-6)


def test_kernel_sums_of_far_and_repeated_points():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.random((500, 3)), np.full((300, 3), 0.25), [[3e6, 0, 0], [-0.0, 0, 0], [0.0, 0, 0]]])
    x = np.concatenate([rng.random((50, 3)), [[3e6, 0.1, 0], [0.25, 0.25, 0.25]]])
    got, _ = KD.BallTree(points).log_sums(x, 0.2)
    for q, s in zip(x, got):
        e = -((points - q) ** 2).sum(axis=1) / 0.08
        assert s == pytest.approx(e.max() + math.log(np.exp(e - e.max()).sum()), abs=1e-6)


def test_predictions_follow_every_labelled_row(spark):
    """Class 1 lies only beside the last of the rows: a draw of some rows rarely has it, all rows always have."""
    df = spark.range(0, 300, 1, 4).selectExpr("id AS k", "CAST(id >= 297 AS INT) AS y", "IF(id < 297, id / 300.0D, 5.0D) AS x")
    got = KD.kernel_scores(df, KD.kernel_trees(df, ["x"], "y", "k", support=50), ["x"], 0.1).collect()
    assert len(got) == 300 and all(r.predicted == r.y for r in got)
    # Kernels that count are evaluated for every row, not only those of a draw.
    assert all(r.kernels > 50 for r in got)
    assert math.isclose(max(r.log_scores[1] for r in got), math.log(3 / 300) - math.log(0.1) - math.log(2 * math.pi) / 2, abs_tol=1e-6)


def test_all_kinds_are_compared(spark):
    """Every kind has its folds, its share held out, its classes and its confusion counts; the vote is over four models."""
    from tidemark.operators import ml as M

    rng = np.random.default_rng(6)
    rows = [(i, i % 2, float(rng.random() + 0.8 * (i % 2)), float(rng.random())) for i in range(160)]
    df = spark.createDataFrame(rows, "key long, cls int, a double, b double").coalesce(1)
    kinds = ["svm", "boosted", "tree", "density", "forest", "vote", "logistic"]
    got = M.compare_classifiers(df, ["a", "b"], "cls", "key", kinds, folds=2, n_classes=2).collect()
    assert {r.model for r in got} == set(kinds) and sorted(r.place for r in got) == list(range(1, 8))
    held = {sum(r.support) for r in got}
    assert len(held) == 1 and 16 <= held.pop() <= 48
    for r in got:
        (a, b), (c, d) = r.confusion
        assert r.valid_accuracy == pytest.approx((a + d) / (a + b + c + d)) and r.support == [a + b, c + d]
        assert r.class_f1 == pytest.approx([2 * a / (2 * a + b + c), 2 * d / (2 * d + b + c)]) and r.valid_f1 == pytest.approx(sum(r.class_f1) / 2)
        assert r.f1 > 0.6 and r.accuracy > 0.6 and 0 <= r.f1_spread < 0.5


def test_fold_scores_equal_the_class_scores(spark):
    from tidemark.operators import ml as M
    from tidemark.operators.evaluate import class_scores

    cells = {(0, 0): 5, (0, 1): 2, (1, 1): 7, (1, 2): 1, (None, 1): 3, (4, 0): 2}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "y int, yhat int, n long")
    want = class_scores(df).selectExpr("avg(f1)", "sum(hits) / sum(support)").first()
    f1, accuracy, by_class = M._scores_of(cells)
    assert (f1, accuracy) == pytest.approx(tuple(want)) and by_class[1] == pytest.approx(14 / 20)


def moons(spark, n=900, parts=3):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, float(rng.normal() + 2 * (i % 3 == 1)), float(rng.normal() + 2 * (i % 3 == 2))) for i in range(n)]
    return spark.createDataFrame(rows, "key long, cls int, a double, b double").repartition(parts, "key")


def test_perceptron_in_blocks_equals_the_plain_fit(spark, tmp_path, monkeypatch):
    """Weights after a few rounds are those of pyspark.ml, with parts that do not fill their last block."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from tidemark.operators import perceptron as PC

    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(moons(spark)).selectExpr("features", "cast(cls as double) AS label")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    want = MultilayerPerceptronClassifier(layers=[2, 7, 5, 3], maxIter=12, seed=42).fit(rows)
    for wide in (64, 1):
        monkeypatch.setattr(PC, "WIDE", wide)
        got = PC.fit_perceptron(rows, [2, 7, 5, 3], 12, 42)
        assert np.allclose(got.weights.toArray(), want.weights.toArray(), atol=1e-9)
    further = MultilayerPerceptronClassifier(layers=[2, 7, 5, 3], maxIter=4, seed=42).setInitialWeights(want.weights).fit(rows)
    assert np.allclose(PC.fit_perceptron(rows, [2, 7, 5, 3], 4, 42, want.weights).weights.toArray(), further.weights.toArray(), atol=1e-9)


def test_large_training_sets_take_the_blocks(spark, monkeypatch):
    from tidemark.operators import ml as M

    df, cols = moons(spark), ["a", "b"]
    plain = M.train_until_best(df.where("key % 5 > 0"), df.where("key % 5 = 0"), cols, "cls", 3, hidden=[6], slice_rounds=5, slices=3)[1].collect()
    used = []
    fit = M.fit_perceptron
    monkeypatch.setattr(M, "fit_perceptron", lambda rows, *a: used.append(rows.count()) or fit(rows, *a))
    monkeypatch.setattr(M, "EVEN_ROWS", 10)
    blocks = M.train_until_best(df.where("key % 5 > 0"), df.where("key % 5 = 0"), cols, "cls", 3, hidden=[6], slice_rounds=5, slices=3)[1].collect()
    assert used == [720] * len(blocks) and [r.slice for r in blocks] == [r.slice for r in plain]
    # Rows are dealt anew, so blocks and with them the loss differ a little.
    assert [r.loss for r in blocks] == pytest.approx([r.loss for r in plain], abs=0.05)
    monkeypatch.setattr(M, "classifier_stage", lambda kind, n, k: M.MultilayerPerceptronClassifier(layers=[n, 6, k], maxIter=15, seed=42))
    model = M.train_classifier(df, cols, "cls", "mlp", 3)
    assert used[-1] == 900 and M.predict(model, df, "cls").where("prediction = label").count() > 700


def test_trained_perceptron_in_blocks_sees_all_copies(spark, monkeypatch):
    """Rare classes are still oversampled by whole copies, and every row and copy is trained on."""
    from tidemark.operators import ml as M

    df = moons(spark, 600).where("cls > 0 OR key % 9 = 0")
    counts = {r[0]: r[1] for r in df.groupBy("cls").count().collect()}
    n = sum(counts.values())
    used, fit = [], M.fit_perceptron
    monkeypatch.setattr(M, "fit_perceptron", lambda rows, *a: used.append(rows.count()) or fit(rows, *a))
    monkeypatch.setattr(M, "EVEN_ROWS", 10)
    monkeypatch.setattr(M, "classifier_stage", lambda kind, f, k: M.MultilayerPerceptronClassifier(layers=[f, 6, k], maxIter=15, seed=42))
    model = M.train_classifier(df, ["a", "b"], "cls", "mlp", 3)
    assert used == [sum(c * max(1, round(n / (3 * c))) for c in counts.values())] and used[0] > n
    assert M.predict(model, df, "cls").where("prediction = label").count() > 0.7 * n
