"""What a reviewer's run on larger tables found."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import cleaning as K
from tidemark.operators import joins as J
from tidemark.operators import ml as M
from tidemark.operators import panel as PN


def test_margin_classifier_predicts(spark):
    """Its predictions can be computed in tasks, and each is the class of the greatest margin."""
    rows = [(i, i % 3, 4.0 * (i % 3 == 1) + (i * 7 % 10) / 20, 4.0 * (i % 3 == 2) + (i * 3 % 10) / 20) for i in range(90)]
    df = spark.createDataFrame(rows, "key long, cls int, a double, b double").coalesce(1)
    model = M.train_classifier(df, ["a", "b"], "cls", "svm", 3)
    got = M.predict(model, df, "cls").select("cls", "prediction", "features", "rawPrediction").collect()
    assert len(got) == 90 and all(r.prediction == r.cls for r in got)
    for r in got:
        want = [float(m.coefficients.dot(r.features)) + m.intercept for m in model.stages[-1].models]
        assert list(r.rawPrediction) == pytest.approx(want) and want.index(max(want)) == r.prediction


def test_many_text_columns_are_cleaned_like_one(spark):
    odd = ["12_", None, "", "-3.5", "1.2.3", "__10000__", "1e5", "NaN", " 7 ", "5-", "-", "4٣"]
    cols = [f"c{i}" for i in range(len(odd))]
    df = spark.createDataFrame([(k, *odd[k:], *odd[:k]) for k in range(len(odd))], ", ".join(["k int", *[f"{c} string" for c in cols]]))
    got = K.clean_numeric_columns(df, [*cols, "absent"])
    want = df.select("k", *[C.clean_numeric(F.col(c)).alias(c) for c in cols])
    assert got.columns == df.columns and sorted(got.collect()) == sorted(want.collect())
    # One cleaning expression, however many columns: the generated stage stays short.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_records_are_parsed_once_and_texts_can_go(spark):
    rows = [(f"CUS_{i % 4}", i, *[str(i + j) for j in range(len(rules.BANK_NUMERIC))], "2 Years and 3 Months", "Good", "x", "Doctor") for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(["Customer_ID string", "n int", *[f"{c} string" for c in rules.BANK_NUMERIC], *[f"{c} string" for c in K.RECORD_TEXTS]]))
    full = K.clean_bank_records(df, ["n"])
    slim = K.clean_bank_records(df, ["n"], texts=False)
    assert full.columns == [*df.columns, "Credit_History_Months", "Credit_Mix_Score", "Spending_Behaviour_Score", "Occupation_Stability_Score"]
    assert slim.columns == [c for c in full.columns if c not in K.RECORD_TEXTS]
    assert sorted(full.drop(*K.RECORD_TEXTS).collect()) == sorted(slim.collect())


def test_panel_lookups_keep_only_asked_days(spark):
    """Look-back figures equal plain loops over a key's days, and running sums are kept only where a date asks for them."""
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=3 * i) for i in range(900)]
    price = {(k, d): 100.0 + k + 10 * math.sin(i / 7 + k) + i / 50 for k in (1, 2) for i, d in enumerate(days) if (i + k) % 5}
    series = spark.createDataFrame([(k, d, v) for (k, d), v in price.items()], "key long, d date, v double")
    index = spark.createDataFrame([(d, 50.0 + i % 11) for i, d in enumerate(days)], "d date, v double")
    asked = [(1, dt.date(2019, 6, 30)), (2, dt.date(2019, 6, 30)), (2, dt.date(2019, 9, 30))]
    points = spark.createDataFrame(asked, "key long, as_of date")
    daily = PN.trailing_daily(series, index, points)
    assert "last(sums" not in daily._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.key, r.as_of): r for r in daily.collect()}
    assert set(got) == set(asked)
    for key, as_of in asked:
        own = sorted((d, v) for (k, d), v in price.items() if k == key and d <= as_of)
        logs = [math.log(b / a) for (e, a), (_, b) in zip(own, own[1:]) if e >= as_of - dt.timedelta(days=400)]
        assert got[key, as_of].vol_1yr == pytest.approx(statistics.stdev(logs) * math.sqrt(252))
    months = PN.month_end_close(series)
    closes = {(r.key, r.d): r.v for r in months.collect()}
    falls = {(r.key, r.as_of): r.max_drawdown for r in PN.trailing_drawdown(months, points).collect()}
    assert set(falls) == set(asked)
    for key, as_of in asked:
        own = [v for d, v in sorted((d, v) for (k, d), v in closes.items() if k == key and as_of.replace(year=as_of.year - 3) <= d <= as_of)]
        assert falls[key, as_of] == pytest.approx(min(v / max(own[:i + 1]) - 1 for i, v in enumerate(own)))


def test_fill_sorts_once_and_cuts_only_large_keys(spark):
    """Large keys by chunk and small ones at once give the plain fill; rows without a key or a chunk are left out as before."""
    rows = [(None if k == 4 else k, None if i == 0 and k == 3 else i, float(i) if (i * 7 + k) % 4 == 0 else None, float(k) if i == 20 + k else None)
            for k in range(5) for i in range(40 if k else 90)]
    df = spark.createDataFrame(rows, "k int, o int, x double, y double")
    chunk = F.floor(F.col("o") / 8)
    want = []
    for k in range(4):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0))
        for i, r in enumerate(own):
            find = lambda c: next((q[c] for q in own[i::-1] if q[c] is not None), next((q[c] for q in own if q[c] is not None), None))  # noqa: E731, B023
            if r[1] is not None:
                want.append((k, r[1], find(2), find(3)))
    for hot in (0, 50, 1000):
        got = K.fill_within_key(df, ["x", "y"], "k", ["o"], chunk, hot=hot)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # One sort for the small keys, two for the large ones' rows and chunk edges; no descending order.
    assert "DESC" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_training_rows_are_dealt_evenly(spark):
    few = spark.range(0, 1000, 1, 3)
    assert M.dealt_evenly(few).rdd.getNumPartitions() == 3
    cores = spark.sparkContext.defaultParallelism
    many = M.dealt_evenly(spark.range(0, M.EVEN_ROWS * cores, 1, cores + 1))
    sizes = many.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) == cores and sum(sizes) == M.EVEN_ROWS * cores and max(sizes) - min(sizes) <= cores + 1


def test_price_without_a_date_stands_before_all_days(spark):
    day = dt.date(2019, 1, 31)
    rows = [(1, None, 90.0), *[(1, day - dt.timedelta(days=i), 100.0 + i % 3) for i in range(300)]]
    series = spark.createDataFrame(rows, "key long, d date, v double")
    index = spark.createDataFrame([(d, 50.0) for _, d, _ in rows if d], "d date, v double")
    got = PN.trailing_daily(series, index, spark.createDataFrame([(1, day)], "key long, as_of date")).collect()
    # 301 rows and 300 returns from the row before, less the first dated one's, as the row without a date ends the look-back.
    own = [v for _, d, v in sorted((r for r in rows if r[1]), key=lambda r: r[1])]
    logs = [math.log(b / a) for a, b in zip(own, own[1:])]
    assert got[0].vol_1yr == pytest.approx(statistics.stdev(logs) * math.sqrt(252))


def test_texts_are_grouped_by_their_hash_first(spark):
    df = spark.createDataFrame([("fund a", 1, None), ("fund a", 2, 5.0), (None, 3, 7.0), ("fund b", 1, 1.0), (None, 1, 8.0)], "name string, at int, v double")
    for pick, want in ((J.latest_per_key, {("fund a", 2, 5.0), (None, 3, 7.0), ("fund b", 1, 1.0)}), (J.first_per_key, {("fund a", 1, None), (None, 1, 8.0), ("fund b", 1, 1.0)})):
        out = pick(df, ["name"], ["at"])
        assert out.columns == ["name", "at", "v"] and set(map(tuple, out.collect())) == want
        assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()
    new = J.newest_values(df, ["name"], ["at"], ["v"])
    assert new.columns == ["name", "v"] and {(r.name, r.v.value) for r in new.collect()} == {("fund a", 5.0), (None, 7.0), ("fund b", 1.0)}
