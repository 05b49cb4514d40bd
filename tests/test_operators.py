"""Hand-computed edge cases, invariants and brute-force comparisons on small fixtures."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import bands as B
from tidemark.operators import catalogue as G
from tidemark.operators import cleaning as K
from tidemark.operators import evaluate as E
from tidemark.operators import explain as X
from tidemark.operators import joins as J
from tidemark.operators import ml as M
from tidemark.operators import privacy as V
from tidemark.operators import recommend as R
from tidemark.operators import series as W
from tidemark.operators import stats as T
from tidemark.operators.quantiles import exact_quantiles, running_totals
from tidemark.sources import readers
from tidemark.streaming.dedupe import run_stateful, ttl_dedupe, ttl_dedupe_stream

DAY = dt.date(2020, 1, 1)






def scalar(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("28_", 28.0), ("-500", -500.0), ("", None), ("_______", None), ("1.2.3", None),
                                       ("!@9#%8", 98.0), (None, None)])
def test_clean_numeric(spark, text, want):
    assert scalar(spark, C.clean_numeric(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("22 Years and 9 Months", 273.0), ("0 Years and 0 Months", None), ("NA", None), ("5 months", 5.0)])
def test_duration(spark, text, want):
    assert scalar(spark, C.parse_duration_months(F.lit(text))) == want


def test_names_and_keywords(spark):
    assert scalar(spark, C.normalise_name(F.lit("ABC Fund – Direct Plan - Growth"))) == "abc fund"
    assert scalar(spark, G.keyword_tier(F.lit("Other Scheme - Gold ETF"))) == "Medium"
    assert scalar(spark, G.keyword_tier(F.lit("Equity Scheme - Large & Mid Cap Fund"))) == "High"
    assert scalar(spark, G.keyword_tier(F.lit(None).cast("string"))) is None
    assert scalar(spark, G.keyword_tier(F.lit("Unknown"))) is None


@pytest.mark.parametrize("value", [0.625, 0.475, 0.125, 0.1, 0.995, 1.005, 2.675, 7.5, 0.0])
def test_fixed2_matches_printf(spark, value):
    assert scalar(spark, C.fixed2(F.lit(value))) == f"{value:.2f}"


# --- gap filling and quantiles: bucketed paths equal the plain ones ---------

def test_chunked_fill_equals_plain_fill(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 3 + ["a", "b"]), i, rnd.choice([None, float(i)]), rnd.choice([None, None, float(i)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, x double, y double")
    plain = K.fill_within_key(df, ["x", "y"], "k", ["o"]).orderBy("o").collect()
    chunked = K.fill_within_key(df, ["x", "y"], "k", ["o"], F.floor(F.col("o") / 16)).orderBy("o").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in chunked]


@pytest.mark.parametrize("small, steps", [(4096, 4096), (7, 4), (1, 2)])
def test_selected_quantiles_equal_numpy(spark, monkeypatch, small, steps):
    """Ties, a hot group, an empty and a one-row one, huge and tiny values; small limits force many levels."""
    from tidemark.operators import quantiles as Q

    monkeypatch.setattr(Q, "SMALL", small)
    monkeypatch.setattr(Q, "STEPS", steps)
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else "cold", rnd.choice([rnd.gauss(0, 1), 1.0, 2.0, 0.0, -0.0, 1e300 * rnd.random(), -1e-300, None])) for i in range(900)]
    rows += [("one", 7.0), (None, 1.5), (None, 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.01, 0.2, 0.5, 0.875, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["v"], probs, ["g"]).collect()}
    assert set(got) == {"hot", "cold", "one", None}
    for g, (n, q) in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert n == len(values) and np.allclose(q, np.quantile(values, probs), rtol=1e-12, atol=1e-12), g
    both = exact_quantiles(df.withColumn("w", -F.col("v")), ["v", "w"], [0.25]).collect()
    values = np.array([v for _, v in rows if v is not None])
    assert {r.feature: r.q[0] for r in both} == pytest.approx({"v": np.quantile(values, 0.25), "w": np.quantile(-values, 0.25)})
    assert exact_quantiles(df.limit(0), ["v"], probs).count() == 0


def test_quantiles_of_not_numbers_and_infinities(spark):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (2.0,)]
    got = exact_quantiles(spark.createDataFrame(rows, "v double"), ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()["q"]
    assert got[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and math.isnan(got[4])


def test_running_totals_with_a_hot_group_and_nulls(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a"] * 8 + ["b", None]), rnd.choice([None, 5, *range(300)]), 1) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    for parts in (None, 1, 9):
        got = {(r.g, r.v): (r.w, r.cum_w, r.tot_w) for r in running_totals(df, ["g"], "v", ["w"], parts).collect()}
        low = lambda v: -1 if v is None else v
        want = {(g, v): (sum(x == (g, v, 1) for x in rows), sum(x[0] == g and low(x[1]) <= low(v) for x in rows),
                         sum(x[0] == g for x in rows)) for g, v, _ in set(rows)}
        assert got == want
    assert running_totals(df.limit(0), [], "v", ["w"]).count() == 0
    assert running_totals(df, [], "v", ["w"], 5).agg(F.max("cum_w"), F.min("tot_w")).first() == (2000, 2000)


# --- price series -----------------------------------------------------------

def series(spark, values, key=1, start=DAY):
    return spark.createDataFrame([(key, start + dt.timedelta(days=d), float(v)) for d, v in values], "key long, d date, v double")


def test_constant_price_hits_floors(spark):
    s = series(spark, [(i, 10) for i in range(800)])
    m = W.price_metrics(s, DAY + dt.timedelta(days=799)).first()
    assert m["vol_1yr"] == 0.002 and m["cagr_1yr"] == 0 and m["max_drawdown"] == 0
    assert m["sharpe_1yr"] == -10 and m["recovery_time"] is None and m["record_count"] == 800
    assert m["consistency_1y"] == 0.0


def test_twenty_row_rule(spark):
    ref = DAY + dt.timedelta(days=100)
    for n, has in ((19, False), (20, True)):
        s = series(spark, [(i, 10 + i % 3) for i in range(n)])
        assert (W.price_metrics(s, ref).first()["vol_1yr"] is not None) is has


def test_two_drawdowns_one_recovers(spark):
    s = series(spark, [(0, 100), (10, 94), (20, 96), (40, 98), (50, 100), (60, 80), (70, 85)])
    m = W.price_metrics(s, DAY + dt.timedelta(days=70)).first()
    assert m["recovery_time"] == 30 and abs(m["max_drawdown"] + 0.2) < 1e-12


def test_price_after_reference_and_bad_price(spark):
    late = series(spark, [(0, 10), (5, 11), (20, 99)])
    m = W.price_metrics(late, DAY + dt.timedelta(days=10)).first()
    assert m["nav_recency"] == 5 and m["record_count"] == 2
    assert W.price_metrics(series(spark, [(0, 10), (5, 0)]), DAY + dt.timedelta(days=10)).count() == 0
    assert W.price_metrics(series(spark, [(20, 10)]), DAY + dt.timedelta(days=10)).count() == 0


def test_daily_close_bounds_rows_per_day(spark):
    raw = spark.createDataFrame([(1, DAY, 5.0, i) for i in range(50)] + [(1, DAY, 7.0, 99)], "key long, d date, v double, seq int")
    assert [tuple(r) for r in readers.daily_close(raw, ["seq"]).collect()] == [(1, DAY, 7.0)]


# --- labels and bands -------------------------------------------------------

def test_threshold_gap_is_interpolated(spark):
    df = spark.createDataFrame([("Low", 1.0), ("High", 3.0), ("Very_High", 4.0)], "risk_label string, risk_score double")
    assert B.bin_thresholds(df).first()["thresholds"] == [1.0, 2.0, 3.0, 4.0]
    empty = df.where("false")
    assert np.allclose(B.bin_thresholds(empty).first()["thresholds"], np.linspace(0, 1, 4))


def test_small_peer_groups_get_no_band(spark):
    funds = spark.createDataFrame([(i, "Equity Scheme - Small Cap Fund" if i < 5 else "Debt Scheme - Liquid Fund") for i in range(9)], "code long, category string")
    m = spark.createDataFrame([(i, 0.1 * (i + 1), -0.05 * (i + 1)) for i in range(9)], "key long, vol_1yr double, max_drawdown double")
    got = {r["code"]: r["band"] for r in B.fund_risk_bands(funds, m).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and set(got.values()) <= {"High", "Very_High"}


def test_unseen_label_takes_fallback_code(spark):
    codes = B.label_codes(spark.createDataFrame([("High",), ("Low",), ("Medium",)], "l string"), "l")
    out = B.label_encode(spark.createDataFrame([("Low",), ("Odd",)], "l string"), "l", "c", codes)
    assert {r["l"]: r["c"] for r in out.collect()} == {"Low": 1, "Odd": 2}


# --- recommendations --------------------------------------------------------

@pytest.fixture(scope="module")
def funds(spark):
    rnd = random.Random(11)
    cats = ["Equity Scheme - Small Cap Fund", "Equity Scheme - Mid Cap Fund", "Equity Scheme - Large Cap Fund", "Hybrid Scheme - Balanced Advantage",
            "Debt Scheme - Liquid Fund", "Debt Scheme - Gilt Fund", "Equity Scheme - Value Fund", "Hybrid Scheme - Arbitrage Fund", "Equity Scheme - ELSS"]
    rows = [(i, f"Fund {i}", f"AMC{i % 7}", cats[i % 9], float(rnd.randint(1, 9999)), 10.0, DAY + dt.timedelta(days=rnd.randint(0, 99)), "Open Ended",
             rnd.choice([0, 1, 2]), rnd.choice([None, rnd.random() * 20]), rnd.choice([None, rnd.random() * 20]), rnd.choice([None, rnd.random() * 20]), i % 2)
            for i in range(300)]
    df = spark.createDataFrame(rows, "code long, name string, amc string, category string, aum double, price double, latest_date date, scheme_type string, "
                                     "quality_mode int, excess_return_3y double, excess_return_5y double, fund_return_3y double, benchmarked int")
    return df.withColumn("risk_tier", G.keyword_tier(F.col("category"))).cache()


def test_recommend_respects_caps(funds):
    for n in (3, 5, 8):
        rows = R.recommend(funds, n).collect()
        for tier in rules.TIERS:
            mine = [r for r in rows if r["for_tier"] == tier]
            assert 0 < len(mine) <= n
            for col, cap in (("category", 2), ("amc", max(1, math.ceil(0.4 * n)))):
                counts = {}
                for r in mine:
                    counts[r[col]] = counts.get(r[col], 0) + 1
                assert max(counts.values()) <= cap


def test_empty_tier_borrows_the_lower_one(funds):
    rows = R.recommend(funds.where("risk_tier <> 'High'"), 5, tiers=["High"]).collect()
    assert rows and all(r["risk_tier"] == "Medium" and r["for_tier"] == "High" for r in rows)


def test_pinned_styles_come_first(funds):
    rows = [r for r in R.recommend(funds, 5, tiers=["Very_High"]).collect()]
    by_rank = sorted(rows, key=lambda r: r["rank"])
    assert by_rank[0]["style"] == "growth"


def test_allocation_invariants(funds):
    rows = R.allocate(R.recommend(funds, 6)).collect()
    for tier in rules.TIERS:
        mine = [r for r in rows if r["for_tier"] == tier]
        assert abs(sum(r["weight"] for r in mine) - 1) < 0.01
        assert abs(sum(r["amount"] for r in mine) - 100_000) < 10
        share = {}
        for r in mine:
            share[r["amc"]] = share.get(r["amc"], 0) + r["weight"]
        assert not mine[0]["cap_met"] or max(share.values()) <= 0.41


def test_core_satellite_edges(funds):
    rows = R.core_satellite(funds).collect()
    low = {r["bracket"]: r["bracket_pct"] for r in rows if r["tier"] == "Very_Low"}
    high = {r["bracket"]: r["bracket_pct"] for r in rows if r["tier"] == "Very_High"}
    mid = {r["bracket"]: r["bracket_pct"] for r in rows if r["tier"] == "Medium"}
    assert low == {"Core": 80.0, "Growth": 20.0} and high == {"Core": 80.0, "Stability": 20.0}
    assert mid == {"Core": 60.0, "Stability": 20.0, "Growth": 20.0}


def test_horizon_weights_sum_to_one(funds):
    sums = R.recommend_by_horizon(funds).groupBy("tier", "horizon_years").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 20 and all(0.95 <= r["w"] <= 1.05 for r in sums)


# --- drift, evaluation, text ------------------------------------------------

def test_psi_identical_and_shifted(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random(500)
    base = spark.createDataFrame([(float(v), 1.0) for v in x], "a double, c double")
    same = {r["feature"]: r["psi"] for r in T.psi(base, base, ["a", "c"]).collect()}
    assert same["a"] == 0 and same["c"] == 0
    moved = base.withColumn("a", F.col("a") * 0.5)
    got = {r["feature"]: r["psi"] for r in T.psi(base, moved, ["a"]).collect()}["a"]
    cuts = np.unique(np.percentile(x, np.linspace(0, 100, 11)))
    b, c = np.histogram(x, cuts)[0], np.histogram(x * 0.5, cuts)[0]
    p = (b + 1e-8) / (b.sum() + 1e-7)
    q = (c + 1e-8) / (c.sum() + 1e-7)
    assert abs(got - float(np.sum((q - p) * np.log(q / p)))) < 1e-9
    few = T.psi(base.limit(5), base, ["a"]).first()["psi"]
    assert few is None


def test_report_with_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "y int, yhat int")
    rows = {r["scope"]: r for r in E.classification_report(df).collect()}
    assert rows["1"]["f1"] == 0 and rows["1"]["precision"] == 0 and abs(rows["accuracy"]["f1"] - 1 / 3) < 1e-12


REDACTED = [
    ("paid Ravi Kumar 20 units", "paid 20 units"),
    ("owes ₹1,20,000 now", "owes ₹[amount] now"),
    ("owes Rs. 500 or rs900", "owes Rs.[amount] or Rs.[amount]"),
    ("call 9876543210 today", "call [phone] today"),
    ("id 123456789012 given", "id [id] given"),
    ("mail a.b@c.example please", "mail [email] please"),
    ("one,  two ,three", "one two three"),
    (" , ", X.DEFAULT_CONTEXT),
]


def test_redaction_of_each_kind(spark):
    df = spark.createDataFrame(REDACTED, "text string, want string").withColumn("got", X.redact_pii(F.col("text")))
    assert [tuple(r) for r in df.filter("got is distinct from want").collect()] == []


@pytest.mark.parametrize("raw,want", [('```json\n{"summary": "a", "rationale": "b"}\n```', "a\n\nb"), ('{"x": 1}', '{"x": 1}'), ("{broken", "{broken"), ("plain", "plain")])
def test_parse_answer(spark, raw, want):
    assert scalar(spark, X.parse_json_answer(F.lit(raw))) == want


def test_validation_catches_wrong_number(spark):
    df = spark.createDataFrame([("Alpha Fund is a stable debt pick, NAV ₹50.00", 50.0), ("Alpha Fund is a stable debt pick, NAV ₹90.00", 50.0)], "t string, p double")
    df = df.withColumns({"tier": F.lit("Low"), "name": F.lit("Alpha Fund"), "cat": F.lit("Debt")})
    rows = X.with_validation(df, "t", "tier", "name", "cat", "p").orderBy("t").collect()
    assert [r["price_plausible"] for r in rows] == [True, False] and rows[0]["passed"]


# --- privacy and de-duplication ---------------------------------------------

def test_opposing_vector_counts_half(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.2]), (3, 1, [-1.0, 0.0]), (4, 1, [0.0, 0.0])], "id int, n int, vec array<double>")
    got = V.robust_vector_mean(df, "vec", "n").first()["mean"]
    assert np.allclose(got, [(1 + 1 - 0.5) / 3.5, 0.2 / 3.5])


def test_ttl_chain_against_a_loop(spark):
    rnd = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else f"k{i % 5}", base + dt.timedelta(seconds=rnd.randint(0, 90_000)), i) for i in range(600)]
    rows += [("edge", base, 1000), ("edge", base + dt.timedelta(minutes=30), 1001), ("edge", base + dt.timedelta(minutes=60), 1002),
             ("edge", base + dt.timedelta(minutes=61), 1003), ("edge", base + dt.timedelta(minutes=120), 1004)]
    got = {r["i"]: r["fresh"] for r in ttl_dedupe(spark.createDataFrame(rows, "k string, ts timestamp, i int")).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        stored = None
        for _, ts, i in sorted(r for r in rows if r[0] == key):
            same = stored is not None and ts == stored
            if stored is None or (ts - stored).total_seconds() >= 3600:
                stored, same = ts, True
            want[i] = same
    assert got == want


def test_ttl_stream_marks_what_the_batch_marks(spark, tmp_path):
    """Out of order, with a hot key, equal times, null columns, and a restart between the lots."""
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "b", None]), start + dt.timedelta(seconds=rng.randrange(0, 40_000)), k, None if k % 5 else "x")
            for k in range(400)]
    rows += [(*rows[3][:2], 9_000, "same time"), rows[7]]
    schema, folder = "k string, ts timestamp, i int, note string", str(tmp_path / "in")
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(0, 3_500)))
    end = [("end", start + dt.timedelta(days=9), -1, None)]
    for lot in (late[:150], late[150:], end):
        spark.createDataFrame(lot, schema).write.mode("append").parquet(folder)
        arrivals = spark.readStream.schema(schema).parquet(folder)
        run_stateful(ttl_dedupe_stream(arrivals), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["k", "ts", "i", "note", "fresh"]
    stored, want = {}, []
    for k, ts, i, note in sorted(rows, key=lambda r: r[1]):
        if k not in stored or ts >= stored[k] + dt.timedelta(hours=1):
            stored[k] = ts
        want.append((k, ts, i, note, ts == stored[k]))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_kernel_scores_equal_full_sums(spark):
    """Every row is a query; log scores equal the full sums, and clustered data need few of the kernels."""
    from tidemark.operators import density as KD

    rng = np.random.default_rng(4)
    centres = rng.random((12, 4)) * 9
    x = centres[rng.integers(0, 12, 1500)] + 0.05 * rng.normal(size=(1500, 4))
    rows = [(i, int(i % 3) if i % 50 else None, *map(float, v)) for i, v in enumerate(x)]
    rows += [(5000, 1, None, 0.0, 0.0, 0.0), (5001, None, 9.0, 9.0, 9.0, 9.0), rows[7]]
    df = spark.createDataFrame(rows, "k long, c int, x0 double, x1 double, x2 double, x3 double").repartition(3)
    cols = ["x0", "x1", "x2", "x3"]
    got = KD.kernel_scores(df, KD.kernel_trees(df, cols, "c", "k"), cols, 0.2).collect()
    assert len(got) == len(rows) and df.columns == list(got[0].asDict())[:6]
    points = {c: np.array([[v or 0.0 for v in r[2:]] for r in rows if r[1] == c]) for c in range(3)}
    n = sum(map(len, points.values()))
    for r in got:
        q = np.array([r[c] or 0.0 for c in cols])
        want = []
        for c in range(3):
            e = -((points[c] - q) ** 2).sum(axis=1) / 0.08
            want.append(e.max() + np.log(np.exp(e - e.max()).sum()) - 4 * math.log(0.2) - 2 * math.log(2 * math.pi) + math.log(1 / n))
        assert np.allclose(r.log_scores, want, atol=1e-6) and r.predicted == int(np.argmax(want))
    assert np.mean([r.kernels for r in got]) < 0.5 * n
    few = KD.kernel_trees(df, cols, "c", "k", support=60)
    assert sum(len(t.points) for _, t in few.values()) <= 60 and len(few) == 3
    none = KD.kernel_scores(df, {}, cols).select("predicted", F.size("log_scores")).distinct().collect()
    assert [tuple(r) for r in none] == [(None, 0)]


def test_epsilon_bands(spark):
    steps = spark.createDataFrame([(5,), (22,)], "steps int")
    eps = {r["steps"]: r["epsilon"] for r in V.epsilon_for_steps(steps).collect()}
    assert 0 < eps[5] < eps[22] < 200


# --- sources ----------------------------------------------------------------

def test_index_files_overlap_first_wins(spark, tmp_path):
    for name, body in (("a.csv", '"IndexName","Date","Total Returns Index"\n"X","11 Mar 2022","100"\n"X","10 Mar 2022","90"\n'),
                       ("b.csv", '"IndexName","Date","Total Returns Index"\n"X","11 Mar 2022","555"\n"X","14 Mar 2022","110"\n"X","bad","1"\n')):
        (tmp_path / name).write_text(body)
    out = readers.read_index_series(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]).orderBy("d").collect()
    assert [(str(r["d"]), r["v"]) for r in out] == [("2022-03-10", 90.0), ("2022-03-11", 100.0), ("2022-03-14", 110.0)]
    assert out[0]["ret"] is None and abs(out[2]["ret"] - 0.1) < 1e-12


def test_find_column_and_types(spark):
    assert readers.find_column(["Name", " Date "], [r"^date$"]) == " Date "
    assert readers.find_column(["Name"], [r"^date$"]) is None
    assert T.dtype_summary(spark.range(1)) == [("bigint", 1)]


def test_last_row_versus_last_value(spark):
    df = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, None, "y")], "k string, o int, v double, s string")
    assert tuple(J.latest_per_key(df, ["k"], ["o"]).select("v", "s").first()) == (None, "y")
    assert tuple(J.last_non_null_per_key(df, "k", ["o"], ["v", "s"]).select("v", "s").first()) == (1.0, "y")


def plain_information(x, y, k):
    from tidemark.operators import neighbours as N

    def psi(n):
        return -N.EULER + sum(1 / q for q in range(1, n))

    d = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1] - N.HAIR
    counts = [np.maximum((abs(v[:, None] - v) < r[:, None]).sum(1), 1) for v in (x, y)]
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(int(a)) + psi(int(b)) for a, b in zip(*counts)]))


@pytest.mark.parametrize("cell_rows", [16, 1_024])
def test_neighbour_information_equals_all_pairs(spark, cell_rows):
    """Ties, a constant, nulls, and cells so small that most points visit others."""
    from tidemark.operators import neighbours as N

    rng = np.random.default_rng(1)
    y = rng.normal(size=300)
    cols = {"a": y + rng.normal(size=300), "b": rng.normal(size=300), "c": np.round(y), "d": np.ones(300), "e": rng.exponential(size=300) ** 4}
    rows = [(f"k{i}", float(y[i]), *(float(v[i]) for v in cols.values())) for i in range(300)]
    rows += [("n1", None, *[1.0] * 5), ("n2", 0.5, None, 1.0, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, y double, a double, b double, c double, d double, e double")
    got = {r.feature: r.mi for r in N.neighbour_information(df, "y", list(cols), "k", 4, cell_rows).collect()}
    z = N.standardised(df, ["y", *cols], "k").toPandas()
    for c in cols:
        some = z.dropna(subset=["y", c])
        assert got[c] == pytest.approx(plain_information(some[c].to_numpy(), some["y"].to_numpy(), 4), abs=1e-9), c
    with pytest.raises(ValueError):
        N.neighbour_information(df.limit(3), "y", ["a"], "k", 4)


def test_digamma(spark):
    from tidemark.operators.neighbours import EULER, digamma

    got = [r[0] for r in spark.range(1, 200).orderBy("id").select(digamma(F.col("id"))).collect()]
    assert np.allclose(got, -EULER + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 199))]), atol=1e-13)


def test_factorisation_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.maximum(rng.random((120, 2)) @ rng.random((2, 6)) + 0.02 * rng.normal(size=(120, 6)), 0)
    df = spark.createDataFrame([(float(i), *map(float, r)) for i, r in enumerate(x)], "i double, " + ", ".join(f"f{j} double" for j in range(6))).repartition(3)
    cols = [f"f{j}" for j in range(6)]
    h = M.fit_nmf(df, cols, 2, rounds=150, steps=20)
    w, a, b = np.ones((120, 2)), x @ h.T, h @ h.T
    for _ in range(2_000):
        w = w * a / (w @ b + 1e-12)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    best = np.linalg.norm(x - (u[:, :2] * s[:2]) @ v[:2])
    assert (h >= 0).all() and np.linalg.norm(x - w @ h) < 1.05 * best
    assert np.allclose(np.linalg.norm(w, axis=0), np.linalg.norm(h, axis=1), rtol=1e-2)  # the size is split evenly
    with pytest.raises(ValueError):
        M.fit_nmf(df.withColumn("f0", F.lit(-1.0)), cols, 2)


def plain_silhouette(x, own):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(own):
        same = (own == c) & (np.arange(len(own)) != i)
        b = min(d[i, own == o].mean() for o in set(own) - {c})
        out.append(0.0 if not same.any() else (b - d[i, same].mean()) / max(d[i, same].mean(), b))
    return np.array(out)


def test_many_starts_equal_one_by_one(spark):
    import hashlib

    from tidemark.operators import clustering as CL

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) + rng.integers(0, 4, 90)[:, None] * 3.0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None)], "k long, v array<double>").repartition(4)
    runs = CL.fit_starts(df, "v", "k", [2, 4], range(6), rounds=40)
    assert len(runs) == 12
    for r in runs:
        order = sorted(range(90), key=lambda i: (hashlib.md5(f"{i}|{r.number}".encode()).hexdigest(), i))
        c = x[order[: r.k]]
        for _ in range(40):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(r.k)])
        cost = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert np.allclose(r.centres, c) and r.cost == pytest.approx(cost)
    best = CL.best_start(runs, 4)
    assert best.cost == min(r.cost for r in runs if r.k == 4)
    got = {r.k: r.cluster for r in CL.assign_clusters(best, df, "v").collect()}
    own = ((x[:, None] - best.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert got == {**{i: int(c) for i, c in enumerate(own)}, 900: None}
    table = {r.k: r for r in M.elbow_table(df.where("v IS NOT NULL"), "v", "k", [2, 4], range(6)).collect()}
    assert table[4].inertia == pytest.approx(best.cost) and table[4].silhouette == pytest.approx(plain_silhouette(x, own).mean()) and table[4].error == 0


def test_silhouette_with_all_and_with_some_references(spark):
    from tidemark.operators import clustering as CL

    rng = np.random.default_rng(6)
    own = np.array([0] * 150 + [1] * 60 + [2])
    x = rng.normal(size=(211, 4)) + own[:, None] * 2.0
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(own, x))] + [(999, None, [0.0] * 4), (998, 1, None)],
                               "k long, c int, v array<double>").repartition(3)
    want = plain_silhouette(x, own)
    exact = {r.scope: (r.silhouette, r.n, r.error) for r in CL.silhouette(df, "c", "v", "k").collect()}
    assert exact["all"] == (pytest.approx(want.mean()), 211, 0.0) and exact["2"] == (0.0, 1, 0.0)
    assert all(exact[str(c)][0] == pytest.approx(want[own == c].mean()) for c in (0, 1))
    rough = {r.scope: r for r in CL.silhouette(df, "c", "v", "k", references=50).collect()}
    assert rough["all"].n == 211 and 0 < rough["all"].error < 0.1
    assert abs(rough["all"].silhouette - want.mean()) < 5 * rough["all"].error


def test_vote_of_trained_models(spark):
    """Rings no line can part: the kernel classifier does; the vote is the weighted mean, and scores are those of a plain count."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 420)
    turn, far = rng.uniform(0, 2 * math.pi, 420), y + 0.25 * rng.normal(size=420)
    rows = [(i, int(c), float(r * math.cos(a)), float(r * math.sin(a))) for i, (c, a, r) in enumerate(zip(y, turn, far))]
    df = spark.createDataFrame(rows, "key long, cls int, a double, b double")
    voted = M.trained_vote(df.where("key % 3 > 0"), df.where("key % 3 = 0"), ["a", "b"], "cls", "key", 3).collect()
    assert len(voted) == 140
    for r in voted:
        for n in ("boosted", "forest", "svm", "tree", "vote"):
            assert len(r[f"p_{n}"]) == 3 and sum(r[f"p_{n}"]) == pytest.approx(1) and min(r[f"p_{n}"]) >= 0
        want = sum(M.VOTE_WEIGHTS[n] * np.array(r[f"p_{n}"]) for n in M.VOTE_WEIGHTS) / 9
        assert np.allclose(r.p_vote, want)
    got = {r.model: r for r in M.score_votes(spark.createDataFrame(voted), "cls").collect()}
    for n in ("svm", "vote"):
        said, real = np.array([int(np.argmax(r[f"p_{n}"])) for r in voted]), np.array([r.cls for r in voted])
        f1 = [2 * ((said == c) & (real == c)).sum() / ((said == c).sum() + (real == c).sum()) for c in range(3)]
        assert got[n].accuracy == pytest.approx((said == real).mean()) and got[n].class_f1 == pytest.approx(f1)
        assert got[n].f1 == pytest.approx(np.mean(f1)) and got[n].support == [int((real == c).sum()) for c in range(3)]
        assert got[n].accuracy > 0.8


def test_training_stops_at_the_best_slice(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) ^ (rng.random(240) < 0.15)  # noise that later slices learn by heart
    rows = [(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "key long, cls int, a double, b double")
    valid = df.where("key % 3 = 0")
    model, table = M.train_until_best(df.where("key % 3 > 0"), valid, ["a", "b"], "cls", 2, hidden=[16, 8], slice_rounds=8, slices=30, patience=3)
    got = table.orderBy("slice").collect()
    losses = [r.loss for r in got]
    best = int(np.argmin(losses))
    assert [r.best for r in got] == [i == best for i in range(len(got))] and got[-1].last and len(got) in (best + 4, 30)
    scored = M.predict(model, valid, "cls").select("cls", "p", "prediction").collect()
    assert np.mean([-math.log(max(r.p[r.cls], 1e-15)) for r in scored]) == pytest.approx(losses[best])
    assert np.mean([r.prediction == r.cls for r in scored]) == pytest.approx(got[best].accuracy) and got[best].accuracy > 0.65
