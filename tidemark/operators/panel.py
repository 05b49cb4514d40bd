"""Month-end closes and the point-in-time (fund, quarter) training panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.joins import asof_offset
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.series import LOOKBACK_DAYS, MIN_FIVE_YEAR_ROWS, MIN_YEAR_ROWS, cagr, with_recovery_days
from tidemark.rules import RISK_FREE, TRADING_DAYS, VOL_FLOOR
from tidemark.sources.lineage import settle

MIN_MONTHS, MIN_HISTORY = 48, 24


def month_end_close(series: DataFrame) -> DataFrame:
    """Last price of each calendar month, stamped with the month end (d)."""
    return series.groupBy("key", F.last_day("d").alias("m")).agg(
        F.max_by("v", "d").alias("v")).withColumnRenamed("m", "d")


def quarter_points(months: DataFrame) -> DataFrame:
    """Quarter-end as-of rows with their look-back and look-ahead values.

    One window pass over month closes per key (a few hundred rows per key).
    """
    w = Window.partitionBy("key").orderBy("d")
    whole = Window.partitionBy("key")
    seen = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = months.select(
        "key", "d", "v", F.count(F.lit(1)).over(whole).alias("_n"), seen.alias("_seen"),
        asof_offset("key", "d", "v", -12).alias("v_1y"), asof_offset("key", "d", "v", -36).alias("v_3y"),
        asof_offset("key", "d", "v", -60).alias("v_5y"), asof_offset("key", "d", "v", -6).alias("v_6m"),
        asof_offset("key", "d", "v", 36).alias("v_next"))
    keep = (F.month("d").isin(3, 6, 9, 12) & (F.col("_n") >= MIN_MONTHS) & (F.col("_seen") >= MIN_HISTORY)
            & F.col("v_next").isNotNull() & (F.col("v") > 0))
    return rows.where(keep).select(
        "key", F.col("d").alias("as_of"), "v",
        (F.col("v_next") / F.col("v") - 1).alias("future_return_3y"),
        cagr(F.col("v_1y"), F.col("v"), 1).alias("cagr_1yr"), cagr(F.col("v_3y"), F.col("v"), 3).alias("cagr_3yr"),
        cagr(F.col("v_5y"), F.col("v"), 5).alias("cagr_5yr"),
        F.when(F.col("v_6m") > 0, F.col("v") / F.col("v_6m") - 1).alias("momentum_6m"))


def trailing_drawdown(months: DataFrame, points: DataFrame) -> DataFrame:
    """Three-year drawdown and recovery time at every (key, as_of) of ``points``, which are quarter ends.

    Each month row is copied to the at most thirteen as-of dates of its key whose window covers it, so a window
    never mixes dates after its as-of date. Months move once, by key; the copies stay where they are made.
    """
    asked = points.groupBy("key").agg(F.collect_set("as_of").alias("_asked"))  # a key's quarter ends
    covering = F.filter("_asked", lambda a: (a >= F.col("d")) & (F.col("d") >= F.add_months(a, -36)))
    copies = months.join(asked, "key").select("key", "d", "v", F.explode(covering).alias("as_of"))
    w = Window.partitionBy("key", "as_of").orderBy("d")
    rows = copies.withColumn("peak", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("drawdown", (F.col("v") - F.col("peak")) / F.col("peak"))
    rows = with_recovery_days(rows, w)
    agg = rows.groupBy("key", "as_of").agg(F.count(F.lit(1)).alias("_n"), F.min("drawdown").alias("max_drawdown"),
                                           F.percentile("recovery_days", 0.5).alias("recovery_time"))
    return agg.where(F.col("_n") >= 2).drop("_n")


def index_starts(index: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """(as_of, first, year): the index's first day of the ``LOOKBACK_DAYS`` before each as-of date, and the first day of
    its last five years that has a one-year return from inside them. Calendar-sized."""
    marks = as_ofs.select("as_of").distinct()
    none, day = F.lit(None).cast("date"), Window.partitionBy(F.lit(1)).orderBy("d")
    rows = index.select("d", F.col("d").alias("day"), F.lead("d", TRADING_DAYS).over(day).alias("later"), none.alias("as_of"), F.lit(0).alias("side"))
    for side, start in ((1, F.date_sub("as_of", LOOKBACK_DAYS)), (2, F.add_months("as_of", -60))):
        rows = rows.unionByName(marks.select(start.alias("d"), none.alias("day"), none.alias("later"), "as_of", F.lit(side).alias("side")))
    after = Window.partitionBy(F.lit(1)).orderBy("d").rangeBetween(0, Window.unboundedFollowing)
    found = rows.select("as_of", "side", F.first("day", ignorenulls=True).over(after).alias("day"), F.first("later", ignorenulls=True).over(after).alias("later"))
    return found.where("as_of IS NOT NULL").groupBy("as_of").agg(
        F.max(F.when(F.col("side") == 1, F.col("day"))).alias("first"), F.max(F.when(F.col("side") == 2, F.col("later"))).alias("year"))


def trailing_daily(series: DataFrame, index: DataFrame, points: DataFrame) -> DataFrame:
    """Volatility, tracking error and one-year consistency at every (key, as_of) of ``points``, from daily prices.

    Running sums stand at every day of a key; what lies in a window is the difference of two of them, and these are
    looked up by a few probes for each as-of date, which every day of the key meets as one array: a probe takes the
    last day not after it. Only days that a probe takes are kept, so sums are neither sorted nor shuffled for the
    others. Rows that a window's start or the index leaves out are the ones before some day, so of several such bounds
    the last counts.
    """
    w = Window.partitionBy("key").orderBy("d")
    one = Window.partitionBy(F.lit(1)).orderBy("d")  # one row per calendar day
    idx = index.select("d", F.ln(F.col("v") / F.lag("v").over(one)).alias("_il"), (F.col("v") / F.lag("v", TRADING_DAYS).over(one) - 1).alias("_ir"))
    days = series.where(F.col("v").isNotNull()).join(idx, "d", "left").select(
        "key", "d", F.ln(F.col("v") / F.lag("v").over(w)).alias("_l"), (F.col("v") / F.lag("v", TRADING_DAYS).over(w) - 1).alias("_r"), "_il", "_ir")
    active, zero = F.col("_l") - F.col("_il"), F.lit(0.0)
    both = F.col("_r").isNotNull() & F.col("_ir").isNotNull()
    parts = {"rows": F.lit(1.0), "n": F.col("_l").isNotNull().cast("double"), "s": F.coalesce("_l", zero), "q": F.coalesce(F.col("_l") * F.col("_l"), zero),
             "an": active.isNotNull().cast("double"), "as": F.coalesce(active, zero), "aq": F.coalesce(active * active, zero),
             "rn": F.col("_r").isNotNull().cast("double"), "up": F.coalesce((F.col("_r") > 0).cast("double"), zero),
             "bn": both.cast("double"), "beat": F.when(both & (F.col("_r") > F.col("_ir")), 1.0).otherwise(0.0)}
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    days = days.select("key", "d", F.struct(*[F.sum(e).over(past).alias(c) for c, e in parts.items()]).alias("at"))
    days = days.select("key", "d", F.lead("d").over(w).alias("_till"),
                       F.struct("at", F.lead("at", 1).over(w).alias("next"), F.lead("at", TRADING_DAYS).over(w).alias("year")).alias("sums"))
    asked = points.select("key", "as_of").join(index_starts(index, points), "as_of", "left")
    before_400, before_5y = F.date_sub("as_of", LOOKBACK_DAYS + 1), F.date_sub(F.add_months("as_of", -60), 1)
    ends = {"end": F.col("as_of"), "start": before_400, "five": before_5y, "index": F.col("first"), "index_year": F.date_sub("year", 1)}
    probes = asked.select("key", F.inline(F.array(*[F.struct(
        F.lit(i).alias("kind"), d.alias("d"), "as_of", F.col("year").isNotNull().cast("int").alias("has_year")) for i, d in enumerate(ends.values())])))
    listed = probes.where("d IS NOT NULL").groupBy("key").agg(F.collect_set(F.struct("kind", "d", "as_of", "has_year")).alias("_asked"))
    # A price without a date stands before all days.
    taken = F.filter("_asked", lambda p: (F.col("_day").isNull() | (p["d"] >= F.col("_day"))) & (F.col("_till").isNull() | (p["d"] < F.col("_till"))))
    found = days.withColumnRenamed("d", "_day").join(listed, "key").select("key", "sums", F.inline(taken))
    at = found.groupBy("key", "as_of").agg(*[F.max(F.when(F.col("kind") == i, F.col("sums"))).alias(k) for i, k in enumerate(ends)],
                                           F.max("has_year").alias("has_year"))
    empty = F.struct(*[zero.alias(c) for c in parts])
    later = lambda a, b: F.when(b.isNull() | (a["rows"] >= b["rows"]), a).otherwise(b)
    own = F.when(F.col("start").isNull(), empty).otherwise(F.col("start")["next"])
    year = F.when(F.col("five").isNull(), empty).otherwise(F.col("five")["year"])
    at = at.withColumns({"o": own, "y": year}).withColumns({
        "i": later(F.col("o"), F.col("index")["at"]), "b": F.when(F.col("has_year") == 1, later(F.col("y"), F.col("index_year")["at"]))})
    e = F.col("end")["at"]

    def annual_sd(n: str, s: str, q: str, out: Column) -> Column:
        count, total = e[n] - out[n], e[s] - out[s]
        square = (e[q] - out[q] - total * total / count) / (count - 1)
        return F.when(count > 1, F.sqrt(F.greatest(square, F.lit(0.0))) * F.sqrt(F.lit(float(TRADING_DAYS))))

    def share(hits: str, n: str, out: Column) -> Column:
        return F.when(e[n] > out[n], (e[hits] - out[hits]) / (e[n] - out[n]))

    enough = e["rows"] - F.coalesce(F.col("start")["at"]["rows"], zero) >= MIN_YEAR_ROWS
    five = e["rows"] - F.coalesce(F.col("five")["at"]["rows"], zero) >= MIN_FIVE_YEAR_ROWS
    return at.select(
        "key", "as_of", F.when(enough, F.greatest(annual_sd("n", "s", "q", F.col("o")), F.lit(VOL_FLOOR))).alias("vol_1yr"),
        F.when(enough & (e["an"] - F.col("i")["an"] >= MIN_YEAR_ROWS), annual_sd("an", "as", "aq", F.col("i"))).alias("tracking_error_1y"),
        F.when(five, share("beat", "bn", F.col("b"))).alias("beat_index"), F.when(five, share("up", "rn", F.col("y"))).alias("beat_zero"))


def index_future_return(index: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """Three-year-ahead index return at each as-of date (on-or-before now, on-or-after later).

    Both sides are calendar-sized; the as-of rows are merged into the index and
    filled by window, so there is no range join.
    """
    marks = as_ofs.select("as_of").distinct()
    both = (index.select("d", "v", F.lit(None).cast("date").alias("as_of"), F.lit(None).cast("int").alias("side"))
            .unionByName(marks.select(F.col("as_of").alias("d"), F.lit(None).cast("double").alias("v"), "as_of", F.lit(0).alias("side")))
            .unionByName(marks.select(F.add_months("as_of", 36).alias("d"), F.lit(None).cast("double").alias("v"), "as_of", F.lit(1).alias("side"))))
    w = Window.partitionBy(F.lit(1)).orderBy("d")
    before = F.last("v", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("v", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    filled = both.select("as_of", "side", before.alias("_b"), after.alias("_a")).where("as_of IS NOT NULL")
    return filled.groupBy("as_of").agg(
        F.max(F.when(F.col("side") == 0, F.col("_b"))).alias("_now"),
        F.max(F.when(F.col("side") == 1, F.col("_a"))).alias("_later")
    ).select("as_of", F.when(F.col("_now") > 0, F.col("_later") / F.col("_now") - 1).alias("index_future"))


def forward_panel(series: DataFrame, index: DataFrame, funds: DataFrame) -> DataFrame:
    """Point-in-time panel: features known at each quarter end and the next three years' return.

    ``funds`` gives key, risk_tier, category and benchmarked per fund.  Metrics
    that lack data stay NULL; impute them per column downstream.
    """
    months = month_end_close(series)
    points = settle(quarter_points(months))  # read for its rows, its dates by key and its distinct dates
    panel = (points.join(trailing_drawdown(months, points), ["key", "as_of"], "left")
             .join(trailing_daily(series, index, points), ["key", "as_of"], "left")
             .join(index_future_return(index, points), "as_of", "left")
             .join(funds, "key"))
    return panel.select(
        "key", "as_of", "risk_tier", "category", "benchmarked", "future_return_3y",
        (F.col("future_return_3y") - F.col("index_future")).alias("future_excess_3y"),
        "cagr_1yr", "cagr_3yr", "cagr_5yr", "momentum_6m", "max_drawdown", "recovery_time", "vol_1yr",
        "tracking_error_1y", F.coalesce(F.when(F.col("benchmarked") > 0, F.col("beat_index")), F.col("beat_zero")).alias("consistency_1y"),
        C.clip((F.col("cagr_1yr") - RISK_FREE) / F.col("vol_1yr"), -10, 10).alias("sharpe_1yr"))


def label_top_quantile(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """label_best = 1 for the top fifth inside (as_of, tier, category); the maximum in groups
    of one or two."""
    by = ["as_of", "risk_tier", "category"]
    metric = F.when((F.col("benchmarked") > 0) & F.col("future_excess_3y").isNotNull(),
                    F.col("future_excess_3y")).otherwise(F.col("future_return_3y"))
    rows = panel.withColumn("_metric", metric)
    q = exact_quantiles(rows, ["_metric"], [share, 1.0], by)
    bar = q.select(*by, F.when(F.col("n") > 2, F.col("q")[0]).otherwise(F.col("q")[1]).alias("_bar"))
    return rows.join(bar, by).withColumn("label_best", (F.col("_metric") >= F.col("_bar")).cast("int")).drop("_metric", "_bar")


def positive_rate(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count(F.lit(1)).alias("panel_rows"), F.sum("label_best").alias("panel_positive"),
                        F.count_distinct("key").alias("panel_funds"), F.avg("label_best").alias("positive_rate"))
