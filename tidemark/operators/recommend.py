"""Constrained top-N selection and portfolio construction, set-based over tiers and horizons.

Everything that touches the whole catalogue is an aggregate or a top-k with a
group limit; from the shortlist on, a tier holds a few dozen rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators import catalogue as G
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.ranking import top_n_per_group

PERFORMANCE = ["excess_return_3y", "excess_return_5y", "fund_return_3y"]
PERFORMANCE_WEIGHT = {"excess_return_3y": 0.30, "excess_return_5y": 0.20, "fund_return_3y": 0.15}


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("code").asc()]


def rule_score(pool: DataFrame, by: str, with_returns: bool = True) -> DataFrame:
    """Weighted min-max score inside each pool.  ``by`` has a handful of values (tiers), so
    its statistics table is that size."""
    perf = PERFORMANCE if with_returns else []
    lows = [F.min(c).alias(f"_lo_{c}") for c in perf] + [F.max(c).alias(f"_hi_{c}") for c in perf]
    aum = F.coalesce("aum", F.lit(0.0))
    days = F.datediff("latest_date", F.lit("1970-01-01").cast("date"))
    stats = pool.groupBy(by).agg(
        *lows, F.min(aum).alias("_lo_aum"), F.max(aum).alias("_hi_aum"),
        F.min(days).alias("_lo_day"), F.max(days).alias("_hi_day"))
    if perf:
        med = exact_quantiles(pool, perf, [0.5], [by])
        stats = stats.join(med.groupBy(by).agg(*[
            F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"_md_{c}") for c in perf]), by, "left")
    df = pool.join(F.broadcast(stats), by)  # one row per tier
    score = F.lit(0.0)
    for c in perf:
        x = F.coalesce(F.col(c), F.col(f"_md_{c}"), F.lit(0.0))
        lo, hi = (F.coalesce(F.col(f"_{k}_{c}"), F.lit(0.0)) for k in ("lo", "hi"))
        score = score + PERFORMANCE_WEIGHT[c] * C.spread_share(x, lo, hi, 1e-6)
    if perf:
        score = score + 0.05 * F.coalesce(F.col("benchmarked").cast("double"), F.lit(0.0))
    w_aum, w_day = (0.20, 0.10) if perf else (0.70, 0.30)
    score = score + w_aum * C.spread_share(aum, F.col("_lo_aum"), F.col("_hi_aum"), 1e-6)
    span = F.col("_hi_day") - F.col("_lo_day")
    recent = F.when(span > 0, (days - F.col("_lo_day")) / span)
    score = score + w_day * F.coalesce(recent, F.lit(0.0))
    return df.withColumn("score", score).drop(*[c for c in df.columns if c.startswith("_")])


def tier_pool(funds: DataFrame, top_n: int, tiers: Sequence[str], min_aum: float | None,
              type_contains: str | None) -> tuple[DataFrame, dict[str, int]]:
    """Candidate rows per requested tier (``for_tier``) and the pool size of each.

    An empty tier borrows the next lower one; from Medium up, funds without data
    are left out when enough data-rich funds exist.
    """
    ok = F.lit(True)
    if min_aum is not None:
        ok = ok & F.coalesce(F.col("aum") >= min_aum, F.lit(False))
    if type_contains:
        ok = ok & F.coalesce(F.contains(F.lower("scheme_type"), F.lit(type_contains.lower())), F.lit(False))
    rich = F.coalesce(F.col("quality_mode"), F.lit(0)) >= 1
    counted = funds.where(F.col("risk_tier").isin(rules.TIERS)).groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(ok & rich).alias("n_rich"))
    sizes = {row["risk_tier"]: row for row in counted.collect()}  # at most five rows
    users: dict[str, list[str]] = {}
    keep_rich, pool_size = [], {}
    for tier in tiers:
        source = tier if tier in sizes else rules.TIERS[max(0, rules.TIER_ORD[tier] - 1)]
        if source not in sizes:
            continue
        users.setdefault(source, []).append(tier)
        row = sizes[source]
        only_rich = rules.TIER_ORD[tier] >= 2 and row["n_rich"] >= max(3, top_n)
        if only_rich:
            keep_rich.append(tier)
        pool_size[tier] = row["n_rich"] if only_rich else row["n_ok"]
    if not users:
        return funds.where(F.lit(False)).withColumn("for_tier", F.lit("")), {}
    targets = F.create_map(*[x for s, ts in users.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in ts]))])
    pool = funds.where(F.col("risk_tier").isin(list(users)) & ok).withColumn(
        "for_tier", F.explode(targets[F.col("risk_tier")]))
    if keep_rich:
        pool = pool.where(~F.col("for_tier").isin(keep_rich) | rich)
    return pool, pool_size


def _per_tier(values: dict[str, int], default: int = 0) -> Column:
    pairs = [F.lit(x) for t, v in values.items() for x in (t, v)]
    return F.coalesce(F.create_map(*pairs)[F.col("for_tier")], F.lit(default)) if pairs else F.lit(default)


def shortlist(pool: DataFrame, sizes: dict[str, int], top_n: int) -> DataFrame:
    """Segment quotas plus carry-over: at most 3n rows per tier."""
    first, second = max(1, math.ceil(top_n * 0.50)), max(1, math.ceil(top_n * 0.30))
    third = max(0, top_n - first - second)
    quota = F.lit(0)
    for tier, order in rules.SEGMENT_ORDER.items():
        for seg, k in zip(order, (first, second, third)):
            quota = F.when((F.col("for_tier") == tier) & (F.col("segment") == seg), k).otherwise(quota)
    big = [t for t, n in sizes.items() if n > top_n]
    small = pool.where(~F.col("for_tier").isin(big)) if big else pool
    if not big:
        return small
    wide = pool.where(F.col("for_tier").isin(big))
    # Both branches are top-k with a literal bound: cut per input task before the shuffle.
    seg = top_n_per_group(wide, ["for_tier", "segment"], best_first(), first, "_rs").where(F.col("_rs") <= quota)
    top = top_n_per_group(wide, ["for_tier"], best_first(), 4 * top_n + 4, "_rt")
    picked = seg.select("for_tier", "code", F.lit(1).alias("_picked"))
    rest = top.join(F.broadcast(picked), ["for_tier", "code"], "left_anti")  # 5 tiers x (n + 2) rows
    counts = Window.partitionBy("for_tier")
    both = (seg.drop("_rs").withColumn("_picked", F.lit(1))
            .unionByName(rest.drop("_rt").withColumn("_picked", F.lit(0))))
    ranked = both.withColumn("_n", F.sum("_picked").over(counts)).withColumn(
        "_r", F.row_number().over(Window.partitionBy("for_tier", "_picked").orderBy(*best_first())))
    kept = ranked.where((F.col("_picked") == 1) | (F.col("_r") <= 3 * top_n - F.col("_n")))
    return kept.drop("_picked", "_n", "_r").unionByName(small)


def recommend(
    funds: DataFrame,
    top_n: int = 5,
    tiers: Sequence[str] = tuple(rules.TIERS),
    min_aum: float | None = None,
    type_contains: str | None = None,
    score: str | None = None,
    with_returns: bool = True,
) -> DataFrame:
    """Constrained top-N funds for every requested tier at once (``for_tier``, ``rank``)."""
    pool, sizes = tier_pool(funds, top_n, tiers, min_aum, type_contains)
    pool = pool.withColumn("segment", G.asset_segment(F.col("category")))
    if score is None:
        pool = rule_score(pool, "for_tier", with_returns)
    else:
        pool = pool.withColumn("score", F.col(score))
    short = shortlist(pool, sizes, top_n).where("category IS NOT NULL AND amc IS NOT NULL")
    capped = top_n_per_group(short, ["for_tier", "category"], best_first(), 2, "_c")
    capped = top_n_per_group(capped, ["for_tier", "amc"], best_first(),
                             max(1, math.ceil(top_n * rules.MAX_AMC_WEIGHT)), "_a").drop("_c", "_a")
    capped = capped.withColumn("style", G.style_bucket(F.col("category")))
    in_style = Window.partitionBy("for_tier", "style").orderBy(*best_first())
    guarded = F.col("for_tier").isin("Medium", "High", "Very_High") & F.lit(top_n >= 4)
    pin = guarded & F.col("style").isin("core", "growth") & (F.row_number().over(in_style) == 1)
    final = capped.withColumn("_pin", pin.cast("int"))
    order = Window.partitionBy("for_tier").orderBy(F.col("_pin").desc(), *best_first())
    final = final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).drop("_pin")
    return with_category_entropy(final)


def with_category_entropy(recs: DataFrame) -> DataFrame:
    """Entropy of the categories inside each (tiny) recommendation list."""
    tier, cell = Window.partitionBy("for_tier"), Window.partitionBy("for_tier", "category")
    n, k = F.count(F.lit(1)).over(tier), F.count(F.lit(1)).over(cell)
    df = recs.withColumn("_p", k / n).withColumn("_k", k).withColumn("_n", n)
    entropy = -F.sum(F.ln(F.col("_p") + 1e-12) * F.col("_p") / F.col("_k")).over(tier)
    kinds = F.sum(1 / F.col("_k")).over(tier)
    df = df.withColumns({"_e": entropy, "_kinds": F.round(kinds)})
    many = F.col("_n") > 1
    return df.withColumns({
        "category_entropy": F.when(many, F.round("_e", 4)).otherwise(0.0),
        "category_entropy_norm": F.when(many, F.round(F.col("_e") / (F.ln("_kinds") + 1e-9), 4)).otherwise(0.0),
    }).drop("_p", "_k", "_n", "_e", "_kinds")


def display_rate(df: DataFrame) -> DataFrame:
    """Show an expense rate only when it is a disclosed one."""
    return df.withColumn("expense_display", F.when(F.col("expense_missing") == 0, F.col("expense_real")))


def rationale_text(model_scored: bool = False) -> Column:
    tag = "(XGB+RF ensemble scored)" if model_scored else "(AUM+recency scored)"
    return F.concat(
        F.lit("Matched to your '"), F.col("for_tier"), F.lit(f"' risk profile {tag}. Category: "),
        F.coalesce("category", F.lit("")), F.lit(". ₹"), F.format_number(F.rint(F.coalesce("aum", F.lit(0.0))), 0),
        F.lit(" Cr AUM, NAV ₹"), F.format_string("%.2f", F.coalesce("price", F.lit(0.0))), F.lit("."))


def compare_rankings(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Top-k by two scores side by side."""
    cols = ["code", a, b]
    left = df.select(*cols).orderBy(F.col(a).desc(), "code").limit(k)
    right = df.select(*cols).orderBy(F.col(b).desc(), "code").limit(k)
    one = Window.partitionBy(F.lit(1))  # k rows
    left = left.select("code", F.row_number().over(one.orderBy(F.col(a).desc(), "code")).alias("rank_a"))
    right = right.select("code", F.row_number().over(one.orderBy(F.col(b).desc(), "code")).alias("rank_b"))
    return left.join(right, "code", "full_outer")


# --- allocation -------------------------------------------------------------

def diversification(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """0.4(1-HHI manager) + 0.4(1-HHI category) + 0.2 two-class entropy, per portfolio."""
    d = df.withColumn("_cls", G.asset_class(F.coalesce("category", F.lit(""))))
    whole = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(whole)

    def share(c: str) -> Column:
        return F.count(F.lit(1)).over(Window.partitionBy(*by, c)) / n

    d = d.select(*by, n.alias("_n"), share("amc").alias("_pa"), share("category").alias("_pc"), share("_cls").alias("_pe"))
    # Each row carries its own group's share: sum of p over rows is N times the sum of p squared.
    entropy = F.sum(-F.log2(F.col("_pe") + 1e-10) / F.col("_n"))
    score = (0.4 * (1 - F.sum(F.col("_pa") / F.col("_n"))) + 0.4 * (1 - F.sum(F.col("_pc") / F.col("_n")))
             + 0.2 * F.least(entropy, F.lit(1.0)))
    return d.groupBy(*by).agg(F.round(score, 4).alias("diversification_score"))


def allocate(recs: DataFrame, by: str = "for_tier", amount: float = 100_000.0, passes: int = 20) -> DataFrame:
    """Equity/debt weights with fund and manager caps, per portfolio.

    A portfolio is a top-N list (tens of rows), so it is folded as one array:
    every pass normalises and scales back the managers above the cap.
    """
    cap = rules.MAX_AMC_WEIGHT
    d = recs.withColumn("asset_class", G.asset_class(F.coalesce("category", F.lit(""))))
    cls = Window.partitionBy(by, "asset_class")
    equity = F.create_map(*[F.lit(x) for kv in rules.EQUITY_SHARE.items() for x in kv])[F.col("for_tier")]
    target = F.when(F.col("asset_class") == "equity", equity).otherwise(1 - equity)
    d = d.withColumn("_w", F.least(target / F.count(F.lit(1)).over(cls), F.lit(rules.MAX_FUND_WEIGHT)))
    keep = [c for c in d.columns if c != by]
    folded = d.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in keep if c != "rank"]))).alias("rows"))
    amcs = F.transform("rows", lambda x: x["amc"])

    def add(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def normalise(w: Column) -> Column:
        return F.transform(w, lambda x: F.when(add(w) > 0, x / add(w)).otherwise(x))

    def one_pass(w: Column) -> Column:
        pairs = F.arrays_zip(w.alias("w"), amcs.alias("a"))
        return F.transform(pairs, lambda p: p["w"] * F.when(
            _share(pairs, p) > cap + 1e-6, cap / _share(pairs, p)).otherwise(1.0))

    def _share(pairs: Column, p: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.when(x["a"] == p["a"], x["w"]).otherwise(0.0))

    start = F.transform("rows", lambda x: x["_w"])
    # Settle each step as its own column: nested lambdas would otherwise multiply the plan.
    step = folded.withColumn("w", start)
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.col("w"), lambda acc, _: one_pass(normalise(acc)))
    step = step.withColumn("w", weights).withColumn("w", normalise(F.col("w")))
    out = step.select(by, F.inline(F.arrays_zip(F.col("rows"), F.col("w"))))
    names = [c for c in recs.columns if c not in (by,)]
    full = out.select(by, *[F.col(f"rows.{c}").alias(c) for c in names], F.col("rows.asset_class").alias("asset_class"),
                      F.col("w").alias("_w"))
    return _finish(full, by, amount, cap)


def _finish(full: DataFrame, by: str, amount: float, cap: float) -> DataFrame:
    full = full.withColumn("_amc", F.sum("_w").over(Window.partitionBy(by, "amc")))
    full = full.withColumns({
        "weight": C.half_even(F.col("_w"), 4),
        "amount": F.rint(F.col("_w") * amount).cast("bigint"),
        "cap_met": F.max("_amc").over(Window.partitionBy(by)) <= cap + 1e-6,
    }).drop("_w", "_amc")
    return full.join(diversification(full, [by]), by)


# --- horizons ---------------------------------------------------------------

def horizon_label(years: Column) -> Column:
    return F.when(years <= 1, "1yr").when(years <= 3, "3yr").when(years <= 5, "5yr").otherwise("10yr+")


def glide_path(tier: Column, years: Column) -> Column:
    """Target equity share from the tier x horizon table."""
    table = F.create_map(*[x for t, v in rules.GLIDE_PATH.items() for x in (F.lit(t), F.array(*[F.lit(s) for s in v]))])
    slot = F.when(years <= 1, 0).when(years <= 3, 1).when(years <= 5, 2).otherwise(3)
    return F.element_at(table[tier], slot + 1)


def with_horizons(df: DataFrame, horizons: Sequence[int] = tuple(rules.HORIZONS)) -> DataFrame:
    return df.withColumn("horizon_years", F.explode(F.array(*[F.lit(h) for h in horizons])))


def recommend_by_horizon(funds: DataFrame, horizons: Sequence[int] = tuple(rules.HORIZONS), top_n: int = 5,
                         amount: float = 100_000.0, with_returns: bool = True) -> DataFrame:
    """Equity leg (category override at short horizons) plus a debt leg two tiers below."""
    k = max(2, top_n // 2)
    keep = ["code", "name", "amc", "category", "score", "rank"]
    base = recommend(funds, k, with_returns=with_returns)
    legs = []
    # Debt leg: the list of the tier two below, at every horizon.
    users: dict[str, list[str]] = {}
    for tier in rules.TIERS:
        users.setdefault(rules.TIERS[max(0, rules.TIER_ORD[tier] - 2)], []).append(tier)
    targets = F.create_map(*[x for s, ts in users.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in ts]))])
    debt = base.withColumn("tier", F.explode(targets[F.col("for_tier")])).select("tier", *keep)
    legs.append(with_horizons(debt, horizons).withColumn("bracket", F.lit("debt")))
    for h in horizons:
        key = 1 if h <= 1 else 3 if h <= 3 else None
        if key is None:
            eq = base.withColumn("tier", F.col("for_tier")).select("tier", *keep)
        else:
            hit = C.contains_any(F.lower(F.coalesce("category", F.lit(""))), rules.HORIZON_OVERRIDE[key])
            pool = funds.where(hit).withColumn("_all", F.lit("all"))
            best = rule_score(pool, "_all", with_returns).orderBy(*best_first()).limit(k)
            ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*best_first())))
            eq = ranked.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in rules.TIERS]))).select("tier", *keep)
        legs.append(eq.withColumns({"horizon_years": F.lit(h), "bracket": F.lit("equity")}))
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    share = glide_path(F.col("tier"), F.col("horizon_years"))
    rows = rows.withColumn("_target", F.when(F.col("bracket") == "equity", share).otherwise(1 - share)).where("_target > 0")
    leg = Window.partitionBy("tier", "horizon_years", "bracket")
    rows = rows.withColumn("_w", C.half_even(F.col("_target") / F.count(F.lit(1)).over(leg), 4))
    whole = Window.partitionBy("tier", "horizon_years")
    rows = rows.withColumn("weight", C.half_even(F.col("_w") / F.sum("_w").over(whole), 4))
    return rows.withColumns({
        "amount": F.rint(F.col("weight") * amount).cast("bigint"),
        "horizon": horizon_label(F.col("horizon_years")), "equity_share": F.round(share, 2),
    }).drop("_w", "_target")


def bracket_table() -> list[tuple[str, str, str, float]]:
    """(tier, bracket, bracket tier, share) with the edge tiers folded into the core."""
    out = []
    last = len(rules.TIERS) - 1
    for i, tier in enumerate(rules.TIERS):
        core, low, high = rules.CORE_SHARE, rules.STABILITY_SHARE, rules.GROWTH_SHARE
        if i == 0:
            core, low = core + low, 0.0
        if i == last:
            core, high = core + high, 0.0
        for name, source, pct in (("Core", tier, core), ("Stability", rules.TIERS[max(0, i - 1)], low),
                                  ("Growth", rules.TIERS[min(last, i + 1)], high)):
            if pct > 0:
                out.append((tier, name, source, pct))
    return out


def core_satellite(funds: DataFrame, horizons: Sequence[int] = (5,), per_bracket: int = 3,
                   amount: float = 100_000.0, with_returns: bool = True) -> DataFrame:
    """60/20/20 portfolios for every tier and horizon from one recommendation pass."""
    recs = recommend(funds, per_bracket, with_returns=with_returns)
    users: dict[str, list] = {}
    for tier, bracket, source, pct in bracket_table():
        users.setdefault(source, []).append(F.struct(
            F.lit(tier).alias("tier"), F.lit(bracket).alias("bracket"), F.lit(pct).alias("pct")))
    targets = F.create_map(*[x for s, us in users.items() for x in (F.lit(s), F.array(*us))])
    rows = recs.withColumn("_t", F.explode(targets[F.col("for_tier")]))
    rows = rows.select("_t.tier", "_t.bracket", F.col("_t.pct").alias("_pct"), F.col("for_tier").alias("bracket_tier"),
                       "code", "name", "amc", "category", "score", "rank")
    cell, whole = Window.partitionBy("tier", "bracket"), Window.partitionBy("tier")
    rows = rows.withColumn("_w", C.half_even(F.col("_pct") / F.count(F.lit(1)).over(cell), 4))
    rows = rows.withColumns({
        "bracket_pct": F.round(F.col("_pct") * 100, 1),
        "weight": C.half_even(F.col("_w") / F.sum("_w").over(whole), 4),
    })
    rows = rows.withColumn("amount", F.rint(F.col("weight") * amount).cast("bigint")).drop("_w", "_pct")
    rows = rows.join(F.broadcast(diversification(rows, ["tier"])), "tier")  # five rows
    rows = with_horizons(rows, horizons)
    return rows.withColumns({"horizon": horizon_label(F.col("horizon_years")),
                             "equity_share": F.round(glide_path(F.col("tier"), F.col("horizon_years")), 2)})


def full_profile(funds: DataFrame, per_bracket: int = 3, amount: float = 500_000.0,
                 with_returns: bool = True) -> DataFrame:
    return core_satellite(funds, rules.HORIZONS, per_bracket, amount, with_returns)


def advise_all(customers: DataFrame, recs: DataFrame, label: str = "risk_label") -> DataFrame:
    """Every customer's recommended list: customers joined to five short lists on the tier.

    The right side is 5 x top_n rows; only customers move with the data.
    """
    lists = recs.groupBy("for_tier").agg(F.sort_array(F.collect_list(
        F.struct("rank", "code", "name", "score"))).alias("funds"))
    return customers.join(F.broadcast(lists.withColumnRenamed("for_tier", label)), label, "left")
