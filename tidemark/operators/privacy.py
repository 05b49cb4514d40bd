"""Vector aggregation with outlier damping, clipping, sampling and privacy accounting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.functions import vectors as V
from tidemark.operators.bands import cohort_waves
from tidemark.operators.quantiles import value_ranks


def mean_vector(df: DataFrame, vec: str, weight: Column | None = None) -> DataFrame:
    """(Weighted) element-wise mean as one ARRAY; partial sums per position combine map-side."""
    w = F.lit(1.0) if weight is None else weight
    pos = df.select(w.alias("_w"), F.posexplode(vec).alias("i", "x"))
    means = pos.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.sum("_w")).alias("m"))
    # One row per vector position.
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def update_cosines(df: DataFrame, vec: str) -> DataFrame:
    mean = mean_vector(df, vec).scalar()
    with_mean = df.withColumn("_mean", mean)
    return with_mean.withColumn("cosine", V.cosine(F.col(vec), F.col("_mean"))).drop("_mean")


def robust_vector_mean(df: DataFrame, vec: str, n: str, threshold: float = 0.0, penalty: float = 0.5) -> DataFrame:
    """Weighted mean in which vectors pointing against the mean direction count half."""
    scored = update_cosines(df, vec)
    weight = F.col(n) * F.when(F.col("cosine") < threshold, penalty).otherwise(1.0)
    return mean_vector(scored.withColumn("_wt", weight), vec, F.col("_wt"))


def cosine_stats(df: DataFrame, vec: str, threshold: float = 0.0) -> DataFrame:
    return update_cosines(df, vec).agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count_if(F.col("cosine") < threshold).alias("n_flagged"),
        F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("min_cosine"))


def clip_and_noise(df: DataFrame, vec: str, limit: float = rules.CLIP_NORM, sigma: float = 0.0, seed: int = 42, key: str | None = None) -> DataFrame:
    """Scale vectors to norm <= limit; with sigma > 0 add Gaussian noise of sigma*limit per element.

    Noise is drawn from a hash of (key, position, seed) by the Box-Muller transform, so it needs no shuffle, a
    retried task repeats it, and rows stay apart even where keys repeat (they then share their noise).
    """
    factor = F.least(F.lit(1.0), limit / (V.norm(F.col(vec)) + 1e-12))
    out = df.withColumn("_factor", factor).withColumn(vec, V.scale(F.col(vec), F.col("_factor"))).drop("_factor")
    if sigma <= 0:
        return out
    if key is None:
        raise ValueError("noise needs the key that it is drawn for")

    def uniform(i: Column, part: int) -> Column:
        text = F.concat_ws("|", F.col(key).cast("string"), i.cast("string"), F.lit(f"{seed}|{part}"))
        return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))

    def noise(i: Column) -> Column:
        return F.sqrt(-2.0 * F.ln(uniform(i, 1))) * F.cos(2.0 * F.pi() * uniform(i, 2))

    return out.withColumn(vec, F.transform(vec, lambda x, i: x + noise(i) * F.lit(sigma * limit)))


def skewed_stratified_sample(df: DataFrame, key: str, cls: str, shares: Mapping[str, float], n: int, seed: str = "skew") -> DataFrame:
    """Per-class quota by target shares in hash order, topped up or trimmed to exactly n rows.

    Quotas and the top-up are top-k selections on a hash, so every input task
    forwards at most n rows per class.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)))
    rows = df.withColumn("_h", h)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy("_h", key))).where(F.col("_r") <= n)
    quota = F.lit(0)
    for name, share in shares.items():
        quota = F.when(F.col(cls) == name, int(_half_even(share * n))).otherwise(quota)
    small = ranked.withColumn("_in", (F.col("_r") <= quota).cast("int"))  # at most n rows per class
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("_in").desc(), F.when(F.col("_in") == 1, F.col(cls)), "_h", key)
    return small.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= n).select(*df.columns)


def _half_even(x: float) -> int:
    return round(x)


def order_epsilon(steps: Column, alpha: Column, sigma: float, q: float, delta: float) -> Column:
    """Epsilon of ``steps`` subsampled Gaussian releases at one moment order."""
    step = alpha / (2.0 * sigma * sigma)
    inner = (1 - q) + q * F.exp(step)
    # exp overflows at high orders; the bound is then infinite and never the minimum.
    first = F.when(step < 700, alpha / (alpha - 1) * F.ln(inner))
    two = 2.0 * (2.0 / (2.0 * sigma * sigma))
    second = step if two > 500 else F.ln(
        1 + min(q * q, 1.0) * alpha * (alpha - 1) / 2.0 * max(0.0, math.exp(two) - 1)) / (alpha - 1)
    amplified = F.least(first, second, step)
    return (steps * amplified + F.log1p(-1.0 / alpha)
            - (math.log(delta) + F.ln(1 - 1.0 / alpha)) / (alpha - 1))


def epsilon_for_steps(steps: DataFrame, sigma: float = rules.NOISE_MULTIPLIER, q: float = rules.SAMPLE_RATE,
                      delta: float = rules.DELTA, orders: tuple[int, int] = (2, 512)) -> DataFrame:
    """Smallest epsilon over moment orders for every distinct step count (column ``steps``)."""
    orders_array = F.transform(F.sequence(F.lit(orders[0]), F.lit(orders[1])), lambda a: a.cast("double"))
    grid = steps.select("steps").distinct().withColumn("a", F.explode(orders_array))
    # Orders whose exponential overflows in double precision are skipped.
    usable = F.col("a") / (2.0 * sigma * sigma) < 709.0
    eps = order_epsilon(F.col("steps"), F.col("a"), sigma, q, delta)
    return grid.where(usable).groupBy("steps").agg(F.round(F.min(eps), 4).alias("epsilon"))


def quality_band(eps: Column) -> Column:
    return (F.when(eps < 1, "Excellent").when(eps < 3, "Strong").when(eps < 5, "Good")
            .when(eps < 10, "Moderate").otherwise("Weak"))


def participation_epsilon(ledger: DataFrame, client: str, rnd: str, epochs: int = rules.LOCAL_EPOCHS, **kw) -> DataFrame:
    """Privacy spent per client: rounds joined, local steps, epsilon and its quality band."""
    joined = ledger.groupBy(client).agg(F.count_distinct(rnd).alias("rounds")).withColumn("steps", F.col("rounds") * epochs)
    eps = epsilon_for_steps(joined, **kw)  # one row per distinct step count
    return joined.join(eps, "steps").withColumn("quality", quality_band(F.col("epsilon")))


def isolation_check(df: DataFrame, partition: str, owner: str) -> DataFrame:
    """True when every partition key holds exactly one owner.

    Minimum and maximum decide it with constant state, however large a partition is.
    """
    per = df.groupBy(partition).agg(F.min(owner).alias("a"), F.max(owner).alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n_partitions"), F.count_if(F.col("a") != F.col("b")).alias("n_shared"),
                   (F.count_if(F.col("a") != F.col("b")) == 0).alias("isolated"))


def pseudo_label_quality(df: DataFrame, key: str, pred: str, true: str, waves: int = 4) -> DataFrame:
    """Agreement and rank correlation of predicted and true labels per hash cohort."""
    rows = df.join(cohort_waves(df, key, waves), key).select("wave", F.col(pred).cast("double").alias("a"), F.col(true).cast("double").alias("b"))
    tagged = rows.select("wave", "a", "b", F.concat(F.lit("a|"), F.col("wave")).alias("fa"), F.concat(F.lit("b|"), F.col("wave")).alias("fb"))
    ranks = value_ranks(tagged.select(F.col("fa").alias("feature"), F.col("a").alias("value")).unionByName(
        tagged.select(F.col("fb").alias("feature"), F.col("b").alias("value"))))  # classes x waves rows
    ra = ranks.select(F.col("feature").alias("fa"), F.col("value").alias("a"), F.col("rank").alias("ra"))
    rb = ranks.select(F.col("feature").alias("fb"), F.col("value").alias("b"), F.col("rank").alias("rb"))
    j = tagged.join(ra, ["fa", "a"]).join(rb, ["fb", "b"])
    return j.groupBy("wave").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"),
                                 F.corr("ra", "rb").alias("spearman"))


def round_summary(log: DataFrame, rnd: str, cls: str, loss: str, hit: str, flagged: str) -> DataFrame:
    """Per round: mean loss, accuracy, class entropy and flagged share."""
    cells = log.groupBy(rnd, cls).agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("l"), F.sum(F.col(hit).cast("int")).alias("h"),
                                      F.sum(F.col(flagged).cast("int")).alias("f"))
    return cells.groupBy(rnd).agg(F.sum("n").alias("n"), (F.sum("l") / F.sum("n")).alias("loss"), (F.sum("h") / F.sum("n")).alias("accuracy"),
                                 (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"),
                                 (F.sum("f") / F.sum("n")).alias("flagged_share"))
