"""Customer risk scores, the four-dimension matrix, labels and splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import columns as C
from tidemark.operators.bands import label_by_quantiles
from tidemark.operators.ordering import ordered_rank
from tidemark.operators.quantiles import fitted_quantiles
from tidemark.session import importable


def weighted_sum(weights: Mapping[str, float]) -> Column:
    return sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))


def risk_score_weighted(df: DataFrame, weights: Mapping[str, float] = rules.FEATURE_WEIGHTS) -> DataFrame:
    return df.withColumn("risk_score", weighted_sum({c: w for c, w in weights.items() if c in df.columns}))


def risk_matrix(df: DataFrame, dimensions: Mapping[str, Sequence[str]] = rules.RISK_DIMENSIONS,
                weights: Mapping[str, float] = rules.FEATURE_WEIGHTS) -> DataFrame:
    """Four weighted dimensions, each min-max scaled (0.5 when constant), and their mean."""
    raw = df.withColumns({f"_{d}": weighted_sum({c: weights[c] for c in cols if c in df.columns})
                          for d, cols in dimensions.items()})
    row = raw.agg(*[F.min(f"_{d}").alias(f"{d}__lo") for d in dimensions],
                  *[F.max(f"_{d}").alias(f"{d}__hi") for d in dimensions]).first()
    out = {}
    for d in dimensions:
        lo, hi = row[f"{d}__lo"], row[f"{d}__hi"]
        flat = lo is None or hi - lo <= 1e-9
        out[d] = F.lit(0.5) if flat else (F.col(f"_{d}") - F.lit(lo)) / F.lit(hi - lo)
    scaled = raw.withColumns(out).drop(*[f"_{d}" for d in dimensions])
    return scaled.withColumn("composite", sum((F.col(d) for d in dimensions), F.lit(0.0)) / len(dimensions))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(filled)


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = 5,
            weights: Mapping[str, float] = rules.FEATURE_WEIGHTS) -> dict:
    """Means, loadings per component and explained shares (all column-sized).

    The first component points to positively weighted features; the sign of each further one is that of its first
    loading of at least half the largest size, so results do not depend on the solver.
    """
    model = PCA(k=min(k, len(cols)), inputCol="features", outputCol="pcs").fit(assemble(df, cols))
    pc = model.pc.toArray().copy()
    means = df.agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols]).first().asDict()
    positive = [i for i, c in enumerate(cols) if weights.get(c, 1.0) > 0]
    sign = 1.0 if pc[positive, 0].sum() >= 0 else -1.0
    for j in range(pc.shape[1]):
        size = abs(pc[:, j])
        pc[:, j] *= sign if j == 0 else 1.0 if pc[(size >= size.max() / 2).argmax(), j] >= 0 else -1.0
    return {"columns": list(cols), "means": [means[c] for c in cols], "sign": sign,
            "loadings": [pc[:, j].tolist() for j in range(pc.shape[1])],
            "explained": model.explainedVariance.toArray().tolist()}


def risk_score_pca(df: DataFrame, model: dict) -> DataFrame:
    """Sign-corrected first component of the centred features."""
    terms = zip(model["columns"], model["means"], model["loadings"][0])
    score = sum(((F.coalesce(F.col(c), F.lit(0.0)) - m) * w for c, m, w in terms), F.lit(0.0))
    return df.withColumn("risk_score", score)


def assign_risk_label(df: DataFrame, model: dict) -> DataFrame:
    return label_by_quantiles(risk_score_pca(df, model), "risk_score")


def pca_summary(df: DataFrame, model: dict) -> DataFrame:
    rows, cum = [], 0.0
    for j, share in enumerate(model["explained"]):
        cum += share
        rows += [(j + 1, c, float(model["loadings"][j][i]), float(share), float(cum))
                 for i, c in enumerate(model["columns"])]
    return df.sparkSession.createDataFrame(
        rows, "component int, feature string, loading double, explained double, cumulative double")


def holdout_split(df: DataFrame, key: str, shares: Mapping[str, float], seed: str = "split") -> DataFrame:
    """Named split by hash bucket: stable under re-runs, added rows and cluster size."""
    bucket = C.hash_bucket(F.col(key), seed)
    out, edge = F.lit(None).cast("string"), 0.0
    for name, share in reversed(list(shares.items())):
        below = round(10_000 * (1.0 - edge))
        edge += share
        out = F.when(bucket < below, name).otherwise(out)
    return df.withColumn("split", out)


def stratified_split(df: DataFrame, key: str, cls: str, share: float = 0.8, seed: str = "strata") -> DataFrame:
    """Exact per-class train share by hash order; rows are placed by range, so a dominant class spreads over tasks."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)))
    placed = ordered_rank(df.withColumn("_h", h), [F.col(cls), F.col("_h"), F.col(key)], "_at")
    # One row per class.
    sizes = placed.groupBy(F.col(cls).alias("_cls")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_tot"))
    pos = placed.join(sizes, F.col(cls).eqNullSafe(F.col("_cls")))
    train = F.col("_at") - F.col("_low") < F.rint(F.col("_tot") * share)
    return pos.withColumn("split", F.when(train, "train").otherwise("validation")).select(*df.columns, "split")


def scenario_weights(weights: Mapping[str, float], trials: int, noise: float = 0.20) -> list[dict[str, float]]:
    """Portable pseudo-random weight sets: each weight moves by at most ``noise`` of its size."""
    import hashlib

    out = []
    for i in range(trials):
        row = {}
        for c, w in weights.items():
            unit = int(hashlib.md5(f"{i}|{c}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
            row[c] = w + (2 * unit - 1) * noise * abs(w)
        out.append(row)
    return out


def scenario_shares(df: DataFrame, scenarios: Sequence[Mapping[str, float]], cuts: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Class shares of every weight scenario on fixed score cuts; nulls count 0.

    A block of rows meets all scenarios in one product of two small tables; what leaves a task is one count for
    each scenario and class, never a row for each row and scenario.
    """
    cols = list(scenarios[0])
    names = list(names or [str(i) for i in range(len(scenarios))])
    weights = np.array([[float(s[c]) for c in cols] for s in scenarios])
    edges, k = np.array(cuts, dtype=np.float64), len(scenarios)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, len(edges) + 1), dtype=np.int64)
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            for a in range(0, len(x), 1024):
                scores = x[a: a + 1024] @ weights.T
                above = np.stack([(scores > e).sum(axis=0) for e in edges], axis=1)  # rows over each cut, by scenario
                reached = np.concatenate([np.full((k, 1), len(scores)), above], axis=1)
                total += reached - np.concatenate([above, np.zeros((k, 1), np.int64)], axis=1)
        rows, bands = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(bands), pa.array(total[rows, bands])], names=["at", "band", "n"])

    importable(df.sparkSession)
    counted = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]) \
        .mapInArrow(count, "at long, band long, n long").groupBy("at", "band").agg(F.sum("n").alias("n"))
    named = F.get(F.lit(names), F.col("at").cast("int")).alias("scenario")
    return counted.groupBy("at").agg(
        F.sum("n").alias("n"), *[(F.coalesce(F.sum(F.when(F.col("band") == i, F.col("n"))), F.lit(0)) / F.sum("n")).alias(f"share{i}")
                                 for i in range(len(cuts) + 1)]).select(named, "n", *[f"share{i}" for i in range(len(cuts) + 1)])


TARGET_SHARES = [0.125, 0.25, 0.25, 0.25, 0.125]


def weight_sensitivity(df: DataFrame, weights: Mapping[str, float], trials: int = 500) -> DataFrame:
    """Mean and 95th percentile of the worst class-share deviation over noisy weight sets."""
    base = df.withColumn("_score", weighted_sum(weights))
    cuts = fitted_quantiles(base, ["_score"], rules.LABEL_QUANTILES)["_score"]
    shares = scenario_shares(df, scenario_weights(weights, trials), cuts)
    dev = F.greatest(*[F.abs(F.col(f"share{i}") - t) for i, t in enumerate(TARGET_SHARES)])
    # One row per trial.
    return shares.select(dev.alias("dev")).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("dev").alias("mean_dev"), F.percentile("dev", 0.95).alias("p95_dev"))


def single_feature_sweep(df: DataFrame, weights: Mapping[str, float], step: float = 0.20) -> DataFrame:
    """Largest class-share change when one weight moves down or up by ``step``."""
    base = df.withColumn("_score", weighted_sum(weights))
    cuts = fitted_quantiles(base, ["_score"], rules.LABEL_QUANTILES)["_score"]
    scenarios, names = [dict(weights)], ["base|"]
    for c, w in weights.items():
        for side, sign in (("minus", -1), ("plus", 1)):
            scenarios.append({**weights, c: w + sign * step * abs(w)})
            names.append(f"{side}|{c}")
    shares = scenario_shares(df, scenarios, cuts, names)
    k = len(TARGET_SHARES)
    packed = shares.select(F.split("scenario", r"\|")[0].alias("side"), F.split("scenario", r"\|")[1].alias("feature"),
                           F.array(*[F.col(f"share{i}") for i in range(k)]).alias("s"))
    base_row = packed.where("side = 'base'").select("s").scalar()
    moved = packed.where("side <> 'base'").withColumn("_b", base_row)
    change = F.array_max(F.zip_with("s", "_b", lambda x, y: F.abs(x - y)))
    return moved.groupBy("feature").agg(F.max(F.when(F.col("side") == "minus", change)).alias("minus"),
                                        F.max(F.when(F.col("side") == "plus", change)).alias("plus"))


