"""Mix of sources at target weights, with each source's budget met by a subset-sum fit.

Documents are counted by exact length. A source takes whole passes over its documents, then the same share of
every length, and last a few more documents whose lengths a bounded knapsack makes add up to what is left.
Which documents of a length are taken follows a seeded hash, so reruns agree.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source of its own, the
last; repeated rows count one by one; empty tables give empty results; other columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import ordered_rank
from tidemark.sources.lineage import settle

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_250


def water_fill(sources: DataFrame, total_share: float, most: float) -> DataFrame:
    """``sources`` (weight, source_size) with ``target``: shares of the total by weight, none above ``most``
    times its size, the excess shared again. Each round is one aggregate; only its three sums reach the driver."""
    cap = F.col("source_size") * F.lit(float(most))
    whole = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole[1]:
        return sources.withColumn("target", F.lit(0.0))
    total, level, full = total_share * whole[0], total_share * whole[0] / whole[1], -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        n, held, weight = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == full or not weight:
            break
        full, level = n, (total - held) / weight
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) > cap, cap)
                              .otherwise(F.col("weight") * F.lit(level)).cast("double"))


def subset_sum(lengths: np.ndarray, room: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most ``room``, for a sum as near ``budget`` from below as there is."""
    took = np.zeros(len(lengths), dtype=np.int64)
    first = np.full(budget + 1, -1, dtype=np.int32)  # the item that first reached a sum
    first[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for k in np.argsort(-room, kind="stable"):
        size, left, copies = int(lengths[k]), int(min(room[k], budget // max(lengths[k], 1))), 1
        if size == 0:
            continue
        while left > 0 and first[budget] < 0:  # binary splitting of the copies
            part = min(copies, left)
            step = size * part
            if step <= budget:
                items.append((k, part))
                new = (first[: budget + 1 - step] >= 0) & (first[step:] < 0)
                first[step:][new] = len(items) - 1
            left, copies = left - part, copies * 2
        if first[budget] >= 0:
            break
    at = int(np.flatnonzero(first >= 0)[-1])
    while at > 0:
        k, part = items[first[at]]
        took[k] += part
        at -= int(lengths[k]) * part
    return took


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length so that their words add up to ``budget`` or just under it."""
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return np.zeros(len(lengths), dtype=np.int64)
    share = min(1.0, budget / total)
    exact = counts * share
    take = np.floor(exact).astype(np.int64)
    left = budget - int((take * lengths).sum())
    reserve = 3 * int(lengths.max())  # what the knapsack shall have to play with
    order = np.lexsort((-lengths, take - exact))  # among equals the long ones first: short ones are left to the knapsack
    order = order[(counts > take)[order] & (lengths > 0)[order]]
    more = order[np.cumsum(lengths[order]) <= left - reserve]
    take[more] += 1
    left -= int(lengths[more].sum())
    while left > 2 * reserve and (counts > take).any():  # only where rounding left much
        open_ = np.flatnonzero((counts > take) & (lengths > 0) & (lengths <= left - reserve))
        if not len(open_):
            break
        k = open_[np.argmax(lengths[open_])]
        n = min(int(counts[k] - take[k]), (left - reserve) // int(lengths[k]))
        take[k] += n
        left -= n * int(lengths[k])
    if left > 0:
        take += subset_sum(lengths, np.where(lengths > 0, counts - take, 0), left)
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths: at most as many rows as its longest text has words."""
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    size, target, most = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0]), int(pdf["most"].iloc[0])
    passes = min(int(target // size), most) if size else 0
    rest = round(target - passes * size) if passes < most else 0
    take = fit_lengths(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), rest)
    return pdf[["source_key", "size", "first", "source_size", "target"]].assign(passes=passes, extra=take)


KEYS = ["_source_key", "_size"]
LIMITS_SENT = 1_000_000  # rows of the table of limits, about 50 bytes each, up to which it is sent to all tasks


def sized(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """``docs`` with ``_source_key``, ``_size`` (words) and the seeded ``_draw``."""
    return docs.select(
        "*", F.when(F.col("source").isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), "source")).alias("_source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col("text")).alias("_draw"))


def _plan(docs: DataFrame, weights: Sequence[float], total_share: float, most: int, seed: int, key: str) -> DataFrame:
    """One narrow row per document (``_key``, ``_draw``, ``_source_key``, ``_size``) with its ``place`` among those of its source and
    size, their source's ``source_size`` and ``target``, and the passes over all of them and ``extra`` more that are taken."""
    narrow = sized(docs, key, seed).select(F.col(f"`{key}`").alias("_key"), "_draw", *KEYS)
    ranked = ordered_rank(settle(narrow), [F.col(c) for c in [*KEYS, "_draw"]])
    lengths = settle(ranked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
                     .select(F.col("_source_key").alias("source_key"), F.col("_size").alias("size"), "n", "first"))
    sources = ordered_rank(lengths.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")),
                           [F.col("source_key")], name="place")
    turn = F.pmod(F.col("place"), F.lit(len(weights))) + 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    targets = settle(water_fill(sources, total_share, most).select("source_key", "source_size", "target"))
    fitted = settle(
        lengths.join(targets, "source_key").withColumn("most", F.lit(int(most))).groupBy("source_key")
        .applyInPandas(_fit_source, "source_key string, size long, first long, source_size long, target double, passes long, extra long"))
    fitted = fitted.withColumnsRenamed({"source_key": "_source_key", "size": "_size"})
    return ranked.join(fitted, KEYS).withColumn("place", F.col("rank") - F.col("first")).drop("rank", "first")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5,
                most: int = 2, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """One row per document: key, size (words), source_size, target (of its source), taken (words) and times.

    ``weights`` go to the sources in code point order, repeating, null last. ``total_share`` of all words is
    asked for; no source and no document is taken more than ``most`` times.
    """
    times = F.col("passes") + (F.col("place") < F.col("extra")).cast("long")
    return _plan(docs, weights, total_share, most, seed, key).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * times).alias("taken"),
        times.cast("int").alias("times"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5,
               most: int = 2, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    The plan becomes one limit of the draw for each source and size, which meets the texts where they are read;
    no text is sorted or written. Repeated rows have equal draws: where a limit falls among such rows, these
    rows alone are numbered by range.
    """
    plan = _plan(docs, weights, total_share, most, seed, key)
    last = F.max(F.when(F.col("place") == F.col("extra") - 1, F.col("_draw")))
    beyond = F.max(F.when(F.col("place") == F.col("extra"), F.col("_draw")))
    limits = settle(plan.groupBy(*KEYS).agg(F.first("passes").alias("_passes"), F.first("extra").alias("_extra"), last.alias("_last"),
                                            beyond.alias("_beyond")))
    cut = F.coalesce(F.col("_last") == F.col("_beyond"), F.lit(False))
    rows = sized(docs, key, seed)
    again = lambda df, times: df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
    near = limits.withColumn("_cut", cut).drop("_extra", "_beyond")
    near = F.broadcast(near) if limits.count() <= LIMITS_SENT else near
    here = rows.join(near, KEYS).withColumn("_taken", F.coalesce(F.col("_draw") <= F.col("_last"), F.lit(False)))
    whole = again(here.filter(~(F.col("_cut") & (F.col("_draw") == F.col("_last")))), F.col("_passes") + F.col("_taken").cast("long"))
    # Rows that tie at a limit: as many of them as have a place before it.
    split = limits.filter(cut)
    n_split = split.count()
    if n_split == 0:
        return whole
    split = F.broadcast(split) if n_split <= LIMITS_SENT else split
    left = plan.join(split.select(*KEYS, F.col("_last").alias("_draw")), [*KEYS, "_draw"]).filter("place < extra") \
        .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_more"))
    tied = rows.join(split.select(*KEYS, "_passes", F.col("_last").alias("_draw")), [*KEYS, "_draw"])
    numbered = ordered_rank(tied.withColumn("_row", F.monotonically_increasing_id()), [*[F.col(c) for c in KEYS], F.col("_row")], name="_rank")
    first = numbered.groupBy(*KEYS).agg(F.min("_rank").alias("_first"))
    some = numbered.join(first, KEYS).join(left, KEYS)
    return whole.unionAll(again(some, F.col("_passes") + (F.col("_rank") - F.col("_first") < F.col("_more")).cast("long")))
