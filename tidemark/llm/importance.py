"""Importance resampling towards a target distribution over hashed n-gram buckets.

Words are runs of letters, digits and non-ASCII bytes after A-Z are lower-cased; features are all runs of 1 to
``n`` words joined by one space. Within a batch every feature is interned in an open-addressed NumPy table: its
xxhash64 gives the first slot, a taken slot is accepted only if the key and the bytes are equal, and the next slot
is tried otherwise. A slot holds the feature's bucket and its count, so a feature's bytes are hashed to a bucket
once a batch. Counts leave a task as at most ``BUCKETS`` sums; gains come back as one broadcast array of as many
numbers, and each occurrence gathers its gain by slot id. The draw is the ranking by weight plus keyed Gumbel
noise, placed by range, so no task sees all rows.

Defined results: null, empty and wordless texts have no features, weight 0 and are never drawn unless
``min_words`` is 0; a null id draws as the empty id; ties in score go to the smaller id (null last), then to the
fewer features, and rows equal in all of these share a place in any order; repeated rows count and draw one by
one; an empty target or corpus counts 0 everywhere; empty tables give empty results; other columns are not read.
The largest text bounds a task's memory (about six times its bytes).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.minhash import U, text_slices
from tidemark.operators.ordering import ordered_rank
from tidemark.sources.lineage import settle

BUCKETS = 10_000
AT_ONCE = 1 << 17  # words whose features are interned together
SEED = 2024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
# The primes of xxhash64.
P1, P2, P3 = U(11400714785074694791), U(14029467366897019727), U(1609587929392839161)
P4, P5 = U(9650029242287828579), U(2870177450012600261)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxhash64_rows(rows: np.ndarray) -> np.ndarray:
    """xxhash64 of each row of a byte table under 32 columns wide."""
    n, size = rows.shape
    h = np.full(n, P5 + U(size), dtype=U)
    at = 0
    while at + 8 <= size:
        lane = np.ascontiguousarray(rows[:, at: at + 8]).view("<u8").reshape(n)
        h = _turn(h ^ (_turn(lane * P2, 31) * P1), 27) * P1 + P4
        at += 8
    if at + 4 <= size:
        lane = np.ascontiguousarray(rows[:, at: at + 4]).view("<u4").reshape(n).astype(U)
        h = _turn(h ^ (lane * P1), 23) * P2 + P3
        at += 4
    for k in range(at, size):
        h = _turn(h ^ (rows[:, k].astype(U) * P5), 11) * P1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxhash64 of every span of ``data``; spans of one length are hashed together."""
    keys, sizes = np.zeros(len(starts), dtype=U), ends - starts
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = order[a:b]
        size = int(sizes[some[0]])
        if size < 32:
            keys[some] = xxhash64_rows(data[starts[some][:, None] + np.arange(size)])
        else:
            keys[some] = [xxhash.xxh64_intdigest(data[i: i + size].tobytes()) for i in starts[some].tolist()]
    return keys


def _equal_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans ``a`` and ``b`` hold the same bytes."""
    same = (ends - starts)[a] == (ends - starts)[b]
    left, at = np.flatnonzero(same), 0
    while len(left) and at < 64:
        left = left[(ends - starts)[a[left]] > at]
        differ = data[starts[a[left]] + at] != data[starts[b[left]] + at]
        same[left[differ]] = False
        left, at = left[~differ], at + 1
    for k in left.tolist():  # long features
        i, j = a[k], b[k]
        same[k] = bool((data[starts[i]: ends[i]] == data[starts[j]: ends[j]]).all())
    return same


def intern(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each span in an open-addressed table, and the span that claimed each slot (-1: free)."""
    keys = span_keys(data, starts, ends)
    size = 1 << max(4, (2 * len(keys)).bit_length())
    owner = np.full(size, -1, dtype=np.int64)
    slot = (keys & U(size - 1)).astype(np.int64)
    open_ = np.arange(len(keys))
    while len(open_):
        at = slot[open_]
        free = owner[at] < 0
        owner[at[free]] = open_[free]  # of the spans that meet at a free slot one claims it
        there = owner[at]
        same = keys[there] == keys[open_]
        same[same] = _equal_bytes(data, starts, ends, there[same], open_[same])
        open_ = open_[~same]
        slot[open_] = (slot[open_] + 1) & (size - 1)
    return slot, owner


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased concatenated texts, and the words' bounds for each text."""
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    out = np.concatenate([~inside, [True]])
    starts = np.flatnonzero(inside & (np.concatenate([[True], out[:-2]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (out[1:] | edge[1:])) + 1 if len(data) else starts
    return starts, ends, np.searchsorted(starts, bounds)


def features(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (bytes, starts, ends, text number) of all runs of 1 to ``n`` words of each text."""
    starts, ends, at = words(data, bounds)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for low in range(0, len(starts), AT_ONCE):
        high = min(low + AT_ONCE, len(starts))
        first = max(low - n + 1, 0)
        s, e, d = starts[first:high], ends[first:high], doc[first:high]
        if n == 1:
            yield data, s, e, d
            continue
        sizes = e - s
        to = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        joined = np.full(int((sizes + 1).sum()), 32, dtype=np.uint8)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[np.repeat(to, sizes) + place] = data[np.repeat(s, sizes) + place]
        last = np.arange(low - first, high - first)
        runs = []
        for k in range(n):
            some = last[last >= k]
            some = some[d[some] == d[some - k]]
            runs.append((to[some - k], to[some] + sizes[some], d[some]))
        yield joined, *(np.concatenate(c) for c in zip(*runs))


def _slots(data, starts, ends, buckets):
    """Slot of each span, and the bucket of each slot."""
    slot, owner = intern(data, starts, ends)
    bucket = np.zeros(len(owner), dtype=np.int64)
    used = np.flatnonzero(owner >= 0)
    bucket[used] = [zlib.crc32(data[a:b].tobytes()) % buckets
                    for a, b in zip(starts[owner[used]].tolist(), ends[owner[used]].tolist())]
    return slot, bucket


def _count(n: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, bounds in text_slices(batch, "text"):
                for buffer, starts, ends, _ in features(LOWER[data], bounds, n):
                    slot, bucket = _slots(buffer, starts, ends, buckets)
                    counts = np.bincount(slot, minlength=len(bucket))
                    np.add.at(sums, bucket, counts)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one sum for each bucket and task, ``buckets`` numbers in the end."""
    parts = texts.select("text").mapInArrow(_count(n, buckets), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, both smoothed by one."""
    t_all, s_all, size = float(target.sum()), float(corpus.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
                     for t, s in zip(target.tolist(), corpus.tolist())], dtype=np.int64)


def _weigh(n: int, gain):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gain.value
        for batch in batches:
            for a, b, data, bounds in text_slices(batch, "text"):
                lower = LOWER[data]
                total, weight = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for buffer, starts, ends, doc in features(lower, bounds, n):
                    slot, bucket = _slots(buffer, starts, ends, len(table))
                    total += np.bincount(doc, minlength=b - a)
                    np.add.at(weight, doc, table[bucket][slot])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(words(lower, bounds)[2])), pa.array(total), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10,
             min_words: int = 20, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (1, 2, ... of the drawn, else null).

    ``target`` needs a column ``text``. Of the documents with at least ``min_words`` words, ``percent`` in a
    hundred with the highest scores are drawn.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(target, n, buckets), bucket_counts(rows, n, buckets))
    weighed = rows.mapInArrow(_weigh(n, docs.sparkSession.sparkContext.broadcast(gain)),
                              "doc_id long, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    # Written once, narrow: the ranking reads it twice, for the ranges and for the rows.
    scored = settle(weighed).withColumn("score", F.col("weight") + noise).withColumn("late", F.col("n_words") < F.lit(min_words))
    placed = ordered_rank(scored, [F.col("late"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"),
                                   F.col("weight")], name="place")
    ready = placed.filter(~F.col("late")).count()
    drawn = ~F.col("late") & (F.col("place") < F.lit(percent * ready // 100))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))
