"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

Every word has a sparse random index vector; a word's vector is the sum of those of its neighbours over the whole
corpus. Words are rows of a table of fixed size by hash, so the table (``ROWS_OF_WORDS`` x ``WIDTH`` numbers)
has the same size for every corpus and may be collected and broadcast; no word is left out. A document is the
weighted mean of its words' unit vectors, the mean of their squares, and how alike neighbouring words are. The network is trained on at most ``SAMPLE`` labelled
documents, the only sample taken, and its logits are divided by a temperature fitted on labelled rows that it
did not learn from.

Defined results: null and empty texts are the zero vector and get the network's score for it; documents without
a label are scored like others; without labels of both kinds every score is 0.5; conflicting labels of a document
count both; repeated rows are scored each; empty tables give empty results; source, language, ids and labels are
never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.minhash import BASE, U, _powers, mix, text_slices

ROWS_OF_WORDS, WIDTH = 1 << 16, 64
NEIGHBOURS = (1, 2)
SAMPLE = 20_000
COMMON = 1e-3  # a word with this share of all words weighs half
HIDDEN, EPOCHS, BATCH, STEP, DECAY = 32, 60, 256, 3e-3, 1e-4
SEED = 11
KIND = np.full(256, 2, dtype=np.uint8)  # signs
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of letters and digits or of signs, and the runs' bounds for each text."""
    kind = KIND[data]
    change = np.ones(len(data) + 1, dtype=bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[bounds] = True
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:-1], dtype=U)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), np.searchsorted(starts, bounds)


def _count_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task, as many rows as the table has at most."""
    sums = np.zeros(ROWS_OF_WORDS * WIDTH, dtype=np.int64)
    seen = np.zeros(ROWS_OF_WORDS, dtype=np.int64)
    for batch in batches:
        for _, _, data, bounds in text_slices(batch, "text"):
            if not len(data):
                continue
            hashes, at = tokens(data, bounds)
            row = (hashes % U(ROWS_OF_WORDS)).astype(np.int64)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            seen += np.bincount(row, minlength=ROWS_OF_WORDS)
            more = (hashes >> U(20)) % U(WIDTH)
            less = (more + U(1) + (hashes >> U(30)) % U(WIDTH - 1)) % U(WIDTH)
            more, less = more.astype(np.int64), less.astype(np.int64)
            for k in NEIGHBOURS:
                same = doc[k:] == doc[:-k]
                left, right = np.flatnonzero(same), np.flatnonzero(same) + k
                for here, there in ((left, right), (right, left)):
                    np.add.at(sums, row[here] * WIDTH + more[there], 1)
                    np.add.at(sums, row[here] * WIDTH + less[there], -1)
    rows = np.flatnonzero(seen)
    table = sums.reshape(ROWS_OF_WORDS, WIDTH)
    for a in range(0, len(rows), 8192):
        some = rows[a: a + 8192]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), *(pa.array(table[some, k]) for k in range(WIDTH))],
                                         names=["word", "n", *(f"v{k}" for k in range(WIDTH))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of unit word vectors, each times the word's weight."""
    names = [f"v{k}" for k in range(WIDTH)]
    parts = docs.select("text").mapInArrow(_count_neighbours, "word long, n long, " + ", ".join(f"{c} long" for c in names))
    # One row for each row of the fixed-size table, as columns of numbers.
    got = parts.groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toArrow()
    table = np.zeros((ROWS_OF_WORDS, WIDTH), dtype=np.float32)
    row, n = got.column("word").to_numpy(), got.column("n").to_numpy().astype(np.float64)
    for a in range(0, len(row), 4096):
        v = np.stack([got.column(c).slice(a, 4096).to_numpy() for c in names], axis=1).astype(np.float64)
        weight = COMMON / (COMMON + n[a: a + 4096] / n.sum())
        table[row[a: a + 4096]] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) * weight[:, None]
    return table


POOL_TOKENS = 50_000
FEATURES = 2 * WIDTH + 2  # means, means of squares, likeness of neighbours, length of the mean


def pooled(data: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each text."""
    n = len(bounds) - 1
    out = np.zeros((n, FEATURES))
    if not len(data):
        return out
    hashes, at = tokens(data, bounds)
    row = (hashes % U(ROWS_OF_WORDS)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(at))
    for i in range(0, len(row), POOL_TOKENS):
        v, d = vectors[row[i: i + POOL_TOKENS + 1]], doc[i: i + POOL_TOKENS + 1]
        alike = np.einsum("ij,ij->i", v[1:], v[:-1]) * (d[1:] == d[:-1])
        length = np.sqrt(np.einsum("ij,ij->i", v, v)) + 1e-12
        np.add.at(out[:, -2], d[1:], alike / (length[1:] * length[:-1]))
        v, d = v[:POOL_TOKENS], d[:POOL_TOKENS]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        out[d[first], :WIDTH] += np.add.reduceat(v, first, axis=0)
        out[d[first], WIDTH: 2 * WIDTH] += np.add.reduceat(v * v, first, axis=0)
    out /= np.maximum(np.diff(at), 1)[:, None]
    out[:, -1] = (out[:, :WIDTH] ** 2).sum(axis=1) / np.maximum(out[:, WIDTH: 2 * WIDTH].sum(axis=1), 1e-12)
    return out


def _pool(table):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_slices(batch, "text"):
                flat = pa.array(pooled(data, bounds, table.value).reshape(-1))
                lists = pa.FixedSizeListArray.from_arrays(flat, FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), lists],
                                                 names=[*batch.schema.names[:-1], "features"])

    return pool


def _score(table, network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_slices(batch, "text"):
                s = network.scores(pooled(data, bounds, table.value)) if network else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(s)], names=["row", "score"])

    return score


class Network:
    """Two layers, trained by Adam on weighted log loss; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
        self.w1 = rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)
        self.temperature = 1.0
        xs, ys = self.scaled(x[~held]), y[~held]
        share = ys.mean()
        weight = np.where(ys > 0.5, 0.5 / share, 0.5 / (1 - share))
        params = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(xs))
            for i in range(0, len(order), BATCH):
                k = order[i: i + BATCH]
                h = np.maximum(xs[k] @ self.w1 + self.b1, 0)
                g = (1 / (1 + np.exp(-(h @ self.w2 + self.b2[0]))) - ys[k]) * weight[k] / len(k)
                back = np.outer(g, self.w2) * (h > 0)
                grads = [xs[k].T @ back + DECAY * self.w1, back.sum(axis=0), h.T @ g + DECAY * self.w2, np.array([g.sum()])]
                t += 1
                for p, d, m, s in zip(params, grads, first, second):
                    m += 0.1 * (d - m)
                    s += 0.001 * (d * d - s)
                    p -= STEP * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
        if held.any():
            z, yh = self.logits(x[held]), y[held]
            grid = np.geomspace(0.25, 8, 61)
            self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, z / c) - yh * z / c) for c in grid])])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.scaled(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, table, sample: int = SAMPLE) -> Network | None:
    """The network, from at most ``sample`` labelled documents by the order of a hash of their ids."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("y")) \
        .filter(F.col("y").isin(0.0, 1.0) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id"))) \
        .join(docs.select(F.col("doc_id").alias("label_id")).distinct(), "label_id", "left_semi") \
        .withColumn("draw", F.xxhash64(F.lit(SEED), "label_id")).orderBy("draw", "label_id", "y").limit(sample)
    texts = docs.select(F.col("doc_id").alias("label_id"), "text").join(F.broadcast(known), "label_id") \
        .select("draw", "label_id", "y", "text")
    got = texts.mapInArrow(_pool(table), "draw long, label_id long, y double, features array<double>").toArrow() \
        .sort_by([("draw", "ascending"), ("label_id", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = got.column("features").combine_chunks().flatten().to_numpy().reshape(len(y), FEATURES)
    held = (got.column("draw").to_numpy() % 6) == 0
    return Network(x, y, held if len(set(y[~held])) == 2 else np.zeros(len(y), dtype=bool))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``row`` (all columns of ``docs``), ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    table = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    network = fit_quality(docs, labels, table, sample)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, "text").mapInArrow(_score(table, network), f"row {kind}, score double") \
        .withColumn("held_out", held_out(F.col("row.doc_id"))) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
