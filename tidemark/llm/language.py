"""Language of a text: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are runs of two to four characters of lower-cased words, word edges included; each is a row of a table of
fixed size by hash. A text is the mean of its subwords' rows, and a linear softmax over that mean gives the
languages. Table and softmax are trained by stochastic gradient descent in numpy on at most ``SAMPLE`` labelled
texts, ``PER_LANGUAGE`` of each language, the only sample taken; whole texts are read, as counts of table rows (at
most ``TABLE`` numbers a text). A fifth of them is held back: it sets the temperature, and the score below which
an answer is rejected because the answers kept would be wrong more often than ``MOST_WRONG`` allows.

Defined results: null texts and texts without a letter are ``und`` with score 0; without a labelled text all are;
with one language every text with a letter has it, with score 1; rows without a language or an id are never
learned from; repeated rows are learned once and predicted each; language, source and ids are never inputs of a
prediction; empty tables give empty results; other columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.minhash import BASE, STEPS, U, mix, text_slices

TABLE, WIDTH = 1 << 15, 16
SIZES = (2, 3, 4)
SAMPLE, PER_LANGUAGE = 2_000, 500
EPOCHS, BATCH, STEP = 12, 32, 8.0
MOST_WRONG = 0.01
UNKNOWN = "und"
SEED = 23
AT_ONCE = 1 << 17  # subwords whose rows are gathered together


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table row and text number of every subword, and whether each text has a letter."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    doc = np.concatenate([[0], doc])
    letter = letters()[code]
    has = np.zeros(len(low), dtype=bool)
    has[doc[letter]] = True
    # One mark between words: other characters next to no letter leave.
    near = letter | np.concatenate([letter[1:], [False]])
    kept, doc, letter = np.where(letter, code, 0)[near], doc[near], letter[near]
    kept, doc, letter = np.append(kept, 0).astype(U), np.append(doc, 0), np.append(letter, False)
    rows, of = [], []
    for size in SIZES:
        n = len(kept) - size + 1
        if n <= 0:
            continue
        ok = letter[1: n + 1] if size > 2 else letter[:n] | letter[1: n + 1]
        for k in range(2, size - 1):
            ok = ok & letter[k: n + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), U(size))
        for k in range(size):
            h += (kept[at + k] + U(1)) * STEPS[k]
        rows.append((mix(h * U(BASE)) % U(TABLE)).astype(np.int64))
        of.append(np.where(letter[at], doc[at], doc[at + 1]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(rows), np.concatenate(of), has


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column("text")
    for a, b, _, _ in text_slices(batch, "text"):
        yield a, b, [t or "" for t in texts.slice(a, b - a).to_pylist()]


def pooled(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean table row of each text's subwords, and whether it has a letter."""
    rows, of, has = subwords(texts)
    sums = np.zeros((len(texts), table.shape[1]))
    for i in range(0, len(rows), AT_ONCE):
        r, d = rows[i: i + AT_ONCE], of[i: i + AT_ONCE]
        cuts = np.flatnonzero(np.diff(d, prepend=-1))
        np.add.at(sums, d[cuts], np.add.reduceat(table[r], cuts, axis=0))
    return sums / np.maximum(np.bincount(of, minlength=len(texts)), 1)[:, None], has


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table rows of each text's subwords and the share of each, as bytes."""
    for batch in batches:
        for a, b, texts in slices(batch):
            rows, of, has = subwords(texts)
            order = np.argsort(of, kind="stable")
            rows, cuts = rows[order], np.searchsorted(of[order], np.arange(len(texts) + 1))
            bags = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                row, n = np.unique(rows[i:j], return_counts=True)
                bags.append((row.astype(np.int32).tobytes(), (n / max(j - i, 1)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in ("draw", "lang")),
                 pa.array([x for x, _ in bags], pa.binary()), pa.array([x for _, x in bags], pa.binary()), pa.array(has)],
                names=["draw", "lang", "rows", "shares", "has"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """``names`` of the languages, the subword ``table``, softmax ``weights`` and ``bias``, ``temperature`` and ``floor``."""

    def __init__(self, names: list[str], bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, held: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.names = names
        self.table = rng.uniform(-1, 1, (TABLE, WIDTH)) / WIDTH
        self.weights, self.bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
        self.temperature, self.floor = 1.0, 0.0
        learn = np.flatnonzero(~held)
        steps, done = EPOCHS * -(-len(learn) // BATCH), 0
        for _ in range(EPOCHS):
            order = rng.permutation(learn)
            for i in range(0, len(order), BATCH):
                self._learn([bags[k] for k in order[i: i + BATCH]], y[order[i: i + BATCH]], STEP * (1 - done / steps))
                done += 1
        # The mean of rows times the weights is the mean of rows times weights, narrower for few languages.
        self.narrow = len(names) < WIDTH
        self.view = self.table @ self.weights if self.narrow else self.table
        if held.any():
            self._calibrate(self.logits(np.stack([share @ self.table[row] for row, share in (bags[k] for k in np.flatnonzero(held))])), y[held])

    def _learn(self, bags, y: np.ndarray, step: float) -> None:
        row, share = (np.concatenate(c) for c in zip(*bags))
        cuts = np.cumsum([0, *(len(r) for r, _ in bags)])[:-1]
        x = np.add.reduceat(self.table[row] * share[:, None], cuts, axis=0)
        g = softmax(x @ self.weights + self.bias)
        g[np.arange(len(y)), y] -= 1
        g *= step / len(y)
        back = np.repeat(g @ self.weights.T, np.diff(np.append(cuts, len(row))), axis=0) * share[:, None]
        self.weights -= x.T @ g
        self.bias -= g.sum(axis=0)
        for k in range(WIDTH):
            self.table[:, k] -= np.bincount(row, weights=back[:, k], minlength=TABLE)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Temperature of least log loss, and the least score from which on few enough answers are wrong."""
        grid = np.geomspace(0.05, 20, 121)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / self.temperature)
        score, wrong = p.max(axis=1), p.argmax(axis=1) != y
        order = np.argsort(-score, kind="stable")
        fine = np.flatnonzero(np.cumsum(wrong[order]) <= MOST_WRONG * np.arange(1, len(y) + 1))
        self.floor = float(score[order][fine[-1]]) if len(fine) else 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def answers(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x, has = pooled(texts, self.view)
        p = softmax((x + self.bias if self.narrow else self.logits(x)) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(has, p[np.arange(len(texts)), best], 0.0)
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(best, has)], score, ~has | (score < self.floor)


def _answer(model):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch):
                if model is None:
                    names, score, rejected = [UNKNOWN] * (b - a), np.zeros(b - a), np.ones(b - a, dtype=bool)
                else:
                    names, score, rejected = model.value.answers(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(names, pa.string()), pa.array(score),
                                                  pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return answer


def held_out(doc_id: Column) -> Column:
    """Documents whose language is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model, from at most ``per_language`` texts of a language and ``sample`` in all, by the order of a hash."""
    draw = F.xxhash64(F.lit(SEED), "doc_id", "text")
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("lang", draw.alias("draw"))
    first = Window.partitionBy("lang").orderBy("draw")
    # Repeated rows tie: the ranking keeps them, the grouping makes them one.
    drawn = known.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= F.lit(per_language)) \
        .groupBy("lang", "draw").agg(F.min("place").alias("place")).orderBy("place", "draw", "lang").limit(sample).select("draw", "lang")
    texts = docs.select("doc_id", "lang", "text", draw.alias("draw")) \
        .join(F.broadcast(drawn), ["draw", "lang"]).select("draw", "lang", "text")  # at most ``sample`` rows broadcast
    got = texts.mapInArrow(_bags, "draw long, lang string, rows binary, shares binary, has boolean").dropDuplicates(["draw", "lang"]) \
        .filter("has").toPandas().sort_values(["draw", "lang"], kind="stable")
    if not len(got):
        return None
    names = sorted(set(got["lang"]))
    bags = [(np.frombuffer(r, np.int32), np.frombuffer(s, np.float32)) for r, s in zip(got["rows"], got["shares"])]
    y = np.searchsorted(names, got["lang"].to_numpy())
    held = (got["draw"].to_numpy() % 5) == 0
    return Model(names, bags, y, held if set(y[~held]) == set(y) else np.zeros(len(y), dtype=bool))


def identify(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected.

    ``lang_pred`` is the likeliest learned language; ``rejected`` tells the answers too uncertain to be used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit_languages(rows, sample, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    return rows.select("doc_id", "text").mapInArrow(_answer(shared), "doc_id long, lang_pred string, score double, rejected boolean") \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
