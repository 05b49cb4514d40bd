"""Removal of byte strings of a fixed length that occur more than once in the corpus: winnowed anchors and hash groups.

A full suffix array writes a name and a place for every byte on every level of its recursion, many times the input.
Nothing is sorted or ranked here: anchors are chosen by content, so that equal strings have their anchors at equal
places. The anchor of a start is the place of the least 16-byte hash among the next ``WINDOW`` ones, so the starts
of one anchor are a run that ends at it. Anchors are grouped by the hash of the bytes that all their starts cover;
those whose hash occurs once are dropped, with all their starts. Of the others, those that agree with another one
over the bytes of all their starts are settled at once. The starts of the rest, and of one of each settled kind
with the same hash, are compared each by the hash of its own ``length`` bytes.

Equality is that of 64-bit hashes over the exact bytes, always together with the anchor's 64-bit hash.

Defined results: null texts count as empty; texts shorter than ``length`` keep all; equal texts of that length at
least are removed whole; rows that repeat a document are copies of each other; overlaps within one text count;
empty tables give empty results; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.minhash import BASE, U, _powers, mix, text_slices
from tidemark.sources.lineage import settle

LENGTH = 400
GRAM, WINDOW = 16, 128
CORE = LENGTH - WINDOW + 1  # bytes after an anchor that all its starts cover
SLICE = 1 << 22  # bytes of texts after which a batch of cut ones is handed on


class Prefix:
    """Hashes of any substring from prefix sums of one text's bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * self.up[:-1], dtype=U)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + U(BASE) * (end - start).astype(U))


def anchors(data: np.ndarray, prefix: Prefix, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the starts 0..n-length, ascending, and the first start of each."""
    n = len(data)
    at = np.arange(n - GRAM + 1)
    h = prefix(at, at + GRAM) & ~U((1 << 20) - 1)
    starts = n - length + 1
    # The least of a window, the last of equal ones, by doubling: low bits hold the place.
    low = h[: starts + WINDOW - 1]
    place = np.arange(len(low))
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        a, b = low[:-step], low[step:]
        right = b <= a
        low, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])
        width += step
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    return place[first], first


def _sample(length: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column("text_id").to_numpy()
            for a, b, data, bounds in text_slices(batch, "text"):
                for k in range(b - a):
                    one = data[bounds[k]: bounds[k + 1]]
                    if len(one) < length:
                        continue
                    prefix = Prefix(one)
                    at, first = anchors(one, prefix, length)
                    last = np.append(first[1:], len(one) - length + 1) - 1  # last start of the anchor
                    core = prefix(at, at + (length - WINDOW + 1))
                    whole = prefix(first, last + length) ^ mix((at - first).astype(U) * U(1 << 32) + (last - first).astype(U))
                    out.append((np.full(len(at), ids[a + k]), first, last, core.view(np.int64), whole.view(np.int64)))
                    if sum(len(x[0]) for x in out) > 50_000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return sample


NAMES = ["text_id", "first", "last", "core", "whole"]


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()).cast(t) for c, t in zip(cols, kinds)], names=NAMES)


def _list(column: pa.Array, k: int) -> np.ndarray:
    item = column[k].values
    return item.to_numpy(zero_copy_only=False).astype(np.int64) if item is not None else np.zeros(0, np.int64)


def _windows(length: int):
    """Hash of every start in the given runs of each text."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                prefix = Prefix(np.frombuffer(text.as_py().encode(), dtype=np.uint8))
                first, last, core = (_list(batch.column(c), k) for c in ("first", "last", "core"))
                n = last - first + 1
                s = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                key = mix(prefix(s, s + length) ^ mix(np.repeat(core.view(U), n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), batch.column("text_id")[k].as_py())), pa.array(s.astype(np.int32)), pa.array(key.view(np.int64))],
                    names=["text_id", "start", "key"])

    return windows


def _cut(length: int):
    """What is left of each text without the bytes of its repeated starts, given as runs (first, last), and what went."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edge, _list(batch.column("first"), k), 1)
                np.add.at(edge, _list(batch.column("last"), k) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out.append((batch.column("doc_id")[k].as_py(), len(data), turns[::2], turns[1::2], data[~gone].tobytes()))
                size += len(data)
                if size > SLICE:
                    yield _cuts(out)
                    out, size = [], 0
            if out:
                yield _cuts(out)

    return cut


def _cuts(parts: list[tuple]) -> pa.RecordBatch:
    ids, n, start, end, kept = zip(*parts)
    ends = np.cumsum([0, *map(len, start)])
    spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (start, end)], names=["start", "end"])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(kept, pa.binary())],
        names=["doc_id", "n_bytes", "spans", "kept"])


def repeated_starts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_id, first, last): runs of starts whose ``length`` bytes start elsewhere too. Equal texts share their id."""
    sample = settle(texts.mapInArrow(_sample(length), "text_id long, first int, last int, core long, whole long"))
    shared = sample.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    hot = settle(sample.join(shared, "core", "left_semi"))
    kinds = settle(hot.groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("n"), *(F.min_by(c, F.xxhash64("text_id", "first")).alias(c) for c in ("text_id", "first", "last"))))
    settled = hot.join(kinds.filter("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("text_id", "first", "last")
    # One of each kind stands for all that are equal to it.
    several = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("core")
    asked = settle(kinds.join(several, "core", "left_semi").groupBy("text_id").agg(
        *(F.collect_list(c).alias(c) for c in ("first", "last", "core"))))
    asked_texts = texts.join(asked.select("text_id"), "text_id", "left_semi").dropDuplicates(["text_id"])
    windows = settle(asked_texts.join(asked, "text_id").select("text_id", "text", "first", "last", "core")
                     .mapInArrow(_windows(length), "text_id long, start int, key long"))
    again = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    found = windows.join(again, "key", "left_semi").select("text_id", F.col("start").alias("first"), F.col("start").alias("last"))
    return settled.unionAll(found).distinct()


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes of the whole text, the removed spans as byte places, and the kept bytes."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("text_id", F.xxhash64("text"))
    starts = repeated_starts(rows.filter(F.octet_length("text") >= length).select("text_id", "text"), length)
    runs = settle(starts.groupBy("text_id").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")))
    return rows.join(runs, "text_id", "left").select("doc_id", "text", "first", "last") \
        .mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and text, what is left.

    ``n_bytes`` counts the whole text, removed or not. Removal goes by bytes and may leave a part of a character;
    the digest counts it, ``text`` has U+FFFD in its place.
    """
    return cut_repeats(docs, key, text, length).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
