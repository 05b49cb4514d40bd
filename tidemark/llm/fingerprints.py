"""Document fingerprints from content-defined chunks.

A rolling gear hash over the last 32 bytes decides where a chunk may end. Up to the normal size a stricter
condition holds, beyond it a looser one, so sizes gather around the normal size; an edit moves boundaries only
near it. A fingerprint is the set of chunk digests with their byte lengths. Likeness is containment: the bytes
of a document's chunks that the other one holds too, over all its bytes.

Defined results: null counts as the empty text, whose fingerprint is empty; two empty ones are alike (1), an
empty and another one are not (0); equal texts have equal fingerprints; repeated ids follow each other in the
order of their texts; rows without an id come first; the last document is followed by the first, a single one
by itself; empty tables give empty results; columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST, NORMAL, LARGEST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 8, 4
FIRST_KEY = -(1 << 63)  # of rows without an id
BUCKETS_PER_PARTITION = 8
OUT_ROWS = 500


def _gear_values() -> np.ndarray:
    """One 32-bit number for each byte value, from a multiplicative mixing rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_values()


def rolling_gear(data: bytes) -> np.ndarray:
    """Gear hash of the last 32 bytes at every position: terms double their age, so five shifted sums do."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    h = rolling_gear(data)
    loose_at = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS))) + 1
    strict = loose_at[h[loose_at - 1] < np.uint32(1 << (32 - STRICT_BITS))].tolist()
    loose = loose_at.tolist()
    ends, start, i, j = [], 0, 0, 0
    while n - start > SMALLEST:
        middle, far = start + NORMAL, min(start + LARGEST, n)
        i = bisect_left(strict, start + SMALLEST, i)
        if i < len(strict) and strict[i] < middle:
            start = strict[i]
        else:
            j = bisect_left(loose, middle, j)
            start = loose[j] if j < len(loose) and loose[j] < far else far
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprint(data: bytes) -> dict[int, int]:
    """Digest of each different chunk with its length in bytes."""
    out, start, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in chunk_ends(data):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def containment(mine: dict[int, int], other: dict[int, int]) -> float:
    if not mine or not other:
        return float(not mine and not other)
    return sum(mine[d] for d in mine.keys() & other.keys()) / sum(mine.values())


PAIR = np.dtype([("digest", "<u8"), ("length", "<u2")])


def as_text(print_: dict[int, int]) -> str:
    """Digests in order, each with its length, as base64 of 10-byte records."""
    packed = np.fromiter(sorted(print_.items()), dtype=PAIR, count=len(print_))
    return base64.b64encode(packed.tobytes()).decode()


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")


def _deal(lows: np.ndarray):
    """Add each row's bucket; the first rows of a bucket also go to the one before, which they follow."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(lows, key, side="right") - 1
            first = np.flatnonzero(lows[bucket] == key)
            rows = np.concatenate([np.arange(len(key)), first])
            tail = np.concatenate([np.zeros(len(key), bool), np.ones(len(first), bool)])
            to = np.concatenate([bucket, (bucket[first] - 1) % len(lows)])
            took = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(to, pa.int64()), pa.array(tail)],
                                             names=[*b.schema.names, "bucket", "tail"])

    return deal


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, followers of the bucket last; only the row before is kept in mind."""
    before, out = None, []
    for b in batches:
        for bucket, tail, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            if before is not None and before[0] == bucket and before[1]:
                continue  # its last document has met its follower
            text = text or ""
            mine = fingerprint(text.encode())
            if before is not None and before[0] == bucket:
                _, _, last_id, last, last_print = before
                edited = edited_text(last, text)
                raw = edited.encode()
                other = last_print if edited == last else fingerprint(raw)
                out.append((last_id, len(last), hashlib.sha256(raw).hexdigest(), as_text(last_print), as_text(other),
                            containment(last_print, other), containment(last_print, mine)))
            before = (bucket, tail, doc_id, text, mine)
            if len(out) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RESULT.types)], schema=RESULT)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RESULT.types)], schema=RESULT)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document.

    The order of ids is cut at quantiles of the id column (a few for each shuffle partition, so few numbers reach
    the driver). Texts are shuffled once, by bucket of ids; the first rows of a bucket go to the one before as well.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY)).alias("key"),
                       F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / (BUCKETS_PER_PARTITION * parts) for k in range(1, BUCKETS_PER_PARTITION * parts)]
    low, marks = rows.agg(F.min("key"), F.percentile_approx("key", cuts, 20 * len(cuts))).first()
    if low is None:
        return spark.createDataFrame([], RESULT_DDL)
    lows = np.array(sorted({low, *(marks or [])}), dtype=np.int64)
    dealt = rows.mapInArrow(_deal(lows), "key long, doc_id long, text string, bucket long, tail boolean")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "key", "text") \
        .mapInArrow(_compare, RESULT_DDL)
