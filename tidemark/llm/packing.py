"""Best-fit packing of token pieces into sequences by a configuration linear program.

Piece lengths are counted; all that follows until the placement works on that histogram, which has at most
``capacity`` rows whatever the data. The linear program over configurations (multisets of lengths that fit a
sequence) is solved by multiplicative weights: the price of a length falls with the share of its stock already
covered, a knapsack by dynamic programming finds the dearest configuration, which then covers some more, until
all is covered. Amounts are rounded to whole sequences; the few pieces left are packed by the same knapsack. Places in the
sequences follow from a piece's rank among those of its length.

Defined results: null and empty texts are one piece that holds only the end token; repeated rows are packed one
by one; ties of length follow a hash; empty tables give empty results; columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import ordered_rank
from tidemark.sources.lineage import settle

CAPACITY = 1024
END_ID = 2
RATE = 1.0  # how fast a price falls with the share covered
LONG = 0.25  # of a sequence: what the longest piece is worth beyond its price in the bound
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of whole texts as bytes, equal to those of the tokenizer file.

    The same vocabulary as ranks is several times faster; it knows no special tokens, so the few texts that
    spell one go to the tokenizer file's own library.
    """

    def __init__(self, json_file: str, ranks_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ordinary = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(json_file)

    def __call__(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids if SPECIAL in text else self.ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(json_file: str, ranks_file: str, pattern: str) -> Encoder:
    """One for each worker process."""
    key = (json_file, ranks_file)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(json_file, ranks_file, pattern)
    return _ENCODERS[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole ones but for a shorter first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, files: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with the checksum of their ids: (doc_id, piece, start, length, ids_crc32)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(*files), np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                view = memoryview(ids)
                out += [(doc_id, k, s, n, zlib.crc32(view[4 * s: 4 * (s + n)]))
                        for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # (index of a length, how many)


def dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> Pattern:
    """Configuration of the highest price: knapsack by dynamic programming over the space used.

    ``lengths`` ascend."""
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = prices
    index = np.zeros(capacity + 1, dtype=np.int64)
    index[lengths] = np.arange(len(lengths))
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for space in range(int(lengths[0]), capacity + 1):
        worth = best[:space][::-1] + price[1: space + 1]
        n = int(worth.argmax())
        if worth[n] > best[space - 1]:
            best[space], pick[space] = worth[n], n + 1
        else:
            best[space] = best[space - 1]
    used: dict[int, int] = {}
    space = capacity
    while space > 0:
        n = int(pick[space])
        if n:
            used[int(index[n])] = used.get(int(index[n]), 0) + 1
        space -= n or 1
    return tuple(sorted(used.items()))


def bound_prices(lengths: np.ndarray, stock: np.ndarray, capacity: int) -> np.ndarray:
    """Prices of which no configuration holds more than ``capacity``, so the stock's worth bounds the sequences needed.

    Pieces shorter than some limit count nothing, and those that only such pieces fit beside count as whole
    sequences; the limit with the highest bound is taken. Zero prices pieces by their length.
    """
    def prices(limit: int) -> np.ndarray:
        return np.where(lengths > capacity - limit, capacity, np.where(lengths >= limit, lengths, 0))

    return max(map(prices, range(capacity // 2 + 1)), key=lambda price: int((price * stock).sum()))


def solve_lp(lengths: np.ndarray, stock: np.ndarray, capacity: int) -> dict[Pattern, float]:
    """Amounts of configurations that cover the stock of every length and use no more of any.

    Multiplicative weights: the prices of the best bound, plus a part for long pieces that falls with the share
    of the length's stock already covered and ends once it is. A round adds its dearest configuration until the
    scarcest length in it is covered, so there are at most as many rounds as lengths.
    """
    base = bound_prices(lengths, stock, capacity)
    covered = np.zeros(len(lengths))
    amounts: dict[Pattern, float] = {}
    while (open_ := np.flatnonzero(covered < 1 - 1e-9)).size:
        prices = base[open_] + LONG * capacity * (lengths[open_] / capacity) ** 2 * np.exp(-RATE * covered[open_])
        pattern = tuple((int(open_[j]), m) for j, m in dearest(lengths[open_], prices, capacity))
        kinds, times = (np.array(x) for x in zip(*pattern))
        add = float(((1 - covered[kinds]) * stock[kinds] / times).min())
        covered[kinds] += add * times / stock[kinds]
        amounts[pattern] = amounts.get(pattern, 0.0) + add
    return amounts


def worth_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Prices by which a fuller configuration always wins; among equally full ones longer pieces do."""
    return lengths + 0.9 * (lengths / capacity) ** 2


def pack_rest(lengths: np.ndarray, stock: np.ndarray, capacity: int) -> dict[Pattern, int]:
    """Whole configurations for all of ``stock``: the longest piece with the fullest choice of others beside it."""
    stock, out = stock.copy(), {}
    while (open_ := np.flatnonzero(stock > 0)).size:
        used = {int(open_[-1]): 1}
        space = capacity - int(lengths[open_[-1]])
        fit = open_[lengths[open_] <= space]
        if len(fit):
            for j, m in dearest(lengths[fit], worth_of(lengths[fit], capacity), space):
                used[int(fit[j])] = used.get(int(fit[j]), 0) + m
            used = {k: int(min(m, stock[k])) for k, m in used.items()}
        space = capacity - sum(int(lengths[k]) * m for k, m in used.items())
        for k in fit[::-1].tolist():  # where the stock had too few
            m = min(space // int(lengths[k]), int(stock[k]) - used.get(k, 0))
            if m > 0:
                used[k] = used.get(k, 0) + m
                space -= m * int(lengths[k])
        times = min(int(stock[k]) // m for k, m in used.items())
        for k, m in used.items():
            stock[k] -= m * times
        pattern = tuple(sorted(used.items()))
        out[pattern] = out.get(pattern, 0) + times
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Configurations, over (length, how many), with the number of sequences of each.

    The program's amounts are rounded up, the largest first, as far as the stock goes; then the few pieces left are packed.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    rest = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    whole: dict[Pattern, int] = {}
    for pattern, amount in sorted(solve_lp(lengths, rest, capacity).items(), key=lambda item: (-item[1], item[0])):
        times = min(int(np.ceil(amount - 1e-9)), *(int(rest[k]) // m for k, m in pattern))
        if times:
            whole[pattern] = times
            for k, m in pattern:
                rest[k] -= m * times
    for pattern, times in pack_rest(lengths, rest, capacity).items():
        whole[pattern] = whole.get(pattern, 0) + times
    return [(tuple((int(lengths[k]), m) for k, m in p), n) for p, n in whole.items()]


def segments(plan: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """For each length the runs of ranks that go to one configuration: first rank, first sequence, pieces a sequence, place."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, m in sorted(pattern, reverse=True):
            rank = given.get(length, 0)
            rows.append((length, rank, sequence, m, offset))
            given[length] = rank + m * times
            offset += m * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"]).sort_values(["length", "rank"])


RANK_BITS = 48


def pack(docs: DataFrame, files: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence."""
    pieces = settle(token_pieces(docs, files, capacity)).withColumn("draw", F.xxhash64("doc_id", "piece", "ids_crc32"))
    ranked = ordered_rank(pieces, [F.col("length"), F.col("draw")])
    # At most one row for each length up to the capacity.
    counts = ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).collect()
    first = {r["length"]: r["first"] for r in counts}
    runs = segments(plan_sequences({r["length"]: r["n"] for r in counts}, capacity))
    codes = (runs["length"].to_numpy() << RANK_BITS) + runs["rank"].to_numpy()
    cols = {c: runs[c].to_numpy() for c in ("length", "rank", "sequence", "each", "offset")}
    starts = np.array([first.get(n, 0) for n in range(capacity + 1)], dtype=np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy()
            rank = b["rank"].to_numpy() - starts[length]
            run = np.searchsorted(codes, (length << RANK_BITS) + rank, side="right") - 1
            past = rank - cols["rank"][run]
            each = cols["each"][run]
            yield b.drop(columns="rank").assign(sequence_id=cols["sequence"][run] + past // each,
                                                offset=cols["offset"][run] + past % each * length)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, schema)


def public_files() -> tuple[str, str, str]:
    """Tokenizer file, the same vocabulary as ranks, and its splitting pattern."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
