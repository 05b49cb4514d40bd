"""Near-duplicate documents by weighted MinHash over five-word shingles with their counts.

Signatures follow BagMinHash: each shingle has Poisson processes over the discretised weight axis, one for each
cell [0,1), [1,2), [2,4), [4,8) and so on, drawn from a hash of shingle and cell. A point has a time, a signature
component and a place on the axis; it counts in a document where the place lies below the shingle's count there.
A component's value is the first counting time, so two documents agree in it with a chance equal to their
weighted Jaccard similarity. Whole cells share a process, so a shingle needs as many processes as its count has
binary digits, and points later than every component's first one are never drawn.

Documents with equal multisets are one class from the start. Bands of the signature deal the class
representatives to buckets. A bucket's smallest member meets all others; then members of a bucket that are
still in different components meet each other, in blocks. Every link is verified by exact multiset overlap.

Defined results: words are separated by ASCII white space and compared byte for byte; texts of one to four words
have one shingle of all of them; null, empty and blank texts form one class (their multisets are equal); rows are
told apart by their multisets' 128-bit digests, not by id, so rows that repeat an id or have none link like others;
a class without any id has a null class_id; ``near_duplicates`` marks every row that has its class's id as kept,
``one_of_each`` keeps one row; empty tables give empty results; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.sources.lineage import settle

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
SKETCH = -(-BANDS * ROWS // 64)  # 64-bit numbers with one bit of every signature component
BITS = [f"bits_{k}" for k in range(SKETCH)]
BLOCK = 1_024  # members of a bucket that meet in one task
BYTES_AT_ONCE = 1_000_000
SPARE = 3.0  # time allowed beyond the mean need of a signature; documents that need more are drawn again

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in the concatenated texts, and the words' bounds for each text."""
    gap = SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate([[True], gap])
    starts = np.flatnonzero(~gap & (before[:-1] | edge[:-1]))
    after = np.concatenate([gap, [True]])[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:-1], dtype=U)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)), np.searchsorted(starts, bounds)


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every text, sorted within each, and their bounds."""
    hashes, word_bounds = word_hashes(data, bounds)
    n = np.diff(word_bounds)
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(word_bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    last = np.repeat(word_bounds[1:], count)
    out = np.zeros(len(at), dtype=U)
    padded = np.concatenate([hashes, np.zeros(words, U)])
    for k in range(words):
        out += np.where(at + k < last, padded[at + k], U(k)) * STEPS[k % len(STEPS)] + U(k)
    out = mix(out)
    for a, b in zip(out_bounds[:-1].tolist(), out_bounds[1:].tolist()):
        out[a:b].sort()
    return out, out_bounds


def _first_times(doc: np.ndarray, seed: np.ndarray, low: np.ndarray, rate: np.ndarray, weight: np.ndarray,
                 limit: np.ndarray, docs: int, size: int) -> np.ndarray:
    """First counting time of each component, over processes of (document, seed, cell start, cell width, weight)."""
    first = np.full(docs * size, np.inf)
    time, drawn, block = np.zeros(len(doc)), 0, 1
    while len(doc):
        step = mix(seed[:, None] + np.arange(drawn + 1, drawn + block + 1, dtype=U) * U(BASE))
        gaps = -np.log(((step >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / (rate[:, None] * size)
        times = time[:, None] + np.cumsum(gaps, axis=1)
        row, col = np.nonzero(times <= limit[doc][:, None])
        pick = mix(step[row, col] + U(1))
        place = low[row] + rate[row] * ((mix(pick) >> U(11)).astype(np.float64) * 2.0 ** -53)
        counts = place < weight[row]
        slot = doc[row] * size + (pick % U(size)).astype(np.int64)
        np.minimum.at(first, slot[counts], times[row, col][counts])
        time = times[:, -1]
        on = time <= limit[doc]
        doc, seed, low, rate, weight, time = (x[on] for x in (doc, seed, low, rate, weight, time))
        drawn, block = drawn + block, min(block * 2, 256)
    return first.reshape(docs, size)


def signatures(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash signature of each document; infinite for those without shingles."""
    docs = len(bounds) - 1
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    x, doc, weight = shingles[at], doc[at], np.diff(np.append(at, len(shingles))).astype(np.float64)
    parts, cell = [], 0
    keep = np.arange(len(x))
    while len(keep):  # cells 0, 1, 2, 3... start at 0, 1, 2, 4...
        start = 0.0 if cell == 0 else 2.0 ** (cell - 1)
        keep = keep[weight[keep] > start]
        parts.append((doc[keep], mix(x[keep] + U(cell * int(STEPS[0]) % (1 << 64))), np.full(len(keep), start),
                      np.full(len(keep), max(start, 1.0)), weight[keep]))
        cell += 1
    process = [np.concatenate(c) for c in zip(*parts)] if parts else []
    total = np.diff(bounds).astype(np.float64)
    out = np.full((docs, size), np.inf)
    open_, spare = np.flatnonzero(total > 0), SPARE
    while len(open_):
        number = np.full(docs, -1)
        number[open_] = np.arange(len(open_))
        mine = number[process[0]] >= 0
        d, *rest = (c[mine] for c in process)
        got = _first_times(number[d], *rest, (np.log(size) + spare) / total[open_], len(open_), size)
        done = np.isfinite(got).all(axis=1)
        out[open_[done]] = got[done]
        open_, spare = open_[~done], spare * 3
    return out


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, bounds) of runs of rows with about ``BYTES_AT_ONCE`` bytes of text."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BYTES_AT_ONCE, side="right")) - 1)
        yield a, b, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
        a = b


EQUAL = ["n_shingles", "equal_a", "equal_b"]  # what tells multisets apart
EQUAL_TYPES = ", ".join(f"{c} long" for c in EQUAL)


def multiset_keys(shingles: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Size and 128-bit digest of each multiset."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(shingles + U(k)), dtype=U)]) for k in (1, 2)]
    return [pa.array(np.diff(at).astype(np.int64)), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = BANDS * ROWS
    for batch in batches:
        for a, b, data, bounds in text_slices(batch, "text"):
            shingles, at = shingle_hashes(data, bounds)
            bits = signatures(shingles, at, size).view(U).reshape(b - a, BANDS, ROWS)
            band = np.zeros((b - a, BANDS), dtype=U)
            for k in range(ROWS):
                band = mix(band + bits[:, :, k])
            brief = np.zeros((b - a, 8 * SKETCH), dtype=np.uint8)
            packed = np.packbits((mix(bits.reshape(b - a, size)) >> U(63)).astype(np.uint8), axis=1)
            brief[:, : packed.shape[1]] = packed
            brief = brief.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)),
                                             pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "text_key")), *multiset_keys(shingles, at), lists,
                 *(pa.array(np.ascontiguousarray(brief[:, k])) for k in range(SKETCH))],
                names=["doc_id", "text_key", *EQUAL, "bands", *BITS])


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text_slices(batch, "text"):
            shingles, at = shingle_hashes(data, bounds)
            yield pa.RecordBatch.from_arrays(
                [*multiset_keys(shingles, at), pa.array([shingles[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())],
                names=[*EQUAL, "shingles"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    xa, ca = np.unique(a, return_counts=True)
    xb, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def _may_link(a: str, b: str):
    """Whether counts and signature bits of two rows leave the similarity possible.

    Components of documents as similar as asked agree in (1 + similarity) / 2 of their bits; five standard
    deviations less are allowed.
    """
    size, agree = BANDS * ROWS, (1 + SIMILARITY) / 2
    most = size * (1 - agree + 5 * (agree * (1 - agree) / size) ** 0.5)
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in BITS), F.lit(0))
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (differ <= F.lit(int(most))) & (n >= F.lit(SIMILARITY) * m) & (m >= F.lit(SIMILARITY) * n)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [overlap(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)) >= SIMILARITY
                for x, y in zip(b.column("shingles_a").to_pylist(), b.column("shingles_b").to_pylist())]
        yield b.select(["a", "b"]).filter(pa.array(same, pa.bool_()))


def multisets(wanted: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(class_no, shingles) of the classes in ``wanted``, from the text of one row of each."""
    named = classes.select("class_no", *EQUAL, "rep").join(wanted.select("class_no").distinct(), "class_no", "left_semi")
    reps = named.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    texts = rows.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")), "left_semi")
    sets = texts.select("text").mapInArrow(_multisets, f"{EQUAL_TYPES}, shingles binary")
    return named.select("class_no", *EQUAL).join(sets.dropDuplicates(EQUAL), EQUAL).select("class_no", "shingles")


def verified(near: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose multisets overlap enough."""
    sets = settle(multisets(near.select(F.explode(F.array("a", "b")).alias("class_no")), classes, rows))
    return near.join(sets.toDF("a", "shingles_a"), "a").join(sets.toDF("b", "shingles_b"), "b") \
        .select("a", "b", "shingles_a", "shingles_b").mapInArrow(_verify, "a long, b long")


TASK = ["band", "hash", "i", "j", "kind"]
COLUMNS = ["side", "class_no", "component", "n_shingles", *BITS]
MEETING_ROWS = BLOCK  # rows that share a task's group


def meetings(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each meeting of two sides: their rows, and which pairs are in different components, may be as similar
    as asked, and share no earlier band, whose bucket has them too."""
    code = pdf.groupby(TASK, sort=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
    side, _, component, n, *bits = (pdf[c].to_numpy() for c in COLUMNS)
    bits, bands, band = [b.view(U) for b in bits], pdf["bands"].to_numpy(), pdf["band"].to_numpy()
    size, agree = BANDS * ROWS, (1 + SIMILARITY) / 2
    most = size * (1 - agree + 5 * (agree * (1 - agree) / size) ** 0.5)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = order[lo:hi]
        x, y = rows[side[rows] == 0], rows[side[rows] == 1]
        if not len(x) or not len(y):
            continue
        ok = component[x][:, None] != component[y][None]
        n_x, n_y = n[x][:, None], n[y][None]
        ok &= (n_x >= SIMILARITY * n_y) & (n_y >= SIMILARITY * n_x)
        ok &= sum(np.bitwise_count(b[x][:, None] ^ b[y][None]) for b in bits) <= most
        if ok.any() and band[x[0]]:
            of_x, of_y = (np.stack(bands[z])[:, : band[x[0]]] for z in (x, y))
            for k in range(band[x[0]]):
                ok &= of_x[:, k][:, None] != of_y[:, k][None]
        if ok.any():
            yield x, y, ok


def _hopeful(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows that may link to one of the other side."""
    keep = [z[ok.any(axis=1 - k)] for x, y, ok in meetings(pdf) for k, z in enumerate((x, y))]
    return pdf.iloc[np.concatenate(keep) if keep else []]


def units(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and elements of multisets: the n-th copy of a shingle is an element of its own."""
    row = np.repeat(np.arange(len(shingles)), [len(x) for x in shingles])
    x = np.concatenate(shingles)
    start = np.ones(len(x), dtype=bool)
    start[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(start)
    copy = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    return row, mix(x + copy.astype(U) * STEPS[1])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of every left multiset with every right one, as a product of 0/1 tables."""
    (i, x), (j, y) = units(left), units(right)
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, len(names), 8192):
        tables = []
        for rows, row, pos in ((len(left), i, at[: len(x)]), (len(right), j, at[len(x):])):
            here = (pos >= low) & (pos < low + 8192)
            t = np.zeros((rows, min(8192, len(names) - low)), dtype=np.float32)
            t[row[here], pos[here] - low] = 1
            tables.append(t)
        both += tables[0] @ tables[1].T
    whole = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None] - both
    return both / np.maximum(whole, 1)


def _cross(pdf: pd.DataFrame) -> pd.DataFrame:
    """One link for each pair of components that members of the two sides of a meeting join."""
    sets = [np.frombuffer(b, dtype=U) for b in pdf["shingles"]]
    ids, component = pdf["class_no"].to_numpy(), pdf["component"].to_numpy()
    out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
    for x, y, ok in meetings(pdf):
        if ok.sum() > 500:
            ok &= overlaps([sets[k] for k in x], [sets[k] for k in y]) >= SIMILARITY - 1e-6
        i, j = np.nonzero(ok)
        same = np.array([overlap(sets[x[a]], sets[y[b]]) >= SIMILARITY for a, b in zip(i, j)], dtype=bool)
        a, b = x[i[same]], y[j[same]]
        out.append(pd.DataFrame({"a": ids[a], "b": ids[b], "ca": component[a], "cb": component[b]}).drop_duplicates(["ca", "cb"])[["a", "b"]])
    return pd.concat(out)


def cross_links(members: DataFrame, part: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between members of one bucket that the first links leave in different components.

    Members outside the component of the bucket's smallest one meet those inside and each other, in blocks that
    are compared within a task; what comes out is one link for each pair of components and block. Sketches and
    bands join only the rows that meet.
    """
    bucket = ["band", "hash"]
    named = members.join(part, F.col("class_no") == F.col("id"), "left").withColumn("component", F.coalesce("component", "class_no")).drop("id")
    home = part.select(F.col("id").alias("low_id"), F.col("component").alias("home"))
    named = named.join(home, F.col("low") == F.col("low_id"), "left") \
        .withColumn("outside", (F.col("component") != F.coalesce("home", "low")).cast("int"))
    sizes = named.groupBy(*bucket).agg(F.sum("outside").alias("n_out"), F.sum(1 - F.col("outside")).alias("n_in")).filter("n_out > 0")
    blocks = settle(sizes.select(*bucket, "n_out", "n_in", *(
        F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(BLOCK))).cast("int").alias(c) for n, c in (("n_out", "outs"), ("n_in", "ins")))))
    n_dealt = blocks.agg(F.sum(F.col("n_out") * (F.col("ins") + F.col("outs") + 1) + F.col("n_in") * F.col("outs"))).first()[0] or 0
    mixed = named.select("class_no", "component", *bucket, "outside").join(blocks.drop("n_out", "n_in"), bucket) \
        .withColumn("block", F.pmod(F.xxhash64("class_no"), F.when(F.col("outside") == 1, F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    out_blocks, in_blocks = F.sequence(F.lit(0), F.col("outs") - 1), F.sequence(F.lit(0), F.col("ins") - 1)
    # A task compares side 0 with side 1: block i outside with block j inside, or blocks i <= j outside.
    place = lambda x, y, kind, side: F.struct(x.alias("i"), y.alias("j"), F.lit(kind).alias("kind"), F.lit(side).alias("side"))
    me = F.col("block")
    outside = F.concat(
        F.transform(in_blocks, lambda j: place(me, j, 0, 0)),
        F.transform(F.filter(out_blocks, lambda j: j >= me), lambda j: place(me, j, 1, 0)),
        F.transform(F.filter(out_blocks, lambda i: i <= me), lambda i: place(i, me, 1, 1)))
    inside = F.transform(out_blocks, lambda i: place(i, me, 0, 1))
    dealt = mixed.withColumn("to", F.explode(F.when(F.col("outside") == 1, outside).otherwise(inside))).select(
        "class_no", "component", *bucket, "to.*")
    # Small meetings share a task's group, as many groups as the counted rows ask for; a large one is a block of each side.
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64(*TASK), F.lit(int(n_dealt) // MEETING_ROWS + 1)))
    dealt = dealt.join(classes.select("class_no", "n_shingles", *BITS, "bands"), "class_no")
    hopeful = settle(dealt.groupBy("deal").applyInPandas(_hopeful, dealt.schema))
    return hopeful.join(multisets(hopeful, classes, rows), "class_no").groupBy("deal").applyInPandas(_cross, "a long, b long").distinct()


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and (multiset key, group, class_id) of every class of equal multisets.

    Only (class, band, hash) goes through the shuffle on buckets: 24 short rows a class.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    signed = settle(rows.mapInArrow(_sign, f"doc_id long, text_key long, {EQUAL_TYPES}, bands array<long>, "
                                    + ", ".join(f"{c} long" for c in BITS)))
    rep = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    classes = settle(signed.groupBy(*EQUAL).agg(F.min(rep).alias("rep"), *(F.first(c).alias(c) for c in ("bands", *BITS)))
                     .withColumn("class_no", F.monotonically_increasing_id()))
    bucket = ["band", "hash"]
    dealt = classes.filter("n_shingles > 0").select("class_no", F.posexplode("bands").alias(*bucket))
    shared = dealt.groupBy(*bucket).agg(F.min("class_no").alias("low"), F.max("class_no").alias("high")).filter("low < high")
    members = settle(dealt.join(shared.select(*bucket, "low"), bucket))
    sketch = classes.select("class_no", "n_shingles", *BITS)
    met = members.filter("class_no <> low").select(F.col("low").alias("a"), F.col("class_no").alias("b")).distinct() \
        .join(sketch.alias("x"), F.col("b") == F.col("x.class_no")).join(sketch.alias("y"), F.col("a") == F.col("y.class_no"))
    tried = settle(met.filter(_may_link("x", "y")).select("a", "b"))
    links = settle(verified(tried, classes, rows))
    part = settle(components(links))
    more = settle(cross_links(members, part, classes, rows))
    part = settle(components(links.unionAll(more)))
    # Unlinked classes are groups of their own; only linked ones look for the smallest id of their group.
    leader = classes.select("class_no", F.col("rep.doc_id").alias("leader"))
    least = part.join(leader, F.col("id") == F.col("class_no")).groupBy("component").agg(F.min("leader").alias("least"))
    linked = part.join(least, "component").select("id", "component", "least")
    named = classes.select(*EQUAL, "class_no", F.col("rep.doc_id").alias("leader")).join(linked, F.col("class_no") == F.col("id"), "left") \
        .select(*EQUAL, F.coalesce("component", "class_no").alias("group"), F.when(F.col("id").isNull(), F.col("leader")).otherwise(F.col("least")).alias("class_id"))
    return signed, named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), n_shingles, kept."""
    signed, named = _grouped(docs, key, text)
    return signed.select("doc_id", *EQUAL).join(named, EQUAL).select(
        "doc_id", "class_id", "n_shingles", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs``, all its columns, for each class: the one with the smallest id, null last."""
    signed, named = _grouped(docs, key, text)
    rows = signed.groupBy(*EQUAL, "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "n")).alias("pick")
    picked = settle(rows.join(named, EQUAL).groupBy("group").agg(pick).select("pick.*"))
    here = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_text_key"))

    def rows_of(some: str) -> DataFrame:
        return docs.join(picked.filter(some).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")), here, "left_semi")

    return rows_of("n = 1").unionAll(rows_of("n > 1").dropDuplicates([key, text]))
