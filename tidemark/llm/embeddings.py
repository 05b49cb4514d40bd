"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Coarse centres and subspace codebooks are fitted on at most ``SAMPLE`` vectors; every vector is indexed. Inside
its list a vector joins the first leader within half the linking angle, so all members of a cell link to each
other without being compared, and a group of near copies of any size becomes a few cells. Leaders search every
list that may hold a link: the angles from its centre, the plane between the centres, the radii of the cells and
the linking angle bound what it can hold, so no link is lost. Lists are searched in groups of bounded size, each
pair of groups once: table-lookup distances and the error of each code select candidates, exact cosines in double
precision decide. On vectors without clusters few lists are excluded and the search grows with the square of the
cells. Two cells link wholly where angle and radii prove it, not at all where they exclude it; only the members
of cells in between are compared, in blocks. Counts are sums of cell sizes; pairs of members are never written.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are
components of their own; equal vectors count as links of each other; repeated ids are taken as separate vectors
of one id; vectors of different lengths never link; empty tables give empty results; labels are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.sources.lineage import settle

COSINE = 0.9
SAMPLE = 20_000
SUBSPACES, CODES = 8, 64
BLOCK = 4_096  # rows of a list that one task clusters
GROUP = 16_384  # cells on each side of one search task
LEAST_GROUP, LEAST_GROUPS = 512, 8  # smaller tables are dealt to so many groups
MEMBER_BLOCK = 512
ROUNDS = 12
SEED = 5
SLACK = 1e-9
LIMIT = math.acos(COSINE)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(axis=1) / 2
    return np.concatenate([(x[i: i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        for d in range(x.shape[1]):
            sums = np.bincount(at, weights=x[:, d], minlength=len(centres))
            centres[:, d] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, d])
    return centres


class Quantiser:
    """Coarse centres and a codebook for each slice of the residual."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, min(lists, len(sample)))
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.slices = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, s], min(CODES, len(rest))) for s in self.slices]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        at = nearest(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([nearest(rest[:, s], b) for s, b in zip(self.slices, self.books)], axis=1).astype(np.uint8)

    def decoded(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[at] + np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)

    def lookup(self, queries: np.ndarray, at: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances of unit queries to coded vectors with squared norms: one table entry a subspace."""
        dots = np.take((queries @ self.centres.T).astype(np.float32), at, axis=1)
        for k, (s, book) in enumerate(zip(self.slices, self.books)):
            dots += np.take((queries[:, s] @ book.T).astype(np.float32), codes[:, k], axis=1)
        return (1 + norms).astype(np.float32) - 2 * dots


class Bound:
    """Which lists may hold a link of a cell, from the extent of the cells in each list."""

    def __init__(self, centres: np.ndarray, extents: dict):
        self.centres, self.half = centres, (centres ** 2).sum(axis=1) / 2
        norm = np.sqrt(2 * self.half)
        self.axes = centres / np.where(norm > 0, norm, 1)[:, None]
        # Empty lists hold no link.
        low, high, wide = (np.array([extents[k][c] if k in extents else empty for k in range(len(centres))])
                           for c, empty in (("low", np.inf), ("high", -np.inf), ("wide", 0.0)))
        flat = (norm < 1e-6) & np.isfinite(high)  # no direction to measure angles from
        self.low, self.high, self.wide = np.where(flat, -np.inf, low), np.where(flat, np.inf, high), wide
        square = 2 * (self.half[:, None] + self.half[None] - centres @ centres.T)
        self.apart = np.sqrt(np.maximum(square, 0))

    def near(self, x: np.ndarray, radius: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows by lists. Vectors of a list lie on its side of the plane between its centre and any other."""
        reach = (LIMIT + radius + 1e-6)[:, None]
        angle = np.arccos(np.clip(x @ self.axes.T, -1, 1))
        score = x @ self.centres.T - self.half
        beyond = score[np.arange(len(x)), at][:, None] - score
        return (angle - reach <= self.high) & (angle + reach >= self.low) \
            & (beyond <= 2 * np.sin((reach + self.wide) / 2) * self.apart[at] + 1e-6)

    def lists(self) -> np.ndarray:
        """Lists by lists: whether any cells of both may link."""
        angle = np.arccos(np.clip(self.axes @ self.axes.T, -1, 1))
        return angle - LIMIT - 1e-6 <= self.high[:, None] + self.high[None]


class Groups:
    """Lists dealt to groups of cells: large ones to several, small ones together."""

    def __init__(self, counts: list[int]):
        size = min(GROUP, max(LEAST_GROUP, -(-sum(counts) // LEAST_GROUPS)))
        self.first, self.parts, self.n, room = [], [], 0, 0
        for c in counts:
            parts = max(1, -(-c // size))
            if parts > 1 or c > room:
                self.n, room = self.n + parts, size if parts == 1 else 0
            room -= c if parts == 1 else 0
            self.first.append(self.n - parts)
            self.parts.append(parts)
        self.first, self.parts, self.n = np.array(self.first).clip(0), np.array(self.parts), max(1, self.n)
        self.holds = np.zeros((self.n, len(counts)), dtype=np.float32)
        for k, (f, p) in enumerate(zip(self.first, self.parts)):
            self.holds[f: f + p, k] = 1

    def of(self, cell: np.ndarray, at: np.ndarray) -> np.ndarray:
        mixed = cell.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return self.first[at] + (mixed % self.parts[at].astype(np.uint64)).astype(np.int64)


def _vectors(column: pd.Series, width: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, width)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; null where nothing can link."""
    for b in batches:
        out = []
        for v in b.column("vector").to_pylist():
            x = np.array([np.nan if c is None else c for c in v] if v else [], dtype=np.float64)
            top = np.abs(x).max() if len(x) else 0.0
            ok = len(x) > 0 and np.isfinite(x).all() and top > 0
            out.append((lambda y: (y / np.sqrt((y * y).sum())).tobytes())(x / top) if ok else None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _index(quantiser: Quantiser, width: int):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, codes = quantiser.encode(_vectors(b["unit"], width))
            yield b.assign(list=at, codes=[c.tobytes() for c in codes])

    return index


def _lead(width: int):
    """Cells of one block: each vector joins the first leader within half the angle."""
    least = math.cos(math.acos(COSINE) / 2 - 1e-6)

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        x = _vectors(pdf["unit"], width)
        cell, cosine = np.full(len(x), -1), np.ones(len(x))
        open_ = np.arange(len(x))
        while len(open_):
            c = x[open_] @ x[open_[0]]
            near = c >= least
            near[0] = True
            cell[open_[near]], cosine[open_[near]] = open_[0], np.minimum(c[near], 1.0)
            cosine[open_[0]] = 1.0
            open_ = open_[~near]
        return pd.DataFrame({"id": pdf["id"], "copies": pdf["copies"], "unit": pdf["unit"], "cell": pdf["id"].to_numpy()[cell],
                             "angle": np.arccos(cosine), "list": pdf["list"], "codes": pdf["codes"]})

    return lead


def _extent(bound: Bound, width: int):
    """Angles from the list's centre within which each cell lies."""
    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cosine = (_vectors(b["unit"], width) * bound.axes[b["list"].to_numpy()]).sum(axis=1)
            angle = np.arccos(np.clip(cosine, -1, 1))
            yield pd.DataFrame({"list": b["list"], "low": angle - b["radius"], "high": angle + b["radius"], "radius": b["radius"]})

    return extent


def _deal(bound: Bound, groups: Groups, width: int):
    """Each cell to the searches of its own group, and as one that asks to the later groups that may hold its links."""
    meet = np.triu(groups.holds @ bound.lists().astype(np.float32) @ groups.holds.T > 0, 1) | np.eye(groups.n, dtype=bool)
    step = max(1, 16_384 // groups.n)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), step):
                b = whole.iloc[i: i + step]
                at = b["list"].to_numpy()
                own = groups.of(b["cell"].to_numpy(), at)
                near = bound.near(_vectors(b["unit"], width), b["radius"].to_numpy(), at).astype(np.float32) @ groups.holds.T > 0
                row, to = np.nonzero(near & (np.arange(groups.n) > own[:, None]))
                yield b.iloc[row].assign(ask=own[row], has=to, asks=True)
                row, by = np.nonzero(meet[:, own].T)
                yield b.iloc[row].assign(ask=by, has=own[row], asks=False)

    return deal


def _search(quantiser: Quantiser, bound: Bound, width: int):
    """Link state of the cells of two groups, each pair once."""
    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        has = pdf[~pdf["asks"]].sort_values("list")
        same = key[0] == key[1]
        asks = has if same else pdf[pdf["asks"]].sort_values("list")
        out = []
        if len(asks) and len(has):
            x, at = _vectors(has["unit"], width), has["list"].to_numpy()
            codes = _vectors(has["codes"], len(quantiser.books), np.uint8)
            coded = quantiser.decoded(at, codes)
            error, norms = np.sqrt(((x - coded) ** 2).sum(axis=1)), (coded ** 2).sum(axis=1)
            has_id, has_r = has["cell"].to_numpy(), has["radius"].to_numpy()
            half = np.stack([np.cos(has_r / 2), np.sin(has_r / 2)])
            for i in range(0, len(asks), 512):
                some = asks.iloc[i: i + 512]
                q, q_id, q_r = _vectors(some["unit"], width), some["cell"].to_numpy(), some["radius"].to_numpy()
                on = np.flatnonzero(bound.near(q, q_r, some["list"].to_numpy()).any(axis=0)[at])
                # Chord of the linking angle and both radii; a code is off by its error at most.
                turn = (LIMIT + q_r) / 2
                most = (2 * np.stack([np.sin(turn), np.cos(turn)], axis=1) @ half[:, on] + error[on]).astype(np.float32)
                a, b = np.nonzero(quantiser.lookup(q, at[on], codes[on], norms[on]) <= most * most + np.float32(1e-4))
                b = on[b]
                once = q_id[a] < has_id[b] if same else q_id[a] != has_id[b]
                a, b = a[once], b[once]
                # Candidates in slices: wide cells have many.
                for k in range(0, len(a), 65_536):
                    out.append(linked(q, x, q_id, has_id, q_r, has_r, a[k: k + 65_536], b[k: k + 65_536]))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "whole": []}).astype({"a": "int64", "b": "int64", "whole": bool})

    def linked(q, x, q_id, has_id, q_r, has_r, a, b) -> pd.DataFrame:
        cosine = np.einsum("ij,ij->i", q[a], x[b])
        radii = q_r[a] + has_r[b]
        angle = np.arccos(np.clip(cosine, -1, 1))
        single = radii == 0
        whole = np.where(single, cosine >= COSINE, angle + radii <= LIMIT - SLACK)
        part = ~single & ~whole & (angle - radii <= LIMIT + SLACK)
        on = whole | part
        return pd.DataFrame({"a": np.minimum(q_id[a], has_id[b])[on], "b": np.maximum(q_id[a], has_id[b])[on], "whole": whole[on]})

    return search


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the members of two blocks, counted on both sides."""
    for b in batches:
        rows = []
        for r in b.itertuples():
            width = len(r.units_a[0]) // 8
            s = _vectors(pd.Series(r.units_a), width) @ _vectors(pd.Series(r.units_b), width).T >= COSINE
            for ids, copies, hit in ((r.ids_a, r.copies_b, s), (r.ids_b, r.copies_a, s.T)):
                n = hit @ np.asarray(copies, dtype=np.int64)
                rows += [(r.a, r.b, int(i), int(k)) for i, k in zip(np.asarray(ids)[n > 0], n[n > 0])]
        yield pd.DataFrame(rows, columns=["a", "b", "id", "n"])


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    units = settle(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
                   .mapInArrow(_unit, "vec_id long, unit binary"))
    alone = units.filter("unit is null or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    distinct = settle(units.filter("unit is not null and vec_id is not null").groupBy("unit")
                      .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    results = [alone]
    # One pass for each vector length; a table has one as a rule.
    for (bytes_,) in distinct.select(F.length("unit")).distinct().collect():
        results.append(_link_width(spark, units, distinct.filter(F.length("unit") == bytes_), bytes_ // 8, sample))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _link_width(spark, units: DataFrame, distinct: DataFrame, width: int, sample: int) -> DataFrame:
    n = distinct.count()
    picked = distinct.orderBy(F.xxhash64(F.lit(SEED), "unit"), "id").limit(sample).select("unit").toPandas()
    quantiser = Quantiser(_vectors(picked["unit"], width), int(min(1024, max(1, round(n ** 0.5)))))
    indexed = settle(distinct.mapInPandas(_index(quantiser, width), "unit binary, id long, copies long, list long, codes binary"))
    # At most 1,024 lists, so few sizes reach the driver.
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    pieces = F.element_at(F.array(*[F.lit(-(-sizes.get(k, 1) // BLOCK)) for k in range(len(quantiser.centres))]), F.col("list").cast("int") + 1)
    members = settle(
        indexed.withColumn("block", F.pmod(F.xxhash64("id"), pieces)).groupBy("list", "block").applyInPandas(
            _lead(width), "id long, copies long, unit binary, cell long, angle double, list long, codes binary"))
    size = members.groupBy("cell").agg(F.sum("copies").alias("size"), F.max("angle").alias("radius"), F.count(F.lit(1)).alias("vectors"))
    cells = settle(members.filter("id = cell").select("cell", "unit", "list", "codes").join(size, "cell"))
    # One row a list.
    extents = {r["list"]: r for r in cells.select("list", "unit", "radius").mapInPandas(
        _extent(Bound(quantiser.centres, {}), width), "list long, low double, high double, radius double")
        .groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("radius").alias("wide"), F.count(F.lit(1)).alias("n")).collect()}
    bound = Bound(quantiser.centres, extents)
    groups = Groups([extents[k]["n"] if k in extents else 0 for k in range(len(quantiser.centres))])
    schema = "cell long, unit binary, list long, codes binary, radius double, ask long, has long, asks boolean"
    pairs = settle(cells.select("cell", "unit", "list", "codes", "radius").mapInPandas(_deal(bound, groups, width), schema)
                   .groupBy("ask", "has").applyInPandas(_search(quantiser, bound, width), "a long, b long, whole boolean"))
    whole = pairs.filter("whole").select("a", "b")
    piece = F.pmod(F.xxhash64(F.lit(1), "id"), F.ceil(F.col("vectors") / F.lit(MEMBER_BLOCK)))
    partly = pairs.filter("not whole").select("a", "b")
    wanted = partly.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    blocked = members.join(size, "cell").join(wanted, "cell", "left_semi").withColumn("piece", piece) \
        .groupBy("cell", "piece").agg(F.collect_list("id").alias("ids"), F.collect_list("copies").alias("copies"), F.collect_list("unit").alias("units"))
    met = settle(
        partly.join(blocked.select(F.col("cell").alias("a"), F.col("ids").alias("ids_a"), F.col("copies").alias("copies_a"), F.col("units").alias("units_a")), "a")
        .join(blocked.select(F.col("cell").alias("b"), F.col("ids").alias("ids_b"), F.col("copies").alias("copies_b"), F.col("units").alias("units_b")), "b")
        .mapInPandas(_members, "a long, b long, id long, n long"))
    part = components(whole.unionAll(met.select("a", "b").distinct()))
    around = whole.select(F.col("a").alias("cell"), F.col("b").alias("other")).unionAll(whole.select(F.col("b").alias("cell"), F.col("a").alias("other"))) \
        .join(size.select(F.col("cell").alias("other"), "size"), "other").groupBy("cell").agg(F.sum("size").alias("near"))
    own = met.groupBy("id").agg(F.sum("n").alias("extra"))
    placed = settle(
        members.select("id", "unit", "cell").join(size.select("cell", "size"), "cell").join(around, "cell", "left")
        .join(part.withColumnRenamed("id", "cell"), "cell", "left").join(own, "id", "left")
        .select("unit", "id", F.coalesce("component", "cell").alias("group"),
                (F.col("size") - 1 + F.coalesce("near", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n_links")))
    least = placed.groupBy("group").agg(F.min("id").alias("component_id"))
    named = placed.join(least, "group").select("unit", "n_links", "component_id")
    return units.join(named, "unit").filter("vec_id is not null").select("vec_id", "n_links", "component_id")
