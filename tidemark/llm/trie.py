"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is a row of turn digests. Rows are dealt and sorted by range of (digests, conv_id), so a group of
copies is cut between tasks like any other rows. Neighbours share a prefix of some length (LCP). A task takes its
edges in descending depth and merges components by union-find: every merge at a new depth is a branching node,
and a node's figures are sums over the components that meet in it. Nodes whose rows reach neither end of the task
are final. The others form one chain at each end; each chain node keeps only what its final children brought, so a
task's open forest is contracted to at most one item a depth and end. The contracted forests of all tasks, in order,
are a short list of the same kind, which the same merge finishes across the boundaries on the driver: its size
depends on the number of tasks and the depth of conversations, not on the number of rows. Runs of unary nodes are
written out from the counts of their lower end, which has the same members.

The digest of the members that end at a node runs over sorted ids: within a task where it is whole, else over the
ids' pieces of up to ``PIECE`` ids that the tasks leave, streamed in order; this is one pass by its definition.

Defined results: rows without a conv_id belong to no conversation; null roles and texts are empty; turns with
equal numbers are ordered by role and digest; repeated rows are turns of their own; remainders of negative ids
are negative; empty tables give an empty result; other columns are not read. One conversation's turns are one row
of digests (32 bytes a turn).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.lineage import settle

EVERY, MOST = 100, 6
PIECE = 1 << 16
NONE = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
FIELDS = [c.split()[0] for c in NODE.split(", ")]
PARTS = f"{NODE}, open_part long, open_item long, ends string, first long, ids binary, forest binary"
PART_FIELDS = [c.split()[0] for c in PARTS.split(", ")]
PART_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in PARTS.split(", ")]
FAR = (1 << 63) - 1


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as structs of digest and code points."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"),
                    F.char_length(text).cast("long").alias("size"))
    return turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")) \
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")) \
        .select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))


def rebuilt(whole: DataFrame) -> DataFrame:
    """Every conversation with its first turns exchanged for those of the first one of its hundred."""
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    heads = whole.filter(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST - 1).alias("head"))
    own = F.slice(F.col("turns"), n + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice(F.coalesce(F.col("head"), F.slice("turns", 1, 0)), F.lit(1), n)
    return whole.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("turns"))


@dataclass
class Component:
    """Rows that share a prefix of ``depth`` turns, and what the children met so far add up to."""

    depth: int
    sums: list[int]  # summed code points of the first 0, 1, ... turns
    n: int = 0
    low: int = FAR
    children: int = 0
    leaves: int = 0
    below: int = 0
    ends: str = ""  # digest of the members that end here; "?..." names a run whose ids are in pieces
    open_: tuple[bool, bool] = (False, False)  # whether its rows reach the first and the last one
    node: int = 0  # number of the node, for children to name their parent
    item: tuple[int, int] | None = None  # the open item it comes from
    chain: list[Component] = field(default_factory=list)  # open nodes inside, deepest first: those at the start
    tail: list[Component] = field(default_factory=list)  # and those at the end

    def own(self, depth: int) -> int:
        return (self.n - 1) * (self.sums[depth] - self.sums[depth - 1]) if depth else 0


class Forest:
    """Merges neighbouring components in descending depth of the edges between them."""

    def __init__(self, parts: Sequence[Component], edges: Sequence[int], keep_open: bool):
        self.parent = list(range(len(parts)))
        self.top: list[Component] = list(parts)
        self.nodes: list[int] = []  # union-find over node numbers
        self.ready: list[tuple[Component, int, int]] = []  # closed nodes: component, depth of its parent, parent's node
        self.low: dict[int, Component] = {}
        self.items: dict[tuple[int, int], int] = {}  # node of each open item met
        self.keep_open = keep_open
        for c in parts:
            self._number(c)
        for k in sorted(range(len(edges)), key=edges.__getitem__, reverse=True):
            a, b = self.find(self.parent, k), self.find(self.parent, k + 1)
            left, right = self.lift(self.top[a], edges[k]), self.lift(self.top[b], edges[k])
            self.parent[b] = a
            self.top[a] = self.join(left, right)

    @staticmethod
    def find(parent: list[int], k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def _number(self, c: Component) -> None:
        c.node = len(self.nodes)
        self.nodes.append(c.node)
        if c.item is not None:
            self.items[c.item] = c.node

    def lift(self, c: Component, depth: int) -> Component:
        """The component as part of the node at ``depth``: deeper ones become its child."""
        if c.depth == depth:
            return c
        up = Component(depth, c.sums, open_=c.open_)
        self._number(up)
        if self.keep_open and any(c.open_):
            bare = Component(c.depth, c.sums, c.n, c.low, c.children, c.leaves, c.below, c.ends, c.open_, c.node)
            # A node that reaches one end hangs on that end's chain.
            up.chain, up.tail = (c.chain + [bare], []) if c.open_[0] else ([], c.tail + [bare])
            return up
        self.ready.append((c, depth, up.node))
        up.n, up.low, up.children = c.n, c.low, 1
        up.leaves = c.leaves if c.children else 1
        up.below = c.below + c.own(c.depth) + (c.n - 1) * (c.sums[c.depth - 1] - c.sums[depth])
        return up

    def join(self, a: Component, b: Component) -> Component:
        """One node of two parts at the same depth."""
        ra, rb = self.find(self.nodes, a.node), self.find(self.nodes, b.node)
        self.nodes[rb] = ra
        return Component(a.depth, a.sums, a.n + b.n, min(a.low, b.low), a.children + b.children, a.leaves + b.leaves, a.below + b.below,
                         a.ends or b.ends, (a.open_[0] or b.open_[0], a.open_[1] or b.open_[1]), ra, None, a.chain or b.chain, a.tail or b.tail)

    def name(self, c: Component) -> None:
        self.low[self.find(self.nodes, c.node)] = c

    def rows(self, open_nodes: dict[int, tuple[int, int]]) -> Iterator[tuple]:
        """Rows of the closed nodes and the unary ones above them; (open part, open item) where the parent is open."""
        for c, _, _ in self.ready:
            self.name(c)
        for c, above, parent in self.ready:
            root = self.find(self.nodes, parent)
            known = self.low.get(root)
            there = open_nodes.get(root, (None, None)) if known is None else (None, None)
            saved = c.below + c.own(c.depth)
            for d in range(c.depth, above, -1):
                deepest, first = d == c.depth, d == above + 1
                yield (c.low, d, (known.low if known else None) if first else c.low, c.n, c.children if deepest else 1,
                       c.leaves if c.children else 1, saved, (c.ends or NONE) if deepest else NONE, *(there if first else (None, None)))
                saved += c.own(d - 1)


def common(a: Sequence, b: Sequence) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def run_key(seq: Sequence[bytes]) -> str:
    return "?" + hashlib.sha256(b"".join(seq)).hexdigest()


def _sums(sizes: Sequence[int]) -> list[int]:
    out = [0]
    for s in sizes:
        out.append(out[-1] + s)
    return out


def _record(**columns) -> dict:
    return columns


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in records], t) for c, t in zip(PART_FIELDS, PART_TYPES)], names=PART_FIELDS)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's final nodes, its contracted forest, and the ids of the runs at its two ends.

    Copies of one sequence are one component from the start, as their edges are the deepest of all.
    """
    part = TaskContext.get().partitionId()
    parts: list[Component] = []
    edges: list[int] = []
    seq = first_seq = None
    ids: list[int] = []
    digest, n_runs, pending = hashlib.sha256(), 0, []

    def flush(key: str) -> dict:
        return _record(ends=key, first=ids[0], ids=",".join(map(str, ids)).encode())

    def finish_run(last: bool) -> Iterator[dict]:
        """Close the run of copies ``seq``: a whole run is digested, one at an end of the task leaves its ids."""
        key = run_key(seq)
        if n_runs == 0 or last:
            yield from pending
            if ids:
                yield flush(key)
            parts[-1].ends = key
        else:
            for p in pending:
                digest.update(p["ids"] + b",")
            digest.update(",".join(map(str, ids)).encode())
            parts[-1].ends = digest.hexdigest()

    for batch in batches:
        for conv_id, turns, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digests", "sizes"))):
            if turns != seq:
                if seq is not None:
                    out = list(finish_run(False))
                    if out:
                        yield _batch(out)
                    n_runs += 1
                    edges.append(common(seq, turns))
                else:
                    first_seq = turns
                seq, ids, pending, digest = turns, [], [], hashlib.sha256()
                parts.append(Component(len(turns), _sums(sizes)))
            elif len(ids) == PIECE:
                if n_runs == 0:
                    yield _batch([flush(run_key(seq))])
                else:  # whether it is the last run shows at its end
                    pending.append(flush(run_key(seq)))
                ids = []
            ids.append(conv_id)
            parts[-1].n += 1
            parts[-1].low = min(parts[-1].low, conv_id)
    if seq is None:
        return
    yield _batch(list(finish_run(True)))
    parts[0].open_, parts[-1].open_ = (True, len(parts) == 1), (len(parts) == 1, True)
    forest = Forest(parts, edges, keep_open=True)
    top = forest.top[Forest.find(forest.parent, 0)]
    left, right = top.chain, top.tail
    items = [*left, top, *reversed(right)]
    open_nodes = {Forest.find(forest.nodes, c.node): (part, k) for k, c in enumerate(items)}
    records = []
    for row in forest.rows(open_nodes):
        records.append(dict(zip([*FIELDS, "open_part", "open_item"], row)))
        if len(records) == 4096:
            yield _batch(records)
            records = []
    kept = [(c.depth, c.n, c.low, c.children, c.leaves, c.below, c.ends) for c in items]
    sums = (parts[0].sums, parts[-1].sums)
    records.append(_record(forest=pickle.dumps((part, first_seq, seq, parts[0].low, len(left), kept, sums))))
    yield _batch(records)


def _merge(forests: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows of the nodes that reach over tasks' boundaries, and (part, item, conv_id) of every open node."""
    parts, edges, before = [], [], None
    for part, first_seq, last_seq, _, n_left, kept, (first_sums, last_sums) in sorted(forests, key=lambda f: (f[1], f[3])):
        for k, (depth, n, low, children, leaves, below, ends) in enumerate(kept):
            if k:
                edges.append(min(kept[k - 1][0], depth))
            elif before is not None:
                edges.append(common(before, first_seq))
            sums = first_sums if k <= n_left else last_sums
            parts.append(Component(depth, sums, n, low, children, leaves, below, ends, item=(part, k)))
        before = last_seq
    if not parts:
        return [], []
    forest = Forest(parts, edges, keep_open=False)
    top = forest.top[Forest.find(forest.parent, 0)]
    root = forest.lift(top, 0)
    forest.name(root)
    rows = [r[:8] for r in forest.rows({})]
    rows.append((root.low, 0, None, root.n, root.children, root.leaves if root.children else 1, root.below, root.ends or NONE))
    named = [(part, k, forest.low[Forest.find(forest.nodes, node)].low) for (part, k), node in forest.items.items()]
    return rows, named


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each run, which come together and in order."""
    key, digest = None, None
    for batch in batches:
        out = []
        for ends, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist()):
            if ends != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = ends, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())],
                                         names=["ends", "whole"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["ends", "whole"])


def trie_nodes(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rows of ``sequences`` (conv_id, turns: digest and size)."""
    spark = sequences.sparkSession
    flat = settle(sequences.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes")))
    grown = settle(flat.repartitionByRange("digests", "conv_id").sortWithinPartitions("digests", "conv_id").mapInArrow(_grow, PARTS))
    # One contracted forest for each task.
    forests = [pickle.loads(r["forest"]) for r in grown.filter("forest IS NOT NULL").select("forest").collect()]
    rows, named = _merge(forests)
    pieces = grown.filter("ids IS NOT NULL").select("ends", "first", "ids")
    runs = pieces.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(_digest_pieces, "ends string, whole string")
    crossing = spark.createDataFrame(rows, NODE).join(runs, F.col("ends_sha256") == F.col("ends"), "left") \
        .withColumn("ends_sha256", F.coalesce("whole", "ends_sha256")).select(*FIELDS)
    parents = spark.createDataFrame(named, "open_part long, open_item long, open_conv long")
    closed = grown.filter("depth IS NOT NULL").join(parents, ["open_part", "open_item"], "left") \
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "open_conv")).select(*FIELDS)
    return closed.unionAll(crossing)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return trie_nodes(rebuilt(conversations(turns)))
