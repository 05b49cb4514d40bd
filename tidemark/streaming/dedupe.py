"""Time-bounded request de-duplication, batch-exact and streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.cleaning import neighbours
from tidemark.session import importable
from tidemark.sources.lineage import settle
from tidemark.streaming.drift import run_to_table

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def request_key(provider: Column, prompt: Column) -> Column:
    return F.md5(F.concat_ws(":", provider, prompt))


def ttl_dedupe(requests: DataFrame, key: str = "k", ts: str = "ts", ttl_seconds: int = 3600) -> DataFrame:
    """Mark each request as a fresh call or a reuse of an answer stored less than ``ttl`` ago.

    The window of a stored answer starts at the call that stored it, so fresh
    calls form a chain: each one is the first request at least ``ttl`` after the
    one before.  A key can hold a third of all requests, so no key is folded in
    one task: the successor of every request is found by time slice, and the
    chain is followed by pointer doubling on (key, time) equi-joins, in about
    log2(chain length) rounds, each settled to a table.
    """
    limit = ttl_seconds * 1_000_000
    rows = requests.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    points = settle(rows.select(key, "_t").distinct())
    # Probes ask for the first request at or after t + ttl; at equal times they sort before it.
    none = F.lit(None).cast("bigint")
    asked = (points.select(key, F.col("_t").alias("_at"), F.lit(1).alias("_kind"), F.col("_t").alias("pt"), none.alias("_src"))
             .unionByName(points.select(key, (F.col("_t") + limit).alias("_at"), F.lit(0).alias("_kind"), none.alias("pt"),
                                        F.col("_t").alias("_src"))))
    near = neighbours(asked, ["pt"], [key], ["_at", "_kind"], F.floor(F.col("_at") / limit))
    jump = settle(near.where("_src IS NOT NULL AND next_pt IS NOT NULL").select(
        key, F.col("_src").alias("_t"), F.col("next_pt").alias("_n")))
    span = points.groupBy(key).agg(F.min("_t").alias("a"), F.max("_t").alias("b"), F.count(F.lit(1)).alias("n"))
    longest = span.agg(F.max(F.least(F.col("n"), F.floor((F.col("b") - F.col("a")) / limit) + 1))).first()[0] or 1
    marks = points.groupBy(key).agg(F.min("_t").alias("_t"))
    reach = 1
    while reach < longest:
        # Positions 0..reach-1 are marked; shift them by ``reach``.
        moved = marks.join(jump, [key, "_t"]).select(key, F.col("_n").alias("_t"))
        marks = settle(marks.unionByName(moved))
        reach *= 2
        if reach < longest:
            then = jump.select(key, F.col("_t").alias("_n"), F.col("_n").alias("_m"))
            jump = settle(jump.join(then, [key, "_n"]).select(key, "_t", F.col("_m").alias("_n")))
    fresh = marks.withColumn("_fresh", F.lit(1))
    return rows.join(fresh, [key, "_t"], "left").withColumn("fresh", F.col("_fresh").isNotNull()).drop("_t", "_fresh")


class FreshCalls(StatefulProcessor):
    """Marks the requests of one key in time order, once the watermark says that no earlier one can come.

    State per key: the time of the answer stored last, and the requests that wait for the watermark. One event-time
    timer stands at the earliest waiting request, or where the stored answer expires and the state can go.
    """

    def __init__(self, fields: Sequence[str], schema: str, key: str, limit: int):
        self.fields, self.schema, self.key, self.limit = list(fields), schema, key, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "t bigint")
        self.waiting = handle.getListState("waiting", self.schema)

    def _wake_at(self, micros: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).iloc[:, 2:]  # after key and time, in the order of ``fields``
        earliest = int(came.iloc[:, -1].min())
        if self.waiting.exists():
            earliest = min(earliest, min(r[-1] for r in self.waiting.get()))
        self.waiting.appendList([tuple(r) for r in came.astype(object).where(came.notna(), None).to_numpy()])
        self._wake_at(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        at = len(self.fields) - 1
        stored = self.stored.get()[0] if self.stored.exists() else None
        waiting = sorted(self.waiting.get(), key=lambda r: r[at]) if self.waiting.exists() else []
        due = [tuple(r) for r in waiting if r[at] <= passed]
        later = [tuple(r) for r in waiting[len(due):]]
        fresh = []
        for r in due:
            if stored is None or r[at] >= stored + self.limit:
                stored = r[at]
            fresh.append(r[at] == stored)
        if stored is not None and not later and stored + self.limit <= passed:
            self.stored.clear()
        elif stored is not None:
            self.stored.update((stored,))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake_at(later[0][at])
        elif self.stored.exists():
            self._wake_at(stored + self.limit)
        if due:
            out = pd.DataFrame(due, columns=self.fields)
            yield out.assign(fresh=fresh, **{self.key: key[0]})

    def close(self) -> None:
        pass


def ttl_dedupe_stream(requests: DataFrame, key: str = "k", ts: str = "ts", ttl_seconds: int = 3600,
                      delay: str = "1 hour") -> DataFrame:
    """Streaming form of ``ttl_dedupe``: the same marks, each row given out once the watermark has passed it.

    Requests may come in any order within ``delay``; later ones are dropped by Spark as late. A repeat after the
    limit is a fresh call, whose answer is stored anew. State is held by key in the state store (RocksDB), so
    a restart from the checkpoint goes on where the last batch ended; a key whose answer expired leaves no state.
    The rule is a chain in time, so the requests of one key within ``delay`` meet in one task.
    """
    importable(requests.sparkSession)
    rows = requests.withWatermark(ts, delay).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    fields = [f for f in rows.schema.fields if f.name not in (key, ts)]  # the time in microseconds is the last
    rows = rows.select(key, ts, *[f.name for f in fields])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    kind = requests.schema[key].dataType.simpleString()
    marked = rows.groupBy(key).transformWithStateInPandas(
        FreshCalls([f.name for f in fields], schema, key, ttl_seconds * 1_000_000), f"{schema}, fresh boolean, `{key}` {kind}",
        outputMode="append", timeMode="EventTime")
    back = F.timestamp_micros("_t").cast(requests.schema[ts].dataType)
    return marked.withColumn(ts, back).select(*requests.columns, "fresh")


def run_stateful(stream: DataFrame, path: str, checkpoint: str) -> str:
    """``run_to_table`` with the state store that timers need; the session's own setting is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        return run_to_table(stream, path, checkpoint)
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)
