"""Stateful operators that take each key's events in the order of their times, whichever order they arrive in.

Events wait in a list state until the watermark has passed them and are then handled in the order of (time, ingest
number), so a stream sees what a batch over the same events sees; what the watermark would drop is nothing that could
still come before them. One event-time timer a key wakes it for the first event that waits, and, where a key may end, after
its idle time, when all of its state is removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: JSON that comes back as it was: microseconds, and nulls left out.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and maps needs the RocksDB store: it is set unless the session has one already."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKSDB)


def packed(events: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    """keys, ts, seq (the ingest number) and event, the given columns (all if none are given) as JSON. Events without a key
    or a time have no place in any order: they don't come out."""
    event = F.to_json(F.struct(*(columns or [F.col(f"`{c}`") for c in events.columns])), _JSON)
    return events.where(" and ".join(f"`{k}` is not null" for k in [*keys, "ts"])).select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("ingest_seq").cast("long").alias("seq"), event.alias("event"))


def unpacked(rows: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    event = F.from_json("event", schema, _JSON | {"maxStringLen": str(2**31 - 1)})
    return rows.select(event.alias("_e"), *more).select("_e.*", *more)


class Ordered(StatefulProcessor):
    """Calls step() for each event of a key, in order; what it returns are output rows, as tuples of `columns`."""

    columns: list[str] = []
    #: Milliseconds without events after which a key's state goes; None: only with the last event that waits.
    idle_ms: int | None = None

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, event string")
        self.clock = handle.getValueState("clock", "n long, last_us long, timer long")
        self.states = [self.waiting, self.clock, *self.open(handle)]

    def open(self, handle) -> list:
        """Further states."""
        return []

    def begin(self) -> None:
        """Before the first step of a batch."""

    def step(self, key: tuple, n: int, us: int, event: dict, text: str) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self) -> None:
        """After the last step of a batch: write back what step() changed."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for batch in rows:
            us = (batch["ts"].astype("datetime64[ns]").astype("int64") // 1000).tolist()
            new += zip(us, batch["seq"].fillna(0).astype("int64").tolist(), batch["event"].tolist(), strict=True)
        if new:
            self.waiting.appendList(new)
        n, last, timer = self.clock.get() or (0, 0, 0)
        first = min((us for us, _, _ in new), default=0) // 1000 + 1
        if new and (not timer or first < timer):
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.clock.update((n, last, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen_ms = timerValues.getCurrentWatermarkInMs()
        n, last, _ = self.clock.get()
        held = sorted(self.waiting.get() if self.waiting.exists() else ())
        ready = [e for e in held if e[0] // 1000 < seen_ms]
        later, out = held[len(ready) :], []
        if ready:
            self.begin()
            for us, _, event in ready:
                n, last = n + 1, us
                out += self.step(key, n, us, json.loads(event), event)
            self.end()
        if later:
            self.waiting.put(later)
            timer = later[0][0] // 1000 + 1
        else:
            self.waiting.clear()
            timer = last // 1000 + 1 + (self.idle_ms or 0)
        if not later and timer <= seen_ms:
            for state in self.states:
                state.clear()
        else:
            self.handle.registerTimer(timer)
            self.clock.update((n, last, timer))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Sequencer(Ordered):
    """Numbers a session's events."""

    columns = ["session_id", "n", "event"]

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def step(self, key, n, us, event, text):
        return [(key[0], n, text)]


def number_stream(log: DataFrame, idle_s: float = 1800, lateness: str = "10 minutes") -> DataFrame:
    """What enrich.first_event makes of a batch: events (session_id, ts, ingest_seq and any others) with n, the number of
    the event in its session, over both planes. Numbers start again after the idle time."""
    use_rocksdb(log.sparkSession)
    rows = packed(log, ["session_id"]).withWatermark("ts", lateness)
    out = rows.groupBy("session_id").transformWithStateInPandas(Sequencer(int(idle_s * 1000)), "session_id string, n long, event string", "append", "EventTime")
    return unpacked(out, log.schema, "n")


def fuse_stream(tools: DataFrame, syscalls: DataFrame, idle_s: float = 1800, lateness: str = "10 minutes") -> DataFrame:
    """One numbered session log of both planes' streams."""
    return number_stream(tools.unionByName(syscalls, allowMissingColumns=True), idle_s, lateness)


class Correlator(Ordered):
    """The latest destination of a process, for as long as a write may take it."""

    columns = ["event"]

    def __init__(self, ttl_us: int) -> None:
        self.ttl, self.idle_ms = ttl_us, ttl_us // 1000

    def open(self, handle):
        self.dest = handle.getValueState("dest", "us long, ip string, port long")
        return [self.dest]

    def begin(self):
        self.now = self.dest.get() if self.dest.exists() else None

    def step(self, key, n, us, event, text):
        if event.get("syscall") in ("connect", "sendto", "dns"):
            self.now = (us, event.get("dest_ip"), event.get("dest_port"))
        elif event.get("syscall") == "write":
            if not self.now or us - self.now[0] > self.ttl:
                return []
            return [(json.dumps(event | {"dest_ip": self.now[1], "dest_port": self.now[2]}),)]
        return [(text,)]

    def end(self):
        if self.now:
            self.dest.update(self.now)


def correlate_stream(syscalls: DataFrame, ttl_s: float = 5, keys: tuple[str, ...] = ("node", "pid", "start_ts"), lateness: str = "10 minutes") -> DataFrame:
    """What enrich.correlate_writes makes of a batch: a write takes the destination of its process's latest connect or
    sendto within ttl_s; writes without one are dropped. The state of a process is one destination, until ttl_s after its
    last call. Calls of unknown processes (a null key) can't be correlated: their writes are dropped, others pass."""
    use_rocksdb(syscalls.sparkSession)
    # at one time a write comes after what opens its connection
    turn = F.col("ingest_seq").cast("long") + F.when(F.col("syscall") == "write", 1 << 62).otherwise(0)
    known = syscalls.select(*keys, "ts", F.struct(*[F.col(f"`{c}`") for c in syscalls.columns]).alias("_call"), turn.alias("ingest_seq"))
    rows = packed(known, list(keys), *[F.col(f"_call.`{c}`") for c in syscalls.columns]).withWatermark("ts", lateness)
    out = rows.groupBy(*keys).transformWithStateInPandas(Correlator(int(ttl_s * 1_000_000)), "event string", "append", "EventTime")
    unknown = syscalls.where(" or ".join(f"`{k}` is null" for k in keys)).where("coalesce(syscall, '') <> 'write'")
    return unpacked(out, syscalls.schema).unionByName(unknown)
