"""State that ends by itself: cached answers and admission leases over streams, with event-time timers.

Each is a fold over a tenant's events, the same for a table and for a stream. Over a
stream the state of a tenant lies in the state store, and a timer at the next end of
anything in it clears what is over, so tenants that have gone quiet leave nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .queue import LEASE_MS, WINDOW_MS, Gate

#: Columns of events, times in ms; and of outcomes.
EVENT = "tenant long, seq long, at double, command string, entry string, value string, ttl double"
OUT = "tenant long, seq long, outcome string, value string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cache:
    """A tenant's cached answers: ``put`` with a time to live, ``get``, ``invalidate`` of all."""

    def __init__(self, held: dict | None = None):
        self.held: dict[str, list] = held or {}

    def take(self, at: float, command: str, entry: str, value: str, ttl: float) -> tuple[str, str | None]:
        if command == "put":
            self.held[entry] = [value, at + ttl]
            return "stored", None
        if command == "invalidate":
            self.held.clear()
            return "invalidated", None
        if command != "get":
            return "refused", None
        found = self.held.get(entry)
        return ("hit", found[0]) if found and found[1] > at else ("miss", None)

    def clear(self, at: float) -> None:
        self.held = {k: v for k, v in self.held.items() if v[1] > at}

    def next_end(self) -> float | None:
        return min((v[1] for v in self.held.values()), default=None)


class Admission:
    """A tenant's gate: ``acquire`` and ``renew`` a lease for a user (entry ``user/token``), ``release`` it."""

    def __init__(self, held: dict | None = None, limits: tuple[int, int] = (1, 3), rates: tuple[int, int] = (2, 4)):
        self.gate = Gate(limits, rates)
        for level, key, leases, recent in (held or {}).get("levels", ()):
            self.gate.leases[level, key], self.gate.recent[level, key] = dict(leases), list(recent)

    @property
    def held(self) -> dict:
        keys = {*self.gate.leases, *self.gate.recent}
        levels = [(i, k, self.gate.leases.get((i, k), {}), self.gate.recent.get((i, k), [])) for i, k in sorted(keys)]
        return {"levels": kept} if (kept := [x for x in levels if x[2] or x[3]]) else {}

    def take(self, at: float, command: str, entry: str, value: str, ttl: float) -> tuple[str, str | None]:
        user, _, token = entry.partition("/")
        keys = (f"u{user}", "all")
        if command == "acquire":
            return ("admitted" if self.gate.acquire(at, token, keys, keys) else "full"), None
        if command == "renew":
            return ("renewed" if self.gate.renew(at, token, keys) else "over"), None
        if command == "release":
            self.gate.release(token, keys)
            return "released", None
        return "refused", None

    def clear(self, at: float) -> None:
        self.gate.leases = {k: live for k, v in self.gate.leases.items() if (live := {t: u for t, u in v.items() if u > at})}
        self.gate.recent = {k: live for k, v in self.gate.recent.items() if (live := [t for t in v if t > at - WINDOW_MS])}

    def next_end(self) -> float | None:
        ends = [u for v in self.gate.leases.values() for u in v.values()] + [t + WINDOW_MS for v in self.gate.recent.values() for t in v]
        return min(ends, default=None)


def _told(fold, rows) -> list[tuple]:
    out = []
    for r in rows:
        fold.clear(r.at)
        out.append((r.tenant, r.seq, *fold.take(r.at, r.command, r.entry or "", r.value or "", r.ttl)))
    return out


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def folded(events: DataFrame, kind: Callable = Cache) -> DataFrame:
    """The outcome of each event of a table (EVENT); a task holds what one tenant has open, never its events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, fold = None, None
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                if fold is None or r.tenant != tenant:
                    tenant, fold = r.tenant, kind()
                out += _told(fold, [r])
            yield pd.DataFrame(out, columns=_columns(OUT))

    rows = events.select(*_columns(EVENT)).withColumn("at", F.col("at").cast("double")).withColumn("ttl", F.coalesce(F.col("ttl").cast("double"), F.lit(0.0)))
    return rows.repartition("tenant").sortWithinPartitions("tenant", "at", "seq").mapInPandas(run, OUT)


class Expiring(StatefulProcessor):
    """Keeps a tenant's fold in the state store, with one timer at the next end of something in it."""

    def __init__(self, kind: Callable):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "json string")

    def _fold(self):
        return self.kind(json.loads(self.state.get()[0]) if self.state.exists() else None)

    def _keep(self, fold) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if fold.held:
            self.state.update((json.dumps(fold.held),))
            self.handle.registerTimer(int(fold.next_end()) + 1)
        elif self.state.exists():
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold = self._fold()
        frame = pd.concat(list(rows)).sort_values(["at", "seq"])  # one tenant's events of one batch of the stream
        out = _told(fold, frame.itertuples(index=False))
        self._keep(fold)
        yield pd.DataFrame(out, columns=_columns(OUT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold = self._fold()
        fold.clear(expiredTimerInfo.getExpiryTimeInMs())
        self._keep(fold)
        yield from ()

    def close(self) -> None:
        pass


def use_timers(spark: SparkSession) -> None:
    """Timers need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def streamed(events: DataFrame, kind: Callable = Cache, late: str = "1 minute") -> DataFrame:
    """The same over a stream of EVENT rows, with a watermark of ``late``; call ``use_timers`` before it is started.

    Events that come after the watermark has passed them are not applied.
    """
    rows = events.select(*_columns(EVENT)).withColumn("at", F.col("at").cast("double")).withColumn("ttl", F.coalesce(F.col("ttl").cast("double"), F.lit(0.0)))
    timed = rows.withColumn("_time", F.timestamp_millis(F.col("at").cast("long") + 1)).withWatermark("_time", late)
    return timed.groupBy("tenant").transformWithStateInPandas(Expiring(kind), OUT, "Append", "EventTime")


def once(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Rows of a stream without those that repeat a key within the watermark's delay of the first.

    Of a key, the first row that arrives stays; its state is dropped when the watermark
    has passed it, so a stream of any length keeps a bounded number of keys.
    """
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
