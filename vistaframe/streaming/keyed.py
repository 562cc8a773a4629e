"""Rules with a state on streams whose events come late and out of order, with timers and typed state.

A key's events wait in a map until the watermark has passed them; then they are taken in the order of their times, so
any order of arrival within `late` gives what the sorted table gives. A timer on event time wakes a key without new
events: it lets go of waiting events, and fires what the rule itself has due (an alert's end, a hint). State is typed, so it
survives a changed version of the rule that keeps its fields. It is held in RocksDB, changes only being written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from vistaframe.streaming import machines
from vistaframe.streaming.machines import Machine
from vistaframe.streaming.sensors import PROFILE_DEG, PROFILE_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -(1 << 62)


def _plain(v):
    """Arrays of a state as lists."""
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "shape", ()) else v


class Ordered(StatefulProcessor):
    """One machine over one key's events, in the order of t_ms and then of their other columns."""

    def __init__(self, machine: Machine, state: list[str], schemas: tuple, columns: list[str], gives: list[str], longs: list[str], timer: machines.Timer | None):
        self.machine, self.names, self.schemas, self.columns, self.gives, self.longs, self.timer = machine, state, schemas, columns, gives, longs, timer

    def init(self, handle) -> None:
        state, event = self.schemas
        self.handle = handle
        self.state = handle.getValueState("state", state)
        self.taken = handle.getValueState("taken", StructType([StructField("t", LongType()), StructField("n", LongType())]))
        self.waiting = handle.getMapState("waiting", StructType([StructField("t", LongType()), StructField("n", LongType())]), event)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t, n = self.taken.get() if self.taken.exists() else (NEVER, 0)
        for pdf in rows:
            for row in pdf[self.columns].astype(object).where(pdf[self.columns].notna(), None).itertuples(index=False):
                if row[0] > t:
                    self.waiting.updateValue((int(row[0]), n), (int(row[0]), *row[1:]))
                    n += 1
        self.taken.update((t, n))
        yield from self._take(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, timerValues.getCurrentWatermarkInMs())

    def _take(self, key, passed: int) -> Iterator[pd.DataFrame]:
        t, n = self.taken.get()
        held = list(self.waiting.iterator())
        ready = sorted(((k, v) for k, v in held if k[0] <= passed), key=lambda x: [(v is not None, v) for v in x[1]])
        state = dict(zip(self.names, map(_plain, self.state.get()))) if self.state.exists() else None
        out = []

        def fire(until: int):
            nonlocal state
            while self.timer and state is not None and (due := self.timer.due(state)) is not None and due <= until:
                state, given = self.timer.fire(state)
                out.append((*key, due, *[None] * (len(self.columns) - 1), *(given[g] for g in self.gives), True))

        for k, row in ready:
            fire(k[0])
            e = dict(zip(self.columns, row))
            state, given = self.machine(state, {**e, **{c: None if e[c] is None else int(e[c]) for c in self.longs}})
            out.append((*key, *row, *(given[g] for g in self.gives), False))
            self.waiting.removeKey(tuple(k))
            t = max(t, k[0])
        fire(passed)
        self.taken.update((max(t, passed), n))
        if state is not None:
            self.state.update(tuple(state.get(x) for x in self.names))
        wake = [k[0] for k, _ in held if k[0] > passed]
        if self.timer and state is not None and (due := self.timer.due(state)) is not None:
            wake.append(due)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if wake:
            self.handle.registerTimer(min(wake))
        if out:
            yield pd.DataFrame(out, columns=["_key", *self.columns, *self.gives, "timer"], dtype=object)

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.withColumn("_at", F.timestamp_millis("t_ms")).withWatermark("_at", late)


def ordered(events: DataFrame, key: str, machine: Machine, gives: str | None = None, state: str | None = None, late: str = "10 seconds") -> DataFrame:
    """A stream of events (key, t_ms and what the machine reads) with the machine's outputs and timer: false, or true for
    rows that the passing of time makes, which have only the key, their time and outputs.

    Rows come once the watermark, `late` behind the latest event of all keys, has passed their time; what comes later than that
    is dropped. gives and state are DDL, known for the machines of this package."""
    new = StructType.fromDDL(gives or machines.OUTPUTS[machine]).fields
    kept = StructType.fromDDL(state or machines.STATE[machine])
    columns = ["t_ms", *(c for c in events.columns if c not in (key, "t_ms"))]
    # pandas would make doubles of long values beside nulls
    longs = [f.name for f in events.schema.fields if isinstance(f.dataType, LongType) and f.name in columns[1:]]
    x = _timed(events.withColumns({c: F.col(c).cast("string") for c in longs}), late)
    event = StructType([x.schema[c] for c in columns])
    schema = StructType([StructField("_key", x.schema[key].dataType), *event.fields, *new, StructField("timer", BooleanType())])
    step = Ordered(machine, kept.names, (kept, event), columns, [f.name for f in new], longs, machines.TIMERS.get(machine))
    out = x.groupBy(key).transformWithStateInPandas(step, schema, "Append", "EventTime").withColumnRenamed("_key", key)
    return out.withColumns({c: F.col(c).cast("long") for c in longs}).select(key, *columns, *(f.name for f in new), "timer")


class Profile(StatefulProcessor):
    """Per bin, the points that are or may become its lowest: each older than the next, and not higher than it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.bins = handle.getMapState("bins", StructType([StructField("bin", IntegerType())]), "t array<long>, el array<double>, az array<double>")
        self.now = handle.getValueState("now", StructType([StructField("t", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        now = max(int(pdf.t_ms.max()), self.now.get()[0] if self.now.exists() else NEVER)
        bins = {k[0]: list(zip(*map(_plain, v))) for k, v in self.bins.iterator()}
        before = {b: min(p, key=lambda x: (x[1], x[0])) for b, p in bins.items()}
        for t, el, az in zip(pdf.t_ms.tolist(), pdf.el.tolist(), pdf.az.tolist()):
            bins.setdefault(int(az // PROFILE_DEG) % round(360 / PROFILE_DEG), []).append((t, el, az))
        yield from self._show(key, bins, before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bins = {k[0]: list(zip(*map(_plain, v))) for k, v in self.bins.iterator()}
        before = {b: min(p, key=lambda x: (x[1], x[0])) for b, p in bins.items()}
        yield from self._show(key, bins, before, max(self.now.get()[0], timerValues.getCurrentWatermarkInMs()))

    def _show(self, key, bins: dict, before: dict, now: int) -> Iterator[pd.DataFrame]:
        out, ends = [], []
        for b, points in bins.items():
            fresh, low = [], None
            for p in sorted((p for p in points if p[0] > now - PROFILE_MS), key=lambda x: (-x[0], x[1], x[2])):
                if low is None or p[1] < low[1] or p[1] == low[1] and p[0] < low[0]:  # from the latest back
                    fresh.append(p)
                    low = p
            if low != before.get(b):
                out.append((*key, b, low and low[1], low and low[2], now))
            if fresh:
                self.bins.updateValue((b,), tuple(map(list, zip(*fresh))))
                ends.append(fresh[-1][0] + PROFILE_MS)
            else:
                self.bins.removeKey((b,))
        self.now.update((now,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ends:
            self.handle.registerTimer(min(ends))
        if out:
            yield pd.DataFrame(out, columns=["_key", "bin", "el", "az", "as_of_ms"])

    def close(self) -> None:
        pass


def panorama_profile(points: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of changes (device_id, bin, el, az, as_of_ms) of sensors.panorama_profile over a stream of points (device_id,
    t_ms, az, el): a row where a bin's lowest point changes, null where the bin has had none for 90 s.

    The time that counts is that of the device's latest point, or the watermark's once the device is silent; the latest row
    of each bin is its present state, in whatever order points come."""
    x = _timed(points.select("device_id", "t_ms", "az", "el").where("az IS NOT NULL AND el IS NOT NULL"), late)
    key = StructField("_key", x.schema["device_id"].dataType)
    schema = StructType([key, *StructType.fromDDL("bin int, el double, az double, as_of_ms long").fields])
    out = x.groupBy("device_id").transformWithStateInPandas(Profile(), schema, "Update", "EventTime")
    return out.withColumnRenamed("_key", "device_id")
