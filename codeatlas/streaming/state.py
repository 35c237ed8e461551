"""Traces as keyed state: each span counts once, and a trace's roll-up is kept as its spans come, in whatever order."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..schemas import SPANS

#: Rows of the output: first-seen spans (kind span), and traces as they now stand (kind trace: name is the root's; settled: no span can change it any more).
CHANGES = f"kind string, {SPANS}, ended_ms bigint, settled boolean"
_TRACE = "child boolean, root_started bigint, root_id string, name string, source string, duration_ms double, started_ms bigint, ended_ms double, last_ms bigint"
_STORE = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.allowFAllocate": "false"}


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(f"spark.sql.streaming.stateStore.{k}", None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.streaming.stateStore.{k}") if v is None else spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)


def _first(child: bool, started: int | None, span_id: str | None) -> tuple:
    """The order in which spans stand for their trace, as structs compare in Spark: nulls first, strings by bytes."""
    return child, started is not None, started or 0, span_id is not None, (span_id or "").encode()


class TraceState(StatefulProcessor):
    """State of a trace: the ids of its spans and its roll-up.

    A span whose id is known changes nothing. A new one may become the root (a span without a parent before
    others, then the earliest, then the first by id), move the start and the end, and is passed on. A timer goes
    off when the watermark has passed the trace's last start, so that further spans of that time would be too late:
    the trace is said once more, as settled, and its state goes.
    """

    def __init__(self, columns: list[str], settles: bool = True) -> None:
        self.columns, self.settles = columns, settles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getValueState("trace", _TRACE)
        self.seen = handle.getMapState("seen", "span_id string", "here boolean")

    def _add(self, spans: Iterator[Row]) -> list[Row]:
        now = self.trace.get() if self.trace.exists() else None
        new, ids = [], set()
        for span in spans:
            key = span.span_id
            if key in ids or self.seen.containsKey((key,)):
                continue
            ids.add(key)
            self.seen.updateValue((key,), (True,))
            new.append(span)
            end = None if span.started_ms is None else span.started_ms + (span.duration_ms or 0.0)
            child = span.parent_span_id is not None
            if now is None:
                now = child, span.started_ms, key, span.name, span.source, span.duration_ms, span.started_ms, end, span.started_ms
                continue
            root = (child, span.started_ms, key, span.name, span.source, span.duration_ms) if _first(child, span.started_ms, key) < _first(*now[:3]) else now[:6]
            now = *root, _of(min, now[6], span.started_ms), _of(max, now[7], end), _of(max, now[8], span.started_ms)
        if new:
            self.trace.update(now)
        if new and self.settles:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now[8] or 0)
        return new

    def _standing(self, trace_id: str | None, settled: bool) -> Row:
        _, _, _, name, source, duration, started, ended, _ = self.trace.get()
        known = {"trace_id": trace_id, "name": name, "source": source or "unknown", "duration_ms": duration, "started_ms": started}
        return self._row("trace", known, None if ended is None else int(ended), settled)

    def _row(self, kind: str, values: dict, ended_ms: int | None = None, settled: bool | None = None) -> Row:
        return Row(kind=kind, **{c: values.get(c) for c in self.columns}, ended_ms=ended_ms, settled=settled)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._add(iter([initialState]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = self._add(rows)
        for span in new:
            yield self._row("span", span.asDict())
        if new:
            yield self._standing(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.trace.exists():
            yield self._standing(key[0], True)
            self.trace.clear()
            self.seen.clear()

    def close(self) -> None:
        """Nothing is held but the state."""


def _of(choose, a, b):
    return b if a is None else a if b is None else choose(a, b)


def traced(stream: DataFrame, known: DataFrame, lateness: str | None) -> DataFrame:
    """CHANGES that a stream of spans makes; known are the spans that a new state begins with.

    Spans that started lateness before the latest one come too late and are left out. Without a lateness no span is too
    late, no trace is ever settled, and all state stays.
    """
    columns = StructType.fromDDL(SPANS).names
    if lateness is None:
        return stream.groupBy("trace_id").transformWithState(TraceState(columns, False), CHANGES, "Update", "None", initialState=known.groupBy("trace_id"))
    timed = stream.withColumn("event_time", F.timestamp_millis("started_ms")).withWatermark("event_time", lateness)
    return timed.groupBy("trace_id").transformWithState(TraceState(columns), CHANGES, "Update", "EventTime", initialState=known.groupBy("trace_id"))


# Spark prepares the processor in a Python process of the driver that may not have this package on its path, so its classes travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
