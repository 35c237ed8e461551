"""Spans and logs as streams: idempotent upserts into trace tables, retention, and windowed roll-ups."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps
from time import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import traces as T
from ..schemas import LOGS, SPANS, TRACES
from .state import keyed_state, traced


DAY = 86_400_000
_ROLLED = f"{TRACES}, settled boolean"


class TraceStore:
    """Tables of spans, traces and logs under a shared root, partitioned by day, one folder per day and micro-batch.

    A stream of spans goes through keyed state (see TraceState), so a span is written once, and with it
    what its trace now comes to; a trace is read from the last of these few rows and not from its spans.
    A repeated batch takes the place of its first try. Streams are told apart by their checkpoints; a new one begins with
    the spans that earlier ones left. Old days are dropped by name: retention writes nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        """Names of folders: days, streams or retentions, of which there are few."""
        system, folder = self._folder(name)
        return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []

    def _read(self, name: str, schema: str) -> DataFrame:
        if not any(n.startswith("day=") for n in self._names(name)):
            return self.spark.createDataFrame([], f"{schema}, day int, batch bigint")
        return self.spark.read.schema(f"{schema}, day int, batch bigint").parquet(f"{self.root}/{name}")

    def _write(self, name: str, rows: DataFrame, at: str, batch: int) -> None:
        """rows by the day of a column of milliseconds; a batch that comes again replaces its own folders."""
        days = rows.withColumn("day", F.coalesce(F.floor(F.col(at) / DAY), F.lit(0)).cast("int")).withColumn("batch", F.lit(batch))
        days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.root}/{name}")

    def _since(self) -> int | None:
        """From when on traces and logs are kept: the latest retention."""
        return max((int(n) for n in self._names("retained")), default=None)

    def traces(self) -> DataFrame:
        """A row per trace: its last roll-up. Where the state had gone before further spans came, the earlier start names the trace and the later end ends it."""
        rows = self._read("traces", _ROLLED)
        last = F.min_by(F.struct("root_span_name", "source", "duration_ms"), F.struct("started_ms", -F.col("batch"))).alias("t")
        grouped = rows.groupBy("trace_id").agg(last, F.min("started_ms").alias("started_ms"), F.max("ended_ms").alias("ended_ms"))
        out = grouped.select("trace_id", "t.root_span_name", "t.source", "started_ms", "ended_ms", "t.duration_ms")
        since = self._since()
        return out if since is None else out.filter(F.col("started_ms") >= since)

    def spans(self) -> DataFrame:
        rows = self._read("spans", SPANS).drop("day", "batch")
        return rows if self._since() is None else rows.join(self.traces().select("trace_id"), "trace_id", "left_semi").select(rows.columns)

    def logs(self) -> DataFrame:
        rows, since = self._read("logs", LOGS).drop("day", "batch"), self._since()
        return rows if since is None else rows.filter(F.col("timestamp_ms") >= since)

    def settled(self) -> DataFrame:
        """Ids of the traces that no span can change any more."""
        return self._read("traces", _ROLLED).groupBy("trace_id").agg(F.max_by("settled", "batch").alias("settled")).filter("settled").select("trace_id")

    def _stream(self, checkpoint: str) -> int:
        """The number of the stream with a checkpoint: that of its folder, or a new one."""
        own = f"{zlib.crc32(checkpoint.encode()):08x}"
        known = dict(reversed(n.split("-")) for n in self._names("streams"))
        if own not in known:
            known[own] = str(len(known) + 1)
            system, folder = self._folder(f"streams/{known[own]}-{own}")
            system.mkdirs(folder)
        return int(known[own])

    def ingest(self, stream: DataFrame, name: str, checkpoint: str, every: str | None = None, lateness: str | None = f"{T.RETENTION_DAYS} days") -> StreamingQuery:
        """Write a stream of spans or logs: all that is there and then stop, or every so often without an end.

        Spans that started lateness before the latest one come too late; with None, as for a store that takes in old spans in any order, none does.
        """
        first = self._stream(checkpoint) << 40

        def logged(rows: DataFrame, n: int) -> None:
            self._write("logs", rows, "timestamp_ms", first + n)

        def changed(rows: DataFrame, n: int) -> None:
            rows = rows.persist()
            self._write("spans", rows.filter("kind = 'span'").drop("kind", "ended_ms", "settled"), "started_ms", first + n)
            rolled = rows.filter("kind = 'trace'").select("trace_id", F.col("name").alias("root_span_name"), "source", "started_ms", "ended_ms", "duration_ms", "settled")
            self._write("traces", rolled.groupBy("trace_id").agg(F.min_by(F.struct("root_span_name", "source", "started_ms", "ended_ms", "duration_ms", "settled"), ~F.col("settled")).alias("t")).select("trace_id", "t.*"), "started_ms", first + n)
            rows.unpersist()

        with keyed_state(self.spark):
            if name == "spans":
                known = self._read("spans", SPANS).filter(F.col("batch") < first).select(StructType.fromDDL(SPANS).names)
                stream = traced(stream, known, lateness)
            writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(changed if name == "spans" else logged)
            return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def retain(self, now_ms: int, days: int = T.RETENTION_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Drop what has aged out, and return the tables that stay.

        Whole days go by their names. What of the first day left is too old, and later spans of a trace that is, readers
        leave out, until their day goes too. Nothing is written but a folder's name.
        """
        since = now_ms - days * DAY
        system, mark = self._folder(f"retained/{since}")
        system.mkdirs(mark)
        for name in ("spans", "traces", "logs"):
            for day in self._names(name):
                if day.startswith("day=") and int(day[4:]) < since // DAY:
                    system, folder = self._folder(f"{name}/{day}")
                    system.delete(folder, True)
        return self.traces(), self.spans(), self.logs()


def distinct_spans(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """A stream of spans, each id once; ids are forgotten after lateness."""
    timed = stream.withColumn("event_time", F.timestamp_millis("started_ms"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["span_id"])


def rates(stream: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Per window and span name: spans, errors and their mean and 95th percentile duration. An extension: spans are otherwise only listed."""
    timed = stream.withColumn("event_time", F.timestamp_millis("started_ms")).withWatermark("event_time", lateness)
    grouped = timed.groupBy(F.window("event_time", window), "name")
    return grouped.agg(F.count(F.lit(1)).alias("spans"), F.count("error_message").alias("errors"), F.avg("duration_ms").alias("mean_ms"), F.percentile_approx("duration_ms", 0.95).alias("p95_ms"))


class Recorder:
    """Collects spans of Python calls for tests and drivers; rows fit the span schema."""

    def __init__(self, source: str = "unknown") -> None:
        self.rows: list[dict] = []
        self.source, self._open = source, []

    @contextmanager
    def span(self, name: str):
        me = uuid4().hex
        trace, parent = (self._open[-1][0], self._open[-1][1]) if self._open else (uuid4().hex, None)
        self._open.append((trace, me))
        begun, error = time(), None
        try:
            yield me
        except Exception as e:
            error = str(e)
            raise
        finally:
            self._open.pop()
            self.rows.append({"span_id": me, "trace_id": trace, "parent_span_id": parent, "name": name, "source": self.source, "started_ms": int(begun * 1000), "duration_ms": (time() - begun) * 1000, "error_message": error})

    def traced(self, name: str) -> Callable:
        """A decorator that records each call as a span."""

        def wrap(f: Callable) -> Callable:
            @wraps(f)
            def call(*args, **kwargs):
                with self.span(name):
                    return f(*args, **kwargs)

            return call

        return wrap

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "span_id string, trace_id string, parent_span_id string, name string, source string, started_ms bigint, duration_ms double, error_message string")


__all__ = ["Recorder", "TRACES", "TraceStore", "distinct_spans", "rates"]
