"""Sessions by event time: events of a key with no longer pause than a gap, kept as batches come, and a side table of what comes too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..shared import discard, stored

_SESSIONS = "key string, start_ms bigint, end_ms bigint, events bigint, errors bigint, batch bigint"
_LATE = "key string, at_ms bigint, batch bigint"
_MARKS = "newest_ms bigint, batch bigint"
DAY = 86_400_000


def merged(sessions: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions (key, start_ms, end_ms, events, errors) that are no more than a gap apart, as one.

    Joining is associative, so sessions of a day are joined first, each day of a key by itself, and what they come to
    across days: a key that holds a third of all events is not sorted in one task.
    """

    def joined(rows: DataFrame, *by: Column) -> DataFrame:
        before = Window.partitionBy("key", *by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
        begins = F.coalesce(F.col("start_ms") - F.max("end_ms").over(before) > gap_ms, F.lit(True))
        told = rows.withColumn("begins", begins.cast("long"))
        number = F.sum("begins").over(Window.partitionBy("key", *by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, 0))
        grouped = told.withColumn("number", number).groupBy("key", *by, "number")
        return grouped.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("events").alias("events"), F.sum("errors").alias("errors"))

    days = joined(sessions, F.floor(F.col("start_ms") / DAY).alias("day"))
    return joined(days.select("key", "start_ms", "end_ms", "events", "errors")).select("key", "start_ms", "end_ms", "events", "errors")


def sessions(events: DataFrame, gap_ms: int) -> DataFrame:
    """The sessions of a table of events (key, at_ms, error)."""
    ones = events.select("key", F.col("at_ms").alias("start_ms"), F.col("at_ms").alias("end_ms"), F.lit(1).cast("long").alias("events"), F.col("error").cast("long").alias("errors"))
    return merged(ones, gap_ms)


class SessionStore:
    """Sessions of a stream of events (key, at_ms, error), one folder per micro-batch.

    The watermark is the newest event of all earlier batches less the lateness. Events before it are late: they go to a side
    table and change nothing. A session can grow until the watermark has passed its end by the gap; so a batch reads the
    sessions that were open, joins its events to them, and writes what closed and what is open now. Closed ones are never read
    again. A batch that is run again reads what the one before it left and takes its own place.
    """

    def __init__(self, spark: SparkSession, root: str, gap_ms: int, lateness_ms: int) -> None:
        self.spark, self.root, self.gap_ms, self.lateness_ms = spark, root.rstrip("/"), gap_ms, lateness_ms

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def newest(self, before: int) -> int | None:
        """The newest event of the batches before one."""
        return self._read("marks", _MARKS).filter(F.col("batch") < before).agg(F.max("newest_ms")).first()[0]

    def add(self, events: DataFrame, batch: int) -> None:
        """Take in a batch of events. Those without a time are late."""
        events = stored(events.select(F.col("key").cast("string").alias("key"), F.col("at_ms").cast("long").alias("at_ms"), F.coalesce("error", F.lit(False)).alias("error")), "events")
        newest = self.newest(batch)
        mark = None if newest is None else newest - self.lateness_ms
        late = F.col("at_ms").isNull() if mark is None else F.col("at_ms").isNull() | (F.col("at_ms") < mark)
        open_ = self._read("open", _SESSIONS).filter(F.col("batch") == batch - 1).drop("batch")
        now = stored(merged(open_.unionByName(sessions(events.filter(~late), self.gap_ms)), self.gap_ms), "sessions")
        latest = events.agg(F.greatest(F.max("at_ms"), F.lit(newest)).alias("newest_ms")).first()[0]
        passed = F.lit(False) if latest is None else F.col("end_ms") + self.gap_ms < latest - self.lateness_ms
        self._write("late", batch, events.filter(late).select("key", "at_ms"))
        self._write("closed", batch, now.filter(passed))
        self._write("open", batch, now.filter(~passed))
        self._write("marks", batch, self.spark.createDataFrame([(latest,)], "newest_ms bigint"))
        discard(events, now)

    def follow(self, events: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Take in a stream of events: all that is there and then stop, or every so often without an end."""
        writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def closed(self) -> DataFrame:
        """Sessions that can grow no more."""
        return self._read("closed", _SESSIONS).drop("batch")

    def open(self) -> DataFrame:
        """Sessions that may grow yet."""
        last = self._read("marks", _MARKS).agg(F.max("batch")).first()[0]
        return self._read("open", _SESSIONS).filter(F.col("batch") == F.lit(last).cast("long")).drop("batch")

    def late(self) -> DataFrame:
        return self._read("late", _LATE).drop("batch")
