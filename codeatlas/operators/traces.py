"""Traces, spans and logs: roll-up, listing, depth and waterfall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

RETENTION_DAYS = 7
NEVER = 10_000


def roll_up(spans: DataFrame) -> DataFrame:
    """A trace per trace_id: the root's name, source and duration, the earliest start and the latest end.

    The root is the span without a parent; without one, the earliest span stands for it. Of
    several, the earliest counts, then the first by id.
    """
    end = F.col("started_ms") + F.coalesce("duration_ms", F.lit(0.0))
    root = F.struct(F.col("parent_span_id").isNotNull().alias("child"), "started_ms", "span_id")
    best = F.min_by(F.struct("name", "source", "duration_ms"), root)
    grouped = spans.groupBy("trace_id").agg(best.alias("root"), F.min("started_ms").alias("started_ms"), F.max(end).cast("long").alias("ended_ms"))
    return grouped.select("trace_id", F.col("root.name").alias("root_span_name"), F.coalesce("root.source", F.lit("unknown")).alias("source"), "started_ms", "ended_ms", F.col("root.duration_ms").alias("duration_ms"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of traces as one: the earliest start names a trace, the newer table on a tie; ends are the latest."""
    both = old.withColumn("__old", F.lit(1)).unionByName(new.withColumn("__old", F.lit(0)))
    first = F.min_by(F.struct("root_span_name", "source", "duration_ms"), F.struct("started_ms", "__old"))
    grouped = both.groupBy("trace_id").agg(first.alias("f"), F.min("started_ms").alias("started_ms"), F.max("ended_ms").alias("ended_ms"))
    return grouped.select("trace_id", "f.root_span_name", "f.source", "started_ms", "ended_ms", "f.duration_ms")


def new_spans(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spans of new that old lacks, each id once."""
    return new.dropDuplicates(["span_id"]).join(old.select("span_id"), "span_id", "left_anti")


def recent(traces: DataFrame, limit: int = 50, sources: list[str] | None = None) -> DataFrame:
    """The limit latest traces, of the given sources."""
    rows = traces.filter(F.col("source").isin(sources)) if sources else traces
    return rows.orderBy(F.desc("started_ms"), "trace_id").limit(limit)


def spans_of(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id).orderBy("started_ms", "span_id")


def logs_of(logs: DataFrame, trace_id: str) -> DataFrame:
    return logs.filter(F.col("trace_id") == trace_id).orderBy("timestamp_ms")


def logs_per_span(logs: DataFrame) -> DataFrame:
    """trace_id, span_id (null for the trace's own logs), n_logs."""
    return logs.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("n_logs"))


def bundle(spans: DataFrame, logs: DataFrame, trace_id: str) -> DataFrame:
    """All of one trace, spans and logs, as rows of kind, at_ms, span_id, name and text, in order; empty where the trace has no spans."""
    own = spans_of(spans, trace_id).select(F.lit("span").alias("kind"), F.col("started_ms").alias("at_ms"), "span_id", "name", F.col("input").alias("text"))
    said = logs_of(logs, trace_id).select(F.lit("log").alias("kind"), F.col("timestamp_ms").alias("at_ms"), "span_id", F.col("level").alias("name"), F.col("message").alias("text"))
    known = spans.filter(F.col("trace_id") == trace_id).limit(1).select(F.lit(True).alias("known"))
    return own.unionByName(said).join(F.broadcast(known)).drop("known").orderBy("at_ms", "kind", "span_id", "name")  # one row


def depths(spans: DataFrame) -> DataFrame:
    """spans with depth, the number of ancestors; an unknown parent counts as one ancestor, and spans on a cycle have null.

    Parents are followed by doubling: after r rounds each span knows its ancestor 2^r up, so
    the rounds are the logarithm of the deepest trace. A table cuts the lineage of each round,
    and the rounds end when every span knows its depth.
    """
    known = spans.select("trace_id", F.col("span_id").alias("__s"), F.lit(True).alias("__here"))
    links = spans.select("trace_id", "span_id", F.col("parent_span_id").alias("up"), F.when(F.col("parent_span_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    links = links.join(known.withColumnRenamed("__s", "up"), ["trace_id", "up"], "left").withColumn("up", F.when(F.col("__here"), F.col("up"))).drop("__here")
    longest, step = spans.groupBy("trace_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], 1
    while step < longest:
        links = stored(links, "depths")
        if links.filter("up is not null").isEmpty():
            break
        far = links.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        links = links.join(far, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        step *= 2
    depth = links.select("trace_id", "span_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    return spans.join(depth, ["trace_id", "span_id"], "left")


def waterfall(spans: DataFrame) -> DataFrame:
    """spans with offset_ms and extent_ms in their trace, and the bar's left and width in percent (2 at least)."""
    trace = Window.partitionBy("trace_id")
    first = F.min("started_ms").over(trace)
    extent = F.max(F.col("started_ms") + F.coalesce("duration_ms", F.lit(0.0))).over(trace) - first
    extent = F.when(extent == 0, F.lit(1.0)).otherwise(extent.cast("double"))
    rows = spans.withColumns({"offset_ms": F.col("started_ms") - first, "extent_ms": extent})
    width = F.coalesce("duration_ms", F.lit(0.0)) / F.col("extent_ms") * 100
    return rows.withColumns({"left_percent": F.col("offset_ms") / F.col("extent_ms") * 100, "width_percent": F.greatest(width, F.lit(2.0))})


def kept(traces: DataFrame, spans: DataFrame, logs: DataFrame, now_ms: int, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays after retention: traces begun in the last days, their spans, and logs of the last days."""
    since = now_ms - days * 86_400_000
    young = traces.filter(F.col("started_ms") >= since)
    own = spans.join(young.select("trace_id"), "trace_id", "left_semi")
    return young, own, logs.filter(F.col("timestamp_ms") >= since)
