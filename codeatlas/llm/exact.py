"""Exact deduplication by a stateful stream: one keyed state per digest, on disk, that never expires."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import BLANK, scratch, stored

#: Most digests met twice that are broadcast to pick the texts to compare (64 bytes each).
MOST_HITS = 500_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANK + "+", " ")


def place(docs: DataFrame) -> list[Column]:
    """file and row of each row of docs, by Spark's own column and not by one of docs that has its name."""
    where = docs.metadataColumn("_metadata")
    return [where["file_path"].alias("file"), where["row_index"].alias("row")]


def filed(docs: DataFrame) -> DataFrame:
    """docs, if its rows have a place in a Parquet file; else the same rows, written to the shared folder."""
    try:
        docs.select(*place(docs))
    except AnalysisException:
        return stored(docs, "filed")
    return docs


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def feed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the stream carries of each document: id, content locator (its file and its row in that file) and digest, no text."""
    docs = filed(docs)
    return docs.select(docs[id_col].alias("id"), *place(docs), digest_of(docs[text_col]).alias("digest"))


def first_row() -> Column:
    """The row of a group that stays."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row"))


def retain(stream: DataFrame, state: str, folder: str) -> DataFrame:
    """Run a streaming feed into keyed state and return the state's rows.

    The state of a digest is the smallest (id, file, row) seen and the number of rows. It lives
    in RocksDB on the executors' disks, is checkpointed under state, and has no watermark, so
    it never expires: a later run with the same state goes on from there. Rows are aggregated
    before the shuffle, so a digest that holds a third of all rows reaches its state as one
    row per task. Each micro-batch appends the states it changed to folder; the largest count
    of a digest is its last state.
    """
    spark = stream.sparkSession
    settings = {"providerClass": ROCKSDB, "rocksdb.allowFAllocate": "false"}  # else each partition's store sets megabytes aside
    before = {k: spark.conf.get(f"spark.sql.streaming.stateStore.{k}", None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
    try:
        grouped = stream.groupBy("digest").agg(first_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
        query = (
            grouped.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(lambda changed, n: changed.write.mode("overwrite").parquet(f"{folder}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(f"spark.sql.streaming.stateStore.{k}")
            else:
                spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
    states = spark.read.schema(grouped.schema).parquet(f"{folder}/batch=*")
    return states.groupBy("digest").agg(F.max_by("first", "group_size").alias("first"), F.max("group_size").alias("group_size"))


def earlier_texts(states: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """digest and t: the texts that earlier runs left in the state and rows of this run met, read from their locators.

    The driver holds the names of the files that they are in.
    """
    spark = states.sparkSession
    met = states.filter("group_size > 1").select("digest", "first.file", "first.row").join(rows.select("file", "row"), ["file", "row"], "left_anti")
    met = stored(met, "met")
    files = [r[0] for r in met.select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "digest string, t string")
    read = spark.read.parquet(*files)
    texts = read.select(*place(read), normalised(read[text_col]).alias("t"))
    return met.join(texts, ["file", "row"]).select("digest", "t")


def collisions(docs: DataFrame, hits: DataFrame, earlier: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The digests of hits that stand for more than one text, by comparing full bytes on every hit.

    The smallest and the largest text of a digest are the same bytes if all its texts are;
    both are found in one aggregation with partial results, so no group meets in one task.
    Up to MOST_HITS digests pick the texts that are compared before these move; beyond, all texts take part.
    """
    texts = docs.select(digest_of(docs[text_col]).alias("digest"), normalised(docs[text_col]).alias("t"))
    if hits.count() <= MOST_HITS:
        texts = texts.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    if earlier is not None:
        texts = texts.unionByName(earlier)
    return texts.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """Group the rows of docs by equal text, through a stateful stream.

    Returns a row per row of docs: id, file, row (its locator), keep_id, group_size, kept and
    text_sha256. The row with the smallest id stays; null ids come last; of rows with the same
    id and text, the first by file and row stays (frames not read from files are written to
    the shared folder first). Null texts count as empty, other columns are not read, and an
    empty table gives an empty one.

    With state, the folder of an earlier run, rows are matched to those of earlier runs too: keep_id and
    group_size count them all, and a row stays if no run has a smaller one.

    A digest met again is a hit. Its texts are compared byte by byte, those of earlier runs by
    their locators. Should different texts of docs share a digest, they are grouped by their bytes; one that
    shares it with an earlier run's is refused, for the state holds one text of a digest.
    """
    spark = docs.sparkSession
    docs = filed(docs)
    folder = state or scratch(spark, "state")
    own = f"{folder}/feed/{uuid.uuid4().hex}"
    fed = feed(docs, id_col, text_col)
    fed.write.parquet(own)
    stream = spark.readStream.schema(fed.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/feed")
    states = stored(retain(stream, f"{folder}/state", scratch(spark, "states")), "digests")
    rows = spark.read.schema(fed.schema).parquet(own)
    earlier = earlier_texts(states, rows, text_col) if state else None
    clashing = stored(collisions(docs, states.filter("group_size > 1"), earlier, text_col), "clashing")
    if clashing.isEmpty():
        named = rows.join(states, "digest")
    else:
        if earlier is not None and not earlier.join(clashing, "digest").isEmpty():
            raise ValueError("a text shares the digest of another one of an earlier run")
        texts = docs.select(docs[id_col].alias("id"), *place(docs), digest_of(docs[text_col]).alias("digest"), normalised(docs[text_col]).alias("t"))
        texts = texts.join(clashing, "digest", "left_semi")
        groups = texts.groupBy("digest", "t").agg(first_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
        named = rows.join(clashing, "digest", "left_anti").join(states, "digest").unionByName(texts.join(groups, ["digest", "t"]).drop("t"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & F.col("file").eqNullSafe(F.col("first.file")) & F.col("row").eqNullSafe(F.col("first.row"))
    return named.select(F.col("id").alias(id_col), "file", "row", F.col("first.id").alias("keep_id"), "group_size", same.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier row has; its columns are unchanged."""
    docs = filed(docs)
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select("file", "row")
    whole = docs.select(F.struct("*").alias("all"), *place(docs))
    return whole.join(gone, ["file", "row"], "left_anti").select("all.*")
