"""What filters remove in every order: a trie of permutations whose equal states are shared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, sliced, stored, utf8

FILTERS = "ABCDE"
#: Copies of one text from which on its rows are told by a broadcast table and not by a shuffle on the text.
CROWD = 256
#: Most texts in that table: one holds more than a part in so many of all rows, so there cannot be more.
CROWDS = 10_000

_MARKS = np.frombuffer(b"#$%&*|", np.uint8)


def verdicts(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a whole text fails A (under 200 words), B (under half of its words distinct), C (over 3 % capitals) and D (a mark)."""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(counts[0x80:0xC0].sum())  # continuation bytes begin no code point
    return len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * int(counts[65:91].sum()) > 3 * points, bool(counts[_MARKS].any())


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, a boolean per filter that says whether the row fails it, good and toxic, for each row of docs; stored.

    Texts are read once. Equal texts (E) are told by their SHA-256: a row fails if a smaller id has its text. Texts of
    over CROWD copies, and over a part in CROWDS of all rows, are few and broadcast, and their rows leave the
    shuffle on texts, so no task holds the copies of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t or b"" for t in utf8(b.column(2))]
            found = list(zip(*map(verdicts, texts))) or [()] * 4
            columns = [b.column(0), b.column(1), *(pa.array(f, pa.bool_()) for f in found), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", *FILTERS[:4], "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].cast("string"))
    judged = stored(rows.mapInArrow(run, f"id {kind}, part string, " + "".join(f"{f} boolean, " for f in FILTERS[:4]) + "digest binary"), "judged")
    copies = stored(judged.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    crowd = F.col("n") > max(CROWD, judged.count() // CROWDS)
    rare = copies.filter(~crowd).select(F.col("digest").alias("key"), F.col("first").alias("own"))
    told = judged.join(F.broadcast(copies.filter(crowd).select("digest", "first")), "digest", "left")  # under CROWDS rows
    told = told.withColumn("key", F.when(F.col("first").isNull(), F.col("digest")).otherwise(F.unhex(F.format_string("%016x", F.xxhash64("id", "part")))))
    told = told.join(rare, "key", "left").withColumn("first", F.coalesce("first", "own"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E")
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    out = stored(told.join(known, "id", "left").select("id", "part", *FILTERS[:4], later, *marks), "failures")
    discard(judged, copies)
    return out


def trie(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts at every edge of the trie of all orders of filters over rows (columns part, a boolean per filter, good, toxic).

    The trie is walked depth first. A state is what a set of filters leaves, whatever their order: it is
    filtered from the persisted state above it, persisted itself while the walk is below it, and visited once; other orders
    share its counts. A state's one pass counts, by part, the rows that each filter still to come
    removes there. Returns part, gone (the set as a bit mask), n (rows in the state), filter, removed, good_lost and toxic_lost.
    States that a lost executor held are filtered again from rows.
    """
    states: dict[int, DataFrame] = {}

    def visit(state: DataFrame, gone: int) -> None:
        if gone in states:
            return
        here = state.persist(StorageLevel.MEMORY_AND_DISK)
        ahead = [(k, f) for k, f in enumerate(filters) if not gone >> k & 1]
        sums = [F.struct(F.lit(f).alias("filter"), *(F.count_if(c).alias(n) for n, c in (("removed", F.col(f)), ("good_lost", F.col(f) & F.col("good")), ("toxic_lost", F.col(f) & F.col("toxic"))))) for _, f in ahead]
        counted = here.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("edges"))
        states[gone] = stored(counted.select("part", F.lit(gone).alias("gone"), "n", F.inline("edges")), "state")
        for k, f in ahead:
            if len(ahead) > 1:
                visit(here.filter(~F.col(f)), gone | 1 << k)
        here.unpersist()

    visit(rows, 0)
    out = stored(reduce(DataFrame.unionByName, states.values()), "edges")
    discard(*states.values())
    return out


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step, with what the step's filter does there.

    Null texts and parts count as empty. A null id is never smaller than another and has no label; rows that
    repeat an id are counted each and fail E only if a smaller id has their text; an id with several
    labels is good (toxic) if one of them says so. Other columns are not read. An empty table gives no rows.
    """
    rows = failures(docs, labels, id_col, text_col, part_col)
    counts = trie(rows)
    n, full = len(FILTERS), (1 << len(FILTERS)) - 1
    # What every state's order of filters comes to: fixed by the number of filters, not by the data.
    sets = [(gone, f, factorial(gone.bit_count()) * factorial(n - 1 - gone.bit_count())) for gone in range(full) for k, f in enumerate(FILTERS) if not gone >> k & 1]
    last = F.col("gone") == F.create_map(*(F.lit(x) for k, f in enumerate(FILTERS) for x in (f, full - (1 << k))))[F.col("filter")]
    steps = [("".join(order), i + 1, sum(1 << FILTERS.index(f) for f in order[:i]), order[i]) for order in permutations(FILTERS) for i in range(n)]
    spark = docs.sparkSession
    parts = counts.filter("gone = 0").select("part").distinct()
    cells = parts.select("part", F.inline(F.array(*(F.struct(F.lit(g).alias("gone"), F.lit(f).alias("filter"), F.lit(w).alias("orders")) for g, f, w in sets))))
    names = ("n", "removed", "good_lost", "toxic_lost")
    edges = cells.join(counts, ["part", "gone", "filter"], "left").select("part", "gone", "filter", "orders", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    per_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("gone") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("removed")).alias("shapley"),
    )
    orders = spark.createDataFrame(steps, "filter_order string, step int, gone int, filter string")
    out = edges.join(per_filter, ["part", "filter"]).join(F.broadcast(orders), ["gone", "filter"])  # a row per order and step
    return out.select(
        "part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
