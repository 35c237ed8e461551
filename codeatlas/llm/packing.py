"""Mixture-controlled packing: deficit round-robin over source queues, in closed form."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encoded, placed

LENGTH = 2048
#: Most sources whose queues are found by an expression; more are found by a join.
QUEUES = 256
#: Rounds times queues that are worked out at once.
CELLS = 1 << 18
#: Bytes of 16-bit ids that are cut at once.
SLICE = 2_000_000


class Rounds:
    """Deficit round-robin over queues of known totals.

    Every window of length ids is a round. A round adds a queue's share of the window, by the
    weights of the queues that still hold ids, to the queue's deficit; the queue gives the
    whole quanta that its deficit holds (rounded), and the rest is carried to the next
    round. When a queue ends, the others share its part again. So the ids that queue q has
    given before round r follow from r alone, and every partition knows the deficits that it
    starts with without asking another. By default the weights are the totals, so that all
    queues end together; quanta of one id keep every window within an id of its shares,
    larger ones make fewer and longer pieces and move windows from their shares by a quantum.

    Places are exact up to 2**53 ids in all.
    """

    def __init__(self, totals: list[int], length: int = LENGTH, weights: list[float] | None = None, quantum: int = 1) -> None:
        self.length, self.rounds, self.quantum = length, max(1, -(-sum(totals) // length)), quantum
        if sum(totals) >= 1 << 53:
            raise ValueError("more than 2**53 ids")
        self.totals = np.array(totals, np.int64)
        self.weights = np.array(totals if weights is None else weights, float)
        if (self.weights[self.totals > 0] <= 0).any():
            raise ValueError("weights of queues that hold ids must be positive")
        # A queue ends at the level total / weight; below it every queue has given weight * level ids.
        used = self.totals > 0
        ends = np.unique(self.totals[used] / self.weights[used])
        self.levels = np.concatenate([[0.0], ends])
        self.given = np.array([np.minimum(self.totals[used], self.weights[used] * x).sum() for x in self.levels])

    def level(self, r: np.ndarray) -> np.ndarray:
        return np.interp(np.asarray(r, float) * self.length, self.given, self.levels)

    def first(self, q: np.ndarray | int | slice, r: np.ndarray) -> np.ndarray:
        """The place in queue q of the first id that round r takes."""
        quanta = np.floor(self.weights[q] * self.level(r) / self.quantum + 0.5).astype(np.int64)
        return np.where(np.asarray(r) >= self.rounds, self.totals[q], np.minimum(quanta * self.quantum, self.totals[q]))

    def round_of(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The round that takes the id at place k of queue q."""
        level = (k // self.quantum + 0.5) * self.quantum / self.weights[q]
        r = np.clip(np.interp(level, self.levels, self.given) // self.length, 0, self.rounds - 1).astype(np.int64)
        while (late := self.first(q, r) > k).any():
            r = r - late
        while (early := self.first(q, r + 1) <= k).any():
            r = r + early
        return r

    def base(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The ids that all queues have given when queue q's turn in round r comes: those before q have had theirs."""
        out = np.zeros(len(r), np.int64)
        rounds, of = np.unique(r, return_inverse=True)
        order = np.argsort(of, kind="stable")
        step = max(1, CELLS // len(self.totals))
        for k in range(0, len(rounds), step):
            some = rounds[k : k + step, None]
            before, after = self.first(slice(None), some), self.first(slice(None), some + 1)
            given = np.cumsum(after - before, axis=1) - (after - before)
            own = order[slice(*np.searchsorted(of[order], [k, k + step]))]
            out[own] = before.sum(axis=1)[of[own] - k] + given[of[own] - k, q[own]]
        return out

    def pieces(self, q: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut documents (queue, place in it, size) by rounds and windows: document, start in it, length, window, offset."""
        q, place, size = (np.asarray(x, np.int64) for x in (q, place, size))
        low, high = self.round_of(q, place), self.round_of(q, place + size - 1)
        doc, r = _ranges(low, high)
        given = self.first(q[doc], r) < self.first(q[doc], r + 1)  # a small queue gives nothing in many rounds
        doc, r = doc[given], r[given]
        own = q[doc]
        start_of_round, end_of_round = self.first(own, r), self.first(own, r + 1)
        a, b = np.maximum(place[doc], start_of_round), np.minimum(place[doc] + size[doc], end_of_round)
        at = self.base(own, r) + a - start_of_round
        low, high = at // self.length, (at + b - a - 1) // self.length
        piece, window = _ranges(low, high)
        begin, end = np.maximum(at[piece], window * self.length), np.minimum(at[piece] + (b - a)[piece], (window + 1) * self.length)
        return tuple(x.astype(np.int64) for x in (doc[piece], a[piece] + begin - at[piece] - place[doc[piece]], end - begin, window, begin - window * self.length))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers low[i] ... high[i]: i and the number."""
    n = (high - low + 1).astype(np.int64)
    i = np.repeat(np.arange(len(n)), n)
    return i, low[i] + (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows of batches in slices of at most `most` bytes of their column ids, or of one row."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("ids")).to_numpy())
        i = 0
        while i < b.num_rows:
            before = ends[i - 1] if i else 0
            k = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(i, k - i)
            i = k


def flat(ids: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit ids of a column in a row, as 32-bit integers, and where each row's begin; read from the column's buffer."""
    at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.frombuffer(data.tobytes(), "<u2").astype("<u4"), (at[:-1] - at[0]).astype(np.int64) // 2


def with_queues(docs: DataFrame, columns: dict[str, Column], source: Column, most: int = QUEUES) -> tuple[DataFrame, Column, list]:
    """columns and queue of each row of docs, where queue is its source's rank, null last; and the sources by rank.

    Up to most sources are found by an expression, more by a join with their ranks, which Spark
    broadcasts only if they are small.
    """
    rows = docs.select(*(c.alias(n) for n, c in columns.items()), source.alias("source"))
    names = [r[0] for r in rows.select("source").distinct().collect()]  # one value per queue, as the driver's totals hold
    known = sorted((n for n in names if n is not None), key=lambda n: n.encode() if isinstance(n, str) else n)
    ranked = known + [None] * (None in names)
    if len(names) > most:
        kind = rows.schema["source"].dataType.simpleString()
        ranks = docs.sparkSession.createDataFrame(list(enumerate(ranked)), f"queue int, name {kind}")
        rows = rows.join(ranks, F.col("source").eqNullSafe(F.col("name")))
        return rows.drop("name", "source"), F.col("queue"), ranked
    queue = F.lit(len(known))
    if known:
        queue = F.coalesce(F.create_map(*(F.lit(x) for i, n in enumerate(known) for x in (n, i)))[F.col("source")], queue)
    return rows.withColumn("queue", queue).drop("source"), F.col("queue"), ranked


def pack(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, ids: bool = False, parts: int | None = None, weights: dict | None = None, quantum: int | None = None) -> DataFrame:
    """Pack all rows of docs into sequences of length ids; every sequence holds each source in its target proportion.

    Returns a row per piece: id, start (the document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id, offset, queue and, if ids is true, token_ids. All sequences but
    the last are full. Every id lies in one piece. Null texts are empty and hold the end id
    alone; null sources are a queue of their own; repeated rows are packed each; other columns
    are not read; an empty table gives an empty one. The driver holds one number per queue.

    weights gives the target of each source (by default the number of its ids, so that all
    sources end together); a source that ends early leaves its part to the others. quantum is
    the number of ids a source gives at least when its turn comes (see Rounds); by default it is twice the number of
    sources, up to length, so that documents fall into few pieces however many sources share the windows.
    """
    spark = docs.sparkSession
    rows, queue, sources = with_queues(docs, {"id": docs[id_col], "text": docs[text_col]}, docs[source_col])
    tokens = encoded(rows, tokenizer, end, "id", "text", queue=queue, parts=parts)
    rows, totals = placed(tokens)
    goal = [weights[s] for s in sources] if weights else None
    rounds = Rounds([totals.get(q, 0) for q in range(len(sources))], length, goal, quantum or max(1, min(length, 2 * len(sources))))
    shared = spark.sparkContext.broadcast(rounds)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            q, place, size = (b.column(c).to_numpy() for c in ("queue", "place", "n_tokens"))
            doc, start, n, window, offset = shared.value.pieces(q, place, size)
            values, first = flat(b.column("ids"))
            data = memoryview(values.view(np.uint8))
            a = first[doc] + start
            crc = [zlib.crc32(data[4 * i : 4 * k]) for i, k in zip(a.tolist(), (a + n).tolist())]
            columns = {"id": b.column("id").take(pa.array(doc)), "start": pa.array(start), "length": pa.array(n), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(size[doc]), "sequence_id": pa.array(window), "offset": pa.array(offset), "queue": pa.array(q[doc].astype(np.int32))}
            if ids:
                columns["token_ids"] = pa.array([values[i:k].astype(np.int32) for i, k in zip(a.tolist(), (a + n).tolist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        pa.default_memory_pool().release_unused()

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue int"
    out = rows.select("id", "queue", "place", "n_tokens", "ids").mapInArrow(run, schema + ", token_ids array<int>" * ids)
    return out.withColumnRenamed("id", id_col)
