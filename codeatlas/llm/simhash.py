"""SimHash fingerprints, linked through multi-index hashing with small Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import sliced, stored, utf8
from .components import connected_components

DISTANCE = 4
#: First bit, width and searched radius of the segments, by the most fingerprints that they are for. Two
#: fingerprints that differ in at most DISTANCE bits lie within the radius in one segment at least: else they would
#: differ in 2 + 2 + 1 bits, or in 3 + 2. Wider segments keep a bucket's entries few where there are more fingerprints.
SEGMENTS = (
    (1 << 27, ((0, 21, 1), (21, 21, 1), (42, 22, 0))),
    (1 << 64, ((0, 32, 2), (32, 32, 1))),
)
#: Table entries of a bucket, and entries that its probes come from, up to which they meet in one place; others are dealt out in cells.
COLD = 256
CELL = 2048


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """64-bit hashes of all shingles of a text; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, k = b" ".join(words), min(shingle, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - k + 1].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())), "<u8", len(starts))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash: bit b is set if over half of the shingle hashes have it; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * ones > len(hashes)) @ (1 << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id and fp (the fingerprint as a signed long) for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t or b"", shingle) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, fp bigint")


def _masks(width: int, radius: int) -> list[tuple[int, int]]:
    """Each way to flip 1 to radius bits of width, with the highest bit that it flips."""
    return [(sum(1 << b for b in bits), 1 << bits[-1]) for n in range(1, radius + 1) for bits in combinations(range(width), n)]


def _segments(points: int) -> tuple:
    return next(s for most, s in SEGMENTS if points <= most)


def _neighbours(key: Column, segments: tuple) -> Column:
    """The keys of key's segment that a fingerprint with this key looks up beside it.

    Of two segments that differ, the one with 0 in the highest bit that differs looks up the
    other, so half a ball does.
    """
    out = F.array().cast("array<bigint>")
    for k, (_, width, radius) in enumerate(segments):
        if radius:
            masks = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(top).cast("long").alias("top")) for m, top in _masks(width, radius)))
            ball = F.transform(F.filter(masks, lambda x: key.bitwiseAND(x["top"]) == 0), lambda x: key.bitwiseXOR(x["m"]))
            out = F.when(F.shiftrightunsigned(key, 32) == k, ball).otherwise(out)
    return out


def _own_keys(segments: tuple) -> Column:
    """The table keys of fp: the bits of each segment, tagged with its number."""
    parts = (F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 32)) for k, (first, width, _) in enumerate(segments))
    return F.array(*parts)


def _other_bits(segments: tuple) -> list[list[int]]:
    """For each segment the bits outside it, in DISTANCE + 1 runs as masks (signed longs): fingerprints that are near agree in one run at least."""
    out = []
    for first, width, _ in segments:
        bits = [b for b in range(64) if not first <= b < first + width]
        runs = np.array_split(bits, DISTANCE + 1)
        out.append([int(np.array(sum(1 << int(b) for b in run), np.uint64).view(np.int64)) for run in runs])
    return out


def _second(fp: Column, key: Column, segments: tuple) -> Column:
    """Where a fingerprint stands in the second table of a crowded bucket: run and its bits, for each run of bits outside the bucket's segment."""
    out = F.lit(None).cast("array<struct<run:int,bits:bigint>>")
    for k, masks in enumerate(_other_bits(segments)):
        runs = F.array(*(F.struct(F.lit(i).alias("run"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)))
        out = F.when(F.shiftrightunsigned(key, 32) == k, runs).otherwise(out)
    return out


def cell_links(left: np.ndarray, right: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Stars that connect what the pairs within distance of left x right connect, in few rows."""
    left, right = np.unique(left), np.unique(right)
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= distance
    label = np.arange(len(left))
    top = len(left)
    while True:
        over = np.where(near, label[:, None], top).min(axis=0, initial=top)
        back = np.where(near, over[None, :], top).min(axis=1, initial=top)
        new = np.minimum(label, back)
        new = new[new]
        if (new == label).all():
            break
        label = new
    stars = [(int(left[i]), int(left[m])) for i, m in enumerate(label) if i != m]
    return stars + [(int(right[j]), int(left[m])) for j, m in enumerate(over) if m < top and right[j] != left[m]]


def links(points: DataFrame) -> DataFrame:
    """Edges u, v over the distinct fingerprints of points (column fp) whose components are those of all pairs within DISTANCE.

    Each fingerprint is in the table of each segment once and looks up its half balls there; a
    match counts if the whole fingerprints are near: 42 look-ups at most a fingerprint up to 2**27 of them, 280 or so beyond. Buckets of
    over COLD entries, and those that such a bucket's entries look up, get a second table: near fingerprints
    agree in one of DISTANCE + 1 runs of the bits outside the segment, so entries and probes stand there
    once for each run, in buckets some 2**8 times smaller, dealt in cells of about CELL x CELL that find their pairs apart and return
    stars. So a bucket's rows grow with its members, unless these agree in most other bits too.
    """
    segments = _segments(points.count())
    table = points.select("fp", F.explode(_own_keys(segments)).alias("key"))
    near = table.select(F.col("fp").alias("fp2"), F.explode(_neighbours(F.col("key"), segments)).alias("key"), F.lit(True).alias("flip"))
    probe = table.select(F.col("fp").alias("fp2"), "key", F.lit(False).alias("flip")).unionByName(near)
    full = stored(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COLD), "crowded")
    found = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE) & (F.col("flip") | (F.col("fp2") < F.col("fp")))
    pairs = [F.col("fp").alias("u"), F.col("fp2").alias("v")]
    if full.isEmpty():
        return table.join(probe, "key").filter(found).select(pairs)
    # What may come to a bucket: the entries of it, where it is full itself, and those of full buckets beside it.
    come = full.select("key", F.col("n").alias("probes")).unionByName(full.select(F.explode(_neighbours(F.col("key"), segments)).alias("key"), F.col("n").alias("probes")))
    come = come.groupBy("key").agg(F.sum("probes").alias("probes"))
    sizes = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(come, "key")
    names = stored(sizes.select("key"), "cells")
    cold = table.join(names, "key", "left_anti").join(probe, "key").filter(found).select(pairs)
    second = ["key", "run", "bits"]

    def spread(rows: DataFrame, fp: str) -> DataFrame:
        return rows.join(names, "key").select("key", F.col(fp).alias("fp"), F.inline(_second(F.col(fp), F.col("key"), segments)))

    entries, probes = spread(table, "fp"), spread(probe, "fp2")
    number = lambda rows, name: rows.groupBy(*second).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name))
    crowded = stored(number(entries, "rows").join(number(probes, "columns"), second), "second")

    def dealt(rows: DataFrame, own: str, across: str, mine: str, others: str) -> DataFrame:
        block, every = F.pmod(F.xxhash64("fp"), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        return rows.join(crowded, second).select(*(F.col(c).alias(c) for c in second), "fp", block.alias(own), every.alias(across))

    hot_table, hot_probe = dealt(entries, "i", "j", "rows", "columns"), dealt(probes, "j", "i", "columns", "rows")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        stars = cell_links(left["fp"].to_numpy(np.int64), right["fp"].to_numpy(np.int64))
        return pd.DataFrame(stars, columns=["u", "v"], dtype="int64")

    cells = [*second, "i", "j"]
    hot = hot_table.groupBy(*cells).cogroup(hot_probe.groupBy(*cells)).applyInPandas(cell, "u bigint, v bigint")
    return cold.unionByName(hot)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Link the rows of docs whose fingerprints differ in at most 4 bits, directly or through others.

    Returns a row per row of docs: id, fp and component_id, the smallest id of its component.
    Null texts count as empty; all texts without words have fingerprint 0 and are linked like
    any other; a null id is never the smallest unless the component has no other; repeated
    rows are in one component; other columns are not read; an empty table gives an empty one.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "points")
    labels = connected_components(links(points.select("fp")))
    named = points.join(labels, points["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "named")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = named.join(least, "label").select("fp", "component_id")
    return rows.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the rows whose id is the component's smallest.

    Rows that repeat an id repeat it in the result; rows of null ids stay only where the
    component has no other.
    """
    groups = near_groups(docs, id_col, text_col)
    gone = groups.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
