"""Near copies by their shingle sets: candidates from SimHash fingerprints and from MinHash bands, each pair verified on both whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import sliced, stored, utf8
from .components import connected_components
from .simhash import fingerprint, links, shingle_hashes

#: BANDS keys of ROWS minima each: two sets of similarity s share no key with probability (1 - s**4)**24,
#: 3 in a million at 0.8 and less above.
BANDS, ROWS = 24, 4
#: Members of a band's key that are paired one by one, and rows of a larger bucket's cell on either side.
COLD = 8
CELL = 512
_RANDOM = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_ODD, _ADD = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's bands, as signed longs; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[i : i + (1 << 12), None] * _ODD + _ADD).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _digest(text: bytes) -> bytes:
    return xxh3_128_digest(b" ".join(text.lower().split()))


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, digest of the words, size of the shingle set, band keys and SimHash fingerprint for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t or b"" for t in utf8(b.column(1))]
            sets = [shingle_set(t, shingle) for t in texts]
            columns = [b.column(0), pa.array(map(_digest, texts), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            columns.append(pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n", "keys", "fp"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, digest binary, n bigint, keys array<bigint>, fp bigint")


def simhash_pairs(points: DataFrame) -> DataFrame:
    """Pairs u < v of digests (of points: digest, fp) that SimHash's links at 4 bits propose.

    Each text of a fingerprint is paired with the first of them, and the first ones of linked fingerprints with each
    other, so there are no more pairs than texts and links. A pair may come more than once.
    """
    heads = stored(points.groupBy("fp").agg(F.min("digest").alias("head")), "fingerprints")
    alike = points.join(heads, "fp").filter(F.col("digest") != F.col("head")).select(F.col("head").alias("u"), F.col("digest").alias("v"))
    ends = [heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head")) for end in ("u", "v")]
    linked = links(heads.select("fp")).join(ends[0], "u").join(ends[1], "v")
    return alike.unionByName(linked.select(F.least("u_head", "v_head").alias("u"), F.greatest("u_head", "v_head").alias("v")))


def _contents(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t or b"" for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, texts), pa.binary()), pa.array(texts, pa.binary())], names=["digest", "text"])

    return docs.select(docs[text_col].cast("string")).mapInArrow(run, "digest binary, text binary")


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs u, v whose whole shingle sets have at least the similarity."""
    pairs = stored(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("digest")).distinct()
    texts = _contents(docs, text_col).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")
    both = pairs.join(texts.select(F.col("digest").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("digest").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}

        def of(digest: bytes, text: bytes) -> np.ndarray:
            if digest not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[digest] = shingle_set(text, shingle)
            return sets[digest]

        for batch in sliced(batches):
            near = []
            for u, v, s, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a, b = of(u, s), of(v, t)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(shared + 1e-9 >= similarity * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return stored(both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary"), "near")


def _linked(left: DataFrame, right: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges u, v between the rows of left and of right in each cell (columns key, i, j, digest, label) whose whole sets have the similarity.

    Rows of one label are linked already and not compared; of the rows of one other label
    that a row is near to, one is returned.
    """

    def cell(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({"u": [], "v": []})
        sets = [shingle_set(t, shingle) for t in other["text"]]
        size = np.array([len(x) for x in sets])
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        labels, digests = other["label"].to_numpy(), other["digest"].to_numpy()
        edges = []
        for digest, label, text in zip(one["digest"], one["label"], one["text"]):
            apart = labels != label
            if not apart.any():
                continue
            own = shingle_set(text, shingle)
            at = np.minimum(np.searchsorted(own, hashes), len(own) - 1) if len(own) else np.zeros(0, np.int64)
            shared = np.bincount(owner[own[at] == hashes], minlength=len(sets)) if len(own) else np.zeros(len(sets), np.int64)
            near = np.flatnonzero(apart & (shared + 1e-9 >= similarity * (len(own) + size - shared)))
            edges += [(digest, digests[k]) for k in {labels[k]: k for k in near[::-1].tolist()}.values()]
        return pd.DataFrame(edges, columns=["u", "v"])

    cells = ["key", "i", "j"]
    sides = [side.join(texts, "digest").select(*(F.col(c).alias(c) for c in (*cells, "digest", "label", "text"))).groupBy(*cells) for side in (left, right)]
    return stored(sides[0].cogroup(sides[1]).applyInPandas(cell, "u binary, v binary"), "links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Link the rows of docs whose sets of shingles (that many words) have a Jaccard similarity of at least similarity, directly or through others.

    Returns a row per row of docs: id and component_id, the smallest id of its component. Shorter texts
    are one shingle. Null texts count as empty; texts without words are linked with each other alone; a
    null id is never the smallest unless the component has no other; repeated rows are in one component.

    SimHash proposes the pairs of fingerprints within 4 bits. At a similarity of 0.8 fingerprints differ in more, so MinHash bands
    propose the others.
    Pairs of buckets of up to COLD members are verified one by one. In larger buckets all
    members meet the one that shares most buckets with others; then those that this left out
    of the bucket's largest component meet all members, in cells of CELL x CELL, and rows
    that are linked already are not compared. So the rows that move are in proportion to the members.
    """
    rows = stored(_sketches(docs, id_col, text_col, shingle), "sketches")
    points = stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "points")
    table = points.select("digest", "n", F.explode("keys").alias("key"))
    shared = table.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = stored(table.join(shared, "key"), "members")

    def other(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c).alias(c if c == "key" else c + "2") for c in df.columns))

    cold = members.filter(F.col("members") <= COLD).select("key", "digest", "n")
    alike = F.least("n", "n2") + F.lit(1e-9) >= F.greatest("n", "n2") * F.lit(similarity)  # sets of other sizes cannot be near
    pairs = cold.join(other(cold), "key").filter((F.col("digest") < F.col("digest2")) & alike).select(F.col("digest").alias("u"), F.col("digest2").alias("v"))
    edges = _verified(simhash_pairs(points.select("digest", "fp")).unionByName(pairs), docs, text_col, shingle, similarity)
    hot = members.filter(F.col("members") > COLD)
    if not hot.isEmpty():
        known = hot.groupBy("digest").agg(F.sum("members").alias("weight"))
        hot = stored(hot.select("key", "digest", "members").join(known, "digest"), "hot")
        texts = stored(_contents(docs, text_col).join(known.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")), "texts")

        def labelled(edges: DataFrame) -> DataFrame:
            labels = connected_components(edges)
            return stored(hot.join(labels, hot["digest"] == labels["node"], "left").select("key", "digest", "members", "weight", F.coalesce("label", "digest").alias("label")), "labelled")

        def dealt(rows: DataFrame, size: str, own: str, across: str, blocks: str) -> DataFrame:
            """rows in one block each of their side, and in every block of the other."""
            block = F.pmod(F.xxhash64("digest"), F.ceil(F.col(size) / CELL)).cast("int")
            return rows.select("key", "digest", "label", block.alias(own), F.explode(F.sequence(F.lit(0), (F.ceil(F.col(blocks) / CELL) - 1).cast("int"))).alias(across))

        now = labelled(edges)
        top = now.groupBy("key").agg(F.max(F.struct("weight", "digest", "label")).alias("top"), F.first("members").alias("members"), F.lit(1).alias("one"))
        top = top.select("key", "members", "one", "top.digest", "top.label")
        edges = edges.unionByName(_linked(dealt(top, "one", "i", "j", "members"), dealt(now.withColumn("one", F.lit(1)), "members", "j", "i", "one"), texts, shingle, similarity))
        now = labelled(edges)
        largest = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"))
        rest = stored(now.join(largest, "key").filter(F.col("label") != F.col("most.label")).select("key", "digest", "label", "members"), "rest")
        if not rest.isEmpty():
            left_out = rest.groupBy("key").agg(F.count(F.lit(1)).alias("outside"))
            edges = edges.unionByName(_linked(dealt(rest.join(left_out, "key"), "outside", "i", "j", "members"), dealt(now.join(left_out, "key"), "members", "j", "i", "outside"), texts, shingle, similarity))
    labels = stored(connected_components(edges), "labels")
    named = points.join(labels, points["digest"] == labels["node"], "left").select("digest", "first", F.coalesce("label", "digest").alias("label"))
    named = stored(named, "named")
    named = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("digest", "component_id")
    return rows.select("id", "digest").join(named, "digest").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of near copies: the rows whose id is the component's smallest.

    Rows that repeat an id repeat it in the result; rows of null ids stay only where the
    component has no other.
    """
    groups = near_copies(docs, id_col, text_col)
    gone = groups.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
