"""Quality by a generalised additive model: cyclic boosted shallow trees give a table per feature and per pair of features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, utf8

FEATURES = (
    "log words", "word length", "longest word", "distinct words", "most frequent word", "words that repeat the one before", "short words", "words that end in a letter",
    "symbols", "exclamations", "bars", "stops and commas", "digits", "capitals", "not ASCII", "white space", "repeated lines", "words a line", "longest line", "entropy of bytes",
)
#: Bins of a feature, and of a feature in a pair.
BINS, COARSE = 48, 8
#: Most leaves of a tree on one feature; trees on a pair have four.
LEAVES = 3
#: Step of a tree, most rounds over all features, rounds without gain after which they end, pairs of a bag and their rounds.
RATE, ROUNDS, PATIENCE, PAIRS, PAIR_ROUNDS = 0.1, 200, 15, 8, 60
RIDGE = 2.0

_SYMBOLS = np.frombuffer(b"#*$%&<>@^~_=\\{}[]", np.uint8)
_UPPER, _LOWER, _DIGITS = (np.arange(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))
_BLANK = np.array([9, 10, 11, 12, 13, 32])


def features(text: bytes) -> list[float]:
    """The numbers of FEATURES for a whole text; a text without words has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    often = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = Counter(w[-1] for w in words)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    by_line = [len(line.split()) for line in text.split(b"\n")]
    lines = Counter(line for line in text.split(b"\n") if line.strip())
    n_lines = max(1, lines.total())
    share = counts[counts > 0] / size
    return [
        log(1 + n), lengths.mean(), log(1 + lengths.max()), len(often) / n, max(often.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, float((lengths <= 3).mean()),
        sum(k for b, k in ends.items() if b >= 128 or chr(b).isalpha()) / n, counts[_SYMBOLS].sum() / n, counts[33] / n, counts[124] / n, (counts[44] + counts[46]) / n,
        counts[_DIGITS].sum() / size, counts[_UPPER].sum() / max(1, letters), counts[128:].sum() / size, counts[_BLANK].sum() / size, 1 - len(lines) / n_lines, log(1 + n / n_lines), log(1 + max(by_line)),
        float(-(share * np.log2(share)).sum()),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """bias, inner bin edges and a table per feature, and tables of pairs over coarse bins.

    A score is the logistic function of the bias and the table entries of a text's bins, added.
    """

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for (i, j), table in self.pairs.items():
            z += table[coarse(b[:, i], len(self.edges[i])), coarse(b[:, j], len(self.edges[j]))]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def coarse(bins: np.ndarray, n_edges: int) -> np.ndarray:
    """Bins 0 ... n_edges in COARSE groups of neighbours."""
    return bins * COARSE // (n_edges + 1)


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Inner edges of at most BINS bins of about as many values; equal values share a bin."""
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) else np.zeros(0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow tree over ordered bins with sums g of gradients and h of their weights: the value of each bin.

    The split that gains most is made first, until there are that many leaves or none gains.
    """
    gs, hs = np.append(0.0, np.cumsum(g)), np.append(0.0, np.cumsum(h))

    def worth(a: int, b: np.ndarray | int) -> np.ndarray | float:
        return (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + RIDGE)

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gain = worth(a, cuts) + (gs[b] - gs[cuts]) ** 2 / (hs[b] - hs[cuts] + RIDGE) - worth(a, b)
                best = max(best, (float(gain.max()), k, int(cuts[gain.argmax()])))
        if not best[2]:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The cut of either axis of a pair's grid of sums that gains most, its gain and the value of each cell."""
    gs, hs = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))

    def four(s: np.ndarray) -> list[np.ndarray]:
        inner, right, below = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1]
        return [inner, right - inner, below - inner, s[-1, -1] - right - below + inner]

    gain = sum(a**2 / (b + RIDGE) for a, b in zip(four(gs), four(hs)))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(four(gs), four(hs))]
    out = np.empty_like(g, dtype=float)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - gs[-1, -1] ** 2 / (hs[-1, -1] + RIDGE)), out


def boost(bins: np.ndarray, sizes: list[int], y: np.ndarray, seed: int) -> tuple[float, list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """Bias, tables and pair tables of one bag: a fifth of its rows tells when to stop.

    Each round takes the features in turn and adds a step of one tree to a feature's table. Then
    the pairs whose quadrants explain most of what is left get tables of their own, in turn too.
    """
    rng = np.random.default_rng(seed)
    learn = rng.permutation(len(y)) >= len(y) // 5
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = log(share / (1 - share))
    z = np.full(len(y), bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where(learn, y - p, 0), np.where(learn, p * (1 - p), 0)

    def loss() -> float:
        return float(np.logaddexp(0, np.where(y > 0, -z, z))[~learn].mean()) if not learn.all() else 0.0

    tables = [np.zeros(n) for n in sizes]
    best, since, held = loss(), 0, ([t.copy() for t in tables], z.copy())
    for _ in range(ROUNDS):
        for j, n in enumerate(sizes):
            g, h = gradient()
            step = RATE * tree(np.bincount(bins[:, j], g, n), np.bincount(bins[:, j], h, n))
            tables[j] += step
            z += step[bins[:, j]]
        since += 1
        if (now := loss()) < best - 1e-5:
            best, since, held = now, 0, ([t.copy() for t in tables], z.copy())
        if since >= PATIENCE:
            break
    tables, z = held
    groups = np.column_stack([coarse(bins[:, j], n - 1) for j, n in enumerate(sizes)])

    def grids(i: int, j: int, sums: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        cell = groups[:, i] * COARSE + groups[:, j]
        return [np.bincount(cell, s, COARSE * COARSE).reshape(COARSE, COARSE) for s in sums]

    sums = gradient()
    gains = {(i, j): quadrants(*grids(i, j, sums))[0] for i, j in combinations(range(len(sizes)), 2)}
    pairs = {k: np.zeros((COARSE, COARSE)) for k in sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]}
    since, held_pairs = 0, {k: t.copy() for k, t in pairs.items()}
    for _ in range(PAIR_ROUNDS):
        for i, j in pairs:
            step = RATE * quadrants(*grids(i, j, gradient()))[1]
            pairs[i, j] += step
            z += step[groups[:, i], groups[:, j]]
        since += 1
        if (now := loss()) < best - 1e-5:
            best, since, held_pairs = now, 0, {k: t.copy() for k, t in pairs.items()}
        if since >= PATIENCE:
            break
    return bias, tables, held_pairs


def held_out(id_column: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _features(docs: DataFrame, keys: dict[str, str], text_col: str) -> DataFrame:
    """The key columns (with their types) of docs and x, the features of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            x = matrix([t or b"" for t in utf8(b.column(len(keys)))])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(list(x), pa.list_(pa.float64()))], names=[*keys, "x"])

    schema = "".join(f"`{n}` {kind}, " for n, kind in keys.items()) + "x array<double>"
    return docs.select(*keys, docs[text_col].cast("string")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, bags: int = 4, id_col: str = "doc_id", text_col: str = "text", mark: str = "quality") -> Model:
    """Fit on the features of a bounded sample: the sample labelled rows that come first by a hash of their id, held-out ones apart.

    Features are worked out where the texts are; the driver and the tasks that fit a bag each
    get sample rows of numbers. A model is the mean of its bags: tables of one feature
    share their bins, and a pair that a bag did not choose counts as zeros there. Rows with a null
    id or mark are not learnt from; of rows that share an id one is; an id with two marks counts
    for both. Where a class is missing, every score is the share of marked rows (a half if there are no labels).
    """
    spark = docs.sparkSession
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(mark).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.select(F.col(id_col).alias("id"), (F.col(mark) != 0).cast("int").alias("mark")).distinct().orderBy(F.xxhash64("id"), "id", "mark").limit(sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")  # at most sample rows of numbers
    kind = docs.schema[id_col].dataType.simpleString()
    got = _features(rows, {"id": kind, "mark": "int"}, "text").groupBy("id", "mark").agg(F.min("x").alias("x")).orderBy("id", "mark").collect()
    y = np.array([r["mark"] for r in got], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        return Model(log(share / (1 - share)), [], [])
    x = np.array([r["x"] for r in got], float)
    model = Model(0.0, [bin_edges(x[:, j]) for j in range(x.shape[1])], [])
    sizes = [len(e) + 1 for e in model.edges]
    shared = spark.sparkContext.broadcast((model.bins(x), sizes, y))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bag in b.column(0).to_pylist():
                bias, tables, pairs = boost(*shared.value, seed=bag)
                parts = [(-1, -1, [bias]), *((j, -1, t.tolist()) for j, t in enumerate(tables)), *((i, j, t.ravel().tolist()) for (i, j), t in pairs.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["i", "j", "table"])

    model.tables = [np.zeros(n) for n in sizes]
    for i, j, table in spark.range(bags, numPartitions=bags).mapInArrow(fit, "i int, j int, table array<double>").orderBy("i", "j", "table").collect():
        if i < 0:
            model.bias += table[0] / bags
        elif j < 0:
            model.tables[i] += np.array(table) / bags
        else:
            model.pairs[i, j] = model.pairs.get((i, j), 0) + np.array(table).reshape(COARSE, COARSE) / bags
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1, higher: better) and predicted for each row of docs, from its whole text alone.

    Null texts count as empty, and texts without words share the features zero; null ids stay
    null; repeated rows get equal scores; other columns are not read; an empty table gives an
    empty one. The model is a few tables of at most BINS and COARSE * COARSE numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = shared.value.scores(matrix([t or b"" for t in utf8(b.column(1))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
