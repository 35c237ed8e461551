"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, utf8

#: Words in a window.
WINDOW = 8
#: Bytes from which on a window is cut, so that the dictionary stays in the compressor's reach, and by which its parts overlap.
LONGEST = 256
OVERLAP = 64
#: Bytes of the trained ordinary dictionary, and most bytes that follow it: toxic segments in one dictionary, ordinary text in the other.
BYTES = 16_384
OWN = 4_096
#: Segments that toxic dictionaries are cut into, and how far apart they begin.
SEGMENT, STEP = 12, 4
#: Lengths of segments and of strings that training counts, and bytes of each toxic dictionary that is trained.
TRAININGS = ((16, 6, 4_096), (16, 8, 4_096), (24, 8, 8_192), (32, 8, 8_192))
#: A segment is toxic if it saves LIFT times as many bytes in a toxic window as in an ordinary one, and LEAST bytes in all.
LIFT, LEAST = 20.0, 10
#: A window counts as a hit from this many bytes on.
HIT = 3


def windows(text: bytes, overlap: int = OVERLAP) -> Iterator[bytes]:
    """WINDOW words each. A longer run of bytes than LONGEST is cut every LONGEST bytes into parts that overlap."""
    words = text.lower().split()
    for i in range(0, len(words), WINDOW):
        window = b" ".join(words[i : i + WINDOW])
        if len(window) <= LONGEST:
            yield window
        else:
            for k in range(0, max(1, len(window) - overlap), LONGEST):
                yield window[k : k + LONGEST + overlap]


def compressor(dictionary: bytes):
    """Compression of windows with a dictionary that was trained (its entropy tables come first)."""
    p = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(dictionary), source_size=64, write_content_size=False, write_dict_id=False, write_checksum=False)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def trained(samples: list[bytes], size: int, k: int = 16, d: int = 6) -> bytes:
    """A trained dictionary of size bytes, or of as many as so few samples give; none if they give none."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
        except (zstandard.ZstdError, ValueError):
            size //= 2
    return b""


def dictionaries(toxic: list[bytes], ordinary: list[bytes], rounds: int = 2) -> tuple[bytes, bytes] | None:
    """An ordinary and a toxic dictionary of equal size from the windows of either class; None if there are too few to train on.

    Both classes train dictionaries of their own. Toxic text is ordinary text for the most part, so
    a toxic dictionary is cut into segments, and those stay that compress toxic windows but not
    ordinary ones, as lengths with and without them tell. They follow the ordinary dictionary in
    the toxic one, as many bytes of ordinary windows in the other: what both know costs the same
    in both. A further round trains on the toxic windows that nothing compresses yet.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    common = trained(ordinary, BYTES) if toxic else b""
    if not common:
        return None
    plain = compressor(common)
    cost = [len(plain(w)) for w in toxic]
    least, own, seen = list(cost), b"", set()
    for _ in range(rounds):
        rest = [w for w, a, b in zip(toxic, cost, least) if a - b < HIT]
        contents = [trained(rest, size, k, d) for k, d, size in TRAININGS] if rest else []
        segments = sorted({c[i : i + SEGMENT] for c in contents for i in range(0, len(c) - SEGMENT + 1, STEP)} - seen)
        seen.update(segments)
        wanted = {g for s in segments for g in _strings(s)}
        in_toxic, in_ordinary = _index(toxic, wanted), _index(ordinary, wanted)
        found = []
        for s in segments:
            hits, misses = ({n for g in _strings(s) for n in index.get(g, ())} for index in (in_toxic, in_ordinary))
            if len(hits) < 3 or len(hits) * len(ordinary) < 2 * len(misses) * len(toxic):
                continue
            compress = compressor(common + s)
            gain = sum(max(0, cost[n] - len(compress(toxic[n]))) for n in hits)
            loss = sum(max(0, len(plain(ordinary[n])) - len(compress(ordinary[n]))) for n in misses)
            if gain >= LEAST and gain / len(toxic) >= LIFT * (loss + 1) / len(ordinary):
                found.append((-gain, s, hits))
        for _, s, hits in sorted(found, key=lambda f: f[:2]):
            if len(own) + len(s) > OWN:
                break
            compress = compressor(common + s + own)
            now = {n: len(compress(toxic[n])) for n in hits}
            if sum(max(0, least[n] - x) for n, x in now.items()) >= LEAST:
                own = s + own
                for n, x in now.items():
                    least[n] = min(least[n], x)
    filler = b" ".join(ordinary[:: max(1, len(ordinary) * 40 // OWN)]).ljust(len(own), b" ")
    return common + filler[: len(own)], common + own


def _strings(text: bytes, n: int = 6) -> set[bytes]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def _index(texts: list[bytes], wanted: set[bytes]) -> dict[bytes, list[int]]:
    out = defaultdict(list)
    for n, t in enumerate(texts):
        for g in _strings(t) & wanted:
            out[g].append(n)
    return out


@dataclass
class Model:
    """pairs: an ordinary and a toxic dictionary each. weights: of the features, the bias first."""

    pairs: list[tuple[bytes, bytes]]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def features(self, text: bytes, pair: int = 0) -> list[float]:
        """Of the bytes that the toxic dictionary of a pair saves in each window: mean, largest, largest three, share and number of hits, number of windows, mean and sum of gains."""
        if self._ready is None:
            self._ready = [tuple(map(compressor, p)) for p in self.pairs]
        ordinary, toxic = self._ready[pair]
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)] or [0], float)
        top, gains = np.sort(saved)[-3:], np.maximum(saved, 0)
        hits = float((saved >= HIT).sum())
        return [saved.mean(), top[-1], top.mean(), hits / len(saved), np.log1p(hits), np.log1p(len(saved)), gains.mean(), np.log1p(gains.sum())]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """By every pair, weighted to the one that finds more: each knows words that the other lacks."""
        by_pair = []
        for k in range(len(self.pairs)):
            x = (np.array([self.features(t, k) for t in texts], float).reshape(len(texts), -1) - self.mean) / self.scale
            by_pair.append(self.weights[0] + x @ self.weights[1:])
        z = 0.5 * (np.max(by_pair, axis=0) + np.mean(by_pair, axis=0)) if by_pair else np.full(len(texts), self.weights[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the bias comes first."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, a.T @ (y - p) - ridge * w * (np.arange(len(w)) > 0))
    return w


def fit(texts: list[bytes], marks: list[int]) -> Model:
    """Train two pairs of dictionaries and calibrate them on labelled texts.

    Every other text of a class trains the first pair, the others the second. The calibration
    sees the features of each text by the pair that it did not train, so thresholds are
    fitted on rows that trained neither dictionary. Where one of the two classes is missing, or there is too little text to
    train on, every score is near the share of marked texts, and under 0.5 without any.
    """
    fold = [0] * len(texts)
    for y in (0, 1):
        for n, i in enumerate(i for i, m in enumerate(marks) if bool(m) == bool(y)):
            fold[i] = n % 2
    pairs = [dictionaries(*([w for t, m, f in zip(texts, marks, fold) if f == k and bool(m) == toxic for w in windows(t)] for toxic in (True, False))) for k in (0, 1)]
    share = (sum(map(bool, marks)) + 0.5) / (len(texts) + 2)
    model = Model([], np.zeros(8), np.ones(8), np.r_[np.log(share / (1 - share)), np.zeros(8)])
    if None in pairs:
        return model
    model.pairs = pairs
    x = np.array([model.features(t, 1 - f) for t, f in zip(texts, fold)], float)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = calibrate((x - model.mean) / model.scale, np.array(marks, float))
    return model


def held_out(id_column) -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int, id_col: str, text_col: str, mark: str) -> DataFrame | None:
    """text, mark of the rows that train() learns from; None without any.

    Ids are chosen from the labels alone, and their texts found by scans of docs.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(mark).isNotNull() & ~held_out(F.col(id_col)))
    order = ["order", "id", "mark"]
    chosen = usable.select(F.col(id_col).alias("id"), F.col(mark).cast("int").alias("mark")).distinct().withColumn("order", F.xxhash64("id")).orderBy(*order).limit(sample)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    sizes = texts.select("id", "hash", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "id")
    sizes = sizes.groupBy(*order).agg(F.min(F.struct("hash", "n")).alias("one")).select(*order, "one.*")
    picked, total = [], 0
    for r in sorted(sizes.collect()):  # sample rows at most
        if total + r["n"] <= sample_bytes:
            total += r["n"]
            picked.append((r["id"], r["hash"], r["mark"]))
    if not picked:
        return None
    wanted = docs.sparkSession.createDataFrame(picked, f"id {docs.schema[id_col].dataType.simpleString()}, hash bigint, mark int")
    return texts.join(F.broadcast(wanted), ["id", "hash"]).dropDuplicates(["id", "hash", "mark"]).select("text", "mark")


def _fitted(rows: list[tuple[bytes, int]]) -> Model:
    """fit() on the rows of a sample, whatever their order is."""
    rows = sorted((bytes(t), m) for t, m in rows)
    order = np.random.default_rng(9).permutation(len(rows))
    return fit([rows[i][0] for i in order], [rows[i][1] for i in order])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, sample_bytes: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text", mark: str = "toxic") -> Model:
    """Fit on a bounded sample: the sample labelled rows that come first by a hash of their id, held-out ones apart.

    Of rows that share an id one is learnt from. A text that would take the sample over
    sample_bytes is left out, so the driver gets no more rows and bytes than these. Rows with a null id or mark
    are not learnt from.
    """
    rows = _sampled(docs, labels, sample, sample_bytes, id_col, text_col, mark)
    return _fitted(rows.collect() if rows is not None else [])


def train_in_task(docs: DataFrame, labels: DataFrame, sample: int = 6000, sample_bytes: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text", mark: str = "toxic") -> Model:
    """train() where the driver's memory is short: the same model, but its bounded sample goes to a task and the driver gets the model alone."""
    rows = _sampled(docs, labels, sample, sample_bytes, id_col, text_col, mark)
    if rows is None:
        return fit([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fitted([r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first()[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted for each row of docs, from its whole text alone.

    Null texts count as empty and empty texts get a score like others; null ids stay null;
    repeated rows get equal scores; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # four dictionaries of BYTES + OWN bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = shared.value.scores([t or b"" for t in utf8(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the documents that score threshold or more; its columns are unchanged."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = shared.value.scores([t or b"" for t in utf8(b.column(place))])
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
