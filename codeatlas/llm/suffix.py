"""Removal of long repeated byte strings: a prefix-free parse, and the suffix order of its dictionary."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: A repeat has REPEAT bytes at least; a trigger is a string of TRIGGER bytes.
REPEAT = 100
TRIGGER = 32
#: A phrase ends at the first trigger whose hash is divisible by SPACING, from SHORTEST bytes on, and at LONGEST bytes.
SPACING = 512
SHORTEST = 256
LONGEST = 8192
#: Contexts of an anchor that are put in order in one place; an anchor of more is dealt out.
CROWDED = 1 << 15
#: Bytes whose hashes are computed at once, and anchors of a task that are looked over together.
CHUNK = 1 << 20
TOGETHER = 400_000
#: Bytes before an anchor that a window can hold; windows of an anchor.
_REACH = REPEAT - TRIGGER
_WINDOWS = _REACH + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_OFFSET_BITS = 14
_OFFSET = (1 << _OFFSET_BITS) - 1


class Roller:
    """Rolling hashes of all TRIGGER-byte strings of a text, mod 2**64, from sums over its bytes."""

    values = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            n = max(n, 2 * len(cls._powers))
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))

    @classmethod
    def hashes(cls, raw: np.ndarray) -> np.ndarray:
        """The hash of the string that begins at each byte; none is 0."""
        n = len(raw) - TRIGGER + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        cls._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(cls.values[raw] * cls._powers[: len(raw)], out=sums[1:])
        h = (sums[TRIGGER:] - sums[:n]) * cls._inverse[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return np.maximum(h, np.uint64(1))


def triggers(raw: np.ndarray) -> np.ndarray:
    """Places of the strings of TRIGGER bytes whose rolling hash is divisible by SPACING."""
    found = []
    for k in range(0, len(raw), CHUNK):
        h = Roller.hashes(raw[k : k + CHUNK + TRIGGER - 1])
        found.append(np.flatnonzero(h % np.uint64(SPACING) == 0) + k)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def phrases(places: list[int], n: int) -> list[tuple[int, int]]:
    """Start and number of windows of each phrase of a text of n bytes that has triggers at places.

    A window is a string of REPEAT bytes, and every one begins in one phrase. A phrase's bytes
    go on to the end of its last window, so they hold the trigger that ends it whole, and
    where it ends depends on its own bytes alone: no phrase begins another one.
    """
    starts, last = [0], n - REPEAT
    while True:
        k = bisect_left(places, starts[-1] + SHORTEST)
        end = min(places[k] if k < len(places) else n, starts[-1] + LONGEST)
        if end > last:
            return [(a, b - a) for a, b in zip(starts, [*starts[1:], last + 1])] if last >= 0 else []
        starts.append(end)


def parse(docs: DataFrame) -> DataFrame:
    """doc, start and phrase for every phrase of docs (columns doc, raw); texts under REPEAT bytes have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bytes_, ends = _buffer(b.column(1))
            at, docs_, starts, texts = triggers(bytes_), [], [], []
            cut = np.searchsorted(at, ends)
            whole = memoryview(bytes_)
            for k, doc in enumerate(b.column(0).to_pylist()):
                first = int(ends[k])
                for start, windows in phrases((at[cut[k] : cut[k + 1]] - first).tolist(), int(ends[k + 1]) - first):
                    docs_.append(doc)
                    starts.append(start)
                    texts.append(bytes(whole[first + start : first + start + windows + REPEAT - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], names=["doc", "start", "phrase"])

    return docs.select("doc", "raw").mapInArrow(run, "doc bigint, start bigint, phrase binary")


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values in a row, and where each begins (and the last one ends)."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not column.buffers()[2]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The minimum or maximum of every width values in a row, in linear time: block-wise running bests from both sides."""
    n = len(values)
    fill = values[-1:].repeat(-n % width)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).reshape(-1)
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """The anchors of some phrases, given as their bytes in a row and their bounds.

    The anchor of a window is the string of TRIGGER bytes in it whose rolling hash is least.
    It depends on the window alone, so equal windows have equal anchors at equal places.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray) -> None:
        self.raw, self.begins, self.ends = raw, bounds[:-1], bounds[1:]
        self.keys = Roller.hashes(raw)
        self.least = sliding(self.keys, _WINDOWS, np.minimum) if len(raw) >= REPEAT else np.zeros(0, np.uint64)
        whole = np.arange(len(self.least)) + REPEAT <= np.repeat(self.ends, self.ends - self.begins)[: len(self.least)]
        self.least[~whole] = 0  # windows over a border
        edge = np.zeros(_REACH, np.uint64)
        self.at = np.flatnonzero(self.keys == sliding(np.concatenate([edge, self.least, edge]), _WINDOWS, np.maximum)) if len(self.least) else np.zeros(0, np.int64)
        self.phrase = np.searchsorted(self.begins, self.at, "right") - 1

    def own(self, at: np.ndarray) -> np.ndarray:
        """Per place, for each number of bytes before it (0 to _REACH), whether the window that begins there has this anchor."""
        start = at[:, None] - np.arange(_WINDOWS)[None, :]
        inside = (start >= 0) & (start < len(self.least))
        return inside & (self.least[np.clip(start, 0, len(self.least) - 1)] == self.keys[at][:, None])

    def contexts(self, at: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Per place, what windows can hold: the _REACH bytes before it, backwards, and REPEAT bytes from it, zero outside the phrase."""
        place = at[:, None] + np.concatenate([-1 - np.arange(_REACH), np.arange(REPEAT)])[None, :]
        inside = (place >= self.begins[phrase][:, None]) & (place < self.ends[phrase][:, None])
        return np.where(inside, self.raw[np.clip(place, 0, len(self.raw) - 1)], 0).astype(np.uint8)


def _steps(words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key and bytes, and how many bytes each shares with the row before it in it (-1: another key)."""
    n, width = words.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = words
    columns = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*columns.T[::-1], keys))
    return order, _shared(words[order], keys[order])


def _shared(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it; -1 where the key is another."""
    out = np.full(len(words), -1, np.int64)
    if len(words) > 1:
        differ = words[1:] != words[:-1]
        out[1:] = np.where(keys[1:] == keys[:-1], np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1]), -1)
    return out


def later(keys: np.ndarray, near: np.ndarray, own: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the own windows of contexts, those that an earlier context (by doc, at) of the same key holds too.

    Contexts are put in suffix order twice: by the bytes from the anchor on, and by those before
    it, backwards. Windows with k bytes before the anchor are equal if their contexts share
    REPEAT - k bytes on and k bytes back, which the shared lengths of neighbours tell.
    """
    gone = np.zeros(own.shape, bool)
    by_place = np.lexsort((at, doc))
    keys, near, own = keys[by_place], near[by_place], own[by_place]
    back, back_shared = _steps(near[:, :_REACH], keys)
    on, on_shared = _steps(near[:, _REACH:], keys)
    n = len(keys)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(_WINDOWS):
        who = np.flatnonzero(own[:, k])
        if len(who) < 2:
            continue
        left[back] = np.cumsum(back_shared < k)
        right[on] = np.cumsum(on_shared < REPEAT - k)
        code = left[who] * (n + 1) + right[who]
        order = np.argsort(code, kind="stable")
        again = code[order][1:] == code[order][:-1]
        gone[by_place[who[order[1:][again]]], k] = True
    return gone


def _rows(table: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """The rows of a table of bytes as binary values; null where keep is false."""
    n, width = table.shape
    keep = np.ones(n, bool) if keep is None else keep
    ends = np.concatenate([[0], np.cumsum(keep * width)]).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [pa.py_buffer(np.packbits(keep, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(table[keep]))])
    return values.cast(pa.binary())


def _bits(mask: np.ndarray) -> pa.Array:
    """Rows of a mask as binary values; null where none is set."""
    return _rows(np.packbits(mask, axis=1), mask.any(axis=1))


def _table(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _mask(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """What _bits() made of a mask."""
    none = bytes(-(-_WINDOWS // 8))
    packed = np.frombuffer(b"".join(x or none for x in column.to_pylist()), np.uint8).reshape(-1, len(none))
    return np.unpackbits(packed, axis=1)[:, :_WINDOWS].astype(bool)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined until they have that many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of values of about size bytes."""
    ends = _buffer(column)[1]
    i = 0
    while i < len(column):
        k = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield i, k
        i = k


def repeated_anchors(dictionary: DataFrame) -> DataFrame:
    """doc, start and offsets: the places of anchors that occur at two places of the dictionary or more, by phrase.

    A task settles the anchors that it holds twice by itself and sends one row of each, so an
    anchor has no more rows in one place than there are tasks and stretches of TOGETHER anchors.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def settled() -> pa.RecordBatch:
            key, doc, spot = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((spot, doc, key))
            key, doc, spot = key[order], doc[order], spot[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            place = spot >> _OFFSET_BITS
            other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]) | new
            group = np.cumsum(new) - 1
            several = (np.bincount(group, other) > 1)[group]
            heads = key[new & several]
            kind = np.concatenate([several * 2, np.ones(len(heads), np.int64)]).astype(np.int32)
            route = np.concatenate([np.where(several, (doc << 20) ^ spot * 0x9E3779B1, key), heads])
            none = np.full(len(heads), -1, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(route), pa.array(kind), pa.array(np.concatenate([doc, none])), pa.array(np.concatenate([spot, none]))], names=["route", "kind", "doc", "spot"])

        for b in batches:
            for i, k in _slices(b.column(2)):
                some = b.slice(i, k - i)
                raw, bounds = _buffer(some.column(2))
                found = Anchors(raw, bounds)
                doc, start = some.column(0).to_numpy()[found.phrase], some.column(1).to_numpy()[found.phrase]
                offset = found.at - found.begins[found.phrase]
                held.append((found.keys[found.at].view(np.int64), doc, start + offset << _OFFSET_BITS | offset))
                n += len(offset)
                if n >= TOGETHER:
                    yield settled()
                    held, n = [], 0
        if n:
            yield settled()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def picked(t: pa.Table) -> pa.RecordBatch:
            route, kind, doc, spot = (t.column(c).to_numpy() for c in range(4))
            keep = kind == 2
            rest = np.flatnonzero(~keep)
            if len(rest):
                key, place = route[rest], spot[rest] >> _OFFSET_BITS
                new = np.concatenate([[True], key[1:] != key[:-1]])
                other = np.concatenate([[True], (doc[rest][1:] != doc[rest][:-1]) | (place[1:] != place[:-1])]) | new
                group = np.cumsum(new) - 1
                known = np.bincount(group, other + 2.0 * (kind[rest] == 1)) > 1
                keep[rest] = known[group] & (kind[rest] == 0)
            offset = spot[keep] & _OFFSET
            return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array((spot[keep] >> _OFFSET_BITS) - offset), pa.array(offset.astype(np.int32))], names=["doc", "start", "offset"])

        for t in _gathered(batches, TOGETHER):
            held = t if held is None else pa.concat_tables([held, t])
            routes = held.column("route").to_numpy()
            whole = int(np.searchsorted(routes, routes[-1], "left"))  # the last key may go on
            if whole:
                yield picked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield picked(held)

    rows = dictionary.select("doc", "start", "phrase").mapInArrow(send, "route bigint, kind int, doc bigint, spot bigint")
    dealt = rows.repartition("route").sortWithinPartitions("route", "doc", "spot")
    return dealt.mapInArrow(judge, "doc bigint, start bigint, offset int").groupBy("doc", "start").agg(F.collect_list("offset").alias("offsets"))


CONTEXT = "key bigint, doc bigint, at bigint, near binary, own binary, gone binary"


def _context_batch(key: np.ndarray, doc: np.ndarray, at: np.ndarray, near: np.ndarray, own: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """Rows of CONTEXT: near and own are null where no own window is left, gone where none is gone."""
    columns = [pa.array(key), pa.array(doc), pa.array(at), _rows(near, own.any(axis=1)), _bits(own), _bits(gone)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "doc", "at", "near", "own", "gone"])


def contexts(dictionary: DataFrame) -> DataFrame:
    """CONTEXT rows of the anchors at offsets in dictionary's phrases; windows that a task finds twice are settled there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            key, doc, at, near, own = (np.concatenate(x) for x in zip(*held))
            gone = np.zeros(own.shape, bool)
            order = np.argsort(key, kind="stable")
            twice = np.zeros(len(key), bool)
            twice[1:] = key[order][1:] == key[order][:-1]
            twice[:-1] |= twice[1:]
            some = order[twice]
            gone[some] = later(key[some], near[some], own[some], doc[some], at[some])
            for k in range(0, len(key), 8192):
                s = slice(k, k + 8192)
                yield _context_batch(key[s], doc[s], at[s], near[s], own[s] & ~gone[s], gone[s])

        for b in batches:
            for i, k in _slices(b.column(2)):
                some = b.slice(i, k - i)
                raw, bounds = _buffer(some.column(2))
                found = Anchors(raw, bounds)
                lists = some.column(3)
                phrase = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
                at = found.begins[phrase] + lists.flatten().to_numpy()
                doc, start = some.column(0).to_numpy()[phrase], some.column(1).to_numpy()[phrase]
                held.append((found.keys[at].view(np.int64), doc, start + at - found.begins[phrase], found.contexts(at, phrase), found.own(at)))
                n += len(at)
                if n >= CROWDED:
                    yield from settled()
                    held, n = [], 0
        if n:
            yield from settled()

    return dictionary.select("doc", "start", "phrase", "offsets").mapInArrow(run, CONTEXT)


def ordered(rows: DataFrame, backwards: bool) -> DataFrame:
    """Settle CONTEXT rows in their suffix order: by what stands before the anchor, or from it on.

    The order is a range partition, so the contexts of one anchor may lie in many tasks. An
    anchor that is whole in one stretch is settled. Of another, own keeps the windows that no
    earlier context of its stretch has and that a neighbour in the order may share.
    """
    back, on = F.substring("near", 1, _REACH), F.substring("near", _REACH + 1, REPEAT)
    rows = rows.select("key", "doc", "at", "near", "own", F.concat(on, back).alias("text") if not backwards else F.col("near").alias("text"))
    dealt = rows.repartitionByRange("key", "text").sortWithinPartitions("key", "text", "doc", "at").drop("text")
    reach = np.arange(_WINDOWS) if backwards else REPEAT - np.arange(_WINDOWS)

    def settled(t: pa.Table, open_: np.ndarray) -> pa.RecordBatch:
        key, doc, at = (t.column(c).to_numpy() for c in ("key", "doc", "at"))
        near, own = _table(t.column("near"), _REACH + REPEAT), _mask(t.column("own"))
        gone = later(key, near, own, doc, at)
        shared = _shared(near[:, :_REACH] if backwards else near[:, _REACH:], key)
        shared[0] = REPEAT  # unknown: what went before it
        most = np.maximum(shared, np.append(shared[1:], REPEAT))
        left = own & ~gone & open_[:, None] & (reach[None, :] <= most[:, None])
        return _context_batch(key, doc, at, near, left, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        goes_on = True  # the first key may have begun in another task
        for t in _gathered(batches, CROWDED):
            held = t if held is None else pa.concat_tables([held, t])
            keys = held.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1], "left"))
            if whole:
                yield settled(held.slice(0, whole), goes_on & (keys[:whole] == keys[0]))
                held, goes_on = held.slice(whole), False
            if held.num_rows >= CROWDED:
                yield settled(held, np.ones(held.num_rows, bool))
                held, goes_on = None, True
        if held is not None and held.num_rows:
            keys = held.column("key").to_numpy()
            yield settled(held, (goes_on & (keys == keys[0])) | (keys == keys[-1]))

    return dealt.mapInArrow(run, CONTEXT)


def windows(rows: DataFrame) -> DataFrame:
    """window (its bytes), doc and start for every own window of CONTEXT rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                some = b.slice(i, 1024)
                near, own = _table(some.column("near"), _REACH + REPEAT), _mask(some.column("own"))
                straight = np.concatenate([near[:, :_REACH][:, ::-1], near[:, _REACH:]], axis=1)
                row, before = np.nonzero(own)
                cut = straight[row[:, None], (_REACH - before)[:, None] + np.arange(REPEAT)[None, :]]
                yield pa.RecordBatch.from_arrays([_rows(cut), some.column("doc").take(pa.array(row)), pa.array(some.column("at").to_numpy()[row] - before)], names=["window", "doc", "start"])

    return rows.select("doc", "at", "near", "own").mapInArrow(run, "window binary, doc bigint, start bigint")


#: What the marks of a text say: a phrase stays, windows of an anchor go, they go unless listed, a listed one stays.
_PHRASE, _GONE, _MAYBE, _STAYS = range(4)


def marks(dictionary: DataFrame) -> DataFrame:
    """doc and marks (what, at, n, bits): which windows of a text are the first of their kind (dictionary: doc, start, phrase)."""

    def mark(rows: DataFrame, what: int, at: str, bits: str | None = None) -> DataFrame:
        none = F.lit(None)
        return rows.select("doc", F.lit(what).alias("what"), F.col(at).alias("at"), (F.col("n") if what == _PHRASE else F.lit(0)).cast("long").alias("n"), (F.col(bits) if bits else none).cast("binary").alias("bits"))

    first = dictionary.select("doc", "start", (F.octet_length("phrase") - REPEAT + 1).alias("n"))
    wanted = stored(repeated_anchors(dictionary), "anchors")
    found = stored(contexts(dictionary.join(wanted, ["doc", "start"])), "contexts")
    discard(wanted)
    once = stored(ordered(found.filter("own is not null"), backwards=True), "backwards")
    out = mark(first, _PHRASE, "start")
    for rows in (found, once):
        out = out.unionByName(mark(rows.filter("gone is not null"), _GONE, "at", "gone"))
    crowded = once.filter("own is not null")
    used = [found, once]
    if not crowded.isEmpty():
        twice = stored(ordered(crowded, backwards=False), "onwards")
        out = out.unionByName(mark(twice.filter("gone is not null"), _GONE, "at", "gone"))
        open_ = twice.filter("own is not null")
        stays = windows(open_).groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first")).select("first.*")
        out = out.unionByName(mark(open_, _MAYBE, "at", "own")).unionByName(mark(stays, _STAYS, "start"))
        used.append(twice)
    out = stored(out.groupBy("doc").agg(F.collect_list(F.struct("what", "at", "n", "bits")).alias("marks")), "marks")
    discard(*used)
    return out


def covered(n: int, what: np.ndarray, at: np.ndarray, size: np.ndarray, bits: list[bytes | None]) -> np.ndarray:
    """Which of the n bytes of a text a window covers that is not the first of its kind."""
    gone = np.ones(n - REPEAT + 1, bool)
    for s, k in zip(at[what == _PHRASE].tolist(), size[what == _PHRASE].tolist()):
        gone[s : s + k] = False
    some = np.flatnonzero((what == _GONE) | (what == _MAYBE))
    if len(some):
        mask = np.frombuffer(b"".join(bits[i] for i in some.tolist()), np.uint8).reshape(len(some), -1)
        row, before = np.nonzero(np.unpackbits(mask, axis=1)[:, :_WINDOWS])
        gone[at[some][row] - before] = True
        gone[at[what == _STAYS]] = False
    steps = np.zeros(n + 1, np.int32)
    steps[: len(gone)] += gone
    steps[REPEAT:] -= gone
    return np.cumsum(steps[:-1]) > 0


def spans(covered: np.ndarray) -> int:
    """The number of runs of true values."""
    return int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())


def _distinguished(rows: DataFrame) -> DataFrame:
    """rows, with doc numbered anew in its order where rows of one id have different texts: the shorter first, then by SHA-256."""
    sums = rows.select("doc", F.octet_length("raw").alias("size"), F.sha2("raw", 256).alias("text"))
    if sums.groupBy("doc").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").isEmpty():
        return rows
    order = sums.distinct().repartitionByRange("doc", "size", "text").sortWithinPartitions("doc", "size", "text")
    numbers = stored(order.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return rows.withColumn("text", F.sha2("raw", 256)).join(numbers, ["doc", "text"]).select("id", F.col("number").alias("doc"), "raw")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove each byte that a string of REPEAT bytes (a window) covers which also starts earlier in the corpus.

    Returns a row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, if texts is
    true, kept_bytes. Earlier means a smaller id, or the same id and an earlier start; windows
    are judged on the input and never cross documents.

    A prefix-free parse cuts the texts into phrases at rolling-hash triggers. The dictionary
    holds each distinct phrase once, with the first place of it in the parse; all windows of
    its other places are repeats. Windows of the dictionary are put in suffix order: by their
    anchors, of which those at one place alone hold no repeat, and then by their bytes before
    and from the anchor on. Neighbours that share REPEAT bytes are equal, and all but
    the first of them in corpus order, that of the parse, are repeats. Bytes are compared
    throughout; hashes only choose triggers and anchors.

    Null texts are empty; null ids come last; rows that share an id but not the text are
    ordered by size and SHA-256 of it, and rows that share both are one document; other columns are
    not read; an empty table gives an empty one. Ids are integers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    last = (1 << 63) - 1
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(last)).alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("raw"))
    rows = _distinguished(rows)
    first = parse(rows).groupBy("phrase").agg(F.min(F.struct("doc", "start")).alias("first"))
    dictionary = stored(first.select("first.doc", "first.start", "phrase"), "dictionary")
    plan = marks(dictionary)
    discard(dictionary)
    ready = rows.join(plan, "doc", "left").select("id", "raw", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lists = [], b.column(2)
            inner = lists.flatten()
            what, at, n = (inner.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            for k in range(b.num_rows):
                raw = b.column(1)[k].as_py()
                s = slice(int(ends[k]), int(ends[k + 1]))
                if len(raw) >= REPEAT:
                    gone = covered(len(raw), what[s], at[s], n[s], inner.field(3)[s].to_pylist())
                else:
                    gone = np.zeros(len(raw), bool)
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), spans(gone), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out)) or [[]] * 5
            fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary())][: 4 + texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], names=["id", *(n for n, _ in fields)])

    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * texts
    return ready.mapInArrow(run, schema).withColumnRenamed("id", id_col)
