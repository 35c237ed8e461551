"""Token ids of whole texts, once, in the order of the documents, with places inside each part."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, small_batches, stored

#: A space between two characters that are not white space: tokens never cross it, so what stands between
#: two such places is encoded alone. Texts with other runs of white space are cut by the pattern.
_RUN = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters that normal forms and lower case leave letters: words of them can be encoded in a row and told apart afterwards.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ɏ"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_ENDS_IN_LETTER = rf"[{_LETTERS}]\z"
#: Marks that tokens never share with such a letter before them (ASCII punctuation but the apostrophe, which contractions hold).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A piece of letters, perhaps marks, a line end and perhaps letters again: tokens cross none of these borders.
_STEMS = re.compile(rf"([^\W\d_]*[{_LETTERS}])([{re.escape(_MARKS)}]*)(\n)([^\W\d_]*)")
#: Encoded pieces in each of a worker's two generations, and the longest piece among them.
CACHE = 400_000
LONGEST = 48
#: Bytes of texts that are encoded together, so that a piece in many of them is looked up once.
TOGETHER = 12_000_000
#: Most sums of parts and queues that are broadcast; more are joined by shuffle.
MOST_SUMS = 500_000
#: Marks the first piece of a text, which no space precedes.
_FIRST = "\0"


def _single_spaced(text: str) -> bool:
    """Whether no white space stands at an end or beside other white space. Most texts hold no more than spaces and line ends."""
    if text.replace("\n", "x").isprintable():
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")) or not text
    return not _RUN.search(text)


def _cut(text: str) -> list[str]:
    """The pieces of a text with other white space; one that the first piece's mark could confuse stays whole."""
    if " " + _FIRST in text:
        return [_FIRST + text]
    first, *rest = _CUT.split(text)
    return [_FIRST + first, *rest]


def _parted(pieces: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Each piece without the marks that end it, where a letter is before them, and those marks."""
    bare = pc.utf8_rtrim(pieces, _MARKS)
    bare = pc.if_else(pc.match_substring_regex(bare, _ENDS_IN_LETTER), bare, pieces)
    n = len(pieces)
    if not n:
        return pieces, pieces
    at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + n + 1]
    cuts = np.column_stack([at[:-1], at[:-1] + pc.binary_length(bare).to_numpy()]).reshape(-1)
    both = pa.StringArray.from_buffers(2 * n, pa.py_buffer(np.append(cuts, at[-1]).astype(np.int32)), pieces.buffers()[2])
    return both.take(pa.array(np.arange(0, 2 * n, 2))), both.take(pa.array(np.arange(1, 2 * n, 2)))


def _every_two(values: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """The values joined in twos."""
    n = len(values) // 2
    at = np.frombuffer(values.buffers()[1], np.int64)[: 2 * n + 1 : 2] if n else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(at)), values.buffers()[2]])


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library; ids fit 16 bits.

    Texts are cut at single spaces and each distinct piece is encoded by the library once, as
    long as the bounded cache holds it: what is used stays, as one generation of pieces passes
    into the next. A text that holds a string of the file's added tokens is encoded whole. The
    result is that of encode(text, add_special_tokens=False).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.all_whole = any(t.normalized for t in added)  # such are found in the normal form of a text, not in the text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins, self.ends = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for name, i in names.items():
            self.begins[i], self.ends[i] = name.startswith("Ġ"), name.endswith("</w>")
        self.line_end = names.get("Ċ", -1)  # a token of white space where it is kept

    def _single(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _in_a_row(self, words: list[str], apart: str) -> list[bytes]:
        """Plain words, each after a space or, if line ends set them apart, after none: encoded together and parted where a word begins or ends."""
        if not words:
            return []
        lead = apart if apart == " " else ""
        ids = np.asarray(self.tokenizer.encode_batch_fast([lead + apart.join(words)], add_special_tokens=False)[0].ids, "<u2")
        gaps = np.flatnonzero(ids == self.line_end) if apart == "\n" else ids[:0]
        if len(gaps):
            starts, stops = np.append(0, gaps + 1), np.append(gaps, len(ids))
        elif apart == " " and self.begins[ids[:1]].all() and self.begins[ids].any():
            starts = np.flatnonzero(self.begins[ids])
            stops = np.append(starts[1:], len(ids))
        else:
            stops = np.flatnonzero(self.ends[ids]) + 1
            starts = np.append(0, stops[:-1])
        if len(starts) != len(words) or len(stops) != len(words) or stops[-1] != len(ids):
            return self._single([lead + w for w in words])
        raw = ids.tobytes()
        return [raw[i:k] for i, k in zip((2 * starts).tolist(), (2 * stops).tolist())]

    def _encode(self, pieces: set[str]) -> set[str]:
        """The ids of pieces (keys: without their space, or with the mark of a first piece)."""
        stems = {p for p in pieces if p.isalpha()}
        compound: dict[str, list[str]] = {}
        for p in pieces - stems:
            m = _STEMS.fullmatch(p)
            if m:
                compound[p] = [m[1], *(_FIRST + x for x in m.groups()[1:] if x)]
            else:
                stems.add(p)
        stems |= self._recall({x for own in compound.values() for x in own} - stems)
        plain = [x for x in stems if x.isascii() and x.isalpha() or _PLAIN.fullmatch(x)]
        other = stems.difference(plain)
        first = [x[1:] for x in other if x[0:1] == _FIRST and _PLAIN.fullmatch(x, 1)]
        other = list(other.difference([_FIRST + x for x in first]))
        fresh: dict[str, bytes] = {}
        for i in range(0, len(plain), 2000):
            fresh.update(zip(plain[i : i + 2000], self._in_a_row(plain[i : i + 2000], " ")))
        for i in range(0, len(first), 2000):
            fresh.update(zip([_FIRST + x for x in first[i : i + 2000]], self._in_a_row(first[i : i + 2000], "\n")))
        fresh.update(zip(other, self._single([x[1:] if x[0:1] == _FIRST else " " + x for x in other])))
        self.known.update(fresh)
        known = self.known
        known.update({p: b"".join([known[x] for x in own]) for p, own in compound.items()})
        return stems.union(compound)

    def _recall(self, keys: set[str]) -> set[str]:
        """The keys that no generation knows; those of the older one pass into the younger."""
        new = keys - self.known.keys()
        for k in new & self.older.keys():
            self.known[k] = self.older[k]
        return new - self.known.keys()

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers.

        Arrow cuts the texts and finds their distinct pieces; Python sees those alone. The ids
        of all pieces in a row are one buffer, and a text's ids a stretch of it.
        """
        whole = [k for k, t in enumerate(texts) if self.all_whole or any(x in t for x in self.added)]
        if whole:
            out = self.many(["" if k in set(whole) else t for k, t in enumerate(texts)]) if len(whole) < len(texts) else [b""] * len(texts)
            for k in whole:
                out[k] = self._single([texts[k]])[0]
            return out
        plain = [_single_spaced(t) and " " + _FIRST not in t for t in texts]
        spaced = pc.split_pattern(pa.array([_FIRST + t for t, p in zip(texts, plain) if p], pa.string()), " ")
        others = pa.array([_cut(t) for t, p in zip(texts, plain) if not p], pa.list_(pa.string()))
        sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (spaced, others)])
        pieces = pa.concat_arrays([spaced.flatten(), others.flatten()]).dictionary_encode()
        stems, tails = (x.dictionary_encode() for x in _parted(pieces.dictionary))
        known_stems, known_tails = stems.dictionary.to_pylist(), [_FIRST + x if x else "" for x in tails.dictionary.to_pylist()]
        fresh = self._encode(self._recall(set(known_stems).union(filter(None, known_tails))))
        found = [self.known[x] for x in known_stems] + [self.known[x] if x else b"" for x in known_tails]
        both = np.column_stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(known_stems)]).reshape(-1)
        ids = _every_two(pa.array(found, pa.large_binary()).take(pa.array(both))).take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        bounds = at[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        stretches = [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])]
        for p in fresh:
            if len(p) > LONGEST:
                del self.known[p]
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        ahead, behind = iter(stretches[: len(spaced)]), iter(stretches[len(spaced) :])
        return [next(ahead if p else behind) for p in plain]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def local_path(tokenizer: str) -> str:
    """tokenizer: a path, or the name of a file of the installed public_tokenizers."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", queue: Column | None = None, parts: int | None = None) -> DataFrame:
    """part, id, queue, before, n_tokens and ids (16-bit, the end id last) for each row of docs, stored once.

    Rows are dealt by ranges of id into parts and sorted in each by id and a hash of text and
    queue, nulls first; before counts the ids of the part's earlier rows of the same queue (all
    rows are one queue by default). Only texts are shuffled, and encoding follows once. parts
    is the number of ranges (the session's shuffle partitions by default).
    """
    spark = docs.sparkSession
    queue = F.lit(0) if queue is None else queue
    rows = docs.select(docs[id_col].alias("id"), queue.cast("int").alias("queue"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id"), F.xxhash64("text", "queue")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = rows.schema["id"].dataType.simpleString()
    tail = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(local_path(tokenizer)).many
        so_far: dict[int, int] = {}

        def finished(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoded = iter(encode([t for b in held for t in b.column("text").to_pylist()]))
            for b in held:
                ids, before, sizes = [x + tail for x in islice(encoded, b.num_rows)], [], []
                for x, q in zip(ids, b.column("queue").to_pylist()):
                    sizes.append(len(x) // 2)
                    before.append(so_far.get(q, 0))
                    so_far[q] = before[-1] + sizes[-1]
                columns = [b.column("part"), b.column("id"), b.column("queue"), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "id", "queue", "before", "n_tokens", "ids"])

        held: list[pa.RecordBatch] = []
        for b in sliced(batches):
            held.append(b)
            if sum(x.nbytes for x in held) >= TOGETHER:
                yield from finished(held)
                held = []
        yield from finished(held)
        pa.default_memory_pool().release_unused()

    with small_batches(spark):
        return stored(dealt.mapInArrow(run, f"part int, id {kind}, queue int, before bigint, n_tokens bigint, ids binary"), "tokens")


def placed(tokens: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """tokens with place, the ids of all earlier rows of its queue, and the total of each queue.

    The sums by part and queue are a small table; its running sums are found in Spark, a
    queue apart from the others, and it is broadcast only while its count allows. Either way
    the rows of a part stay in one partition and in their order.
    """
    sums = stored(tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n")), "parts")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    few = sums.count() <= MOST_SUMS
    totals = {r[0]: r[1] for r in sums.groupBy("queue").agg(F.sum("n")).collect()}
    rows = tokens.join(F.broadcast(bases) if few else bases.hint("shuffle_merge"), ["part", "queue"])
    rows = rows.withColumn("place", F.col("base") + F.col("before")).drop("base", "before")
    return rows if few else rows.repartition("part").sortWithinPartitions("part", "place"), totals
