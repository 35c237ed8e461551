"""Token ids in Huffman-coded files: canonical codes of limited length, independent blocks, checkpoints."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoded, placed

#: The longest code, ids in a block (a document is never split over blocks), and ids between two checkpoints.
LIMIT = 18
BLOCK = 1 << 19
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits (package-merge); 0 for symbols without a count."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    by_weight = used[np.argsort(counts[used], kind="stable")]
    coins = counts[by_weight].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([coins, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(coins))
        ranked = both[order]
        packages = ranked[0 : len(ranked) // 2 * 2 : 2] + ranked[1 : len(ranked) // 2 * 2 : 2]
    lengths, take = np.zeros(len(coins), np.int64), 2 * len(coins) - 2
    for is_coin in reversed(levels):
        n = int(is_coin[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[by_weight] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths: by length, then by symbol, counting up."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for symbol in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each value of the next limit bits, the symbol times 256 and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    table = np.ones(1 << limit, np.uint32)
    table[: int(spans.sum())] = np.repeat(order.astype(np.uint32) << 8 | lengths[order], spans)
    return table


def encoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its code at the left end of 64 bits, and its length."""
    size = lengths.astype(np.int64)
    return np.where(size > 0, canonical(lengths) << (64 - np.maximum(size, 1)).astype(np.uint64), np.uint64(0)), size


def pack(ids: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of every STRIDE-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = sizes[ids]
    end = np.cumsum(size)
    start = end - size
    word = start >> 5
    bits = codes[ids] >> (start & 31).astype(np.uint64)
    first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    # The codes that begin in a 32-bit word fill it and part of the next, and share no bit.
    sums, at = np.add.reduceat(bits, first), word[first]
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    out[at] += sums >> np.uint64(32)
    out[at + 1] += sums & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: int(end[-1] + 7) >> 3], start[::STRIDE]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The n ids of a block: all stretches between checkpoints are decoded side by side, an id of each at a time."""
    if not n:
        return np.zeros(0, np.uint16)
    # The last stretch may be short and is decoded past its end.
    raw = np.frombuffer(payload + bytes(STRIDE * limit // 8 + 8), np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, mask = np.asarray(checkpoints, np.int64).copy(), np.uint32((1 << limit) - 1)
    out = np.zeros((STRIDE, len(at)), np.uint16)
    for k in range(STRIDE):
        found = table[words[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32) & mask]
        out[k] = found >> 8
        at += found & 255
    return out.T.reshape(-1)[:n]


def _counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: counted in every task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for ids in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, "<u2"), minlength=1 << 16) if len(ids) > 1 << 14 else 0
            small = b"".join(x for x in b.column(0).to_pylist() if len(x) <= 1 << 14)
            total += np.bincount(np.frombuffer(small, "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["symbol", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for symbol, n in tokens.select("ids").mapInArrow(run, "symbol int, n bigint").groupBy("symbol").agg(F.sum("n")).collect():
        counts[symbol] = n
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode docs and write their ids to path in ascending order of id.

    path/codes holds the code lengths, path/blocks the blocks, in folders by part (a range of
    ids): the ids and sizes of its documents, the number of token ids before it in all
    documents, the bits, and the bit offset of every STRIDE-th id. A block can be decoded
    without any other, and from any checkpoint on. Null texts are empty and hold the end id
    alone; null ids come first; repeated ids keep all their rows; other columns are not
    written; an empty table gives files without blocks. A tokenizer has at most 65,536 ids.
    """
    spark = docs.sparkSession
    tokens = encoded(docs, tokenizer, end, id_col, text_col, parts=parts)
    lengths = code_lengths(_counts(tokens))
    used = [int(s) for s in np.flatnonzero(lengths)]
    spark.createDataFrame([(s, int(lengths[s])) for s in used], "symbol int, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(encoding_table(lengths))  # at most 65,536 entries
    rows, _ = placed(tokens)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["part", "ids", "sizes", "start", "n_ids", "checkpoints", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes_of = shared.value

        def block(part: int, start: int, held: list) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[2] for h in held), "<u2")
            payload, marks = pack(ids, codes, sizes_of)
            lists = [pa.array([[h[0] for h in held]], pa.list_(id_type)), pa.array([[h[1] for h in held]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists, pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=names)

        part, start, follows, held, size, id_type = None, 0, 0, [], 0, None
        for b in batches:
            id_type = b.column("id").type
            for p, i, n, ids, place in zip(*(b.column(c).to_pylist() for c in ("part", "id", "n_tokens", "ids", "place"))):
                if held and (p != part or place != follows or size + n > BLOCK):
                    yield block(part, start, held)
                    held, size = [], 0
                if not held:
                    part, start = p, place
                held.append((i, n, ids))
                size += n
                follows = place + n
        if held:
            yield block(part, start, held)

    schema = f"part int, ids array<{kind}>, sizes array<bigint>, start bigint, n_ids bigint, checkpoints array<bigint>, payload binary"
    rows.select("part", "id", "n_tokens", "ids", "place").mapInArrow(run, schema).write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint", ids: bool = True) -> DataFrame:
    """Decode the files of write_tokens(): id, start, n_tokens, ids_crc32 and, if ids is true, the ids themselves."""
    lengths = np.zeros(1 << 16, np.uint8)
    for symbol, length in spark.read.schema("symbol int, length int").parquet(f"{path}/codes").collect():
        lengths[symbol] = length
    shared = spark.sparkContext.broadcast(lengths)
    schema = f"ids array<{id_type}>, sizes array<bigint>, start bigint, n_ids bigint, checkpoints array<bigint>, payload binary, part int"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks").drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(shared.value)
        for b in batches:
            for k in range(b.num_rows):
                names, sizes = b.column("ids")[k].values, b.column("sizes")[k].values.to_numpy()
                marks = b.column("checkpoints")[k].values.to_numpy()
                decoded = unpack(b.column("payload")[k].as_py(), marks, b.column("n_ids")[k].as_py(), table).astype("<u4")
                ends = np.cumsum(sizes)
                pieces = [decoded[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = {"id": names, "start": pa.array(b.column("start")[k].as_py() + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in pieces], pa.int64())}
                if ids:
                    columns["token_ids"] = pa.array([x.tolist() for x in pieces], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return blocks.mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * ids)
