"""How the sources of a language differ in words: a vocabulary by document frequency, recounted by automata, compared through sparse postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sliced, stored, utf8

#: Documents of a language that a kept term is in, and the best ranks that are returned of terms.
LEAST, RANKS = 3, 200
#: Bytes of terms from which on a chunk ends, and pairs of postings that are worked out at once.
CHUNK = 16_000_000
PAIRS = 1 << 19
#: Bytes that an automaton scans at once.
PIECE = 1 << 20
#: ASCII letters in lower case and all bytes from 128 on belong to terms; a blank stands for each other byte.
_TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _chunks(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, parts: int | None) -> DataFrame:
    """Chunks of documents of one lang and source: their terms set apart by blanks, and each distinct one with the number of documents that hold it. Both are packed, as they are moved again.

    Rows are dealt by ranges of lang, source and a hash of the row, so a source of any size is spread, and few chunks are small.
    """
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))), docs[id_col].alias("id"))
    order = ["lang", "source", F.xxhash64("text", "id")]
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions("lang", "source").select("lang", "source", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size, found, own, n = [], 0, Counter(), None, 0

        def chunk() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=1).compress
            columns = ([own[2] << 32 | n], [own[0]], [own[1]], [packed(b" ".join(texts))], [packed(b" ".join(found))], [list(found.values())])
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "lang", "source", "text", "terms", "documents"])

        for b in sliced(batches):
            for lang, source, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), utf8(b.column(2))):
                if own is not None and (own != (lang, source, part) or size >= CHUNK):
                    yield chunk()
                    texts, size, found, n = [], 0, Counter(), n + 1
                own = lang, source, part
                words = text.translate(_TERMS).split()
                found.update(set(words))
                texts.append(b" ".join(words))
                size += len(texts[-1]) + 1
        if own is not None:
            yield chunk()
        pa.default_memory_pool().release_unused()

    return stored(dealt.mapInArrow(run, "chunk bigint, lang string, source string, text binary, terms binary, documents array<int>"), "chunks")


def _terms(chunks: DataFrame) -> DataFrame:
    """chunk, lang, term and the documents of the chunk that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            terms = pa.array(unpacked(b.column(2)[0]).split(), pa.binary()).cast(pa.string())
            repeat = pa.array(np.zeros(len(terms), np.int64))
            columns = [b.column(0).take(repeat), b.column(1).take(repeat), terms, b.column(3).flatten()]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "term", "documents"])

    return chunks.select("chunk", "lang", "terms", "documents").mapInArrow(run, "chunk bigint, lang string, term string, documents int")


def unpacked(value: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_py())


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds the terms between blanks; the value of a match is the term's place. Bytes are read as characters, so none is ambiguous."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        found.add_word(f" {t.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def recount(text: bytes, terms: list[bytes]) -> np.ndarray:
    """How often each term occurs in a text of terms set apart by blanks. The text is scanned in pieces that end at blanks."""
    counts = np.zeros(len(terms), np.int64)
    if not terms or not text:
        return counts
    found = automaton(terms).iter
    a = 0
    while a < len(text):
        b = text.find(b" ", a + PIECE)
        b = len(text) if b < 0 else b
        places = map(itemgetter(1), found(f" {text[a:b].decode('latin-1')} "))
        counts += np.bincount(np.fromiter(places, np.int32), minlength=len(terms))
        a = b + 1
    return counts


def _occurrences(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term and its count in a chunk, for the kept terms: each chunk meets an automaton of its own, of the kept terms it holds."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        terms = utf8(found.column("term"))
        counts = recount(unpacked(chunk.column("text")[0]), terms) if chunk.num_rows else np.zeros(len(terms), np.int64)
        repeat = pa.array(np.zeros(len(terms), np.int64))
        return pa.table({"lang": chunk.column("lang").take(repeat), "source": chunk.column("source").take(repeat), "term": found.column("term"), "count": pa.array(counts, pa.int64())})

    found = _terms(chunks).select("chunk", "lang", "term").join(kept, ["lang", "term"], "left_semi").select("chunk", "term")
    return chunks.select("chunk", "lang", "source", "text").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, "lang string, source string, term string, count bigint")


def _common(postings: DataFrame) -> DataFrame:
    """lang, source, item and value: what the terms that two sources share add to the pair, beyond what each source's terms add alone (see divergences).

    postings: lang, source, term, p and p0. Rows of a term stand together; pairs are made in blocks of arrays and summed before they leave the task.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = {}
        rest = None

        def out() -> pa.RecordBatch:
            groups = list(names)
            rows = [(*groups[k >> 32], groups[k & 0xFFFFFFFF][1], v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

        def add(t: pa.Table) -> None:
            n = t.num_rows
            heads = np.append(0, np.flatnonzero(_changes(t)) + 1)
            length = np.diff(np.append(heads, n))
            first, size = np.repeat(heads, length), np.repeat(length, length)
            langs, sources = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            codes, which = np.unique(langs.indices.to_numpy().astype(np.int64) << 32 | sources.indices.to_numpy(), return_inverse=True)
            here = [(langs.dictionary[x >> 32].as_py(), sources.dictionary[x & 0xFFFFFFFF].as_py()) for x in codes.tolist()]
            group = np.array([names.setdefault(x, len(names)) for x in here], np.int64)[which]
            p, p0 = (t.column(c).to_numpy() for c in ("p", "p0"))
            total = np.append(0, np.cumsum(size))
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
                i = np.repeat(np.arange(a, b), size[a:b])
                k = first[i] + np.arange(len(i)) - (total[i] - total[a])
                i, k = i[i != k], k[i != k]
                key = group[i] << 32 | group[k]
                value = f(p[i], p[k]) - f(p[i], p0[k]) - f(p0[i], p[k]) + f(p0[i], p0[k])
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                for x, v in zip(key[starts].tolist(), (np.add.reduceat(value, starts) if len(key) else value).tolist()):
                    sums[x] = sums.get(x, 0) + v
                a = b

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            ends = np.flatnonzero(_changes(t))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last term may go on
            if cut:
                add(t.slice(0, cut))
            rest = t.slice(cut)
            if len(sums) > PAIRS:
                yield out()
        if rest is not None and rest.num_rows:
            add(rest)
        if sums:
            yield out()

    sorted_rows = postings.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return sorted_rows.mapInArrow(run, "lang string, source string, item string, value bigint")


def _changes(t: pa.Table) -> np.ndarray:
    """Whether the row after each row has another lang or term."""
    n = t.num_rows
    differ = (pc.not_equal(t.column(c).slice(1), t.column(c).slice(0, max(0, n - 1))) for c in ("lang", "term"))
    return pc.or_(*differ).to_numpy()


def divergences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, ranks: int = RANKS, parts: int | None = None) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a lang is from the others (part pair), and the terms it has most above its lang (part term).

    Terms are runs of ASCII letters, lower-cased, and characters beyond ASCII; a lang keeps the terms of at least `least` of its rows.
    A group (a source in a lang) gives each kept term p = 1 + floor(10**9 * (count + 1) / (N + V)); so does the lang. A term's
    value is floor((p - q)**2 / q). A pair's is the sum over all kept terms, q being the other source's. Most counts are zero: with p0 for
    a count of zero, a pair's sum is that of f(p, q0) over the one's terms, of f(p0, q) over the other's, f(p0, q0) for each further
    term, and a correction for each term of both, so only terms that groups hold are looked at.

    Numbers are whole: p needs 10**9 times a count, which is worked out in decimals. Null text, lang and source
    count as empty; repeated rows count each; other columns are not read; a group without terms is at p0
    everywhere; a lang without kept terms has pairs of value 0; an empty table gives no rows. The table of groups is broadcast
    if Spark finds it small; the result holds a row for each pair of them.
    """
    chunks = _chunks(docs, id_col, text_col, lang_col, source_col, parts)
    kept = stored(_terms(chunks).groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least).select("lang", "term"), "vocabulary")
    counted = _occurrences(chunks, kept).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
    postings = stored(counted, "postings")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    held = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms"))
    groups = chunks.select("lang", "source").distinct().join(size, "lang", "left").join(held, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "n", "terms")))
    groups = groups.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang")))

    def price(count: str, n: str) -> F.Column:
        return F.expr(f"1 + (1000000000BD * (cast({count} as decimal(20)) + 1)) div nullif(cast({n} + v as decimal(20)), 0)")

    def f(p: str, q: str) -> F.Column:
        return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")

    groups = stored(groups.withColumn("p0", price("0", "n")), "groups")
    discard(chunks, kept)
    priced = postings.join(groups, ["lang", "source"]).withColumn("p", price("count", "n"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("other_terms"))
    alone = groups.join(other, "lang").filter("source != item").select("lang", "source", "item", F.coalesce((F.col("v") - F.col("terms") - F.col("other_terms")) * f("p0", "q0"), F.lit(0)).alias("value"))
    same = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"), F.first("p0").alias("p0"))
    sides = F.array(F.struct("source", "item", (F.col("times") * f("p", "q0")).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * f("q0", "p")).alias("value")))
    one_side = same.join(other, "lang").filter("source != item").select("lang", F.inline(sides))
    value = alone.unionByName(one_side).unionByName(_common(priced)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    in_lang = Window.partitionBy("lang", "term")
    above = priced.withColumn("all", F.sum("count").over(in_lang)).withColumn("q", price("`all`", "lang_n")).filter("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f("p", "q").alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
