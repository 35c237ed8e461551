import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeatlas.llm import huffman, packing, tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, rows, monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = tokens.Encoder(tokens.local_path(name))
    monkeypatch.setattr(tokens, "CACHE", 60)
    odd = ["a  b", " a", "a ", "a \n b", "x\n\n y", "it's 12 'quoted' 　z", "é ́x", "a\tb c", "İx ΣΑΣ Σ b", "<|endoftext|> x", "a\x1c b", " ", "\n"]
    odd += ["word, word. end.\nNext one,\nand Éa éa. x² ²,", "first,\nsecond. \0zero \0", "\0", "don't, can't. x.y,z a,b", "end. ", "ŉ ŀ ǆ, Ǆ. ſ ẞ", "a\nb c\n\nd"]
    odd += ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>\nB  <|startoftext|><|endoftext|> c", "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext|>" * 3]
    odd += ["İ. İ, \u05e9\u05c1. \ufb2a. a½. ab… it's. A_ word*** $$$ it'*", "q.\nab.\ncd* x", "\nend", "Alone", "A,"]
    texts = odd + [r[1] or "" for r in rows]
    for k in (1, 7, len(texts)):
        got = [ids for i in range(0, len(texts), k) for ids in encoder.many(texts[i : i + k])]
        for text, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text[:50]


@given(st.lists(st.integers(0, 40), max_size=900), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip(ids, skew):
    ids = np.array([i**skew for i in ids], np.uint16) if ids else np.zeros(0, np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
    payload, marks = huffman.pack(ids, *huffman.encoding_table(lengths))
    table = huffman.decoding_table(lengths)
    assert huffman.unpack(payload, marks, len(ids), table).tolist() == ids.tolist()
    for k in range(0, len(marks), 3):
        assert huffman.unpack(payload, marks[k : k + 1], 1, table)[0] == ids[k * huffman.STRIDE]


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([0, *(2**k for k in range(24))])
    lengths = huffman.code_lengths(counts, 18)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= 18 and len(used) == 24 and abs((2.0**-used).sum() - 1) < 1e-9
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 300)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert int((huffman.code_lengths(counts, 18) * counts).sum()) == total


def expected_ids(rows, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [end] for r in rows}


def test_files_hold_every_id(spark, docs, rows, tmp_path):
    path = str(tmp_path / "files")
    huffman.write_tokens(docs, path, "byte_bpe_50k.json", end=2)
    got = huffman.read_tokens(spark, path).orderBy("start").collect()
    want = expected_ids(rows, "byte_bpe_50k.json", 2)
    assert [g.id for g in got] == sorted(r[0] for r in rows)
    at = 0
    for g in got:
        ids = want[g.id]
        assert (g.start, g.n_tokens, list(g.token_ids), g.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_many_parts_keep_their_order(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_SUMS", 0)
    path = str(tmp_path / "files")
    huffman.write_tokens(docs, path, "byte_bpe_50k.json", end=2)
    got = huffman.read_tokens(spark, path).collect()
    assert {(g.id, tuple(g.token_ids)) for g in got} == {(i, tuple(ids)) for i, ids in expected_ids(rows, "byte_bpe_50k.json", 2).items()}
    starts = sorted((g.start, g.id) for g in got)
    assert [i for _, i in starts] == sorted(r[0] for r in rows)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() == blocks.select("part").distinct().count()


def test_packing_places_every_id_once(docs, rows):
    got = packing.pack(docs, "word_bpe_49k.json", end=1, ids=True, length=256).collect()
    want = expected_ids(rows, "word_bpe_49k.json", 1)
    n_rows = defaultdict(int)
    for r in rows:
        n_rows[r[0]] += 1
    whole, slots = defaultdict(list), defaultdict(list)
    for g in got:
        assert g.length == len(g.token_ids) > 0 and g.doc_tokens == len(want[g.doc_id])
        assert list(g.token_ids) == want[g.doc_id][g.start : g.start + g.length]
        assert g.ids_crc32 == zlib.crc32(np.array(g.token_ids, "<u4").tobytes())
        whole[g.doc_id].append((g.start, g.length))
        slots[g.sequence_id].append((g.offset, g.length))
    for i, ids in want.items():
        assert sum(n for _, n in whole[i]) == n_rows[i] * len(ids)
    for s, pieces in slots.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 256 or s == max(slots) and at <= 256
    assert sorted(slots) == list(range(len(slots)))


def test_windows_follow_the_mix():
    totals = [50_000, 1_000, 7, 30_013]
    rounds = packing.Rounds(totals, 256)
    window = defaultdict(lambda: [0] * 4)
    for q, total in enumerate(totals):
        place = np.arange(0, total, 97)
        size = np.minimum(97, total - place)
        doc, start, n, w, offset = rounds.pieces(np.full(len(place), q), place, size)
        assert n.sum() == total and (n > 0).all()
        for k, m in zip(w.tolist(), n.tolist()):
            window[k][q] += m
    full = [window[k] for k in range(len(window) - 1)]
    assert all(sum(w) == 256 for w in full)
    for q, total in enumerate(totals):
        share = 256 * total / sum(totals)
        assert max(abs(w[q] - share) for w in full) <= 6


def test_large_totals_stay_exact():
    rounds = packing.Rounds([3 * 10**13, 10**12 + 7])
    doc, start, n, w, offset = rounds.pieces(np.array([0, 1]), np.array([10**13, 10**11]), np.array([5000, 400]))
    assert n.sum() == 5400 and (offset + n <= packing.LENGTH).all()


def test_empty(spark, empty, tmp_path):
    assert packing.pack(empty, "word_bpe_49k.json", end=1).count() == 0
    huffman.write_tokens(empty, str(tmp_path / "none"), "byte_bpe_50k.json", end=2)
    assert huffman.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_many_sources_keep_their_own_queues(spark):
    rows = [(i, f"text {i} of a source " * 3, f"s{i % 300}" if i % 300 else None) for i in range(1200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "word_bpe_49k.json", end=1, length=64).collect()
    queues = defaultdict(set)
    for g in got:
        queues[g.queue].add(rows[g.doc_id][2])
    assert sorted(queues) == list(range(300)) and all(len(s) == 1 for s in queues.values()) and queues[299] == {None}
    filled = defaultdict(int)
    for g in got:
        filled[g.sequence_id] += g.length
    assert all(n == 64 for s, n in filled.items() if s < max(filled)) and sorted(filled) == list(range(len(filled)))


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_bases_match_the_sum_over_all_queues(monkeypatch, cells):
    monkeypatch.setattr(packing, "CELLS", cells)
    rng = np.random.default_rng(3)
    for totals in (rng.integers(1, 5000, 400).tolist(), [3 * 10**13, 10**12 + 7]):
        rounds = packing.Rounds(totals)
        q, r = rng.integers(0, len(totals), 300), rng.integers(0, rounds.rounds, 300)
        want = [sum(int(rounds.first(o, r[i : i + 1] + (o < q[i]))[0]) for o in range(len(totals))) for i in range(60)]
        assert rounds.base(q, r)[:60].tolist() == want


@pytest.mark.parametrize("quantum", [1, 100])
def test_windows_follow_given_weights_and_share_again_when_a_queue_ends(quantum):
    totals, weights, length = [50_000, 20_000, 3_000, 0], [1.0, 2.0, 1.0, 0.0], 256
    rounds = packing.Rounds(totals, length, weights, quantum)
    window = defaultdict(lambda: [0] * 4)
    for q, total in enumerate(totals):
        place = np.arange(0, total, 97)
        size = np.minimum(97, total - place)
        doc, start, n, w, offset = rounds.pieces(np.full(len(place), q), place, size)
        assert n.sum() == total and (offset + n <= length).all()
        for k, m in zip(w.tolist(), n.tolist()):
            window[k][q] += m
    full = [window[k] for k in range(len(window) - 1)]
    assert all(sum(w) == length for w in full)
    left = np.array(totals, float)
    for w in full:  # brute force: shares by weight of what is left, window by window
        share, open_ = np.zeros(4), left > 0
        room = float(length)
        while room > 1e-6 and open_.any():
            part = np.where(open_, np.array(weights), 0)
            step = min(room / part.sum(), ((left - share)[open_] / part[open_]).min())
            share += step * part
            room -= step * part.sum()
            open_ &= left - share > 1e-6
        left -= share
        assert np.abs(np.array(w) - share).max() <= 3 * quantum + 3


def test_weights_by_source(spark):
    rows = [(i, "some words of text " * 20, "a" if i % 4 else "b") for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "word_bpe_49k.json", end=1, length=128, weights={"a": 1, "b": 3}).collect()
    share = defaultdict(lambda: [0, 0])
    for g in got:
        share[g.sequence_id][g.queue] += g.length
    assert all(abs(share[s][1] - 96) <= 3 for s in range(20)) and share[max(share) - 1][1] == 0


def test_pieces_do_not_grow_with_the_sources():
    """Documents of 400 ids in up to 2,000 sources, with the default quantum."""
    for n in (1, 20, 200, 2000):
        each = max(1, 4000 // n)
        rounds = packing.Rounds([each * 400] * n, quantum=max(1, min(packing.LENGTH, 2 * n)))
        q, place = np.repeat(np.arange(n), each), np.tile(np.arange(each) * 400, n)
        doc, start, size, window, offset = rounds.pieces(q, place, np.full(n * each, 400))
        assert size.sum() == n * each * 400 and len(size) <= 10 * n * each
        ends = np.sort(window * packing.LENGTH + offset)
        order = np.argsort(window * packing.LENGTH + offset)
        assert (np.append(0, np.cumsum(size[order]))[:-1] == ends).all()  # gapless
