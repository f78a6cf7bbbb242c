"""Packing, token files and token counts against the tokenizers library."""

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing, token_counts, token_files
from quillon.llm.common import PieceEncoder, shared_folder

from .helpers import BPE, ODD, no_docs, odd_docs, ordered, texts, tokenizer


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(rows, end):
    t = tokenizer()
    return [(k, t.encode(x or "", add_special_tokens=False).ids + [end]) for k, x in rows]


def check_packing(rows, packed, size=2048):
    want = Counter()
    for k, ids in ids_of(rows, 1):
        for a in range(0, len(ids), size):
            want[(k, a, len(ids[a : a + size]), crc(ids[a : a + size]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return sum(r.length for r in packed) / (size * len(by)) if by else 1.0


def test_packing_is_whole_and_dense(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert check_packing(texts(spark, small), packing.pack_documents(docs, BPE).collect()) > 0.95


def test_packing_of_odd_documents(spark):
    rows = packing.pack_documents(odd_docs(spark), BPE).collect()
    check_packing([(r[0], r[1]) for r in ODD], rows)
    assert packing.pack_documents(no_docs(spark), BPE).count() == 0


def test_sequences_hold_the_ids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).cache()
    packed = packing.pack_documents(docs, BPE)
    rows = packed.collect()
    sequences = {r.sequence_id: r.ids for r in packing.sequence_ids(docs, packed, BPE).collect()}
    want = dict(ids_of([(r.doc_id, r.text) for r in docs.collect()], 1))
    assert {len(s) for s in sequences.values()} == {2048}
    for r in rows:
        assert sequences[r.sequence_id][r.offset : r.offset + r.length] == want[r.doc_id][r.start : r.start + r.length]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_patterns_place_every_length_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for count, items in patterns:
        assert sum(length * copies for length, copies in items) <= 64
        for length, copies in items:
            placed[length] += count * copies
    assert placed == Counter(histogram)
    slots = packing.pattern_slots(patterns)
    for length, n in histogram.items():
        edges = sorted((a, b) for k, a, b, *_ in slots if k == length)
        assert edges[0][0] == 0 and edges[-1][1] == n and all(x[1] == y[0] for x, y in zip(edges, edges[1:], strict=False))


@given(st.lists(st.lists(st.integers(0, 6), max_size=120), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_grammar_round_trip_and_random_access(docs):
    keys = [None, *range(len(docs) - 1)]
    ends = np.cumsum([len(d) for d in docs])
    flat = np.array([x for d in docs for x in d], np.uint32)
    payload = token_files.write_block(keys, flat, ends, 7)
    block = token_files.Block.read(payload)
    assert block.keys == keys and block.expand(block.symbols).tolist() == flat.tolist()
    for k, d in enumerate(docs):
        assert block.ids(k).tolist() == d
        assert block.ids(k, len(d) // 3, len(d) // 3 + 5).tolist() == d[len(d) // 3 : len(d) // 3 + 5]


def test_grammar_finds_repeats():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    symbols, _, rules, lengths = token_files.compress(ids, np.array([len(ids)]), 1000)
    assert len(rules) < 120 and len(symbols) < 20 and lengths.max() >= 3000


@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_grammar_leaves_no_frequent_pair_and_no_rule_unused(docs):
    ends = np.cumsum([len(d) for d in docs])
    symbols, sizes, rules, _ = token_files.compress(np.array([x for d in docs for x in d], np.uint32), ends, 7)
    seen, start = Counter(), 0
    for n in sizes.tolist():
        part, start, last = symbols[start : start + n].tolist(), start + n, None
        for k, pair in enumerate(zip(part, part[1:])):
            if last != (k - 1, pair):  # a run of one symbol has every other place
                seen[pair] += 1
                last = (k, pair)
            else:
                last = None
    assert max(seen.values(), default=0) < 4
    assert {*range(7, 7 + len(rules))} <= {*symbols.tolist(), *rules.ravel().tolist()}


def files_of(rows):
    out, at = [], 0
    for k, ids in sorted(ids_of(rows, 0), key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files(spark, small):
    got = token_files.token_files(spark.read.parquet(f"{small}/documents.parquet"), BPE)
    assert ordered(got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == ordered(files_of(texts(spark, small)))


def test_token_files_of_odd_documents(spark):
    folder = shared_folder(spark)
    token_files.write_token_files(odd_docs(spark), folder, BPE, block_tokens=64)
    got = [tuple(r) for r in token_files.read_token_files(spark, folder).collect()]
    want = files_of([(r[0], r[1]) for r in ODD])
    assert Counter((k, n, c) for k, _, n, c in got) == Counter((k, n, c) for k, _, n, c in want)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [r[0] for r in want]
    assert token_files.token_files(no_docs(spark), BPE).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, small, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda x: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    rows = [(r[0], r[1]) for r in ODD if r[0] != 6 or name != "word_bpe_49k.json"] + (texts(spark, small) if name.startswith("byte") else texts(spark, small)[:20])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_counts.token_counts(docs, path).collect()
    want = [(k, len((x or "").encode()), count(x or "")) for k, x in rows]
    assert ordered((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == ordered(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_counts_of_nothing_and_of_clashing_columns(spark):
    assert token_counts.token_counts(no_docs(spark), BPE).count() == 0
    assert token_counts.token_counts(odd_docs(spark), BPE).count() == len(ODD)


@given(st.lists(st.text(alphabet=" \t\n\xa0　abé'<|>endoftext0123😀", max_size=40), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_tokens_of_whole_texts(rows):
    import pyarrow as pa

    encoder, counter, t = coders()
    want = [t.encode(x, add_special_tokens=False).ids for x in rows]
    ids, ends = encoder.ids(pa.array(rows, pa.string()))
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == want
    assert counter.counts(pa.array(rows, pa.string())).tolist() == [len(w) for w in want]


@cache
def coders():
    return PieceEncoder(BPE, most=20), token_counts.TokenCounter(BPE, most=50), tokenizer()
