"""Token-id files compressed by Re-Pair grammars.

Documents are encoded in ascending order of their key and written in blocks. In each block, pairs of neighbouring ids
are replaced by new symbols, the most frequent first, until no pair stands at four places: below that a rule (12 bytes as
stored, before the writer compresses it) takes more room than it saves. A block stores its rules with the lengths they expand to, so any span of any
document can be decoded alone. Blocks are rows of a Parquet folder: Spark's writers commit them
as a whole wherever the cluster keeps its files.

Block payload, little endian: magic b"RPR1"; uint32 base (first new symbol), rules, documents, symbols, tokens and
symbol width (2 or 4 bytes); then rules as (left, right) uint32 pairs, uint32 expansion length per rule, int64 key and
uint8 key-is-present per document, uint32 symbols per document, uint32 tokens per document, and the symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, piece_encoder, shared_folder, slices

BLOCK_SCHEMA = "shard int, block int, first_doc long, last_doc long, n_docs long, n_tokens long, payload binary"
DOC_SCHEMA = "shard int, block int, doc_id long, block_start long, n_tokens long, ids_crc32 long"
_HEAD = struct.Struct("<4s6I")


def _likely(symbols: np.ndarray, at: np.ndarray, bar: int | None) -> tuple[np.ndarray, int]:
    """The places whose pair may stand at `bar` places (None: a sixteenth as many as the most frequent one), and the bar.
    Pairs share counters by hash, so a count is never too low."""
    mixed = symbols[:-1] * np.uint32(0x9E3779B1) + symbols[1:] * np.uint32(0x85EBCA6B)
    slot = (mixed[at] >> np.uint32(14)).astype(np.int64)
    count = np.bincount(slot, minlength=1 << 18)
    if bar is None:
        bar = int(count.max()) // 16
    return at[count[slot] >= bar], bar


def _by_pair(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` in order of the pair that stands there, and where each pair's places start among them."""
    place, symbol = max(1, len(symbols)).bit_length(), int(symbols.max()).bit_length()
    left, right = symbols[at].astype(np.uint64), symbols[at + 1].astype(np.uint64)
    if place + 2 * symbol <= 64:  # pair and place as one number
        packed = (left << np.uint64(symbol) | right) << np.uint64(place) | at.astype(np.uint64)
        packed.sort()
        at, pair = (packed & np.uint64((1 << place) - 1)).astype(np.int64), packed >> np.uint64(place)
    else:
        order = np.lexsort((right, left))
        at, pair = at[order], left[order] << np.uint64(32) | right[order]
    return at, np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one block: (symbols, symbols per document, rules, ids that each rule expands to). ends: where each
    document's ids end.

    A step replaces every pair inside documents that is at least as frequent as a bar. The bar starts at a sixteenth of
    the most frequent pair and falls to a sixteenth with each step, down to `least`, where it stays until no pair stands at
    so many places apart from each other. Where two pairs overlap the more frequent one is replaced, ties by the smaller
    pair: so the most frequent one is replaced wherever it stands. A pair that loses so many places that fewer than
    `least` are left gets no rule in this step. Pairs only become rarer, but for those with a new symbol: a place whose
    pair was seen too rarely is looked at again only when a neighbour changes."""
    symbols, joined = ids.astype(np.uint32), np.ones(len(ids), np.int8)  # joined: whether a symbol may pair with the next
    joined[ends[ends > 0] - 1] = 0
    open_ = joined.copy()  # places whose pair can still be frequent
    rules, lengths, made, bar = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64), 0, None
    while len(at := np.flatnonzero(open_)):
        likely, bar = _likely(symbols, at, None if bar is None else bar // 16) if bar is None or bar > least else (at, bar)
        bar = max(bar, least)
        if bar == least:  # the others are too rare for good
            open_[:] = 0
            open_[likely] = 1
        if not len(likely):
            continue
        at, first = _by_pair(symbols, likely)
        count = np.diff(np.append(first, len(at)))
        spare = np.zeros(len(at), bool)  # in a run of one symbol every other place overlaps the one before
        twin = symbols[at[first]] == symbols[at[first] + 1]
        if twin.any():
            k = np.flatnonzero(np.repeat(twin, count))
            starts = np.zeros(len(at), bool)
            starts[first] = True
            run = np.flatnonzero((np.diff(at[k], prepend=-2) != 1) | starts[k])
            spare[k] = (np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))) % 2 == 1
            count = count - np.add.reduceat(spare.astype(np.int64), first)
        size = np.diff(np.append(first, len(at)))
        chosen = np.flatnonzero(count >= bar)
        if bar == least:
            open_[at[np.repeat(count < least, size) & ~spare]] = 0
            if not len(chosen):
                break
        rank = np.full(len(count), -1, np.int32)
        rank[chosen[np.argsort(-count[chosen], kind="stable")]] = np.arange(len(chosen))
        of = np.repeat(rank, size)
        hit = (of >= 0) & ~spare
        ranks = np.full(len(symbols) + 2, len(chosen), np.int32)  # of the pair at each place, one place on
        ranks[at[hit] + 1] = of[hit]
        take = np.sort(at[hit])
        mine = ranks[take + 1]
        won = (mine < ranks[take]) & (mine < ranks[take + 2])
        take, mine = take[won], mine[won]
        enough = np.bincount(mine, minlength=len(chosen)) >= least
        won = enough[mine]
        take, mine = take[won], (np.cumsum(enough) - 1)[mine[won]]
        pair = np.zeros((int(enough.sum()), 2), np.uint32)
        pair[mine, 0], pair[mine, 1] = symbols[take], symbols[take + 1]
        opened = np.append(lengths, 1)  # an id stands for itself
        lengths = np.append(lengths, opened[np.where(pair >= base, pair.astype(np.int64) - base, -1)].sum(axis=1))
        rules.append(pair)
        symbols[take] = base + made + mine
        made += len(pair)
        joined[take] = joined[take + 1]
        open_[take] = joined[take]
        before = take[take > 0] - 1
        open_[before] = joined[before]
        keep = np.ones(len(symbols), bool)
        keep[take + 1] = False
        keep = np.flatnonzero(keep)
        symbols, joined, open_ = symbols.take(keep), joined.take(keep), open_.take(keep)
    stops = np.flatnonzero(joined == 0) + 1
    sizes = np.zeros(len(ends), np.int64)
    sizes[np.diff(ends, prepend=0) > 0] = np.diff(stops, prepend=0)
    return symbols, sizes, np.concatenate(rules), lengths


def write_block(keys: list[int | None], ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    symbols, sizes, rules, lengths = compress(ids, ends, base)
    width = 2 if base + len(rules) <= 65536 else 4
    head = _HEAD.pack(b"RPR1", base, len(rules), len(keys), len(symbols), len(ids), width)
    there = np.array([k is not None for k in keys], np.uint8)
    return b"".join((
        head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), there.tobytes(),
        sizes.astype("<u4").tobytes(), np.diff(ends, prepend=0).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ))


@dataclass
class Block:
    base: int
    rules: np.ndarray
    lengths: np.ndarray
    keys: list[int | None]
    sizes: np.ndarray
    tokens: np.ndarray
    symbols: np.ndarray

    @classmethod
    def read(cls, payload: bytes) -> Block:
        magic, base, rules, docs, symbols, _, width = _HEAD.unpack_from(payload)
        if magic != b"RPR1":
            raise ValueError("not a Re-Pair block")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        pairs, lengths, keys, there = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules), take("<i8", docs), take("u1", docs)
        sizes, tokens = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        return cls(base, pairs, lengths.astype(np.int64), [int(k) if t else None for k, t in zip(keys, there, strict=True)], sizes, tokens, take(f"<u{width}", symbols).astype(np.uint32))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols. For many of them the rules are opened once each and laid out in the symbols' order."""
        if len(symbols) <= len(self.rules) or not len(self.rules):
            return self._open(symbols)
        ids = np.concatenate([np.arange(self.base, dtype=np.uint32), self._open(np.arange(self.base, self.base + len(self.rules)))])
        ends = np.concatenate([np.arange(self.base + 1), self.base + np.cumsum(self.lengths)]) * 4
        each = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        return np.frombuffer(each.take(pa.array(symbols)).buffers()[2], np.uint32)

    def _open(self, symbols: np.ndarray) -> np.ndarray:
        """Each symbol has its place in the result, and rules are opened level by level."""
        size = np.ones(len(symbols), np.int64)
        new = symbols >= self.base
        size[new] = self.lengths[symbols[new] - self.base]
        ends = np.cumsum(size)
        out, at = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32), ends - size
        while len(symbols):
            new = symbols >= self.base
            out[at[~new]] = symbols[~new]
            pair, at = self.rules[symbols[new] - self.base], at[new]
            left = pair[:, 0]
            step, new = np.ones(len(left), np.int64), left >= self.base
            step[new] = self.lengths[left[new] - self.base]
            symbols, at = np.concatenate([left, pair[:, 1]]), np.concatenate([at, at + step])
        return out

    def ids(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids [start, stop) of one document: only the symbols that cover them are opened."""
        first = int(self.sizes[:document].sum())
        symbols = self.symbols[first : first + int(self.sizes[document])]
        stop = int(self.tokens[document]) if stop is None else min(stop, int(self.tokens[document]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        size = np.ones(len(symbols), np.int64)
        new = symbols >= self.base
        size[new] = self.lengths[symbols[new] - self.base]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop)
        skip = start - int(ends[a] - size[a])
        return self.expand(symbols[a : b + 1])[skip : skip + stop - start]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, block_tokens: int = 1 << 17, key: str = "doc_id", text: str = "text") -> None:
    """Write the whole texts' ids, each document's closed by end_id, in ascending key order to a new Parquet folder.

    Nulls: a null text is empty, a null key comes first. Rows with equal keys are ordered by their text's hash. A
    document is never cut, so a block holds block_tokens ids or a single longer document. No documents, a folder without
    blocks."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = piece_encoder(tokenizer), TaskContext.get().partitionId(), 0
        base = int(encoder.tokenizer.get_vocab_size(with_added_tokens=True))
        base = max(base, end_id + 1)
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, n, number
            ends = np.cumsum([len(p) for p in parts])
            payload = write_block(keys, np.concatenate(parts), ends, base)
            row = [[shard], [number], [keys[0]], [keys[-1]], [len(keys)], [n], [payload]]
            keys, parts, n, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], ["shard", "block", "first_doc", "last_doc", "n_docs", "n_tokens", "payload"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids, ends = encoder.ids(batch.column(1))
            before = 0
            for k, at in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                keys.append(k)
                parts.append(np.concatenate([ids[before:at], end]))
                n += at - before + 1
                before = at
                if n >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    ordered.select("key", "text").mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decode a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Documents of null and repeated
    keys are rows of their own, as they were written; a folder without blocks has no rows."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {name: batch.column(k)[0].as_py() for k, name in enumerate(("shard", "block", "payload"))}
            block = Block.read(row["payload"])
            raw, ends = block.expand(block.symbols).astype("<u4").tobytes(), np.cumsum(block.tokens)
            starts = ends - block.tokens
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(block.keys, pa.int64()), pa.array(starts), pa.array(block.tokens), pa.array(sums, pa.int64())],
                ["shard", "block", "doc_id", "block_start", "n_tokens", "ids_crc32"],
            )

    bounded_batches(spark)
    files = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    # tokens before a block: of the shards before it (as many as the write had tasks), and of the blocks before it there
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("shard_start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    blocks = files.select("shard", "block", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = blocks.join(shards, "shard")
    docs = files.select("shard", "block", "payload").mapInArrow(decode, DOC_SCHEMA)
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("before") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write to a new shared folder and read back: nulls, repeated keys and very long texts as in write_token_files, no documents
    no rows."""
    folder = shared_folder(docs.sparkSession)
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)
