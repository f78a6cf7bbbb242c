"""Token counts by rank-synchronous array merging.

The bytes of a batch's new pre-tokens lie side by side in one array. In every step each pre-token's pair of lowest
merge rank is applied at all its places, for all pre-tokens at once, until none has a pair left; what survives is
counted. Counts of pre-tokens seen lately are kept, so a common word is merged once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import INNER_SPACE, PIECES, TwoGenerations, bounded_batches, cuts_before_space, slices


class MergeTable:
    """Ranks and results of a byte-level tokenizer's merges, found by pair through one open-addressed table."""

    def __init__(self, model: dict):
        vocabulary = model["vocab"]
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.uint32)
        #: Whether no two merges have one result: else a pair could come up again while it is applied.
        self.distinct = len(np.unique(self.result)) == len(pairs)
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        keys = left << np.uint64(32) | right
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.zeros(1 << self.bits, np.int64)
        waiting, at = np.arange(len(keys)), self._slot(keys)
        while len(waiting):  # all keys go to their slot at once; those that find it taken go on to the next
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            first = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[waiting[put]], waiting[put]
            rest = np.ones(len(waiting), bool)
            rest[put] = False
            waiting, at = waiting[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.none = len(pairs)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair its merge rank; `none` where there is no merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right
        at = self._slot(keys)
        out = np.full(len(keys), self.none, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def merge_counts(symbols: np.ndarray, sizes: np.ndarray, table: MergeTable) -> np.ndarray:
    """How many symbols each sequence has once all its merges are applied. sizes: at least 1 each. A step applies a
    sequence's lowest-ranked pair at all its places at once, which is what merging it place by place gives, as no two
    merges of the table have one result."""
    counts = sizes.copy()
    who = np.arange(len(sizes))
    ranks = np.full(len(symbols), table.none, np.int64)  # of the pair of each symbol and the next
    ends = np.cumsum(sizes)
    inner = np.ones(len(symbols), bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    ranks[at] = table.rank(symbols[at], symbols[at + 1])
    while len(sizes):
        lowest = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
        live = lowest < table.none
        if not live.all():  # finished sequences leave
            counts[who[~live]] = sizes[~live]
            keep = np.repeat(live, sizes)
            symbols, ranks, sizes, who, lowest = symbols[keep], ranks[keep], sizes[live], who[live], lowest[live]
            if not len(sizes):
                break
        at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
        run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]  # of a run of equal pairs every other one
        ends = np.cumsum(sizes)
        seq = np.searchsorted(ends, at, "right")
        symbols[at] = table.result[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        last = np.zeros(len(symbols), bool)
        last[ends - 1] = True
        last[at] |= last[at + 1]
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        symbols, last, touched = symbols[keep], last[keep], touched[keep]
        ranks = ranks[keep]
        sizes = sizes - np.bincount(seq, minlength=len(sizes))
        touched[:-1] |= touched[1:]  # the pair before a new symbol changes too
        ranks[last] = table.none
        at = np.flatnonzero(touched & ~last)
        ranks[at] = table.rank(symbols[at], symbols[at + 1])
    return counts


class TokenCounter:
    """Counts tokens as the library of a vocabulary file does: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known = TwoGenerations(most)
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.by_piece = cuts_before_space(self.tokenizer) and model.get("type") == "BPE" and plain
        if self.by_piece:
            self.table, self.vocabulary = MergeTable(model), model["vocab"]
            self.by_piece = self.table.distinct
        if self.by_piece:
            special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
            self.special = re.compile("|".join(map(re.escape, special))) if special else None
            self.first = np.zeros(0x200, np.uint32)
            for token, i in self.vocabulary.items():
                if len(token) == 1:
                    self.first[ord(token)] = i

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; null is the empty text."""
        column = pc.fill_null(column, "")
        if self.pieces is not None:
            return np.array([len(x) for x in self.pieces.encode(column.to_pylist(), num_threads=1)], np.int64)
        if not self.by_piece:
            return np.array([len(e.ids) for e in self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)], np.int64)
        if len(column) == 0:
            return np.zeros(0, np.int64)
        odd = pc.match_substring_regex(column, INNER_SPACE).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.if_else(pa.array(odd), "", column), " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        firsts = offsets[:-1] - offsets[0]
        coded = words.flatten().dictionary_encode()
        unique, index = [" " + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)
        heads = coded.dictionary.take(pa.array(index[firsts])).to_pylist()
        whole = {int(k): PIECES.findall(column[int(k)].as_py()) for k in np.flatnonzero(odd)}
        self._know({*unique, *heads, *(p for ps in whole.values() for p in ps)})
        get = self.known.__getitem__
        each = np.fromiter(map(get, unique), np.int64, len(unique))[index]
        each[firsts] = [sum(map(get, whole[k])) if k in whole else get(w) for k, w in enumerate(heads)]
        return np.add.reduceat(each, firsts)

    def _know(self, pieces: set[str]) -> None:
        new = self.known.missing(pieces)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # pieces stay apart when they are joined: nearly all pre-tokens come from one call each few thousand pieces
        plain = [p for p in new if p[0:1] == " " and not p[-1:].isspace() and not (self.special and "<" in p and self.special.search(p))]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            tokens = [t for t, _ in split("".join(part))]
            ends = np.cumsum([len(p.encode()) for p in part])
            sizes = np.array([len(t) for t in tokens], np.int64)
            owner = np.searchsorted(ends, np.cumsum(sizes) - 1, "right")
            for p, n in zip(part, np.bincount(owner, self._merged(tokens, sizes), len(part)).astype(np.int64).tolist(), strict=True):
                self.known[p] = n
        rest = [p for p in new if p not in self.known]
        owner, tokens, extra = [], [], np.zeros(len(rest), np.int64)
        for k, p in enumerate(rest):
            parts = self.special.split(p) if self.special else [p]
            extra[k] = len(parts) - 1
            for part in filter(None, parts):
                got = [t for t, _ in split(part)]
                tokens += got
                owner += [k] * len(got)
        merged = self._merged(tokens, np.array([len(t) for t in tokens], np.int64))
        total = extra + np.bincount(np.array(owner, np.int64), merged, len(rest)).astype(np.int64)
        self.known.update(zip(rest, total.tolist(), strict=True))

    def _merged(self, tokens: list[str], sizes: np.ndarray) -> np.ndarray:
        if not tokens:
            return np.zeros(0, np.int64)
        points = np.frombuffer("".join(tokens).encode("utf-16-le"), "<u2")
        return merge_counts(self.first[points], sizes, self.table)


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """The counter of this Python worker, which serves one task after another."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null or empty text has none of
    either, a very long one is counted whole; null and repeated keys stay rows of their own; no rows, no result; other
    columns are left out."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in slices(batches, 2048):
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counter.counts(batch.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
