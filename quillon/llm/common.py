"""What the corpus operators share: tables, shared folders, Arrow batches and whole-text tokenization."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table  # noqa: F401

#: Bytes that one Arrow batch between the JVM and Python may hold; bounds the memory of a Python worker.
BATCH_BYTES = "16m"

#: Bytes of words and ids that an encoder holds for the next batches.
HELD_BYTES = 64 << 20

#: Java and Python pattern of a word in the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# The code points with Unicode's White_Space property, for Python and for RE2.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A run of white space with the run of other characters after it. A byte-level pre-tokenizer always cuts before
#: white space that follows something else, so the tokens of a text are those of its pieces.
PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: It also cuts before every space, but for one with white space on both sides.
INNER_SPACE = f"[{_SPACE_RE2}] [{_SPACE_RE2}]"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as by rows, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows with a few columns of 8 bytes up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def joined_by(rows: DataFrame, keys: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with a written table of keys: broadcast up to BROADCAST_ROWS keys, shuffled beyond."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key, how)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """XXH64 of words as bytes, held for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxh64_intdigest(word, 42)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` words at each place, from the words' hashes."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class TwoGenerations(dict):
    """A dict for what was seen lately: holds at most twice `most` keys, and forgets those not looked up for longest."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that are not held; the others are kept for longer."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        again = new.intersection(self.old)
        self.update((k, self.old[k]) for k in again)
        return list(new - again)


class PieceEncoder:
    """Token ids of whole texts by the tokenizers library. A batch's distinct words are encoded once each, a thousand of
    them side by side in one text, and the ids are laid out in the order of the words. Up to `most` words are held for
    the next batches; when there are more, those of the last batch stay.

    Only for byte-level tokenizers whose pre-tokenizer cuts before white space; others, and texts with a space between
    two other white spaces, are encoded text by text."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.held, self.held_ids = most, pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.by_piece = cuts_before_space(self.tokenizer)
        if self.by_piece:  # bytes of each id: one character of its string each
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes_of[i] = len(token)
            for i, token in self.tokenizer.get_added_tokens_decoder().items():
                self.bytes_of[i] = len(token.content.encode())

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of a column of texts (null: empty) the ids in one array, and where each text's ids end."""
        column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
        if len(column) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_piece:
            ids = self._alone(column.to_pylist())
            return _values(ids), _ends(ids)
        odd = pc.match_substring_regex(column, INNER_SPACE)
        words = pc.split_pattern(pc.if_else(odd, "", column), " ")
        starts = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        # the first word of a text has no space before it; a text that is encoded whole is its own first word
        heads = pc.if_else(odd, column, coded.dictionary.take(pa.array(index[starts[:-1]])))
        ids = pa.concat_arrays([self._words(coded.dictionary), self._alone(heads.to_pylist())])
        index[starts[:-1]] = len(coded.dictionary) + np.arange(len(heads))
        laid = ids.take(pa.array(index))  # all words' ids side by side
        return _values(laid), _ends(laid)[starts[1:] - 1]

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words with a space in front, as bytes."""
        place = pc.index_in(words, value_set=self.held)
        new = words.filter(pc.is_null(place))
        known = pa.concat_arrays([self.held_ids, self._encode(new)])
        place = place.to_numpy(zero_copy_only=False)
        fresh = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
        place = np.where(fresh, len(self.held) + np.cumsum(fresh) - 1, place).astype(np.int64)
        found = known.take(pa.array(place))
        if len(known) > self.most or self.held.nbytes + known.nbytes > HELD_BYTES:
            self.held, self.held_ids = words, found
        else:
            self.held, self.held_ids = pa.concat_arrays([self.held, new]), known
        return found

    def _encode(self, words: pa.Array, side: int = 1024, texts: int = 16) -> pa.Array:
        length = pc.binary_length(words).to_numpy().astype(np.int64)
        # what is empty or ends in white space can run into the next word
        joins = pc.match_substring_regex(words, r"[^\x00-\x20]\z").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n, strings = int(joins.sum()), words.to_numpy(zero_copy_only=False)
        out = []
        for at in range(0, n, side * texts):
            parts = [order[a : min(a + side, n)] for a in range(at, min(at + side * texts, n), side)]
            found = self.tokenizer.encode_batch_fast([" " + " ".join(strings[p].tolist()) for p in parts], add_special_tokens=False)
            for p, e in zip(parts, found, strict=True):
                got, stops = np.array(e.ids, "<u4"), np.cumsum(length[p] + 1)
                reached = np.cumsum(self.bytes_of[got])
                cut = np.searchsorted(reached, stops)
                if len(got) and reached[-1] == stops[-1] and np.array_equal(reached[cut], stops):
                    out.append(_as_bytes(got, cut + 1))
                else:  # they did not stay apart
                    out.append(self._alone([" " + w for w in strings[p]]))
        out = pa.concat_arrays([*out, self._alone([" " + w for w in strings[order[n:]]])])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return out.take(pa.array(place))

    def _alone(self, texts: list[str]) -> pa.Array:
        got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return _as_bytes(np.concatenate([np.zeros(0, "<u4"), *got]), np.cumsum([len(x) for x in got], dtype=np.int64))


def _as_bytes(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids, cut at the ends, as an array of byte strings."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def _ends(ids: pa.Array) -> np.ndarray:
    return np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[1:] // 4


def _values(ids: pa.Array) -> np.ndarray:
    return np.frombuffer(ids.buffers()[2], "<u4", int(_ends(ids)[-1]))


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker, which serves one task after another: loaded once, with what it has seen."""
    return PieceEncoder(path)


def cuts_before_space(tokenizer) -> bool:
    """Whether the tokens of a text are those of its pieces: byte level, nothing normalised or added, and special
    strings that neither hold white space nor take it from their sides."""
    pre = repr(tokenizer.pre_tokenizer)
    special = tokenizer.get_added_tokens_decoder().values()
    return tokenizer.normalizer is None and pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre and not any(t.lstrip or t.rstrip or t.single_word or re.search(f"[{_SPACE}]", t.content) for t in special)


def word_count(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
