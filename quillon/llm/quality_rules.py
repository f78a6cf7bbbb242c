"""Quality rules by compression bands, with the base counts of words, symbols and repeats.

A text is rejected where zstandard makes it much smaller than prose of its length (repetition) or hardly smaller at
all (noise). The limits depend on the length: short prose compresses worse than long prose.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts_of

#: UTF-8 bytes from which the limits hold: compressed share below which a text repeats itself, above which it is noise. The
#: upper limits are the largest shares of 3,306 texts labelled good (0.92, 0.74, 0.68, 0.58, 0.47, 0.43; chunks 0.48) and
#: 15 % more; the lower ones lie at about half of the smallest (0.57, 0.54, 0.51, 0.45, 0.42, 0.40; chunks 0.44).
BANDS = ((128, 0.40, 1.00), (256, 0.35, 0.85), (512, 0.30, 0.78), (1024, 0.25, 0.67), (4096, 0.20, 0.54), (16384, 0.17, 0.50))
#: Bytes of a chunk, its limits, and the share of bytes in chunks beyond them that rejects a text.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 4096, 0.20, 0.55, 1 / 3

SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_chunks double"
_WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of five words which the text has twice or more."""
    if len(words) < _WINDOW + 1:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words)) + np.uint64(1)
    n = len(words) - _WINDOW + 1
    bits = max(1, len(number)).bit_length()
    if bits * _WINDOW <= 64:
        keys = np.zeros(n, np.uint64)
        for k in range(_WINDOW):
            keys = keys << np.uint64(bits) | ids[k : k + n]
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    else:  # too many different words for one 64-bit key: name the pairs first, then the fours, then the fives
        pair = np.unique(ids[:-1] << np.uint64(32) | ids[1:], return_inverse=True)[1].astype(np.uint64)
        four = np.unique(pair[:-2] << np.uint64(32) | pair[2:], return_inverse=True)[1].astype(np.uint64)
        _, inverse, count = np.unique(four[:n] << np.uint64(32) | ids[_WINDOW - 1 :], return_inverse=True, return_counts=True)
    again = np.append((count > 1)[inverse], np.zeros(_WINDOW - 1, bool)).astype(np.int64)
    inside = np.cumsum(again)
    inside[_WINDOW:] -= inside[:-_WINDOW].copy()
    return int(np.count_nonzero(inside))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Bands:
    def __init__(self, level: int = 3):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def verdict(self, raw: bytes) -> tuple[bool, float, float]:
        """(inside all bands, compressed share of the whole, share of bytes in chunks outside theirs)."""
        if not raw:
            return True, 1.0, 0.0
        ratio = len(self.compress(raw)) / len(raw)
        inside = True
        for least, low, high in reversed(BANDS):
            if len(raw) >= least:
                inside = low <= ratio <= high
                break
        odd = 0
        if len(raw) >= CHUNK:
            ends = [*range(CHUNK, len(raw) + 1, CHUNK)]
            if ends[-1] < len(raw):
                ends.append(len(raw))  # the remainder, with what stands before it up to a whole chunk
            for before, end in zip([0, *ends], ends):
                if not CHUNK_LOW <= len(self.compress(raw[end - CHUNK : end])) / CHUNK <= CHUNK_HIGH:
                    odd += end - before
        share = odd / len(raw)
        return inside and share <= CHUNK_SHARE, ratio, share


def document_counts(text: str, bands: Bands) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeat_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    inside, ratio, share = bands.verdict(raw)
    return len(words), word_chars, symbols, duplicate_lines(raw), repeats, failed, inside and not failed, ratio, share


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_columns: bool = False) -> DataFrame:
    """Per row the counts, base_failed, kept, and the compressed share of the whole and share of bytes in odd chunks.

    A null text counts as empty: no words, base_failed. Very long texts are judged whole; null and repeated keys stay rows
    of their own; no rows, no result. Other columns are left out; keep_columns returns the rows of docs that are kept instead, with docs' own columns."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in slices(batches, 512):
            rows = [document_counts(t, bands) for t in texts_of(batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in slices(batches, 512):
            yield batch.filter(pa.array([document_counts(t, bands)[6] for t in texts_of(batch.column(at))], pa.bool_()))

    bounded_batches(docs.sparkSession)
    if keep_columns:
        at = docs.columns.index(text)
        return docs.mapInArrow(keep, docs.schema)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, SCHEMA)
