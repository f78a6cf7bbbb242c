"""Sequence packing: shortest-pack-first over the length histogram.

Documents become pieces of at most `max_tokens` token ids. Only the histogram of piece lengths, which has at most
`max_tokens` rows for any corpus, comes to the driver; it is packed there into patterns with counts, and the patterns
are joined back to the pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, piece_encoder, slices

PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the document's key, the ids before it, its length, the CRC-32 of its ids (little-endian
    unsigned 32-bit) and the document's ids with the end id.

    A null text is empty and so one piece with the end id alone; rows with a null or repeated key stay rows of their
    own; a longer text than max_tokens is cut into pieces, whole; no documents, no rows; other columns are left out."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = piece_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, ends = encoder.ids(batch.column(1))
            rows, before = [], 0
            for doc, at in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                raw = ids[before:at].tobytes() + end
                n, before = len(raw) // 4, at
                rows += [(doc, k, min(max_tokens, n - k), zlib.crc32(raw[4 * k : 4 * (k + max_tokens)]), n) for k in range(0, n, max_tokens)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, PIECES_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how many packs, [(length, how many of it side by side), ...]).

    Lengths are placed longest first, each on the packs that hold least so far. Where it fits on none, new packs take
    as many of it as they hold."""
    packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by the space left: count and chain of items
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for space in range(max_tokens, length - 1, -1):
            if not left:
                break
            waiting, packs[space] = packs[space], []
            while waiting and left:
                count, chain = waiting.pop()
                # all packs of this class get the same number of copies, as evenly as they reach
                copies = max(1, min(space // length, left // count))
                used = min(count, left // copies)
                left -= used * copies
                packs[space - copies * length].append((used, (chain, length, copies)))
                if used < count:
                    packs[space].append((count - used, chain))
            packs[space] += waiting
        if left:
            copies = max_tokens // length
            if left >= copies:
                packs[max_tokens - copies * length].append((left // copies, (None, length, copies)))
            if rest := left % copies:
                packs[max_tokens - rest * length].append((1, (None, length, rest)))
    out = []
    for space in sorted(packs):
        for count, chain in packs[space]:
            items = []
            while chain:
                chain, length, copies = chain
                items.append((length, copies))
            out.append((count, items[::-1]))
    return out


def pattern_slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, copies, first sequence, offset): the ranks of each length are
    given to the patterns in turn."""
    taken: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for count, items in patterns:
        offset = 0
        for length, copies in items:
            slots.append((length, taken[length], taken[length] + count * copies, copies, sequence, offset))
            taken[length] += count * copies
            offset += length * copies
        sequence += count
    return slots


def pack(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Give each piece (columns of token_pieces) its sequence_id and the offset there; no pieces, no rows.

    Ranks come from two levels, so no length gathers in one task: within the part that a task wrote, and the sums of
    the parts before."""
    spark = pieces.sparkSession
    pieces = materialise(pieces.withColumn("part", F.spark_partition_id()))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = pieces.withColumn("within", within).join(before, ["length", "part"]).withColumn("rank", F.col("base") + F.col("within"))
    slots = spark.createDataFrame(pattern_slots(shortest_pack_first(histogram, max_tokens)), "slot_length long, first long, after long, copies long, sequence long, item_offset long")
    at = F.col("rank") - F.col("first")
    # a few slots per length, whatever the size of the corpus: broadcast
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("item_offset") + (at % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents (token_pieces) with their sequence_id and offset. Null and empty texts, and null and repeated
    keys, are as there; a text of any length has as many pieces as it fills; no documents, no rows."""
    return pack(token_pieces(docs, tokenizer, max_tokens, end_id, key, text), max_tokens)


def sequence_ids(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 1, pad_id: int = 0, max_tokens: int = 2048) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int, padded to max_tokens). One row of `packed` per
    piece and distinct doc_id are expected; a sequence's pieces meet in one group of at most max_tokens ids."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        for batch in slices(batches, 512):
            ids, ends = encoder.ids(batch.column(1))
            out = [[*part.tolist(), end_id] for part in np.split(ids, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "all_ids"])

    bounded_batches(docs.sparkSession)
    whole = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, all_ids array<int>")
    parts = packed.join(whole, "doc_id").select("sequence_id", "offset", F.slice("all_ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    ids = parts.groupBy("sequence_id").agg(ids.alias("ids"))
    return ids.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(max_tokens) - F.size("ids"))))
