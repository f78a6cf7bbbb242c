"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `distance` or fewer differing bits. The bits are grouped into parts, correlated bits
together, and each part i gets a threshold t_i with sum(t_i) = distance - parts + 1: two fingerprints that link then
differ in at most t_i bits of some part i with t_i >= 0. Number of parts and thresholds come from a dynamic programme
over estimated costs: keys written plus candidate pairs compared. A fingerprint's keys for a part are its value there
with each choice of t_i bits masked out, so that whoever differs in t_i bits shares a key.

Only distinct fingerprints are compared. A group of fingerprints that share a key is compared in memory up to a size.
In larger groups each member is listed under every value within half the distance of it: two that link share such a
value, and no value has more holders than a ball has points. A group yields a spanning forest of its verified links,
not its pairs.

`similar_texts` finds texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Edits change few words, so
its candidates are fingerprints of the distinct words, at a distance that near copies keep; they are found by the same
parts and thresholds. A second fingerprint, of the shingles, drops candidates that can't be alike. Candidates of sparse
groups are pairs, each verified on the whole shingle sets. A dense group has too many pairs to list; what its candidates
hang together with is a cluster, and clusters are compared whole and exactly, block by block (`cluster_links`).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, joined_by, materialise, run_hashes, slices, texts_of, unused
from .components import connected_components

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Bit k is 1 if it is set in over half of the XXH64 values of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long). A null text is empty: zero bits."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            bits = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, "doc_id long, bits long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both: 64 x 64 counts over all of them."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in slices(batches, 1 << 14):
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], ["n", "both"])

    parts = distinct.select("bits").mapInArrow(count, "n long, both array<long>")
    summed = parts.select("n", F.posexplode("both").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    both, n = np.zeros(BITS * BITS, np.int64), 0
    for r in summed.collect():  # 4,096 rows
        both[r.k], n = r.v, r.n
    return n, both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size, each filled with those most correlated with what it holds."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        first = max(free, key=lambda b: (correlation[b, sorted(free)].sum(), -b))
        held = [first]
        free.discard(first)
        while len(held) < size:
            best = max(free, key=lambda b: (correlation[b, held].sum(), -b))
            held.append(best)
            free.discard(best)
        out.append(sorted(held))
    return out


def part_cost(n: int, both: np.ndarray, bits: list[int], threshold: int, shares: np.ndarray | None = None) -> float:
    """Estimated work for each fingerprint: keys of the part at the threshold, and candidates that share one.

    shares: of all pairs, those that differ in 0, 1 and 2 of the part's bits. A pair that differs in k of them meets under
    each key that masks these k; a key costs as much as a thousand comparisons. Without shares, two fingerprints agree on
    a bit with probability p^2 + (1 - p)^2, and with the least of the bits' agreement the masked ones are left out."""
    if threshold < 0:
        return 0.0
    if threshold > 2 or threshold >= len(bits):
        return float("inf")
    if shares is not None:
        return comb(len(bits), threshold) * 1000 + n * float(sum(shares[k] * comb(len(bits) - k, threshold - k) for k in range(threshold + 1)))
    p = np.diag(both) / max(n, 1)
    agree = np.sort(np.log(p[bits] ** 2 + (1 - p[bits]) ** 2))
    keys = 1
    for k in range(threshold):
        keys = keys * (len(bits) - k) // (k + 1)
    return keys * (4 + n * float(np.exp(agree[threshold:].sum())))


def differing(sample: np.ndarray, bits: list[int]) -> np.ndarray:
    """Of all pairs of a sample of fingerprints, those that differ in 0, 1 and 2 of the bits."""
    part = sample & np.uint64(sum(1 << (63 - b) for b in bits))
    count = np.bincount(np.bitwise_count(part[:, None] ^ part[None, :]).ravel(), minlength=3)[:3]
    return (count - [len(part), 0, 0]) / (len(part) * (len(part) - 1))


def allocate(n: int, both: np.ndarray, distance: int, sample: np.ndarray | None = None) -> list[tuple[list[int], int]]:
    """The parts that are probed, with their thresholds: the cheapest over all numbers of parts that can have any."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, distance + 2):
        groups, total = group_bits(n, both, m), distance - m + 1
        # cheapest[s]: the cost and thresholds of the groups so far whose thresholds add up to s
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            new: dict[int, tuple[float, list[int]]] = {}
            shares = None if sample is None or len(sample) < 2 else differing(sample, g)
            costs = {t: part_cost(n, both, g, t, shares) for t in range(-1, min(distance, 2) + 1)}
            for s, (cost, chosen) in cheapest.items():
                for t in costs:
                    c = cost + costs[t]
                    if c < new.get(s + t, (float("inf"), []))[0]:
                        new[s + t] = (c, [*chosen, t])
            cheapest = new
        if total in cheapest and (best is None or cheapest[total][0] < best[0]):
            best = (cheapest[total][0], [(g, t) for g, t in zip(groups, cheapest[total][1], strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: list[int], threshold: int) -> list[int]:
    """Masks of the part with each choice of `threshold` bits left out. Bit 0 is the most significant."""
    return [_signed(sum(1 << (63 - b) for b in bits if b not in out)) for out in map(set, combinations(bits, threshold))]


def spanning_links(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints that differ in at most `distance` bits: each node in turn takes
    what it reaches of those not reached before."""
    left, ends = np.unique(bits), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= distance
            if near.any():
                reached, left = left[near], left[~near]
                ends.append((np.full(len(reached), node), reached))
                queue.extend(reached)
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*ends, strict=True))
    return a, b


def links(distinct: DataFrame, distance: int = 2, most: int = 1 << 15) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column bits) that connect what differs in at most `distance` bits:
    every link is an edge or a path of edges, each of them verified. Fingerprints are distinct and not null. `most` is the
    size up to which a group is compared in memory; larger ones are listed by ball, none is left out."""
    n, both = bit_statistics(distinct)
    masks = [m for bits, t in allocate(n, both, distance) for m in _masks(bits, t)]
    # fixed: the bits on which the members of a group are known to agree
    keyed = distinct.select("bits", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("fixed")).withColumn("value", F.col("bits").bitwiseAND(F.col("fixed")))
    sizes = keyed.groupBy("fixed", "value").agg(F.count("*").alias("size")).where("size > 1")
    keyed = materialise(keyed.join(sizes, ["fixed", "value"]))
    small = keyed.where(F.col("size") <= most).select("fixed", "value", "bits")
    large = balls(keyed.where(F.col("size") > most).select("fixed", "bits"), (distance + 1) // 2)
    return forest(small, distance).union(forest(large, distance)).distinct()


def balls(members: DataFrame, radius: int) -> DataFrame:
    """members: fixed, bits. Each member under every value that differs from it in at most `radius` of the bits that are
    not fixed: fixed, value, bits."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 12):
            fixed, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for f in np.unique(fixed):
                free = [b for b in range(BITS) if not int(f) >> (63 - b) & 1]
                flips = np.array([_signed(sum(1 << (63 - b) for b in c)) for k in range(radius + 1) for c in combinations(free, k)], np.int64)
                own = bits[fixed == f]
                value = (own[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), f)), pa.array(value), pa.array(np.repeat(own, len(flips)))], ["fixed", "value", "bits"])

    return members.mapInArrow(spread, "fixed long, value long, bits long")


def groups_of(frames: Iterable[pd.DataFrame], keys: list[str], values: list[str]) -> Iterator[list[np.ndarray]]:
    """Of frames that are sorted by the keys the value columns of each group of two rows or more, one after the other; a
    group may go on in the next frames."""
    held: list[list[np.ndarray]] = []  # of the open group, by frame
    key: list | None = None

    def close() -> Iterator[list[np.ndarray]]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if len(held) > 1 else held[0] if held else [[]]
        if len(columns[0]) > 1:
            yield columns

    for frame in frames:
        if not len(frame):
            continue
        names, columns = [frame[c].to_numpy() for c in keys], [frame[c].to_numpy() for c in values]
        edge = [*np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)).tolist()]
        edge = [0, *(e + 1 for e in edge), len(frame)]
        if key is not None and key != [c[0] for c in names]:
            yield from close()
            held = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a:
                yield from close()
                held = []
            held.append([c[a:b] for c in columns])
        key = [c[-1] for c in names]
    yield from close()


def in_frames(ends: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Edges as frames (a, b) of some size."""
    held, n = [], 0
    for a, b in ends:
        if len(a):
            held.append((a, b))
            n += len(a)
        if n > 1 << 16:
            yield pd.DataFrame({"a": np.concatenate([e[0] for e in held]), "b": np.concatenate([e[1] for e in held])})
            held, n = [], 0
    if held:
        yield pd.DataFrame({"a": np.concatenate([e[0] for e in held]), "b": np.concatenate([e[1] for e in held])})


def forest(keyed: DataFrame, distance: int) -> DataFrame:
    """keyed: fixed, value, bits. The spanning links of each group; a task reads its groups one after the other."""

    def link(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames(spanning_links(bits.view(np.uint64), distance) for (bits,) in groups_of(frames, ["fixed", "value"], ["bits"]))

    return keyed.repartition("fixed", "value").sortWithinPartitions("fixed", "value").select("fixed", "value", "bits").mapInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id keep it and get the
    smallest doc_id of the others they reach, null if there is none. Repeated rows and doc_ids stay rows of their own.
    No rows, no result. Other columns are left out."""
    prints = materialise(fingerprints(docs, key, text))
    distinct = materialise(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    nodes = connected_components(links(distinct.select("bits"), distance)).withColumnRenamed("node", "bits")
    classes = distinct.join(nodes, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(classes.join(least, "component").select("bits", "component_id"))
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of `size` words (their hashes given); fewer words are one run."""
    return np.unique(run_hashes(words, min(size, max(1, len(words)))))


def lowered_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; none give zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


@dataclass
class Group:
    """Fingerprints that share a key: of words, of shingles (two of 64 bits), and the number of shingles."""

    bits: np.ndarray
    first: np.ndarray
    second: np.ndarray
    n: np.ndarray
    similarity: float
    distance: int

    def apart(self, i, j) -> np.ndarray:
        """Bits in which the shingle fingerprints differ; NOT_NEAR where the texts can't have the similarity or the words'
        fingerprints are too far apart."""
        far = np.bitwise_count(self.first[i] ^ self.first[j]) + np.bitwise_count(self.second[i] ^ self.second[j])
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        near = (np.bitwise_count(self.bits[i] ^ self.bits[j]) <= self.distance) & (low >= self.similarity * high - 1e-6) & (far <= shingle_limit(self.similarity))
        return np.where(near, far, NOT_NEAR).astype(np.uint8)

    def edges(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Candidate links and False; in a dense group edges of a spanning forest of the candidates and True."""
        size, ends, held = len(self.bits), [], 0
        step = max(1, (1 << 21) // size)
        for a in range(0, size, step):
            i, j = np.nonzero(np.bitwise_count(self.bits[a : a + step, None] ^ self.bits[None, a:]) <= self.distance)
            i, j = i[j > i] + a, j[j > i] + a
            near = self.apart(i, j) != NOT_NEAR
            ends.append((i[near], j[near]))
            held += int(near.sum())
            if held > 4 * size + 64:
                return *self.forest(), True
        return *(np.concatenate(x) for x in zip(*ends, strict=True)), False

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        left, ends = np.arange(len(self.bits)), []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                node = queue.pop()
                near = self.apart(node, left) != NOT_NEAR
                if near.any():
                    reached, left = left[near], left[~near]
                    ends.append((np.full(len(reached), node), reached))
                    queue.extend(reached)
        return tuple(np.concatenate(x) for x in zip(*ends, strict=True))


NOT_NEAR = 255


def shingle_limit(similarity: float) -> int:
    """Of 128 bits, those that differ at the similarity, and four standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(128 * p + 4 * math.sqrt(128 * p * (1 - p)))


def candidate_links(distinct: DataFrame, similarity: float, distance: int, most: int) -> DataFrame:
    """distinct: set, bits, first, second, n. Candidate links (a, b, dense) between sets: all pairs of candidates, but of
    dense groups edges that connect what all of theirs do. `most` is the size up to which a group is compared as a whole.
    A larger one is dealt to blocks, and each two blocks are compared by a task. Sets are distinct, nothing is null."""
    n, both = bit_statistics(distinct)
    sample = np.array([r.bits for r in distinct.orderBy(F.xxhash64("set"), "set").select("bits").limit(2048).collect()], np.int64).view(np.uint64)
    masks = [m for bits, t in allocate(n, both, distance, sample) for m in _masks(bits, t)]
    keyed = distinct.withColumn("fixed", F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))).withColumn("value", F.col("bits").bitwiseAND(F.col("fixed")))
    zero = F.lit(0)
    large = materialise(keyed.groupBy("fixed", "value").agg(F.count("*").alias("size")).where(F.col("size") > most))
    if not large.isEmpty():
        blocks = keyed.join(large, ["fixed", "value"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / most), F.lit(1)).cast("int"))
        blocks = blocks.withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        keyed = blocks.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    else:
        keyed = keyed.withColumn("lo", zero).withColumn("hi", zero)
    keys, values = ["fixed", "value", "lo", "hi"], ["set", "bits", "first", "second", "n"]

    def linked(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for own, bits, first, second, count in groups_of(frames, keys, values):
            i, j, dense = Group(bits.view(np.uint64), first.view(np.uint64), second.view(np.uint64), count, similarity, distance).edges()
            held.append((np.minimum(own[i], own[j]), np.maximum(own[i], own[j]), np.full(len(i), dense)))
            n += len(i)
            if n > 1 << 16:
                yield pd.DataFrame(dict(zip(("a", "b", "dense"), map(np.concatenate, zip(*held, strict=True)), strict=True)))
                held, n = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("a", "b", "dense"), map(np.concatenate, zip(*held, strict=True)), strict=True)))

    found = keyed.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(linked, "a long, b long, dense boolean")
    return found.groupBy("a", "b").agg(F.max("dense").alias("dense"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs: a, b; sets: set, shingles. The pairs that have the similarity."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda v: np.frombuffer(v.as_buffer(), np.uint64)
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            yield batch.select(["a", "b"]).filter(pa.array([jaccard(of(x[k]), of(y[k])) >= similarity - 1e-9 for k in range(batch.num_rows)], pa.bool_()))

    x, y = (sets.select(F.col("set").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


#: Texts and shingles of a block of a cluster, and texts that all of its blocks meet first.
BLOCK, BLOCK_SHINGLES, HUBS = 1024, 1 << 21, 64


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, by the shingles that two or more of them have."""
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    column, who = np.unique(column[common], return_inverse=True)[1], who[common]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 2048
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(sets), width), np.float32)
        has[who[lo:hi], column[lo:hi] - at] = 1
        out += has @ has.T
    return out


def exact_forest(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between sets of different sides (side -1: between all)."""
    n, both = np.array([len(x) for x in sets], np.float32), shared_shingles(sets)
    linked = both >= np.float32(similarity - 1e-6) * (n[:, None] + n[None, :] - both)
    for i, j in zip(*np.nonzero(linked & (both < np.float32(similarity + 1e-6) * (n[:, None] + n[None, :] - both))), strict=True):
        linked[i, j] = float(both[i, j]) / (float(n[i]) + float(n[j]) - float(both[i, j])) >= similarity - 1e-9 if n[i] or n[j] else True
    if (side >= 0).any():
        linked &= side[:, None] != side[None, :]
    left, ends = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = linked[node, left]
            if near.any():
                reached, left = left[near], left[~near]
                ends.append((np.full(len(reached), node), reached))
                queue.extend(reached)
    return tuple(np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forests(meeting: DataFrame, sets: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """meeting: keys, side, set; sets: set, shingles. Verified links (a, b) that connect the sets of each group."""

    def link(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, side, shingles in groups_of(frames, keys, ["set", "side", "shingles"]):
            i, j = exact_forest([np.frombuffer(x, np.uint64) for x in shingles], side, similarity)
            if len(i):
                yield pd.DataFrame({"a": own[i], "b": own[j]})

    return meeting.join(sets, "set").select(*keys, "side", "set", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(link, "a long, b long")


def cluster_links(clusters: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """clusters: set, cluster, n; sets: set, shingles. Verified links (a, b) that connect what all links inside a cluster do.

    A cluster is dealt to blocks, and each block is compared whole, with some texts that all blocks of its cluster meet. A
    link that this leaves out joins two classes, so one of its texts is not in the cluster's largest class: these are
    compared with all texts of the cluster, block against block. No pair of a cluster is left untested unless both of its
    texts are in one class already."""
    zero = F.lit(0).cast("long")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = materialise(joined_by(clusters.select("set", "cluster"), materialise(sizes), "cluster").withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks"))))
    hub = F.pmod(F.xxhash64(F.lit(1), "set"), F.col("size")) < HUBS
    every = F.when(hub, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("own"))
    first = materialise(forests(placed.select("cluster", F.explode(every).alias("block"), F.lit(-1).alias("side"), "set"), sets, ["cluster", "block"], similarity))
    many = placed.where("blocks > 1")
    if many.isEmpty():
        return first
    classes = joined_by(many, materialise(connected_components(first).withColumnRenamed("node", "set")), "set", "left").withColumn("class", F.coalesce("component", "set"))
    largest = classes.groupBy("cluster", "class").agg(F.count("*").alias("of")).groupBy("cluster").agg(F.max_by("class", F.struct("of", "class")).alias("largest"))
    rest = materialise(joined_by(classes, materialise(largest), "cluster").where("class <> largest").select("cluster", "set", "own", "blocks"))
    if rest.isEmpty():
        return first
    counted = materialise(rest.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("parts")))
    part = F.pmod(F.xxhash64(F.lit(2), "set"), F.col("parts"))
    rest = rest.join(counted, "cluster").select("cluster", part.alias("part"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "set")
    others = many.join(counted, "cluster").select("cluster", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), F.col("own").alias("block"), F.lit(1).alias("side"), "set")
    return first.union(materialise(forests(rest.union(others), sets, ["cluster", "part", "block"], similarity)))


def similar_texts(docs: DataFrame, key: str, text: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 8, most: int = 1 << 14, block: int = BLOCK) -> DataFrame:
    """Per row: key, class. Rows are of one class if verified links lead from one to the other: a Jaccard similarity of
    their texts' distinct shingles of at least `similarity`. key: a long, the same only for rows with the same text.

    Texts with the same shingles are alike, so null and empty ones are. Each link that stands is exact; found are those
    whose word fingerprints differ in at most `distance` bits. Very long texts are taken whole. No rows, no result."""
    bounded_batches(docs.sparkSession)
    long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        hashes = WordHashes()
        for batch in slices(batches, 512):
            own = [hashes.of(lowered_words(t)) for t in texts_of(batch.column(1))]
            runs = [shingle_hashes(x, words) for x in own]
            first, second = ([majority(r * np.uint64(odd) ^ r >> np.uint64(31)) for r in runs] for odd in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), long([xxh3_64_intdigest(r.tobytes()) for r in runs]), long([majority(np.unique(x)) for x in own]), long(first), long(second), pa.array([len(r) for r in runs], pa.int64())],
                ["key", "set", "bits", "first", "second", "n"],
            )

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(hashes.of(lowered_words(t)), words).tobytes() for t in texts_of(batch.column(1))], pa.binary())], ["set", "shingles"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = materialise(rows.mapInArrow(prints, "key long, set long, bits long, first long, second long, n long"))
    distinct = materialise(marked.groupBy("set").agg(*(F.min(c).alias(c) for c in ("key", "bits", "first", "second", "n"))))
    pairs = materialise(candidate_links(distinct.drop("key"), similarity, distance, most))
    ends = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    asked = materialise(ends.join(distinct.select("set", "key"), "set"))
    sets = joined_by(rows, asked, "key").dropDuplicates(["key"]).select("set", "text").mapInArrow(whole, "set long, shingles binary")
    sets = materialise(sets)
    links = verified(pairs.where("not dense").select("a", "b"), sets, similarity)
    dense = pairs.where("dense")
    if not dense.isEmpty():
        clusters = connected_components(dense).select(F.col("node").alias("set"), F.col("component").alias("cluster"))
        links = links.union(cluster_links(clusters.join(distinct.select("set", "n"), "set"), sets, similarity, block))
    component = connected_components(links).withColumnRenamed("node", "set")
    return marked.select("key", "set").join(component, "set", "left").select(F.col("key").alias(key), F.coalesce("component", "set").alias("class"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay when one row of each class of similar texts does: that of its smallest doc_id. Rows with
    a null doc_id go where their class has another; of repeated doc_ids in a class one row stays, that of the smallest
    text hash; of rows with the same doc_id and text one stays, whatever else they hold. Null and empty texts are one
    class. Other columns keep their names; no rows, no result. What goes is looked up, so the texts that stay are not
    shuffled."""
    row = unused(docs, "_row")
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    of = similar_texts(marked.select(row, "text"), row, "text", words, similarity).select(F.col(row).alias("_row"), F.col("class").alias("_class"))
    of = materialise(of.groupBy("_row").agg(F.min("_class").alias("_class"), F.count("*").alias("_n")))
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row")).distinct().join(of, "_row")
    first = ids.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("k")).select(F.col("k._row").alias("_row"))
    gone = materialise(of.join(first, "_row", "left_anti").select(F.col("_row").alias(row)))
    again = materialise(of.where("_n > 1").join(first, "_row", "left_semi").select(F.col("_row").alias(row)))
    single = joined_by(joined_by(marked, gone, row, "left_anti"), again, row, "left_anti")
    return single.union(joined_by(marked, again, row, "left_semi").dropDuplicates([row])).select(*docs.columns)
