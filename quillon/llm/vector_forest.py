"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits at the median of a random projection, again and again; what lies near the cut goes to both sides (spill), so
that close vectors part only rarely, and hardly ever in all trees. The upper splits are fitted on a sample and hold for
every vector; leaves that stay too large are split further, each by trees of its own fitted where its vectors are.

Vectors of a leaf are compared with each other in double precision. A pair that meets in several leaves is counted in the
smallest of them: each vector carries the ids of its leaves, so links are counted without listing pairs, and a leaf hands on
a spanning forest of its links. A leaf that splits no more is a dense group: vectors within half the linking angle of one
centre link with each other whatever they are, so such a ball is counted as a whole and only its pairs with others are
compared, block by block. Equal vectors are one, with their number.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, joined_by, materialise, slices
from .components import connected_components
from .maxscore import usable
from .simhash import groups_of

#: Trees, vectors of a leaf that is split no further, and most that are compared at once.
TREES, TARGET, MOST = 8, 2048, 4096
#: Vectors and bytes of a sample at most, and those that a leaf of the fitted tree has at least.
SAMPLE, SAMPLE_BYTES, LEAST = 8192, 32 << 20, 32
#: Part of a node's vectors that may go to one side of a split; more is no progress.
PROGRESS = 0.85
MEMBER = "key long, vec binary, copies long, width int, leaves array<long>"


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, also of very large and very small ones."""
    rows = rows.astype(float)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def spill(similarity: float, width: int) -> float:
    """How far from a cut vectors go to both sides: half a standard deviation of a projected link."""
    return math.sqrt(max(2 - 2 * similarity, 0)) / math.sqrt(width) / 2


class Tree:
    """Splits of a random-projection tree: a direction and a cut each, and what lies left and right (a split, or ~leaf)."""

    def __init__(self, sample: np.ndarray, rows: float, margin: float, draw: np.random.Generator, target: int):
        """sample: unit vectors that stand for so many rows. A node is split while it stands for more than `target`."""
        self.directions, self.cuts, self.sides, self.leaves, self.margin = [], [], [], 0, margin
        self.top = self._node(np.arange(len(sample)), sample, rows / max(len(sample), 1), draw, target)

    def _node(self, own: np.ndarray, sample: np.ndarray, each: float, draw: np.random.Generator, target: int) -> int:
        if len(own) * each > target and len(own) >= LEAST:
            directions = draw.normal(size=(sample.shape[1], 3))
            directions /= np.linalg.norm(directions, axis=0)
            shadows = sample[own] @ directions
            best = int(shadows.std(axis=0).argmax())  # of three, that which spreads most
            shadow, cut = shadows[:, best], float(np.median(shadows[:, best]))
            left, right = shadow <= cut + self.margin, shadow >= cut - self.margin
            if max(left.sum(), right.sum()) <= PROGRESS * len(own):
                at = len(self.cuts)
                self.directions.append(directions[:, best])
                self.cuts.append(cut)
                self.sides.append((0, 0))
                self.sides[at] = (self._node(own[left], sample, each, draw, target), self._node(own[right], sample, each, draw, target))
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaves_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a leaf that it is in."""
        found, open_ = [], [(self.top, np.arange(len(rows)))]
        while open_:
            node, own = open_.pop()
            if node < 0:
                found.append((own, np.full(len(own), ~node)))
            elif len(own):
                shadow = rows[own] @ self.directions[node]
                for side, kept in zip(self.sides[node], (shadow <= self.cuts[node] + self.margin, shadow >= self.cuts[node] - self.margin), strict=True):
                    open_.append((side, own[kept]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def leaf_id(above: int, number: np.ndarray) -> np.ndarray:
    """Ids of leaves below one that was split: the same whenever and wherever they are made."""
    x = np.uint64(above & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15) + (np.asarray(number).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(29)) >> np.uint64(1)).astype(np.int64)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """rows: vec_id, v, h1, h2. Distinct vectors: key (a number), h1, h2, v, width, copies, first (smallest vec_id)."""
    one = rows.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return materialise(one.withColumn("width", F.size("v")).withColumn("key", F.monotonically_increasing_id()))


def members_of(distinct: DataFrame, similarity: float, trees: int, seed: int, target: int, number: str) -> DataFrame:
    """Every vector with its leaves: key, vec (components as bytes), copies, width, leaves. Trees are fitted on a sample of
    the vectors of the most frequent width; others start with a leaf a tree for each width."""
    widths = distinct.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, n = (widths[0]["width"], widths[0]["count"]) if widths else (1, 0)
    most = max(LEAST, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = [r.v for r in distinct.where(F.col("width") == width).orderBy("h1", "h2").limit(most).select("v").collect()]
    forest = []
    if n > target:  # fewer are one leaf
        unit = unit_rows(np.array(sample, number))
        forest = [Tree(unit, n, spill(similarity, width), np.random.default_rng([seed, t]), target) for t in range(trees)]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            key, vec, copies, sizes = batch.column(0), batch.column(1), batch.column(2), batch.column(3).to_numpy()
            starts = vec.offsets.to_numpy().astype(np.int64)
            values = vec.values.to_numpy(zero_copy_only=False).astype(number, copy=False)
            leaves: list[list[int]] = [[] for _ in range(len(sizes))]
            own = np.flatnonzero(sizes == width)
            if len(own) and forest:
                rows = unit_rows(values[starts[own][:, None] + np.arange(width)])
                for t, tree in enumerate(forest):
                    for k, leaf in zip(*(x.tolist() for x in tree.leaves_of(rows)), strict=True):
                        leaves[own[k]].append(t << 40 | leaf)
            for k in range(len(sizes)):
                leaves[k] = leaves[k] or [t << 40 | 1 << 39 | int(sizes[k]) for t in range(trees if sizes[k] != width else 1)]
            vec = pa.array([values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([key, vec, copies, pa.array(sizes), pa.array(leaves, pa.list_(pa.int64()))], ["key", "vec", "copies", "width", "leaves"])

    bounded_batches(distinct.sparkSession)
    return materialise(distinct.select("key", "v", "copies", "width").mapInArrow(assign, MEMBER))


def large_leaves(members: DataFrame, most: int) -> DataFrame:
    return materialise(members.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > most))


def entries_of(members: DataFrame, large: DataFrame) -> DataFrame:
    """The vectors of large leaves, once for each: leaf, size, key, vec."""
    return joined_by(members.select("key", "vec", F.explode("leaves").alias("leaf")), large, "leaf")


def modelled(entries: DataFrame, fit, most: int, seed: int, number: str) -> DataFrame:
    """A model (bytes) of each leaf, fitted by fit(leaf, unit vectors, size) on some SAMPLE of its vectors at most."""

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        leaf, size = int(frame["leaf"].iloc[0]), int(frame["size"].iloc[0])
        made = fit(leaf, unit_rows(np.frombuffer(b"".join(frame["vec"]), number).reshape(len(frame), -1)), size)
        return pd.DataFrame({"leaf": [leaf], "model": [pickle.dumps(made)]})

    share = F.lit(float(min(SAMPLE, most))) / F.col("size")
    picked = entries.where(F.pmod(F.xxhash64(F.lit(seed), "leaf", "key"), F.lit(1_000_000)) < share * 1_000_000)
    return materialise(picked.groupBy("leaf").applyInPandas(model, "leaf long, model binary"))


def with_models(entries: DataFrame, models: DataFrame, most: int, use, schema: str, number: str) -> DataFrame:
    """use(leaf, model, keys, unit vectors) of the vectors of each leaf that has a model. A leaf is dealt to tasks of some
    `most` vectors; each reads the model first."""
    parts = F.ceil(F.col("size") / most).cast("long")
    dealt = entries.select("leaf", F.pmod(F.xxhash64("key"), parts).alias("part"), F.lit(1).alias("kind"), "key", "vec")
    sizes = entries.select("leaf", "size").distinct().join(models, "leaf")
    copied = sizes.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("key"), F.col("model").alias("vec"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = None, None
        for batch in batches:
            leaf, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero((leaf[1:] != leaf[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(leaf)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and kind[a] == 0:
                    model, of = pickle.loads(batch.column(4)[a].as_py()), leaf[a]
                elif a < b and of == leaf[a]:
                    rows = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), number).reshape(b - a, -1)
                    yield from use(int(leaf[a]), model, batch.column(3).to_numpy()[a:b], unit_rows(rows))

    return dealt.union(copied).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind").mapInArrow(run, schema)


def split_further(members: DataFrame, similarity: float, seed: int, target: int, most: int, number: str, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """members with leaves of at most `most` vectors where splits make progress, and the leaves that are still larger."""

    def fit(leaf: int, sample: np.ndarray, size: int) -> Tree:
        return Tree(sample, size, spill(similarity, sample.shape[1]), np.random.default_rng([seed, leaf & (1 << 63) - 1]), target)

    def use(leaf: int, tree: Tree, keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, below = tree.leaves_of(rows) if tree.leaves > 1 else (np.arange(len(keys)), None)
        ids = leaf_id(leaf, below) if below is not None else np.full(len(keys), leaf)
        yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(np.full(len(at), leaf)), pa.array(ids)], ["key", "leaf", "below"])

    tried = None
    for _ in range(rounds):
        large = large_leaves(members, most)
        fresh = large if tried is None else large.join(tried, "leaf", "left_anti")
        if fresh.isEmpty():
            break
        fresh = materialise(fresh)
        entries = entries_of(members, fresh)
        models = modelled(entries, fit, SAMPLE, seed, number)
        moved = materialise(with_models(entries, models, most, use, "key long, leaf long, below long", number))
        tried = materialise(fresh.select("leaf") if tried is None else tried.union(fresh.select("leaf")))
        new = moved.groupBy("key").agg(F.collect_set("leaf").alias("old"), F.collect_set("below").alias("new"))  # the leaves of one vector
        joined = members.join(new, "key", "left")
        leaves = F.when(F.col("new").isNull(), F.col("leaves")).otherwise(F.array_union(F.array_except("leaves", "old"), "new"))
        members = materialise(joined.select("key", "vec", "copies", "width", leaves.alias("leaves")))
    return members, large_leaves(members, most)


def in_balls(members: DataFrame, large: DataFrame, similarity: float, seed: int, most: int, number: str, balls: int = 16) -> DataFrame:
    """members with the ball that each vector of a large leaf is counted in, or null: vectors of a ball are within half the
    linking angle of its centre, so each two of them link."""
    near = math.cos(math.acos(similarity) / 2) + 1e-9

    def fit(leaf: int, sample: np.ndarray, size: int) -> np.ndarray:
        centres, left = [], sample
        while len(left) and len(centres) < balls:
            reach = left @ left.T >= near
            middle = left[reach[reach.sum(axis=1).argmax()]].mean(axis=0)
            middle /= max(np.linalg.norm(middle), 1e-300)
            inside = left @ middle >= near
            if inside.sum() < max(8, len(sample) // 64):
                break
            centres.append(middle)
            left = left[~inside]
        return np.array(centres).reshape(-1, sample.shape[1])

    def use(leaf: int, centres: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(centres):
            close = rows @ centres.T
            best = close.argmax(axis=1)
            inside = close[np.arange(len(rows)), best] >= near
            yield pa.RecordBatch.from_arrays([pa.array(keys[inside]), pa.array(leaf_id(leaf, best[inside]))], ["key", "ball"])

    if large.isEmpty():
        return members.withColumn("ball", F.lit(None).cast("long"))
    entries = entries_of(members, large)
    models = modelled(entries, fit, 2048, seed, number)
    found = with_models(entries, models, most, use, "key long, ball long", number).groupBy("key").agg(F.min("ball").alias("ball"))
    return materialise(members.join(found, "key", "left"))


def meetings(members: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """Which vectors a task compares: leaf, lo, hi, block, and the vector. A leaf of at most `most` is one group; a larger
    one is dealt to blocks, those of a ball apart, and each two blocks are a group but for two of one ball."""
    vector = ["key", "vec", "copies", "leaves", "ball"]
    every = members.select(*vector, F.explode("leaves").alias("leaf"))
    if large.isEmpty():
        return every.select("leaf", *(F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "block")), *vector)
    small = joined_by(every, large.select("leaf"), "leaf", "left_anti").select("leaf", *(F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "block")), *vector)
    rest = joined_by(every, large.select("leaf"), "leaf", "left_semi").withColumn("of", F.coalesce("ball", F.lit(-1)))
    n = materialise(rest.groupBy("leaf", "of").agg(F.ceil(2 * F.count("*") / most).cast("long").alias("blocks")))
    name = lambda part: F.xxhash64("leaf", "of", part)
    blocks = n.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("leaf", "of", name("part").alias("block"))
    other = blocks.select("leaf", F.col("of").alias("of2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "leaf").where("block <= block2 AND (of <> of2 OR of = -1)").select("leaf", F.col("block").alias("lo"), F.col("block2").alias("hi"))
    pairs = materialise(pairs)  # of blocks, not of vectors
    places = pairs.select("leaf", "lo", "hi", F.col("lo").alias("block")).union(pairs.where("lo < hi").select("leaf", "lo", "hi", F.col("hi").alias("block")))
    dealt = rest.join(n, ["leaf", "of"]).withColumn("block", name(F.pmod(F.xxhash64("key"), F.col("blocks"))))
    return small.union(dealt.join(places, ["leaf", "block"]).select("leaf", "lo", "hi", "block", *vector))


def similar(unit: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows have the cosine, symmetric; the few within rounding of it are summed again without error."""
    n = len(unit)
    out = np.zeros((n, n), bool)
    for a in range(0, n, 512):
        cosine = unit[a : a + 512] @ unit[a:].T
        out[a : a + 512, a:] = cosine >= similarity
        for i, j in zip(*np.nonzero(np.abs(cosine - similarity) < 1e-13), strict=True):
            out[a + i, a + j] = math.fsum(unit[a + i] * unit[a + j]) >= similarity
    out = np.triu(out, 1)
    return out | out.T


def links_of_group(leaf: int, unit: np.ndarray, copies: np.ndarray, leaves: list, ball: np.ndarray, block: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of the links that are counted in this group: the rows that have any, how many copies each links with, and a spanning
    forest as a row and those reached from it."""
    linked = similar(unit, similarity)
    if len(set(block.tolist())) > 1:
        linked &= block[:, None] != block[None, :]
    for own in _groups(ball, np.arange(len(ball))):
        if ball[own[0]] >= 0:
            linked[np.ix_(own, own)] = False
    rows = np.flatnonzero(linked.any(axis=1))
    linked = linked[np.ix_(rows, rows)]
    if len(rows):
        # pairs that meet in a smaller leaf are counted there
        where = np.repeat(np.arange(len(rows)), [len(leaves[k]) for k in rows])
        ids = np.concatenate([np.asarray(leaves[k]) for k in rows])
        for own in _groups(ids[ids < leaf], where[ids < leaf]):
            linked[np.ix_(own, own)] = False
        kept = linked.any(axis=1)
        rows, linked = rows[kept], linked[np.ix_(kept, kept)]
    counts = np.concatenate([linked[a : a + 512].astype(float) @ copies[rows] for a in range(0, len(rows), 512)]) if len(rows) else np.zeros(0)
    left, forest = np.ones(len(rows), bool), []
    for start in range(len(rows)):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            node = queue.pop()
            reached = np.flatnonzero(linked[node] & left)
            if len(reached):
                left[reached] = False
                forest.append((rows[node], rows[reached]))
                queue.extend(reached.tolist())
    return rows, counts.astype(np.int64), forest


def _groups(values: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each value that two or more have."""
    order = np.argsort(values, kind="stable")
    edges = np.flatnonzero(values[order][1:] != values[order][:-1]) + 1
    for own in np.split(rows[order], edges):
        if len(own) > 1:
            yield own


def compared(groups: DataFrame, similarity: float, number: str) -> DataFrame:
    """groups: as `meetings` gives them. Rows (a, b, n): n links of a, or where b is not null an edge of a link forest."""
    keys = ["leaf", "lo", "hi"]
    values = ["key", "vec", "copies", "leaves", "ball", "leaf", "block"]

    def compare(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = (f.assign(ball=f["ball"].fillna(-1).astype(np.int64)) for f in frames)
        for key, vec, copies, leaves, ball, leaf, block in groups_of(filled, keys, values):
            unit = unit_rows(np.frombuffer(b"".join(vec), number).reshape(len(vec), -1))
            rows, counts, forest = links_of_group(int(leaf[0]), unit, copies, list(leaves), ball, block, similarity)
            if len(rows):
                a = np.concatenate([key[rows], *(np.full(len(to), key[at]) for at, to in forest)])
                b = np.concatenate([np.full(len(rows), -1), *(key[to] for _, to in forest)])
                yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64").astype("Int64"), "n": np.concatenate([counts, np.zeros(len(a) - len(rows), np.int64)])})

    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long, n long")


def near_vectors(embeddings: DataFrame, similarity: float = 0.95, trees: int = TREES, seed: int = 13, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.

    Rows link at a cosine of at least `similarity` in double precision; equal vectors do, and are all counted. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing and are a component of their own, and
    those of different lengths do not link. Repeated rows are rows of their own. A row with a null vec_id links like
    others, is kept never, and gets the smallest vec_id of the others it reaches, null if there is none. No rows, no
    result. Other columns are left out.

    Every link is exact. A pair at the bare similarity is missed by a tree with some 2 % a split in 64 dimensions, closer
    ones far less, and by all trees with less than 0.01 % up to a million vectors; tables of at most `target` vectors are
    compared whole."""
    number = "f8" if embeddings.schema["embedding"].dataType.simpleString() == "array<double>" else "f4"
    valid = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    cast = F.col("embedding").cast("array<double>" if number == "f8" else "array<float>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, cast).alias("v"))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    distinct = distinct_vectors(rows)
    members = members_of(distinct, similarity, trees, seed, target, number)
    members, large = split_further(members, similarity, seed, target, most, number)
    members = in_balls(members, large, similarity, seed, most, number)
    found = materialise(compared(meetings(members, large, most), similarity, number))
    balls = materialise(members.where("ball IS NOT NULL").groupBy("ball").agg(F.sum("copies").alias("inside"), F.min("key").alias("centre")))
    balled = joined_by(members.where("ball IS NOT NULL").select("key", "ball", "copies"), balls, "ball")
    counts = found.where("b = -1").select(F.col("a").alias("key"), "n").union(balled.select("key", F.col("inside") - F.col("copies")))
    edges = found.where("b <> -1").select("a", "b").union(balled.select("key", "centre"))
    component = connected_components(edges).withColumnRenamed("node", "key")
    named = distinct.select("key", "h1", "h2", "copies", "first").join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = named.join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key", "left")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(named.join(least, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = joined_by(rows.where("v IS NOT NULL").select("vec_id", "h1", "h2"), named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle() -> str:
    return """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
w AS MATERIALIZED (SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE ok),
l AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM w a JOIN w b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
