"""The trie of conversations that begin alike, as succinct level-order (LOUDS) tries of prefix shards.

A turn is known by 128 bits of hashes of its role and text, a prefix by the exclusive or of its turns' hashes mixed with
their places; a node is a distinct prefix, and its parent's key is its own without the last turn. Conversations are ranked
and keyed by ranges of their turns, so that one conversation of any length has many tasks.

Shards are the largest subtrees of at most `most` turns of distinct conversations. A task reads whole shards in level
order and builds one LOUDS bit vector and arrays of labels of them; parents are read off the bits by rank and select, and
sums go up in reverse level order. Prefixes with more below them are the heavy upper levels: what their shards' tops add to
them is summed by Spark, and they are cut into shards again, until only the root is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, joined_by, materialise, word_count

#: Turns of distinct conversations in a shard at most.
MOST = 1 << 17
KEY = ["depth", "ka", "kb"]


class Louds:
    """A forest in level order: bits (a one for each child of a node, then a zero; first those of the roots) and a label
    of each node."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        self.zeros = np.flatnonzero(~bits)

    @classmethod
    def of(cls, degrees: np.ndarray, roots: int, labels: np.ndarray) -> Louds:
        """From the number of children of each node, in level order."""
        every = np.concatenate([[roots], degrees]).astype(np.int64)
        bits = np.ones(every.sum() + len(every), bool)
        bits[np.cumsum(every) + np.arange(len(every))] = False
        return cls(bits, labels)

    def parents(self) -> np.ndarray:
        """The parent of each node, -1 for roots: the zeros before its one are those of the nodes before its parent."""
        return np.flatnonzero(self.bits) - np.arange(len(self.labels)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(self.zeros) - 1

    def children(self, node: int) -> range:
        """The children of a node, or the roots for -1, which are side by side."""
        start = 0 if node < 0 else int(self.zeros[node]) + 1
        return range(start - node - 1, int(self.zeros[node + 1]) - node - 1)

    def find(self, labels: Iterable) -> int | None:
        """The node that a path of labels from a root leads to."""
        node = -1
        for label in labels:
            below = self.children(node)
            at = np.flatnonzero((self.labels[below.start : below.stop] == label).all(axis=-1))
            if not len(at):
                return None
            node = below.start + int(at[0])
        return node


def level_order(level: np.ndarray, key: np.ndarray, parent_key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a forest by level from their roots, 128-bit key and parent's key. Their order by level, in it by parent and
    key; the number of children of each in that order; the places where levels start and end."""
    n = len(level)
    both = np.concatenate([key, parent_key])
    by = np.lexsort((both[:, 1], both[:, 0]))
    code = np.empty(2 * n, np.int64)
    code[by] = np.concatenate([[0], (both[by][1:] != both[by][:-1]).any(axis=1).cumsum()]) if n else []
    place = np.full(2 * n, -1, np.int64)
    place[code[:n]] = np.arange(n)
    parent = np.where(level > 0, place[code[n:]], -1)
    rank, order, edges, start = np.full(n + 1, -1, np.int64), [], [0], 0
    by_level = np.argsort(level, kind="stable")
    for own in np.split(by_level, np.cumsum(np.bincount(level))[:-1]) if n else []:
        own = own[np.lexsort((code[own], rank[parent[own]]))]  # rank[-1] is that of no parent
        rank[own] = start + np.arange(len(own))
        start += len(own)
        order.append(own)
        edges.append(start)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    degrees = np.bincount(rank[parent[order][parent[order] >= 0]], minlength=n)
    return order, degrees, np.array(edges)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a, b (hashes of role and text), words. Null roles and texts are empty, rows without conv_id go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), word_count(text).alias("words")
    )


def carried(rows: DataFrame, amounts: dict[str, F.Column], how) -> DataFrame:
    """rows: conv_id, _range. Of conversations with rows in several ranges (at most one more than there are ranges) what
    the ranges before each add up to, as columns of the names given."""
    several = rows.groupBy("conv_id").agg(F.min("_range").alias("lo"), F.max("_range").alias("hi")).where("lo < hi").select("conv_id")
    sums = joined_by(rows, materialise(several), "conv_id", "left_semi").groupBy("conv_id", "_range").agg(*(x.alias(n) for n, x in amounts.items()))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(sums.select("conv_id", "_range", *(F.coalesce(how(n).over(before), F.lit(0)).alias(n) for n in amounts)))


def with_carried(rows: DataFrame, before: DataFrame, names: Iterable[str]) -> DataFrame:
    joined = rows.join(F.broadcast(before), ["conv_id", "_range"], "left")  # a row a range at most, and one more
    return joined.select(*rows.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def placed(turns: DataFrame) -> DataFrame:
    """turns with their ranges and places from 1 in their conversations by turn, null first, ties by the hashes: columns
    _range and place. Ranges of turns are sorted apart, so a conversation may have any number of rows."""
    order = ["conv_id", F.asc_nulls_first("turn"), "a", "b"]
    ranged = materialise(turns.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = carried(ranged, {"before": F.count("*")}, F.sum)
    own = F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order[1:]))
    return with_carried(ranged.withColumn("own", own), before, ["before"]).withColumn("place", F.col("before") + F.col("own")).drop("before", "own")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """turns: as `placed` gives them. The rebuilt turns (conv_id, _range, sort, a, b, words), and conv_id of all
    conversations. Conversation c has the first h turns of c - c % every, then its own after the first h, where h is
    crc32(c) % heads; the remainder has the sign of c."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = materialise(turns.groupBy("conv_id").agg(F.min("_range").alias("_range")))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < heads)).select(F.col("conv_id").alias("base"), (F.col("place") - heads).alias("sort"), "place", "a", "b", "words")
    asked = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).where(h > 0)
    head = asked.join(first, "base").where(F.col("place") <= h)
    names = ["conv_id", "_range", "sort", "a", "b", "words"]
    own = turns.where(F.col("place") > h).withColumn("sort", F.col("place"))
    return head.select(*names).union(own.select(*names)), convs.select("conv_id")


def keyed(turns: DataFrame) -> DataFrame:
    """turns: conv_id, _range, sort, a, b, words. Per turn conv_id, its depth from 1, the key of the prefix that ends
    there (ka, kb), that of the prefix before (pa, pb), and words."""
    turns = materialise(turns)
    inside = Window.partitionBy("conv_id", "_range")
    deep = with_carried(turns.withColumn("own", F.row_number().over(inside.orderBy("sort"))), carried(turns, {"before": F.count("*")}, F.sum), ["before"])
    depth = F.col("before") + F.col("own")
    deep = materialise(deep.select("conv_id", "_range", depth.alias("depth"), F.xxhash64(depth, "a", "b").alias("ma"), F.xxhash64(depth, "b", "a").alias("mb"), "words"))
    before = carried(deep, {"xa": F.bit_xor("ma"), "xb": F.bit_xor("mb")}, F.bit_xor)
    upto = inside.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = deep.withColumn("ra", F.bit_xor("ma").over(upto)).withColumn("rb", F.bit_xor("mb").over(upto))
    rows = with_carried(rows, before, ["xa", "xb"]).withColumn("ka", F.col("ra").bitwiseXOR(F.col("xa"))).withColumn("kb", F.col("rb").bitwiseXOR(F.col("xb")))
    return rows.select("conv_id", "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("ma")).alias("pa"), F.col("kb").bitwiseXOR(F.col("mb")).alias("pb"), "words")


def whole_shards(frames: Iterable[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Frames sorted by shard (ta, tb), cut between shards, of some `most` rows where shards allow it."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        while len(frame):
            held.append(frame)
            frame = frame.iloc[:0]
            if sum(map(len, held)) > most:
                rows = pd.concat(held, ignore_index=True)
                ta, tb = rows["ta"].to_numpy(), rows["tb"].to_numpy()
                edge = np.flatnonzero((ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1]))
                held = [rows]
                if len(edge):
                    yield rows.iloc[: edge[-1] + 1]
                    held = [rows.iloc[edge[-1] + 1 :]]
    if held:
        yield pd.concat(held, ignore_index=True)


def forest(rows: pd.DataFrame) -> tuple[pd.DataFrame, Louds, np.ndarray]:
    """rows: nodes of whole shards (ta, tb, top, depth, ka, kb, pa, pb). The rows in level order, their LOUDS forest with
    the keys as labels, and where its levels start and end."""
    level = (rows["depth"] - rows["top"]).to_numpy()
    key, parent = rows[["ka", "kb"]].to_numpy(), rows[["pa", "pb"]].to_numpy()
    order, degrees, edges = level_order(level, key, parent)
    return rows.iloc[order], Louds.of(degrees, int((level == 0).sum()), key[order]), edges


NODE = "depth long, ka long, kb long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, pa long, pb long, is_top boolean"
TRIE = "n_nodes long, n_tops int, louds binary, labels binary, depths binary, n_convs binary"


def rolled_up(rows: pd.DataFrame) -> pd.DataFrame:
    """The shards' nodes with what their subtrees add up to; given_* is what lower shards have added to a node."""
    rows, trie, edges = forest(rows)
    parent, children = trie.parents(), trie.degrees() + rows["given_children"].to_numpy()
    leaves = np.where(children == 0, 1, rows["given_leaves"].to_numpy())
    saved = (rows["n_convs"].to_numpy() - 1) * rows["words"].to_numpy() + rows["given_saved"].to_numpy()
    for lo, hi in zip(edges[-2:0:-1], edges[:1:-1], strict=True):  # from the lowest level to the second
        np.add.at(leaves, parent[lo:hi], leaves[lo:hi])
        np.add.at(saved, parent[lo:hi], saved[lo:hi])
    out = rows[["depth", "ka", "kb", "conv_id"]].assign(parent_conv_id=pd.array(rows["conv_id"].to_numpy()[parent], "Int64"), n_convs=rows["n_convs"], n_children=children, n_leaves=leaves, saved_tokens=saved, pa=rows["pa"], pb=rows["pb"], is_top=parent < 0)
    out.loc[out["is_top"], "parent_conv_id"] = pd.NA
    return out


def packed_trie(rows: pd.DataFrame) -> pd.DataFrame:
    rows, trie, _ = forest(rows)
    arrays = [np.packbits(trie.bits), trie.labels, rows["depth"].to_numpy(), rows["n_convs"].to_numpy()]
    return pd.DataFrame([[len(rows), int((trie.parents() < 0).sum()), *(np.ascontiguousarray(x).tobytes() for x in arrays)]], columns=["n_nodes", "n_tops", "louds", "labels", "depths", "n_convs"])


def by_shard(nodes: DataFrame, make, schema: str, most: int) -> DataFrame:
    def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_shards(frames, most):
            yield make(rows)

    bounded_batches(nodes.sparkSession)
    return nodes.repartition("ta", "tb").sortWithinPartitions("ta", "tb").mapInPandas(build, schema)


def ends_of(rows: DataFrame) -> DataFrame:
    """The last prefix of each conversation: conv_id, depth, ka, kb."""
    return rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("conv_id", "end.*")


def sharded(paths: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """paths: conv_id, last, depth, ka, kb, of distinct sequences. The nodes of shards (key, ta, tb, top), and the paths
    that are left above them."""
    heavy = materialise(paths.groupBy(*KEY).agg(F.sum(F.col("last") - F.col("depth") + 1).alias("below")).where(F.col("below") > most).select(*KEY, F.lit(True).alias("heavy")))
    marked = joined_by(paths, heavy, KEY, "left")
    top = marked.groupBy("conv_id").agg(F.min(F.when(F.col("heavy").isNull(), F.struct(*KEY))).alias("t"))
    light = marked.where("heavy IS NULL").drop("heavy").join(top, "conv_id")
    shards = light.groupBy(*KEY).agg(F.min("t.ka").alias("ta"), F.min("t.kb").alias("tb"), F.min("t.depth").alias("top"))
    return materialise(shards), materialise(marked.where("heavy").drop("heavy", "last"))


def distinct_paths(rows: DataFrame) -> DataFrame:
    """rows: conv_id, depth, ka, kb. Those of one conversation of each distinct sequence, with its last depth."""
    one = ends_of(rows).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("depth").alias("last"))
    return joined_by(rows.select("conv_id", *KEY), materialise(one), "conv_id")


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: conv_id, depth, ka, kb. Per end the sha256 of its conversations' ids, ascending and joined by commas. A task
    reads the ids of an end in order and holds the state of its hash, never the ids."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def rows(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*KEY, "ends_sha256"])

        for batch in batches:
            done, columns = [], [c.to_numpy() for c in batch.columns]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1 if batch.num_rows else []
            edges = [0, *(int(e) for e in change), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                own = tuple(int(c[lo]) for c in columns[:3])
                text = ",".join(map(str, columns[3][lo:hi].tolist()))
                if own == key:
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(text.encode())
            yield rows(done)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    return ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(digest, "depth long, ka long, kb long, ends_sha256 string")


def trie_nodes(rows: DataFrame, convs: DataFrame, most: int = MOST) -> DataFrame:
    """rows: as `keyed` gives them; convs: conv_id of all conversations, those without turns too. Per node: depth, ka, kb,
    conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    nodes = materialise(rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("words").alias("words")))
    n_all, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    parts, zero = [], F.lit(0).cast("long")
    parent = [F.lit(0).cast("long").alias("depth"), zero.alias("ka"), zero.alias("kb")]
    given = spark.createDataFrame([], "depth long, ka long, kb long, given_children long, given_leaves long, given_saved long")
    paths = materialise(distinct_paths(rows))
    while not paths.isEmpty():
        shards, above = sharded(paths, most)
        own = nodes.join(shards, KEY).join(given, KEY, "left").fillna(0, ["given_children", "given_leaves", "given_saved"])
        done = materialise(by_shard(own, rolled_up, NODE, most))
        tops = done.where("is_top").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"), "n_leaves", "saved_tokens")
        added = tops.groupBy(*KEY).agg(F.count("*").alias("given_children"), F.sum("n_leaves").alias("given_leaves"), F.sum("saved_tokens").alias("given_saved"))
        given = materialise(given.union(added).groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("given_children", "given_leaves", "given_saved"))))
        parts.append(done)
        paths = materialise(distinct_paths(above))
    root = convs.limit(0).select(*parent) if not n_all else spark.range(1).select(*parent)
    root = root.join(given, KEY, "left").select(
        *KEY, F.lit(least).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_all).cast("long").alias("n_convs"),
        F.coalesce("given_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("given_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("given_saved", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    # the parents of shards' tops are heavy prefixes and the root
    named = root.select(*KEY, "conv_id").union(joined_by(nodes.select(*KEY, "conv_id"), given.select(*KEY), KEY, "left_semi"))
    named = materialise(named.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("top_parent"), F.lit(True).alias("is_top")))
    out = root
    for done in parts:
        done = joined_by(done, named, ["depth", "pa", "pb", "is_top"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_parent"))
        out = out.union(done.select(*root.columns))
    ends = ends_of(rows)
    turnless = convs.join(ends, "conv_id", "left_anti").select("conv_id", *parent)
    digests = end_digests(ends.union(turnless))
    none = hashlib.sha256(b"").hexdigest()
    return out.join(digests, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))


def tries(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The stored tries of the first cut into shards, one row for some whole shards: n_nodes, n_tops, and as bytes the
    LOUDS bits, labels (two longs a node), depths and n_convs in level order; `opened` reads a row back."""
    nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    shards, _ = sharded(materialise(distinct_paths(rows)), most)
    return by_shard(nodes.join(shards, KEY), packed_trie, TRIE, most)


def opened(row) -> tuple[Louds, np.ndarray, np.ndarray]:
    """The forest of a row of `tries`, its nodes' depths and numbers of conversations."""
    bits = np.unpackbits(np.frombuffer(row.louds, np.uint8), count=2 * row.n_nodes + 1).astype(bool)
    return Louds(bits, np.frombuffer(row.labels, np.int64).reshape(-1, 2)), np.frombuffer(row.depths, np.int64), np.frombuffer(row.n_convs, np.int64)


def prefix_trie(conversations: DataFrame, every: int = 20, heads: int = 4, most: int = MOST) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by a hash of role and text; repeated rows are a turn each. Null and empty
    roles and texts are the same; texts are hashed whole. Rows with a null conv_id take no part. The root has all
    conversations; a table without any has no nodes, not even a root. Other columns are left out."""
    turns = materialise(placed(turn_rows(conversations)))
    own, convs = rebuilt(turns, every, heads)
    rows = materialise(keyed(own))
    out = trie_nodes(rows, materialise(convs), most)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle() -> str:
    crc = "xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT), lambda x, y: list_reduce([xor(x, y)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda u, w: xor(u >> 1, 3988292384::UBIGINT * (u & 1)))), 4294967295::UBIGINT)"
    return f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, ({crc} % 4)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (
  SELECT c.conv_id, p - 100 AS k, r, x FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
  UNION ALL SELECT c.conv_id, p, r, x FROM c JOIN t USING (conv_id) WHERE p > h),
q AS (SELECT conv_id, row_number() OVER w AS d, list(struct_pack(r := r, x := x)) OVER w AS path, x FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS MATERIALIZED (
  SELECT conv_id, d, path, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words FROM q
  UNION ALL SELECT conv_id, 0, CAST([] AS STRUCT(r VARCHAR, x VARCHAR)[]), 0 FROM c),
n AS MATERIALIZED (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY d, path),
ch AS (SELECT a.d, a.path, count(b.d) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.path[1:a.d] = a.path GROUP BY a.d, a.path),
su AS (
  SELECT a.d, a.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
  FROM n a JOIN n b ON b.d >= a.d AND b.path[1:a.d] = a.path JOIN ch ON ch.d = b.d AND ch.path = b.path GROUP BY a.d, a.path),
e AS (SELECT d, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY d, path)
SELECT n.conv_id, n.d AS depth, pn.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN ch ON ch.d = n.d AND ch.path = n.path JOIN su ON su.d = n.d AND su.path = n.path
LEFT JOIN n pn ON pn.d = n.d - 1 AND pn.path = n.path[1:n.d - 1] LEFT JOIN e ON e.d = n.d AND e.path = n.path
"""
