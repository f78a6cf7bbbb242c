"""Exact top-k inner products by MaxScore.

Components become whole numbers, floor(1024 * x). A task holds its vectors in shards by column: a column is the posting
list of its dimension. For a query each dimension's largest possible contribution in the shard is its bound. With the
k-th best score so far as the threshold, the dimensions of smallest bound whose bounds together stay below it are
non-essential: the others' postings are traversed first, and the non-essential ones are probed, largest bound first,
only for vectors that can still reach the threshold. The tasks' best k of each query are merged at the end.

Queries and vectors are both packed into rows of up to SHARD vectors, and one job pairs every row of queries with every
row of vectors: a stated query set against all rows, in blocks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices

SCALE = 1024
#: Vectors and components of a packed row at most, and rows of queries whose best so far a task keeps.
SHARD, CELLS, HELD = 4096, 1 << 18, 4
SCHEMA = "query_id long, vec_id long, score long"


def usable(embedding) -> F.Column:
    """Whether a vector takes part: not null, and no component null, infinite or NaN."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole_numbers(embedding) -> F.Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


class Shard:
    """Vectors by column, with each dimension's smallest and largest component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """best (scores, ids) of the query after this shard; at most k, highest score and then smallest id first."""
        full = len(best[0]) >= k
        threshold = best[0][-1] if full else None
        bound = np.maximum(query * self.low, query * self.high)
        bound = np.maximum(bound, 0)
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        spare = int(np.searchsorted(below, threshold)) if full else 0  # bounds of the first `spare` add up to less than the threshold
        spare = min(spare, len(order))
        rest = int(below[spare - 1]) if spare else 0
        score = query[order[spare:]] @ self.columns[order[spare:]]
        if full:
            at = np.flatnonzero(score + rest >= threshold)
            score = score[at]
            for d in order[:spare][::-1]:
                if not len(at):
                    return best
                rest -= int(bound[d])
                score = score + query[d] * self.columns[d][at]
                near = score + rest >= threshold
                at, score = at[near], score[near]
        else:
            at = np.arange(len(self.ids))
        other = self.ids[at] != query_id
        scores, ids = np.concatenate([best[0], score[other]]), np.concatenate([best[1], self.ids[at][other]])
        top = np.lexsort((ids, -scores))[:k]
        return scores[top], ids[top]


def packed(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id, embedding (whole numbers). Rows of up to SHARD of them: ids and components as bytes, width. A
    shorter vector is filled up with zeros, which add nothing to a score."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SHARD):
            width = max(1, pc.max(pc.list_value_length(batch.column(1))).as_py() or 0)
            for part in slices([batch], max(1, CELLS // width)):
                lengths = pc.list_value_length(part.column(1)).to_numpy()
                rows = np.zeros((part.num_rows, width), np.int64)
                rows[np.arange(width) < lengths[:, None]] = part.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([rows.tobytes()]), pa.array([width], pa.int32())], ["ids", "rows", "width"])

    bounded_batches(vectors.sparkSession)
    return materialise(vectors.mapInArrow(pack, "ids binary, rows binary, width int"))


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Both packed. Each task's best k for each query: query_id, vec_id, score. A task meets a row of queries with one row
    of vectors after the other, and what it has found so far is the threshold for the next."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[bytes, tuple] = OrderedDict()  # by ids of a row of queries: the ids, the vectors, the best of each
        for batch in slices(batches, 1):
            query_ids, queries, query_width, ids, rows, width = (c[0].as_py() for c in batch.columns)
            if query_ids not in held:
                if len(held) == HELD:
                    yield close(held.popitem(last=False)[1])
                own = np.frombuffer(query_ids, np.int64)
                held[query_ids] = (own, np.frombuffer(queries, np.int64).reshape(len(own), query_width), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own))
            held.move_to_end(query_ids)
            own, matrix, best = held[query_ids]
            common = min(width, query_width)  # only the components that both have count
            ids = np.frombuffer(ids, np.int64)
            shard = Shard(ids, np.frombuffer(rows, np.int64).reshape(len(ids), width)[:, :common])
            for n, (q, query) in enumerate(zip(own.tolist(), matrix[:, :common], strict=True)):
                best[n] = shard.search(q, query, k, best[n])
        for block in held.values():
            yield close(block)

    def close(block: tuple) -> pa.RecordBatch:
        own, _, best = block
        n = [len(b[0]) for b in best]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))], ["query_id", "vec_id", "score"])

    both = queries.select(F.col("ids").alias("query_ids"), F.col("rows").alias("queries"), F.col("width").alias("query_width")).crossJoin(vectors)
    return both.select("query_ids", "queries", "query_width", "ids", "rows", "width").mapInArrow(pairs, SCHEMA)


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Queries: the vec_ids divisible by `every`. Per query and rank: query_id, rank, vec_id, score.

    All rows but those with the query's own vec_id are candidates, ties go to the smaller vec_id; repeated rows are
    candidates each. Of a query's repeated rows the smallest vector is the query. Rows with a null vec_id, and vectors
    that are null or hold null or non-finite components, take no part; where lengths differ, only the components that
    both vectors have count; an empty vector scores 0 with all. No queries, no rows. Other columns are left out."""
    vectors = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), whole_numbers(F.col("embedding")).alias("embedding"))
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = search(packed(queries), packed(vectors), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
