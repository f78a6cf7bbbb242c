"""Centroid clustering with partial-distance search.

Components become whole numbers, floor(256 * x). Vectors are packed into rows of a written table once; each round is one
job over it. A task assigns its vectors by partial-distance search: squared differences are summed over the dimensions of
highest variance first; whichever centroid looks nearest there is finished, which gives the vector a distance to beat, and
a centroid is abandoned once its partial sum is strictly above it. The survivors finish all dimensions. A round returns
one row of counts and componentwise sums a task, so only k x 64 numbers, whatever the input, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices
from .maxscore import usable

DIMENSIONS, SCALE = 64, 256
#: Whole components end here, so that a squared distance fits a long.
BOUND = 1 << 27
#: Vectors of a packed row, and dimensions after which centroids are abandoned.
BLOCK, STEP = 4096, 8


def nearest(rows: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest centroid (ties: the smaller) and the squared distance to it."""
    n, k = len(rows), len(centroids)
    rows, centroids = rows[:, order], centroids[:, order]
    first = min(STEP, rows.shape[1])
    partial = np.zeros((n, k), np.int64)
    for d in range(first):
        partial += (rows[:, d, None] - centroids[None, :, d]) ** 2
    likely = partial.argmin(axis=1)  # finished first: the distance to beat
    best = partial[np.arange(n), likely] + ((rows[:, first:] - centroids[likely, first:]) ** 2).sum(axis=1)
    at, of = np.nonzero(partial <= best[:, None])
    so_far = partial[at, of]
    for d in range(first, rows.shape[1], STEP):
        so_far = so_far + ((rows[at, d : d + STEP] - centroids[of, d : d + STEP]) ** 2).sum(axis=1)
        left = so_far <= best[at]  # strictly above is abandoned
        at, of, so_far = at[left], of[left], so_far[left]
    # at ascends, and so do the centroids of each row
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, at, so_far)
    tied = so_far == least[at]
    row, place = np.unique(at[tied], return_index=True)
    cluster = np.zeros(n, np.int64)
    cluster[row] = of[tied][place]
    return cluster, least


def packed(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id, whole. Rows of up to BLOCK of them: ids, null_ids, rows (32-bit components), as bytes."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            ids, no_id = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, no_id, rows)], ["ids", "null_ids", "rows"])

    bounded_batches(vectors.sparkSession)
    return materialise(vectors.select("vec_id", "whole").mapInArrow(pack, "ids binary, null_ids binary, rows binary"))


def unpacked(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32).reshape(-1, DIMENSIONS).astype(np.int64)


def dimension_order(blocks: DataFrame) -> np.ndarray:
    """The dimensions, that of highest variance over all vectors first. It decides the work, never the result."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        for batch in batches:
            for value in batch.column(0):
                rows = unpacked(value).astype(float)
                n, one, two = n + len(rows), one + rows.sum(axis=0), two + (rows**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([one.tolist()]), pa.array([two.tolist()])], ["n", "one", "two"])

    parts = blocks.select("rows").mapInArrow(count, "n double, one array<double>, two array<double>")
    each = [F.sum(F.col(c)[d]).alias(f"{c}{d}") for c in ("one", "two") for d in range(DIMENSIONS)]
    r = parts.agg(F.sum("n").alias("n"), *each).first()
    n = max(r.n or 0.0, 1.0)
    variance = [(r[f"two{d}"] or 0.0) / n - ((r[f"one{d}"] or 0.0) / n) ** 2 for d in range(DIMENSIONS)]
    return np.array(sorted(range(DIMENSIONS), key=lambda d: (-variance[d], d)))


def cluster_sums(blocks: DataFrame, centroids: np.ndarray, order: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Of each centroid the number of its vectors and their componentwise sum, exact."""
    k = len(centroids)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
        for batch in batches:
            for value in batch.column(0):
                rows = unpacked(value)
                cluster, _ = nearest(rows, centroids, order)
                sizes += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, rows)
        numbers = np.concatenate([sizes, sums.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers)], ["place", "number"])

    parts = blocks.select("rows").mapInArrow(count, "place int, number long")
    numbers = [0] * (k + k * DIMENSIONS)
    for r in parts.groupBy("place").agg(F.sum(F.col("number").cast("decimal(38,0)")).alias("number")).collect():  # k x 65 rows
        numbers[r.place] = int(r.number)
    return numbers[:k], [numbers[k + c * DIMENSIONS : k + (c + 1) * DIMENSIONS] for c in range(k)]


def assigned(blocks: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """Per vector: vec_id, cluster, distance."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, no_id, value in zip(*batch.columns, strict=True):
                cluster, distance = nearest(unpacked(value), centroids, order)
                ids = pa.array(np.frombuffer(ids.as_buffer(), np.int64), mask=np.frombuffer(no_id.as_buffer(), np.bool_))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return blocks.select("ids", "null_ids", "rows").mapInArrow(assign, "vec_id long, cluster int, distance long")


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, whole: the vectors of 64 finite components, as whole numbers."""
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))
    kept = embeddings.where((F.size("embedding") == DIMENSIONS) & usable(F.col("embedding")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("whole"))


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Per vector of 64 finite components: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest sha256 of `seed:vec_id`; fewer vectors make fewer centroids. Rows
    with a null vec_id are clustered, but start none. Repeated rows count each, and may start a centroid each: then the
    ties between these go to the smaller number. Components beyond 2^27 steps of 1/256 count as that many. Sums of
    distances beyond a long are null. No vectors, no rows. Other columns are left out."""
    vectors = kept_vectors(embeddings)
    blocks = packed(vectors)
    starts = vectors.where("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = starts.orderBy("hash", "vec_id", "whole").limit(k).select("whole").collect()  # k rows
    centroids = np.array([r.whole for r in first], np.int64).reshape(-1, DIMENSIONS)
    if not len(centroids):  # none has an id: the smallest vectors start
        centroids = np.array([r.whole for r in vectors.orderBy("whole").limit(k).select("whole").collect()], np.int64).reshape(-1, DIMENSIONS)
    spark = embeddings.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order = dimension_order(blocks)
    for _ in range(rounds):
        sizes, sums = cluster_sums(blocks, centroids, order)
        centroids = np.array([[s // n for s in total] if n else own for n, total, own in zip(sizes, sums, centroids.tolist(), strict=True)], np.int64)
    found = materialise(assigned(blocks, centroids, order))
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # at most k rows
    total, long = sum(int(r.n) for r in inertia), lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(r.cluster, long(int(r.n)), long(total), digest[r.cluster]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT r, v.vec_id, v.e, c.c, {distance} AS d FROM v CROSS JOIN c{r} c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT r, vec_id, e, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if r < rounds:
            steps.append(f"""x{r} AS (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}),
s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM x{r} GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, o.e) AS e FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id, e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k}),
{', '.join(steps)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""
