"""Centroid clusters against a plain k-means in whole numbers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quillon.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, whole int, distance long, hash string"
NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, e) for i, e in kept if i is not None)[:k]
    middles = [e for _, _, e in start]
    for step in range(rounds + 1):
        found = []
        for _, e in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(e, m, strict=True)), c) for c, m in enumerate(middles)))
        if step < rounds:
            for c in range(len(middles)):
                own = [e for (_, e), (_, of) in zip(kept, found, strict=True) if of == c]
                if own:
                    middles[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    total = sum(d for d, _ in found)
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], total, hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found, strict=True))


def rows_of(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


def odd(seed=0, n=120):
    draw = np.random.default_rng(seed)
    rows = [(int(i), draw.normal(size=64).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][1]
    rows += [(n + k, same) for k in range(60)]  # a third are copies
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, None), (-4, [0.0] * 64), (-5, [-0.0] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [1.0] * 63 + [math.nan]), (906, [math.inf] + [1.0] * 63)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 3, 4, "x") for i, e in rows], SCHEMA)


def test_odd_vectors(spark):
    assert rows_of(centroids.clusters(frame(spark, odd()))) == plain(odd())


@pytest.mark.parametrize("n", [1, 7, 39])
def test_fewer_vectors_than_centroids(spark, n):
    rows = odd(2, 40)[:n]
    assert rows_of(centroids.clusters(frame(spark, rows))) == plain(rows)


def test_empty_tables_and_only_null_ids(spark):
    assert centroids.clusters(frame(spark, [])).count() == 0
    assert centroids.clusters(frame(spark, [(1, None), (2, [1.0])])).count() == 0
    got = centroids.clusters(frame(spark, [(None, [1.0] * 64), (None, [0.0] * 64)])).collect()
    assert sorted((r.cluster, r.distance) for r in got) == [(0, 0), (1, 0)]


def test_huge_components_are_bounded(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.5] * 64)]
    got = centroids.clusters(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(1, 0), (2, 0), (3, 0)]


def test_search_abandons_no_nearest_centroid():
    draw = np.random.default_rng(5)
    rows, middles = draw.integers(-40, 40, (500, 64)), draw.integers(-40, 40, (40, 64))
    middles[7] = middles[21]  # a tie on every row
    rows[:50] = middles[draw.integers(0, 40, 50)]
    exact = ((rows[:, None] - middles[None]) ** 2).sum(axis=2)
    cluster, distance = centroids.nearest(rows, middles, draw.permutation(64))
    assert np.array_equal(cluster, exact.argmin(axis=1)) and np.array_equal(distance, exact.min(axis=1))


def test_given_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    assert rows_of(centroids.clusters(table)) == plain([(r.vec_id, r.embedding) for r in table.collect()])
