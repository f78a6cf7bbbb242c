"""Near-duplicate vectors against all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from quillon.llm import vector_forest

SCHEMA = "vec_id long, embedding array<float>, label int, key int, leaf int, ball int, v string, copies int"


def plain(rows, similarity=0.95):
    kept = [k for k, (_, e) in enumerate(rows) if e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    n_links, reach = Counter(), {k: {k} for k in range(len(rows))}
    by_width = {}
    for k in kept:
        by_width.setdefault(len(rows[k][1]), []).append(k)
    for own in by_width.values():
        x = np.array([rows[k][1] for k in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= similarity, 1)), strict=True):
            a, b = own[i], own[j]
            n_links[a] += 1
            n_links[b] += 1
            if reach[a] is not reach[b]:
                both = reach[a] | reach[b]
                for k in both:
                    reach[k] = both
    out = Counter()
    for k, (i, _) in enumerate(rows):
        least = min((rows[m][0] for m in reach[k] if rows[m][0] is not None), default=None)
        out[i, n_links[k], least, i is not None and i == least] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 3, 4, "x", 5) for i, e in rows], SCHEMA)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def near(draw, centre, cosine, n):
    """Vectors at the cosine from the centre."""
    centre = centre / np.linalg.norm(centre)
    side = draw.normal(size=(n, len(centre)))
    side -= (side @ centre)[:, None] * centre
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine**2) * side


def family(seed=3, width=64, others=900):
    """Vectors of random directions, pairs about the bare similarity, a group with a centre (a third of all), a chain."""
    draw = np.random.default_rng(seed)
    out = [draw.normal(size=(others, width))]
    for c in (0.94, 0.951, 0.955, 0.97, 0.999):
        out += [near(draw, x, c, 1) * draw.uniform(0.01, 100) for x in out[0][:40]]
    out.append(near(draw, draw.normal(size=width), 0.992, others // 2))  # of one ball
    out.append(near(draw, draw.normal(size=width), 0.975, others // 4))  # in part linked
    step = np.linspace(0, 2, 30)
    chain = np.zeros((30, width))
    chain[:, 0], chain[:, 1] = np.cos(step), np.sin(step)
    rows = np.concatenate([*out, chain, out[0][:5], out[0][:1], out[0][:1]]).astype(np.float32)
    draw.shuffle(rows)
    return [(int(k), x.tolist()) for k, x in enumerate(rows)]


ODD = [
    (1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 63), (5, [1.0] * 64), (6, [2.0] * 64), (6, [2.0] * 64), (None, [3.0] * 64), (None, None), (7, [1.0] * 63 + [None]),
    (8, [1.0] * 63 + [math.nan]), (9, [math.inf] * 64), (10, [3e38] * 64), (11, [1e-40] * 64), (-2, [-1.0] * 64), (12, [1.0]), (13, [5.0]), (14, [-0.0, 1.0]), (15, [0.0, 1.0]), (None, [0.5, -7.0]), (1, None), (16, [1.0] + [0.0] * 63),
]


def test_odd_vectors(spark):
    assert rows_of(vector_forest.near_vectors(frame(spark, ODD))) == plain(ODD)
    assert vector_forest.near_vectors(frame(spark, [])).count() == 0
    assert rows_of(vector_forest.near_vectors(frame(spark, [(3, None), (3, [])]))) == plain([(3, None), (3, [])])


@pytest.mark.parametrize("target, most", [(10_000, 10_000), (200, 600), (100, 120)])
def test_all_pairs(spark, target, most):
    """One leaf; leaves of trees; leaves that are split again, dense groups in balls, and blocks of what is left."""
    rows = family()
    assert rows_of(vector_forest.near_vectors(frame(spark, rows), target=target, most=most)) == plain(rows)


def test_doubles_and_few_dimensions(spark):
    draw = np.random.default_rng(8)
    rows = [(int(k), x.tolist()) for k, x in enumerate(draw.normal(size=(400, 3)).astype(np.float32))]
    got = vector_forest.near_vectors(frame(spark, rows).withColumn("embedding", vector_forest.F.col("embedding").cast("array<double>")), target=60, most=90)
    assert rows_of(got) == plain(rows)


def test_recall_of_one_tree_and_of_all():
    """Pairs at the bare similarity, and closer ones, meet in a leaf of some tree."""
    draw = np.random.default_rng(1)
    base = draw.normal(size=(4000, 64))
    for cosine, least in ((0.95, 0.999), (0.99, 1.0)):
        pairs = np.concatenate([near(draw, x, cosine, 1) for x in base[:1000]])
        unit = vector_forest.unit_rows(np.concatenate([base, pairs]))
        met = np.zeros(1000, bool)
        for t in range(vector_forest.TREES):
            tree = vector_forest.Tree(unit, 400_000, vector_forest.spill(0.95, 64), np.random.default_rng([13, t]), 4000)
            leaves = [set() for _ in unit]
            for k, leaf in zip(*tree.leaves_of(unit), strict=True):
                leaves[k].add(int(leaf))
            met |= [bool(leaves[k] & leaves[4000 + k]) for k in range(1000)]
        assert met.mean() >= least


def test_given_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    assert rows_of(vector_forest.near_vectors(table)) == plain([(r.vec_id, r.embedding) for r in table.collect()])
