"""The nightly build over a small world, held against a plain reading of its neighbours."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon import schemas
from quillon.plans import build_model
from quillon.sources import tables

WORDS = "storm harbour pilot garden ledger winter copper violin canyon market signal orchard".split()


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = random.Random(4)
    shows = []
    for k in range(1, 41):
        shows.append({"id": k, "name": f"Show{k}", "summary": "<p>" + " ".join(r.choice(WORDS) for _ in range(20)) + " war</p>" if k % 7 else "", "premiered": "2001-02-03" if k % 11 else None, "genres": r.sample(["Drama", "Comedy", "Crime"], r.randrange(3)), "type": "Scripted"})
    raw = spark.createDataFrame(shows, schemas.SHOW)
    facets = spark.createDataFrame([(k, f, f"{f}{r.randrange(6)}", 1.0) for k in range(1, 41) for f in ("franchise", "maker", "cast") if r.random() < 0.6], "id long, family string, token string, multiplier double")
    clicks = spark.createDataFrame([(m, a, b, r.randrange(1, 90)) for m in ("2024-01", "2024-02") for a in range(1, 41) for b in range(a + 1, 41) if r.random() < 0.1], schemas.CLICKS)
    root = str(tmp_path_factory.mktemp("model"))
    done = build_model.build(root, raw, facets, clicks, "2010-01-01", ["Drama", "Comedy", "Crime"], [r"\\bwar\\b", r"\\bstorm\\b"], width=6)
    return spark, root, done


def test_every_table_is_published(world):
    spark, root, done = world
    assert set(done) == {"catalogue", "vectors", "facets", "co_interest", "neighbours"}
    assert tables.current(spark, root, "catalogue").count() == 40


def test_neighbours_equal_all_pairs(world):
    spark, root, _ = world
    get = lambda name: tables.current(spark, root, name).collect()
    shows = {r.id: r for r in get("catalogue")}
    text, facet, edges = {}, {}, {(r.a, r.b): r.s for r in get("co_interest")}
    for r in get("vectors"):
        text.setdefault(r.id, {})[r.term] = r.value
    for r in get("facets"):
        facet.setdefault((r.id, r.family), {})[r.token] = r.value
    dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
    bits = lambda x, y: (x & y).bit_count() / math.sqrt(x.bit_count() * y.bit_count()) if x and y else 0.0
    of = lambda i, family: facet.get((i, family), {})
    want = {}
    for i, a in shows.items():
        scored = []
        for j, b in shows.items():
            if i != j and b.recommendable:
                t = dot(text.get(i, {}), text.get(j, {}))
                near = 0.4 * t + 0.35 * bits(a.theme_bits, b.theme_bits) + 0.25 * bits(a.genre_bits, b.genre_bits) + 0.3 * (2.0 * dot(of(i, "franchise"), of(j, "franchise")) + 0.5 * dot(of(i, "maker"), of(j, "maker"))) / 2.5
                bonus = 10 * edges[i, j] ** 0.33 if (i, j) in edges and not set(of(i, "franchise")) & set(of(j, "franchise")) else 0.0
                scored.append((-round(near + 0.3 * bonus, 9), j, t, bonus))
        want[i] = [x for x in sorted(scored) if x[0] < 0][:6]
    got = {}
    for r in sorted(get("neighbours"), key=lambda r: r.rank):
        got.setdefault(r.i, []).append((r.j, r.near, r.text, r.bonus))
    assert sum(map(len, want.values())) > 200
    for i, rows in want.items():
        mine = got.get(i, [])
        assert [j for j, *_ in mine] == [j for _, j, *_ in rows], i
        assert all(abs(n + s) < 1e-8 and abs(t - u) < 1e-9 and abs(b - c) < 1e-9 for (_, n, t, b), (s, _, u, c) in zip(mine, rows))


def test_a_version_that_fails_its_check_is_not_published(world):
    spark, root, done = world
    bad = tables.current(spark, root, "catalogue").withColumn("id", F.lit(1).cast("long"))
    with pytest.raises(ValueError):
        tables.publish(bad, root, "catalogue", [bad.groupBy("id").count().where("count > 1")])
    assert tables.current(spark, root, "catalogue").select("id").distinct().count() == 40
