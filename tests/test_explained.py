"""Explained picks, the study's report, spread over several groups and moments, against plain readings."""

import hashlib
import math
from collections import Counter
from datetime import datetime, timezone
from statistics import NormalDist

import __spark_entry__ as entry
from pyspark.sql import functions as F

from quillon.functions.dates import parse_moment
from quillon.operators import explain, ranking, study

ITEMS = [
    ("l", 1, 11, ["a", "x"]), ("l", 2, 12, ["a", "y"]), ("l", 3, 13, ["a", "x", "x"]), ("l", 4, 14, []), ("l", 5, 15, ["y", None]), ("l", 6, 16, ["b"]), ("l", 7, 17, ["a", "b"]),
    ("l", 8, 18, None), ("l", 9, 19, ["x", "y", "b"]), ("l", 10, 20, ["c"]), ("m", 1, 11, ["a"]), ("m", 2, 12, ["a"]), ("m", 3, 13, ["a"]), ("m", 4, 14, ["z"]),
]


def spread_plain(items, keep):
    """The list is walked in order; what came before is counted."""
    seen, keyed = Counter(), []
    for rank, key, groups in sorted(items):
        groups = {g for g in groups or () if g is not None}
        weight = min((0.75 * 0.5 ** seen[g] + 0.25 for g in groups), default=1.0)
        seen.update(groups)
        keyed.append(((0, rank) if rank <= keep else (1, round(math.log(rank) - math.log(weight), 9)), rank, key))
    return [key for *_, key in sorted(keyed)]


def test_spread_over_groups(spark):
    df = spark.createDataFrame(ITEMS, "list string, rank int, id long, groups array<string>")
    for keep in (0, 3):
        got = ranking.spread_groups(df, "list", "rank", "id", F.col("groups"), keep).collect()
        for name in ("l", "m"):
            mine = [r.id for r in sorted((r for r in got if r.list == name), key=lambda r: r.place)]
            assert mine == spread_plain([(r, k, g) for n, r, k, g in ITEMS if n == name], keep)
    assert ranking.spread_groups(df.limit(0), "list", "rank", "id", F.col("groups")).count() == 0


def test_moments(spark):
    texts = [
        "2024-02-29T12:30:45Z", "2024-02-29 12:30:45.5+02:00", "20240229T123045", "2024-02-29T12:30", "2024-02-29T12", "2024-02-29", "20240229", "2024-02-29T12:30:45,1234567", "2024-02-29T12:30:45-05:30:15",
        "2024-02-29T123045.25+0130", "2023-02-29", "2024-02-29T25:00", "2024-02-29T12:61", "2024-13-01", "yesterday", "", "2024-0229", "2024-02-29T12:3045", "2024-02-29T12:30:45Z and", " 2024-02-29", "2024-02-29T12:30:45.", None,
    ]

    def plain(x):
        try:
            m = datetime.fromisoformat(x.replace("Z", "+00:00"))
        except (AttributeError, ValueError):
            return None
        m = m if m.tzinfo else m.replace(tzinfo=timezone.utc)
        return (m - datetime(1970, 1, 1, tzinfo=timezone.utc)) // (datetime.resolution)

    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    got = {r.k: r.m for r in df.select("k", F.unix_micros(parse_moment(F.col("x"))).alias("m")).collect()}
    for k, x in enumerate(texts):
        assert got[k] == plain(x), x


def test_visit_deviates(spark, small):
    events = {r.event_id: r for r in spark.read.parquet(f"{small}/events.parquet").collect()}
    z = lambda seed, e: NormalDist().inv_cdf((int.from_bytes(hashlib.blake2b(f"{seed}|row|{e}".encode(), digest_size=8).digest(), "big") + 0.5) / 2**64)
    got = entry.queries()["visit_deviates"](spark, small).collect()
    assert len(got) == len(events)
    for r in got:
        e = events[r.event_id]
        want = 0.0 if e.event_id % 5 == 0 else z(e.user_id, e.event_id) if e.event_id % 3 == 0 else math.sqrt(0.65) * z(e.user_id, e.event_id) + math.sqrt(0.35) * z(e.event_type, e.event_id)
        assert abs(r.z - want) < 1e-9


def test_long_lists_show_sources_and_the_heaviest(spark):
    liked = spark.createDataFrame([(1, i, i, 0.7 if i % 4 else 1.0) for i in range(20)] + [(2, 3, 0, 1.0)], "user_id long, id long, pos long, weight double")
    picked = spark.createDataFrame([(1, 100, 1), (1, 101, 6), (2, 100, None)], "user_id long, id long, because long")
    got = {r.user_id: r.liked for r in explain.shown_liked(liked, picked, most=6).collect()}
    assert got == {1: [1, 4, 6, 8, 12, 16], 2: [3]}
    links = spark.createDataFrame([(6, 100, 0.25), (3, 100, 0.5), (7, 101, 0.9)], "a long, b long, near double")
    rows = {(r.user_id, r.id): r for r in explain.linked_liked(picked, liked, links, most=6).collect()}
    assert rows[1, 100].links == [0.0, 0.0, 25.0, 0.0, 0.0, 0.0] and rows[1, 101].links == [0.0] * 6 and rows[2, 100].links == [50.0]


def test_features_of_lists(spark):
    """Features by sets; a list without likes has no row, a feature that no candidate carries no lift."""
    ratings = [(1, 1, 1.0), (1, 2, 0.7), (1, 3, -1.0), (2, 4, -1.0), (3, 5, 1.0)]
    items = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "c"), (6, "a"), (7, "b"), (8, "d"), (1, "a")]
    pool = {1, 3, 4, 6, 7, 8}
    got = {(r.user_id, r.name): (r["count"], r.share, r.baseline, r.lift) for r in explain.list_features(spark.createDataFrame(ratings, "user_id long, id long, weight double"), spark.createDataFrame([(i,) for i in pool], "id long"), spark.createDataFrame(items, "id long, name string"), ["name"]).collect()}
    want = {}
    for user in (1, 2, 3):
        liked, rated = {i for u, i, w in ratings if u == user and w > 0}, {i for u, i, _ in ratings if u == user}
        left = pool - rated
        for name in {n for i, n in items if i in liked}:
            has = {i for i, n in items if n == name}
            share, base = len(has & liked) / len(liked), len(has & left) / len(left)
            want[user, name] = (len(has & liked), round(share * 100), round(base * 100 + 1e-9, 1), round(share / base + 1e-9, 1) if base else None)
    assert got == want


def test_study_report(spark):
    seeds = [(1, 0, 1.0), (2, 1, 0.7), (3, 2, -1.0)]
    near = {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (1, 2): 0.5, (2, 1): 0.5, (1, 10): 0.4, (2, 10): 0.4, (3, 10): 0.1, (1, 11): 0.2, (3, 11): 0.9, (2, 12): 1.3, (1, 13): 0.4, (2, 13): 0.4, (3, 13): 0.1}
    s, a = spark.createDataFrame(seeds, "id long, pos long, weight double"), spark.createDataFrame([(x, y, v) for (x, y), v in near.items()], "a long, b long, s double")
    candidates = spark.createDataFrame([(i,) for i in (1, 10, 11, 12, 13, 14)], "id long")
    of = lambda x, b: min(1.0, near.get((x, b), 0.0))

    def plain(b):
        average, best = (of(1, b) + 0.7 * of(2, b)) / 1.7, max(of(1, b), 0.7 * of(2, b))
        penalty = 0.35 * of(3, b)
        return [round(100 * x, 2) for x in (max(0.0, 0.7 * average + 0.3 * best - penalty), average, of(2, b), penalty)]

    got = {r.id: r for r in study.points(candidates, s, study.measures(s, a, axis_y=2), most=2).collect()}
    assert {i: r.rank for i, r in got.items()} == {1: None, 2: None, 12: 1, 10: 2}  # 10 and 13 are equal
    for i, r in got.items():
        assert [r.score, r.x, r.y, r.penalty] == plain(i)
    assert (got[10].nearest, got[10].nearest_other, got[1].nearest, got[1].nearest_other, got[12].nearest) == (1, 1, 1, 2, 2)
    assert {(r.a, r.b): r.percent for r in study.pair_matrix(s, a, 2).collect()} == {(1, 1): 100.0, (1, 2): 50.0, (2, 1): 50.0, (2, 2): 100.0}
    assert study.measures(s.where("weight < 0"), a).count() == 0
