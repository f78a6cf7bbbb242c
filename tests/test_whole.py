"""Queries without SQL against plain readings over all ids and users."""

import __spark_entry__ as entry
from quillon.operators import rows, sets


def plain_starter_scores(shows):
    """shows: id -> (type, popularity, tags)."""
    out = {}
    for kind in {k for k, _, _ in shows.values()}:
        mine = [i for i, s in shows.items() if s[0] == kind]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
        mean = {i: sum(jaccard(shows[i][2], shows[k][2]) for k in mine if k != i) / max(1, len(mine) - 1) for i in mine}
        top = max(mean.values()) or 1.0
        for i in mine:
            p = shows[i][1]
            f = (sum(shows[k][1] < p for k in mine) + (sum(shows[k][1] == p for k in mine) + 1) / 2) / len(mine)
            r = mean[i] / top
            out[i] = (kind, 2 * f * r / (f + r) if f + r else 0.0)
    return out


def test_starter_scores_of_all_shows(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_type", "p_name").collect()
    want = plain_starter_scores({r.p_partkey: (r.p_type, r.p_partkey * 37 % 101, frozenset(r.p_name.split(" "))) for r in part})
    got = entry.queries()["starter_scores"](spark, small).collect()
    assert len(got) == len(part) and all(r.type == want[r.id][0] and abs(r.score - want[r.id][1]) < 2e-6 for r in got)
    assert any(r.score for r in got if r.id % 50)


def test_starter_scores_of_odd_groups(spark):
    data = {1: ("a", 5, ["x", "y"]), 2: ("a", 7, ["y", "x"]), 3: ("a", 7, ["z"]), 4: ("a", 9, []), 5: ("b", 1, ["x"]), 6: ("c", 1, []), 7: ("c", 2, []), 8: ("a", 1, ["x", "z", "x"])}
    df = spark.createDataFrame([(i, *v) for i, v in data.items()], "id long, type string, popularity int, tags array<string>")
    got = rows.starter_scores(df.select("id", "type", "popularity"), sets.total_likeness(df, "type", "id", "tags"), "type", "popularity").collect()
    want = plain_starter_scores({i: (k, p, frozenset(t)) for i, (k, p, t) in data.items()})
    assert {r.id: (r.type, round(r.score, 9)) for r in got} == {i: (k, round(s, 9)) for i, (k, s) in want.items()}


def test_interest_clusters_of_all_users(spark, small):
    queries = entry.queries()
    liked = {}
    for r in queries["profile_latest_weight"](spark, small).where("weight > 0").collect():
        liked.setdefault(r.user_id, set()).add(r.id)
    got = {}
    for r in queries["interest_clusters"](spark, small).collect():
        assert r.id not in got.setdefault(r.user_id, {})
        got[r.user_id][r.id] = r.interest
    assert {u: set(c) for u, c in got.items()} == liked and any(u % 50 for u in liked)
    assert all(set(c.values()) == set(range(len(set(c.values())))) for c in got.values())
    near = {(r.a, r.b): r.s for r in queries["co_interest_topk"](spark, small).collect()}
    for user, c in got.items():  # without a link in the list, every show is an interest of its own
        if not any((a, b) in near for a in c for b in c):
            assert len(set(c.values())) == len(c), user
