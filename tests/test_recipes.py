"""Frequent combinations against counting all of them."""

import random
from collections import Counter
from itertools import product

from quillon.operators import recipes


def plain(parts, members, least):
    of = {}
    for k, role, words in set(parts):
        if words is not None:
            of.setdefault(k, {}).setdefault(role, []).append(words)
    found = Counter()
    for group, k in set(members):
        own = of.get(k, {})
        for combination in product(own.get("core", []), *([None, *own.get(r, [])] for r in recipes.ROLES[1:])):
            found[group, *combination] += 1
    return {c: n for c, n in found.items() if n >= least}


def test_frequent_combinations(spark):
    r = random.Random(2)
    words = {"core": ["noir", "crime", "opera"], "form": ["dramas", "films"], "place": ["Nordic", "Korean", "French"], "adjective": ["dark", "slow"], "era": ["1980s", "1990s"]}
    parts = [(k, role, w) for k in range(60) for role, ws in words.items() for w in r.sample(ws, r.choice([0, 1, 1, 1, 2]))]
    parts += parts[:20] + [(3, "core", None), (5, "other", "x")]
    members = [(g, k) for g in "abc" for k in r.sample(range(70), 25)] + [("a", 1), ("a", 1)]
    p = spark.createDataFrame(parts, "id long, role string, words string")
    m = spark.createDataFrame(members, "interest string, id long")
    for least in (1, 2, 4):
        got = {(x.interest, *(x[role] for role in recipes.ROLES)): x.support for x in recipes.frequent(m.distinct().join(p, "id"), "interest", "id", least).collect()}
        assert got == plain([x for x in parts if x[1] in recipes.ROLES], members, least)
    every = plain([x for x in parts if x[1] in recipes.ROLES], [("all", k) for k in range(60)], 1)
    wanted = spark.createDataFrame([c[1:] for c in every][::3], ", ".join(f"{r} string" for r in recipes.ROLES))
    held = {tuple(x[role] for role in recipes.ROLES): x.shows for x in recipes.held_by(p, "id", wanted).collect()}
    assert held == {c[1:]: every[c] for c in list(every)[::3]}
    assert recipes.recipes(m.limit(0), p, 60).count() == 0 and recipes.recipes(m, p.limit(0), 60).count() == 0
