"""Browser memory replayed visit by visit, monthly counts with a file that is missing at first, and interests by definition."""

import math
import os
from collections import defaultdict

from pyspark.sql import functions as F

from quillon.operators import memory, ranking
from quillon.queries import ranking as queries
from quillon.sources import months

SHOWN = [  # user, day, visit, id, card, hero
    (1, 0, 1, 5, True, False), (1, 0, 2, 5, True, False), (1, 3, 0, 5, True, True), (1, 3, 0, 6, True, False), (1, 3, 1, 5, True, False), (1, 3, 1, 7, False, True), (1, 3, 2, 5, True, False), (1, 3, 2, 6, True, True),
    (1, 3, 3, 8, True, False), (1, 10, 1, 5, True, True), (1, 10, 1, 9, True, False), (1, 11, 1, 9, True, True), (1, 40, 1, 6, True, True), (2, 3, 1, 5, True, True), (2, 3, 4, 6, True, True), (2, 4, 1, 6, True, False),
]


def replay(rows):
    """What a browser holds, noted after each visit."""
    days, today, heroes, out = defaultdict(list), {}, defaultdict(list), {}
    for day, visit in sorted({(r[1], r[2]) for r in rows}):
        featured = set(heroes[day]) if visit else set()
        seen = {}
        for i in set(days) | featured:
            n = sum(0.5 ** ((day - d) / 7) for d in days[i] if d < day)
            if visit:
                n += 0.5 * min(2, len([v for v in today.get((i, day), ()) if 0 < v < visit]) + (i in featured))
            n = math.floor(round(n * 10, 9) + 0.5) / 10
            if n >= 0.1:
                seen[i] = min(n, 50)
        rest = [heroes[d][0] for d in sorted(heroes) if day - 7 <= d < day and heroes[d]] + (heroes[day] if visit else [])
        out[day, visit] = seen, list(dict.fromkeys(rest))
        for _, _, _, i, card, hero in sorted(r for r in rows if r[1:3] == (day, visit)):
            if card:
                days[i] += [day] if day not in days[i] else []
                today.setdefault((i, day), []).append(visit)
            if hero and i not in heroes[day]:
                heroes[day].append(i)
    return out


def test_memory_of_visits(spark):
    shown = spark.createDataFrame(SHOWN, "user_id long, day int, visit int, id long, card boolean, hero boolean")
    got, rest = defaultdict(dict), {}
    for r in memory.seen(shown, shown.union(shown)).collect():
        got[r.user_id, r.day, r.visit][r.id] = r.seen
    for r in memory.resting(shown, shown.where("hero")).collect():
        rest[r.user_id, r.day, r.visit] = r.resting
    for user in (1, 2):
        for (day, visit), (seen, heroes) in replay([r for r in SHOWN if r[0] == user]).items():
            assert (got.get((user, day, visit), {}), rest[user, day, visit]) == (seen, heroes), (user, day, visit)
    assert [r.id for r in memory.seen(shown.where("user_id = 1 and day = 10"), shown, most=1).collect()] == [5]
    assert [r.resting for r in memory.resting(shown.where("user_id = 1 and day = 11"), shown.where("hero"), most=1).collect()] == [[5]]
    assert memory.seen(shown, shown.limit(0)).count() == 0


def test_months_are_counted_once_and_tried_again(spark, tmp_path):
    for m, lines in {"2024-01": "A\tB\tlink\t3\nA\tB\texternal\t90\nB\tA\tlink\t4\nA\tZ\tlink\t9\n", "2024-02": "A\tC\tlink\tx\nA\tB\tlink\t5\n", "2024-03": "C\tB\tlink\t1\n", "2024-04": "A\tC\tlink\t2\n"}.items():
        (tmp_path / f"{m}.tsv").write_text(lines)
    titles = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "title string, id long")
    file, root = lambda m: f"{tmp_path}/{m}.tsv", f"{tmp_path}/store"
    every = lambda: sorted(tuple(r) for r in months.counts(spark, root).collect())
    assert every() == [] and months.held(spark, root) == []
    assert months.add_months(spark, root, {"2024-01": file("2024-01"), "2024-02": file("none")}, titles) == [("2024-01", "counted"), ("2024-02", "skipped")]
    assert every() == [("2024-01", 1, 2, 7)]
    os.remove(file("2024-01"))
    assert months.add_months(spark, root, {m: file(m) for m in ("2024-01", "2024-02", "2024-03")}, titles) == [("2024-01", "held"), ("2024-02", "counted"), ("2024-03", "counted")]
    assert every() == [("2024-01", 1, 2, 7), ("2024-02", 1, 2, 5), ("2024-03", 2, 3, 1)]
    assert months.add_months(spark, root, {m: file(m) for m in ("2024-03", "2024-04")}, titles) == [("2024-03", "held"), ("2024-04", "counted")]
    assert [r[0] for r in every()] == ["2024-02", "2024-03", "2024-04"]
    (tmp_path / "2024-04.tsv").write_text("A\tC\tlink\t8\n")
    assert months.add_months(spark, root, {"2024-04": file("2024-04")}, titles, again=True) == [("2024-04", "counted")]
    assert every()[-1] == ("2024-04", 1, 3, 8)


def test_interests_by_definition(spark, small):
    """Average linkage read plainly: the mean of all links between two groups, from scratch in every step."""
    liked = defaultdict(list)
    for r in queries.ratings(spark, small).where("weight > 0").orderBy("user_id", "pos").collect():
        liked[r.user_id].append(r)
    ids = sorted({r.id for x in liked.values() for r in x})
    near = {(a, b): (a * 7 + b * 3) % 19 / 60 for a in ids for b in ids if a != b and (a + b) % 3}
    links = spark.createDataFrame([(*k, v) for k, v in near.items()], "a long, b long, near double")
    got = defaultdict(dict)
    for r in ranking.interests(spark.createDataFrame([(r.user_id, r.pos, r.id, r.weight) for x in liked.values() for r in x], "user_id long, pos long, id long, weight double"), links).collect():
        got[r.user_id][r.id] = r.interest
    several = 0
    for user, shows in liked.items():
        assert len(shows) <= 150
        groups = [[r] for r in shows]
        mean = lambda x, y: math.fsum((near.get((a.id, b.id), 0.0) + near.get((b.id, a.id), 0.0)) / 2 for a in x for b in y) / (len(x) * len(y))
        while len(groups) > 1:
            best, i, j = max(((round(mean(groups[i], groups[j]), 12), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
            if best < ranking.JOIN:
                break
            groups[-i] = groups[-i] + groups[-j]
            del groups[-j]
        groups = [sorted(g, key=lambda r: r.pos) for g in groups]
        groups.sort(key=lambda g: (-round(sum(r.weight for r in g), 9), g[0].pos))
        assert got[user] == {r.id: n for n, g in enumerate(groups) for r in g}
        several += any(len(g) > 1 for g in groups)
    assert several and set(got) == set(liked)
