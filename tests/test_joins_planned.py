"""What Spark sends to every executor: of titles and attributes nothing, however small their files let them look."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import rows, search
from quillon.plans.stand_ins import attributes, ratings, shows
from quillon.queries import lists, titles


def broadcast(df) -> list[str]:
    """The subtrees that the plan broadcasts."""
    plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+|*-]*", line)[0])
    out = []
    for k, line in enumerate(plan):
        if re.search(r"BroadcastHashJoin|BroadcastNestedLoopJoin", line):
            below = []
            for x in plan[k + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            tops = [n for n, x in enumerate(below) if depth(x) == depth(below[0])]
            sides = ["\n".join(below[: tops[1]]), "\n".join(below[tops[1] :])] if len(tops) > 1 else ["\n".join(below)]
            out.append(sides[0] if "BuildLeft" in line else sides[-1])
    return out


@pytest.mark.parametrize("tier", ["exact", "prefix", "words", "inside", "initials"])
def test_titles_are_not_broadcast(spark, small, tier):
    lines = titles.lines(spark, small)
    marked = lines.withColumn("alias", F.col("alias") & F.lit(True))
    found = getattr(search, f"tier_{tier}")(titles.prepared(spark), marked)
    sides = broadcast(found)
    assert sides and not any(re.search(r"\bline#", s) for s in sides if "qword" not in s and "query" not in s), sides


def test_first_tiers_joins_titles_by_merge(spark, small):
    q, t = titles.prepared(spark), titles.lines(spark, small)
    assert not [s for s in broadcast(search.first_tiers([search.tier_exact(q, t)], titles.titles(spark, small))) if "parquet" in s]


def test_attributes_are_not_broadcast(spark, small):
    of = attributes(shows(spark, small))
    out = rows.insights(ratings(spark, small), of, lists.reference(spark, small))
    assert not any("Generate" in s and "Aggregate" not in s for s in broadcast(out))
    assert not any("Generate" in s and "Filter" not in s for s in broadcast(lists.spoke_choice(spark, small)))
