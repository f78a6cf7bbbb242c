"""A recommendation works its lists and links out once."""

from quillon.queries import explained, ranking


def test_links_and_lists_are_read_once(spark, small):
    for out in (ranking.recommended(spark, small), explained.recommend_explained(spark, small)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "event_type" not in plan
        assert out.count() > 0
