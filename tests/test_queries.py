"""Registered queries against DuckDB, and the entry points."""

import pytest

import __spark_entry__ as entry
from quillon.queries import all_queries

from .compare import database, difference

WITH_SQL = [q for q in all_queries() if q.sql]
#: One query of each module: the rest are compared by `python -m tests.compare FOLDER`.
SAMPLE = ("html_strip_words", "audit_counts", "spearman_matrix", "co_interest_topk", "facet_idf_normalised", "taste_contributions", "gaps_islands_moving_avg", "as_of_join", "search_tiers_1_4", "rank_single_interest", "explore_insertion", "sitemap_pages", "stream_high_water", "list_features")


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, small, name):
    q = next(q for q in WITH_SQL if q.name == name)
    assert not difference(spark, small, q.run, q.sql, database(small))


def test_names_and_sql_fit(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= len({q.name for q in all_queries()}) == len(all_queries())
    assert entry.entry(spark).columns == ["a", "b", "s", "rank"]


def test_clusters_and_recommendations(spark, small):
    queries = entry.queries()
    picks = queries["recommend"](spark, small).collect()
    assert len({(r.user_id, r.id) for r in picks}) == len(picks) and all(0 < r.score <= 1 and 1 <= r["rank"] <= 24 for r in picks)
    rated = {(r.user_id, r.id) for r in queries["profile_latest_weight"](spark, small).collect()}
    assert not {(r.user_id, r.id) for r in picks} & rated and all((r.user_id, r.because) in rated for r in picks)
