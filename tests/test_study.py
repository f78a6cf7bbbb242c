"""The study's scores and matrix without a row for every pair."""

from pyspark.sql import functions as F

from quillon.operators import ranking, study, vectors
from quillon.queries import explained
from quillon.queries import ranking as queries


def test_scores_of_vectors_equal_scores_of_pairs(spark):
    rows = spark.range(60).select("id", F.expr("array(1L, 2L, 3L)").alias("cols"), F.expr("array((id % 5) / 9, (id % 4) / 7, (id % 3) / 5)").alias("vals"))
    rows = rows.union(spark.sql("SELECT 99L, array(8L), array(0.5D)"))  # shares nothing with any seed
    seeds = spark.createDataFrame([(10, 1.0), (11, 0.7), (20, 0.35)], "id long, weight double")
    dot = F.expr("aggregate(zip_with(x.vals, y.vals, (p, q) -> p * q), 0D, (s, v) -> s + v)")
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.id <> y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.when(F.expr("x.cols = y.cols"), dot).otherwise(0.0).alias("s"))
    want = {r.id: round(r.score, 9) for r in ranking.study_scores(rows.select("id"), seeds, pairs).collect()}
    got = {r.id: round(r.score, 9) for r in study.scores_of_vectors(rows.select("id"), seeds, rows).collect()}
    assert got == want and got[99] == 0


def test_no_pairs_of_the_catalogue(spark, small, monkeypatch):
    def spelled_out(*_, **__):
        raise AssertionError("every seed with every show")

    monkeypatch.setattr(vectors, "closeness", spelled_out)
    assert queries.study_ranking(spark, small).count() == 196
    assert explained.study_pairs(spark, small).count() > 0
