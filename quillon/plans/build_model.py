"""The nightly build: from raw shows, facts and click counts to the published tables of the model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, checks, cointerest, vectors
from ..sources import tables

#: What a family of facets weighs in closeness.
FACET_WEIGHTS = {"franchise": 2.0, "maker": 0.5}


def build(root: str, shows: DataFrame, facets: DataFrame, clicks: DataFrame, snapshot: str, genres: Sequence[str], themes: Sequence[str], stop: Sequence[str] = (), width: int = 48, months: int = 3) -> dict[str, str]:
    """shows: raw (schemas.SHOW); facets: id, family, token, multiplier; clicks: month, a, b, n. Publishes catalogue,
    vectors, facets, co_interest and neighbours under root, each held against its checks before it becomes current, and
    returns their versions. A later table is built from the published earlier ones."""
    spark = shows.sparkSession
    done = {}
    catalogue = tables.show_records(shows, snapshot, genres, themes)
    done["catalogue"] = tables.publish(catalogue, root, "catalogue", [checks.duplicates(catalogue, ["id"])])
    catalogue = tables.current(spark, root, "catalogue")
    vectors_ = vectors.tf_idf(vectors.terms(catalogue, "id", "summary", stop), "id", catalogue)
    done["vectors"] = tables.publish(vectors_, root, "vectors", [checks.orphans(vectors_, "id", catalogue, "id")])
    values = vectors.facet_values(facets.join(catalogue.select("id"), "id", "left_semi"), "id", catalogue)
    done["facets"] = tables.publish(values, root, "facets", [checks.orphans(values, "id", catalogue, "id"), values.where(~F.col("value").between(0, 1.000001))])
    edges = cointerest.similarity(cointerest.latest_months(clicks, months).groupBy("a", "b").agg(F.sum("n").alias("n")))
    done["co_interest"] = tables.publish(edges, root, "co_interest", [edges.where("a = b or s <= 0 or s > 1")])
    near = neighbours(catalogue, tables.current(spark, root, "vectors"), tables.current(spark, root, "facets"), tables.current(spark, root, "co_interest"), width)
    done["neighbours"] = tables.publish(near, root, "neighbours", [near.where("i = j"), checks.duplicates(near, ["i", "rank"])])
    return done


def neighbours(catalogue: DataFrame, text: DataFrame, facets: DataFrame, edges: DataFrame, width: int = 48) -> DataFrame:
    """i, rank, j, near, text, bonus: the closest recommendable shows of every show. Closeness without readers' links is an
    inner product, compared in blocks of all shows with all recommendable ones; pairs that readers link are scored one by
    one with their bonus, and the better of both lists stay. A pair without a bonus that is among the best of all is among
    the best without any."""
    words = text.select("id", F.col("term").alias("token"), "value")
    cells = tables.materialise(vectors.closeness_cells(catalogue, words, facets, FACET_WEIGHTS))
    rows = vectors.cell_vectors(cells)
    able = catalogue.where("recommendable").select("id")
    near = blocks.nearest(rows, rows.join(able, "id", "left_semi"), width).select("a", "b", F.col("score").alias("near"))
    known, able_b = catalogue.select(F.col("id").alias("a")), able.withColumnRenamed("id", "b")
    bonus = cointerest.bonus(edges, vectors.sharing(edges, facets, "id", "franchise")).select("a", "b", "bonus")
    bonus = tables.materialise(bonus.join(known, "a", "left_semi").join(able_b, "b", "left_semi"))
    read = vectors.pair_closeness(bonus, cells).join(bonus, ["a", "b"]).select("a", "b", (F.col("near") + 0.3 * F.col("bonus")).alias("near"), "bonus")
    both = near.join(bonus, ["a", "b"], "left_anti").withColumn("bonus", F.lit(0.0)).union(read)
    best = vectors.top_neighbours(both, "a", "b", "near", width)
    told = vectors.pair_closeness(best, words.withColumn("kind", F.lit("text"))).withColumnRenamed("near", "text")
    return best.join(told, ["a", "b"]).select(F.col("a").alias("i"), "rank", F.col("b").alias("j"), "near", "text", "bonus")
