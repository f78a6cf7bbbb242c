"""Co-interest: what the same people look at in the same stretch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(links: DataFrame, a: str, b: str, n: str | None = None) -> DataFrame:
    """Unordered pairs a < b with their summed counts; self links go, malformed counts (null) add nothing."""
    amount = F.lit(1) if n is None else F.col(n)
    pairs = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), amount.alias("n"))
    return pairs.groupBy("a", "b").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def basket_pairs(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """Pairs a < b of distinct items that share a basket, with how many baskets they share. Baskets are one person's or one
    visit's items: a basket of k gives k * (k - 1) / 2 pairs by definition, summed up before they are shuffled. The join on
    the basket is split by AQE where one stands out."""
    items = baskets.select(basket, item).distinct()
    pairs = items.select(basket, F.col(item).alias("a")).join(items.select(basket, F.col(item).alias("b")), basket).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def similarity(pairs: DataFrame, top: int | None = 100, places: int = 9) -> DataFrame:
    """pairs: a < b, n. Both directions with s = n / sqrt(total a * total b), the `top` strongest of each a, ties to the
    smaller b; rank from 1."""
    both = pairs.select("a", "b", "n").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    totals = both.groupBy("a").agg(F.sum("n").alias("t"))
    s = both.join(totals.withColumnRenamed("t", "ta"), "a").join(totals.select(F.col("a").alias("b"), F.col("t").alias("tb")), "b")
    s = s.withColumn("s", F.round(F.col("n") / F.sqrt(F.col("ta").cast("double") * F.col("tb")), places))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    ranked = s.withColumn("rank", F.row_number().over(order))
    return (ranked.where(F.col("rank") <= top) if top else ranked).select("a", "b", "s", "rank")


def latest_months(counts: DataFrame, keep: int, month: str = "month") -> DataFrame:
    """The rows of the newest `keep` months. Months are few: they are ranked among themselves and joined back."""
    months = counts.select(month).distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc(month)))).where(F.col("k") <= keep).select(month)
    return counts.join(F.broadcast(months), month, "left_semi")


def bonus(edges: DataFrame, shared: DataFrame, weight: float = 3.0, power: float = 0.33, facets: float = 30.0) -> DataFrame:
    """What a co-interest edge adds to facet closeness; pairs that share a franchise (a, b of `shared`) add nothing."""
    return edges.join(shared.select("a", "b"), ["a", "b"], "left_anti").withColumn("bonus", weight / (facets / 100) * F.pow("s", F.lit(power)))
