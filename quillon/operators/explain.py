"""What a pick shares with the list it was picked for, and what the list itself is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_signals(picked: DataFrame, signals: DataFrame, names: tuple[str, ...] = ("themes", "genres")) -> DataFrame:
    """picked: id, because and more; signals: id and an array column per name. Adds each pick's own arrays and, as
    shared_<name>, those values that its source has too, each once and in the pick's order. Unknown shows have empty arrays."""
    none = F.array().cast("array<string>")
    mine = signals.select("id", *(F.col(n) for n in names))
    theirs = signals.select(F.col("id").alias("because"), *(F.col(n).alias(f"_{n}") for n in names))
    j = picked.join(mine, "id", "left").join(theirs, "because", "left")
    own = [F.coalesce(n, none).alias(n) for n in names]
    common = [F.array_intersect(F.coalesce(n, none), F.coalesce(f"_{n}", none)).alias(f"shared_{n}") for n in names]
    return j.select(*picked.columns, *own, *common)


def shown_liked(liked: DataFrame, picked: DataFrame, most: int = 150) -> DataFrame:
    """The liked shows that stand beside a list's picks: user_id, liked (ids in list order). A list of over `most` shows only
    the sources of its picks and then its heaviest, newest first among equals, `most` in all."""
    sources = picked.where("because is not null").select("user_id", F.col("because").alias("id")).distinct().withColumn("is_source", F.lit(True))
    order = Window.partitionBy("user_id").orderBy(F.col("is_source").desc_nulls_last(), F.desc("weight"), F.desc("pos"))
    kept = liked.select("user_id", "id", "pos", "weight").join(sources, ["user_id", "id"], "left").withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= most) | F.col("is_source"))
    return kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("liked"))


def linked_liked(picked: DataFrame, liked: DataFrame, links: DataFrame, most: int = 150) -> DataFrame:
    """picked with liked (see shown_liked) and links: how close the pick is to each of them, in percent. links: a, b, near."""
    shown = shown_liked(liked, picked, most)
    near = picked.select("user_id", "id").join(links.select("a", F.col("b").alias("id"), "near"), "id").join(liked.select("user_id", F.col("id").alias("a")), ["user_id", "a"], "left_semi")
    table = near.groupBy("user_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("a", F.round(F.round(F.col("near") * 100, 6), 1)))).alias("_near"))
    j = picked.join(shown, "user_id", "left").join(table, ["user_id", "id"], "left")
    return j.withColumn("links", F.transform("liked", lambda x: F.coalesce(F.try_element_at("_near", x), F.lit(0.0)))).drop("_near")


def list_features(ratings: DataFrame, pool: DataFrame, items: DataFrame, feature: list[str]) -> DataFrame:
    """Of each list (user_id, id, weight): how many of its liked shows carry a feature (items: id and the feature columns),
    their share, how common it is among the shows the list could still be given (pool: id, less what is rated), both in
    percent, and the lift: user_id, features, count, share, baseline, lift (null where no candidate carries it).

    The pool is counted once and what a list has rated is taken off, so lists never meet the catalogue."""
    size = pool.select("id").distinct().agg(F.count("*").alias("size"))
    common = items.select("id", *feature).distinct()
    base = common.join(pool.select("id").distinct(), "id", "left_semi").groupBy(*feature).agg(F.count("*").alias("base"))
    rated = ratings.join(pool.select("id").distinct().withColumn("in_pool", F.lit(1)), "id", "left").select("user_id", "id", (F.col("weight") > 0).cast("int").alias("is_liked"), F.coalesce("in_pool", F.lit(0)).alias("in_pool"))
    lists = rated.groupBy("user_id").agg(F.sum("is_liked").alias("liked"), F.sum("in_pool").alias("gone"))
    mine = rated.join(common, "id").groupBy("user_id", *feature).agg(F.sum("is_liked").alias("count"), F.sum("in_pool").alias("taken")).where("count > 0")
    j = mine.join(lists, "user_id").join(base, feature, "left").crossJoin(F.broadcast(size))  # one row
    left = F.coalesce(F.try_divide(F.coalesce("base", F.lit(0)) - F.col("taken"), F.col("size") - F.col("gone")), F.lit(0.0))
    share = F.col("count") / F.col("liked")
    tidy = lambda c, k: F.round(F.round(c, 9), k)
    return j.select("user_id", *feature, "count", tidy(share * 100, 0).cast("long").alias("share"), tidy(left * 100, 1).alias("baseline"), tidy(F.try_divide(share, F.when(left > 0, left)), 1).alias("lift"))


def list_context(liked: DataFrame, catalogue: DataFrame, columns: tuple[str, ...] = ("language", "type", "network")) -> DataFrame:
    """user_id, label, value, count, of: the commonest known value of each column among a list's liked shows, ties to the
    larger value, and the number of liked shows; columns no liked show knows have no row."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")
    n = liked.groupBy("user_id").agg(F.count("*").alias("of"))
    each = liked.select("user_id", "id").join(catalogue.select("id", values), "id").where("v.value is not null").groupBy("user_id", "v.label", "v.value").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("value", F.col("n").alias("count")), F.struct("n", "value"))
    return each.groupBy("user_id", "label").agg(best.alias("b")).select("user_id", "label", "b.*").join(n, "user_id")


def penalised(penalty: Column) -> Column:
    """A penalty in percent, one decimal; none is 0."""
    return F.coalesce(F.round(F.round(penalty * 100, 6), 1), F.lit(0.0))
