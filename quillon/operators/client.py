"""What a browser works out about a profile: charts, picks shown before, lists kept short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radar(rated: DataFrame, user: str, dimensions: Sequence[str], weight: str = "weight") -> DataFrame:
    """Per dimension column (1, 0 or null for unknown): weighted share over what is known, and the share of the list
    that is known. Unknown everywhere is null, not 0."""
    cells = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("v")) for d in dimensions)))
    long = rated.select(user, F.col(weight).alias("w"), cells.alias("c"))
    known = F.when(F.col("c.v").isNotNull(), F.col("w"))
    return long.groupBy(user, F.col("c.dimension").alias("dimension")).agg(F.try_divide(F.sum(F.col("w") * F.col("c.v")), F.sum(known)).alias("share"), F.try_divide(F.coalesce(F.sum(known), F.lit(0.0)), F.sum("w")).alias("known"))


def spokes(rows: DataFrame, user: str, name: str, you: str = "you", them: str = "them", vs: str = "vs", most: int = 8) -> DataFrame:
    """rows: user, name and three shares of 0 to 100 (null: unknown): the profile's, the title's and the other title's. The
    best `most` names that say something: shared ground first, then what the title records, what the other title records
    in full, and the profile's share. Ties to the name; one per head of a label ('Crime / ...')."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rank = F.when((zero(them) > 0) & (zero(you) >= 25), 400).otherwise(0) + F.when(zero(them) > 0, 200).otherwise(0) + F.when(zero(vs) == 100, 150).otherwise(0) + zero(you)
    said = rows.where((zero(you) != 0) | (zero(them) != 0) | (zero(vs) != 0)).withColumn("_rank", rank).withColumn("_head", F.lower(F.split(name, " / ")[0]))
    first = F.row_number().over(Window.partitionBy(user, "_head").orderBy(F.desc("_rank"), name))
    d = said.withColumn("_k", first).where("_k = 1")
    return d.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("_rank"), name))).where(F.col("place") <= most).drop("_head", "_k", "_rank")


def compared(mine: Column, theirs: Column, dead_band: float = 0.005) -> Column:
    return F.when(mine - theirs > dead_band, "more often").when(theirs - mine > dead_band, "less often").otherwise("about as often")


def similar_choice(chosen: DataFrame, liked: DataFrame, user: str = "user_id", least: int = 2) -> DataFrame:
    """Chosen shows that are still liked, in list order; fewer than `least` are none."""
    kept = chosen.join(liked.select(user, "id", "pos"), [user, "id"])
    n = F.count("*").over(Window.partitionBy(user))
    return kept.withColumn("_n", n).where(F.col("_n") >= least).withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy("pos"))).drop("_n")


def last_shown(shown: DataFrame, wanted: DataFrame, today: Column, user: str = "user_id") -> DataFrame:
    """The latest earlier day on which wanted picks were shown, and how many days ago."""
    past = shown.where(F.col("day") < today).join(wanted.select(user, "id"), [user, "id"], "left_semi")
    return past.groupBy(user).agg(F.max("day").alias("day")).withColumn("days_ago", F.datediff(today, F.col("day")))


def recent_searches(searches: DataFrame, user: str, text: str, ts: str, most: int = 10) -> DataFrame:
    """Newest first, one of each text whatever its case."""
    d = searches.withColumn("_low", F.lower(F.trim(text))).where("_low <> ''").groupBy(user, "_low").agg(F.max_by(text, ts).alias(text), F.max(ts).alias(ts))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), "_low"))).where(F.col("place") <= most).drop("_low")


def crew(credits: DataFrame, show: str, role: str, person: str, order: Sequence[str]) -> DataFrame:
    """People by role, roles in a fixed order and then by name."""
    rank = F.create_map(*(x for k, r in enumerate(order) for x in (F.lit(r), F.lit(k))))
    d = credits.groupBy(show, role).agg(F.array_sort(F.collect_set(person)).alias("people")).withColumn("_o", F.coalesce(F.try_element_at(rank, F.col(role)), F.lit(len(order))))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(show).orderBy("_o", role))).drop("_o")


def links_once(links: DataFrame, show: str, href: str, order: Sequence[str]) -> DataFrame:
    """The first link of each address, without query and fragment."""
    bare = F.regexp_replace(F.col(href), r"[?#].*$", "")
    return links.withColumn("_bare", bare).withColumn("_k", F.row_number().over(Window.partitionBy(show, "_bare").orderBy(*order))).where("_k = 1").drop("_k", "_bare")


def trailers(videos: DataFrame, show: str, most: int = 6) -> DataFrame:
    """videos: show, key, kind, official, published. Trailers first, official first, newest first; one per key."""
    order = [(F.col("kind") != "Trailer").cast("int"), (~F.col("official")).cast("int"), F.desc("published"), F.col("key")]
    d = videos.withColumn("_k", F.row_number().over(Window.partitionBy(show, "key").orderBy(*order))).where("_k = 1")
    return d.withColumn("place", F.row_number().over(Window.partitionBy(show).orderBy(*order))).where(F.col("place") <= most).drop("_k")


def carried(records: DataFrame, catalogue: DataFrame, key: str, fetched: str, now: Column, days: int = 180) -> DataFrame:
    """Records young enough to keep whose key is still in the catalogue."""
    return records.where(F.datediff(now, F.col(fetched)) <= days).join(catalogue.select(key), key, "left_semi")


def warm_list(recent: DataFrame, popular: DataFrame, fresh: DataFrame, key: str, top: int = 200) -> DataFrame:
    """Recent keys and the most popular ones, without those whose record is fresh."""
    best = popular.orderBy(F.desc("popularity"), key).limit(top).select(key)
    return recent.select(key).union(best).distinct().join(fresh.select(key), key, "left_anti")


def suggestions(shared: Column, in_a: Column, in_b: Column, profile_share: Column) -> Column:
    """How much a dimension says in a comparison: shared 3, in either 1, plus the profile's share."""
    return F.when(shared, F.lit(3.0)).when(in_a | in_b, F.lit(1.0)).otherwise(F.lit(0.0)) + profile_share
