"""What a visitor's browser remembers at each visit: how often shows were seen lately, and which heroes rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_REQUEST = ["user_id", "day", "visit"]


def seen(requests: DataFrame, shown: DataFrame, half_life: float = 7.0, share: float = 0.5, most: int = 300, cap: float = 50.0) -> DataFrame:
    """requests: user_id, day, visit (whole numbers; visit 0: a request without one); shown: user_id, day, visit, id, card,
    hero (booleans: whether the visit showed it as a card, as its hero). user_id, day, visit, id, seen of each request: earlier
    days with the show as a card, each decayed by its age, and for a numbered visit `share` for each of the day's earlier
    numbered visits with the card and once for having been a hero today, two such at most; one decimal, half up, from 0.1
    to `cap`. The `most` best of a request, ties to the smaller id.

    A user's requests meet that user's days, one row a show and day, so repeats within a day never multiply."""
    r = requests.select(*_REQUEST).distinct()
    days = shown.where("card").select("user_id", "id", F.col("day").alias("d")).distinct()
    past = r.join(days, "user_id").where("d < day").select(*_REQUEST, "id", F.pow(F.lit(0.5), (F.col("day") - F.col("d")) / half_life).alias("old"), F.lit(0).alias("card"), F.lit(0).alias("hero"))
    same = shown.groupBy("user_id", "day", F.col("visit").alias("v"), "id").agg(F.max(F.col("card").cast("int")).alias("card"), F.max(F.col("hero").cast("int")).alias("hero"))
    today = r.where("visit > 0").join(same, ["user_id", "day"]).where("v < visit").select(*_REQUEST, "id", F.lit(0.0).alias("old"), F.when(F.col("v") > 0, F.col("card")).otherwise(0).alias("card"), "hero")
    both = past.union(today).groupBy(*_REQUEST, "id").agg((F.sum("old") + share * F.least(F.lit(2), F.sum("card") + F.max("hero"))).alias("seen"))
    both = both.withColumn("seen", F.least(F.floor(F.round(F.col("seen") * 10, 9) + 0.5) / 10, F.lit(cap))).where("seen >= 0.1")
    place = F.row_number().over(Window.partitionBy(*_REQUEST).orderBy(F.desc("seen"), "id"))
    return both.withColumn("_k", place).where(F.col("_k") <= most).drop("_k")


def resting(requests: DataFrame, heroes: DataFrame, rest: int = 7, most: int = 60) -> DataFrame:
    """heroes: user_id, day, visit, id. user_id, day, visit, resting of each request: the first hero of each of the last `rest`
    days, oldest first, then for a numbered visit today's earlier heroes in order; each once, the last `most` of them. No
    heroes, an empty array."""
    r = requests.select(*_REQUEST).distinct()
    h = heroes.select("user_id", F.col("day").alias("d"), F.col("visit").alias("v"), "id").distinct()
    first = h.groupBy("user_id", "d").agg(F.min_by(F.struct("v", "id"), F.struct("v", "id")).alias("h")).select("user_id", "d", "h.*")
    before = r.join(first, "user_id").where(F.col("d").between(F.col("day") - rest, F.col("day") - 1)).select(*_REQUEST, "d", "v", "id")
    today = r.where("visit > 0").join(h, "user_id").where("d = day and v < visit").select(*_REQUEST, "d", "v", "id")
    once = before.union(today).groupBy(*_REQUEST, "id").agg(F.min(F.struct("d", "v")).alias("at"))
    listed = once.groupBy(*_REQUEST).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("every"))
    last = F.slice("every", F.greatest(F.size("every") - most + 1, F.lit(1)), most)
    return r.join(listed, _REQUEST, "left").select(*_REQUEST, F.coalesce(last, F.array().cast("array<bigint>")).alias("resting"))
