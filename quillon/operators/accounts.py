"""Account state: revisions, tombstones, saved lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def removals_since(tombstones: DataFrame, since: int, owner: str = "account_id") -> DataFrame:
    """What was removed after a revision, in that order."""
    return tombstones.where(F.col("revision") > since).withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy("revision", "key")))


def optimistic_save(stored: DataFrame, changes: DataFrame, owner: str = "account_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """stored: owner, key, value, revision (of the account); changes: owner, key, value, base (the revision the client
    saw). Returns the new state (changed accounts replaced as a whole, their revision one higher), the new tombstones
    (owner, key, revision) and the refused accounts, whose base is not the stored revision."""
    revisions = stored.groupBy(owner).agg(F.max("revision").alias("revision"))
    asked = changes.groupBy(owner).agg(F.max("base").alias("base"))
    judged = asked.join(revisions, owner, "left").withColumn("revision", F.coalesce("revision", F.lit(0).cast("long"))).withColumn("ok", F.col("base") == F.col("revision"))
    accepted = judged.where("ok").select(owner, (F.col("revision") + 1).alias("new_revision"))
    fresh = changes.join(accepted, owner).select(owner, "key", "value", F.col("new_revision").alias("revision"))
    state = stored.join(accepted.select(owner), owner, "left_anti").select(owner, "key", "value", "revision").union(fresh)
    gone = stored.join(accepted, owner).join(changes.select(owner, "key"), [owner, "key"], "left_anti").select(owner, "key", F.col("new_revision").alias("revision"))
    return state, gone, judged.where(~F.col("ok")).select(owner, "base", "revision")


def compacted(preferences: DataFrame, owner: str, key: str, weight: str, position: str, allowed: Sequence[float] = (-1.0, 0.0, 0.35, 0.7, 1.0), most: int = 3000) -> DataFrame:
    """One row per item, the first; only allowed weights; at most `most` of an account."""
    valid = preferences.where(F.col(weight).isin(*allowed) & (F.col(key) > 0))
    first = valid.groupBy(owner, key).agg(F.min_by(weight, position).alias(weight), F.min(position).alias(position))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(position, key))).where(F.col("place") <= most).select(owner, "place", key, weight)


def pending(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Asked keys that are not held yet."""
    return asked.select(key).distinct().join(held.select(key), key, "left_anti")


def expired(rows: DataFrame, fetched: str, now, ended: str, days: int = 180, ended_days: int = 30) -> DataFrame:
    """Rows past their time to live: shorter for one kind."""
    limit = F.when(F.col(ended), F.lit(ended_days)).otherwise(F.lit(days))
    return rows.where(F.datediff(now, F.col(fetched)) > limit)
