"""Checks of a new version before it is published: each returns its violations, so none is the good answer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def rule_violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key, rule of every row that breaks a rule; a rule that is unknown for a row is broken. One pass over df."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def size_shift(before: DataFrame, after: DataFrame, most: float = 0.10) -> DataFrame:
    """One row with both counts if they differ by more than the share."""
    counts = before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after")))
    return counts.where(F.abs(F.col("n_after") - F.col("n_before")) > most * F.col("n_before"))


def min_share(previous: Column, now: Column, share: float = 0.5) -> Column:
    """Whether a new fetch holds enough of what the last one held."""
    return now >= share * F.coalesce(previous, F.lit(0))


def missing_both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def mismatches(df: DataFrame, catalogue: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose key is unknown or whose columns differ from the catalogue's, nulls being equal."""
    c = catalogue.select(F.col(key), F.lit(True).alias("_known"), *(F.col(x).alias(f"_c_{x}") for x in columns))
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"_c_{x}")) for x in columns))
    return df.join(c, key, "left").where(F.col("_known").isNull() | ~same).select(*df.columns)


def missing_months(published: DataFrame, held: DataFrame, keep: int = 3, month: str = "month") -> DataFrame:
    """Of the newest published months those not held."""
    return published.select(month).distinct().orderBy(F.desc(month)).limit(keep).join(held.select(month), month, "left_anti")


def recount_loses(new: DataFrame, held: DataFrame, published: DataFrame, month: str = "month") -> DataFrame:
    """Months that are held and still published, and that a recount would lose: must be empty."""
    return held.select(month).intersect(published.select(month)).exceptAll(new.select(month).distinct())


def latest_valid(versions: DataFrame, component: str, version: str, valid: str) -> DataFrame:
    """For each component its newest valid version: what is carried forward when a build fails."""
    return versions.where(F.col(valid)).groupBy(component).agg(F.max(version).alias(version))


def version_verdict(catalogue: DataFrame, tracks: Mapping[str, DataFrame], snapshot: str, retrieved: str | None = None, previous: int | None = None, most: float = 0.10, key: str = "id") -> DataFrame:
    """check, ok of a whole version: the catalogue is not empty and its ids are unique and known; every track (popularity,
    art and so on, a row a show) has its shows and no others, once each; the snapshot is a date, and that of the manifest;
    and it has about as many shows as the live version (previous; null: none yet)."""
    spark, ids = catalogue.sparkSession, catalogue.select(key)
    n = ids.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct"), F.count(key).alias("known"))
    out = n.select(F.lit("ids").alias("check"), ((F.col("n") > 0) & (F.col("n") == F.col("distinct")) & (F.col("n") == F.col("known"))).alias("ok"))
    for name, track in tracks.items():
        both = ids.withColumn("c", F.lit(1)).join(track.groupBy(key).agg(F.count("*").alias("t")), key, "full")
        out = out.union(both.agg(F.coalesce(F.every(F.coalesce((F.col("c") == 1) & (F.col("t") == 1), F.lit(False))), F.lit(False)).alias("ok")).select(F.lit(name).alias("check"), "ok"))
    date = F.lit(snapshot).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(F.lit(snapshot), F.lit("yyyy-MM-dd")).isNotNull()
    same = F.lit(True) if retrieved is None else F.substring(F.lit(retrieved), 1, 10) == snapshot
    out = out.union(spark.range(1).select(F.lit("date").alias("check"), (date & same).alias("ok")))
    shift = F.lit(True) if not previous else F.abs(F.col("n") - previous) <= most * previous
    return out.union(n.select(F.lit("size").alias("check"), shift.alias("ok")))
