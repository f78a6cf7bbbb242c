"""Runs, sessions, episodes and other ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each group from 1; a row where `breaks` holds starts one."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(w) + 1)


def moving_average(df: DataFrame, group: Sequence[str], season: str, number: str, value: str, reach: int = 2) -> DataFrame:
    """A centred average of 2 * reach + 1 rows, cut at the ends of runs; a run breaks where the season changes, a number
    is missing or the value is unknown. Rows without a value have no average."""
    d = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*group).orderBy(season, number)
    breaks = (F.lag(season).over(w) != F.col(season)) | (F.col(number) - F.lag(number).over(w) != 1)
    runs = islands(d, group, [season, number], breaks)
    around = Window.partitionBy(*group, "run").orderBy(number).rowsBetween(-reach, reach)
    return runs.withColumn("smooth", F.avg(value).over(around))


def grid(df: DataFrame, rows: Sequence[str], column: str, value: str, size: int) -> DataFrame:
    """A row per group, a column for each number from 1 to size: the fixed list spares the pivot a pass for its values."""
    return df.groupBy(*rows).pivot(column, list(range(1, size + 1))).agg(F.first(value, ignorenulls=True))


def watched_through(episodes: DataFrame, group: Sequence[str], order: Sequence[str], watched: str, key: str) -> DataFrame:
    """The last episode before the first unwatched one, the count of watched, and the next to watch."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = episodes.withColumn("_pos", F.row_number().over(w))
    first = F.min(F.when(~F.col(watched), F.col("_pos"))).over(Window.partitionBy(*group))
    d = d.withColumn("_first", first)
    return d.groupBy(*group).agg(
        F.max_by(key, F.when(F.coalesce(F.col("_pos") < F.col("_first"), F.lit(True)), F.col("_pos"))).alias("through"),
        F.count_if(watched).alias("watched"), F.max(F.when(F.col("_pos") == F.col("_first"), F.col(key))).alias("next"), F.every(watched).alias("caught_up"),
    )


def sessions(df: DataFrame, user: str, ts: str, idle: str = "30 minutes") -> DataFrame:
    """Visits that end after an idle stretch, by Spark's session windows: start, end (last event), events."""
    w = F.session_window(F.col(ts).cast("timestamp"), idle)
    return df.groupBy(user, w).agg(F.count("*").alias("events"), F.max(ts).alias("last")).select(user, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "last", "events")


def visits(df: DataFrame, user: str, ts: str, idle_minutes: int = 30, hour: int = 4) -> DataFrame:
    """Sessions that also end when the viewing day turns."""
    from ..functions.dates import viewing_day

    w = Window.partitionBy(user).orderBy(ts, *[c for c in ("event_id",) if c in df.columns])
    d = df.withColumn("day", viewing_day(F.col(ts)))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) >= idle_minutes * 60_000_000
    return islands(d, [user], [ts, *[c for c in ("event_id",) if c in df.columns]], gap | (F.lag("day").over(w) != F.col("day")), "visit")


def decayed_counts(days: DataFrame, group: Sequence[str], day: str, today: Column, half_life: float = 7.0) -> DataFrame:
    """Sum of .5 ^ (age / half life) over distinct days before today."""
    age = F.datediff(today, F.col(day))
    return days.select(*group, day).distinct().where(age > 0).groupBy(*group).agg(F.sum(F.pow(F.lit(0.5), age / half_life)).alias("seen"))


def tired(days: DataFrame, group: Sequence[str], day: str, engaged: str, today: Column, window: int = 14, least: int = 5) -> DataFrame:
    """Groups shown on at least so many of the last days without engagement."""
    recent = days.where(F.datediff(today, F.col(day)).between(0, window - 1))
    return recent.groupBy(*group).agg(F.count_distinct(day).alias("days"), F.max(F.col(engaged).cast("int")).alias("e")).where((F.col("days") >= least) & (F.col("e") == 0)).drop("e")


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], key: str, openable: Column) -> DataFrame:
    """The previous and next openable row of each openable row."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.where(openable).withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by the order given ascending."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def newest(df: DataFrame, group: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The newest `keep` rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= keep).drop("_k")


def fold_mutations(log: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """State from an operation log: operation_id, revision, keys, fields (null: not touched), deleted. A repeated
    operation counts once; each field has its latest value, a deleted key no row unless a later operation restores it."""
    once = log.groupBy("operation_id").agg(F.min_by(F.struct(*[c for c in log.columns if c != "operation_id"]), F.struct("revision")).alias("o")).select("operation_id", "o.*")
    order = F.struct("revision", "operation_id")
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f)
    return once.groupBy(*key).agg(*(last(f) for f in fields), F.max_by("deleted", order).alias("deleted"), F.max("revision").alias("revision")).where("not deleted").drop("deleted")


def generations(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each change's generation in its row, and overall how many changes the row has had."""
    w = Window.partitionBy(*key)
    return changes.withColumn("generation", F.row_number().over(w.orderBy(*order))).withColumn("generations", F.count("*").over(w))
