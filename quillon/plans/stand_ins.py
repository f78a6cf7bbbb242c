"""The driver's tables in the shape of a catalogue and of rating lists: the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import never_broadcast, table

#: Columns of a catalogue out of `part`; every expression means the same in Spark SQL and DuckDB.
SHOW_COLUMNS = (
    "p_partkey AS id", "p_name AS name", "p_type AS type", "p_brand AS network", "p_size AS runtime",
    "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 5 + CAST(p_partkey * 7 % 50 AS DOUBLE) / 10 END AS rating",
    "CAST(1950 + p_partkey % 75 AS INT) AS year", "CAST(p_partkey * 37 % 101 AS INT) AS popularity",
    "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'English' WHEN 2 THEN 'French' ELSE 'German' END AS language",
    "CASE p_partkey % 5 WHEN 0 THEN 'Ended' WHEN 1 THEN NULL ELSE 'Running' END AS status",
    "p_partkey % 13 <> 0 AS recommendable", "CAST(p_partkey % 40 AS INT) AS summary_words",
    "CAST(p_partkey % 64 AS BIGINT) AS genre_bits", "CAST(p_partkey * 5 % 128 AS BIGINT) AS theme_bits",
)
SHOWS_SQL = f"shows AS (SELECT {', '.join(SHOW_COLUMNS)} FROM part)"

WEIGHT = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.7 WHEN 'view' THEN 0.35 WHEN 'signup' THEN 0.0 ELSE -1.0 END"
RATINGS_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, CAST({WEIGHT} AS DOUBLE) AS weight FROM events),
lat AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS rn FROM ev),
ratings AS (SELECT user_id, item AS id, weight, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM lat WHERE rn = 1)"""


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*SHOW_COLUMNS)


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k").cast("long")).withColumn("weight", F.expr(f"CAST({WEIGHT} AS DOUBLE)"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, id, weight, ts, pos: each user's latest rating of each item, in order."""
    from pyspark.sql import Window

    from ..operators.sequences import latest

    last = latest(item_events(spark, sf_dir).select("user_id", F.col("item").alias("id"), "ts", "event_id", "weight"), ["user_id", "id"], ["ts", "event_id"])
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return last.select("user_id", "id", "weight", "ts", pos.cast("long").alias("pos"))


#: Attribute families of a show: the SQL of each value.
FAMILY_SQL = {
    "language": "language",
    "format": "type",
    "network": "network",
    "decade": "CASE WHEN year < 1960 THEN 'before 1960' ELSE concat(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR(10)), 's') END",
    "length": "CASE WHEN runtime IS NULL OR runtime = 0 THEN NULL WHEN runtime <= 20 THEN 'short' WHEN runtime <= 40 THEN 'half-hour' WHEN runtime <= 75 THEN 'hour-long' ELSE 'feature-length' END",
    "fame": "CASE WHEN popularity >= 95 THEN 'household names' WHEN popularity >= 85 THEN 'well known' WHEN popularity >= 70 THEN 'fairly known' WHEN popularity >= 50 THEN 'lesser known' ELSE 'little known' END",
    "acclaim": "CASE WHEN rating IS NULL THEN NULL WHEN rating >= 8.5 THEN 'acclaimed' WHEN rating >= 7.5 THEN 'well rated' WHEN rating >= 6.5 THEN 'middling' ELSE 'poorly rated' END",
}
ATTRIBUTES_SQL = "attributes AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS family, {e} AS value FROM shows WHERE {e} IS NOT NULL" for f, e in FAMILY_SQL.items()) + ")"


def attributes(catalogue: DataFrame) -> DataFrame:
    """id, family, value of the known attributes of a catalogue: one pass, the families as an array. Several rows a show, so never
    broadcast."""
    from ..functions import buckets

    values = {
        "language": F.col("language"), "format": F.col("type"), "network": F.col("network"), "decade": buckets.decade(F.col("year")), "length": buckets.length(F.col("runtime")),
        "fame": buckets.fame(F.col("popularity")), "acclaim": buckets.acclaim(F.col("rating")),
    }
    each = catalogue.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("family"), v.alias("value")) for f, v in values.items()))).alias("a"))
    return never_broadcast(each.where("a.value is not null").select("id", "a.family", "a.value"))
