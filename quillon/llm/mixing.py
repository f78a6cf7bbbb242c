"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything is DataFrame functions. A source's target is its share of all words by weight, but at most `epochs` times
its own size; what it can't take is shared out again by weight until no target is above its cap. Each document of a
source is then taken floor(target / size) times, and the fraction that is left is filled by one more time of the
documents that come first in a seeded order, as many as come nearest to the fraction. The order is found on two
levels, buckets of the seeded hash and the rows of the one bucket where the fraction ends, so that a source with a
third of all rows is never sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, unused, word_count

#: Buckets of the seeded hash: the first three of its 32 hexadecimal digits.
BUCKET_DIGITS = 3
#: Sources, and bytes of their names, up to which the plan is broadcast; the parts that a source is dealt to beyond.
BROADCAST_SOURCES, BROADCAST_BYTES, SALTS = 100_000, 16 << 20, 64


def order_key(doc_id: Column, seed: int) -> Column:
    """The seeded place of a document in its source; rows with one doc_id share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, epochs: int = 3, cycle: int = 3) -> DataFrame:
    """sources: source, source_size. Adds weight and target.

    Sources by code point, null last, weigh 1, 2, ... `cycle`, repeating. The rows are one per source; clamping the
    sources with the smallest cap for their weight first, and sharing the rest among the others, is the fixed point of
    clamping and sharing again. Sources without words have target 0. One task orders the sources, a few numbers and the
    name of each: a mix has thousands of them, and some millions still fit."""
    first = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", ((F.row_number().over(first) - 1) % cycle + 1).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    # cap / weight in whole numbers, so that equal ratios are equal: the weights divide their common multiple
    multiple = 1
    for w in range(2, cycle + 1):
        multiple *= w
    ratio = F.col("cap") * F.expr(f"{multiple} div weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left").cast("double"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap").cast("double"))
    )
    # the first source that is not clamped sets the level for all after it
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return filled.select("source", "source_size", "weight", F.coalesce(F.least(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def with_source(rows: DataFrame, per_source: DataFrame, name: str, key: str = "order_key") -> DataFrame:
    """The rows with their source's row of per_source, a written table with the source (null: like any other) in column
    `name`, at most once each. Up to the bounds above it is broadcast. Beyond, each of its rows is copied to SALTS parts
    and each row is dealt to one of its source's parts by the hash of its `key`: no source gathers in one task."""
    n, size = per_source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    same = F.col("source").eqNullSafe(F.col(name))
    if n <= BROADCAST_SOURCES and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_source), same)
    salt, copy = unused(rows, "_salt"), unused(rows, "_salt_of")
    copies = per_source.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, same & (F.col(salt) == F.col(copy))).drop(salt, copy)


def mix_plan(sized: DataFrame, epochs: int = 3, cycle: int = 3) -> DataFrame:
    """sized: source, size, order_key. Per source: source, source_size, target, whole (times that each document is
    taken) and last_key (documents up to this key are taken once more; null: none)."""
    buckets = sized.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS)).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = materialise(buckets)  # at most 4,096 rows a source
    filled = water_fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), epochs, cycle)
    plan = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialise(plan.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    same = F.col("p.source").eqNullSafe(F.col("b.source"))
    reached = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("b.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (
        buckets.alias("b").withColumn("reached", reached).join(plan.alias("p"), same)
        .where((F.col("reached") < F.col("wanted")) & (F.col("reached") + F.col("bucket_size") >= F.col("wanted")))
        .select("p.source", "wanted", "bucket", "reached")
    )
    edge = materialise(edge)  # at most a row a source
    ends = edge.select(F.col("source").alias("edge_source"), "wanted", F.col("bucket").alias("edge_bucket"), "reached")
    keys = (
        with_source(sized, ends, "edge_source").where(F.substring("order_key", 1, BUCKET_DIGITS) == F.col("edge_bucket"))
        .groupBy("source", "order_key", "wanted", "reached").agg(F.sum("size").alias("key_size"))
    )
    upto = F.col("reached") + F.sum("key_size").over(Window.partitionBy("source").orderBy("order_key"))
    # a document belongs in if it brings the sum nearer to the fraction than it is without it
    kept = keys.withColumn("upto", upto).where(F.col("upto") - F.col("wanted") <= F.col("wanted") - (F.col("upto") - F.col("key_size")))
    inside = kept.groupBy("source").agg(F.max("order_key").alias("key_inside"))
    edges = edge.select("source", F.col("bucket").alias("edge_bucket")).alias("e")
    joined = plan.alias("p").join(edges, F.col("p.source").eqNullSafe(F.col("e.source")), "left").join(inside.alias("i"), F.col("p.source").eqNullSafe(F.col("i.source")), "left")
    # the buckets before the last one are in as a whole; every key there is below the last bucket's own prefix
    last_key = F.when(F.col("wanted") > 0, F.coalesce("key_inside", "edge_bucket"))
    return materialise(joined.select("p.source", "source_size", "target", "whole", last_key.alias("last_key")))


def taken_times(whole: Column, last_key: Column, key: Column) -> Column:
    return whole + F.coalesce((key <= last_key).cast("long"), F.lit(0))


def mix(docs: DataFrame, epochs: int = 3, cycle: int = 3, seed: int = 11) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken.

    Null text: size 0. Null source: a source of its own, after the others. Null doc_id: a key like any other. Repeated
    rows are each taken, all or none of those with one doc_id. No rows, no result."""
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("order_key")))
    plan = mix_plan(sized, epochs, cycle).withColumnRenamed("source", "plan_source")
    out = with_source(sized, plan, "plan_source")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * taken_times(F.col("whole"), F.col("last_key"), F.col("order_key"))).alias("taken"))


def mixed_documents(docs: DataFrame, epochs: int = 3, cycle: int = 3, seed: int = 11) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its columns and in as many rows.

    Null texts have size 0 and are taken like others of their source; a source without any words is left out. Nulls,
    repeated rows and no rows are as mix() has them; other columns keep their names and values. The texts stay where
    they are: only the plan travels."""
    names = {c: unused(docs, f"_mix_{c}") for c in ("source", "whole", "last_key", "key", "copy")}
    keyed = docs.withColumn(names["key"], order_key(F.col("doc_id"), seed))
    sized = materialise(keyed.select("source", word_count(F.col("text")).alias("size"), F.col(names["key"]).alias("order_key")))
    plan = mix_plan(sized, epochs, cycle).select(*(F.col(c).alias(names[c]) for c in ("source", "whole", "last_key")))
    times = taken_times(F.col(names["whole"]), F.col(names["last_key"]), F.col(names["key"]))
    joined = with_source(keyed, plan, names["source"], names["key"]).where(times > 0)
    return joined.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), times.cast("int"), F.lit(1)))).select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for mix() with its defaults over the view documents."""
    return r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM src),
lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level,
         cap * (6 // weight) AS ratio
  FROM ranked WINDOW o AS (ORDER BY cap * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
base AS (SELECT min_by(level, (ratio, source IS NULL, source)) FILTER (level * weight <= cap::DOUBLE) AS level,
                min(ratio) FILTER (level * weight <= cap::DOUBLE) AS ratio FROM lev),
targets AS (
  SELECT l.source, l.source_size, l.weight,
         CASE WHEN b.ratio IS NULL OR l.ratio < b.ratio THEN l.cap::DOUBLE ELSE least(b.level * l.weight, l.cap::DOUBLE) END AS target
  FROM lev l, base b),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
keys AS (SELECT s.source, k, sum(size)::BIGINT AS key_size FROM sized s GROUP BY s.source, k),
cum AS (
  SELECT q.source, q.k, p.target - p.whole * p.source_size AS wanted, q.key_size,
         sum(q.key_size) OVER (PARTITION BY q.source ORDER BY q.k)::BIGINT AS upto
  FROM keys q JOIN plan p ON q.source IS NOT DISTINCT FROM p.source),
last AS (SELECT source, max(k) AS last_key FROM cum WHERE wanted > 0 AND upto - wanted <= wanted - (upto - key_size) GROUP BY source)
SELECT s.doc_id, s.size, p.source_size, p.target,
       s.size * (p.whole + CASE WHEN s.k <= l.last_key THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN last l ON s.source IS NOT DISTINCT FROM l.source
"""
