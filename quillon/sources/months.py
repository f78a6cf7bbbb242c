"""Monthly click files counted one month at a time: months that are held are skipped, months that failed are tried again."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import clickstream, month_pairs

_LOG = "month string, path string, counted timestamp"


def held(spark: SparkSession, root: str, keep: int = 3) -> list[tuple[str, str]]:
    """(month, path) of the latest `keep` months held under root, oldest first; of a month counted twice the later count."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{root}/held")
    except AnalysisException:  # nothing was counted yet
        return []
    latest = log.groupBy("month").agg(F.max_by("path", F.struct("counted", "path")).alias("path")).orderBy(F.desc("month")).limit(keep)
    return sorted((r.month, r.path) for r in latest.collect())  # `keep` rows


def add_months(spark: SparkSession, root: str, wanted: dict[str, str], titles: DataFrame, keep: int = 3, again: bool = False) -> list[tuple[str, str]]:
    """Count the latest `keep` of the wanted months (month: path of its tab-separated clicks; lines without a count say nothing) between known titles, the oldest
    first. Held months are left as they are unless asked for again. (month, outcome) of each: held, counted, or skipped where
    its file could not be read to the end; nothing of a skipped month is seen, and the next call tries it again.

    A month's counts go to a folder of their own; only when they are written whole does a row of the log under root/held
    name it, so a run that dies leaves no half month."""
    have, out = {m for m, _ in held(spark, root, keep)}, []
    for month in sorted(wanted)[-keep:]:  # a few files of one large job each
        if month in have and not again:
            out.append((month, "held"))
            continue
        path = f"{root}/counts/{uuid.uuid4().hex}"
        try:
            month_pairs(clickstream(spark, wanted[month]).where("type = 'link' and n is not null"), titles, month).write.parquet(path)
        except PySparkException:
            out.append((month, "skipped"))
            continue
        row = spark.range(1).select(F.lit(month).alias("month"), F.lit(path).alias("path"), F.current_timestamp().alias("counted"))
        row.coalesce(1).write.mode("append").parquet(f"{root}/held")
        out.append((month, "counted"))
    return out


def counts(spark: SparkSession, root: str, keep: int = 3) -> DataFrame:
    """month, a, b, n of the latest `keep` months held; none held, no rows."""
    paths = [p for _, p in held(spark, root, keep)]
    schema = "month string, a long, b long, n long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
