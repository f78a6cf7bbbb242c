"""Bands, buckets and labels of catalogue attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, limit: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), value)))


def truthy(value: Column, zero=0) -> Column:
    """Null for null and zero: the falsy values of a number, or with zero='' of a string."""
    return F.nullif(value, F.lit(zero))


def decade(year: Column) -> Column:
    return F.when(truthy(year).isNull(), None).when(year < 1960, "before 1960").otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def length(runtime: Column) -> Column:
    return F.when(truthy(runtime).isNull(), None).when(runtime <= 20, "short").when(runtime <= 40, "half-hour").when(runtime <= 75, "hour-long").otherwise("feature-length")


def fame(popularity: Column) -> Column:
    return F.when(popularity >= 95, "household names").when(popularity >= 85, "well known").when(popularity >= 70, "fairly known").when(popularity >= 50, "lesser known").otherwise("little known")


def acclaim(rating: Column) -> Column:
    return F.when(truthy(rating).isNull(), None).when(rating >= 8.5, "acclaimed").when(rating >= 7.5, "well rated").when(rating >= 6.5, "middling").otherwise("poorly rated")


def rating_band(score: Column) -> Column:
    """Seven bands of a score of 0 to 10, rounded to one place; none for no score."""
    r = F.round(score, 1)
    names = ((9.5, "masterpiece"), (9.0, "outstanding"), (8.0, "great"), (7.0, "good"), (6.0, "fair"), (5.0, "weak"))
    out = F.when(truthy(score).isNull(), "unrated")
    for least, name in names:
        out = out.when(r >= least, name)
    return out.otherwise("poor")


def form_of(kind: Column) -> Column:
    return F.when(kind == "Animation", "animation").when(kind == "Scripted", "scripted").otherwise("factual")


def coverage_label(words: Column, has_genres: Column) -> Column:
    return F.when((words >= 15) & has_genres, "plot and genres").when(words >= 15, "plot only").when(has_genres, "genres only").otherwise("neither")


def recommendable(premiered: Column, words: Column, has_genres: Column, snapshot: str) -> Column:
    """Out by the snapshot (ISO dates compare as text), and with a plot of 15 words or a genre."""
    return F.coalesce((premiered <= snapshot) & ((words >= 15) | has_genres), F.lit(False))


def season_code(season: Column) -> Column:
    """S01, or the year for seasons that are years."""
    return F.when(season >= 1900, season.cast("string")).otherwise(F.concat(F.lit("S"), F.lpad(season.cast("string"), 2, "0")))


def episode_code(season: Column, number: Column) -> Column:
    return F.when(number.isNull(), F.concat(season_code(season), F.lit(" special"))).otherwise(F.concat(season_code(season), F.lit("E"), F.lpad(number.cast("string"), 2, "0")))


def percent(share: Column) -> Column:
    """Whole percent, half up."""
    return F.floor(share * 100 + 0.5)


def quantised(value: Column, most: float) -> Column:
    """0 to 255 by the square root, half to even."""
    return F.rint(F.sqrt(F.least(F.greatest(value, F.lit(0.0)), F.lit(most)) / most) * 255).cast("short")


def dequantised(byte: Column, most: float) -> Column:
    return F.pow(byte / 255.0, 2) * most
