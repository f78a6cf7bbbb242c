"""Predicates over a catalogue: who may be recommended, what fits a browser's filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of programme kinds.
FORMAT_GROUPS = {
    "scripted": ("Scripted",),
    "animation": ("Animation",),
    "documentary": ("Documentary",),
    "unscripted": ("Reality", "Variety", "Talk Show", "Game Show", "Panel Show", "Award Show", "Sports", "News"),
}


@dataclass(frozen=True)
class Settings:
    """Weights of closeness and the filters of a request, with their defaults."""

    text: float = 40
    themes: float = 35
    genres: float = 25
    facets: float = 30
    closest: float = 0.3
    dislike: float = 0.35
    language: str = "all"
    type: str = "all"
    status: str = "all"
    year_min: int = 1900
    runtime_min: int = 0
    rating_min: float = 0
    known_min: int = 60


def in_format(kind: Column, wanted: str) -> Column:
    if wanted == "all":
        return F.lit(True)
    return F.coalesce(kind, F.lit("unknown")).isin(*FORMAT_GROUPS.get(wanted, (wanted,)))


def at_least(value: Column, least: float) -> Column:
    """Unknown values only pass a limit of zero."""
    return F.lit(True) if least == 0 else F.coalesce(value >= least, F.lit(False))


def eligible(s: Settings, recommendable: Column | None = None) -> Column:
    """Over columns recommendable, year, popularity, type, language, status, runtime, rating."""
    parts = [F.coalesce(recommendable if recommendable is not None else F.col("recommendable"), F.lit(False)), F.coalesce(F.col("year") >= s.year_min, F.lit(False)), F.col("popularity") >= s.known_min, in_format(F.col("type"), s.type)]
    parts += [F.coalesce(F.col(c), F.lit("unknown")) == v for c, v in (("language", s.language), ("status", s.status)) if v != "all"]
    return reduce(and_, [*parts, at_least(F.col("runtime"), s.runtime_min), at_least(F.col("rating"), s.rating_min)])


def pool(catalogue: DataFrame, rated: DataFrame, s: Settings) -> DataFrame:
    """Eligible shows that are not rated. rated: id, or user_id and id: then the pool of each user of that stated set is
    spelled out, which scoring does without (plans.recommend)."""
    candidates = catalogue.where(eligible(s))
    if "user_id" not in rated.columns:
        return candidates.join(rated.select("id"), "id", "left_anti")
    users = rated.select("user_id").distinct()
    return candidates.crossJoin(users).join(rated.select("user_id", "id"), ["user_id", "id"], "left_anti")


def discovery(filters: Mapping) -> Column:
    """Any of genres, least rating and year, exact status and language, format group, length class, most episodes,
    seasons and hours; a missing filter passes everything, an unknown value passes no filter."""
    f, parts = filters, []
    known = lambda c: F.coalesce(c, F.lit(False))
    if f.get("genres"):
        parts.append(known(F.arrays_overlap("genres", F.array(*(F.lit(g) for g in f["genres"])))))
    for name, column in (("rating", "rating"), ("year", "year")):
        if f.get(name):
            parts.append(known(F.col(column) >= f[name]))
    for name in ("status", "language"):
        if f.get(name):
            parts.append(known(F.col(name) == f[name]))
    if f.get("format"):
        parts.append(in_format(F.col("type"), f["format"]))
    if f.get("length"):
        low, high = {"short": (1, 20), "half-hour": (21, 40), "hour-long": (41, 75), "feature-length": (76, 100_000)}[f["length"]]
        parts.append(known(F.col("runtime").between(low, high)))
    for name, column in (("episodes", "episodes"), ("seasons", "seasons"), ("hours", "hours")):
        if f.get(name):
            parts.append(known(F.col(column) <= f[name]))
    return reduce(and_, parts, F.lit(True))


def recipe(parts: Sequence[Sequence[Column]]) -> Column:
    """All of the parts, each of which is any of its conditions."""
    return reduce(and_, [reduce(or_, [F.coalesce(c, F.lit(False)) for c in part]) for part in parts], F.lit(True))


def mask_recipe(mask: Column, parts: Sequence[Sequence[int]]) -> Column:
    """recipe() over bits of one mask: a part matches if any of its bits is set."""
    return recipe([[mask.bitwiseAND(F.lit(sum(1 << b for b in part)).cast("long")) != 0] for part in parts])


def study(snapshot: str) -> Column:
    """English scripted shows with a plot that were out by the snapshot."""
    return F.coalesce((F.col("language") == "English") & (F.col("type") == "Scripted") & (F.col("summary_words") >= 15) & (F.col("premiered") <= snapshot), F.lit(False))


def plausible_match(own_name: Column, other_name: Column, year: Column, first: Column, last: Column, slack: int = 1) -> Column:
    """Equal folded names and a year inside the run, give or take."""
    return F.coalesce((own_name == other_name) & year.between(first - slack, F.coalesce(last, year) + slack), F.lit(False))
