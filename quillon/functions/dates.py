"""Dates, ages and what is already out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def viewing_day(ts: Column, hour: int = 4) -> Column:
    """The day a moment belongs to when days turn at `hour` o'clock."""
    return F.to_date(ts - F.make_interval(hours=F.lit(hour)))


def decayed(age: Column, half_life: float = 7.0) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def faded(pos: Column, count: Column, floor: float = 0.5, half: float = 300.0) -> Column:
    """The weight of the pos-th of count ratings, oldest 0: falls toward floor, halfway there after `half` newer ones."""
    return floor + (1 - floor) * F.pow(F.lit(0.5), (count - 1 - pos) / half)


def released(airstamp: Column, airdate: Column, now: Column) -> Column:
    """True, false or null for unknown: by the moment where it is known, else by the day, of which today says nothing."""
    stamp, day, today = F.try_to_timestamp(airstamp), F.try_to_date(airdate), F.to_date(now)
    return F.when(stamp.isNotNull(), stamp <= now).when(day < today, F.lit(True)).when(day > today, F.lit(False))


def next_slot(now: Column, hour: int) -> Column:
    """The next moment at the full hour, strictly after now."""
    today = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour))
    return F.when(today > now, today).otherwise(today + F.make_interval(days=F.lit(1)))


def age_years(born: Column, at: Column) -> Column:
    """Whole years by the calendar; null when either is unknown or born later."""
    years = F.year(at) - F.year(born) - F.when(F.date_format(at, "MMdd") < F.date_format(born, "MMdd"), 1).otherwise(0)
    return F.when(born <= at, years)


def due(fetched_at: Column, now: Column, ended: Column, days: int = 1, ended_days: int = 7) -> Column:
    """Whether a record is older than its kind allows; never fetched is due."""
    limit = F.when(ended, F.lit(ended_days)).otherwise(F.lit(days))
    return F.coalesce(F.datediff(now, fetched_at) > limit, F.lit(True))


_DAY = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
_CLOCK = r"(\d{2})(?:(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)|(?:(\d{2})(?:(\d{2})(?:[.,](\d{1,6})\d*)?)?))?"
_OFFSET = r"([+-])([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d))?)?"
_MOMENT = f"^{_DAY}(?:.{_CLOCK}(?:{_OFFSET})?)?$"


def parse_moment(value: Column) -> Column:
    """A moment written by the ISO calendar, in the long or the short form, with or without seconds, fractions (cut at
    microseconds), Z or an offset; any one character stands between day and time, and without an offset it is UTC. What
    is no such text, or no such day or time, is null."""
    text = F.replace(value, F.lit("Z"), F.lit("+00:00"))
    part = lambda k: F.nullif(F.regexp_extract(text, _MOMENT, k), F.lit(""))
    either = lambda a, b, default="00": F.coalesce(part(a), part(b), F.lit(default))
    day = F.concat_ws("-", part(1), F.coalesce(part(2), part(4)), F.coalesce(part(3), part(5)))
    clock = F.concat(F.coalesce(part(6), F.lit("00")), F.lit(":"), either(7, 10), F.lit(":"), either(8, 11), F.lit("."), F.rpad(either(9, 12, "0"), 6, "0"))
    whole = lambda k: F.coalesce(part(k).cast("int"), F.lit(0))
    offset = F.when(part(13) == "-", -1).otherwise(1) * (whole(14) * 3600 + whole(15) * 60 + whole(16))
    return F.when(text.rlike(_MOMENT), F.try_to_timestamp(F.concat(day, F.lit("T"), clock, F.lit("+00:00"))) - F.make_dt_interval(secs=offset.cast("decimal(18,6)")))
