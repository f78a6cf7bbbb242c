"""Compact encodings: rating lists, locales, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character for each rating.
CODES = {"4": 1.0, "3": 0.7, "2": 0.35, "1": 0.0, "0": -1.0}


def decode_ratings(ids: Column, codes: Column) -> Column:
    """Array of (pos, id, weight) of ids and a string with a code each; null where they do not fit."""
    table = F.create_map(*(x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))))
    rows = F.transform(ids, lambda i, k: F.struct(k.alias("pos"), i.alias("id"), F.try_element_at(table, F.substring(codes, k + 1, F.lit(1))).alias("weight")))
    return F.when((F.size(ids) == F.length(codes)) & codes.rlike("^[0-4]*$"), rows)


def encode_ratings(pairs: Column) -> Column:
    """(ids, weights) of an array of (pos, id, weight), in order of pos."""
    code = lambda w: F.when(w == 1.0, "4").when(w == 0.7, "3").when(w == 0.35, "2").when(w == 0.0, "1").otherwise("0")
    ordered = F.array_sort(pairs)
    return F.struct(F.transform(ordered, lambda p: p["id"]).alias("ids"), F.array_join(F.transform(ordered, lambda p: code(p["weight"])), "").alias("weights"))


def locale_parts(tag: Column) -> Column:
    """(language, country) of a BCP 47 tag; script subtags are passed over."""
    parts = F.split(F.replace(tag, F.lit("_"), F.lit("-")), "-")
    country = F.element_at(F.filter(parts, lambda p: p.rlike("^[A-Za-z]{2}$")), -1)
    has = F.size(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda p: p.rlike("^[A-Za-z]{2}$"))) > 0
    return F.struct(F.lower(parts[0]).alias("language"), F.when(has, F.upper(country)).alias("country"))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
