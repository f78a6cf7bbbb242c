"""Registered queries: each operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> list[Query]:
    from . import catalogue, explained, landed, lists, model, ordered, payloads, ranking, related, scalars, starters, titles

    return [q for module in (scalars, catalogue, landed, model, lists, ordered, titles, related, ranking, starters, explained, payloads) for q in module.QUERIES]
