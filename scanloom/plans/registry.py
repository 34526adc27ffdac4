"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.plans.views import Views, sql


@dataclass(frozen=True)
class Entry:
    run: Callable[[Views], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, text: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(fn, sql(text) if text else None)
        return fn

    return register


def snap(c: Column, digits: int = 6) -> Column:
    """Cut to ``digits`` decimals; the offset keeps exact ties away from the cut."""
    return F.floor(c * (10.0**digits) + 0.3717) / (10.0**digits)


def s(expr: str, digits: int = 6) -> str:
    """SQL text of :func:`snap`."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.3717::DOUBLE) / {scale})"


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: ENTRIES[name].run(Views(spark, folder))
