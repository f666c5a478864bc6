"""Reproducible draws: a hash of a key and an id stands in for a random number, in any engine.

``u(key, id)`` is the first 32 bits of md5("key:id") over 2**32. Distinct draws use distinct keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(key: str, *ids: Column) -> Column:
    """The hash that orders rows: md5 of ``key:id[:id...]``."""
    return F.md5(F.concat_ws(":", F.lit(key), *[i.cast("string") for i in ids]))


def u(key: str, *ids: Column) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(h(key, *ids), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(key: str, low: int, high: int, *ids: Column) -> Column:
    """A whole number from low to high."""
    return (F.floor(u(key, *ids) * (high - low + 1)) + low).cast("int")


def between(key: str, low: float, high: float, *ids: Column) -> Column:
    return u(key, *ids) * (high - low) + low


def normal(key: str, mean: float, deviation: float, *ids: Column) -> Column:
    """Box and Muller's transform of two draws."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u(f"{key}/r", *ids)))
    return radius * F.cos(F.lit(2 * math.pi) * u(f"{key}/a", *ids)) * deviation + mean


# The same in DuckDB's SQL, for the oracles.
def sql_h(key: str, *ids: str) -> str:
    return f"md5(concat_ws(':', '{key}', {', '.join(ids)}))"


def sql_u(key: str, *ids: str) -> str:
    return f"(('0x' || substr({sql_h(key, *ids)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_pick(key: str, low: int, high: int, *ids: str) -> str:
    return f"CAST(floor({sql_u(key, *ids)} * {high - low + 1}) + {low} AS INTEGER)"


def sql_between(key: str, low: float, high: float, *ids: str) -> str:
    return f"({sql_u(key, *ids)} * {high - low!r} + {low!r})"


def sql_normal(key: str, mean: float, deviation: float, *ids: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_u(key + '/r', *ids)})) * cos({2 * math.pi!r}::DOUBLE * {sql_u(key + '/a', *ids)}) * {deviation!r} + {mean!r})"
