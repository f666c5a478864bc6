"""Keyed permutations of 0 to n - 1: an epoch's order as arithmetic on one stored number, without a sort.

A number is two digits of a grid of about the square root of n on each side. Rounds add to one digit a hash of the
other one, modulo its side, which can be undone and so never maps two numbers to one. A result outside 0 to n - 1 is
put in again until one inside comes out; the grid has fewer than one row too many, so that this is rare."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import h, sql_h

ROUNDS = 4
#: Turns of a number through the rounds; more are not needed for any n that has been seen, and are an error.
TURNS = 48


def _sides(n: int) -> tuple[int, int]:
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def permuted(number: Column, n: int, key: str, epoch: Column) -> Column:
    """Where ``number`` (0 to n - 1) goes in the permutation of ``key`` and ``epoch``; null stays null."""
    a, b = _sides(n)
    draw = lambda step, of: F.conv(F.substring(h(key, epoch, step, of), 1, 8), 16, 10).cast("bigint")

    def turn(x: Column, i: Column) -> Column:
        step = F.pmod(i, F.lit(ROUNDS))
        left = F.when(step % 2 == 0, F.pmod(x["l"] + draw(step, x["r"]), F.lit(a))).otherwise(x["l"])
        right = F.when(step % 2 == 1, F.pmod(x["r"] + draw(step, x["l"]), F.lit(b))).otherwise(x["r"])
        made = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
        ended = lambda m: F.struct(m["l"].alias("l"), m["r"].alias("r"), ((step == ROUNDS - 1) & (m["l"] * b + m["r"] < n)).alias("done"))
        return F.when(x["done"], x).otherwise(F.element_at(F.transform(F.array(made), ended), 1))

    start = F.struct(F.expr("0L").alias("l"), F.expr("0L").alias("r"), F.lit(False).alias("done"))
    start = start.withField("l", F.floor(number / F.lit(b)).cast("bigint")).withField("r", F.pmod(number, F.lit(b)).cast("bigint"))
    ended = lambda x: F.when(x["done"], x["l"] * b + x["r"]).otherwise(F.raise_error(F.lit("the permutation does not come back")).cast("bigint"))
    return F.when(number.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * TURNS - 1)), start, turn, ended))


def sql_permuted(number: str, n: str, key: str, epoch: str) -> str:
    """The same in DuckDB's SQL; ``n`` may be a subquery's column."""
    a = f"CAST(floor(sqrt(greatest({n} - 1, 0))) + 1 AS BIGINT)"
    b = f"(({n} + {a} - 1) // {a})"
    draw = lambda of: f"('0x' || substr({sql_h(key, epoch, f'i % {ROUNDS}', of)}, 1, 8))::BIGINT"
    step = f"""CASE WHEN x[3] = 1 THEN x ELSE list_transform([CASE WHEN i % 2 = 0 THEN [(x[1] + {draw("x[2]")}) % {a}, x[2]] ELSE [x[1], (x[2] + {draw("x[1]")}) % {b}] END],
  lambda m: [m[1], m[2], CASE WHEN i % {ROUNDS} = {ROUNDS - 1} AND m[1] * {b} + m[2] < {n} THEN 1 ELSE 0 END])[1] END"""
    fold = f"list_reduce(list_transform(range({ROUNDS * TURNS}), lambda k: [k]), lambda x, s: list_transform([s[1]], lambda i: {step})[1], [{number} // {b}, {number} % {b}, 0])"
    return f"list_transform([{fold}], lambda x: x[1] * {b} + x[2])[1]"
