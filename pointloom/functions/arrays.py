"""Array functions in higher-order expressions: differences, running sums, even spacing, norms, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diff(a: Column) -> Column:
    """Differences of neighbours; empty below two elements."""
    n = F.size(a)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: (x - y).cast("double")))


def cumsum(a: Column) -> Column:
    """Running sums by one fold."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["s"] + x.cast("double")
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))

    return F.aggregate(a, start, add, lambda acc: acc["out"])


def linspace(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / max(n - 1, 1))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def argmin(a: Column) -> Column:
    """Position of the least element from 0 (the first of equals); null for empty arrays."""
    return F.nullif(F.array_position(a, F.array_min(a)), F.lit(0)) - 1


def argmax(a: Column) -> Column:
    return F.nullif(F.array_position(a, F.array_max(a)), F.lit(0)) - 1


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, also where the plan would otherwise repeat its expression."""
    return F.get(F.transform(F.array(value), use), 0)
