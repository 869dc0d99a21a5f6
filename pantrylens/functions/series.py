"""Sequential smoothing over one series held as an array (bounded by the calendar length)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` needs it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ordered_values(time: str, value: str) -> Column:
    """Aggregate: the values of a series in time order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("y"))))
    return F.transform(pairs, lambda p: p["y"])


def exponential_smooth(values: Column, alpha: float) -> Column:
    """Final level of simple exponential smoothing seeded with the first value; null when empty."""
    return F.when(
        F.size(values) > 0,
        F.aggregate(
            F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))),
            F.element_at(values, F.lit(1)),
            lambda level, x: F.lit(alpha) * x + F.lit(1 - alpha) * level,
        ),
    )


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def demand_sizes(values: Column) -> Column:
    return F.filter(values, lambda x: x > 0)


def demand_intervals(values: Column) -> Column:
    """Steps between successive non-zero observations."""
    places = F.filter(F.transform(values, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return let(
        places,
        lambda at: F.transform(
            F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))),
            lambda p, i: (p - F.element_at(at, i + 1)).cast("double"),
        ),
    )


def square_sum(values: Column) -> Column:
    """Sum of squared differences from the mean."""
    return let(values, lambda v: let(array_mean(v), lambda mean: F.aggregate(v, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean))))
