"""Forecasts of all series at once: one array of values per series, one row per series and step.

A series has at most one value a step, so its array is bounded by the length of the calendar. Null
values count as 0. A series of no values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.functions.series import array_mean, demand_intervals, demand_sizes, exponential_smooth, ordered_values, square_sum
from pantrylens.operators.holt_winters import holt_winters_steps, with_holt_winters

# Windows, least numbers of points, smoothing factors.
DAILY_WINDOW, WEEKLY_WINDOW = 7, 4
ENOUGH_FOR_SEASON, ENOUGH_FOR_MEAN = 14, 3
CROSTON_ALPHA, TUNED_ALPHA = 0.1, 0.15
Z95 = 1.959963984540054


def as_series(rows: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """One row per key: ``y`` in time order, its length ``n`` and the ``last`` time."""
    filled = rows.withColumn("y", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    series = filled.groupBy(*keys).agg(ordered_values(time, "y").alias("y"), F.max(time).alias("last"))
    return series.withColumn("n", F.size("y"))


def tail(values: Column, k: int) -> Column:
    k = F.least(F.lit(k), F.size(values))
    return F.slice(values, F.size(values) - k + 1, k)


def spread(values: Column) -> Column:
    """Population standard deviation."""
    return F.when(F.size(values) > 0, F.sqrt(square_sum(values) / F.size(values)))


def median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    return (low + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2


def floored(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def band(forecast: Column, lower: Column, upper: Column) -> Column:
    return F.struct(forecast.alias("forecast"), lower.alias("lower"), upper.alias("upper"))


def daily_method() -> Column:
    return (
        F.when(F.col("n") >= ENOUGH_FOR_SEASON, "holt_winters")
        .when(F.col("n") >= ENOUGH_FOR_MEAN, "moving_average")
        .otherwise("insufficient_data")
    )


def with_daily_bands(series: DataFrame) -> DataFrame:
    """Adds ``moving`` and ``insufficient``, the two bands that need no model."""
    recent = series.withColumn("recent", tail(F.col("y"), DAILY_WINDOW))
    known = recent.withColumns({"mean_recent": array_mean(F.col("recent")), "std_recent": spread(F.col("recent")), "mean": array_mean(F.col("y"))})
    mean, every = F.col("mean_recent"), F.col("mean")
    width = Z95 * F.when(F.col("n") > 1, F.col("std_recent")).otherwise(0.2 * mean)
    doubt = F.greatest(0.5 * every, F.lit(1.0))
    return known.withColumns(
        {
            "moving": band(mean, floored(mean - width), mean + width),
            "insufficient": band(every, floored(every - doubt), every + doubt),
        }
    )


def steps_ahead(df: DataFrame, keys: Sequence[str], horizon: int, days: int, time: str, *columns: str) -> DataFrame:
    """Constant forecasts spread over ``horizon`` steps of ``days`` days after ``last``."""
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    return df.select(*keys, *columns, "last", step).select(
        *keys, F.date_add("last", F.col("step") * days).alias(time), *columns
    )


def constant_steps(band_column: str, horizon: int) -> Column:
    """Array of (step, forecast, lower, upper) that repeats one band."""
    bands = [F.col(band_column)[c].alias(c) for c in ("forecast", "lower", "upper")]
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda step: F.struct(step.alias("step"), *bands))


def daily_forecasts(series: DataFrame, keys: Sequence[str], horizon: int = 7) -> DataFrame:
    """(keys, date, forecast, lower, upper, method) of the next days, each series by the model its length allows."""
    routed = with_daily_bands(with_holt_winters(series)).withColumn("method", daily_method())
    steps = (
        F.when(F.col("method") == "holt_winters", holt_winters_steps(horizon))
        .when(F.col("method") == "moving_average", constant_steps("moving", horizon))
        .otherwise(constant_steps("insufficient", horizon))
    )
    rows = routed.select(*keys, "last", "method", F.inline(steps))
    return rows.select(*keys, F.date_add("last", F.col("step")).alias("date"), "forecast", "lower", "upper", "method")


def with_weekly_bands(series: DataFrame) -> DataFrame:
    """Adds ``croston`` and ``moving``; forecasts are whole (half to even), bounds are cut."""
    y = F.col("y")
    known = series.withColumns(
        {
            "size": exponential_smooth(demand_sizes(y), CROSTON_ALPHA),
            "gap": exponential_smooth(demand_intervals(y), CROSTON_ALPHA),
            "mean": array_mean(y),
            "mean_recent": array_mean(tail(y, WEEKLY_WINDOW)),
            "std_recent": spread(tail(y, WEEKLY_WINDOW)),
        }
    )
    croston = floored(F.bround(F.when(F.col("gap") > 0, F.col("size") / F.col("gap")).otherwise(F.col("mean"))))
    moving = floored(F.bround("mean_recent"))
    known = known.withColumns({"croston_value": croston, "moving_value": moving})
    croston, moving = F.col("croston_value"), F.col("moving_value")
    width = 1.5 * F.when(F.col("n") > 1, F.col("std_recent")).otherwise(0.3 * moving)
    cut = lambda x: F.signum(x) * F.floor(F.abs(x))
    return known.withColumns(
        {
            "croston": band(croston, F.floor(0.5 * croston).cast("double"), F.floor(1.5 * croston).cast("double")),
            "moving": band(moving, floored(cut(moving - width)), cut(moving + width)),
        }
    )


def last_weeks(lines: DataFrame, keys: Sequence[str], time: str = "created") -> DataFrame:
    """Weeks with sales and the last of them for every key."""
    sold = lines.select(*keys, F.to_date(F.date_trunc("week", time)).alias("week_start")).distinct()
    return sold.groupBy(*keys).agg(F.count("*").alias("weeks"), F.max("week_start").alias("last"))


def insufficient_weekly(series: DataFrame, keys: Sequence[str], horizon: int = 4) -> DataFrame:
    """Forecasts of series (``last``) too short for any model: 0, up to 5, at a confidence of one half."""
    fixed = {"forecast": 0.0, "lower": 0.0, "upper": 5.0, "confidence": 0.5}
    return steps_ahead(series.withColumns({c: F.lit(v) for c, v in fixed.items()}), keys, horizon, 7, "week_start", *fixed)


def with_tuned_bands(series: DataFrame) -> DataFrame:
    """Adds ``smooth``, ``erratic``, ``croston_sba``, ``tsb`` and ``weighted``, unrounded."""
    y = F.col("y")
    known = series.withColumns(
        {
            "mean": array_mean(y), "top": F.array_max(y), "low": F.array_min(y), "std": spread(y), "median": median(y),
            "mean_recent": array_mean(tail(y, 4)), "first": F.element_at(y, 1), "final": F.element_at(y, -1),
            "sizes": demand_sizes(y), "gap": exponential_smooth(demand_intervals(y), TUNED_ALPHA),
            "later": F.slice(y, 2, F.greatest(F.col("n") - 1, F.lit(0))), "six": tail(y, 6),
        }
    )
    sizes = F.col("sizes")
    known = known.withColumns(
        {
            "k": F.size(sizes), "size": exponential_smooth(sizes, TUNED_ALPHA), "size_mean": array_mean(sizes),
            "size_std": spread(sizes), "size_top": F.array_max(sizes), "size_low": F.array_min(sizes),
            "six_mean": F.aggregate(F.transform("six", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
            / (F.size("six") * (F.size("six") + 1) / 2),
        }
    )
    share = F.col("k").cast("double") / F.col("n")
    level = exponential_smooth(F.concat(F.array("size_mean"), demand_sizes(F.col("later"))), TUNED_ALPHA)
    chance = exponential_smooth(
        F.concat(F.array(share), F.transform("later", lambda x: F.when(x > 0, 1.0).otherwise(0.0))), TUNED_ALPHA
    )
    n, mean, top, low, std = (F.col(c) for c in ("n", "mean", "top", "low", "std"))
    size_range = F.col("size_top") - F.col("size_low")
    rise = F.when(n >= 3, 0.4 * floored((F.col("final") - F.col("first")) / (n - 1))).otherwise(0.0)
    lean = F.when(n >= 3, (F.col("final") - F.element_at(y, F.greatest(n - 2, F.lit(1)))) / 4).otherwise(0.0)
    known = known.withColumns(
        {
            "f_smooth": 0.5 * mean + 0.35 * F.col("mean_recent") + 0.15 * top + rise,
            "f_erratic": F.greatest(0.4 * mean + 0.3 * F.col("median") + 0.18 * top, 0.9 * mean),
            "f_croston": F.col("size") / F.greatest(F.col("gap"), F.lit(1.0)) * (1 - TUNED_ALPHA / 2),
            "f_tsb": level * chance,
            "f_weighted": F.col("six_mean") + lean,
        }
    )
    smooth, erratic, croston, tsb, weighted = (F.col(f"f_{c}") for c in ("smooth", "erratic", "croston", "tsb", "weighted"))
    one, few, zero = n == 1, F.col("k") < 2, F.lit(0.0)
    typical = F.coalesce("size_mean", F.lit(1.0))
    w_smooth = F.greatest(5 * std, 1.2 * (top - low), 0.7 * smooth)
    w_erratic = F.greatest(6 * std, 1.8 * (top - low), 0.9 * erratic)
    w_croston = F.greatest(5 * F.col("size_std"), size_range, 0.8 * croston)
    w_tsb = F.greatest(6 * F.col("size_std"), 1.5 * size_range, tsb)
    w_weighted = F.greatest(4 * std, 0.5 * weighted)
    return known.withColumns(
        {
            "smooth": F.when(one, band(mean, 0.1 * mean, 4 * mean)).otherwise(
                band(smooth, floored(smooth - w_smooth), smooth + 1.5 * w_smooth)
            ),
            "erratic": F.when(one, band(mean, zero, 6 * mean)).otherwise(
                band(erratic, zero, F.greatest(1.8 * top, erratic + 1.8 * w_erratic))
            ),
            "croston_sba": F.when(few, band(0.3 * typical, zero, 2 * typical)).otherwise(
                band(croston, zero, croston + 1.5 * w_croston)
            ),
            "tsb": F.when(few, band(0.25 * typical, zero, 3 * typical)).otherwise(band(tsb, zero, tsb + 2 * w_tsb)),
            "weighted": F.when(one, band(mean, zero, 2 * mean)).otherwise(
                band(floored(weighted), floored(weighted - w_weighted), weighted + w_weighted)
            ),
        }
    )


def tuned_by_class(kind: Column) -> Column:
    """The tuned band of a class; smooth for any other."""
    return (
        F.when(kind == "Erratic", F.col("erratic"))
        .when(kind == "Intermittent", F.col("croston_sba"))
        .when(kind == "Lumpy", F.col("tsb"))
        .otherwise(F.col("smooth"))
    )
