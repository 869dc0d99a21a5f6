"""Trend times season, fitted to every series by itself: a straight trend, Fourier terms of the year and the week.

A value is taken as (level + slope * t) * (1 + season), t being the share of the series' span that has passed.
The trend is that of least squares. The season is a ridge regression of value / trend - 1 on sines and cosines,
from the normal equations of the series. The two are fitted in turns, each to what the other leaves, so that a part
of a year at an end is not taken for a trend. Bands are the forecast and a quantile of the normal distribution times
the standard deviation of the errors.

A series is one row with its dates and values (one shuffle, bounded by the calendar); the small linear systems are
solved in batches of rows by a vectorised function, all else is built-in.

Defined cases: null values count as 0. A series shorter than ``least`` has no fit and no row. A trend at or below a
hundredth of the mean is taken as that hundredth; a series without demand is forecast as 0. Equal dates count each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quantiles of the normal distribution for bands of 80 and 95 percent.
Z80, Z95 = 1.2815515655446004, 1.959963984540054
YEAR, WEEK = 365.25, 7.0
#: Turns of trend and season, and the least share of the trend that a season may leave.
TURNS, LEAST_SHARE = 5, 0.1
FIT = "level double, slope double, first int, span double, low double, year array<double>, week array<double>, spread double"


@dataclass(frozen=True)
class Season:
    """Pairs of Fourier terms of the year and of the week, and the weight that draws them to 0."""

    year: int = 5
    week: int = 0
    ridge: float = 1.0


WEEKLY, DAILY = Season(), Season(week=3)


def angles(days: np.ndarray, period: float, pairs: int) -> np.ndarray:
    """sin and cos of 1 to ``pairs`` turns a period, for days since 1970."""
    turns = 2 * np.pi * np.outer(days / period, np.arange(1, pairs + 1))
    return np.concatenate([np.sin(turns), np.cos(turns)], axis=1)


def fit_one(days: np.ndarray, y: np.ndarray, season: Season) -> tuple:
    """level, slope, first day, span, least trend, coefficients of year and week, and deviation of errors."""
    first, span = int(days[0]), float(max(days[-1] - days[0], 1))
    t = (days - first) / span
    line = np.column_stack([np.ones(len(y)), t])
    low = 0.01 * y.mean()
    terms = np.column_stack([angles(days, YEAR, season.year), angles(days, WEEK, season.week)])
    normal = terms.T @ terms + season.ridge * np.eye(terms.shape[1])
    weights = np.zeros(terms.shape[1])
    for _ in range(TURNS):
        level, slope = np.linalg.lstsq(line, y / np.maximum(1 + terms @ weights, LEAST_SHARE), rcond=None)[0]
        trend = np.maximum(level + slope * t, low)
        ratio = np.divide(y, trend, out=np.ones_like(y), where=trend > 0) - 1
        weights = np.linalg.solve(normal, terms.T @ ratio)
    spread = float(np.std(y - trend * (1 + terms @ weights)))
    cut = 2 * season.year
    return float(level), float(slope), first, span, float(low), weights[:cut].tolist(), weights[cut:].tolist(), spread


def with_season(rows: DataFrame, keys: Sequence[str], time: str, value: str, season: Season = WEEKLY, least: int = 2) -> DataFrame:
    """One row per series of at least ``least`` values: keys, n, last and ``fit``."""

    @F.pandas_udf(FIT)
    def fitted(days: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = [fit_one(np.asarray(d, dtype=float), np.asarray(v, dtype=float), season) for d, v in zip(days, values)]
        return pd.DataFrame(rows, columns=["level", "slope", "first", "span", "low", "year", "week", "spread"])

    day, known = F.unix_date(F.to_date(time)), F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    points = F.sort_array(F.collect_list(F.struct(day.alias("day"), known.alias("y"))))
    series = rows.groupBy(*keys).agg(points.alias("points"), F.max(F.to_date(time)).alias("last")).where(F.size("points") >= least)
    return series.select(*keys, F.size("points").alias("n"), "last", fitted(F.col("points.day"), F.col("points.y")).alias("fit"))


def _wave(weights: Column, period: float, day: Column, pairs: int) -> Column:
    """The season of ``weights`` on a day, as built-in expressions."""
    total = F.lit(0.0)
    for k in range(pairs):
        turn = 2 * np.pi * (k + 1) * day / period
        total = total + F.get(weights, F.lit(k)) * F.sin(turn) + F.get(weights, F.lit(pairs + k)) * F.cos(turn)
    return total


def parts(date: Column, season: Season) -> dict[str, Column]:
    """Trend and shares of year and week of ``fit`` on a date."""
    fit, day = F.col("fit"), F.unix_date(date).cast("double")
    trend = F.greatest(fit["level"] + fit["slope"] * (day - fit["first"]) / fit["span"], fit["low"])
    return {"trend": trend, "yearly": _wave(fit["year"], YEAR, day, season.year), "weekly": _wave(fit["week"], WEEK, day, season.week)}


def seasonal_steps(fitted: DataFrame, keys: Sequence[str], horizon: int, days: int, time: str, season: Season = WEEKLY, z: float = Z80) -> DataFrame:
    """(keys, time, forecast, lower, upper, trend, yearly, weekly) of the next ``horizon`` steps of ``days`` days, none below 0."""
    ahead = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ahead = ahead.withColumn(time, F.date_add("last", F.col("step") * days))
    ahead = ahead.withColumns(parts(F.col(time), season))
    value = F.col("trend") * (1 + F.col("yearly") + F.col("weekly"))
    width, zero = z * F.col("fit.spread"), F.lit(0.0)
    bands = {"forecast": F.greatest(value, zero), "lower": F.greatest(value - width, zero), "upper": F.greatest(value + width, zero)}
    return ahead.withColumns(bands).select(*keys, time, *bands, "trend", "yearly", "weekly")


def seasonal_effects(fitted: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, season: Season = DAILY) -> DataFrame:
    """(keys, kind, part, effect): mean share of season in percent of each weekday (0 = Monday) and month that ``rows`` hold."""
    days = rows.select(*keys, F.to_date(time).alias("date")).distinct()
    known = days.join(fitted, list(keys)).withColumns(parts(F.col("date"), season))
    kinds = F.array(
        F.struct(F.lit("weekday").alias("kind"), F.weekday("date").alias("part"), F.col("weekly").alias("share")),
        F.struct(F.lit("month").alias("kind"), F.month("date").alias("part"), F.col("yearly").alias("share")),
    )
    cells = known.select(*keys, F.inline(kinds))
    return cells.groupBy(*keys, "kind", "part").agg((100 * F.avg("share")).alias("effect"))
