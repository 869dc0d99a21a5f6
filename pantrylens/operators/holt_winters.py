"""Additive Holt-Winters with a damped trend and a week of seasons, fitted to every series by itself.

A series is one array in time order, so a fit is a fold over it and needs no shuffle: each set of
parameters of a fixed grid folds the series into a state with the sum of its squared errors, the least
sum wins (ties: the smaller parameters, alpha first), and a second, finer grid round the winner is folded
the same way. Each task folds many series and all sets at once, day by day. State and forecasts stay in the row of
the series.

Defined cases: values below 0.1 (nulls count as 0) are taken as 0.1. A series shorter than two seasons has no
fit (null). The error in percent is over values other than 0, 100 at most and 100 if there are none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASON = 7
# Least value of a series, quantile of the band.
FLOOR, Z95 = 0.1, 1.959963984540054
# The grid of smoothing factors, and what the best ones are multiplied by for the finer grid.
GRID = {"alpha": (0.1, 0.3, 0.6), "beta": (0.01, 0.1, 0.3), "gamma": (0.05, 0.3), "phi": (0.9, 0.98)}
FINER = (0.7, 1.0, 1.3)
MOST = 0.99
FACTORS = ("alpha", "beta", "gamma", "phi")
SEASONS = [f"s{k}" for k in range(SEASON)]
END = ("level", "trend", *SEASONS, "error", "squares", "percent")
FIT = f"struct<squares: double, {', '.join(f'{c}: double' for c in FACTORS)}, end: struct<{', '.join(f'{c}: double' for c in END)}>>"
# Series folded at once, so that the states of all sets stay small.
AT_ONCE = 256


Folded = dict[str, np.ndarray]


def first_state(z: np.ndarray) -> Folded:
    """Level and seasons of the first week; the trend is the change to the second one, a day. ``z`` has a row a day."""

    def mean(start: int) -> np.ndarray:
        total = np.zeros(z.shape[1])
        for k in range(SEASON):
            total = total + z[start + k]
        return total / SEASON

    level = mean(0)
    zero = np.zeros_like(level)
    state = {"level": level, "trend": (mean(SEASON) - level) / SEASON, "error": zero, "squares": zero, "percent": zero}
    return state | {s: z[k] - level for k, s in enumerate(SEASONS)}


def fold(y: np.ndarray, n: np.ndarray, factors: np.ndarray, squares_only: bool = False) -> Folded:
    """The states after all of ``y``, with sums of errors, of squared errors, and of errors as shares of values other than 0.

    With ``squares_only`` the sums but that of squares stay 0: a choice among factors needs no other.

    ``y`` has a row a day and a column a series, longest first, ``n`` their lengths; ``factors`` (4 x sets x series or
    1) are tried on every series. States are sets x series.
    """
    z = np.maximum(y, FLOOR)
    alpha, beta, gamma, phi = factors
    shape = (alpha.shape[0], y.shape[1])
    at = {k: np.broadcast_to(v, shape).copy() for k, v in first_state(z).items()}
    seasons = [at.pop(s) for s in SEASONS]
    level, trend, error, squares, percent = (at[k] for k in ("level", "trend", "error", "squares", "percent"))
    ends = np.searchsorted(-n, -np.arange(len(y)))  # at day t, the series longer than t come first
    keep = {"a": 1 - alpha, "b": 1 - beta, "g": 1 - gamma}
    # every day writes into the same five arrays: new ones each day took most of the time
    room = [np.empty(shape) for _ in range(5)]
    part = lambda x, k: x[:, :k] if x.shape[1] > 1 else x
    for t in range(len(y)):
        k = ends[t]
        value, known = z[t, :k], y[t, :k]
        a, b, g, a1, b1, g1 = (part(x, k) for x in (alpha, beta, gamma, keep["a"], keep["b"], keep["g"]))
        season, was, slope = seasons[t % SEASON][:, :k], level[:, :k], trend[:, :k]
        before, off, spare, new, damped = (x[:, :k] for x in room)
        np.multiply(part(phi, k), slope, out=damped)
        np.add(was, damped, out=before)
        np.add(before, season, out=spare)  # the day's forecast
        np.subtract(value, spare, out=off)
        # the newest season takes the place of the oldest
        if not squares_only:
            percent[:, :k] += np.where(known != 0, np.abs((known - spare) / np.where(known != 0, known, 1.0)), 0.0)
            error[:, :k] += off
        np.subtract(value, season, out=new)
        np.multiply(a, new, out=new)
        np.multiply(a1, before, out=spare)
        np.add(new, spare, out=new)
        np.subtract(new, was, out=was)
        np.multiply(b, was, out=was)
        np.multiply(b1, damped, out=damped)
        np.add(was, damped, out=slope)
        np.subtract(value, before, out=before)
        np.multiply(g, before, out=before)
        np.multiply(g1, season, out=season)
        np.add(before, season, out=season)
        was[...] = new
        np.multiply(off, off, out=off)
        np.add(squares[:, :k], off, out=squares[:, :k])
    turned = np.stack(seasons)
    first = (n[None, :] + np.arange(SEASON)[:, None]) % SEASON
    rotated = np.take_along_axis(turned, np.broadcast_to(first[:, None, :], turned.shape), axis=0)
    return {"level": level, "trend": trend, "error": error, "squares": squares, "percent": percent, **dict(zip(SEASONS, rotated))}


def _least(squares: np.ndarray) -> np.ndarray:
    """Of each series, the first set with the least sum; one that is no number counts as the greatest."""
    none = np.isnan(squares)
    best = np.argmin(np.where(none, np.inf, squares), axis=0)
    series = np.arange(squares.shape[1])
    return np.where(none[best, series], np.argmax(~none, axis=0), best)


def _grid() -> np.ndarray:
    return np.array(list(itertools.product(*GRID.values()))).T[:, :, None]


def _finer(best: np.ndarray) -> np.ndarray:
    """Level and season factors round the best ones (4 x series); trend and damping stay."""
    alpha, beta, gamma, phi = best
    near = lambda x, m: np.minimum(x * m, MOST)
    return np.stack([np.stack([near(alpha, a), beta, near(gamma, g), phi]) for a in FINER for g in FINER], axis=1)


def fits(y: np.ndarray, n: np.ndarray) -> Folded:
    """Factors, last state and sums of the best fit of each series, in columns as ``fold`` takes them."""
    series = np.arange(y.shape[1])
    grid = _grid()
    coarse = grid[:, _least(fold(y, n, grid, squares_only=True)["squares"]), 0]
    finer = _finer(coarse)
    end = fold(y, n, finer)
    best = _least(end["squares"])
    return {k: v[best, series] for k, v in end.items()} | dict(zip(FACTORS, finer[:, best, series]))


def _fit(values: pa.Array) -> pa.Array:
    """Fits of a batch of series (nulls: none), some at a time, of about equal lengths."""
    n = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.cumsum(n) - n
    flat = pc.fill_null(values.flatten(), 0.0).to_numpy(zero_copy_only=False)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] >= 2 * SEASON]
    out = {c: np.zeros(len(values)) for c in ("squares", *FACTORS, *END)}
    for lo in range(0, len(order), AT_ONCE):
        some = order[lo : lo + AT_ONCE]
        size = n[some]
        y = np.zeros((size[0], len(some)))
        day = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        y[day, np.repeat(np.arange(len(some)), size)] = flat[np.repeat(offsets[some], size) + day]
        with np.errstate(all="ignore"):
            for c, v in fits(y, size).items():
                out[c][some] = v
    none = pa.array(n < 2 * SEASON)
    end = pa.StructArray.from_arrays([pa.array(out[c]) for c in END], names=list(END))
    return pa.StructArray.from_arrays([*(pa.array(out[c]) for c in ("squares", *FACTORS)), end], names=["squares", *FACTORS, "end"], mask=none)


def with_holt_winters(series: DataFrame) -> DataFrame:
    """Adds ``fit`` to series (y, n): factors, last state and sums; null below two seasons."""
    fit = F.arrow_udf(_fit, FIT)
    return series.withColumn("fit", fit(F.when(F.col("n") >= 2 * SEASON, F.col("y").cast("array<double>"))))


def residual_spread() -> Column:
    """Population standard deviation of the errors of ``fit``."""
    end, n = F.col("fit.end"), F.col("n")
    mean = end["error"] / n
    return F.sqrt(F.greatest(end["squares"] / n - mean * mean, F.lit(0.0)))


def fit_mape() -> Column:
    """Mean absolute error in percent of the values other than 0, 100 at most."""
    sold = F.size(F.filter("y", lambda v: v != 0))
    return F.when(sold > 0, F.least(100 * F.col("fit.end.percent") / sold, F.lit(100.0))).otherwise(100.0)


def holt_winters_steps(horizon: int = SEASON) -> Column:
    """Array of (step, forecast, lower, upper) of ``fit`` for the next days, none below 0."""
    fit, width = F.col("fit"), Z95 * residual_spread()
    steps, damping = [], F.lit(0.0)
    for k in range(horizon):
        damping = fit["phi"] * (1 + damping)
        value = F.greatest(fit["end"]["level"] + damping * fit["end"]["trend"] + fit["end"][SEASONS[k % SEASON]], F.lit(0.0))
        steps.append(F.struct(F.lit(k + 1).alias("step"), value.alias("forecast"), F.greatest(value - width, F.lit(0.0)).alias("lower"), (value + width).alias("upper")))
    return F.array(*steps)
