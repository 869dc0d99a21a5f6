"""Gradient-boosted trees on lags of weekly demand, and forecasts that feed on themselves.

One model learns from all series: Spark's trees are grown level by level from binned sums over all rows, so no
series has to fit in a task and the model's size depends on its parameters alone. A forecast of several weeks is as
many rounds of prediction, each of which shifts the last four values of a series by its own result.

Defined cases: rows without four earlier weeks teach nothing. A series of fewer than fourteen weeks, ten rows to
learn from, gets the moving average. With no rows at all there is no model, and every series gets the moving average.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.functions.series import array_mean
from pantrylens.operators.forecast import as_series, band, with_weekly_bands

LAGS = ["lag_1", "lag_2", "lag_4", "roll_mean", "roll_std"]
# Weeks in a feature window, least rows to learn from, band round a forecast.
WINDOW, LEAST_ROWS, BAND = 4, 10, 0.3


def learn(frame: DataFrame, rounds: int = 20, depth: int = 4, rate: float = 0.2, bins: int = 64) -> PipelineModel | None:
    """Trees that predict ``demand`` from the lag columns; None without rows."""
    if frame.isEmpty():
        return None
    trees = GBTRegressor(featuresCol="lags", labelCol="demand", maxIter=rounds, maxDepth=depth, stepSize=rate, maxBins=bins, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=LAGS, outputCol="lags"), trees]).fit(frame)


def lag_columns(tail: Column) -> dict[str, Column]:
    """The features of the week after the four values of ``tail``, as the training rows have them."""
    mean = array_mean(tail)
    squares = F.aggregate(tail, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean))
    at = {"lag_1": 3, "lag_2": 2, "lag_4": 0}
    return {n: F.get(tail, F.lit(k)) for n, k in at.items()} | {"roll_mean": mean, "roll_std": F.sqrt(squares / (WINDOW - 1))}


def predicted(model: PipelineModel, rows: DataFrame, tail: str) -> DataFrame:
    """``rows`` with ``demand_ahead``: the model's whole number for the week after ``tail``, 0 at least."""
    told = model.transform(rows.withColumns(lag_columns(F.col(tail))))
    return told.withColumn("demand_ahead", F.greatest(F.bround("prediction"), F.lit(0.0))).drop(*LAGS, "lags", "prediction")


def boosted_steps(model: PipelineModel | None, series: DataFrame, keys: Sequence[str], horizon: int = 4) -> DataFrame:
    """(keys, week_start, forecast, lower, upper, method) of the next weeks of ``series`` (y, n, last)."""
    rows = with_weekly_bands(series).select(*keys, "n", "last", F.col("moving"), F.slice("y", F.greatest(F.col("n") - WINDOW + 1, F.lit(1)), WINDOW).alias("tail"))
    able = F.col("n") >= LEAST_ROWS + WINDOW
    step = lambda k: F.date_add("last", 7 * k).alias("week_start")
    plain = rows if model is None else rows.where(~able)
    steps = F.array(*[F.struct(step(k), *[F.col("moving")[c].alias(c) for c in ("forecast", "lower", "upper")]) for k in range(1, horizon + 1)])
    out = plain.select(*keys, F.inline(steps), F.lit("moving_average").alias("method"))
    if model is None:
        return out
    learned = rows.where(able).withColumn("path", F.array().cast("array<double>"))
    for _ in range(horizon):
        learned = predicted(model, learned, "tail")
        learned = learned.withColumns(
            {"tail": F.concat(F.slice("tail", 2, WINDOW - 1), F.array("demand_ahead")), "path": F.concat("path", F.array("demand_ahead"))}
        ).drop("demand_ahead")
    value = lambda k: F.get("path", F.lit(k - 1))
    bands = [band(value(k), F.floor((1 - BAND) * value(k)).cast("double"), F.floor((1 + BAND) * value(k)).cast("double")) for k in range(1, horizon + 1)]
    steps = F.array(*[F.struct(step(k), *[b[c].alias(c) for c in ("forecast", "lower", "upper")]) for k, b in enumerate(bands, 1)])
    return out.unionByName(learned.select(*keys, F.inline(steps), F.lit("boosted_trees").alias("method")))


def history(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    return as_series(weekly, keys, "week_start", "demand")
