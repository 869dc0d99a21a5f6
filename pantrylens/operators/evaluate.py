"""Accuracy of forecasts and of what follows from them, on weeks that the forecasts have not seen.

``prefixes`` cuts every series at several origins within its own row, so that a backtest of all forecasters needs no
shuffle before its sums; sums are combined before they are shuffled. Ratios to a sum of 0 are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.functions.series import array_mean, demand_sizes, square_sum
from pantrylens.operators.classify import class_of
from pantrylens.operators.forecast import with_tuned_bands, with_weekly_bands
from pantrylens.operators.health import risk_flag
from pantrylens.operators.recommend import discount_of, urgency_of

# Targets of the error in percent by class, of risk and coverage in percent, and of the correlation.
WAPE_TARGETS = {"Smooth": 20.0, "Erratic": 30.0, "Intermittent": 40.0, "Lumpy": 50.0}
WAPE_GOAL, RISK_GOAL, COVERAGE_GOAL, CORRELATION_GOAL, ENOUGH_GOALS = 30.0, 80.0, 80.0, 0.7, 3
HORIZON, ORIGINS, LEAST = 4, 4, 8
#: Forecasters of weekly series that need nothing but the series, and the column of their band.
METHODS = {
    "moving_average": "moving",
    "croston": "croston",
    "smooth_blend": "smooth",
    "erratic_blend": "erratic",
    "croston_sba": "croston_sba",
    "tsb_lumpy": "tsb",
    "weighted_ma_trend": "weighted",
}
BAND = ("forecast", "lower", "upper")


def prefixes(series: DataFrame, keys: Sequence[str], origins: int = ORIGINS, horizon: int = HORIZON) -> DataFrame:
    """(keys, origin, y, n, last, held): each series up to each origin, and the ``horizon`` values after it.

    Origin 1 leaves out the last ``horizon`` values, origin 2 twice as many. Prefixes of under eight values are left out.
    """
    cut = series.withColumn("origin", F.explode(F.sequence(F.lit(1), F.lit(origins))))
    cut = cut.withColumn("kept", F.col("n") - horizon * F.col("origin")).where(F.col("kept") >= LEAST)
    return cut.select(
        *keys,
        "origin",
        F.slice("y", F.lit(1), F.col("kept")).alias("y"),
        F.col("kept").alias("n"),
        F.date_sub("last", 7 * horizon * F.col("origin")).alias("last"),
        F.slice("y", F.col("kept") + 1, horizon).alias("held"),
    )


def series_class(y: Column) -> Column:
    """Demand class of a complete series."""
    sizes = demand_sizes(y)
    mean, k = array_mean(sizes), F.size(sizes)
    deviation = F.when(k > 1, F.sqrt(square_sum(sizes) / (k - 1))).otherwise(0.0)
    return class_of(k, F.try_divide(F.size(y).cast("double"), k), F.pow(F.try_divide(deviation, mean), F.lit(2.0)))


def backtest(series: DataFrame, keys: Sequence[str], origins: int = ORIGINS) -> DataFrame:
    """(keys, origin, demand_type, method, actual, forecast, lower, upper): every forecaster on every held-out week."""
    past = with_tuned_bands(with_weekly_bands(prefixes(series, keys, origins)).withColumn("demand_type", series_class(F.col("y"))))
    bands = F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(c)[x].alias(x) for x in BAND]) for m, c in METHODS.items()])
    told = past.select(*keys, "origin", "demand_type", "held", F.inline(bands))
    return told.select(*keys, "origin", "demand_type", "method", F.explode("held").alias("actual"), *BAND)


def _share(total: Column, of: Column) -> Column:
    return 100 * F.try_divide(total, of)


def accuracy(actual: str = "actual", forecast: str = "forecast") -> list[Column]:
    """Aggregates: n, wape, mape (weeks with demand), coverage, rmse and bias."""
    a, f = F.col(actual), F.col(forecast)
    return [
        F.count("*").alias("n"),
        _share(F.sum(F.abs(f - a)), F.sum(a)).alias("wape"),
        (100 * F.avg(F.when(a > 0, F.abs(f - a) / a))).alias("mape"),
        (100 * F.avg(F.when(a.between(F.col("lower"), F.col("upper")), 1.0).otherwise(0.0))).alias("coverage"),
        F.sqrt(F.avg((f - a) * (f - a))).alias("rmse"),
        _share(F.sum(f - a), F.sum(a)).alias("bias"),
    ]


def scored(rows: DataFrame, by: Sequence[str] = ("method",), kind: str = "demand_type") -> DataFrame:
    """Accuracy per ``by`` over all classes (class All) and for each, in one pass."""
    names = [F.col(c) for c in by]
    out = rows.groupingSets([[*names, F.col(kind)], names], *names, F.col(kind)).agg(F.grouping(kind).alias("every"), *accuracy())
    return out.withColumn(kind, F.when(F.col("every") == 1, "All").otherwise(F.col(kind))).drop("every")


def holdout(series: DataFrame, stock: DataFrame, keys: Sequence[str], item: str = "item_id") -> DataFrame:
    """One row per pair and held-out week: the class's tuned forecast, an independent expected one, and risk, discount and urgency by both."""
    past = with_tuned_bands(prefixes(series, keys, 1).withColumn("demand_type", series_class(F.col("y"))))
    model = (
        F.when(F.col("demand_type") == "Erratic", F.col("erratic"))
        .when(F.col("demand_type") == "Intermittent", F.col("croston_sba"))
        .when(F.col("demand_type") == "Lumpy", F.col("tsb"))
        .otherwise(F.col("smooth"))
    )
    weeks = past.select(*keys, "demand_type", "last", model.alias("m"), F.col("weighted.forecast").alias("expected"), F.posexplode("held").alias("step", "actual"))
    rows = weeks.select(*keys, F.date_add("last", 7 * (F.col("step") + 1)).alias("week_start"), "demand_type", "m.*", "expected", "actual")
    held = rows.join(stock.select(item, "current_stock", "days_to_expiry"), item)
    days = F.col("days_to_expiry")
    out = held
    for name, value in (("model", "forecast"), ("expected", "expected")):
        out = out.withColumn(f"{name}_risk", risk_flag(days, F.col("current_stock"), F.col(value)))
        out = out.withColumns({f"{name}_discount": discount_of(F.col(f"{name}_risk"), days), f"{name}_urgency": urgency_of(F.col(f"{name}_risk"))})
    return out


def forecast_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error against the expected forecast and against demand, where the expected one is above 0."""
    # without a filter, which would be moved below the forecasts and work them out once more
    e = F.when(F.col("expected") > 0, F.col("expected"))
    f, a = F.when(e.isNotNull(), F.col("forecast")), F.when(e.isNotNull(), F.coalesce("actual", F.lit(0.0)))
    return rows.groupBy(*by).agg(
        F.count(e).alias("n"),
        _share(F.sum(F.abs(f - e)), F.sum(e)).alias("wape"),
        _share(F.sum(F.abs(f - a)), F.sum(a)).alias("wape_actual"),
        (100 * F.avg(F.abs(f - e) / e)).alias("mape"),
        (100 * F.avg(F.when((a >= F.col("lower")) & (a <= F.col("upper")), 1.0).when(a.isNotNull(), 0.0))).alias("ci_coverage"),
        F.sqrt(F.avg((f - e) * (f - e))).alias("rmse"),
        _share(F.sum(f - e), F.sum(e)).alias("bias"),
    )


def metrics_by_class(rows: DataFrame) -> DataFrame:
    """``forecast_metrics`` over all and per class, with the class's target and whether it is met."""
    levels = rows.withColumn("demand_type", F.explode(F.array(F.lit("Overall"), F.col("demand_type"))))
    target = F.coalesce(F.create_map(*[F.lit(x) for pair in WAPE_TARGETS.items() for x in pair])[F.col("demand_type")], F.lit(WAPE_GOAL))
    known = F.col("demand_type").isin("Overall", *WAPE_TARGETS) & (F.col("n") > 0)
    out = forecast_metrics(levels, ["demand_type"]).where(known).withColumn("target", target)
    return out.withColumn("met", F.coalesce(F.col("wape") < F.col("target"), F.lit(False)))


def risk_accuracy(rows: DataFrame) -> DataFrame:
    """Per risk (and Overall): rows that should have it, rows given it, and the share of the former that were given it."""
    known = rows.where(F.col("expected_risk").isNotNull() & F.col("model_risk").isNotNull())
    counts = known.groupBy("expected_risk", "model_risk").count()
    hit = F.when(F.col("expected_risk") == F.col("model_risk"), F.col("count")).otherwise(0)
    sides = F.array(
        F.struct(F.col("expected_risk").alias("risk"), F.col("count").alias("actual"), F.lit(0).cast("long").alias("predicted"), hit.alias("right")),
        F.struct(F.col("model_risk").alias("risk"), F.lit(0).cast("long").alias("actual"), F.col("count").alias("predicted"), F.lit(0).cast("long").alias("right")),
        F.struct(F.lit("Overall").alias("risk"), F.col("count").alias("actual"), F.col("count").alias("predicted"), hit.alias("right")),
    )
    sums = [F.sum(c).alias(c) for c in ("actual", "predicted", "right")]
    return counts.select(F.inline(sides)).groupBy("risk").agg(*sums).withColumn("accuracy", _share(F.col("right"), F.col("actual")))


def urgency_correlation(rows: DataFrame) -> DataFrame:
    """Pearson's r of the two urgencies; 0 where one of them does not vary."""
    r = F.corr(F.col("expected_urgency").cast("double"), F.col("model_urgency").cast("double"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("urgency_correlation"))


def discount_alignment(rows: DataFrame) -> DataFrame:
    """Share of rows whose discounts differ by ten points at most; a missing one counts as none."""
    apart = F.abs(F.coalesce("expected_discount", F.lit(0)) - F.coalesce("model_discount", F.lit(0)))
    return rows.agg(F.count("*").alias("n"), (100 * F.avg(F.when(apart <= 10, 1.0).otherwise(0.0))).alias("discount_alignment"))


def output_quality(rows: DataFrame) -> DataFrame:
    """One row per rule of a sound result, with the rows that break it."""
    rules = {
        "forecast_not_negative": F.col("forecast") >= 0,
        "risk_present": F.col("model_risk").isNotNull(),
        "urgency_in_range": F.col("model_urgency").between(1, 10),
        "bounds_in_order": F.col("lower") <= F.col("upper"),
    }
    broken = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(n) for n, rule in rules.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return broken.select(F.inline(cells)).withColumn("passed", F.col("violations") == 0)


def doc_metrics(rows: DataFrame) -> DataFrame:
    """Mean absolute error, and the share of forecasts that demand reaches."""
    f, a = F.col("forecast"), F.col("actual")
    return rows.agg(F.avg(F.abs(f - a)).alias("mae"), (100 * F.avg(F.when(f <= a, 1.0).otherwise(0.0))).alias("hit_rate"))


def pass_fail(rows: DataFrame) -> DataFrame:
    """The four goals, and whether three of them are met."""
    share = lambda c: 100 * F.avg(F.when(c, 1.0).otherwise(0.0))
    some, e, f, a = F.col("expected") > 0, F.col("expected"), F.col("forecast"), F.col("actual")
    r = F.corr(F.col("expected_urgency").cast("double"), F.col("model_urgency").cast("double"))
    known = rows.agg(
        _share(F.sum(F.when(some, F.abs(f - e))), F.sum(F.when(some, e))).alias("wape"),
        share(F.col("expected_risk") == F.col("model_risk")).alias("risk_accuracy"),
        (100 * F.avg(F.when(some, F.when(a.between(F.col("lower"), F.col("upper")), 1.0).otherwise(0.0)))).alias("ci_coverage"),
        F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("urgency_correlation"),
    )
    met = [F.col("wape") < WAPE_GOAL, F.col("risk_accuracy") > RISK_GOAL, F.col("ci_coverage") > COVERAGE_GOAL, F.col("urgency_correlation") > CORRELATION_GOAL]
    goals = sum((F.coalesce(m, F.lit(False)).cast("int") for m in met), F.lit(0))
    return known.withColumn("goals_met", goals).withColumn("passed", F.col("goals_met") >= ENOUGH_GOALS)
