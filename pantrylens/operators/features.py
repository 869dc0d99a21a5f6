"""Window and calendar features of a complete weekly series.

Every window shares one specification (partition by pair, order by week), so the whole
feature set costs one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pantrylens.operators.demand import PAIR

FEATURE_COLUMNS = [
    "place_id", "item_id", "week_start", "demand",
    "lag_1w", "lag_2w", "lag_4w", "lag_52w",
    "roll_mean_4w", "roll_std_4w", "roll_max_4w", "roll_min_4w",
    "zero_demand_ratio", "days_since_demand", "demand_streak", "cv_rolling",
    "avg_price_week", "price_change_flag",
    "day_of_week", "week_of_year", "month", "is_weekend", "is_holiday",
    "demand_type", "train_val_test_flag",
]


def series_window() -> WindowSpec:
    return Window.partitionBy(*PAIR).orderBy("week_start")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def lag_features(series: DataFrame, lags: tuple[int, ...] = (1, 2, 4, 52)) -> DataFrame:
    return series.withColumns({f"lag_{k}w": _or_zero(F.lag("demand", k).over(series_window())) for k in lags})


def rolling_features(series: DataFrame, weeks: int = 4) -> DataFrame:
    past = series_window().rowsBetween(-weeks, -1)
    stats = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    return series.withColumns({f"roll_{n}_{weeks}w": _or_zero(f("demand").over(past)) for n, f in stats.items()})


def rolling_mean(series: DataFrame, weeks: int) -> DataFrame:
    past = series_window().rowsBetween(-weeks, -1)
    return series.withColumn(f"roll_mean_{weeks}w", _or_zero(F.avg("demand").over(past)))


def zero_demand_ratio(series: DataFrame) -> DataFrame:
    past = series_window().rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.row_number().over(series_window()) - 1, F.lit(1))
    sold = F.count_if(F.col("demand") > 0).over(past)
    return series.withColumn("zero_demand_ratio", 1 - F.coalesce(sold, F.lit(0)) / seen)


def weeks_since_demand(series: DataFrame) -> DataFrame:
    """Weeks since the last earlier week with demand; 0 before the first one."""
    past = series_window().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("demand") > 0, F.col("week_start")), ignorenulls=True).over(past)
    weeks = F.floor(F.datediff("week_start", last) / 7)
    return series.withColumn("days_since_demand", F.coalesce(weeks, F.lit(0)).cast("bigint"))


def demand_streak(series: DataFrame) -> DataFrame:
    """Consecutive weeks with demand up to and including this one."""
    upto = series_window().rowsBetween(Window.unboundedPreceding, 0)
    position = F.row_number().over(series_window())
    gap = F.coalesce(F.max(F.when(F.col("demand") <= 0, F.col("position"))).over(upto), F.lit(0))
    return (
        series.withColumn("position", position)
        .withColumn("demand_streak", (F.col("position") - gap).cast("bigint"))
        .drop("position")
    )


def lagged_streak(series: DataFrame) -> DataFrame:
    """The streak known before the week starts; safe as a model input."""
    return series.withColumn("demand_streak_lag", F.coalesce(F.lag("demand_streak").over(series_window()), F.lit(0)))


def cv_rolling(series: DataFrame) -> DataFrame:
    mean = F.when(F.col("roll_mean_4w") == 0, F.lit(1.0)).otherwise(F.col("roll_mean_4w"))
    return series.withColumn("cv_rolling", F.col("roll_std_4w") / mean)


def price_change_flag(series: DataFrame) -> DataFrame:
    """1 when the price differs from last week's or either is unknown."""
    before = F.lag("avg_price").over(series_window())
    same = F.coalesce(F.col("avg_price") == before, F.lit(False))
    return series.withColumns({"avg_price_week": F.col("avg_price"), "price_change_flag": F.when(same, 0).otherwise(1)})


def calendar_features(df: DataFrame, date: str = "week_start") -> DataFrame:
    return df.withColumns(
        {
            "day_of_week": F.weekday(date),
            "week_of_year": F.weekofyear(date),
            "month": F.month(date),
            "is_weekend": F.lit(0),
        }
    )


def holiday_week_flag(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """1 when a holiday falls in the week; the calendar holds a few rows per year, so it is broadcast."""
    weeks = holidays.select(F.to_date(F.date_trunc("week", "date")).alias("week_start")).distinct()
    flags = F.broadcast(weeks.withColumn("is_holiday", F.lit(1)))
    return df.join(flags, "week_start", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))


def temporal_split(df: DataFrame, train_end: str, val_end: str, date: str = "week_start") -> DataFrame:
    split = (
        F.when(F.col(date) <= F.lit(train_end).cast("date"), "train")
        .when(F.col(date) <= F.lit(val_end).cast("date"), "val")
        .otherwise("test")
    )
    return df.withColumn("train_val_test_flag", split)


def split_last_weeks(df: DataFrame, weeks: int = 4) -> DataFrame:
    cut = F.date_sub(df.agg(F.max("week_start")).scalar(), 7 * weeks)
    past = F.col("week_start") <= cut
    return df.withColumns({"train_val_test_flag": F.when(past, "train").otherwise("test"), "is_future": ~past})


def days_to_holiday(dates: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """Days until the next holiday on or after each date, null after the last one.

    Each holiday owns the days since the one before it, so the lookup is an equi-join on the
    day instead of a range join.
    """
    days = holidays.select("date").distinct()
    previous = F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    first = dates.agg(F.min(date)).scalar()
    owned = days.withColumn("from", F.coalesce(F.date_add(previous, 1), F.least(first, F.col("date")))).select(
        F.explode(F.sequence("from", "date")).alias(date), F.col("date").alias("next_holiday")
    )
    return dates.join(F.broadcast(owned), date, "left").withColumn(
        "days_to_holiday", F.datediff("next_holiday", F.col(date)).cast("bigint")
    )


def pattern_features(series: DataFrame) -> DataFrame:
    """Lag, rolling, pattern and price features on one window."""
    out = series
    for step in (
        lag_features, rolling_features, zero_demand_ratio, weeks_since_demand, demand_streak, cv_rolling, price_change_flag,
    ):
        out = step(out)
    return out


def feature_matrix(
    series: DataFrame, classes: DataFrame, holidays: DataFrame, train_end: str, val_end: str
) -> DataFrame:
    out = temporal_split(holiday_week_flag(calendar_features(pattern_features(series)), holidays), train_end, val_end)
    out = out.join(classes.select(*PAIR, "demand_type"), PAIR, "left")
    out = out.withColumn("demand_type", F.coalesce("demand_type", F.lit("Insufficient Data")))
    return out.select(*FEATURE_COLUMNS)


def ml_lag_frame(series: DataFrame) -> DataFrame:
    """Lags 1, 2, 4 and the mean and deviation of four earlier weeks; incomplete rows are dropped."""
    past = series_window().rowsBetween(-4, -1)
    full = F.count("demand").over(past) == 4
    return series.select(
        *PAIR,
        "week_start",
        "demand",
        *[F.lag("demand", k).over(series_window()).alias(f"lag_{k}") for k in (1, 2, 4)],
        F.when(full, F.avg("demand").over(past)).alias("roll_mean"),
        F.when(full, F.stddev_samp("demand").over(past)).alias("roll_std"),
    ).dropna()
