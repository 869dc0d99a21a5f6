"""Demand pattern classes from average demand interval (ADI) and squared variation (CV2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.operators.demand import PAIR

# Class thresholds.
ADI_THRESHOLD = 1.32
CV2_THRESHOLD = 0.49


def class_of(non_zero: Column, adi: Column, cv2: Column, enough: int = 2, strict: bool = False) -> Column:
    regular = adi < ADI_THRESHOLD if strict else adi <= ADI_THRESHOLD
    stable = cv2 < CV2_THRESHOLD if strict else cv2 <= CV2_THRESHOLD
    return (
        F.when(non_zero < enough, "Insufficient Data")
        .when(regular & stable, "Smooth")
        .when(regular, "Erratic")
        .when(stable, "Intermittent")
        .otherwise("Lumpy")
    )


def _sizes(total: Column, spread) -> list[Column]:
    sold = F.when(F.col("demand") > 0, F.col("demand"))
    when = F.when(F.col("demand") > 0, F.col("week_start"))
    return [
        total.alias("total_weeks"),
        F.count(sold).alias("non_zero_weeks"),
        F.avg(sold).alias("mean_size"),
        F.coalesce(spread(sold), F.lit(0.0)).alias("std_size"),
        F.min(when).alias("first_demand"),
        F.max(when).alias("last_demand"),
    ]


def _classified(stats: DataFrame, **rule) -> DataFrame:
    adi = F.try_divide(F.col("total_weeks").cast("double"), F.col("non_zero_weeks"))
    cv2 = F.pow(F.try_divide("std_size", "mean_size"), F.lit(2.0))
    return (
        stats.withColumn("adi", adi)
        .withColumn("cv2", cv2)
        .withColumn("demand_type", class_of(F.col("non_zero_weeks"), F.col("adi"), F.col("cv2"), **rule))
    )


def sbc_classify(weekly: DataFrame) -> DataFrame:
    """Class per pair on the complete calendar.

    Empty weeks change nothing but the number of weeks, which is the calendar length, so the
    observed weeks are enough and the calendar is never expanded.
    """
    span = weekly.agg((F.datediff(F.max("week_start"), F.min("week_start")) / 7 + 1).cast("bigint")).scalar()
    stats = weekly.groupBy(*PAIR).agg(*_sizes(F.max(span), F.stddev_samp))
    return _classified(stats)


def sbc_series(series: DataFrame, keys: list[str], adi: float = ADI_THRESHOLD, cv2: float = CV2_THRESHOLD) -> DataFrame:
    """Class of each series as given (``demand`` rows per key), thresholds as parameters."""
    sold = F.when(F.col("demand") > 0, F.col("demand"))
    stats = series.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.count(sold).alias("non_zero"),
        F.coalesce(F.stddev_samp(sold) / F.avg(sold), F.lit(0.0)).alias("cv"),
    )
    interval, spread = F.try_divide(F.col("points").cast("double"), F.col("non_zero")), F.col("cv") * F.col("cv")
    label = (
        F.when(F.col("non_zero") < 2, "Insufficient Data")
        .when((interval <= adi) & (spread <= cv2), "Smooth")
        .when(interval <= adi, "Erratic")
        .when(spread <= cv2, "Intermittent")
        .otherwise("Lumpy")
    )
    return stats.select(*keys, "points", "non_zero", label.alias("demand_type"))


def sbc_dashboard(weekly: DataFrame) -> DataFrame:
    """Strict thresholds, population deviation, four points needed, weeks as observed."""
    stats = weekly.groupBy(*PAIR).agg(*_sizes(F.count("*"), F.stddev_pop))
    out = _classified(stats, strict=True)
    few = (F.col("total_weeks") < 4) | (F.col("non_zero_weeks") < 2)
    return out.withColumn("demand_type", F.when(few, "Insufficient Data").otherwise(F.col("demand_type")))


def weeks_active() -> Column:
    """Weeks from the first to the last week with demand, 0 without any."""
    return F.coalesce(F.floor(F.datediff("last_demand", "first_demand") / 7) + 1, F.lit(0)).cast("bigint")


def class_distribution(classes: DataFrame) -> DataFrame:
    """Pairs and share per class, overall (null place) and per place, in one pass."""
    place, kind = F.col("place_id"), F.col("demand_type")
    counts = (
        classes.groupingSets([[place, kind], [kind]], place, kind)
        .agg(F.grouping("place_id").alias("overall"), F.count("*").alias("pairs"))
    )
    totals = counts.groupBy(F.col("overall").alias("o"), F.col("place_id").alias("p")).agg(F.sum("pairs").alias("all"))
    same = (F.col("o") == F.col("overall")) & F.col("p").eqNullSafe(F.col("place_id"))
    return counts.join(totals, same).select(
        F.when(F.col("overall") == 1, "overall").otherwise("place").alias("level"),
        "place_id",
        "demand_type",
        "pairs",
        (100.0 * F.col("pairs") / F.col("all")).alias("share_pct"),
    )
