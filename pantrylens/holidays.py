"""Holiday calendar with demand impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Danish public holidays with their demand factors.
HOLIDAYS = [
    ("2024-01-01", "New Year", 0.2),
    ("2024-03-28", "Maundy Thursday", 0.7),
    ("2024-03-29", "Good Friday", 0.5),
    ("2024-03-31", "Easter Sunday", 0.3),
    ("2024-04-01", "Easter Monday", 0.5),
    ("2024-05-09", "Ascension Day", 0.7),
    ("2024-05-19", "Whit Sunday", 0.7),
    ("2024-05-20", "Whit Monday", 0.6),
    ("2024-06-05", "Constitution Day", 0.8),
    ("2024-12-24", "Christmas Eve", 0.2),
    ("2024-12-25", "Christmas Day", 0.1),
    ("2024-12-26", "Boxing Day", 0.4),
    ("2024-12-31", "New Year Eve", 0.3),
    ("2025-01-01", "New Year", 0.2),
    ("2025-04-17", "Maundy Thursday", 0.7),
    ("2025-04-18", "Good Friday", 0.5),
    ("2025-04-20", "Easter Sunday", 0.3),
    ("2025-04-21", "Easter Monday", 0.5),
    ("2025-05-29", "Ascension Day", 0.7),
    ("2025-06-08", "Whit Sunday", 0.7),
    ("2025-06-09", "Whit Monday", 0.6),
    ("2025-06-05", "Constitution Day", 0.8),
    ("2025-12-24", "Christmas Eve", 0.2),
    ("2025-12-25", "Christmas Day", 0.1),
    ("2025-12-26", "Boxing Day", 0.4),
    ("2025-12-31", "New Year Eve", 0.3),
    ("2026-01-01", "New Year", 0.2),
    ("2026-04-02", "Maundy Thursday", 0.7),
    ("2026-04-03", "Good Friday", 0.5),
    ("2026-04-05", "Easter Sunday", 0.3),
    ("2026-04-06", "Easter Monday", 0.5),
    ("2026-05-14", "Ascension Day", 0.7),
    ("2026-05-24", "Whit Sunday", 0.7),
    ("2026-05-25", "Whit Monday", 0.6),
    ("2026-06-05", "Constitution Day", 0.8),
    ("2026-12-24", "Christmas Eve", 0.2),
    ("2026-12-25", "Christmas Day", 0.1),
    ("2026-12-26", "Boxing Day", 0.4),
    ("2026-12-31", "New Year Eve", 0.3),
]

# Holidays on the same date every year, used for years without a listed calendar.
FIXED_DATE_HOLIDAYS = [
    (1, 1, "New Year", 0.2),
    (6, 5, "Constitution Day", 0.8),
    (12, 24, "Christmas Eve", 0.2),
    (12, 25, "Christmas Day", 0.1),
    (12, 26, "Boxing Day", 0.4),
    (12, 31, "New Year Eve", 0.3),
]

# Holiday dates of the feature pipeline.
FEATURE_HOLIDAYS = [
    "2021-01-01", "2021-04-01", "2021-04-02", "2021-04-04", "2021-04-05", "2021-05-13", "2021-05-23", "2021-05-24",
    "2021-06-05", "2021-12-24", "2021-12-25", "2021-12-26", "2021-12-31",
    "2022-01-01", "2022-04-14", "2022-04-15", "2022-04-17", "2022-04-18", "2022-05-13", "2022-05-26", "2022-06-05",
    "2022-06-06", "2022-12-24", "2022-12-25", "2022-12-26", "2022-12-31",
    "2023-01-01", "2023-04-06", "2023-04-07", "2023-04-09", "2023-04-10", "2023-05-05", "2023-05-18", "2023-05-28",
    "2023-05-29", "2023-12-24", "2023-12-25", "2023-12-26", "2023-12-31",
    "2024-01-01", "2024-03-28", "2024-03-29", "2024-03-31", "2024-04-01", "2024-05-09", "2024-05-19", "2024-05-20",
    "2024-12-24", "2024-12-25", "2024-12-26", "2024-12-31",
]


def listed_holidays(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(HOLIDAYS, "date string, name string, impact double")
    return rows.withColumn("date", F.to_date("date"))


def feature_holidays(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(day,) for day in FEATURE_HOLIDAYS], "date string")
    return rows.withColumn("date", F.to_date("date"))


def fixed_date_holidays(spark: SparkSession, dates: DataFrame, date: str) -> DataFrame:
    """The fixed-date holidays of every year that ``dates`` have, and of the year after."""
    days = spark.createDataFrame(FIXED_DATE_HOLIDAYS, "m int, d int, name string, impact double")
    years = F.sequence(dates.agg(F.year(F.min(date))).scalar(), dates.agg(F.year(F.max(date)) + 1).scalar())
    return days.withColumn("y", F.explode(years)).select(F.make_date("y", "m", "d").alias("date"), "name", "impact")
