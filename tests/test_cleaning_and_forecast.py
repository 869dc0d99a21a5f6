"""Literal cases of cleaning, forecasts and decisions."""

import pytest
from pyspark.sql import functions as F

from pantrylens.operators import cleaning, forecast, recommend


def bands(spark, values):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, t int, v double")
    return forecast.with_tuned_bands(forecast.as_series(rows, ["k"], "t", "v")).first()


def test_column_with_a_zero_time_is_left_as_it_is(spark):
    df = spark.createDataFrame([(1, 0), (2, 1600000000), (3, 1600000001)], "id int, created long")
    assert [r.created for r in cleaning.epoch_to_timestamp(df, ["created"]).orderBy("id").collect()] == [0, 1600000000, 1600000001]


def test_epoch_seconds_and_millis(spark):
    df = spark.createDataFrame([(1600000000, 1600000000000, None)], "a long, b long, c long")
    out = cleaning.epoch_to_timestamp(df, ["a", "b", "c"])
    assert dict(out.dtypes) == {"a": "timestamp", "b": "timestamp", "c": "bigint"}
    assert out.where("a = b").count() == 1


def test_unrelated_time_column_keeps_its_values(spark):
    df = spark.createDataFrame([(1, 5), (2, 9)], "id int, lead_time_days long")
    assert {r.lead_time_days for r in cleaning.clean_table(df).collect()} == {5, 9}


def test_forward_fill_needs_key_and_time(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, None)], "k int, t int, price double")
    with pytest.raises(ValueError):
        cleaning.clean_table(df, strategy="forward_fill")
    out = cleaning.clean_table(df, time_columns=[], strategy="forward_fill", key="k", time="t")
    assert [r.price for r in out.orderBy("t").collect()] == [2.0, 2.0]


def test_single_point_bands(spark):
    row = bands(spark, [10])
    assert tuple(row.smooth) == (10.0, 1.0, 40.0)
    assert tuple(row.erratic) == (10.0, 0.0, 60.0)
    assert tuple(row.weighted) == (10.0, 0.0, 20.0)


def test_series_without_demand(spark):
    row = bands(spark, [0, 0, 0])
    assert tuple(row.croston_sba) == (0.3, 0.0, 2.0)
    assert tuple(row.tsb) == (0.25, 0.0, 3.0)


def test_weighted_mean_follows_the_trend(spark):
    row = bands(spark, [1, 2, 3])
    assert row.weighted.forecast == pytest.approx((1 + 4 + 9) / 6 + 0.5)


def test_croston_of_regular_demand(spark):
    row = bands(spark, [4, 0, 4, 0, 4])
    assert row.croston_sba.forecast == pytest.approx(4 / 2 * 0.925)


def test_prep_units(spark):
    sizes = [0.5, 3.4, 12.0, 34.0, 90.0]
    df = spark.createDataFrame([(x,) for x in sizes], "q double")
    assert [r.u for r in df.select(recommend.prep_unit(F.col("q")).alias("u")).collect()] == [0.0, 3.0, 10.0, 30.0, 100.0]
