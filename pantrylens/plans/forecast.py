"""Forecast queries."""

from pyspark.sql import functions as F

from pantrylens.functions.series import exponential_smooth
from pantrylens.functions.stats import r4
from pantrylens.operators import classify, demand as d, forecast as f, holt_winters as hw
from pantrylens.plans.demand import weekly
from pantrylens.plans.registry import query
from pantrylens.plans.smoothing_sql import holt_winters_ctes

PAIR = ["place_id", "item_id"]


def _smoothed(values: str, alpha: float) -> str:
    return f"""CASE WHEN len({values}) > 0 THEN
    list_reduce({values}, lambda a, x: {alpha}::DOUBLE * x + {1 - alpha}::DOUBLE * a) END"""


CTES = {
    "day_lists": """
SELECT item_id, list(demand::DOUBLE ORDER BY date) AS y, max(date) AS last, count(*) AS n FROM daily_events GROUP BY 1""",
    "day_bands": """
SELECT *, list_avg(y[greatest(n - 6, 1):]) AS mean_recent, list_avg(y) AS mean,
  1.959963984540054 * CASE WHEN n > 1 THEN list_stddev_pop(y[greatest(n - 6, 1):]) ELSE 0.2 * mean_recent END AS width,
  greatest(0.5 * mean, 1) AS doubt FROM day_lists""",
    "week_lists": """
SELECT place_id, item_id, list(demand::DOUBLE ORDER BY week_start) AS y, max(week_start) AS last, count(*) AS n
FROM expanded GROUP BY 1, 2""",
    "week_sizes": """
SELECT *, list_filter(y, lambda x: x > 0) AS sizes, list_filter(range(1, n + 1), lambda i: y[i] > 0) AS spots,
  list_transform(range(1, len(spots)), lambda i: (spots[i + 1] - spots[i])::DOUBLE) AS gaps, y[2:] AS later FROM week_lists""",
    "week_bands": f"""
SELECT *, {_smoothed("sizes", 0.1)} AS size, {_smoothed("gaps", 0.1)} AS gap,
  greatest(round_even(CASE WHEN gap > 0 THEN size / gap ELSE list_avg(y) END, 0), 0) AS croston_value,
  greatest(round_even(list_avg(y[greatest(n - 3, 1):]), 0), 0) AS moving_value,
  1.5 * CASE WHEN n > 1 THEN list_stddev_pop(y[greatest(n - 3, 1):]) ELSE 0.3 * moving_value END AS width FROM week_sizes""",
    "tuned_stats": f"""
SELECT *, list_avg(y) AS mean, list_max(y) AS top, list_min(y) AS low, list_stddev_pop(y) AS std, list_median(y) AS mid,
  list_avg(y[greatest(n - 3, 1):]) AS mean_recent, len(sizes) AS k, {_smoothed("sizes", 0.15)} AS size,
  {_smoothed("gaps", 0.15)} AS gap, list_avg(sizes) AS size_mean, list_stddev_pop(sizes) AS size_std,
  list_max(sizes) - list_min(sizes) AS size_range, [list_avg(sizes)] || list_filter(later, lambda x: x > 0) AS size_path,
  [len(sizes)::DOUBLE / n] || list_transform(later, lambda x: CASE WHEN x > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS chance_path,
  y[greatest(n - 5, 1):] AS six FROM week_sizes""",
    "tuned_values": f"""
SELECT *, 0.5 * mean + 0.35 * mean_recent + 0.15 * top
    + CASE WHEN n >= 3 THEN 0.4 * greatest((y[n] - y[1]) / (n - 1), 0) ELSE 0 END AS f_smooth,
  greatest(0.4 * mean + 0.3 * mid + 0.18 * top, 0.9 * mean) AS f_erratic, size / greatest(gap, 1) * 0.925 AS f_croston,
  {_smoothed("size_path", 0.15)} * {_smoothed("chance_path", 0.15)} AS f_tsb,
  list_sum(list_transform(six, lambda x, i: x * i)) / (len(six) * (len(six) + 1) / 2)
    + CASE WHEN n >= 3 THEN (y[n] - y[n - 2]) / 4 ELSE 0 END AS f_weighted FROM tuned_stats""",
    "tuned_bands": """
SELECT place_id, item_id, last,
  CASE WHEN n = 1 THEN [mean, 0.1 * mean, 4 * mean] ELSE [f_smooth, greatest(f_smooth - greatest(5 * std, 1.2 * (top - low), 0.7 * f_smooth), 0),
    f_smooth + 1.5 * greatest(5 * std, 1.2 * (top - low), 0.7 * f_smooth)] END AS smooth,
  CASE WHEN n = 1 THEN [mean, 0, 6 * mean] ELSE [f_erratic, 0,
    greatest(1.8 * top, f_erratic + 1.8 * greatest(6 * std, 1.8 * (top - low), 0.9 * f_erratic))] END AS erratic,
  CASE WHEN k < 2 THEN [0.3 * coalesce(size_mean, 1), 0, 2 * coalesce(size_mean, 1)] ELSE [f_croston, 0,
    f_croston + 1.5 * greatest(5 * size_std, size_range, 0.8 * f_croston)] END AS croston_sba,
  CASE WHEN k < 2 THEN [0.25 * coalesce(size_mean, 1), 0, 3 * coalesce(size_mean, 1)] ELSE [f_tsb, 0,
    f_tsb + 2 * greatest(6 * size_std, 1.5 * size_range, f_tsb)] END AS tsb,
  CASE WHEN n = 1 THEN [mean, 0, 2 * mean] ELSE [greatest(f_weighted, 0), greatest(f_weighted - greatest(4 * std, 0.5 * f_weighted), 0),
    f_weighted + greatest(4 * std, 0.5 * f_weighted)] END AS weighted FROM tuned_values""",
}

CTES |= holt_winters_ctes("hw", "day_lists")
CTES["sparse_lists"] = """
SELECT item_id, list(demand ORDER BY date) AS y, max(date) AS last, count(*) AS n FROM (
  SELECT l_partkey * 1000 + l_suppkey % 1000 AS item_id, l_shipdate::DATE AS date, sum(l_quantity)::DOUBLE AS demand FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
CTES["sparse_bands"] = CTES["day_bands"].replace("day_lists", "sparse_lists")


def q(name, sql):
    return query(name, sql, CTES)


def daily_series(b):
    return f.as_series(b.daily_events, ["item_id"], "date", "demand")


def weekly_series(b):
    return f.as_series(d.expand_full_calendar(weekly(b)), PAIR, "week_start", "demand")


def band_columns(band: str):
    return [r4(F.col(band)[c]).alias(c) for c in ("forecast", "lower", "upper")]


def _ahead(source: str, keys: str, time: str, days: int, horizon: int, *values: str) -> str:
    named = ", ".join(f"round({v}, 4) AS {n}" for v, n in zip(values, ("forecast", "lower", "upper"), strict=True))
    return f"SELECT {keys}, (last + {days} * step::INTEGER)::DATE AS {time}, {named} FROM {source}, range(1, {horizon + 1}) t(step)"


@q(
    "route_by_length",
    """SELECT item_id, n, CASE WHEN n >= 14 THEN 'holt_winters' WHEN n >= 3 THEN 'moving_average' ELSE 'insufficient_data' END AS method
FROM day_lists""",
)
def _(b):
    return daily_series(b).select("item_id", F.col("n").cast("bigint").alias("n"), f.daily_method().alias("method"))


MOVING_SQL = _ahead(
    "(SELECT * FROM day_bands WHERE n BETWEEN 3 AND 13)", "item_id", "date", 1, 7,
    "mean_recent", "greatest(mean_recent - width, 0)", "mean_recent + width",
)
INSUFFICIENT_SQL = _ahead(
    "(SELECT * FROM day_bands WHERE n < 3)", "item_id", "date", 1, 7, "mean", "greatest(mean - doubt, 0)", "mean + doubt"
)
FITTED_SQL = "SELECT item_id, date, round(forecast, 4) AS forecast, round(lower, 4) AS lower, round(upper, 4) AS upper FROM hw_steps"


def rounded_bands(df):
    return df.withColumns({c: r4(c) for c in ("forecast", "lower", "upper")})


def daily_by(b, method):
    """Forecasts of the series that go to one method."""
    routed = daily_series(b).where(f.daily_method() == method)
    return rounded_bands(f.daily_forecasts(routed, ["item_id"])).drop("method")


@q("holt_winters_daily", FITTED_SQL)
def _(b):
    return daily_by(b, "holt_winters")


@q(
    "moving_average_daily",
    _ahead("day_bands", "item_id", "date", 1, 7, "mean_recent", "greatest(mean_recent - width, 0)", "mean_recent + width"),
)
def _(b):
    """Of every series, whatever its length; those that go to this method alone are in ``forecast_long``."""
    bands = f.with_daily_bands(daily_series(b)).select("item_id", "last", *band_columns("moving"))
    return f.steps_ahead(bands, ["item_id"], 7, 1, "date", "forecast", "lower", "upper")


@q("insufficient_daily", INSUFFICIENT_SQL.replace("day_bands", "sparse_bands"))
def _(b):
    """Of parts by supplier, most of which were sold on one or two days."""
    sold = b.supplier_lines.select((F.col("item_id") * 1000 + F.col("place_id") % 1000).alias("item_id"), F.to_date("created").alias("date"), "quantity")
    daily = sold.groupBy("item_id", "date").agg(F.sum("quantity").alias("demand"))
    routed = f.as_series(daily, ["item_id"], "date", "demand").where(f.daily_method() == "insufficient_data")
    return rounded_bands(f.daily_forecasts(routed, ["item_id"])).drop("method")


@q(
    "forecast_long",
    f"""SELECT *, 'holt_winters' AS method FROM ({FITTED_SQL}) UNION ALL SELECT *, 'moving_average' FROM ({MOVING_SQL})
UNION ALL SELECT *, 'insufficient_data' FROM ({INSUFFICIENT_SQL})""",
)
def _(b):
    return rounded_bands(f.daily_forecasts(daily_series(b), ["item_id"]))


@q(
    "fit_mape",
    """SELECT item_id, n, CASE WHEN sold > 0 THEN least(round(100 * share / sold, 4), 100) ELSE 100 END AS mape, round(spread, 4) AS spread
FROM hw_fit""",
)
def _(b):
    fitted = hw.with_holt_winters(daily_series(b).where(f.daily_method() == "holt_winters"))
    return fitted.select("item_id", F.col("n").cast("bigint").alias("n"), r4(hw.fit_mape()).alias("mape"), r4(hw.residual_spread()).alias("spread"))


@q("exp_smoothing", f"SELECT place_id, item_id, round({_smoothed('y', 0.1)}, 4) AS level FROM week_lists")
def _(b):
    level = exponential_smooth(F.col("y"), f.CROSTON_ALPHA)
    return weekly_series(b).select(*PAIR, r4(level).alias("level"))


@q(
    "croston_weekly",
    _ahead(
        "week_bands", "place_id, item_id", "week_start", 7, 4,
        "croston_value", "floor(0.5 * croston_value)", "floor(1.5 * croston_value)",
    ),
)
def _(b):
    bands = f.with_weekly_bands(weekly_series(b)).select(*PAIR, "last", *band_columns("croston"))
    return f.steps_ahead(bands, PAIR, 4, 7, "week_start", "forecast", "lower", "upper")


@q(
    "moving_average_weekly",
    _ahead(
        "week_bands", "place_id, item_id", "week_start", 7, 4,
        "moving_value", "greatest(trunc(moving_value - width), 0)", "trunc(moving_value + width)",
    ),
)
def _(b):
    bands = f.with_weekly_bands(weekly_series(b)).select(*PAIR, "last", *band_columns("moving"))
    return f.steps_ahead(bands, PAIR, 4, 7, "week_start", "forecast", "lower", "upper")


def _tuned(name: str, band: str) -> None:
    sql = f"SELECT place_id, item_id, round({band}[1], 4) AS forecast, round({band}[2], 4) AS lower, round({band}[3], 4) AS upper FROM tuned_bands"

    @q(name, sql)
    def _(b):
        return f.with_tuned_bands(weekly_series(b)).select(*PAIR, *band_columns(band))


for _name, _band in [
    ("smooth_blend", "smooth"),
    ("erratic_blend", "erratic"),
    ("croston_sba", "croston_sba"),
    ("tsb_lumpy", "tsb"),
    ("weighted_ma_trend", "weighted"),
]:
    _tuned(_name, _band)


@q(
    "route_tuned",
    """SELECT place_id, item_id, demand_type, round(band[1], 4) AS forecast, round(band[2], 4) AS lower, round(band[3], 4) AS upper
FROM (SELECT place_id, item_id, demand_type, CASE demand_type WHEN 'Erratic' THEN erratic WHEN 'Intermittent' THEN croston_sba
    WHEN 'Lumpy' THEN tsb ELSE smooth END AS band FROM tuned_bands JOIN sbc USING (place_id, item_id))""",
)
def _(b):
    kinds = classify.sbc_classify(weekly(b)).select(*PAIR, "demand_type")
    routed = f.with_tuned_bands(weekly_series(b)).join(kinds, PAIR)
    return routed.withColumn("band", f.tuned_by_class(F.col("demand_type"))).select(*PAIR, "demand_type", *band_columns("band"))


@q(
    "order_quantity",
    """SELECT item_id, current_stock, round(avg_daily, 4) AS avg_daily, round(CASE WHEN current_stock <= 5 * avg_daily
  THEN greatest(14 * avg_daily - current_stock, 0) ELSE 0 END, 4) AS order_quantity
FROM dim_stock JOIN (SELECT item_id, avg(demand_quantity) AS avg_daily FROM daily_item GROUP BY 1) USING (item_id)""",
)
def _(b):
    daily = d.demand_per_item(b.lines, b.orders).groupBy("item_id").agg(F.avg("demand_quantity").alias("avg_daily"))
    need = F.greatest(14 * F.col("avg_daily") - F.col("current_stock"), F.lit(0.0))
    order = F.when(F.col("current_stock") <= 5 * F.col("avg_daily"), need).otherwise(0.0)
    return b.stock.join(daily, "item_id").select(
        "item_id", "current_stock", r4("avg_daily").alias("avg_daily"), r4(order).alias("order_quantity")
    )
