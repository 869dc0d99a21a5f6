"""Window feature queries."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4, r8
from pantrylens.holidays import FIXED_DATE_HOLIDAYS, fixed_date_holidays
from pantrylens.operators import classify, demand as d, features as f
from pantrylens.plans.demand import weekly
from pantrylens.plans.registry import query

TRAIN_END, VAL_END = "1999-12-31", "2000-12-31"
KEYS = "place_id, item_id, week_start"
W = "OVER (PARTITION BY place_id, item_id ORDER BY week_start"
PAST4 = W + " ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"
PAST = W + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

HOLIDAY_CTE = {
    "fixed_holidays": """SELECT make_date(y::BIGINT, m, d) AS date, name, impact FROM (SELECT unnest(range(a, z + 2)) AS y FROM (
  SELECT year(min(o_orderdate)) AS a, year(max(o_orderdate)) AS z FROM orders)), (VALUES """
    + ", ".join(f"({m}, {d}, '{n}', {i}::DOUBLE)" for m, d, n, i in FIXED_DATE_HOLIDAYS)
    + ") h(m, d, name, impact)",
    "feat": f"""
SELECT {KEYS}, demand, avg_price, coalesce(lag(demand, 1) {W}), 0) AS lag_1w, coalesce(lag(demand, 2) {W}), 0) AS lag_2w,
  coalesce(lag(demand, 4) {W}), 0) AS lag_4w, coalesce(lag(demand, 52) {W}), 0) AS lag_52w,
  coalesce(avg(demand) {PAST4}, 0) AS roll_mean_4w, coalesce(stddev_samp(demand) {PAST4}, 0) AS roll_std_4w,
  coalesce(max(demand) {PAST4}, 0) AS roll_max_4w, coalesce(min(demand) {PAST4}, 0) AS roll_min_4w,
  coalesce(avg(demand) {W} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), 0) AS roll_mean_13w,
  1 - coalesce(count(*) FILTER (demand > 0) {PAST}, 0) / greatest(row_number() {W}) - 1, 1)::DOUBLE AS zero_demand_ratio,
  coalesce(date_diff('day', max(CASE WHEN demand > 0 THEN week_start END) {PAST}, week_start) // 7, 0) AS days_since_demand,
  sum(CASE WHEN demand > 0 THEN 0 ELSE 1 END) {W}) AS island,
  CASE WHEN avg_price = lag(avg_price) {W}) THEN 0 ELSE 1 END AS price_change_flag
FROM expanded""",
    "streaks": f"""
SELECT {KEYS}, CASE WHEN demand > 0 THEN count(*) FILTER (demand > 0) OVER (PARTITION BY place_id, item_id, island ORDER BY week_start)
  ELSE 0 END AS demand_streak FROM feat""",
    "holiday_weeks": "SELECT DISTINCT date_trunc('week', date)::DATE AS week_start FROM fixed_holidays",
}


def series(b):
    return d.expand_full_calendar(weekly(b))


def holidays(b):
    return fixed_date_holidays(b.spark, b.raw("orders"), "o_orderdate")


def q(name, sql):
    return query(name, sql, HOLIDAY_CTE)


@q("lag_features", f"SELECT {KEYS}, demand, lag_1w, lag_2w, lag_4w, lag_52w FROM feat")
def _(b):
    return f.lag_features(series(b)).select("place_id", "item_id", "week_start", "demand", "lag_1w", "lag_2w", "lag_4w", "lag_52w")


@q(
    "rolling_4w",
    f"SELECT {KEYS}, round(roll_mean_4w, 4) AS roll_mean_4w, round(roll_std_4w, 4) AS roll_std_4w, roll_max_4w, roll_min_4w FROM feat",
)
def _(b):
    return f.rolling_features(series(b)).select(
        "place_id", "item_id", "week_start", r4("roll_mean_4w").alias("roll_mean_4w"), r4("roll_std_4w").alias("roll_std_4w"),
        "roll_max_4w", "roll_min_4w",
    )


@q("rolling_13w", f"SELECT {KEYS}, round(roll_mean_13w, 4) AS roll_mean_13w FROM feat")
def _(b):
    return f.rolling_mean(series(b), 13).select("place_id", "item_id", "week_start", r4("roll_mean_13w").alias("roll_mean_13w"))


@q("zero_demand_ratio", f"SELECT {KEYS}, round(zero_demand_ratio, 8) AS zero_demand_ratio FROM feat")
def _(b):
    return f.zero_demand_ratio(series(b)).select(
        "place_id", "item_id", "week_start", r8("zero_demand_ratio").alias("zero_demand_ratio")
    )


@q("weeks_since_demand", f"SELECT {KEYS}, days_since_demand FROM feat")
def _(b):
    return f.weeks_since_demand(series(b)).select("place_id", "item_id", "week_start", "days_since_demand")


@q(
    "demand_streak",
    f"""SELECT {KEYS}, demand_streak, coalesce(lag(demand_streak) {W}), 0) AS demand_streak_lag FROM streaks""",
)
def _(b):
    out = f.lagged_streak(f.demand_streak(series(b)))
    return out.select("place_id", "item_id", "week_start", "demand_streak", "demand_streak_lag")


@q(
    "cv_rolling",
    f"SELECT {KEYS}, round(roll_std_4w / CASE WHEN roll_mean_4w = 0 THEN 1 ELSE roll_mean_4w END, 4) AS cv_rolling FROM feat",
)
def _(b):
    return f.cv_rolling(f.rolling_features(series(b))).select("place_id", "item_id", "week_start", r4("cv_rolling").alias("cv_rolling"))


@q("price_change_flag", f"SELECT {KEYS}, round(avg_price, 8) AS avg_price_week, price_change_flag FROM feat")
def _(b):
    return f.price_change_flag(series(b)).select(
        "place_id", "item_id", "week_start", r8("avg_price_week").alias("avg_price_week"), "price_change_flag"
    )


CALENDAR_SQL = """(isodow({c}) - 1)::INTEGER AS day_of_week, weekofyear({c})::INTEGER AS week_of_year, month({c})::INTEGER AS month, 0 AS is_weekend"""


@q("calendar_features", "SELECT DISTINCT o_orderdate::DATE AS date, " + CALENDAR_SQL.format(c="o_orderdate") + " FROM orders")
def _(b):
    days = b.raw("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return f.calendar_features(days, "date")


@q(
    "holiday_week_flag",
    """SELECT DISTINCT week_start, CASE WHEN EXISTS (SELECT 1 FROM fixed_holidays h WHERE h.date >= w.week_start
  AND h.date <= w.week_start + INTERVAL 6 DAY) THEN 1 ELSE 0 END AS is_holiday FROM weekly w""",
)
def _(b):
    return f.holiday_week_flag(weekly(b).select("week_start").distinct(), holidays(b))


@q(
    "temporal_split",
    f"""SELECT {KEYS}, CASE WHEN week_start <= DATE '{TRAIN_END}' THEN 'train' WHEN week_start <= DATE '{VAL_END}' THEN 'val'
  ELSE 'test' END AS train_val_test_flag FROM expanded""",
)
def _(b):
    return f.temporal_split(series(b), TRAIN_END, VAL_END).select("place_id", "item_id", "week_start", "train_val_test_flag")


@q(
    "split_last_4w",
    f"""SELECT {KEYS}, CASE WHEN week_start <= m THEN 'train' ELSE 'test' END AS train_val_test_flag, week_start > m AS is_future
FROM expanded, (SELECT max(week_start) - INTERVAL 28 DAY AS m FROM weekly)""",
)
def _(b):
    return f.split_last_weeks(series(b)).select("place_id", "item_id", "week_start", "train_val_test_flag", "is_future")


@q(
    "days_to_holiday",
    """SELECT date, next_holiday, date_diff('day', date, next_holiday) AS days_to_holiday FROM (
  SELECT d.date, (SELECT min(h.date) FROM fixed_holidays h WHERE h.date >= d.date) AS next_holiday
  FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) d)""",
)
def _(b):
    days = b.raw("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return f.days_to_holiday(days, holidays(b))


def features(b):
    return f.feature_matrix(series(b), classify.sbc_classify(weekly(b)), holidays(b), TRAIN_END, VAL_END)


FEATURES_SQL = f"""
SELECT f.place_id, f.item_id, f.week_start, f.demand, lag_1w, lag_2w, lag_4w, lag_52w, round(roll_mean_4w, 4) AS roll_mean_4w,
  round(roll_std_4w, 4) AS roll_std_4w, roll_max_4w, roll_min_4w, round(zero_demand_ratio, 8) AS zero_demand_ratio,
  days_since_demand, demand_streak, round(roll_std_4w / CASE WHEN roll_mean_4w = 0 THEN 1 ELSE roll_mean_4w END, 4) AS cv_rolling,
  round(avg_price, 8) AS avg_price_week, price_change_flag, {CALENDAR_SQL.format(c='f.week_start')},
  CASE WHEN h.week_start IS NULL THEN 0 ELSE 1 END AS is_holiday, sbc.demand_type,
  CASE WHEN f.week_start <= DATE '{TRAIN_END}' THEN 'train' WHEN f.week_start <= DATE '{VAL_END}' THEN 'val'
  ELSE 'test' END AS train_val_test_flag
FROM feat f JOIN streaks USING (place_id, item_id, week_start) JOIN sbc USING (place_id, item_id)
LEFT JOIN holiday_weeks h ON h.week_start = f.week_start"""


@q("feature_matrix", FEATURES_SQL)
def _(b):
    rounded = ["roll_mean_4w", "roll_std_4w", "cv_rolling"]
    return features(b).withColumns({c: r4(c) for c in rounded} | {c: r8(c) for c in ("zero_demand_ratio", "avg_price_week")})


@q(
    "ml_lag_frame",
    f"""SELECT {KEYS}, demand, lag_1, lag_2, lag_4, round(roll_mean, 4) AS roll_mean, round(roll_std, 4) AS roll_std FROM (
  SELECT {KEYS}, demand, lag(demand, 1) {W}) AS lag_1, lag(demand, 2) {W}) AS lag_2, lag(demand, 4) {W}) AS lag_4,
    avg(demand) {PAST4} AS roll_mean, stddev_samp(demand) {PAST4} AS roll_std, count(*) {PAST4} AS n FROM weekly_ai) WHERE n = 4""",
)
def _(b):
    from pantrylens.plans.demand import weekly_ai

    return f.ml_lag_frame(weekly_ai(b)).withColumns({c: r4(c) for c in ("roll_mean", "roll_std")})
