"""Stock and health queries. Demand is the forecast of each stocked part for the next seven days."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4
from pantrylens.operators import demand as d, forecast as f, health as h
from pantrylens.plans.forecast import CTES as FORECAST_CTES, MOVING_SQL, INSUFFICIENT_SQL
from pantrylens.plans.registry import query
from pantrylens.plans.smoothing_sql import holt_winters_ctes

CTES = {
    **FORECAST_CTES,
    **holt_winters_ctes("parts", "part_lists"),
    "part_lists": "SELECT item_id, list(demand_quantity ORDER BY period) AS y, max(period) AS last, count(*) AS n FROM daily_item GROUP BY 1",
    "part_bands": FORECAST_CTES["day_bands"].replace("day_lists", "part_lists"),
    "part_forecast": f"""
SELECT item_id, date, round(forecast, 4) AS q FROM parts_steps
UNION ALL SELECT item_id, date, forecast FROM ({MOVING_SQL.replace("day_bands", "part_bands")})
UNION ALL SELECT item_id, date, forecast FROM ({INSUFFICIENT_SQL.replace("day_bands", "part_bands")})""",
    "item_summary": """
SELECT item_id, list_reduce(list(q ORDER BY date), lambda a, x: a + x) AS total_demand, date_diff('day', min(date), max(date)) + 1 AS days,
  total_demand / (date_diff('day', min(date), max(date)) + 1) AS avg_daily_demand
FROM part_forecast GROUP BY 1""",
    "item_trend": """
SELECT item_id, CASE WHEN len(v) >= 6 AND (v[1] + v[2] + v[3]) / 3 <> 0
  THEN 100 * ((v[-3] + v[-2] + v[-1]) / 3 - (v[1] + v[2] + v[3]) / 3) / ((v[1] + v[2] + v[3]) / 3) ELSE 0 END AS trend_pct
FROM (SELECT item_id, list(q ORDER BY date) AS v FROM part_forecast GROUP BY 1)""",
    "scored": """
SELECT *, CASE WHEN supply IS NULL THEN CASE WHEN current_stock > 0 THEN 50 ELSE 100 END WHEN current_stock <= 0 THEN 0
    WHEN supply < 3 THEN 20 WHEN supply < 5 THEN 50 WHEN supply < 7 THEN 80 WHEN supply <= 14 THEN 100
    WHEN supply <= 21 THEN 80 WHEN supply <= 30 THEN 50 ELSE 30 END AS stock_score,
  CASE WHEN days_to_expiry IS NULL OR days_to_expiry > 14 THEN 100 WHEN days_to_expiry <= 3 THEN 10
    WHEN days_to_expiry <= 7 THEN 40 ELSE 70 END AS expiry_score,
  CASE WHEN trend >= 0 THEN 100 WHEN trend >= -10 THEN 70 WHEN trend >= -25 THEN 40 ELSE 10 END AS trend_score,
  CASE WHEN current_stock <= 0 THEN CASE WHEN daily > 0 THEN 0 ELSE 50 END WHEN 30 * daily / current_stock > 4 THEN 100
    WHEN 30 * daily / current_stock > 2 THEN 70 WHEN 30 * daily / current_stock > 1 THEN 40 ELSE 10 END AS turnover_score
FROM (SELECT s.*, coalesce(m.avg_daily_demand, 0) AS daily, coalesce(t.trend_pct, 0) AS trend,
    CASE WHEN m.avg_daily_demand > 0 THEN s.current_stock / m.avg_daily_demand END AS supply
  FROM dim_stock s LEFT JOIN item_summary m USING (item_id) LEFT JOIN item_trend t USING (item_id))""",
    # Whole numbers of a hundredth of a point, as the score is a multiple of 0.05 and rounds half up.
    "health_rows": """
SELECT *, ((30 * stock_score + 35 * expiry_score + 20 * trend_score + 15 * turnover_score + 5) // 10) / 10.0::DOUBLE AS health,
  CASE WHEN health >= 70 THEN 'LOW' WHEN health >= 40 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM scored""",
    "flagged": """
SELECT item_id, days_to_expiry, CASE WHEN days < 7 AND ratio > 2 THEN 'Critical'
  WHEN days < 14 OR (ratio > 1.5 AND days < 21) THEN 'High Risk' WHEN ratio > 1.2 OR days < 30 THEN 'Low Risk' ELSE 'Safe' END AS risk_flag
FROM (SELECT item_id, days_to_expiry, coalesce(days_to_expiry, 30) AS days,
  CASE WHEN current_stock = 0 THEN 1.5 * total_demand ELSE current_stock END / greatest(total_demand, 1) AS ratio
  FROM dim_stock JOIN item_summary USING (item_id))""",
}


def q(name, sql):
    return query(name, sql, CTES)


def item_demand(b):
    """The forecast of every part: what it will need, not what it once sold; ``days_with_sales`` is its days of history."""
    daily = d.demand_per_item(b.lines, b.orders, dealt=True)
    series = f.as_series(daily, ["item_id"], "period", "demand_quantity")
    return f.daily_forecasts(series, ["item_id", "n"]).select("item_id", "date", r4("forecast").alias("demand"), F.col("n").cast("bigint").alias("days_with_sales"))


def scores(b, keep=()):
    return h.health_scores(b.stock, item_demand(b), keep)


def flagged(b):
    known = b.stock.join(h.demand_summary(item_demand(b)), "item_id")
    return known.withColumn("risk_flag", h.risk_flag(F.col("days_to_expiry"), F.col("current_stock"), F.col("total_demand")))


@q(
    "stock_snapshot",
    """SELECT id, title, unit, quantity, low_stock_threshold, CASE WHEN quantity <= low_stock_threshold THEN 'low_stock'
  WHEN quantity > 2 * low_stock_threshold THEN 'adequate' ELSE 'normal' END AS status FROM dim_skus""",
)
def _(b):
    return h.stock_snapshot(b.skus)


@q("demand_summary", "SELECT item_id, round(total_demand, 4) AS total_demand, days, round(avg_daily_demand, 4) AS avg_daily_demand FROM item_summary")
def _(b):
    return h.demand_summary(item_demand(b)).withColumns({c: r4(c) for c in ("total_demand", "avg_daily_demand")})


@q("demand_trend", "SELECT item_id, round(trend_pct, 4) AS trend_pct FROM item_trend")
def _(b):
    return h.demand_trend(item_demand(b)).withColumn("trend_pct", r4("trend_pct"))


def _score(name: str) -> None:
    @q(name, f"SELECT item_id, {name.removeprefix('score_')}_score AS score FROM scored")
    def _(b):
        return scores(b).select("item_id", F.col(f"{name.removeprefix('score_')}_score").alias("score"))


for _name in ("score_stock", "score_expiry", "score_trend", "score_turnover"):
    _score(_name)


@q(
    "health_score",
    "SELECT item_id, stock_score, expiry_score, trend_score, turnover_score, health, risk FROM health_rows",
)
def _(b):
    return scores(b).select("item_id", "stock_score", "expiry_score", "trend_score", "turnover_score", "health", "risk")


@q("risk_flag", "SELECT item_id, risk_flag FROM flagged")
def _(b):
    return flagged(b).select("item_id", "risk_flag")


@q(
    "bom_demand",
    """SELECT sku_id, round(sum(total_demand * quantity), 6) AS component_demand, count(*) AS parents
FROM dim_bom JOIN item_summary ON item_id = parent_sku_id GROUP BY 1""",
)
def _(b):
    return h.component_demand(item_demand(b), b.bom).withColumn("component_demand", F.round("component_demand", 6))
