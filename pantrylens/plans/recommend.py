"""Recommendation queries."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4
from pantrylens.operators import demand as d, recommend as r
from pantrylens.plans.health import CTES as HEALTH_CTES, flagged, scores
from pantrylens.plans.registry import query

RULES = {
    "reorder": """SELECT item_id, 'reorder' AS rule, 'reorder' AS action, CASE WHEN supply < 1 THEN 'CRITICAL' ELSE 'HIGH' END AS urgency,
  1.2 * (10 * daily - current_stock) AS amount, 10 AS rate, NULL::DOUBLE AS discount
FROM health_rows WHERE supply < 3 AND 10 * daily > current_stock""",
    "reduce": """SELECT item_id, 'reduce' AS rule, 'reduce_order' AS action, 'MEDIUM' AS urgency, current_stock - 14 * daily AS amount, 5 AS rate,
  NULL::DOUBLE AS discount FROM health_rows WHERE supply > 21 AND current_stock > 14 * daily""",
    "expiry": """SELECT item_id, 'expiry' AS rule, CASE WHEN days_to_expiry <= 3 THEN 'prioritize_sales' ELSE 'discount' END AS action,
  CASE WHEN days_to_expiry <= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS urgency, current_stock AS amount,
  CASE WHEN days_to_expiry <= 3 THEN 8 ELSE 5 END AS rate, CASE WHEN days_to_expiry <= 3 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS discount
FROM health_rows WHERE days_to_expiry <= 7 AND current_stock > 0""",
    "trend": """SELECT item_id, 'trend' AS rule, CASE WHEN trend > 20 THEN 'increase_order' ELSE 'remove' END AS action, 'MEDIUM' AS urgency,
  CASE WHEN trend > 20 THEN daily ELSE 0 END AS amount, 5 AS rate, CASE WHEN trend > 20 THEN least(trend / 2, 30) / 100 END AS discount
FROM health_rows WHERE trend > 20 OR (trend_score = 10 AND daily < 1)""",
    "bundle": """SELECT item_id, 'bundle' AS rule, 'bundle' AS action, 'MEDIUM' AS urgency, current_stock AS amount, 3 AS rate, NULL::DOUBLE AS discount
FROM health_rows WHERE turnover_score = 10 AND supply > 14 AND current_stock > 0""",
}
SHOWN = """item_id, rule, action, urgency, CASE WHEN rule <> 'trend' THEN round_even(amount, 0) END AS quantity, round(amount * rate, 4) AS impact, round(discount, 4) AS discount"""
CTES = {
    **HEALTH_CTES,
    "all_rules": " UNION ALL ".join(RULES.values()),
    "history": """
SELECT item_id, avg(demand_quantity) AS avg_daily, coalesce(stddev_samp(demand_quantity), 0) AS std_daily,
  max(demand_quantity) AS max_daily, count(*) AS days_with_sales FROM daily_item GROUP BY 1""",
}
COLUMNS = ["item_id", "rule", "action", "urgency", "quantity", "impact", "discount"]


def q(name, sql):
    return query(name, sql, CTES)


def found(b):
    return r.recommendations(scores(b)).withColumns({c: r4(c) for c in ("impact", "discount")})


def history(b):
    daily = d.demand_per_item(b.lines, b.orders).select("item_id", F.col("demand_quantity").alias("q"))
    return daily.groupBy("item_id").agg(
        F.avg("q").alias("avg_daily"),
        F.coalesce(F.stddev_samp("q"), F.lit(0.0)).alias("std_daily"),
        F.max("q").alias("max_daily"),
        F.count("*").alias("days_with_sales"),
    )


def _by_rule(rule: str) -> None:
    @q(f"rule_{rule}", f"SELECT {SHOWN} FROM ({RULES[rule]})")
    def _(b):
        return found(b).where(F.col("rule") == rule).select(COLUMNS)


for _rule in RULES:
    _by_rule(_rule)


@q(
    "recommendations_ranked",
    f"""SELECT {SHOWN}, i.title AS item_name FROM all_rules LEFT JOIN (SELECT id, title FROM dim_items) i ON i.id = item_id""",
)
def _(b):
    names = b.items.select(F.col("id").alias("item_id"), F.col("title").alias("item_name"))
    named = found(b).join(names, "item_id", "left")
    return named.orderBy("urgency_rank", F.desc("impact"), "item_id", "rule").select(*COLUMNS, "item_name")


@q(
    "prep_quantity",
    """SELECT item_id, round(avg_daily, 4) AS avg_daily, round(CASE WHEN avg_daily > 0 THEN least(avg_daily +
    CASE WHEN std_daily > 0 THEN 1.5 * std_daily ELSE 0.2 * avg_daily END, greatest(2 * avg_daily, max_daily)) ELSE 0 END, 4) AS prep_quantity,
  CASE WHEN days_with_sales > 20 THEN 'high' WHEN days_with_sales > 10 THEN 'medium' ELSE 'low' END AS confidence FROM history""",
)
def _(b):
    return r.prep_quantity(history(b)).withColumns({c: r4(c) for c in ("avg_daily", "prep_quantity")})


@q(
    "prep_rounding",
    """SELECT item_id, max_daily, CASE WHEN avg_daily < 1 THEN 0 WHEN avg_daily < 5 THEN round_even(avg_daily, 0)
  WHEN avg_daily < 20 THEN round_even(avg_daily / 5, 0) * 5 WHEN avg_daily < 50 THEN round_even(avg_daily / 10, 0) * 10
  ELSE round_even(avg_daily / 25, 0) * 25 END AS prep_units FROM history""",
)
def _(b):
    return history(b).select("item_id", "max_daily", r.prep_unit(F.col("avg_daily")).alias("prep_units"))


@q(
    "demand_alerts",
    """SELECT item_id, CASE WHEN avg_daily > 10 THEN 'potential_understock' ELSE 'potential_overstock' END AS alert
FROM history WHERE avg_daily > 10 OR avg_daily < 2""",
)
def _(b):
    avg = F.col("avg_daily")
    alert = F.when(avg > 10, "potential_understock").when(avg < 2, "potential_overstock")
    return history(b).select("item_id", alert.alias("alert")).where("alert is not null")


@q(
    "stock_alerts",
    """SELECT item_id, CASE WHEN avg_daily > 10 THEN 'reorder' ELSE 'reduce' END AS alert,
  round(CASE WHEN avg_daily > 10 THEN 7 * avg_daily END, 4) AS order_quantity FROM history JOIN dim_stock USING (item_id)
WHERE (avg_daily > 10 AND current_stock < 2 * avg_daily) OR (avg_daily < 2 AND current_stock > 14 * avg_daily)""",
)
def _(b):
    avg, stock = F.col("avg_daily"), F.col("current_stock")
    alert = F.when((avg > 10) & (stock < 2 * avg), "reorder").when((avg < 2) & (stock > 14 * avg), "reduce")
    order = F.when(F.col("alert") == "reorder", 7 * avg)
    known = history(b).join(b.stock, "item_id").withColumn("alert", alert).where("alert is not null")
    return known.select("item_id", "alert", r4(order).alias("order_quantity"))


@q(
    "discount_urgency",
    """SELECT item_id, risk_flag, CASE risk_flag WHEN 'Critical' THEN least(50, greatest(30, 50 - 2 * days))
    WHEN 'High Risk' THEN least(30, greatest(15, 30 - days)) WHEN 'Low Risk' THEN least(15, greatest(5, 15 - days // 2)) ELSE 0 END AS discount,
  CASE risk_flag WHEN 'Critical' THEN 9 WHEN 'High Risk' THEN 6 WHEN 'Low Risk' THEN 3 ELSE 1 END AS urgency,
  CASE risk_flag WHEN 'Critical' THEN 'URGENT DISCOUNT' WHEN 'High Risk' THEN 'PROMOTE' WHEN 'Low Risk' THEN 'MONITOR' ELSE 'NO ACTION' END AS action
FROM (SELECT *, coalesce(days_to_expiry, 30) AS days FROM flagged)""",
)
def _(b):
    risk = F.col("risk_flag")
    return flagged(b).select(
        "item_id",
        "risk_flag",
        r.discount_of(risk, F.col("days_to_expiry")).alias("discount"),
        r.urgency_of(risk).alias("urgency"),
        r.action_of(risk).alias("action"),
    )
