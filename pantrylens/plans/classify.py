"""Demand class queries."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4
from pantrylens.operators import classify as c
from pantrylens.plans.demand import weekly, weekly_ai
from pantrylens.plans.registry import query


@query(
    "sbc_classify",
    """SELECT place_id, item_id, demand_type, round(adi, 4) AS adi, round(cv2, 4) AS cv2, non_zero_weeks,
  coalesce(date_diff('day', first_demand, last_demand) // 7 + 1, 0) AS weeks_active FROM sbc""",
)
def _(b):
    return c.sbc_classify(weekly(b)).select(
        "place_id", "item_id", "demand_type", r4("adi").alias("adi"), r4("cv2").alias("cv2"), "non_zero_weeks",
        c.weeks_active().alias("weeks_active"),
    )


@query(
    "sbc_series",
    """SELECT item_id, points, non_zero, CASE WHEN non_zero < 2 THEN 'Insufficient Data'
  WHEN points::DOUBLE / non_zero <= 1.5 THEN CASE WHEN cv * cv <= 0.2 THEN 'Smooth' ELSE 'Erratic' END
  ELSE CASE WHEN cv * cv <= 0.2 THEN 'Intermittent' ELSE 'Lumpy' END END AS demand_type
FROM (SELECT item_id, count(*) AS points, count(*) FILTER (demand > 0) AS non_zero,
  coalesce(stddev_samp(demand) FILTER (demand > 0) / avg(demand) FILTER (demand > 0), 0) AS cv FROM daily_events GROUP BY 1)""",
)
def _(b):
    return c.sbc_series(b.daily_events, ["item_id"], adi=1.5, cv2=0.2)


@query(
    "sbc_dashboard",
    """SELECT place_id, item_id, CASE WHEN n < 4 OR nz < 2 THEN 'Insufficient Data'
  WHEN n / nz < 1.32 THEN CASE WHEN cv2 < 0.49 THEN 'Smooth' ELSE 'Erratic' END
  ELSE CASE WHEN cv2 < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END END AS demand_type, round(cv2, 4) AS cv2
FROM (SELECT place_id, item_id, count(*)::DOUBLE AS n, count(*) FILTER (demand > 0) AS nz,
  power(stddev_pop(demand) FILTER (demand > 0) / avg(demand) FILTER (demand > 0), 2) AS cv2 FROM weekly_ai GROUP BY 1, 2)""",
)
def _(b):
    return c.sbc_dashboard(weekly_ai(b)).select("place_id", "item_id", "demand_type", r4("cv2").alias("cv2"))


@query(
    "weeks_active",
    "SELECT place_id, item_id, coalesce(date_diff('day', first_demand, last_demand) // 7 + 1, 0) AS weeks_active FROM sbc",
)
def _(b):
    return c.sbc_classify(weekly(b)).select("place_id", "item_id", c.weeks_active().alias("weeks_active"))


@query(
    "class_distribution",
    """SELECT 'place' AS level, place_id, demand_type, count(*) AS pairs,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY place_id), 4) AS share_pct FROM sbc GROUP BY 2, 3
UNION ALL
SELECT 'overall', NULL, demand_type, count(*), round(100.0 * count(*) / sum(count(*)) OVER (), 4) FROM sbc GROUP BY 3""",
)
def _(b):
    return c.class_distribution(c.sbc_classify(weekly(b))).withColumn("share_pct", r4("share_pct"))
