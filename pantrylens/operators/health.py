"""Stock health: weighted scores of supply, expiry, trend and turnover, and the risk of an item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the four scores, and the least score of a low and of a medium risk.
WEIGHTS = {"stock_score": 0.30, "expiry_score": 0.35, "trend_score": 0.20, "turnover_score": 0.15}
LOW_RISK, MEDIUM_RISK = 70, 40


def stock_snapshot(skus: DataFrame) -> DataFrame:
    """Status of every SKU against its threshold."""
    stock, least = F.col("quantity"), F.col("low_stock_threshold")
    status = (
        F.when(stock.isNull() | least.isNull(), "unknown")
        .when(stock <= least, "low_stock")
        .when(stock > 2 * least, "adequate")
        .otherwise("normal")
    )
    return skus.select("id", "title", "unit", "quantity", "low_stock_threshold", status.alias("status"))


def in_order() -> Column:
    """Aggregate: the demand of an item by date; a forecast has few days an item."""
    return F.transform(F.sort_array(F.collect_list(F.struct("date", "demand"))), lambda x: x["demand"])


def outlook(demand: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Total, calendar days, average per day and trend of each item, of forecast rows ``(item_id, date, demand)``, in one grouping.

    Columns of ``keep`` are facts of the item, equal in all its rows, and stay with it.

    Days from the first to the last row count, so those without demand need no rows. The trend is the change in percent
    from the first three to the last three days; 0 with under six days or from 0.
    """
    days = (F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint")
    dealt = demand.repartition("item_id").sortWithinPartitions("item_id", "date")
    known = dealt.groupBy("item_id").agg(in_order().alias("v"), days.alias("days"), *[F.max(c).alias(c) for c in keep])
    mean = lambda part: (F.get(part, F.lit(0)) + F.get(part, F.lit(1)) + F.get(part, F.lit(2))) / 3
    ends = known.withColumns({"early": mean(F.slice("v", 1, 3)), "late": mean(F.slice("v", -3, 3))})
    change = 100 * (F.col("late") - F.col("early")) / F.col("early")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    trend = F.when((F.size("v") >= 6) & (F.col("early") != 0), change).otherwise(0.0)
    totals = ends.select("item_id", total.alias("total_demand"), "days", trend.alias("trend_pct"), *keep)
    return totals.select("item_id", "total_demand", "days", (F.col("total_demand") / F.col("days")).alias("avg_daily_demand"), "trend_pct", *keep)


def demand_summary(demand: DataFrame) -> DataFrame:
    """Total, calendar days and average per day of each item."""
    return outlook(demand).drop("trend_pct")


def demand_trend(demand: DataFrame) -> DataFrame:
    """Change in percent over each item's forecast."""
    return outlook(demand).select("item_id", "trend_pct")


def days_of_supply() -> Column:
    return F.when(F.col("avg_daily_demand") > 0, F.col("current_stock") / F.col("avg_daily_demand"))


def score_stock() -> Column:
    """Score of the days of supply; an item without demand scores by whether it has stock."""
    days, stock = F.col("days_of_supply"), F.col("current_stock")
    return (
        F.when(days.isNull(), F.when(stock > 0, 50).otherwise(100))
        .when(stock <= 0, 0)
        .when(days < 3, 20)
        .when(days < 5, 50)
        .when(days < 7, 80)
        .when(days <= 14, 100)
        .when(days <= 21, 80)
        .when(days <= 30, 50)
        .otherwise(30)
    )


def score_expiry() -> Column:
    days = F.col("days_to_expiry")
    return F.when(days.isNull(), 100).when(days <= 3, 10).when(days <= 7, 40).when(days <= 14, 70).otherwise(100)


def score_trend() -> Column:
    pct = F.col("trend_pct")
    return F.when(pct >= 0, 100).when(pct >= -10, 70).when(pct >= -25, 40).otherwise(10)


def score_turnover() -> Column:
    """Score of the share of the stock sold in thirty days."""
    daily, stock = F.col("avg_daily_demand"), F.col("current_stock")
    turns = 30 * daily / F.when(stock > 0, stock)
    return (
        F.when(turns.isNull(), F.when(daily > 0, 0).otherwise(50))
        .when(turns > 4, 100)
        .when(turns > 2, 70)
        .when(turns > 1, 40)
        .otherwise(10)
    )


def health_scores(stock: DataFrame, demand: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Scores of every item in stock; items without demand count as of no demand and no trend. ``keep`` as in ``outlook``."""
    known = (
        stock.join(outlook(demand, keep), "item_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("avg_daily_demand", "trend_pct", "current_stock")})
        .withColumn("days_of_supply", days_of_supply())
    )
    scored = known.withColumns(
        {
            "stock_score": score_stock(),
            "expiry_score": score_expiry(),
            "trend_score": score_trend(),
            "turnover_score": score_turnover(),
        }
    )
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    score = F.round(F.round(total, 6), 1)
    risk = F.when(F.col("health") >= LOW_RISK, "LOW").when(F.col("health") >= MEDIUM_RISK, "MEDIUM").otherwise("HIGH")
    return scored.withColumn("health", score).withColumn("risk", risk)


def risk_flag(days: Column, stock: Column, forecast: Column) -> Column:
    """Risk by days to expiry and stock over forecast. Unknown expiry is 30 days, no stock 1.5 forecasts."""
    days = F.coalesce(days, F.lit(30))
    held = F.when(F.coalesce(stock, F.lit(0.0)) == 0, 1.5 * forecast).otherwise(stock)
    ratio = held / F.greatest(F.coalesce(forecast, F.lit(1.0)), F.lit(1.0))
    return (
        F.when((days < 7) & (ratio > 2.0), "Critical")
        .when((days < 14) | ((ratio > 1.5) & (days < 21)), "High Risk")
        .when((ratio > 1.2) | (days < 30), "Low Risk")
        .otherwise("Safe")
    )


def component_demand(demand: DataFrame, bom: DataFrame) -> DataFrame:
    """Demand of components: that of each parent times its quantity, summed before the second shuffle."""
    parents = demand.groupBy(F.col("item_id").alias("parent_sku_id")).agg(F.sum("demand").alias("parent_demand"))
    need = F.sum(F.col("parent_demand") * F.col("quantity")).alias("component_demand")
    return bom.join(parents, "parent_sku_id").groupBy("sku_id").agg(need, F.count("*").alias("parents"))
