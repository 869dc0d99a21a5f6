"""Recommendations: one row per rule that an item meets, from its health scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of urgency.
URGENCY = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def _rule(met: Column, rule: str, action: Column, urgency: Column, quantity: Column, impact: Column, discount: Column) -> Column:
    row = F.struct(
        F.lit(rule).alias("rule"),
        action.alias("action"),
        urgency.alias("urgency"),
        F.bround(quantity).alias("quantity"),
        impact.alias("impact"),
        discount.alias("discount"),
    )
    return F.when(met, row)


def rules() -> list[Column]:
    """The rules of supply, expiry, trend and waste, each null where it does not apply."""
    stock, daily = F.col("current_stock"), F.col("avg_daily_demand")
    supply, expiry, trend = F.col("days_of_supply"), F.col("days_to_expiry"), F.col("trend_pct")
    none, text = F.lit(None).cast("double"), F.lit
    want, excess = F.greatest(10 * daily - stock, F.lit(0.0)) * 1.2, stock - 14 * daily
    slow = F.coalesce(F.col("turnover_score") == 10, F.lit(False))
    return [
        _rule(
            (supply < 3) & (want > 0), "reorder", text("reorder"),
            F.when(supply < 1, "CRITICAL").otherwise("HIGH"), want, want * 10, none,
        ),
        _rule((supply > 21) & (excess > 0), "reduce", text("reduce_order"), text("MEDIUM"), excess, excess * 5, none),
        _rule((expiry <= 3) & (stock > 0), "expiry", text("prioritize_sales"), text("CRITICAL"), stock, stock * 8, F.lit(0.4)),
        _rule((expiry > 3) & (expiry <= 7) & (stock > 0), "expiry", text("discount"), text("HIGH"), stock, stock * 5, F.lit(0.2)),
        _rule((F.col("trend_score") == 10) & (daily < 1), "trend", text("remove"), text("MEDIUM"), none, F.lit(0.0), none),
        _rule(trend > 20, "trend", text("increase_order"), text("MEDIUM"), none, daily * 5, F.least(trend / 2, F.lit(30.0)) / 100),
        _rule(slow & (supply > 14) & (stock > 0), "bundle", text("bundle"), text("MEDIUM"), stock, stock * 3, none),
    ]


def recommendations(health: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every met rule of every item, with the columns ``keep`` of its health; ``urgency_rank`` and ``impact`` order them."""
    found = health.select("item_id", *keep, F.explode(F.array_compact(F.array(*rules()))).alias("r")).select("item_id", *keep, "r.*")
    rank = F.create_map(*[F.lit(x) for pair in URGENCY.items() for x in pair])[F.col("urgency")]
    return found.withColumn("urgency_rank", rank)


def prep_unit(quantity: Column) -> Column:
    """Quantity in the unit a kitchen prepares, half to even."""
    to = lambda k: F.bround(quantity / k) * k
    return F.when(quantity < 1, 0.0).when(quantity < 5, to(1)).when(quantity < 20, to(5)).when(quantity < 50, to(10)).otherwise(to(25))


def discount_of(risk: Column, days: Column) -> Column:
    """Discount in percent by risk and days to expiry (unknown: 30)."""
    days = F.coalesce(days, F.lit(30)).cast("bigint")
    held = lambda low, high, value: F.least(F.lit(high), F.greatest(F.lit(low), value))
    return (
        F.when(risk == "Critical", held(30, 50, 50 - days * 2))
        .when(risk == "High Risk", held(15, 30, 30 - days))
        .when(risk == "Low Risk", held(5, 15, 15 - F.floor(days / 2)))
        .otherwise(0)
    )


def urgency_of(risk: Column) -> Column:
    return F.when(risk == "Critical", 9).when(risk == "High Risk", 6).when(risk == "Low Risk", 3).otherwise(1)


def action_of(risk: Column) -> Column:
    return (
        F.when(risk == "Critical", "URGENT DISCOUNT")
        .when(risk == "High Risk", "PROMOTE")
        .when(risk == "Low Risk", "MONITOR")
        .otherwise("NO ACTION")
    )


def prep_quantity(stats: DataFrame, safety: float = 1.5) -> DataFrame:
    """Average plus ``safety`` deviations (a fifth of the average where there is none), capped; 0 without demand."""
    avg = F.col("avg_daily")
    spare = F.when(F.col("std_daily") > 0, safety * F.col("std_daily")).otherwise(0.2 * avg)
    most = F.greatest(2 * avg, F.col("max_daily"))
    quantity = F.when(avg > 0, F.least(avg + spare, most)).otherwise(0.0)
    sure = F.when(F.col("days_with_sales") > 20, "high").when(F.col("days_with_sales") > 10, "medium").otherwise("low")
    return stats.select("item_id", "avg_daily", quantity.alias("prep_quantity"), sure.alias("confidence"))
