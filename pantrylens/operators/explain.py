"""Explanations of recommendations as nested values: action, reasons, impact, confidence and risk, to JSON and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a rule's recommendation is called, by type: sign, verb, category, headline.
TYPES = {
    "reorder": ("📦", "Order", "Replenishment", "Replenishment needed for %s"),
    "reduce": ("⚠️", "Review", "Alert", "Attention required: %s"),
    "expiry": ("🏷️", "Discount", "Markdown", "Price reduction recommended for %s"),
    "trend": ("⚠️", "Review", "Alert", "Attention required: %s"),
    "bundle": ("🎁", "Bundle", "Promotion", "Bundle opportunity with %s"),
}
# Signs, labels, descriptions and deadlines of risks.
RISKS = {
    "CRITICAL": ("🔴", "Critical", "Requires immediate attention - potential significant loss", "Act today"),
    "HIGH": ("🟠", "High Priority", "Should be addressed within 24-48 hours", "Act within 1-2 days"),
    "MEDIUM": ("🟡", "Medium", "Plan to address this week", "Act this week"),
    "LOW": ("🟢", "Low", "Routine optimization opportunity", "When convenient"),
}
# Least confidence of each level, and what it means.
LEVELS = (
    (0.85, "High", "Strong historical patterns support this recommendation"),
    (0.7, "Good", "Reasonable confidence based on available data"),
    (0.5, "Moderate", "Some uncertainty - consider reviewing manually"),
    (0.0, "Low", "Limited data - treat as suggestion for review"),
)
SCHEMA = """struct<summary: string, headline: string, action: struct<text: string, verb: string, specifics: map<string, string>>,
  why: struct<factors: array<struct<factor: string, value: string, explanation: string>>>,
  impact: struct<metrics: array<struct<metric: string, description: string>>>,
  confidence: struct<percentage: int, level: string, explanation: string>,
  risk: struct<level: string, icon: string, label: string, description: string, urgency: string>,
  metadata: struct<type: string, category: string>>"""


def picked(key: Column, table: dict[str, tuple], at: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[at])])[key]


def confidence_of(days: Column) -> Column:
    """More days of history, more confidence: from 0.6 up to 0.95."""
    return F.least(F.lit(0.95), 0.6 + 0.35 * F.coalesce(days, F.lit(0)) / 100)


def level(confidence: Column, at: int) -> Column:
    out = F.when(confidence >= LEVELS[0][0], LEVELS[0][at])
    for row in LEVELS[1:-1]:
        out = out.when(confidence >= row[0], row[at])
    return out.otherwise(LEVELS[-1][at])


def factors() -> Column:
    """What speaks for the recommendation: only what is known of the item."""
    one = lambda name, value, text: F.struct(F.lit(name).alias("factor"), value.alias("value"), F.lit(text).alias("explanation"))
    supply, expiry, trend, daily = (F.col(c) for c in ("days_of_supply", "days_to_expiry", "trend_pct", "avg_daily_demand"))
    return F.array_compact(
        F.array(
            F.when(daily > 0, one("Forecasted Demand", F.format_string("%.2f units/day", F.round(daily, 2)), "Based on historical patterns and trend analysis")),
            F.when(supply.isNotNull(), one("Supply", F.format_string("%.2f days", F.round(supply, 2)), "Days that the stock lasts at the forecast")),
            F.when(expiry.isNotNull(), one("Expiry", F.format_string("%d days", expiry.cast("long")), "Days until the stock expires")),
            F.when(trend != 0, one("Trend", F.format_string("%.2f%%", F.round(trend, 2)), "Change over the forecast days")),
        )
    )


def metrics() -> Column:
    one = lambda name, text: F.struct(F.lit(name).alias("metric"), text.alias("description"))
    lift = F.format_string("Expected %d%% increase in sales velocity", F.bround(30 + 100 * F.col("discount")).cast("long"))
    sold = F.col("rule") == "expiry"
    return F.array_compact(
        F.array(
            F.when(F.col("rule") == "reorder", one("Stockout Prevention", F.lit("Ensures product availability for forecasted demand"))),
            F.when(sold & F.col("discount").isNotNull(), one("Sales Velocity", lift)),
            F.when(sold, one("Waste Reduction", F.lit("Reduced risk of expiry-related waste"))),
        )
    )


def specifics() -> Column:
    """Quantity and discount in words, those that the recommendation has."""
    row = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    quantity, discount = F.col("quantity"), F.col("discount")
    known = F.array_compact(
        F.array(
            F.when(quantity.isNotNull(), row("quantity_text", F.format_string("%d units", quantity.cast("long")))),
            F.when(discount.isNotNull(), row("discount_text", F.format_string("%d%% off", F.floor(F.round(100 * discount, 6)).cast("long")))),
        )
    )
    return F.map_from_entries(known)


def explained(recs: DataFrame) -> DataFrame:
    """``recs`` (a recommendation, its item's name, health and days of history) with ``explanation``.

    An item without a name is called by its id. Facts that are not known are left out, not shown as null.
    """
    name = F.coalesce("item_name", F.concat(F.lit("item "), F.col("item_id").cast("string")))
    rule, risk = F.col("rule"), F.col("urgency")
    sure = F.col("confidence_score")
    text = F.replace(F.col("action"), F.lit("_"), F.lit(" "))
    whole = F.struct(
        F.format_string("%s %s: %s %s", picked(rule, TYPES, 0), name, text, picked(risk, RISKS, 0)).alias("summary"),
        F.replace(picked(rule, TYPES, 3), F.lit("%s"), name).alias("headline"),
        F.struct(text.alias("text"), picked(rule, TYPES, 1).alias("verb"), specifics().alias("specifics")).alias("action"),
        F.struct(factors().alias("factors")).alias("why"),
        F.struct(metrics().alias("metrics")).alias("impact"),
        F.struct(F.floor(F.round(sure * 100, 6)).cast("int").alias("percentage"), level(sure, 1).alias("level"), level(sure, 2).alias("explanation")).alias("confidence"),
        F.struct(risk.alias("level"), *[picked(risk, RISKS, k).alias(n) for k, n in enumerate(("icon", "label", "description", "urgency"))]).alias("risk"),
        F.struct(rule.alias("type"), picked(rule, TYPES, 2).alias("category")).alias("metadata"),
    )
    return recs.withColumn("confidence_score", confidence_of(F.col("days_with_sales"))).withColumn("explanation", whole)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.withColumn("explanation", F.to_json("explanation"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.withColumn("explanation", F.from_json("explanation", SCHEMA))


def flat(rows: DataFrame) -> DataFrame:
    """One column per part of an explanation, for tables that cannot nest."""
    e = F.col("explanation")
    return rows.select(
        "item_id",
        "rule",
        e["summary"].alias("summary"),
        e["headline"].alias("headline"),
        e["action"]["verb"].alias("verb"),
        e["action"]["specifics"]["quantity_text"].alias("quantity_text"),
        e["action"]["specifics"]["discount_text"].alias("discount_text"),
        F.array_join(F.transform(e["why"]["factors"], lambda x: F.concat_ws("=", x["factor"], x["value"])), "; ").alias("factors"),
        F.array_join(F.transform(e["impact"]["metrics"], lambda x: x["description"]), "; ").alias("metrics"),
        e["confidence"]["percentage"].alias("confidence_pct"),
        e["confidence"]["level"].alias("confidence_level"),
        e["risk"]["label"].alias("risk_label"),
        e["risk"]["urgency"].alias("risk_urgency"),
        e["metadata"]["category"].alias("category"),
    )
