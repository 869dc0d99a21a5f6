"""Binds the driver's star-schema tables to the inventory domain.

Everything here is derived row by row from the given tables, so each bound table grows with
them. ``*_raw`` tables carry deliberately dirty values (nulls, negatives, orphans, duplicate
ids) for the cleaning and profiling operators; the others are clean.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Place codes of the five market segments.
PLACE_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}

# Item codes of the event types in the daily series.
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def coded(column: Column, codes: dict[str, int]) -> Column:
    out = None
    for label, code in codes.items():
        hit = column == label
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out.cast("bigint")


class Bound:
    """Domain view of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def place_id(self) -> Column:
        return coded(F.col("c_mktsegment"), PLACE_CODES)

    @cached_property
    def orders(self) -> DataFrame:
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), self.place_id.alias("place_id"))
        return (
            self.raw("orders")
            .join(customers, "o_custkey", "left")
            .select(
                F.col("o_orderkey").alias("id"),
                "place_id",
                F.col("o_custkey").alias("user_id"),
                F.col("o_orderdate").cast("timestamp").alias("created"),
                F.col("o_totalprice").alias("total_amount"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_orderpriority").alias("type"),
            )
        )

    @cached_property
    def orders_raw(self) -> DataFrame:
        key = F.col("o_orderkey")
        customers = self.raw("customer").select(
            F.col("c_custkey").alias("o_custkey"), self.place_id.alias("segment_place"), "c_name"
        )
        # Customers grow with the orders: they are shuffled, not copied to the driver for every scan of a profile.
        return (
            self.raw("orders")
            .join(customers.hint("merge"), "o_custkey", "left")
            .select(
                key.alias("id"),
                F.when(key % 23 != 0, F.col("segment_place")).alias("place_id"),
                F.col("o_custkey").alias("user_id"),
                F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created"),
                F.when(key % 19 != 0, F.col("o_totalprice")).alias("total_amount"),
                F.col("o_orderpriority").alias("type"),
                F.when(key % 17 == 0, F.lit(None))
                .when((F.col("o_orderstatus") == "P") & (key % 3 == 0), F.lit("cancelled"))
                .when((F.col("o_orderstatus") == "P") & (key % 3 == 1), F.lit("Cancelled"))
                .when(F.col("o_orderstatus") == "P", F.lit("CANCELLED"))
                .when(F.col("o_orderstatus") == "F", F.lit("Closed"))
                .otherwise(F.lit("Open"))
                .alias("status"),
                F.when(key % 5 == 0, F.lit(None)).when(key % 5 < 3, F.lit("Card")).otherwise(F.lit("Cash")).alias(
                    "payment_method"
                ),
                F.when(key % 8 == 0, F.lit(1)).when(key % 8 > 3, F.lit(0)).alias("demo_mode"),
                F.col("c_name").alias("customer_name"),
                F.concat(F.lit("ext-"), key.cast("string")).alias("external_id"),
                F.concat(F.lit("acc-"), F.col("o_custkey").cast("string")).alias("account_id"),
                F.concat(F.lit("+45"), (key % 99999999).cast("string")).alias("customer_mobile_phone"),
            )
        )

    def _unit_price(self) -> Column:
        return F.col("l_extendedprice") / F.col("l_quantity")

    @cached_property
    def lines_raw(self) -> DataFrame:
        order, part = F.col("l_orderkey"), F.col("l_partkey")
        return self.raw("lineitem").select(
            (order * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_suppkey").alias("user_id"),
            F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("created"),
            part.cast("double").alias("item_id"),
            F.when((order + part) % 29 == 0, F.lit(None))
            .when((order + part) % 31 == 0, (order + 100000000).cast("double"))
            .otherwise(order.cast("double"))
            .alias("order_id"),
            F.when(part % 19 == 0, F.lit(None))
            .when((order + part) % 13 == 0, -F.col("l_quantity"))
            .otherwise(F.col("l_quantity"))
            .alias("quantity"),
            F.when(order % 41 != 0, self._unit_price()).alias("price"),
            (self._unit_price() * 0.6).alias("cost"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("commission_amount"),
            F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
            F.when(part % 3 == 0, F.concat(F.lit("["), part.cast("string"), F.lit("]"))).alias("add_on_ids"),
            F.when(order % 7 != 0, F.col("l_returnflag")).alias("status"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").alias("quantity"),
            self._unit_price().alias("price"),
            (self._unit_price() * 0.6).alias("cost"),
            F.col("l_shipdate").cast("timestamp").alias("created"),
        )

    @cached_property
    def supplier_lines(self) -> DataFrame:
        """Lines by supplier and part: very many pairs of few weeks, which grow with the tables."""
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("place_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").alias("quantity"),
            self._unit_price().alias("price"),
            F.col("l_shipdate").cast("timestamp").alias("created"),
        )

    @property
    def brand_code(self) -> Column:
        return F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")

    @cached_property
    def menu_lines(self) -> DataFrame:
        """Order lines at menu-item grain: one item per brand, so series are dense."""
        brands = self.raw("part").select(F.col("p_partkey").alias("item_id"), self.brand_code.alias("brand_item"))
        return (
            self.lines.join(brands, "item_id")
            .drop("item_id")
            .withColumnRenamed("brand_item", "item_id")
            .select(self.lines.columns)
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_size").cast("bigint").alias("section_id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("type"),
            F.when(F.col("p_partkey") % 9 == 0, F.lit("Inactive")).otherwise(F.lit("Active")).alias("status"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def items_raw(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("id"),
            F.col("p_size").cast("bigint").alias("section_id"),
            F.when(key % 7 != 0, F.col("p_name")).alias("title"),
            F.when(key % 11 != 0, F.col("p_type")).alias("type"),
            F.when(key % 13 != 0, F.lit("Active")).alias("status"),
            F.when(key % 5 != 0, (key % 50) / F.lit(10.0)).alias("rating"),
            F.when(key % 6 != 0, (key % 400).cast("double")).alias("purchases"),
            F.when(key % 17 != 0, F.col("p_retailprice")).alias("price"),
        )

    @cached_property
    def menu_items(self) -> DataFrame:
        return (
            self.raw("part")
            .groupBy(self.brand_code.alias("id"))
            .agg(F.min("p_brand").alias("title"), F.max("p_retailprice").alias("price"), F.min("p_type").alias("type"))
        )

    @cached_property
    def places(self) -> DataFrame:
        return (
            self.raw("customer")
            .groupBy(self.place_id.alias("id"), F.col("c_mktsegment").alias("title"))
            .agg(F.min("c_nationkey").cast("string").alias("country"), F.count("*").alias("inventory_management"))
        )

    @cached_property
    def skus(self) -> DataFrame:
        key = F.col("p_partkey")
        quantity = (key * 37) % 400 - 20
        return self.raw("part").select(
            key.alias("id"),
            F.col("p_name").alias("title"),
            quantity.cast("double").alias("quantity"),
            (F.col("p_size") * 2).cast("double").alias("low_stock_threshold"),
            F.when(key % 2 == 0, F.lit("kg")).otherwise(F.lit("pcs")).alias("unit"),
            (key % 5 + 1).alias("place_id"),
            F.when(key % 10 != 0, (key * 13) % 45).alias("days_to_expiry"),
            (key % 6 * 10 + 5).alias("shelf_life_days"),
        )

    @cached_property
    def stock(self) -> DataFrame:
        """Item to stock mapping: the clamped SKU quantity and days to expiry per item."""
        return self.skus.select(
            F.col("id").alias("item_id"),
            F.greatest(F.col("quantity"), F.lit(0.0)).alias("current_stock"),
            "days_to_expiry",
            "shelf_life_days",
        )

    @cached_property
    def bom(self) -> DataFrame:
        key = F.col("p_partkey")
        part = self.raw("part")
        small = part.select(
            key.alias("parent_sku_id"),
            (key - key % 10).alias("sku_id"),
            (F.col("p_size") % 4 + 1).cast("double").alias("quantity"),
        )
        large = part.select(
            key.alias("parent_sku_id"),
            (key - key % 100).alias("sku_id"),
            F.lit(0.5).alias("quantity"),
        )
        return small.unionByName(large)

    @cached_property
    def daily_events(self) -> DataFrame:
        """Daily demand of (user, event type) items: short series of 2 to 30 points."""
        return (
            self.raw("events")
            .groupBy(
                (F.col("user_id") * 10 + coded(F.col("event_type"), EVENT_CODES)).alias("item_id"),
                F.to_date("ts").alias("date"),
            )
            .agg(F.sum(F.ceil("value").cast("double")).alias("demand"))
        )

    # ---- context -------------------------------------------------------------------------

    @cached_property
    def visits(self) -> DataFrame:
        """Places (one a user) and the days they are looked at."""
        return self.raw("events").select(F.col("user_id").alias("place_id"), F.to_date("ts").alias("date")).distinct()

    @cached_property
    def context_events(self) -> DataFrame:
        """An event per user and type, on the day of its largest value: local ones at two places, some everywhere."""
        best = F.max(F.struct("value", (-F.col("event_id")).alias("order"), F.to_date("ts").alias("day"))).alias("b")
        user, event = F.col("user_id"), -F.col("b.order")
        places = F.when(user % 50 != 0, F.array(user, user + 1))
        return (
            self.raw("events")
            .groupBy("user_id", "event_type")
            .agg(best)
            .select(
                F.concat_ws(" ", "event_type", user.cast("string")).alias("name"),
                "event_type",
                F.col("b.day").alias("start_date"),
                F.when(event % 5 != 0, F.date_add("b.day", (event % 5).cast("int"))).alias("end_date"),
                (0.5 + (user % 11) / F.lit(10.0)).alias("impact_factor"),
                places.alias("place_ids"),
            )
        )

    @cached_property
    def dated_events(self) -> DataFrame:
        """Events of single days: types that are worth more on a day than on their average day."""
        totals = (
            self.raw("events")
            .groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("name"))
            .agg(F.sum(F.ceil("value")).alias("total"))
        )
        usual = totals.groupBy("name").agg(F.avg("total").alias("usual"))
        kind = (
            F.when(F.col("name") == "purchase", "holiday")
            .when(F.col("name") == "signup", "local_event")
            .when(F.col("name") == "error", "slow_day")
            .otherwise("promotion")
        )
        return (
            totals.join(usual, "name")
            .where(F.col("total") > F.col("usual"))
            .select(
                "date",
                "name",
                kind.alias("event_type"),
                F.when(F.col("name") == "error", F.lit(0.9)).alias("impact_factor"),
                F.when(F.col("name") == "view", F.array(F.lit("beverages_cold"), F.lit("salad"))).alias("affected_categories"),
            )
        )

    @cached_property
    def weather(self) -> DataFrame:
        """A weather and a temperature for every day, from the number of its events."""
        kinds = ["sunny", "cloudy", "rainy", "stormy", "snow", "extreme_heat", "extreme_cold"]
        return (
            self.raw("events")
            .groupBy(F.to_date("ts").alias("date"))
            .agg(F.count("*").alias("k"))
            .select(
                "date",
                F.get(F.array(*[F.lit(x) for x in kinds]), (F.col("k") % 7).cast("int")).alias("weather_type"),
                (F.col("k") % 45 - 5).cast("double").alias("temperature"),
            )
        )

    @cached_property
    def item_categories(self) -> DataFrame:
        """The weather-sensitive category of every item of the daily series; null for some."""
        kinds = ["beverages_cold", "beverages_hot", "ice_cream", "soup", "salad"]
        items = self.daily_events.select("item_id").distinct()
        return items.withColumn("category", F.get(F.array(*[F.lit(x) for x in kinds]), (F.col("item_id") % 7).cast("int")))
