"""Demand aggregation, complete calendars and item or place statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrylens.functions.stats import exact_quantiles, quantiles_wide

PAIR = ["place_id", "item_id"]


def week_start(column: str | Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", column))


def lines_with_orders(lines: DataFrame, orders: DataFrame, how: str = "left") -> DataFrame:
    """Order lines plus the order's time and place; the order's time is ``ordered``."""
    heads = orders.select(F.col("id").alias("order_id"), F.col("created").alias("ordered"), "place_id")
    return lines.join(heads, "order_id", how)


def daily_demand(lines: DataFrame, orders: DataFrame) -> DataFrame:
    joined = lines_with_orders(lines, orders)
    return (
        joined.where(F.col("ordered").isNotNull())
        .groupBy("item_id", F.to_date("ordered").alias("date"))
        .agg(F.sum("quantity").alias("demand"), F.sum(F.col("quantity") * F.col("price")).alias("revenue"))
    )


def daily_demand_direct(lines: DataFrame) -> DataFrame:
    qty, price = F.coalesce("quantity", F.lit(0.0)), F.coalesce("price", F.lit(0.0))
    return (
        lines.where(F.col("created").isNotNull())
        .groupBy("item_id", F.to_date("created").alias("date"))
        .agg(F.sum(qty).alias("demand"), F.sum(qty * price).alias("revenue"))
    )


def fill_calendar(
    observed: DataFrame,
    keys: Sequence[str],
    time: str,
    step_days: int,
    zero: Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every step between the global first and last ``time`` for every key.

    Missing steps get 0 in the ``zero`` columns and the last known value of the ``carry``
    columns (the first known one before the first observation). Each observed row spans up to
    its successor, so one shuffle on the keys is enough: no grid, no join.
    """
    first, last = observed.agg(F.min(time)).scalar(), observed.agg(F.max(time)).scalar()
    order = Window.partitionBy(*keys).orderBy(time)
    spans = observed
    for c in carry:
        spans = spans.withColumn(
            c,
            F.coalesce(
                F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
                F.first(c, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
            ),
        )
    spans = spans.select(
        *keys,
        F.col(time).alias("seen"),
        F.lead(time).over(order).alias("following"),
        F.lag(time).over(order).alias("previous"),
        *zero,
        *carry,
    )
    start = F.when(F.col("previous").isNull(), first).otherwise(F.col("seen"))
    end = F.when(F.col("following").isNull(), last).otherwise(F.date_sub("following", step_days))
    step = F.expr(f"interval {step_days} days")
    return spans.select(
        *keys, "seen", F.explode(F.sequence(start, end, step)).alias(time), *zero, *carry
    ).select(
        *keys,
        time,
        *[F.when(F.col(time) == F.col("seen"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c) for c in zero],
        *carry,
    )


def fill_missing_dates(daily: DataFrame) -> DataFrame:
    return fill_calendar(daily, ["item_id"], "date", 1, ["demand", "revenue"])


PERIODS = {
    "daily": lambda t: F.to_date(t),
    "weekly": lambda t: F.concat_ws(
        "/",
        F.date_format(week_start(t), "yyyy-MM-dd"),
        F.date_format(F.date_add(week_start(t), 6), "yyyy-MM-dd"),
    ),
    "monthly": lambda t: F.date_format(t, "yyyy-MM"),
    "all_time": lambda t: F.lit("all_time"),
}


def demand_per_item(
    lines: DataFrame, orders: DataFrame, period: str = "daily", start: str | None = None, end: str | None = None, dealt: bool = False
) -> DataFrame:
    """Demand, price and cost of each item and period.

    ``dealt``: for items that rarely sell twice in a period, so that sums before a shuffle merge next to nothing. Lines
    are then dealt by item and sorted, and so is what is returned: neither the sums nor the items' series need a hash
    table or another shuffle.
    """
    joined = _between(lines_with_orders(lines, orders), start, end).withColumn("period", PERIODS[period]("ordered"))
    if dealt:
        joined = joined.repartition("item_id").sortWithinPartitions("item_id", "period")
    summed = joined.groupBy("item_id", "period").agg(
        F.sum("quantity").alias("demand_quantity"), F.avg("price").alias("avg_price"), F.sum("cost").alias("total_cost")
    )
    # costs little, as rows come in this order; without it Spark does not know that they do
    return summed.sortWithinPartitions("item_id", "period") if dealt else summed


def _between(joined: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        joined = joined.where(F.col("ordered") >= F.lit(start).cast("timestamp"))
    if end:
        joined = joined.where(F.col("ordered") <= F.lit(end).cast("timestamp"))
    return joined


def demand_per_period(lines: DataFrame, orders: DataFrame, period: str = "daily") -> DataFrame:
    joined = lines_with_orders(lines, orders)
    return joined.groupBy(PERIODS[period]("ordered").alias("period")).agg(F.sum("quantity").alias("demand_quantity"))


def demand_by_place(lines: DataFrame, orders: DataFrame, period: str = "daily") -> DataFrame:
    return (
        lines_with_orders(lines, orders)
        .groupBy("item_id", "place_id", PERIODS[period]("ordered").alias("period"))
        .agg(F.sum("quantity").alias("demand_quantity"))
    )


def weekly_place_item(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Weekly demand per place and item by the order's time.

    Days collapse first, so the distinct-day count needs no second pass over the lines.
    """
    by_day = (
        lines_with_orders(lines, orders, "inner")
        .groupBy(*PAIR, F.to_date("ordered").alias("day"))
        .agg(
            F.sum("quantity").alias("quantity"),
            F.count("id").alias("n"),
            F.sum("price").alias("price_sum"),
            F.count("price").alias("price_n"),
        )
    )
    return by_day.groupBy(*PAIR, week_start("day").alias("week_start")).agg(
        F.sum("quantity").alias("demand"),
        F.sum("n").alias("transactions"),
        F.try_divide(F.sum("price_sum"), F.sum("price_n")).alias("avg_price"),
        F.min("day").alias("first_transaction"),
        F.max("day").alias("last_transaction"),
        F.count("day").alias("days_active"),
    )


def with_active_flag(weekly: DataFrame, places: DataFrame) -> DataFrame:
    flags = places.select(F.col("id").alias("place_id"), F.col("active_flag").alias("is_active"))
    return weekly.join(flags, "place_id", "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))


def weekly_place_item_by_line_time(lines: DataFrame, orders: DataFrame) -> DataFrame:
    return (
        lines_with_orders(lines, orders, "inner")
        .groupBy(*PAIR, week_start("created").alias("week_start"))
        .agg(
            F.sum("quantity").alias("demand"),
            F.avg("price").alias("avg_price"),
            F.count("id").alias("transaction_count"),
        )
    )


def expand_full_calendar(weekly: DataFrame) -> DataFrame:
    return fill_calendar(
        weekly, PAIR, "week_start", 7, ["demand", "transactions", "days_active"], ["avg_price"]
    ).withColumn("is_active", F.lit(True))


def daily_for_dashboard(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("item_id").isNotNull())
        .groupBy(F.col("item_id").cast("bigint").alias("item_id"), F.to_date("created").alias("date"))
        .agg(
            F.sum(F.coalesce("quantity", F.lit(1.0))).alias("daily_quantity"),
            F.sum(F.coalesce("price", F.lit(0.0))).alias("daily_revenue"),
        )
    )


def store_daily_total(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.sum("daily_quantity").alias("daily_quantity"))


def item_metrics(menu: DataFrame, daily: DataFrame, as_of: Column) -> DataFrame:
    """Sales metrics for every menu item, sold or not."""
    sold = daily.groupBy("item_id").agg(
        F.sum("daily_quantity").alias("total_quantity"),
        F.min("date").alias("first_sale"),
        F.max("date").alias("last_sale"),
    )
    span = F.greatest(F.datediff("last_sale", "first_sale") + 1, F.lit(1))
    sold = sold.select(
        F.col("item_id").alias("id"),
        "total_quantity",
        (F.col("total_quantity") / span).alias("avg_daily"),
        F.datediff(as_of, F.col("last_sale")).alias("idle"),
        F.col("last_sale").alias("last_sale_date"),
    )
    return menu.join(sold, "id", "left").select(
        *menu.columns,
        F.coalesce("total_quantity", F.lit(0.0)).alias("total_quantity_sold"),
        F.coalesce("avg_daily", F.lit(0.0)).alias("avg_daily_demand"),
        F.coalesce("idle", F.lit(999)).cast("bigint").alias("days_since_last_sale"),
        "last_sale_date",
    )


def historical_demand_stats(demand: DataFrame, as_of: Column) -> DataFrame:
    """Statistics over the days an item sold (not calendar days)."""
    return demand.groupBy("item_id").agg(
        F.sum("demand_quantity").alias("total_demand"),
        F.avg("demand_quantity").alias("avg_daily"),
        F.coalesce(F.stddev_samp("demand_quantity"), F.lit(0.0)).alias("std_daily"),
        F.max("demand_quantity").alias("max_daily"),
        F.count("*").alias("days_with_sales"),
        F.coalesce(F.datediff(as_of, F.max("period")), F.lit(999)).cast("bigint").alias("days_since_last_sale"),
    )


def item_feature_aggregates(lines: DataFrame) -> DataFrame:
    return lines.groupBy("item_id").agg(
        F.sum("quantity").alias("quantity_sum"),
        F.avg("quantity").alias("quantity_mean"),
        F.stddev_samp("quantity").alias("quantity_std"),
        F.count("quantity").alias("quantity_count"),
        F.avg("price").alias("price_mean"),
        F.stddev_samp("price").alias("price_std"),
        F.sum("cost").alias("cost_sum"),
        F.avg("cost").alias("cost_mean"),
    )


def demand_pivot(demand: DataFrame, items: Sequence[int]) -> DataFrame:
    """Period x item matrix for a stated item list; the long form is the one that scales.

    Demand of an item that is not in the list is an error, not left out in silence; that of no item (null) is left out.
    """
    item = F.col("item_id")
    unknown = F.raise_error(F.format_string("item %s is not among the columns of the matrix", item.cast("string")))
    known = demand.where(item.isNotNull()).withColumn("item_id", F.when(item.isin(list(items)), item).otherwise(unknown.cast("bigint")))
    wide = known.groupBy("period").pivot("item_id", list(items)).agg(F.avg("demand_quantity"))
    return wide.na.fill(0.0, [str(i) for i in items]).select(
        "period", *[F.col(str(i)).alias(f"item_{i}") for i in items]
    )


def item_metadata(items: DataFrame) -> DataFrame:
    return items.select("id", "title", "price", "status")


def item_totals(weekly: DataFrame) -> DataFrame:
    """Per place and item: demand, revenue and weeks observed."""
    return weekly.groupBy(*PAIR).agg(
        F.sum("demand").alias("demand"),
        F.sum(F.col("demand") * F.col("avg_price")).alias("revenue"),
        F.count("demand").cast("double").alias("frequency"),
    )


def top_items_per_place(weekly: DataFrame, items: DataFrame, n: int = 20, metric: str = "demand") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("value"), "item_id"))
    top = (
        item_totals(weekly)
        .select(*PAIR, F.round(metric, 4).alias("value"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= n)
    )
    titles = items.select(F.col("id").alias("item_id"), "title")
    return top.join(titles, "item_id", "left").select(
        F.lit(metric).alias("metric"), *PAIR, "title", "value", F.col("rank").cast("bigint").alias("rank")
    )


def active_places(places: DataFrame, orders: DataFrame, days: int = 90) -> DataFrame:
    """Places with an order in the last ``days`` of the data, busiest first."""
    cutoff = F.date_sub(F.to_date(orders.agg(F.max("created")).scalar()), days)
    stats = orders.groupBy(F.col("place_id").alias("id")).agg(
        F.count("*").alias("order_count"), F.to_date(F.max("created")).alias("last_order")
    )
    return (
        places.join(stats, "id", "left")
        .where(F.coalesce(F.col("last_order") >= cutoff, F.lit(False)))
        .select("id", "title", "country", "order_count", "last_order")
        .orderBy(F.desc("order_count"), "id")
    )


def place_stats(weekly: DataFrame) -> DataFrame:
    """Pairs and weeks collapse first, so distinct counts stay small."""
    items = weekly.groupBy(*PAIR).agg(F.sum("demand").alias("d")).groupBy("place_id")
    weeks = weekly.groupBy("place_id", "week_start").agg(F.lit(1).alias("one")).groupBy("place_id")
    return (
        items.agg(F.count("*").alias("total_items"), F.sum("d").alias("total_demand"))
        .join(weeks.agg(F.count("*").alias("weeks_active")), "place_id")
        .withColumn("avg_weekly_demand", F.try_divide("total_demand", "weeks_active"))
    )


def place_items(weekly: DataFrame, items: DataFrame, classes: DataFrame, place_id: int | None = None) -> DataFrame:
    """Items sold at one place (or at each place) with their demand class."""
    rows = weekly if place_id is None else weekly.where(F.col("place_id") == place_id)
    pairs = rows.groupBy(*PAIR).agg(F.sum("demand").alias("total_demand"), F.count("*").alias("weeks"))
    titled = pairs.join(items.select(F.col("id").alias("item_id"), "title"), "item_id", "left")
    kind = classes.select(*PAIR, "demand_type")
    return titled.join(kind, PAIR, "left").withColumn(
        "demand_type", F.coalesce("demand_type", F.lit("Insufficient Data"))
    )


def last_n_weeks(weekly: DataFrame, weeks: int = 52) -> DataFrame:
    recent = F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("week_start")))
    return weekly.withColumn("recency", recent).where(F.col("recency") <= weeks)


def top_n_places(weekly: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` places with most rows; the broadcast side has at most ``n`` rows."""
    largest = weekly.groupBy("place_id").count().orderBy(F.desc("count"), "place_id").limit(n).select("place_id")
    return weekly.join(F.broadcast(largest), "place_id", "left_semi")


def enrich_titles(pairs: DataFrame, places: DataFrame, items: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    out = pairs.join(places.select(F.col("id").alias("place_id"), F.col("title").alias("place_title")), "place_id", "left")
    out = out.join(items.select(F.col("id").alias("item_id"), F.col("title").alias("item_title")), "item_id", "left")
    kind = F.lit("Unknown")
    if classes is not None:
        out = out.join(classes.select(*PAIR, "demand_type"), PAIR, "left")
        kind = F.coalesce("demand_type", kind)
    return out.select(
        *pairs.columns,
        F.coalesce("place_title", F.concat(F.lit("Location "), F.col("place_id").cast("string"))).alias("place_title"),
        F.coalesce("item_title", F.concat(F.lit("Item "), F.col("item_id").cast("string"))).alias("item_title"),
        kind.alias("demand_type"),
    )


def share_of_total(counts: DataFrame, column: str) -> DataFrame:
    return counts.withColumn("share_pct", 100.0 * F.col(column) / counts.agg(F.sum(column)).scalar())


def weekday_profile(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy(F.weekday("created").cast("bigint").alias("weekday")).agg(F.count("*").alias("orders"))
    return share_of_total(counts, "orders")


def monthly_share(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy(F.month("created").cast("bigint").alias("month")).agg(F.count("*").alias("orders"))
    return share_of_total(counts, "orders")


def yearly_trend(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy(F.year("created").cast("bigint").alias("year")).agg(F.count("*").alias("orders"))
    before = counts.select((F.col("year") + 1).alias("year"), F.col("orders").alias("previous"))
    growth = F.try_divide(100.0 * (F.col("orders") - F.col("previous")), F.col("previous"))
    return counts.join(before, "year", "left").select("year", "orders", growth.alias("yoy_growth_pct"))


def pair_density(lines: DataFrame, orders: DataFrame) -> DataFrame:
    pairs = lines_with_orders(lines, orders, "inner").groupBy(*PAIR).agg(F.count("*").alias("n"))
    counts = pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("n") >= 10).alias("pairs_10"),
        F.count_if(F.col("n") >= 50).alias("pairs_50"),
        F.count_if(F.col("n") >= 100).alias("pairs_100"),
        F.avg("n").alias("mean_transactions"),
    )
    return counts.withColumn("median_transactions", exact_quantiles(pairs, ["n"], [0.5]).select("value").scalar())


def min_history_pairs(weekly: DataFrame, weeks: int = 52, non_zero: int = 26) -> DataFrame:
    span = F.floor(F.datediff(F.max("week_start"), F.min("week_start")) / 7) + 1
    return (
        weekly.groupBy(*PAIR)
        .agg(span.cast("bigint").alias("history_weeks"), F.count_if(F.col("demand") > 0).alias("non_zero_weeks"))
        .where((F.col("history_weeks") >= weeks) & (F.col("non_zero_weeks") >= non_zero))
    )


def hierarchy_rollup(weekly: DataFrame, items: DataFrame) -> DataFrame:
    """Place x item, category and item levels per week in one pass."""
    typed = weekly.join(items.select(F.col("id").alias("item_id"), F.col("type").alias("category")), "item_id", "left")
    place, item, category, week = (F.col(c) for c in ("place_id", "item_id", "category", "week_start"))
    sets = [[place, item, week], [category, week], [item, week]]
    level = (
        F.when(F.grouping("place_id") == 0, "place_item")
        .when(F.grouping("category") == 0, "category")
        .otherwise("item")
    )
    return typed.groupingSets(sets, place, item, category, week).agg(
        level.alias("level"), F.sum("demand").alias("demand")
    )


def place_volume(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("place_id", F.to_date("created").alias("day"))
        .agg(F.count("*").alias("n"))
        .groupBy("place_id")
        .agg(
            F.sum("n").alias("orders"),
            F.count("*").alias("active_days"),
            F.min("day").alias("first_order"),
            F.max("day").alias("last_order"),
        )
    )


def place_volume_tiers(orders: DataFrame) -> DataFrame:
    tier = F.when(F.col("orders") >= 1000, "1000+").when(F.col("orders") >= 100, "100+").otherwise("<100")
    return place_volume(orders).withColumn("tier", tier)


def stratified_place_sample(orders: DataFrame, shares: dict[str, int] | None = None) -> DataFrame:
    """Whole places: all of the busiest 20 %, 30 % of the middle, 10 % of the quietest 30 %.

    The draw hashes the place id, so every run and every partitioning keeps the same places.
    """
    shares = shares or {"high": 100, "medium": 30, "low": 10}
    volume = orders.groupBy("place_id").agg(F.count("*").alias("orders"))
    cuts = quantiles_wide(volume, ["orders"], [0.3, 0.8])
    high, low = cuts.select("q80").scalar(), cuts.select("q30").scalar()
    tier = F.when(F.col("orders") >= high, "high").when(F.col("orders") > low, "medium").otherwise("low")
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("tier")]
    draw = F.pmod(F.col("place_id") * 7919 + 13, F.lit(100))
    return volume.withColumn("tier", tier).where(draw < share)
