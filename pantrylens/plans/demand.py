"""Demand queries."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4, r8
from pantrylens.operators import classify, demand as d
from pantrylens.plans.registry import query
from pantrylens.sources.bindings import Bound

BRANDS = list(range(1, 26))


def weekly(b: Bound):
    return d.weekly_place_item(b.menu_lines, b.orders)


def weekly_ai(b: Bound):
    return d.weekly_place_item_by_line_time(b.menu_lines, b.orders)


def daily_item(b: Bound, period: str = "daily"):
    return d.demand_per_item(b.lines, b.orders, period)


def as_of(b: Bound):
    return F.to_date(b.raw("orders").agg(F.max("o_orderdate")).scalar())


DAILY_ORDERS = """
SELECT l.item_id, o.created::DATE AS date, sum(l.quantity) AS demand, sum(l.quantity * l.price) AS revenue
FROM {lines} l LEFT JOIN fct_orders o ON l.order_id = o.id GROUP BY 1, 2"""


@query(
    "daily_demand",
    f"SELECT item_id, date, demand, round(revenue, 2) AS revenue FROM ({DAILY_ORDERS.format(lines='fct_lines')})",
)
def _(b):
    return d.daily_demand(b.lines, b.orders).withColumn("revenue", F.round("revenue", 2))


@query(
    "daily_demand_direct",
    """SELECT item_id::BIGINT AS item_id, make_timestamp(created * 1000000)::DATE AS date,
    sum(coalesce(quantity, 0)) AS demand, round(sum(coalesce(quantity, 0) * coalesce(price, 0)), 2) AS revenue
    FROM (SELECT * REPLACE (created AS created) FROM lines_raw) GROUP BY 1, 2""",
)
def _(b):
    lines = b.lines_raw.withColumn("created", F.timestamp_seconds("created")).withColumn(
        "item_id", F.col("item_id").cast("bigint")
    )
    return d.daily_demand_direct(lines).withColumn("revenue", F.round("revenue", 2))


@query(
    "fill_missing_dates",
    f"""WITH_MENU SELECT g.item_id, g.date, coalesce(x.demand, 0) AS demand, round(coalesce(x.revenue, 0), 2) AS revenue
FROM (SELECT item_id, unnest(generate_series((SELECT min(date) FROM menu_daily)::TIMESTAMP,
        (SELECT max(date) FROM menu_daily)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
      FROM (SELECT DISTINCT item_id FROM menu_daily)) g
LEFT JOIN menu_daily x USING (item_id, date)""".replace("WITH_MENU", ""),
    ctes={"menu_daily": DAILY_ORDERS.format(lines="menu_lines")},
)
def _(b):
    return d.fill_missing_dates(d.daily_demand(b.menu_lines, b.orders)).withColumn("revenue", F.round("revenue", 2))


ITEM_PERIOD = """
SELECT l.item_id, {period} AS period, sum(l.quantity) AS demand_quantity, round(avg(l.price), 8) AS avg_price,
  round(sum(l.cost), 8) AS total_cost
FROM fct_lines l LEFT JOIN fct_orders o ON l.order_id = o.id {where} GROUP BY 1, 2"""
WEEK_LABEL = """strftime(date_trunc('week', o.created), '%Y-%m-%d') || '/' ||
 strftime(date_trunc('week', o.created) + INTERVAL 6 DAY, '%Y-%m-%d')"""


def _rounded(df):
    return df.withColumn("avg_price", r8("avg_price")).withColumn("total_cost", r8("total_cost"))


@query(
    "demand_per_item_daily",
    ITEM_PERIOD.format(period="o.created::DATE", where=""),
)
def _(b):
    return _rounded(d.demand_per_item(b.lines, b.orders, "daily"))


@query("demand_per_item_weekly", ITEM_PERIOD.format(period=WEEK_LABEL, where=""))
def _(b):
    return _rounded(d.demand_per_item(b.lines, b.orders, "weekly"))


@query("demand_per_item_monthly", ITEM_PERIOD.format(period="strftime(o.created, '%Y-%m')", where=""))
def _(b):
    return _rounded(d.demand_per_item(b.lines, b.orders, "monthly"))


@query(
    "demand_all_time",
    f"""SELECT * FROM ({ITEM_PERIOD.format(period="'all_time'", where="")})
UNION ALL
SELECT NULL, strftime(o.created, '%Y-%m'), sum(l.quantity), NULL, NULL
FROM fct_lines l LEFT JOIN fct_orders o ON l.order_id = o.id GROUP BY 2""",
)
def _(b):
    per_item = _rounded(d.demand_per_item(b.lines, b.orders, "all_time"))
    return per_item.unionByName(d.demand_per_period(b.lines, b.orders, "monthly"), allowMissingColumns=True)


@query(
    "demand_by_place",
    """SELECT l.item_id, o.place_id, strftime(o.created, '%Y-%m') AS period, sum(l.quantity) AS demand_quantity
FROM fct_lines l LEFT JOIN fct_orders o ON l.order_id = o.id GROUP BY 1, 2, 3""",
)
def _(b):
    return d.demand_by_place(b.lines, b.orders, "monthly")


@query(
    "weekly_place_item",
    """SELECT w.place_id, item_id, week_start, demand, transactions::BIGINT AS transactions, round(avg_price, 8) AS avg_price,
  first_transaction, last_transaction, days_active, coalesce(a.flag, false) AS is_active
FROM weekly w LEFT JOIN (SELECT p.id, max(o.created) >= TIMESTAMP '2001-07-31' - INTERVAL 90 DAY AS flag
  FROM dim_places p JOIN fct_orders o ON o.place_id = p.id GROUP BY 1) a ON w.place_id = a.id""",
)
def _(b):
    from pantrylens.operators.cleaning import place_activity

    flags = place_activity(b.places, b.orders, cutoff="2001-07-31")
    return d.with_active_flag(weekly(b), flags).withColumn("avg_price", r8("avg_price"))


@query(
    "weekly_place_item_ai",
    "SELECT place_id, item_id, week_start, demand, round(avg_price, 8) AS avg_price, transaction_count FROM weekly_ai",
)
def _(b):
    return weekly_ai(b).withColumn("avg_price", r8("avg_price"))


@query(
    "daily_demand_dashboard",
    """SELECT item_id::BIGINT AS item_id, make_timestamp(created * 1000000)::DATE AS date,
  sum(coalesce(quantity, 1)) AS daily_quantity, round(sum(coalesce(price, 0)), 8) AS daily_revenue
FROM lines_raw WHERE item_id IS NOT NULL GROUP BY 1, 2""",
)
def _(b):
    return d.daily_for_dashboard(b.lines_raw.withColumn("created", F.timestamp_seconds("created"))).withColumn(
        "daily_revenue", r8("daily_revenue")
    )


@query(
    "store_daily_total",
    "SELECT created::DATE AS date, sum(quantity) AS daily_quantity FROM fct_lines GROUP BY 1",
)
def _(b):
    return d.store_daily_total(d.daily_for_dashboard(b.lines))


ITEM_METRICS = """
SELECT i.id, i.title, i.type, i.price, coalesce(s.total, 0) AS total_quantity_sold,
  coalesce(s.total / greatest(date_diff('day', s.first_sale, s.last_sale) + 1, 1), 0) AS avg_daily_demand,
  coalesce(date_diff('day', s.last_sale, (SELECT max(o_orderdate)::DATE FROM orders)), 999) AS days_since_last_sale,
  s.last_sale AS last_sale_date
FROM dim_items i LEFT JOIN (SELECT item_id, sum(quantity) AS total, min(created)::DATE AS first_sale, max(created)::DATE AS last_sale
  FROM fct_lines GROUP BY 1) s ON i.id = s.item_id"""


def item_metrics(b: Bound):
    sold = d.daily_for_dashboard(b.lines)
    return d.item_metrics(b.items.select("id", "title", "type", "price"), sold, as_of(b))


@query("item_metrics", f"SELECT * REPLACE (round(avg_daily_demand, 8) AS avg_daily_demand) FROM ({ITEM_METRICS})")
def _(b):
    return item_metrics(b).withColumn("avg_daily_demand", r8("avg_daily_demand"))


@query(
    "historical_demand_stats",
    """SELECT item_id, sum(demand_quantity) AS total_demand, round(avg(demand_quantity), 4) AS avg_daily,
  round(coalesce(stddev_samp(demand_quantity), 0), 4) AS std_daily, max(demand_quantity) AS max_daily,
  count(*) AS days_with_sales, date_diff('day', max(period), (SELECT max(o_orderdate)::DATE FROM orders)) AS days_since_last_sale
FROM daily_item GROUP BY 1""",
)
def _(b):
    out = d.historical_demand_stats(daily_item(b), as_of(b))
    return out.withColumn("avg_daily", r4("avg_daily")).withColumn("std_daily", r4("std_daily"))


@query(
    "expand_full_calendar",
    "SELECT place_id, item_id, week_start, demand, transactions, days_active, true AS is_active FROM expanded",
)
def _(b):
    return d.expand_full_calendar(weekly(b)).drop("avg_price")


@query("price_forward_fill", "SELECT place_id, item_id, week_start, round(avg_price, 8) AS avg_price FROM expanded")
def _(b):
    return d.expand_full_calendar(weekly(b)).select("place_id", "item_id", "week_start", r8("avg_price").alias("avg_price"))


@query(
    "item_feature_agg",
    """SELECT item_id, sum(quantity) AS quantity_sum, round(avg(quantity), 4) AS quantity_mean,
  round(stddev_samp(quantity), 4) AS quantity_std, count(quantity) AS quantity_count, round(avg(price), 8) AS price_mean,
  round(stddev_samp(price), 4) AS price_std, round(sum(cost), 8) AS cost_sum, round(avg(cost), 8) AS cost_mean
FROM fct_lines GROUP BY 1""",
)
def _(b):
    out = d.item_feature_aggregates(b.lines)
    fine = {c: r8(c) for c in ("price_mean", "cost_sum", "cost_mean")}
    return out.withColumns({c: r4(c) for c in ("quantity_mean", "quantity_std", "price_std")} | fine)


@query(
    "demand_pivot",
    "SELECT period, "
    + ", ".join(f"round(coalesce(avg(q) FILTER (item_id = {i}), 0), 4) AS item_{i}" for i in BRANDS)
    + """ FROM (SELECT l.item_id, o.created::DATE AS period, sum(l.quantity) AS q FROM menu_lines l
      LEFT JOIN fct_orders o ON l.order_id = o.id GROUP BY 1, 2) GROUP BY 1""",
)
def _(b):
    out = d.demand_pivot(d.demand_per_item(b.menu_lines, b.orders), BRANDS)
    return out.withColumns({f"item_{i}": r4(f"item_{i}") for i in BRANDS})


@query("item_metadata", "SELECT id, title, price, status FROM dim_items")
def _(b):
    return d.item_metadata(b.items)


TOP_ITEMS = """
SELECT '{m}' AS metric, place_id, item_id, title, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY value DESC, item_id) AS rank FROM (
    SELECT place_id, item_id, round({e}, 4) AS value FROM weekly_ai GROUP BY 1, 2)) t
LEFT JOIN menu_items m ON t.item_id = m.id WHERE rank <= 8"""


@query(
    "top_items_per_place",
    " UNION ALL ".join(
        TOP_ITEMS.format(m=m, e=e)
        for m, e in [("demand", "sum(demand)"), ("revenue", "sum(demand * avg_price)"), ("frequency", "count(demand)::DOUBLE")]
    ),
)
def _(b):
    parts = [d.top_items_per_place(weekly_ai(b), b.menu_items, 8, m) for m in ("demand", "revenue", "frequency")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "active_places",
    """SELECT p.id, p.title, p.country, count(*) AS order_count, max(o.created)::DATE AS last_order
FROM dim_places p JOIN fct_orders o ON o.place_id = p.id GROUP BY 1, 2, 3
HAVING max(o.created)::DATE >= (SELECT max(created)::DATE FROM fct_orders) - INTERVAL 90 DAY""",
)
def _(b):
    return d.active_places(b.places, b.orders)


@query(
    "place_stats",
    """SELECT place_id, count(DISTINCT item_id) AS total_items, sum(demand) AS total_demand, count(DISTINCT week_start) AS weeks_active,
  round(sum(demand) / count(DISTINCT week_start), 4) AS avg_weekly_demand FROM weekly_ai GROUP BY 1""",
)
def _(b):
    return d.place_stats(weekly_ai(b)).withColumn("avg_weekly_demand", r4("avg_weekly_demand"))


@query(
    "place_slice",
    """SELECT w.place_id, w.item_id, m.title, sum(w.demand) AS total_demand, count(*) AS weeks,
  coalesce(any_value(s.demand_type), 'Insufficient Data') AS demand_type
FROM weekly_ai w LEFT JOIN menu_items m ON m.id = w.item_id LEFT JOIN sbc s ON s.place_id = w.place_id AND s.item_id = w.item_id
WHERE w.place_id = 3 GROUP BY 1, 2, 3""",
)
def _(b):
    return d.place_items(weekly_ai(b), b.menu_items, classify.sbc_classify(weekly(b)), 3)


@query(
    "item_history_last_n",
    """SELECT place_id, item_id, week_start, demand, round(avg_price, 8) AS avg_price, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY place_id, item_id ORDER BY week_start DESC) AS recency FROM weekly_ai) WHERE recency <= 52""",
)
def _(b):
    out = d.last_n_weeks(weekly_ai(b), 52)
    return out.select(
        "place_id", "item_id", "week_start", "demand", r8("avg_price").alias("avg_price"), F.col("recency").cast("bigint").alias("recency")
    )


@query(
    "top_n_places",
    """SELECT place_id, item_id, week_start, demand FROM weekly WHERE place_id IN (
  SELECT place_id FROM weekly GROUP BY 1 ORDER BY count(*) DESC, place_id LIMIT 3)""",
)
def _(b):
    return d.top_n_places(weekly(b).select("place_id", "item_id", "week_start", "demand"), 3)


@query(
    "enrich_titles",
    """SELECT q.place_id, q.item_id, coalesce(p.title, 'Location ' || q.place_id) AS place_title,
  coalesce(i.title, 'Item ' || q.item_id) AS item_title, coalesce(s.demand_type, 'Unknown') AS demand_type
FROM (SELECT DISTINCT o.place_id, l.item_id FROM menu_lines l JOIN fct_orders o ON o.id = l.order_id) q
LEFT JOIN dim_places p ON p.id = q.place_id LEFT JOIN menu_items i ON i.id = q.item_id
LEFT JOIN sbc s ON s.place_id = q.place_id AND s.item_id = q.item_id""",
)
def _(b):
    pairs = d.lines_with_orders(b.menu_lines, b.orders, "inner").select("place_id", "item_id").distinct()
    return d.enrich_titles(pairs, b.places, b.menu_items, classify.sbc_classify(weekly(b)))


def _share_sql(part: str, name: str) -> str:
    return f"""SELECT {part} AS {name}, count(*) AS orders, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS share_pct
FROM orders GROUP BY 1"""


@query("weekday_profile", _share_sql("isodow(o_orderdate) - 1", "weekday"))
def _(b):
    return d.weekday_profile(b.orders).withColumn("share_pct", r4("share_pct"))


@query("monthly_share", _share_sql("month(o_orderdate)", "month"))
def _(b):
    return d.monthly_share(b.orders).withColumn("share_pct", r4("share_pct"))


@query(
    "yearly_trend",
    """SELECT year, orders, round(100.0 * (orders - lag(orders) OVER (ORDER BY year)) / lag(orders) OVER (ORDER BY year), 4) AS yoy_growth_pct
FROM (SELECT year(o_orderdate) AS year, count(*) AS orders FROM orders GROUP BY 1)""",
)
def _(b):
    return d.yearly_trend(b.orders).withColumn("yoy_growth_pct", r4("yoy_growth_pct"))


@query(
    "pair_density",
    """SELECT count(*) AS pairs, count(*) FILTER (n >= 10) AS pairs_10, count(*) FILTER (n >= 50) AS pairs_50,
  count(*) FILTER (n >= 100) AS pairs_100, round(avg(n), 4) AS mean_transactions,
  quantile_cont(n::DOUBLE, 0.5) AS median_transactions
FROM (SELECT o.place_id, l.item_id, count(*) AS n FROM fct_lines l JOIN fct_orders o ON o.id = l.order_id GROUP BY 1, 2)""",
)
def _(b):
    return d.pair_density(b.lines, b.orders).withColumn("mean_transactions", r4("mean_transactions"))


@query(
    "min_history_filter",
    """SELECT place_id, item_id, date_diff('day', min(week_start), max(week_start)) // 7 + 1 AS history_weeks,
  count(*) FILTER (demand > 0) AS non_zero_weeks FROM weekly GROUP BY 1, 2
HAVING date_diff('day', min(week_start), max(week_start)) // 7 + 1 >= 52 AND count(*) FILTER (demand > 0) >= 26""",
)
def _(b):
    return d.min_history_pairs(weekly(b))


@query(
    "hierarchy_rollup",
    """SELECT place_id, item_id, type AS category, week_start, CASE WHEN grouping(place_id) = 0 THEN 'place_item'
  WHEN grouping(type) = 0 THEN 'category' ELSE 'item' END AS level, sum(demand) AS demand
FROM weekly w LEFT JOIN menu_items m ON m.id = w.item_id
GROUP BY GROUPING SETS ((place_id, item_id, week_start), (type, week_start), (item_id, week_start))""",
)
def _(b):
    return d.hierarchy_rollup(weekly(b), b.menu_items)


@query(
    "stratified_place_sample",
    """SELECT place_id, orders, tier FROM (SELECT *, CASE WHEN orders >= (SELECT quantile_cont(orders::DOUBLE, 0.8) FROM volume) THEN 'high'
   WHEN orders > (SELECT quantile_cont(orders::DOUBLE, 0.3) FROM volume) THEN 'medium' ELSE 'low' END AS tier FROM volume)
WHERE (place_id * 7919 + 13) % 100 < CASE tier WHEN 'high' THEN 100 WHEN 'medium' THEN 30 ELSE 10 END""",
    ctes={"volume": "SELECT o_custkey AS place_id, count(*) AS orders FROM orders GROUP BY 1"},
)
def _(b):
    return d.stratified_place_sample(b.orders.withColumn("place_id", F.col("user_id")))


@query(
    "place_volume_tiers",
    """SELECT o_custkey AS place_id, count(*) AS orders, count(DISTINCT o_orderdate::DATE) AS active_days, min(o_orderdate)::DATE AS first_order,
  max(o_orderdate)::DATE AS last_order, CASE WHEN count(*) >= 1000 THEN '1000+' WHEN count(*) >= 100 THEN '100+' ELSE '<100' END AS tier
FROM orders GROUP BY 1""",
)
def _(b):
    return d.place_volume_tiers(b.orders.withColumn("place_id", F.col("user_id")))
