"""Cleaning queries over the raw tables."""

from pyspark.sql import functions as F

from pantrylens.operators import cleaning as c
from pantrylens.plans.registry import query

TEXT_TIME = "yyyy-MM-dd HH:mm:ss"
SQL_TIME = "'%Y-%m-%d %H:%M:%S'"
LINE_VALUES = "quantity, price, cost, commission_amount, discount_amount"
AMOUNTS = [c.strip() for c in LINE_VALUES.split(",")]

CTES = {
    "kept_orders": """
SELECT * FROM orders_raw WHERE coalesce(demo_mode, 0) <> 1
  AND coalesce(status NOT IN ('cancelled', 'Cancelled', 'CANCELLED'), true)""",
    "order_modes": "SELECT "
    + ", ".join(
        f"(SELECT {x} FROM orders_raw WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {x} LIMIT 1) AS {x}_mode"
        for x in ("type", "status", "payment_method")
    ),
    "live_places": """
SELECT place_id AS id FROM fct_orders GROUP BY 1 HAVING max(created) >= TIMESTAMP '2001-07-31' - INTERVAL 90 DAY""",
}


def q(name, sql):
    return query(name, sql, CTES)


def text_time(column):
    return F.date_format(column, TEXT_TIME).alias(column)


@q(
    "epoch_to_timestamp",
    f"SELECT id, strftime(make_timestamp(created * 1000000), {SQL_TIME}) AS created FROM orders_raw",
)
def _(b):
    return c.epoch_to_timestamp(b.orders_raw, ["created"], earliest=0).select("id", text_time("created"))


@q("standardize_ids", "SELECT id, user_id, item_id::BIGINT AS item_id, order_id::BIGINT AS order_id FROM lines_raw")
def _(b):
    return c.standardize_ids(b.lines_raw).select("id", "user_id", "item_id", "order_id")


@q("fill_missing_numeric", "SELECT id, order_id, " + ", ".join(f"coalesce({x}, 0) AS {x}" for x in AMOUNTS) + " FROM lines_raw")
def _(b):
    return c.fill_missing_numeric(b.lines_raw).select("id", "order_id", *AMOUNTS)


@q(
    "fill_missing_mode",
    """SELECT id, coalesce(type, type_mode, 'Unknown') AS type, coalesce(status, status_mode, 'Unknown') AS status,
  coalesce(payment_method, payment_method_mode, 'Unknown') AS payment_method FROM orders_raw, order_modes""",
)
def _(b):
    return c.fill_missing_mode(b.orders_raw).select("id", "type", "status", "payment_method")


@q("fill_missing_text", "SELECT id, coalesce(title, '') AS title, type, status FROM items_raw")
def _(b):
    return c.fill_missing_text(b.items_raw).select("id", "title", "type", "status")


@q(
    "dedup_by_key",
    """SELECT id, user_id, item_id, quantity, price FROM lines_raw
QUALIFY row_number() OVER (PARTITION BY id ORDER BY user_id NULLS FIRST, item_id NULLS FIRST, quantity NULLS FIRST, price NULLS FIRST) = 1""",
)
def _(b):
    return c.dedup_by_key(b.lines_raw.select("id", "user_id", "item_id", "quantity", "price"))


@q("negatives_clamp", "SELECT id, greatest(quantity, 0) AS quantity, low_stock_threshold FROM dim_skus")
def _(b):
    return c.negatives_clamp(b.skus).select("id", "quantity", "low_stock_threshold")


def _fence(x: str) -> str:
    low, high = (f"(SELECT quantile_cont({x}, {p}) FROM items_raw)" for p in (0.25, 0.75))
    spread = f"({high} - {low})"
    return f"""CASE WHEN (SELECT count({x}) FROM items_raw) > 10 AND {spread} > 0
    THEN coalesce({x} < {low} - 3 * {spread} OR {x} > {high} + 3 * {spread}, false) END AS {x}_outlier_flag"""


@q("flag_outliers_iqr", f"SELECT id, {_fence('price')}, {_fence('purchases')} FROM items_raw")
def _(b):
    flagged = c.flag_outliers(b.items_raw, ["price", "purchases"])
    return flagged.select("id", "price_outlier_flag", "purchases_outlier_flag")


@q("filter_demo_cancelled", "SELECT id, place_id, status, demo_mode FROM kept_orders")
def _(b):
    return c.filter_demo_cancelled(b.orders_raw).select("id", "place_id", "status", "demo_mode")


@q("drop_pii", "SELECT id, place_id, user_id, created, total_amount, type, status, payment_method, demo_mode FROM orders_raw")
def _(b):
    return c.drop_pii(b.orders_raw)


@q("orphan_lines_semi", "SELECT id, order_id, item_id FROM lines_raw WHERE order_id IN (SELECT id FROM kept_orders)")
def _(b):
    kept = c.filter_demo_cancelled(b.orders_raw)
    return c.restrict_to(c.standardize_ids(b.lines_raw), kept, "order_id").select(
        "id", F.col("order_id").cast("double").alias("order_id"), F.col("item_id").cast("double").alias("item_id")
    )


@q(
    "nonneg_quantity",
    """SELECT id, order_id, quantity, coalesce(discount_amount, 0) AS discount_amount FROM lines_raw
WHERE quantity >= 0 AND order_id IS NOT NULL""",
)
def _(b):
    kept = c.nonneg_quantity(b.lines_raw, need_order=True)
    return kept.select("id", "order_id", "quantity", "discount_amount")


@q("clean_item_dim", "SELECT id, title, section_id, status, price FROM items_raw")
def _(b):
    return c.clean_items(b.items_raw)


@q(
    "place_activity",
    """SELECT p.id, p.title, min(o.created)::DATE AS first_order, max(o.created)::DATE AS last_order, count(o.id) AS order_count,
  coalesce(max(o.created) >= TIMESTAMP '2001-07-31' - INTERVAL 90 DAY, false) AS active_flag
FROM dim_places p LEFT JOIN fct_orders o ON o.place_id = p.id GROUP BY 1, 2""",
)
def _(b):
    out = c.place_activity(b.places, b.orders, cutoff="2001-07-31")
    return out.select(
        "id", "title", F.to_date("first_order").alias("first_order"), F.to_date("last_order").alias("last_order"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"), "active_flag",
    )


@q(
    "place_active_relative",
    """SELECT p.id, p.title, p.id IN (SELECT place_id FROM fct_orders
  WHERE created >= (SELECT max(created) FROM fct_orders) - INTERVAL 90 DAY) AS is_active FROM dim_places p""",
)
def _(b):
    return c.place_active_relative(b.places, b.orders).select("id", "title", "is_active")


@q(
    "restrict_active",
    """SELECT l.id, l.order_id, l.item_id, l.quantity FROM fct_lines l
WHERE l.order_id IN (SELECT id FROM fct_orders WHERE place_id IN (SELECT id FROM live_places))""",
)
def _(b):
    flags = c.place_activity(b.places, b.orders, cutoff="2001-07-31")
    return c.restrict_active(b.orders, b.lines, flags)[1].select("id", "order_id", "item_id", "quantity")


@q(
    "clean_table_pipeline",
    f"""SELECT id, place_id, strftime(make_timestamp(created * 1000000), {SQL_TIME}) AS created,
  coalesce(total_amount, 0) AS total_amount, coalesce(type, type_mode) AS type, coalesce(status, status_mode) AS status,
  coalesce(payment_method, payment_method_mode) AS payment_method FROM orders_raw, order_modes""",
)
def _(b):
    out = c.clean_table(b.orders_raw, earliest=0)
    return out.select("id", "place_id", text_time("created"), "total_amount", "type", "status", "payment_method")


@q(
    "cleaning_summary",
    """SELECT *, rows_before - rows_after AS rows_removed FROM (
  SELECT 'orders' AS "table", (SELECT count(*) FROM orders_raw) AS rows_before, (SELECT count(DISTINCT id) FROM kept_orders) AS rows_after
  UNION ALL
  SELECT 'lines', (SELECT count(*) FROM lines_raw), (SELECT count(DISTINCT id) FROM lines_raw
    WHERE quantity >= 0 AND order_id IN (SELECT id FROM kept_orders)))""",
)
def _(b):
    orders = c.clean_orders(b.orders_raw)
    lines = c.clean_order_lines(b.lines_raw, orders)
    return c.cleaning_summary({"orders": b.orders_raw, "lines": b.lines_raw}, {"orders": orders, "lines": lines})


@q(
    "fill_missing_strategies",
    """SELECT 'drop' AS strategy, id, title, price FROM items_raw WHERE title IS NOT NULL AND type IS NOT NULL AND status IS NOT NULL
  AND rating IS NOT NULL AND purchases IS NOT NULL AND price IS NOT NULL AND section_id IS NOT NULL
UNION ALL SELECT 'zero', id, coalesce(title, ''), coalesce(price, 0) FROM items_raw
UNION ALL SELECT 'forward_fill', id, last_value(title IGNORE NULLS) OVER w, last_value(price IGNORE NULLS) OVER w FROM items_raw
  WINDOW w AS (PARTITION BY section_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(b):
    parts = [
        c.fill_missing(b.items_raw, strategy, "section_id", "id").select(F.lit(strategy).alias("strategy"), "id", "title", "price")
        for strategy in ("drop", "zero", "forward_fill")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
