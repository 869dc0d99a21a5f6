"""SQL twins of the bound domain tables and of the intermediate results shared by many checks."""

PLACE = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END"""
NET = "(l_extendedprice / l_quantity)"

CTES: dict[str, str] = {
    "fct_orders": f"""
SELECT o_orderkey AS id, ({PLACE})::BIGINT AS place_id, o_custkey AS user_id, o_orderdate AS created,
       o_totalprice AS total_amount, o_orderstatus AS status, o_orderpriority AS type
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "orders_raw": f"""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 <> 0 THEN ({PLACE})::BIGINT END AS place_id, o_custkey AS user_id,
  epoch(o_orderdate)::BIGINT AS created, CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS total_amount,
  o_orderpriority AS type,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'Cancelled' ELSE 'CANCELLED' END
       WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 3 THEN 'Card' ELSE 'Cash' END AS payment_method,
  CASE WHEN o_orderkey % 8 = 0 THEN 1 WHEN o_orderkey % 8 > 3 THEN 0 END::INTEGER AS demo_mode,
  c_name AS customer_name, 'ext-' || o_orderkey AS external_id, 'acc-' || o_custkey AS account_id,
  '+45' || (o_orderkey % 99999999) AS customer_mobile_phone
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "lines_raw": f"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS user_id, epoch(l_shipdate)::BIGINT AS created,
  l_partkey::DOUBLE AS item_id,
  CASE WHEN (l_orderkey + l_partkey) % 29 = 0 THEN NULL
       WHEN (l_orderkey + l_partkey) % 31 = 0 THEN (l_orderkey + 100000000)::DOUBLE
       ELSE l_orderkey::DOUBLE END AS order_id,
  CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN (l_orderkey + l_partkey) % 13 = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 41 <> 0 THEN {NET} END AS price, {NET} * 0.6::DOUBLE AS cost,
  l_extendedprice * l_tax AS commission_amount,
  CASE WHEN l_linenumber <> 3 THEN l_extendedprice * l_discount END AS discount_amount,
  CASE WHEN l_partkey % 3 = 0 THEN '[' || l_partkey || ']' END AS add_on_ids,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END AS status
FROM lineitem""",
    "fct_lines": f"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS item_id, l_quantity AS quantity,
  {NET} AS price, {NET} * 0.6::DOUBLE AS cost, l_shipdate AS created
FROM lineitem""",
    "menu_lines": """
SELECT f.id, f.order_id, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS item_id, f.quantity, f.price, f.cost, f.created
FROM fct_lines f JOIN part ON f.item_id = p_partkey""",
    "dim_items": """
SELECT p_partkey AS id, p_size::BIGINT AS section_id, p_name AS title, p_type AS type,
  CASE WHEN p_partkey % 9 = 0 THEN 'Inactive' ELSE 'Active' END AS status, p_retailprice AS price
FROM part""",
    "items_raw": """
SELECT p_partkey AS id, p_size::BIGINT AS section_id, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS title,
  CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS type, CASE WHEN p_partkey % 13 <> 0 THEN 'Active' END AS status,
  CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 50) / 10.0::DOUBLE END AS rating,
  CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 400)::DOUBLE END AS purchases,
  CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price
FROM part""",
    "menu_items": """
SELECT regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS id, min(p_brand) AS title, max(p_retailprice) AS price, min(p_type) AS type
FROM part GROUP BY 1""",
    "dim_places": f"""
SELECT ({PLACE})::BIGINT AS id, c_mktsegment AS title, min(c_nationkey)::VARCHAR AS country, count(*) AS inventory_management
FROM customer GROUP BY 1, 2""",
    "dim_skus": """
SELECT p_partkey AS id, p_name AS title, ((p_partkey * 37) % 400 - 20)::DOUBLE AS quantity,
  (p_size * 2)::DOUBLE AS low_stock_threshold, CASE WHEN p_partkey % 2 = 0 THEN 'kg' ELSE 'pcs' END AS unit,
  p_partkey % 5 + 1 AS place_id, CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * 13) % 45 END AS days_to_expiry,
  p_partkey % 6 * 10 + 5 AS shelf_life_days
FROM part""",
    "dim_stock": """
SELECT id AS item_id, greatest(quantity, 0) AS current_stock, days_to_expiry, shelf_life_days FROM dim_skus""",
    "dim_bom": """
SELECT p_partkey AS parent_sku_id, p_partkey - p_partkey % 10 AS sku_id, (p_size % 4 + 1)::DOUBLE AS quantity FROM part
UNION ALL
SELECT p_partkey, p_partkey - p_partkey % 100, 0.5::DOUBLE FROM part""",
    "daily_events": """
SELECT user_id * 10 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
  WHEN 'view' THEN 4 END AS item_id, ts::DATE AS date, sum(ceil(value)) AS demand
FROM events GROUP BY 1, 2""",
    # ---- demand tables -------------------------------------------------------------------
    "daily_item": """
SELECT l.item_id, o.created::DATE AS period, sum(l.quantity) AS demand_quantity, avg(l.price) AS avg_price, sum(l.cost) AS total_cost
FROM fct_lines l LEFT JOIN fct_orders o ON l.order_id = o.id GROUP BY 1, 2""",
    "weekly": """
SELECT o.place_id, l.item_id, date_trunc('week', o.created)::DATE AS week_start, sum(l.quantity) AS demand,
  count(l.id) AS transactions, avg(l.price) AS avg_price, min(o.created)::DATE AS first_transaction,
  max(o.created)::DATE AS last_transaction, count(DISTINCT o.created::DATE) AS days_active
FROM menu_lines l JOIN fct_orders o ON l.order_id = o.id GROUP BY 1, 2, 3""",
    "weekly_ai": """
SELECT o.place_id, l.item_id, date_trunc('week', l.created)::DATE AS week_start, sum(l.quantity) AS demand,
  avg(l.price) AS avg_price, count(l.id) AS transaction_count
FROM menu_lines l JOIN fct_orders o ON l.order_id = o.id GROUP BY 1, 2, 3""",
    "calendar": """
SELECT place_id, item_id, unnest(generate_series((SELECT min(week_start) FROM weekly)::TIMESTAMP,
  (SELECT max(week_start) FROM weekly)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS week_start
FROM (SELECT DISTINCT place_id, item_id FROM weekly)""",
    "expanded": """
SELECT c.place_id, c.item_id, c.week_start, coalesce(w.demand, 0) AS demand, coalesce(w.transactions, 0) AS transactions,
  coalesce(w.days_active, 0) AS days_active, w.avg_price AS raw_price,
  coalesce(last_value(w.avg_price IGNORE NULLS) OVER (PARTITION BY c.place_id, c.item_id ORDER BY c.week_start
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(w.avg_price IGNORE NULLS) OVER (PARTITION BY c.place_id, c.item_id ORDER BY c.week_start
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS avg_price
FROM calendar c LEFT JOIN weekly w USING (place_id, item_id, week_start)""",
    "sbc": """
SELECT *, CASE WHEN non_zero_weeks < 2 THEN 'Insufficient Data'
   WHEN adi <= 1.32 THEN CASE WHEN cv2 <= 0.49 THEN 'Smooth' ELSE 'Erratic' END
   ELSE CASE WHEN cv2 <= 0.49 THEN 'Intermittent' ELSE 'Lumpy' END END AS demand_type
FROM (SELECT place_id, item_id, count(*) AS total_weeks, count(*) FILTER (demand > 0) AS non_zero_weeks,
        count(*)::DOUBLE / nullif(count(*) FILTER (demand > 0), 0) AS adi,
        power(coalesce(stddev_samp(demand) FILTER (demand > 0), 0) / avg(demand) FILTER (demand > 0), 2) AS cv2,
        min(week_start) FILTER (demand > 0) AS first_demand, max(week_start) FILTER (demand > 0) AS last_demand
      FROM expanded GROUP BY 1, 2)""",
}
