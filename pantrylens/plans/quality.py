"""Queries of profiles and validation, over the tables as they come."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4
from pantrylens.operators import demand as d, profiling as p
from pantrylens.plans.demand import weekly
from pantrylens.plans.registry import query

# The domain's name of each table, its SQL name, and its columns: those of numbers, then the others.
COLUMNS = {
    "fct_orders": (
        "orders_raw",
        "id place_id user_id created total_amount demo_mode",
        "type status payment_method customer_name external_id account_id customer_mobile_phone",
    ),
    "fct_order_items": (
        "lines_raw",
        "id user_id created item_id order_id quantity price cost commission_amount discount_amount",
        "add_on_ids status",
    ),
    "dim_items": ("items_raw", "id section_id rating purchases price", "title type status"),
    "dim_places": ("dim_places", "id inventory_management", "title country"),
    "dim_skus": ("dim_skus", "id quantity low_stock_threshold place_id days_to_expiry shelf_life_days", "title unit"),
}
# The columns that each table must and may have.
SCHEMAS = {
    "fct_orders": {"required": ["id", "created"], "optional": ["place_id", "status", "total", "payment_method"]},
    "fct_order_items": {"required": ["id", "order_id", "item_id", "quantity"], "optional": ["price", "cost", "discount"]},
    "dim_skus": {"required": ["id"], "optional": ["title", "quantity", "unit", "low_stock_threshold", "place_id"]},
    "dim_menu_items": {"required": ["id", "title"], "optional": ["price", "status", "category_id"]},
}
INTEGERS = {"fct_orders": ["id", "place_id", "user_id"], "fct_order_items": ["id", "order_id", "item_id", "price"], "dim_skus": ["id", "quantity"]}
REQUIRED = ["orders", "lineitem", "customer", "part", "supplier", "nation", "region", "events", "inventory_reports"]
#: The given tables begin in 1995, before the seconds that by default look like a point in time.
LEAST_EPOCH = 500_000_000


def _cells(numeric_only=False):
    for table, (view, numeric, other) in COLUMNS.items():
        for column in numeric.split():
            yield table, view, column, True
        for column in () if numeric_only else other.split():
            yield table, view, column, False


def _measured_sql(table, view, c, numeric):
    of = (
        f"avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most, "
        f"count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} <> floor({c})) AS fractions"
        if numeric
        else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS least, NULL::DOUBLE AS most, 0 AS negatives, 0 AS fractions"
    )
    return f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", typeof(any_value({c})) AS kind, count(*) AS rows, count(*) - count({c}) AS nulls, {of} FROM {view}"


def pct(part, whole="rows"):
    return f"coalesce(((20000 * {part} + {whole}) // nullif(2 * {whole}, 0)) / 100.0::DOUBLE, 0)"


def like(*words):
    return "(" + " OR ".join(f"contains(\"column\", '{w}')" for w in words) + ")"


KEY = "(\"column\" = 'id' OR \"column\" LIKE '%\\_id' ESCAPE '\\')"
FOREIGN = "(\"column\" LIKE '%\\_id' ESCAPE '\\' AND starts_with(\"table\", 'fct_'))"
AMOUNT = like("quantity", "amount", "price", "cost")
CTES = {
    "measured": " UNION ALL ".join(_measured_sql(*cell) for cell in _cells()),
    "repeated_rows": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", a.n AS rows, a.n - b.n AS duplicate_rows FROM (SELECT count(*) AS n FROM {v}) a, (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM {v})) b"
        for t, (v, _, _) in COLUMNS.items()
    ),
    "repeated_keys": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, count(*) - count(DISTINCT id) - CASE WHEN count(id) < count(*) THEN 1 ELSE 0 END AS duplicate_keys FROM {v}"
        for t, (v, _, _) in COLUMNS.items()
    ),
    "readiness_rows": f"""
SELECT "table", greatest(points, 0)::BIGINT AS score,
  CASE WHEN points >= 80 THEN 'ready' WHEN points >= 50 THEN 'needs_cleaning' ELSE 'critical_issues' END AS status, issues::BIGINT AS issues
FROM (SELECT *, 100 - 50 * e - 30 * k - 20 * bad_keys - 10 * g - 5 * n - 10 * f AS points, e + k + bad_keys + g + n + f AS issues FROM (
  SELECT m."table", (max(m.rows) = 0)::INT AS e, (any_value(r.duplicate_keys) > 0)::INT AS k, count(*) FILTER (m.is_key AND m.pct > 50) AS bad_keys,
    (count(*) FILTER (NOT m.is_key AND m.pct > 20) > 5)::INT AS g, (count(*) FILTER (m.is_amount AND m.negatives > 0) > 0)::INT AS n,
    (count(*) FILTER (m.is_foreign AND m.pct > 30) > 0)::INT AS f
  FROM (SELECT *, {pct("nulls")} AS pct, {KEY} AS is_key, {AMOUNT} AS is_amount, {FOREIGN} AS is_foreign FROM measured) m
  LEFT JOIN repeated_keys r ON r."table" = m."table" GROUP BY 1))""",
    "event_texts": "SELECT CASE WHEN event_id % 9 = 0 THEN 'not a date' WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created FROM events",
}


def q(name, sql):
    return query(name, sql, CTES)


def catalogue(b):
    return {"fct_orders": b.orders_raw, "fct_order_items": b.lines_raw, "dim_items": b.items_raw, "dim_places": b.places, "dim_skus": b.skus}


def measured(b):
    return p.measures(catalogue(b))


@q("profile_nulls", f'SELECT "table", "column", nulls, {pct("nulls")} AS null_pct FROM measured')
def _(b):
    return p.null_profile(measured(b))


@q("profile_duplicate_rows", 'SELECT "table", rows, duplicate_rows FROM repeated_rows')
def _(b):
    return p.duplicate_rows(catalogue(b))


@q(
    "profile_numeric",
    'SELECT "table", "column", round(mean, 4) AS mean, round(std, 2) AS std, least, most, rows - nulls AS non_null, median FROM measured JOIN ('
    + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median FROM {v}" for t, v, c, _ in _cells(True))
    + ') USING ("table", "column") WHERE rows > nulls',
)
def _(b):
    found = p.numeric_profile(catalogue(b), measured(b))
    # A median can lie half-way between two fourth decimals when written out, and below that as a double: the double counts.
    median, size = F.col("median"), F.abs("median")
    near = F.when(size < 1e11, F.signum(median) * F.floor(size * 10_000 + 0.5) / 10_000).otherwise(r4(median))
    return found.withColumns({"mean": r4("mean"), "median": near, "std": F.round("std", 2)})


@q(
    "profile_date_range",
    f"""SELECT "table", "column", least::BIGINT AS first_second, most::BIGINT AS last_second,
  strftime(make_timestamp(least::BIGINT * 1000000), '%Y-%m-%d') AS first_day, strftime(make_timestamp(most::BIGINT * 1000000), '%Y-%m-%d') AS last_day
FROM measured WHERE {like("created", "updated")} AND least > {LEAST_EPOCH}""",
)
def _(b):
    return p.date_ranges(measured(b), LEAST_EPOCH)


@q(
    "profile_types",
    f"""SELECT "table", "column", CASE WHEN {like("created", "updated", "time", "date")} AND least > {LEAST_EPOCH} AND most < 2147483647 THEN 'timestamp'
  WHEN {KEY} THEN 'id' WHEN {like("amount", "price", "cost", "quantity", "points")} THEN 'numeric'
  WHEN {like("status", "type", "channel", "method")} THEN 'categorical' WHEN kind IN ('BIGINT', 'INTEGER') THEN 'integer'
  WHEN kind = 'DOUBLE' THEN 'float' WHEN kind = 'VARCHAR' THEN 'string' END AS role FROM measured""",
)
def _(b):
    return p.column_roles(measured(b), LEAST_EPOCH)


@q(
    "issue_negatives",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS negatives, min({c})::DOUBLE AS least, "
        f"to_json(list_slice(list_sort(list(DISTINCT {c}::DOUBLE)), 1, 5))::VARCHAR AS samples FROM {v} WHERE {c} < 0 HAVING count(*) > 0"
        for t, v, c, _ in _cells(True)
        if any(w in c for w in ("quantity", "amount", "price", "cost"))
    ),
)
def _(b):
    return p.negative_issues(catalogue(b))


@q("issue_duplicate_keys", 'SELECT "table", rows, duplicate_keys FROM repeated_keys WHERE duplicate_keys > 0')
def _(b):
    return p.duplicate_keys(catalogue(b)).where("duplicate_keys > 0")


@q("issue_missing_fk", f'SELECT "table", "column", nulls, {pct("nulls")} AS null_pct FROM measured WHERE {FOREIGN} AND nulls > 0')
def _(b):
    return p.missing_keys(measured(b))


@q(
    "issue_outliers",
    f"SELECT \"table\", \"column\", outliers, {pct('outliers')} AS outlier_pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", (SELECT count(*) FROM {v}) AS rows, count({c}) AS n, any_value(q3) > any_value(q1) AS wide, "
        f"count(*) FILTER ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS outliers FROM {v}, "
        f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {v})"
        for t, v, c, _ in _cells(True)
    )
    + ") WHERE wide AND n > 10 AND outliers > 0",
)
def _(b):
    return p.outlier_issues(catalogue(b), measured(b))


def ready(b):
    return p.readiness(measured(b), p.duplicate_keys(catalogue(b)))


@q("readiness_score", 'SELECT "table", score, status, issues FROM readiness_rows')
def _(b):
    return ready(b)


@q(
    "suspicious_columns",
    f"""SELECT "table", "column", 'missing values' AS issue, 'high' AS severity FROM measured WHERE {pct("nulls")} > 80 UNION ALL
SELECT "table", "column", 'negative quantities', 'critical' FROM measured WHERE "table" = 'dim_skus' AND contains("column", 'quantity') AND negatives > 0""",
)
def _(b):
    return p.suspicious_columns(measured(b))


@q(
    "quality_report",
    """SELECT status, count(*) AS n_tables, string_agg("table", ', ' ORDER BY "table") AS tables, min(score) AS least_score FROM readiness_rows GROUP BY 1""",
)
def _(b):
    return p.quality_report(ready(b))


@q(
    "validate_required_columns",
    'SELECT w."table", w."column", need, coalesce(rows - nulls, 0) AS filled, CASE WHEN m.rows IS NOT NULL THEN \'present\' '
    "WHEN need = 'required' THEN 'error' ELSE 'absent' END AS status FROM (VALUES "
    + ", ".join(f"('{t}', '{c}', '{need}')" for t, needs in SCHEMAS.items() for need, columns in needs.items() for c in columns)
    + ') w("table", "column", need) LEFT JOIN measured m ON m."table" = w."table" AND m."column" = w."column"',
)
def _(b):
    return p.required_columns(measured(b), SCHEMAS)


def _seconds_sql(table, view):
    return f"""SELECT '{table}' AS "table", 'created' AS "column", count(*) AS filled, count(*) FILTER (created <= 1577836800 OR created >= 1893456000) AS bad_rows,
  'unusual' AS wrong FROM {view} WHERE created IS NOT NULL"""


@q(
    "validate_timestamps",
    f"""SELECT "table", "column", filled, bad_rows, {pct("bad_rows", "filled")} AS bad_pct,
  CASE WHEN filled = 0 THEN 'empty' WHEN bad_rows > 0 THEN wrong ELSE 'ok' END AS status FROM (
{_seconds_sql("fct_orders", "orders_raw")} UNION ALL {_seconds_sql("fct_order_items", "lines_raw")} UNION ALL
SELECT 'events', 'created', count(*), count(*) FILTER (try_cast(created AS TIMESTAMP) IS NULL), 'unparseable' FROM event_texts WHERE created IS NOT NULL)""",
)
def _(b):
    event = F.col("event_id")
    text = F.when(event % 9 == 0, "not a date").when(event % 11 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return p.valid_timestamps({**catalogue(b), "events": b.raw("events").select(text.alias("created"))}, ["created", "updated", "expires_at"])


@q(
    "validate_missing_thresholds",
    f"""SELECT "table", "column", nulls, {pct("nulls")} AS null_pct, CASE WHEN nulls > 0.2 * rows THEN 'critical' WHEN nulls > 0.05 * rows THEN 'warning'
  ELSE 'info' END AS severity FROM measured WHERE nulls > 0""",
)
def _(b):
    return p.missing_thresholds(measured(b))


@q(
    "validate_duplicates",
    """SELECT "table", duplicate_rows, coalesce(duplicate_keys, 0) AS duplicate_keys, CASE WHEN duplicate_rows > 100 THEN 'critical'
  WHEN duplicate_rows > 10 OR duplicate_keys > 0 THEN 'warning' ELSE 'ok' END AS severity
FROM repeated_rows LEFT JOIN repeated_keys USING ("table")""",
)
def _(b):
    return p.valid_duplicates(p.duplicate_rows(catalogue(b)), p.duplicate_keys(catalogue(b)))


@q(
    "check_negative_demand",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS rows, count(*) FILTER ({c} < 0) AS negative_rows, negative_rows = 0 AS passed FROM {v}"
        for n, v, c in (("weekly_place_item", "weekly", "demand"), ("daily_item", "daily_item", "demand_quantity"), ("order_items", "lines_raw", "quantity"))
    ),
)
def _(b):
    daily = d.demand_per_item(b.lines, b.orders)
    return p.negative_demand({"weekly_place_item": (weekly(b), "demand"), "daily_item": (daily, "demand_quantity"), "order_items": (b.lines_raw, "quantity")})


@q(
    "check_integer_typed",
    "SELECT \"table\", \"column\", CASE kind WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE lower(kind) END AS kind, fractions::BIGINT AS fractions, "
    'fractions = 0 AS passed FROM measured WHERE ("table", "column") IN (' + ", ".join(f"('{t}', '{c}')" for t, columns in INTEGERS.items() for c in columns) + ")",
)
def _(b):
    return p.whole_numbers(measured(b), INTEGERS)


@q(
    "check_tables_present",
    " UNION ALL ".join(
        "SELECT 'inventory_reports' AS \"table\", 0::BIGINT AS rows, 'missing' AS status"
        if t == "inventory_reports"
        else f"SELECT '{t}' AS \"table\", count(*) AS rows, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status FROM {t}"
        for t in REQUIRED
    ),
)
def _(b):
    return p.tables_present({t: b.raw(t) for t in REQUIRED if t != "inventory_reports"}, REQUIRED)
