"""Queries of data quality: keys without parents and features that know too much."""

from pantrylens.functions.stats import r4
from pantrylens.operators import integrity as i
from pantrylens.plans.demand import weekly
from pantrylens.plans.features import FEATURES_SQL, HOLIDAY_CTE, TRAIN_END, VAL_END, features
from pantrylens.plans.registry import query

RELATIONS = {
    "lines.order_id -> orders.id": ("lines_raw", "order_id", "orders_raw", "id"),
    "lines.item_id -> items.id": ("lines_raw", "item_id", "items_raw", "id"),
    "orders.place_id -> places.id": ("orders_raw", "place_id", "dim_places", "id"),
}
LEAKS = {
    "train_before_split": ("train_val_test_flag = 'train'", f"week_start <= DATE '{TRAIN_END}'"),
    "val_between_splits": ("train_val_test_flag = 'val'", f"week_start > DATE '{TRAIN_END}' AND week_start <= DATE '{VAL_END}'"),
    "test_after_splits": ("train_val_test_flag = 'test'", f"week_start > DATE '{VAL_END}'"),
    **{f"{lag}_is_past_demand": ("true", f"{lag} = back_{k}") for lag, k in i.LAGS.items()},
    "roll_max_4w_is_past": ("true", "roll_max_4w <= greatest(back_1, back_2, back_3, back_4)"),
    "roll_min_4w_is_past": ("true", "roll_min_4w >= least(back_1, back_2, back_3, back_4)"),
}
CTES = {
    **HOLIDAY_CTE,
    "feature_rows": FEATURES_SQL,
    "compared": "SELECT f.*, "
    + ", ".join(f"coalesce(b{k}.demand, 0) AS back_{k}" for k in (1, 2, 3, 4, 52))
    + " FROM feature_rows f "
    + " ".join(
        f"LEFT JOIN weekly b{k} ON b{k}.place_id = f.place_id AND b{k}.item_id = f.item_id AND b{k}.week_start = f.week_start - {7 * k}"
        for k in (1, 2, 3, 4, 52)
    ),
}


def relations(b):
    tables = {"lines_raw": b.lines_raw, "orders_raw": b.orders_raw, "items_raw": b.items_raw, "dim_places": b.places}
    return [i.Relation(n, tables[child], column, tables[parent], key) for n, (child, column, parent, key) in RELATIONS.items()]


def _relation_sql(name, child, column, parent, key):
    return f"""SELECT '{name}' AS relation, count(*) AS child_rows, count(*) FILTER (c.{column} IS NULL) AS null_rows,
  count(*) FILTER (c.{column} IS NOT NULL AND p.k IS NULL) AS orphan_rows, count(DISTINCT CASE WHEN p.k IS NULL THEN c.{column} END) AS orphan_keys
FROM {child} c LEFT JOIN (SELECT DISTINCT {key} AS k FROM {parent}) p ON p.k = c.{column}"""


@query(
    "referential_integrity",
    "SELECT *, round(100.0::DOUBLE * (child_rows - null_rows - orphan_rows) / (child_rows - null_rows), 4) AS integrity_pct, "
    "CASE WHEN orphan_rows = 0 THEN 'ok' WHEN integrity_pct >= 95 THEN 'warning' ELSE 'broken' END AS status FROM ("
    + " UNION ALL ".join(_relation_sql(n, *r) for n, r in RELATIONS.items())
    + ")",
)
def _(b):
    return i.referential_integrity(relations(b)).withColumn("integrity_pct", r4("integrity_pct"))


@query(
    "check_leakage",
    "SELECT \"check\", rows, violations, violations = 0 AS passed FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", count(*) FILTER ({of}) AS rows, count(*) FILTER (({of}) AND NOT ({ok})) AS violations FROM compared"
        for n, (of, ok) in LEAKS.items()
    )
    + ")",
    CTES,
)
def _(b):
    return i.check_leakage(features(b), weekly(b), TRAIN_END, VAL_END)
