"""Profiles and validation on literal rows: nulls, repeated rows, negative values, empty tables and odd names."""

import pytest

from pantrylens.functions.stats import exact_quantiles
from pantrylens.operators import profiling as p

ROWS = [(1, 10, 1_600_000_000, 5.0, "a"), (1, 10, 1_600_000_000, 5.0, "a"), (2, None, 1_700_000_000, -2.5, None), (None, None, 1_650_000_000, None, None), (None, None, 1_650_000_000, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    kinds = "id long, place_id long, created long, price double, `odd name.x` string"
    return {
        "fct_sales": spark.createDataFrame(ROWS, kinds),
        "fct_none": spark.createDataFrame([], kinds),
        "dim_skus": spark.createDataFrame([(k, float(k - 1), None) for k in range(12)] + [(99, 1000.0, None)], "id long, quantity double, gone double"),
    }


@pytest.fixture(scope="module")
def measured(tables):
    return p.measures(tables)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_measures_of_every_column(measured):
    rows = by(measured, "table", "column")
    assert len(rows) == 13
    price = rows["fct_sales", "price"]
    assert (price.rows, price.nulls, price.mean, price.least, price.most, price.negatives, price.fractions) == (5, 2, 2.5, -2.5, 5.0, 1, 1)
    odd = rows["fct_sales", "odd name.x"]
    assert (odd.nulls, odd.mean, odd.negatives) == (3, None, 0)
    assert (rows["fct_none", "id"].rows, rows["fct_none", "id"].nulls, rows["fct_none", "id"].mean) == (0, 0, None)


def test_null_shares_round_half_up(spark):
    df = spark.createDataFrame([(None if k else 1,) for k in range(2)] + [(1,)] * 14, "x int")
    assert p.null_profile(p.measures({"t": df})).first().null_pct == 6.25
    exact = spark.range(40000).selectExpr("if(id < 402, null, id) AS x")
    assert p.null_profile(p.measures({"t": exact})).first().null_pct == 1.01  # 1.005 percent


def test_duplicates_take_nulls_as_equal(tables):
    rows, keys = p.duplicate_rows(tables), p.duplicate_keys(tables)
    assert {r.table: (r.rows, r.duplicate_rows) for r in rows.collect()} == {"fct_sales": (5, 2), "fct_none": (0, 0), "dim_skus": (13, 0)}
    assert {r.table: r.duplicate_keys for r in keys.collect()} == {"fct_sales": 2, "fct_none": 0, "dim_skus": 0}
    assert {r.table: r.severity for r in p.valid_duplicates(rows, keys).collect()} == {"fct_sales": "warning", "fct_none": "ok", "dim_skus": "ok"}


def test_numeric_profile_leaves_out_columns_without_values(tables, measured):
    rows = by(p.numeric_profile(tables, measured), "table", "column")
    assert ("dim_skus", "gone") not in rows and ("fct_none", "price") not in rows
    assert (rows["fct_sales", "price"].median, rows["fct_sales", "price"].non_null) == (5.0, 3)
    assert rows["dim_skus", "quantity"].median == 5.0


def test_medians_send_bounds_to_the_cells_not_cells_to_the_driver(spark, capsys):
    """Cells are many times the columns that Spark judges their size by; bounds are one row a column."""
    wide = spark.range(1000).selectExpr("id", *[f"id * {k} AS c{k}" for k in range(2, 6)])
    got = exact_quantiles(wide, wide.columns, [0.5])
    assert {r.column: r.value for r in got.collect()} == {"id": 499.5, **{f"c{k}": 499.5 * k for k in range(2, 6)}}
    got.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_roles_and_ranges(measured):
    roles = {(r.table, r.column): r.role for r in p.column_roles(measured).collect()}
    assert roles["fct_sales", "created"] == "timestamp" and roles["fct_none", "created"] == "integer"
    assert roles["fct_sales", "place_id"] == "id" and roles["dim_skus", "gone"] == "float" and roles["fct_sales", "odd name.x"] == "string"
    ranges = by(p.date_ranges(measured), "table", "column")
    assert list(ranges) == [("fct_sales", "created")]
    assert (ranges["fct_sales", "created"].first_day, ranges["fct_sales", "created"].last_second) == ("2020-09-13", 1_700_000_000)


def test_issues(tables, measured):
    negative = by(p.negative_issues(tables), "table", "column")
    assert {k: (r.negatives, r.least, r.samples) for k, r in negative.items()} == {
        ("fct_sales", "price"): (1, -2.5, "[-2.5]"),
        ("dim_skus", "quantity"): (1, -1.0, "[-1.0]"),
    }
    assert by(p.missing_keys(measured), "table", "column")["fct_sales", "place_id"].null_pct == 60.0
    outliers = by(p.outlier_issues(tables, measured), "table", "column")
    assert {k: (r.outliers, r.outlier_pct) for k, r in outliers.items()} == {("dim_skus", "quantity"): (1, 7.69), ("dim_skus", "id"): (1, 7.69)}
    found = {(r.table, r.column): r.severity for r in p.suspicious_columns(measured).collect()}
    assert found == {("dim_skus", "gone"): "high", ("dim_skus", "quantity"): "critical"}


def test_readiness(tables, measured):
    rows = by(p.readiness(measured, p.duplicate_keys(tables)), "table")
    # repeated keys 30, a key column more than half null 20, negative price 5, a foreign key above 30 percent null 10
    assert (rows["fct_sales",].score, rows["fct_sales",].status, rows["fct_sales",].issues) == (35, "critical_issues", 4)
    assert (rows["fct_none",].score, rows["fct_none",].status, rows["fct_none",].issues) == (50, "needs_cleaning", 1)
    assert (rows["dim_skus",].score, rows["dim_skus",].status) == (95, "ready")
    report = by(p.quality_report(p.readiness(measured, p.duplicate_keys(tables))), "status")
    assert report["ready",].tables == "dim_skus" and len(report) == 3


def test_validation(spark, tables, measured):
    need = p.required_columns(measured, {"fct_sales": {"required": ["id", "total"], "optional": ["price", "note"]}, "none": {"required": ["id"]}})
    assert {(r.table, r.column): (r.filled, r.status) for r in need.collect()} == {
        ("fct_sales", "id"): (3, "present"),
        ("fct_sales", "total"): (0, "error"),
        ("fct_sales", "price"): (3, "present"),
        ("fct_sales", "note"): (0, "absent"),
        ("none", "id"): (0, "error"),
    }
    texts = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), (None,), ("x",)], "created string")
    times = by(p.valid_timestamps({**tables, "texts": texts}, ["created"]), "table")
    assert {k[0]: (r.filled, r.bad_rows, r.status) for k, r in times.items()} == {
        "fct_sales": (5, 0, "ok"),
        "fct_none": (0, 0, "empty"),
        "texts": (3, 2, "unparseable"),
    }
    assert {r.column: r.severity for r in p.missing_thresholds(measured).where("table = 'dim_skus'").collect()} == {"gone": "critical"}
    negative = p.negative_demand({"a": (tables["dim_skus"], "quantity"), "b": (tables["fct_none"], "price")})
    assert {r.dataset: (r.negative_rows, r.passed) for r in negative.collect()} == {"a": (1, False), "b": (0, True)}
    whole = p.whole_numbers(measured, {"fct_sales": ["id", "price"]})
    assert {r.column: r.passed for r in whole.collect()} == {"id": True, "price": False}
    present = p.tables_present(tables, ["dim_skus", "fct_none", "gone"])
    assert {r.table: (r.rows, r.status) for r in present.collect()} == {"dim_skus": (13, "ok"), "fct_none": (0, "empty"), "gone": (0, "missing")}
