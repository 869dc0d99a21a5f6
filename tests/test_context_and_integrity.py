"""Literal cases of events, adjustments, keys, leaks, files and explanations."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pantrylens.operators import context as c, explain as x, integrity as i, intervals, recommend as r
from pantrylens.sources import sinks, star

D = datetime.date


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(1)
    day = lambda: D(2023, 12, 1) + datetime.timedelta(days=rng.randint(0, 90))
    spans = lambda n, most: [(k, rng.choice([1, 2, None]), a := day(), a + datetime.timedelta(days=rng.randint(-1, most))) for k in range(n)]
    left, right = spans(60, 30), spans(80, 5) + [(99, 1, None, None)]
    a = spark.createDataFrame(left, "l long, k long, l_from date, l_to date")
    b = spark.createDataFrame(right, "r long, k long, r_from date, r_to date")
    near = lambda p, q: p[2] <= q[3] and q[2] <= p[3] and p[2] <= p[3] and q[2] <= q[3]
    pairs = [(p[0], q[0], p[1] is not None and p[1] == q[1]) for p in left for q in right if q[2] and near(p, q)]
    for width in (1, 8, 64):
        got = intervals.overlap_join(a, b.drop("k"), ("l_from", "l_to"), ("r_from", "r_to"), width=width).collect()
        assert sorted((x.l, x.r) for x in got) == sorted((p, q) for p, q, _ in pairs)
        keyed = intervals.overlap_join(a, b, ("l_from", "l_to"), ("r_from", "r_to"), ["k"], width).collect()
        assert sorted((x.l, x.r) for x in keyed) == sorted((p, q) for p, q, same in pairs if same)


def test_active_events_and_combined_factor(spark):
    events = [
        ("here", "promotion", D(2024, 1, 10), None, 1.5, [1]),
        ("there", "promotion", D(2024, 1, 10), None, 1.5, [2, 2]),
        ("all", "holiday", D(2024, 1, 1), D(2024, 1, 5), 0.5, None),
        ("none named", "holiday", D(2024, 1, 8), D(2024, 1, 20), 1.0, []),
        ("late", "holiday", D(2024, 1, 13), None, 9.0, None),
    ]
    ev = spark.createDataFrame(events, "name string, event_type string, start_date date, end_date date, impact_factor double, place_ids array<long>")
    targets = spark.createDataFrame([(1, D(2024, 1, 5)), (2, D(2024, 1, 5)), (3, D(2025, 1, 1))], "place_id long, date date")
    active = c.active_events(targets, ev)
    got = sorted((a.place_id, a.name, a.scope) for a in active.collect())
    assert got == [(1, "all", "global"), (1, "here", "local"), (1, "none named", "global"), (2, "all", "global"), (2, "none named", "global"), (2, "there", "local")]
    factors = {f.place_id: (f.events, f.combined_factor) for f in c.combined_factor(targets, active).collect()}
    # Fridays (1.39) with 0.5, 1.0 and 1.5; a Wednesday without events
    assert factors == {1: (3, 1.04), 2: (3, 1.04), 3: (0, 1.14)}
    assert {u.name for u in c.upcoming_impacts(active).collect()} == {"all", "here", "there"}
    assert c.active_events(targets, ev.where("false")).count() == 0


def test_targets_of_one_date_meet_events_of_all_places_in_blocks(spark):
    """All targets of a date in one task would leave the other tasks idle; texts are made once an event, not once a row."""
    kinds = "name string, event_type string, start_date date, end_date date, impact_factor double, place_ids array<long>"
    events = [(f"e{k}", "holiday", D(2024, 1, 1 + k), None, 0.5 + k / 5, None) for k in range(5)] + [("own", "holiday", D(2024, 1, 1), None, 1.7, [3])]
    ev = spark.createDataFrame(events, kinds)
    places = [*range(300), 7, None]
    targets = spark.createDataFrame([(k, D(2024, 1, 1)) for k in places] + [(1, None)], "place_id long, date date")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put small partitions together
    try:
        active = c.active_events(targets, ev)
        parts = active.where("scope = 'global'").groupBy(F.spark_partition_id()).count().collect()
        rows = [(a.place_id, a.name) for a in active.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(parts) > 4
    order = lambda rows: sorted(rows, key=str)
    assert order(rows) == order([(p, f"e{k}") for p in places for k in range(5)] + [(3, "own")])
    factors = c.combined_factor(targets, active)
    told = c.active_events(targets, c.with_advice(ev))
    assert order(map(tuple, c.context_advice(factors, told).collect())) == order(map(tuple, c.context_advice(factors, active).collect()))
    assert c.context_advice(factors, told).where("kind = 'event' and subject = 'own'").first().advice == "Expect 70% higher demand. Increase stock levels."
    early = c.upcoming_impacts(c.active_events(targets, c.with_impact(ev)))
    assert order(map(tuple, early.collect())) == order(map(tuple, c.upcoming_impacts(active).collect()))
    assert early.where("name = 'own'").first().description == "own expected to increase demand by 70%"


def test_adjustments_in_order_with_their_audit(spark):
    forecast = spark.createDataFrame([(1, D(2024, 1, 6), 100.0), (2, D(2024, 1, 6), 10.0), (3, D(2024, 1, 7), None)], "item_id long, date date, forecast double")
    events = [
        (D(2024, 1, 6), "Fair", "local_event", None, None),
        (D(2024, 1, 6), "Cold drinks", "promotion", 1.1, ["beverages_cold"]),
        (D(2024, 1, 6), "Odd", "unheard of", None, None),
    ]
    ev = spark.createDataFrame(events, "date date, name string, event_type string, impact_factor double, affected_categories array<string>")
    weather = spark.createDataFrame([(D(2024, 1, 6), "rainy", 31.0)], "date date, weather_type string, temperature double")
    kinds = spark.createDataFrame([(1, "beverages_cold"), (2, None)], "item_id long, category string")
    rows = c.with_records(forecast, ev, weather, kinds)
    done = {a.item_id: a for a in c.adjusted(rows).collect()}
    assert done[1].adjustment_factor == pytest.approx(1.25 * 1.1 * 1.2 * 1.0 * 0.85 * 1.4) and done[1].adjusted_forecast == 196.35
    assert done[1].adjustment_reasons == (
        "Day-of-week (Sat): 1.25x; Event (Cold drinks): 1.10x; Event (Fair): 1.20x; Event (Odd): 1.00x; Weather (rainy): 0.85x; "
        "Temperature (hot, beverages_cold): 1.40x"
    )
    assert done[2].adjusted_forecast == pytest.approx(12.75) and done[3].adjusted_forecast == 0.0
    steps = [(a.step, a.type, round(a.before, 6), round(a.after, 6)) for a in c.audit(rows).where("item_id = 2").orderBy("step").collect()]
    assert steps == [(1, "day_of_week", 10, 12.5), (2, "event", 12.5, 15.0), (3, "event", 15.0, 15.0), (4, "weather", 15.0, 12.75)]
    assert c.audit(rows.where("false")).count() == 0


def test_patterns_of_a_holiday(spark):
    days = spark.createDataFrame([(D(2024, 1, 1) + datetime.timedelta(days=k), 10.0 if k != 10 else 30.0) for k in range(20)], "date date, demand double")
    holidays = spark.createDataFrame([(D(2024, 1, 14), "Feast", 0.5), (D(2030, 1, 1), "Far", 1.0)], "date date, name string, impact double")
    got = {(p.kind, p.part): p.observed for p in c.context_patterns(days, holidays).collect()}
    assert got["holiday", "Feast 2024-01-14"] == round(90 / 7 / 11, 2) and ("holiday", "Far 2030-01-01") not in got
    assert got["weekday", "3"] == round(50 / 3 / 11, 2) and got["month", "1"] == 1.0


def test_integrity_counts_orphans_once_a_key(spark):
    child = spark.createDataFrame([(1.0,), (1.0,), (9.0,), (9.0,), (8.0,), (None,)], "fk double")
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    rel = i.Relation("a -> b", child, "fk", parent, "id")
    row = i.referential_integrity([rel, i.Relation("none", child.where("false"), "fk", parent, "id")]).collect()
    assert row[0][:5] == ("a -> b", 6, 1, 3, 2) and row[0].integrity_pct == pytest.approx(40.0) and row[0].status == "broken"
    assert row[1][:5] == ("none", 0, 0, 0, 0) and row[1].status == "ok"
    assert sorted(o.fk for o in i.orphans(rel).collect()) == [8.0, 9.0, 9.0]


def test_leaks_are_found(spark):
    weeks = [D(2024, 1, 1) + datetime.timedelta(days=7 * k) for k in range(6)]
    weekly = spark.createDataFrame([(1, 1, w, float(k + 1)) for k, w in enumerate(weeks)], "place_id long, item_id long, week_start date, demand double")
    past = lambda k, n: float(k - n + 1) if k >= n else 0.0
    seen = lambda k: [past(k, n) for n in (1, 2, 3, 4)]
    rows = [(1, 1, w, past(k, 1), past(k, 2), past(k, 4), 0.0, max(seen(k)), min(seen(k)), "train" if k < 3 else "test") for k, w in enumerate(weeks)]
    schema = "place_id long, item_id long, week_start date, lag_1w double, lag_2w double, lag_4w double, lag_52w double, roll_max_4w double, roll_min_4w double, train_val_test_flag string"
    good = spark.createDataFrame(rows, schema)
    clean = {v.check: (v.rows, v.violations) for v in i.check_leakage(good, weekly, "2024-01-15", "2024-01-15").collect()}
    assert clean["lag_1w_is_past_demand"] == (6, 0) and clean["train_before_split"] == (3, 0) and clean["val_between_splits"] == (0, 0)
    assert all(v == 0 for _, v in clean.values())
    # a lag that is the week's own demand, a window that ends in it, and a split a week too late
    own = good.join(weekly, ["place_id", "item_id", "week_start"]).withColumns({"lag_1w": F.col("demand"), "roll_max_4w": F.col("demand")})
    bad = {v.check: v.violations for v in i.check_leakage(own, weekly, "2024-01-08", "2024-01-15").collect()}
    assert bad["lag_1w_is_past_demand"] == 6 and bad["roll_max_4w_is_past"] == 6 and bad["train_before_split"] == 1


def test_star_keeps_broken_rows_apart(spark, tmp_path):
    (tmp_path / "fct_sales.csv").write_text("id,price,name\n1,2.5,a\nx,3.5,b\n3,oops,\n4\n")
    (tmp_path / "dim_things.csv").mkdir()
    (tmp_path / "dim_things.csv" / "part-0.csv").write_text("id,title\n1,one\n")
    (tmp_path / "dim_things.csv" / "part-1.csv").write_text("id,title\n2,two\n")
    (tmp_path / "other.csv").write_text("a\n")
    (tmp_path / "readme.txt").write_text("no table")
    schema = StructType([StructField("id", LongType()), StructField("price", DoubleType()), StructField("name", StringType())])
    found = {t.name: (t.role, t.files) for t in star.discover(spark, str(tmp_path)).collect()}
    assert found == {"fct_sales": ("fact", 1), "dim_things": ("dimension", 2), "other": ("other", 1)}
    tables = star.scan_star(spark, str(tmp_path), {"fct_sales": schema})
    sales = {s[star.BROKEN]: s for s in tables["fct_sales"].collect()}
    assert sales["x,3.5,b"].id is None and sales["x,3.5,b"].price == 3.5 and sales[None].id == 1
    counts = {t.name: (t.columns, t.rows, t.broken_rows) for t in star.load_counts(tables).collect()}
    assert counts == {"fct_sales": (3, 4, 3), "dim_things": (2, 2, 0), "other": (1, 0, 0)}


def test_partitions_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select((F.col("id") % 3).alias("place"), "id", (F.col("id") * 2).alias("v"), F.lit("wide" * 10).alias("w"))
    sinks.write_partitions(df, path, ["place"], order=["id"])
    sinks.write_partitions(df.where("place = 1 and id < 100"), path, ["place"])
    sinks.write_partitions(df.where("place = 1 and id < 100"), path, ["place"])
    counts = {p.place: p["count"] for p in spark.read.parquet(path).groupBy("place").count().collect()}
    assert counts == {0: 334, 1: 33, 2: 333}
    sinks.write_partitions(df.where("false"), path, ["place"])
    assert spark.read.parquet(path).count() == 700
    pruned = sinks.read_pruned(spark, path, ["id"], "place = 2 and v > 100")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(place" in plan and "GreaterThan(v,100)" in plan
    assert "ReadSchema: struct<id:bigint,v:bigint>" in plan and pruned.count() == 316
    sinks.write_clustered(df, path + "c", ["place"], ["id"], files=4)
    assert spark.read.parquet(path + "c").count() == 1000


def test_trend_rule_as_stated(spark):
    cols = "item_id long, current_stock double, avg_daily_demand double, days_of_supply double, days_to_expiry long, trend_pct double, trend_score int, turnover_score int"
    health = spark.createDataFrame([(1, 9.0, 0.5, 18.0, None, -40.0, 10, 40), (2, 10.0, 2.0, 5.0, None, 30.0, 100, 40)], cols)
    got = {t.item_id: t for t in r.recommendations(health).where("rule = 'trend'").collect()}
    assert (got[1].action, got[1].quantity, got[1].impact) == ("remove", None, 0.0)
    assert (got[2].action, got[2].quantity, got[2].impact, got[2].discount) == ("increase_order", None, 10.0, 0.15)


def test_explanations_survive_json_and_leave_out_the_unknown(spark):
    schema = """item_id long, item_name string, rule string, action string, urgency string, quantity double, impact double, discount double,
      days_of_supply double, days_to_expiry long, trend_pct double, avg_daily_demand double, days_with_sales long"""
    rows = [
        (1, "Soup", "expiry", "discount", "HIGH", 12.0, 60.0, 0.2, 3.25, 5, 0.0, 3.7, 100),
        (2, None, "trend", "remove", "MEDIUM", None, 0.0, None, None, None, -50.0, 0.0, None),
    ]
    told = x.explained(spark.createDataFrame(rows, schema))
    back = x.from_json(x.as_json(told)).orderBy("item_id").collect()
    assert [b.explanation for b in back] == [t.explanation for t in told.orderBy("item_id").collect()]
    one, two = (b.explanation for b in back)
    assert one.summary == "🏷️ Soup: discount 🟠" and one.action.specifics == {"quantity_text": "12 units", "discount_text": "20% off"}
    assert [m.metric for m in one.impact.metrics] == ["Sales Velocity", "Waste Reduction"] and one.confidence.level == "High"
    assert two.headline == "Attention required: item 2" and two.action.specifics == {} and [f.factor for f in two.why.factors] == ["Trend"]
    assert (two.confidence.percentage, two.confidence.level) == (60, "Moderate")
    flat = x.flat(x.from_json(x.as_json(told))).where("item_id = 1").first()
    assert flat.factors == "Forecasted Demand=3.70 units/day; Supply=3.25 days; Expiry=5 days" and flat.risk_urgency == "Act within 1-2 days"
