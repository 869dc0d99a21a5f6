"""Queries that must do their whole job, on rows built here."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from pantrylens.operators import context as c, demand, health, holt_winters as hw
from pantrylens.plans import explain, load_all
from pantrylens.sources.bindings import Bound

QUERIES = load_all()[0]


def written_events(spark, folder, lengths):
    """An events table with one series of clicks a user, of the given numbers of days."""
    start = datetime(2024, 1, 1)
    rows = [(100 * u + k, start + timedelta(days=k), u, "click", float(k % 5 + 1), "{}") for u, n in lengths.items() for k in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_moving_average_daily_covers_series_of_every_length(spark, tmp_path):
    folder = written_events(spark, tmp_path, {1: 1, 2: 2, 3: 3, 4: 13, 5: 14, 6: 40})
    rows = QUERIES["moving_average_daily"](spark, folder).collect()
    found = {}
    for r in rows:
        found.setdefault(r.item_id, []).append(r)
    assert {k: len(v) for k, v in found.items()} == {u * 10: 7 for u in range(1, 7)}
    recent = [k % 5 + 1 for k in range(33, 40)]
    assert all(r.forecast == round(sum(recent) / 7, 4) for r in found[60])
    assert found[10][0].upper == round(1 + 1.959963984540054 * 0.2, 4)
    assert Bound(spark, folder).daily_events.select("item_id").distinct().count() == len(found)


def test_many_fits_at_once_equal_fits_one_by_one(spark):
    """Series of unequal lengths, more than are folded at once, nulls and a batch without any long series."""
    rng = np.random.default_rng(1)
    rows = [(k, [None if v > 8 else float(v) for v in rng.integers(0, 10, n)]) for k, n in enumerate(rng.integers(10, 40, 2 * hw.AT_ONCE + 9))]
    series = spark.createDataFrame(rows, "k long, y array<double>").withColumn("n", F.size("y"))
    got = {r.k: r.fit for r in hw.with_holt_winters(series.repartition(1)).collect()}
    for k, y in rows:
        if len(y) < 2 * hw.SEASON:
            assert got[k] is None
        elif k % 20 == 0:
            one = hw.fits(np.array([[v or 0.0] for v in y]), np.array([len(y)]))
            assert got[k].squares == one["squares"][0] and [got[k].end[c] for c in hw.END] == [one[c][0] for c in hw.END]
    assert [r.fit for r in hw.with_holt_winters(series.where("n < 14")).collect()].count(None) == sum(len(y) < 14 for _, y in rows)


def test_health_is_worked_out_from_one_forecast(spark):
    """Every use of the forecast is a fit of all series: one of them, not one for the total and one for the trend."""
    start = datetime(2024, 1, 1).date()
    demand = spark.createDataFrame([(1, start + timedelta(days=k), float(k + 1)) for k in range(7)], "item_id long, date date, demand double")
    read = F.udf(lambda x: x, "double")
    stock = spark.createDataFrame([(1, 10.0, 3), (2, 5.0, None)], "item_id long, current_stock double, days_to_expiry int")
    rows = health.health_scores(stock, demand.withColumn("demand", read("demand")))
    assert {r.item_id: (r.avg_daily_demand, r.trend_pct) for r in rows.collect()} == {1: (4.0, 200.0), 2: (0.0, 0.0)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [item_id") == 1


def test_common_events_are_not_spread_over_targets(spark):
    """The combined factor of every target, without a row for each target and event of all places."""
    day = datetime(2024, 1, 1).date()
    at = lambda k: day + timedelta(days=k)
    targets = spark.createDataFrame([(p, at(k)) for p in (1, 2, 3, None) for k in (0, 5, 30)] + [(1, None)], "place_id long, date date")
    everywhere = [(f"e{k}", "click", at(k % 9), None, 0.5 + (k % 11) / 10, None) for k in range(40)]
    own = [("own", "view", at(2), at(40), 1.3, [1, 2, 2]), ("none", "view", at(0), None, None, [1]), ("empty", "view", at(30), None, 0.7, [])]
    events = spark.createDataFrame(everywhere + own, "name string, event_type string, start_date date, end_date date, impact_factor double, place_ids array<long>")
    spread = c.combined_factor(targets, c.active_events(targets, events))
    common = c.common_events(targets, events)
    assert common.count() == common.distinct().count() < 3 * 41
    got = c.combined_factor(targets, c.local_events(targets, events), common)
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(got) == key(spread) and got.count() == 13
    assert {r.events for r in got.where("place_id is null").collect()} == {0}
    assert {(r.events, r.combined_factor) for r in got.where((F.col("place_id") == 3) & (F.col("date") == at(30))).collect()} == {(1, 0.8)}


def test_profiles_do_not_broadcast_customers(spark):
    """A profile scans the orders several times; each would bring all customers to the driver."""
    rows = Bound(spark, "/root/testdata/sf0.001").orders_raw
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_series_of_unequal_lengths_keep_their_own_states(spark):
    """The arrays that the days share leave no trace of one series or set in another: each equals a plain fold."""
    rng = np.random.default_rng(5)
    lengths = np.array([40, 31, 31, 20, 14])
    y = np.zeros((40, 5))
    for k, n in enumerate(lengths):
        y[:n, k] = rng.integers(0, 9, n)
    factors = np.array([(0.1, 0.01, 0.05, 0.9), (0.6, 0.3, 0.3, 0.98)]).T[:, :, None]
    got = hw.fold(y, lengths, factors)
    for k, n in enumerate(lengths):
        for j in range(2):
            alpha, beta, gamma, phi = factors[:, j, 0]
            z = np.maximum(y[:n, k], hw.FLOOR)
            level = sum(z[:7]) / 7
            trend, seasons, squares = (sum(z[7:14]) / 7 - level) / 7, list(z[:7] - level), 0.0
            for t in range(n):
                before, season = level + phi * trend, seasons[t % 7]
                new = alpha * (z[t] - season) + (1 - alpha) * before
                squares += (z[t] - before - season) ** 2
                trend = beta * (new - level) + (1 - beta) * phi * trend
                seasons[t % 7], level = gamma * (z[t] - before) + (1 - gamma) * season, new
            found = [got[c][j, k] for c in ("level", "trend", "squares", "s0")]
            np.testing.assert_allclose(found, [level, trend, squares, seasons[n % 7]], rtol=1e-9)


def test_explanations_read_the_lines_once(spark):
    """Recommendations, their facts and the days of history come from one forecast, not one each."""
    rows = explain.recommended(Bound(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and plan.count("Relation [l_orderkey") == 1
    twice = rows.groupBy("item_id", "rule").count().where("count > 1").count()
    assert twice == 0 and rows.count() > 0


def test_dealt_demand_equals_plain_demand_with_null_and_repeated_keys(spark):
    lines = spark.createDataFrame(
        [(1, 1, 2.0, 1.0, 1.0), (1, 1, 3.0, None, 1.0), (2, 1, None, 1.0, 1.0), (2, None, 4.0, 2.0, None), (None, 1, 5.0, 1.0, 1.0), (9, 2, 6.0, 1.0, 1.0), (3, 2, 7.0, 1.0, 1.0)],
        "order_id long, item_id long, quantity double, price double, cost double",
    )
    orders = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-01-02", 1), (2, "2024-01-01", 1), (3, None, 1), (None, "2024-01-03", 1)], "id long, day string, place_id long")
    orders = orders.withColumn("created", F.col("day").cast("timestamp"))
    plain, dealt = (sorted(map(str, demand.demand_per_item(lines, orders, dealt=x).collect())) for x in (False, True))
    assert dealt == plain and len(plain) == 5


def test_forecasts_of_parts_use_no_hash_table(spark, sf_dir, capsys):
    for name in ("score_stock", "risk_flag", "discount_urgency", "rule_trend"):
        QUERIES[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert "HashAggregate" not in plan and plan.count("SortAggregate") == 3, name
