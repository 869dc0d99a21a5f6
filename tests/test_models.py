"""Fitted models against plain versions: Holt-Winters, seasonal trends, boosted trees and the backtest."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pantrylens.operators import boosting, evaluate as e, forecast as f, holt_winters as hw, seasonal as s

DAY = datetime.date(2024, 1, 1)


def rows_of(series):
    return [(k, DAY + datetime.timedelta(days=t), v) for k, y in series.items() for t, v in enumerate(y)]


def plain_fold(y, alpha, beta, gamma, phi):
    z = [max(v, 0.1) for v in y]
    level = sum(z[:7]) / 7
    trend = (sum(z[7:14]) / 7 - level) / 7
    season = [v - level for v in z[:7]]
    errors = []
    for v in z:
        before = level + phi * trend
        errors.append(v - (before + season[0]))
        new = alpha * (v - season[0]) + (1 - alpha) * before
        trend = beta * (new - level) + (1 - beta) * phi * trend
        season = season[1:] + [gamma * (v - before) + (1 - gamma) * season[0]]
        level = new
    return sum(x * x for x in errors), (alpha, beta, gamma, phi), level, trend, season, errors


def plain_fit(y):
    best = min(plain_fold(y, *p) for p in itertools.product(*hw.GRID.values()))
    a, b, g, phi = best[1]
    finer = [(min(a * x, hw.MOST), b, min(g * w, hw.MOST), phi) for x in hw.FINER for w in hw.FINER]
    return min(plain_fold(y, *p) for p in finer)


def test_holt_winters_folds_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    week = np.array([5, 2, 1, 0, 3, 9, 8])
    series = {
        1: [float(x) for x in np.round(20 + 0.3 * np.arange(40) + np.tile(week, 6)[:40] + rng.normal(0, 1, 40), 2)],
        2: [float(x) for x in rng.poisson(3, 25)],
        3: [7.0] * 14,
        4: [0.0] * 20,
        5: [1.0, 2.0, 3.0],
        6: [4.0],
    }
    df = spark.createDataFrame(rows_of(series), "item_id long, date date, demand double")
    fitted = hw.with_holt_winters(f.as_series(df, ["item_id"], "date", "demand"))
    got = {r.item_id: r for r in fitted.withColumns({"mape": hw.fit_mape(), "spread": hw.residual_spread()}).collect()}
    for k in (1, 2, 3, 4):
        squares, factors, level, trend, season, errors = plain_fit(series[k])
        fit = got[k].fit
        assert (fit.alpha, fit.beta, fit.gamma, fit.phi) == pytest.approx(factors)
        assert [fit.end[c] for c in hw.SEASONS] == pytest.approx(season, abs=1e-9)
        assert (fit.end.level, fit.end.trend, fit.squares) == pytest.approx((level, trend, squares), abs=1e-9)
        assert got[k].spread == pytest.approx(np.std(errors), abs=1e-6)
    assert got[4].mape == 100 and got[3].mape == pytest.approx(0) and got[5].fit is None
    steps = {}
    for r in f.daily_forecasts(f.as_series(df, ["item_id"], "date", "demand"), ["item_id"]).orderBy("item_id", "date").collect():
        steps.setdefault(r.item_id, []).append(r)
    assert {k: v[0].method for k, v in steps.items()} == {**dict.fromkeys((1, 2, 3, 4), "holt_winters"), 5: "moving_average", 6: "insufficient_data"}
    assert all(len(v) == 7 and v[0].date == DAY + datetime.timedelta(days=len(series[k])) for k, v in steps.items())
    # the trend and the week go on
    ahead = 20 + 0.3 * np.arange(40, 47) + np.tile(week, 8)[40:47]
    assert np.abs(np.array([r.forecast for r in steps[1]]) - ahead).mean() < 1.5
    assert [r.forecast for r in steps[3]] == pytest.approx([7.0] * 7) and all(0 <= r.lower <= r.forecast <= r.upper for v in steps.values() for r in v)
    assert f.daily_forecasts(f.as_series(df.where("false"), ["item_id"], "date", "demand"), ["item_id"]).count() == 0


def test_nulls_count_as_no_demand(spark):
    df = spark.createDataFrame([(1, DAY + datetime.timedelta(days=t), None if t % 2 else 4.0) for t in range(14)], "item_id long, date date, demand double")
    fit = hw.with_holt_winters(f.as_series(df, ["item_id"], "date", "demand")).first().fit
    assert fit.squares == pytest.approx(plain_fit([0.0 if t % 2 else 4.0 for t in range(14)])[0])


def test_seasonal_trend_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    days = np.arange(0, 7 * 160, 7) + 19000
    wave = 1 + 0.4 * np.sin(2 * np.pi * days / 365.25)
    y = (50 + 0.1 * np.arange(160)) * wave + rng.normal(0, 1, 160)
    rows = [(1, datetime.date(1970, 1, 1) + datetime.timedelta(days=int(d)), float(v)) for d, v in zip(days, y)]
    rows += [(2, DAY, 5.0), (3, DAY, 0.0), (3, DAY + datetime.timedelta(days=7), None)]
    df = spark.createDataFrame(rows, "k long, day date, y double")
    fitted = s.with_season(df, ["k"], "day", "y", s.WEEKLY)
    got = {r.k: r for r in fitted.collect()}
    assert set(got) == {1, 3}
    t = (days - days[0]) / (days[-1] - days[0])
    terms = np.column_stack([fn(2 * np.pi * k * days / 365.25) for fn in (np.sin, np.cos) for k in range(1, 6)])
    weights = np.zeros(10)
    for _ in range(s.TURNS):
        line = np.polyfit(t, y / (1 + terms @ weights), 1)
        trend = np.polyval(line, t)
        # ridge as plain least squares with rows of its own
        weights = np.linalg.lstsq(np.vstack([terms, np.eye(10)]), np.r_[y / trend - 1, np.zeros(10)], rcond=None)[0]
    assert got[1].fit.year == pytest.approx(weights.tolist(), abs=1e-9)
    assert (got[1].fit.slope, got[1].fit.level) == pytest.approx(tuple(line))
    steps = s.seasonal_steps(fitted, ["k"], 4, 7, "day").where("k = 1").orderBy("day").collect()
    ahead = np.arange(1, 5) * 7 + days[-1]
    plain = np.polyval(line, (ahead - days[0]) / (days[-1] - days[0])) * (1 + np.column_stack([fn(2 * np.pi * k * ahead / 365.25) for fn in (np.sin, np.cos) for k in range(1, 6)]) @ weights)
    assert [r.forecast for r in steps] == pytest.approx(plain.tolist())
    truth = (50 + 0.1 * np.arange(160, 164)) * (1 + 0.4 * np.sin(2 * np.pi * ahead / 365.25))
    assert np.abs(plain / truth - 1).max() < 0.04
    width = s.Z80 * np.std(y - trend * (1 + terms @ weights))
    assert steps[0].upper - steps[0].forecast == pytest.approx(width)
    assert [r.forecast for r in s.seasonal_steps(fitted, ["k"], 4, 7, "day").where("k = 3").collect()] == [0.0] * 4


def best_split(x, y):
    """Least sum of squares over all columns and cuts of one split."""
    best = None
    for c in range(x.shape[1]):
        for cut in np.unique(x[:, c])[:-1]:
            left = x[:, c] <= cut
            sse = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
            if best is None or sse < best[0] - 1e-9:
                best = (sse, c, y[left].mean(), y[~left].mean())
    return best


def test_first_tree_is_the_best_one(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (60, 5)).astype(float)
    y = np.where(x[:, 2] > 6, 30.0, 10.0) + rng.normal(0, 1, 60)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], boosting.LAGS + ["demand"])
    model = boosting.learn(df, rounds=1, depth=1)
    got = sorted({round(r.prediction, 9) for r in model.transform(df).collect()})
    _, column, low, high = best_split(x, y)
    assert column == 2 and got == pytest.approx(sorted([low, high]))
    assert boosting.learn(df.where("false")) is None


def test_boosted_steps_feed_on_themselves(spark):
    rows = [(1, DAY + datetime.timedelta(days=7 * t), float(10 + 5 * (t % 2))) for t in range(60)]
    rows += [(2, DAY + datetime.timedelta(days=7 * t), 3.0) for t in range(6)]
    df = spark.createDataFrame(rows, "place_id long, week_start date, demand double").withColumn("item_id", F.lit(1).cast("long"))
    from pantrylens.operators.features import ml_lag_frame

    model = boosting.learn(ml_lag_frame(df), rounds=30, rate=0.3)
    out = boosting.boosted_steps(model, boosting.history(df, ["place_id"]), ["place_id"]).orderBy("place_id", "week_start").collect()
    assert [(r.place_id, r.method) for r in out] == [(1, "boosted_trees")] * 4 + [(2, "moving_average")] * 4
    assert [r.forecast for r in out[:4]] == [10.0, 15.0, 10.0, 15.0]
    assert (out[0].lower, out[0].upper) == (7.0, 13.0) and [r.forecast for r in out[4:]] == [3.0] * 4
    none = boosting.boosted_steps(None, boosting.history(df, ["place_id"]), ["place_id"]).collect()
    assert len(none) == 8 and {r.method for r in none} == {"moving_average"}


def test_prefixes_hold_back_what_they_are_scored_on(spark):
    y = [float(t) for t in range(20)]
    df = spark.createDataFrame([(1, DAY + datetime.timedelta(days=7 * t), v) for t, v in enumerate(y)] + [(2, DAY, 1.0)], "k long, week_start date, demand double")
    cut = e.prefixes(f.as_series(df, ["k"], "week_start", "demand"), ["k"]).orderBy("origin").collect()
    assert [(r.k, r.origin, r.n, r.y[-1], r.held) for r in cut] == [(1, o, 20 - 4 * o, 19.0 - 4 * o, y[20 - 4 * o : 24 - 4 * o]) for o in (1, 2, 3)]
    assert cut[0].last == DAY + datetime.timedelta(days=7 * 15)


def test_scores_of_known_errors(spark):
    rows = [("m", "Smooth", 10.0, 12.0, 9.0, 13.0), ("m", "Smooth", 0.0, 1.0, 0.0, 2.0), ("m", "Lumpy", 10.0, 5.0, 6.0, 7.0)]
    df = spark.createDataFrame(rows, "method string, demand_type string, actual double, forecast double, lower double, upper double")
    got = {r.demand_type: r for r in e.scored(df).collect()}
    assert set(got) == {"All", "Smooth", "Lumpy"}
    assert (got["All"].n, got["All"].wape, got["All"].mape, got["All"].bias) == pytest.approx((3, 40.0, 35.0, -10.0))
    assert got["All"].coverage == pytest.approx(200 / 3) and got["Lumpy"].coverage == 0 and got["All"].rmse == pytest.approx(np.sqrt(10))


def test_models_beat_the_moving_average_on_held_out_weeks(spark):
    from pantrylens.plans import load_all

    queries, _ = load_all()
    read = lambda name: {r.method: r for r in queries[name](spark, "/root/testdata/sf0.01").where("demand_type = 'All'").collect()}
    models, plain = read("rolling_backtest_models"), read("rolling_backtest")
    assert set(models) == {"seasonal_trend", "boosted_trees"} and set(plain) == set(e.METHODS)
    for name in models:
        assert models[name].n == plain["moving_average"].n
        assert models[name].wape < plain["moving_average"].wape and models[name].rmse < plain["moving_average"].rmse
