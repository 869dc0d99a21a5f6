"""Queries of fitted models: seasonal trends, boosted trees, and the routing of weekly series to them."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4
from pantrylens.operators import boosting, classify, demand as d, features as ft, forecast as f, seasonal as s
from pantrylens.plans.demand import weekly
from pantrylens.plans.forecast import PAIR
from pantrylens.plans.registry import query

BANDS = ["forecast", "lower", "upper"]
STORE = ["store"]


def whole(df):
    """Weekly forecasts are whole numbers."""
    return df.withColumns({c: F.bround(c) for c in BANDS})


def complete(b):
    return d.expand_full_calendar(weekly(b))


def seasonal_weekly(series):
    fitted = s.with_season(series, PAIR, "week_start", "demand", s.WEEKLY)
    return whole(s.seasonal_steps(fitted, PAIR, 4, 7, "week_start", s.WEEKLY, s.Z80)).select(*PAIR, "week_start", *BANDS)


def store_days(b):
    """Daily totals above 0 of the whole store."""
    return d.store_daily_total(d.daily_for_dashboard(b.lines)).where("daily_quantity > 0").withColumn("store", F.lit("all"))


def store_fit(b):
    return s.with_season(store_days(b), STORE, "date", "daily_quantity", s.DAILY, least=14)


# A ridge solve and trees grown from all rows are not expressible in SQL: these are tested against plain versions.


@query("seasonal_trend_weekly")
def _(b):
    return seasonal_weekly(complete(b))


@query("seasonal_trend_store")
def _(b):
    steps = s.seasonal_steps(store_fit(b), STORE, 14, 1, "date", s.DAILY, s.Z95).drop("store")
    return steps.withColumns({c: r4(c) for c in steps.columns if c != "date"})


@query("seasonality_effects")
def _(b):
    effects = s.seasonal_effects(store_fit(b), store_days(b), STORE, "date", s.DAILY)
    return effects.select("kind", "part", F.round("effect", 1).alias("effect"))


def learned(b, until=None):
    """Trees of all weeks of the complete calendar, or of those up to a date."""
    frame = ft.ml_lag_frame(complete(b))
    return boosting.learn(frame if until is None else frame.where(F.col("week_start") <= until))


@query("ml_lag_forecast")
def _(b):
    return boosting.boosted_steps(learned(b), boosting.history(complete(b), PAIR), PAIR)


def routed(b, pairs=None):
    """Forecasts of every pair (or of ``pairs``) by the model of its demand class."""
    rows = weekly(b) if pairs is None else weekly(b).join(pairs, PAIR, "left_semi")
    kinds = classify.sbc_classify(rows).select(*PAIR, "demand_type")
    long = rows.groupBy(*PAIR).count()
    model = (
        F.when(F.col("count") < 4, "insufficient_data")
        .when(F.col("demand_type") == "Smooth", "seasonal_trend")
        .when(F.col("demand_type").isin("Erratic", "Lumpy"), "boosted_trees")
        .when(F.col("demand_type") == "Intermittent", "croston")
        .otherwise("moving_average")
    )
    to = kinds.join(long, PAIR).select(*PAIR, "demand_type", model.alias("model"))
    of = lambda df, name: df.join(to.where(F.col("model") == name).select(*PAIR), PAIR, "left_semi")
    series = d.expand_full_calendar(rows)

    def banded(name, column):
        rows = f.with_weekly_bands(f.as_series(of(series, name), PAIR, "week_start", "demand"))
        rows = rows.select(*PAIR, "last", *[F.col(column)[c].alias(c) for c in BANDS])
        return f.steps_ahead(rows, PAIR, 4, 7, "week_start", *BANDS)

    none = of(series, "insufficient_data").groupBy(*PAIR).agg(F.max("week_start").alias("last"))
    branches = [
        seasonal_weekly(of(series, "seasonal_trend")),
        boosting.boosted_steps(learned(b), boosting.history(of(series, "boosted_trees"), PAIR), PAIR).drop("method"),
        banded("croston", "croston"),
        banded("moving_average", "moving"),
        f.insufficient_weekly(none, PAIR).drop("confidence"),
    ]
    out = branches[0]
    for more in branches[1:]:
        out = out.unionByName(more)
    return out.join(to, PAIR)


@query("route_by_class")
def _(b):
    return routed(b)


@query("forecast_place_top_n")
def _(b):
    top = d.top_items_per_place(weekly(b), b.menu_items, 5).select(*PAIR)
    return routed(b, top)


@query(
    "insufficient_weekly",
    """SELECT place_id, item_id, (last + 7 * step::INTEGER)::DATE AS week_start, 0::DOUBLE AS forecast, 0::DOUBLE AS lower, 5::DOUBLE AS upper,
  0.5::DOUBLE AS confidence
FROM (SELECT l_suppkey AS place_id, l_partkey AS item_id, max(date_trunc('week', l_shipdate))::DATE AS last FROM lineitem
  GROUP BY 1, 2 HAVING count(DISTINCT date_trunc('week', l_shipdate)) < 4), range(1, 5) t(step)""",
)
def _(b):
    short = f.last_weeks(b.supplier_lines, PAIR).where("weeks < 4")
    return f.insufficient_weekly(short, PAIR)
