"""Queries of accuracy: rolling origins, and the metrics of the last four weeks as held out."""

from pyspark.sql import functions as F

from pantrylens.functions.stats import r4
from pantrylens.operators import boosting, evaluate as e, seasonal as s
from pantrylens.plans.forecast import CTES as FORECAST_CTES, PAIR, weekly_series
from pantrylens.plans.models import complete, learned
from pantrylens.plans.registry import query

# The forecasters' SQL over prefixes: the same text, from other lists.
RENAMED = {
    "week_lists": "past_lists",
    "week_sizes": "past_sizes",
    "week_bands": "past_bands",
    "tuned_stats": "past_stats",
    "tuned_values": "past_values",
    "tuned_bands": "past_tuned",
}


def _renamed(text: str) -> str:
    for old, new in RENAMED.items():
        text = text.replace(old, new)
    return text


CELLS = {
    "moving_average": "[moving_value, greatest(trunc(moving_value - width), 0), trunc(moving_value + width)]",
    "croston": "[croston_value, floor(0.5 * croston_value), floor(1.5 * croston_value)]",
    "smooth_blend": "smooth",
    "erratic_blend": "erratic",
    "croston_sba": "croston_sba",
    "tsb_lumpy": "tsb",
    "weighted_ma_trend": "weighted",
}
SCORES = """count(*) AS n, round(100 * sum(abs(f - a)) / nullif(sum(a), 0), 4) AS wape,
  round(100 * avg(CASE WHEN a > 0 THEN abs(f - a) / a END), 4) AS mape, round(100 * avg(CASE WHEN a BETWEEN l AND u THEN 1 ELSE 0 END), 4) AS coverage,
  round(sqrt(avg((f - a) * (f - a))), 4) AS rmse, round(100 * sum(f - a) / nullif(sum(a), 0), 4) AS bias"""
RISK = """CASE WHEN days < 7 AND held / greatest({f}, 1) > 2 THEN 'Critical' WHEN days < 14 OR (held / greatest({f}, 1) > 1.5 AND days < 21) THEN 'High Risk'
  WHEN held / greatest({f}, 1) > 1.2 OR days < 30 THEN 'Low Risk' ELSE 'Safe' END"""
HELD = "CASE WHEN current_stock = 0 THEN 1.5 * {f} ELSE current_stock END"
DISCOUNT = """CASE {r} WHEN 'Critical' THEN least(50, greatest(30, 50 - 2 * days)) WHEN 'High Risk' THEN least(30, greatest(15, 30 - days))
  WHEN 'Low Risk' THEN least(15, greatest(5, 15 - days // 2)) ELSE 0 END"""
URGENCY = "CASE {r} WHEN 'Critical' THEN 9 WHEN 'High Risk' THEN 6 WHEN 'Low Risk' THEN 3 ELSE 1 END"


def _risk(f: str) -> str:
    return RISK.format(f=f).replace("held", f"({HELD.format(f=f)})")


CTES = {
    **FORECAST_CTES,
    **{RENAMED[k]: _renamed(v) for k, v in FORECAST_CTES.items() if k in RENAMED},
    "past_lists": """
SELECT place_id, item_id, o AS origin, y[1:n - 4 * o] AS y, n - 4 * o AS n, (last - (28 * o)::INTEGER)::DATE AS last, y[n - 4 * o + 1:n - 4 * o + 4] AS held_out
FROM week_lists, range(1, 5) t(o) WHERE n - 4 * o >= 8""",
    "past_class": """
SELECT place_id, item_id, last, origin, held_out, moving_value, croston_value, width, CASE WHEN len(sizes) < 2 THEN 'Insufficient Data'
  WHEN n::DOUBLE / len(sizes) <= 1.32 THEN CASE WHEN cv2 <= 0.49 THEN 'Smooth' ELSE 'Erratic' END
  ELSE CASE WHEN cv2 <= 0.49 THEN 'Intermittent' ELSE 'Lumpy' END END AS demand_type
FROM (SELECT *, power(CASE WHEN len(sizes) > 1 THEN list_stddev_samp(sizes) ELSE 0 END / list_avg(sizes), 2) AS cv2 FROM past_bands)""",
    "tested": """
SELECT origin, demand_type, method, band[1] AS f, band[2] AS l, band[3] AS u, unnest(held_out) AS a FROM (
"""
    + " UNION ALL ".join(
        f"SELECT origin, demand_type, held_out, '{m}' AS method, {c} AS band FROM past_class JOIN past_tuned USING (place_id, item_id, last)"
        for m, c in CELLS.items()
    )
    + ")",
    "held_weeks": """
SELECT place_id, item_id, (last + 7 * step::INTEGER)::DATE AS week_start, demand_type, band[1] AS forecast, band[2] AS lower, band[3] AS upper,
  weighted[1] AS expected, held_out[step] AS actual, current_stock, days_to_expiry, coalesce(days_to_expiry, 30) AS days
FROM (SELECT *, CASE demand_type WHEN 'Erratic' THEN erratic WHEN 'Intermittent' THEN croston_sba WHEN 'Lumpy' THEN tsb ELSE smooth END AS band
  FROM past_class JOIN past_tuned USING (place_id, item_id, last) WHERE origin = 1) JOIN dim_stock USING (item_id), range(1, 5) t(step)""",
    "judged": f"""
SELECT *, {DISCOUNT.format(r="model_risk")} AS model_discount, {URGENCY.format(r="model_risk")} AS model_urgency,
  {DISCOUNT.format(r="expected_risk")} AS expected_discount, {URGENCY.format(r="expected_risk")} AS expected_urgency
FROM (SELECT *, {_risk("forecast")} AS model_risk, {_risk("expected")} AS expected_risk FROM held_weeks)""",
}
EXPECTED = """count(*) AS n, round(100 * sum(abs(forecast - expected)) / sum(expected), 4) AS wape,
  round(100 * sum(abs(forecast - actual)) / nullif(sum(actual), 0), 4) AS wape_actual, round(100 * avg(abs(forecast - expected) / expected), 4) AS mape,
  round(100 * avg(CASE WHEN actual >= lower AND actual <= upper THEN 1 ELSE 0 END), 4) AS ci_coverage,
  round(sqrt(avg((forecast - expected) * (forecast - expected))), 4) AS rmse, round(100 * sum(forecast - expected) / sum(expected), 4) AS bias"""


def q(name, sql):
    return query(name, sql, CTES)


def rounded(df):
    return df.withColumns({c: r4(c) for c, kind in df.dtypes if kind == "double"})


def held_out(b):
    return e.holdout(weekly_series(b), b.stock, PAIR)


@q(
    "rolling_backtest",
    f"""SELECT method, demand_type, {SCORES} FROM tested GROUP BY 1, 2 UNION ALL SELECT method, 'All', {SCORES} FROM tested GROUP BY 1""",
)
def _(b):
    return rounded(e.scored(e.backtest(weekly_series(b), PAIR)))


@query("rolling_backtest_models")
def _(b):
    """The fitted models at the same origins. Trees learn from the weeks before the first origin, so from none they are tested on."""
    rows = complete(b).select(*PAIR, "week_start", "demand")
    end = rows.agg(F.max("week_start")).scalar()
    origins = F.explode(F.sequence(F.lit(1), F.lit(e.ORIGINS))).alias("origin")
    cut = F.date_sub(F.lit(end), 7 * e.HORIZON * F.col("origin"))
    before = lambda df: df.select("*", origins).where(F.col("week_start") <= cut)
    keys = [*PAIR, "origin"]
    fitted = s.with_season(before(rows), keys, "week_start", "demand", s.WEEKLY, least=e.LEAST)
    seasonal = s.seasonal_steps(fitted, keys, e.HORIZON, 7, "week_start", s.WEEKLY, s.Z80).select(*keys, "week_start", *e.BAND)
    model = learned(b, F.date_sub(F.lit(end), 7 * e.HORIZON * e.ORIGINS))
    trees = boosting.boosted_steps(model, boosting.history(before(rows), keys), keys).where("method = 'boosted_trees'").drop("method")
    told = seasonal.withColumn("method", F.lit("seasonal_trend")).unionByName(trees.withColumn("method", F.lit("boosted_trees")))
    kinds = e.prefixes(weekly_series(b), PAIR).select(*keys, e.series_class(F.col("y")).alias("demand_type"))
    actual = rows.withColumnRenamed("demand", "actual")
    return rounded(e.scored(told.join(kinds, keys).join(actual, [*PAIR, "week_start"])))


@q(
    "holdout_join",
    """SELECT place_id, item_id, week_start, demand_type, round(forecast, 4) AS forecast, round(lower, 4) AS lower, round(upper, 4) AS upper,
  round(expected, 4) AS expected, actual, current_stock, days_to_expiry, model_risk, expected_risk, model_discount, expected_discount,
  model_urgency, expected_urgency FROM judged""",
)
def _(b):
    out = held_out(b).withColumns({c: r4(c) for c in ("forecast", "lower", "upper", "expected")})
    return out.select(
        *PAIR, "week_start", "demand_type", "forecast", "lower", "upper", "expected", "actual", "current_stock", "days_to_expiry",
        "model_risk", "expected_risk", "model_discount", "expected_discount", "model_urgency", "expected_urgency",
    )


@q("forecast_metrics", f"SELECT {EXPECTED} FROM judged WHERE expected > 0")
def _(b):
    return rounded(e.forecast_metrics(held_out(b)))


@q(
    "metrics_by_class",
    f"""SELECT *, coalesce(wape < target, false) AS met FROM (SELECT *, CASE demand_type WHEN 'Smooth' THEN 20::DOUBLE WHEN 'Intermittent' THEN 40
  WHEN 'Lumpy' THEN 50 ELSE 30 END AS target FROM (SELECT demand_type, {EXPECTED} FROM judged WHERE expected > 0
  AND demand_type IN ('Smooth', 'Erratic', 'Intermittent', 'Lumpy') GROUP BY 1
  UNION ALL SELECT 'Overall', {EXPECTED} FROM judged WHERE expected > 0))""",
)
def _(b):
    return rounded(e.metrics_by_class(held_out(b)))


@q(
    "risk_accuracy",
    """SELECT risk, actual, predicted, "right", round(100.0::DOUBLE * "right" / nullif(actual, 0), 4) AS accuracy FROM (
  SELECT risk, sum(actual)::BIGINT AS actual, sum(predicted)::BIGINT AS predicted, sum(hits)::BIGINT AS "right" FROM (
    SELECT expected_risk AS risk, 1 AS actual, 0 AS predicted, (expected_risk = model_risk)::INTEGER AS hits FROM judged
    UNION ALL SELECT model_risk, 0, 1, 0 FROM judged UNION ALL SELECT 'Overall', 1, 1, (expected_risk = model_risk)::INTEGER FROM judged) GROUP BY 1)""",
)
def _(b):
    return rounded(e.risk_accuracy(held_out(b)))


@q(
    "urgency_correlation",
    """SELECT count(*) AS n, round(coalesce(CASE WHEN isnan(corr(expected_urgency, model_urgency)) THEN 0 ELSE corr(expected_urgency, model_urgency) END, 0), 4)
  AS urgency_correlation FROM judged""",
)
def _(b):
    return rounded(e.urgency_correlation(held_out(b)))


@q(
    "discount_alignment",
    """SELECT count(*) AS n, round(100 * avg(CASE WHEN abs(expected_discount - model_discount) <= 10 THEN 1 ELSE 0 END), 4) AS discount_alignment FROM judged""",
)
def _(b):
    return rounded(e.discount_alignment(held_out(b)))


@q(
    "output_quality",
    """SELECT rule, violations, violations = 0 AS passed FROM (
  SELECT 'forecast_not_negative' AS rule, count(*) FILTER (NOT forecast >= 0) AS violations FROM judged
  UNION ALL SELECT 'risk_present', count(*) FILTER (model_risk IS NULL) FROM judged
  UNION ALL SELECT 'urgency_in_range', count(*) FILTER (NOT model_urgency BETWEEN 1 AND 10) FROM judged
  UNION ALL SELECT 'bounds_in_order', count(*) FILTER (NOT lower <= upper) FROM judged)""",
)
def _(b):
    return e.output_quality(held_out(b))


@q(
    "doc_metrics",
    "SELECT round(avg(abs(forecast - actual)), 4) AS mae, round(100 * avg(CASE WHEN forecast <= actual THEN 1 ELSE 0 END), 4) AS hit_rate FROM judged",
)
def _(b):
    return rounded(e.doc_metrics(held_out(b)))


@q(
    "pass_fail",
    """SELECT *, goals_met >= 3 AS passed FROM (SELECT *, (wape < 30)::INTEGER + (risk_accuracy > 80)::INTEGER + (ci_coverage > 80)::INTEGER
  + (urgency_correlation > 0.7)::INTEGER AS goals_met FROM (
  SELECT round(100 * sum(abs(forecast - expected)) FILTER (expected > 0) / sum(expected) FILTER (expected > 0), 4) AS wape,
    round(100 * avg(CASE WHEN expected_risk = model_risk THEN 1 ELSE 0 END), 4) AS risk_accuracy,
    round(100 * avg(CASE WHEN actual BETWEEN lower AND upper THEN 1 ELSE 0 END) FILTER (expected > 0), 4) AS ci_coverage,
    round(coalesce(CASE WHEN isnan(corr(expected_urgency, model_urgency)) THEN 0 ELSE corr(expected_urgency, model_urgency) END, 0), 4)
      AS urgency_correlation FROM judged))""",
)
def _(b):
    return rounded(e.pass_fail(held_out(b)))
