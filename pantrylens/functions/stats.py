"""Statistics that stay exact and bounded per task whatever the size of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def r4(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 4)


def r8(column: Column | str) -> Column:
    """For ratios of whole numbers, which can end in a 5 at the fifth decimal."""
    return F.round(F.col(column) if isinstance(column, str) else column, 8)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolated quantiles as rows ``(*keys, column, prob, value)``.

    A mergeable sketch first brackets each quantile; only rows inside the bracket (about
    2/ACCURACY of the group) are then ranked exactly, so no task ever holds a whole group.
    """
    keys = list(keys)
    margin = 2.0 / ACCURACY
    sketch = []
    for c in columns:
        edges = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
        sketch += [
            F.count(c).alias(f"n__{c}"),
            F.percentile_approx(F.col(c).cast("double"), edges, ACCURACY).alias(f"e__{c}"),
        ]
    marks = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(float(p)).alias("prob"),
                F.col(f"n__{c}").alias("n"),
                F.col(f"e__{c}")[2 * i].alias("lo"),
                F.col(f"e__{c}")[2 * i + 1].alias("hi"),
            )
            for c in columns
            for i, p in enumerate(probs)
        ]
    )
    bounds = (
        df.groupBy(*keys).agg(*sketch).select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*").where("n > 0")
    )
    cells = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("x"),
    ).select(*keys, "x.*").where("v is not null")

    on = [*keys, "column"]
    # Without keys there is one row per column and probability, whatever the table's size. Spark takes the cells for as
    # small as the columns they come from, and would copy them to every task, and first to the driver.
    joined = _null_safe_join(cells, bounds if keys else F.broadcast(bounds), on)
    side = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0)
    # Values outside the bracket collapse to one row per side; inside, to one row per value.
    tally = (
        joined.select(*on, "prob", "n", side.alias("side"), "v")
        .withColumn("slot", F.when(F.col("side") == 0, F.col("v")))
        .groupBy(*on, "prob", "n", "side", "slot")
        .agg(F.count("*").alias("c"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    )
    run = Window.partitionBy(*on, "prob", "n").orderBy("side", "slot").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tally.withColumn("upto", F.sum("c").over(run)).withColumn(
        "v", F.when(F.col("side") < 0, F.col("v_max")).otherwise(F.col("v_min"))
    )
    pos = F.col("prob") * (F.col("n") - 1)
    out = ranked.groupBy(*on, "prob", "n").agg(
        F.min(F.when(F.col("upto") > F.floor(pos), F.col("v"))).alias("v0"),
        F.min(F.when(F.col("upto") > F.ceil(pos), F.col("v"))).alias("v1"),
    )
    frac = pos - F.floor(pos)
    return out.select(*on, "prob", (F.col("v0") + (F.col("v1") - F.col("v0")) * frac).alias("value"))


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"r__{k}") for k in on], *[c for c in right.columns if c not in on])
    cond = None
    for k in on:
        term = left[k].eqNullSafe(renamed[f"r__{k}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond).drop(*[f"r__{k}" for k in on])


def quantiles_wide(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` with one ``q<percent>`` column per probability."""
    named = [(p, f"q{round(p * 100)}") for p in probs]
    return (
        exact_quantiles(df, columns, probs, keys)
        .groupBy(*keys, "column")
        .agg(*[F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in named])
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with one map: the most frequent non-null value of each text column, the smallest on a tie.

    Values of all columns are counted together, in one pass and combined before the shuffle; a column without values
    is missing in the map.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    counts = cells.where("value is not null").groupBy("column", "value").count()
    best = counts.groupBy("column").agg(F.min_by("value", F.struct((-F.col("count")).alias("neg"), F.col("value"))).alias("value"))
    return best.agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("modes"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; combines map-side, so a hot key does not hurt."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])
