"""Cleaning: conversion, repair, de-duplication and filters, each ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrylens.functions.stats import keep_first, most_frequent, quantiles_wide

# Name fragments that give a column its role.
TIME_WORDS = ("created", "updated", "time", "date")
AMOUNT_WORDS = ("amount", "quantity", "price", "cost", "points")
SIGNED_WORDS = ("quantity", "amount", "price", "cost")
CATEGORY_WORDS = ("status", "type", "channel", "method")
CANCELLED = ("cancelled", "Cancelled", "CANCELLED")
PII = ("customer_name", "external_id", "account_id", "customer_mobile_phone")
ORDER_COLUMNS = ("id", "place_id", "created_dt", "total_amount", "status", "type", "demo_mode")
LINE_COLUMNS = (
    "id", "order_id", "item_id", "quantity", "price", "created_dt", "status", "discount_amount", "add_on_ids",
)
ITEM_COLUMNS = ("id", "title", "section_id", "status", "price")

# Epoch bounds; seconds lie between, milliseconds above.
EPOCH_SECONDS = (1_000_000_000, 2_147_483_647)
EPOCH_MILLIS = 1_000_000_000_000

NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")


def has_word(column: str, words: Sequence[str]) -> bool:
    return any(w in column.lower() for w in words)


def is_id(column: str) -> bool:
    return column == "id" or column.endswith("_id")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC]


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def epoch_to_timestamp(df: DataFrame, columns: Sequence[str], earliest: int = EPOCH_SECONDS[0]) -> DataFrame:
    """Epoch seconds or milliseconds become timestamps.

    A column whose values are not all epoch times of one unit keeps its type and values. The bounds decide
    the type of the column, so they are read when the plan is built: one row of two values a column.
    """
    numeric = set(numeric_columns(df))
    columns = [c for c in present(df, columns) if c in numeric]
    if not columns:
        return df
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in columns:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is None:
            continue
        if lo > earliest and hi < EPOCH_SECONDS[1]:
            out[c] = F.timestamp_seconds(F.col(c).cast("bigint"))
        elif lo > EPOCH_MILLIS:
            out[c] = F.timestamp_millis(F.col(c).cast("bigint"))
    return df.withColumns(out) if out else df


def standardize_ids(df: DataFrame) -> DataFrame:
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({c: F.col(c).cast("bigint") for c in df.columns if is_id(c) and c in floats})


def fill_missing_numeric(df: DataFrame) -> DataFrame:
    amounts = [c for c in numeric_columns(df) if has_word(c, AMOUNT_WORDS) and not is_id(c)]
    return df.na.fill(0, amounts) if amounts else df


def missing_ids(df: DataFrame) -> DataFrame:
    """Ids are never imputed, only counted."""
    ids = [c for c in df.columns if is_id(c)]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ids])
    return counts.unpivot([], ids, "column", "missing")


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and has_word(c, CATEGORY_WORDS) and not is_id(c)]


def fill_missing_mode(df: DataFrame) -> DataFrame:
    """Nulls of categorical columns become the column's most frequent value; one pass for all columns."""
    columns = categorical_columns(df)
    if not columns:
        return df
    modes = most_frequent(df, columns).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), modes[c], F.lit("Unknown")) for c in columns})


def fill_missing_text(df: DataFrame) -> DataFrame:
    skip = set(categorical_columns(df))
    text = [
        c
        for c, t in df.dtypes
        if t == "string" and c not in skip and not is_id(c) and not has_word(c, AMOUNT_WORDS)
    ]
    return df.na.fill("", text) if text else df


def fill_missing(df: DataFrame, strategy: str = "smart", key: str | None = None, time: str | None = None) -> DataFrame:
    """``smart``, ``drop``, ``zero`` or ``forward_fill`` (over ``key`` in ``time`` order)."""
    if strategy == "smart":
        return fill_missing_text(fill_missing_mode(fill_missing_numeric(df)))
    if strategy == "drop":
        return df.dropna()
    if strategy == "zero":
        return df.na.fill(0).na.fill("")
    if strategy == "forward_fill":
        if key is None or time is None:
            raise ValueError("forward_fill needs key and time")
        rest = [c for c in df.columns if c not in (key, time)]
        upto = Window.partitionBy(key).orderBy(time, *rest).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in rest})
    raise ValueError(f"unknown strategy {strategy!r}")


def dedup_by_key(df: DataFrame, key: str = "id", order: Sequence[str] | None = None) -> DataFrame:
    """The first row per key in a stated total order (all other columns by default)."""
    return keep_first(df, [key], list(order or [c for c in df.columns if c != key]))


def negatives_clamp(df: DataFrame, columns: Sequence[str] = ("quantity",)) -> DataFrame:
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in present(df, columns)})


def negative_counts(df: DataFrame) -> DataFrame:
    signed = [c for c in numeric_columns(df) if has_word(c, SIGNED_WORDS)]
    return df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in signed]).unpivot([], signed, "column", "negatives")


def outlier_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the 3 IQR fence, only with more than ten values and a positive IQR."""
    q = quantiles_wide(df, columns, [0.25, 0.75])
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "n")
    iqr = F.col("q75") - F.col("q25")
    return (
        q.join(F.broadcast(counts), "column")
        .where((F.col("n") > 10) & (iqr > 0))
        .select("column", "n", (F.col("q25") - 3 * iqr).alias("lower"), (F.col("q75") + 3 * iqr).alias("upper"))
    )


def flag_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``<column>_outlier_flag``; null where the column has no usable fence."""
    columns = list(columns or numeric_columns(df))
    fence = outlier_bounds(df, columns)
    fences = fence.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("lower", "upper")))).alias("m")
    ).scalar()
    out = {}
    for c in columns:
        edge = F.try_element_at(fences, F.lit(c))
        outside = (F.col(c) < edge["lower"]) | (F.col(c) > edge["upper"])
        out[f"{c}_outlier_flag"] = F.when(edge.isNotNull(), F.coalesce(outside, F.lit(False)))
    return df.withColumns(out)


def not_demo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("demo_mode").eqNullSafe(1)) if "demo_mode" in df.columns else df


def not_cancelled(df: DataFrame) -> DataFrame:
    if "status" not in df.columns:
        return df
    return df.where(F.coalesce(~F.col("status").isin(*CANCELLED), F.lit(True)))


def filter_demo_cancelled(orders: DataFrame) -> DataFrame:
    return not_cancelled(not_demo(orders))


def drop_pii(df: DataFrame) -> DataFrame:
    return df.drop(*PII)


def clean_orders(orders: DataFrame) -> DataFrame:
    kept = filter_demo_cancelled(orders).withColumn("created_dt", F.timestamp_seconds("created"))
    kept = drop_pii(kept)
    return dedup_by_key(kept.select(*present(kept, ORDER_COLUMNS)))


def restrict_to(df: DataFrame, parents: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows whose ``column`` is a ``key`` of ``parents``."""
    return df.join(parents.select(F.col(key).alias(column)), column, "left_semi")


def nonneg_quantity(lines: DataFrame, need_order: bool = False) -> DataFrame:
    kept = lines.where(F.col("quantity") >= 0)
    if need_order:
        kept = kept.dropna(subset=["order_id"])
    return kept.na.fill(0.0, ["discount_amount"]) if "discount_amount" in kept.columns else kept


def clean_order_lines(lines: DataFrame, clean_orders: DataFrame) -> DataFrame:
    kept = lines.withColumn("created_dt", F.timestamp_seconds("created"))
    kept = standardize_ids(nonneg_quantity(kept))
    kept = restrict_to(kept.select(*present(kept, LINE_COLUMNS)), clean_orders, "order_id")
    return dedup_by_key(kept)


def clean_items(items: DataFrame) -> DataFrame:
    return dedup_by_key(items.select(*present(items, ITEM_COLUMNS)))


def place_activity(places: DataFrame, orders: DataFrame, cutoff: str, days: int = 90, time: str = "created") -> DataFrame:
    """First and last order and order count per place; active when the last order is recent."""
    activity = orders.groupBy(F.col("place_id").alias("id")).agg(
        F.min(time).alias("first_order"), F.max(time).alias("last_order"), F.count("*").alias("order_count")
    )
    since = F.date_sub(F.lit(cutoff).cast("date"), days).cast("timestamp")
    return places.join(activity, "id", "left").withColumn(
        "active_flag", F.coalesce(F.col("last_order") >= since, F.lit(False))
    )


def place_active_relative(places: DataFrame, orders: DataFrame, days: int = 90, time: str = "created") -> DataFrame:
    """Active when any order lies within ``days`` of the newest order in the data."""
    since = orders.agg(F.max(time)).scalar() - F.expr(f"interval {days} days")
    recent = orders.where(F.col(time) >= since).groupBy(F.col("place_id").alias("id")).agg(F.lit(True).alias("hit"))
    return places.join(recent, "id", "left").withColumn("is_active", F.coalesce("hit", F.lit(False))).drop("hit")


def restrict_active(orders: DataFrame, lines: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = restrict_to(orders, places.where("active_flag"), "place_id")
    return kept, restrict_to(lines, kept, "order_id")


def clean_table(
    df: DataFrame,
    time_columns: Sequence[str] | None = None,
    strategy: str = "smart",
    dedup: bool = True,
    negatives: bool = True,
    ids: bool = True,
    outliers: Sequence[str] | None = (),
    clamp: bool = False,
    key: str | None = None,
    time: str | None = None,
    earliest: int = EPOCH_SECONDS[0],
) -> DataFrame:
    """The fixed cleaning order as one plan; each step can be switched off.

    ``outliers`` names the columns to flag (``None`` = every numeric column). ``clamp`` is for
    stock tables, where a negative quantity is an entry error. ``key`` and ``time`` serve ``forward_fill``.
    """
    times = [c for c in df.columns if has_word(c, TIME_WORDS)] if time_columns is None else list(time_columns)
    out = fill_missing(epoch_to_timestamp(df, times, earliest), strategy, key, time)
    if dedup and "id" in out.columns:
        out = dedup_by_key(out)
    if negatives and clamp:
        out = negatives_clamp(out)
    if ids:
        out = standardize_ids(out)
    if outliers is None or outliers:
        out = flag_outliers(out, outliers)
    return out


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cleaning_summary(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    was = row_counts(before).withColumnRenamed("rows", "rows_before")
    now = row_counts(after).withColumnRenamed("rows", "rows_after")
    removed: Column = F.col("rows_before") - F.col("rows_after")
    return was.join(now, "table").select("table", "rows_before", "rows_after", removed.alias("rows_removed"))
