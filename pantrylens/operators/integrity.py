"""Checks that tables fit together: keys have parents, and features know no more than they may."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.operators.demand import PAIR

LAGS = {"lag_1w": 1, "lag_2w": 2, "lag_4w": 4, "lag_52w": 52}


@dataclass(frozen=True)
class Relation:
    """``child.column`` should hold keys of ``parent.key``, or null."""

    name: str
    child: DataFrame
    column: str
    parent: DataFrame
    key: str


def relation_rows(relation: Relation) -> DataFrame:
    """One row: rows of the child, those without a key, those whose key has no parent, and how many such keys there are.

    Child rows are counted by key before anything is joined, so a key that most rows share is one row of the join.
    """
    kind = dict(relation.parent.dtypes)[relation.key]
    keys = relation.child.groupBy(F.col(relation.column).cast(kind).alias("key")).agg(F.count("*").alias("rows"))
    parents = relation.parent.select(F.col(relation.key).alias("key")).where("key is not null").distinct().withColumn("known", F.lit(True))
    orphan = F.col("key").isNotNull() & F.col("known").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return keys.join(parents, "key", "left").agg(
        F.lit(relation.name).alias("relation"),
        zero(F.sum("rows")).alias("child_rows"),
        zero(F.sum(F.when(F.col("key").isNull(), F.col("rows")))).alias("null_rows"),
        zero(F.sum(F.when(orphan, F.col("rows")))).alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_keys"),
    )


def referential_integrity(relations: list[Relation]) -> DataFrame:
    """All relations' rows with the share of keyed rows that have a parent (100 without any) and a status."""
    out = None
    for relation in relations:
        row = relation_rows(relation)
        out = row if out is None else out.unionByName(row)
    keyed = F.col("child_rows") - F.col("null_rows")
    share = F.when(keyed > 0, 100 * (keyed - F.col("orphan_rows")) / keyed).otherwise(100.0)
    status = F.when(F.col("orphan_rows") == 0, "ok").when(share >= 95, "warning").otherwise("broken")
    return out.withColumns({"integrity_pct": share, "status": status})


def orphans(relation: Relation) -> DataFrame:
    """The child's rows whose key has no parent."""
    kind = dict(relation.parent.dtypes)[relation.key]
    parents = relation.parent.select(F.col(relation.key).alias("parent_key")).distinct()
    keyed = relation.child.where(F.col(relation.column).isNotNull())
    return keyed.join(parents, F.col(relation.column).cast(kind) == F.col("parent_key"), "left_anti")


def check_leakage(features: DataFrame, weekly: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """(check, rows, violations, passed): splits by date, and lags and rolling bounds against raw demand of earlier weeks.

    ``weekly`` has the weeks with sales only; a week without a row had none. Each of its rows is dealt to the weeks
    that may see it, k weeks later, and joined to the features by pair and week. So a lag is compared with the raw
    table, not with the window that made it, and a feature that has seen its own week differs.
    """
    steps = sorted({*LAGS.values(), 1, 2, 3, 4})
    later = weekly.select(*PAIR, "week_start", F.col("demand").alias("seen"), F.explode(F.array(*[F.lit(k) for k in steps])).alias("k"))
    shifted = later.withColumn("week_start", F.date_add("week_start", 7 * F.col("k")))
    at = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("seen"))), F.lit(0.0))
    past = shifted.groupBy(*PAIR, "week_start").agg(*[at(k).alias(f"back_{k}") for k in steps])
    known = features.join(past, [*PAIR, "week_start"], "left").na.fill(0.0, [f"back_{k}" for k in steps])
    week, flag = F.col("week_start"), F.col("train_val_test_flag")
    day = lambda text: F.lit(text).cast("date")
    recent = [F.col(f"back_{k}") for k in (1, 2, 3, 4)]
    rules: dict[str, tuple[Column, Column]] = {
        "train_before_split": (flag == "train", week <= day(train_end)),
        "val_between_splits": (flag == "val", (week > day(train_end)) & (week <= day(val_end))),
        "test_after_splits": (flag == "test", week > day(val_end)),
        **{f"{lag}_is_past_demand": (F.lit(True), F.col(lag) == F.col(f"back_{k}")) for lag, k in LAGS.items()},
        "roll_max_4w_is_past": (F.lit(True), F.col("roll_max_4w") <= F.greatest(*recent)),
        "roll_min_4w_is_past": (F.lit(True), F.col("roll_min_4w") >= F.least(*recent)),
    }
    counts = [F.count_if(of).alias(f"n_{n}") for n, (of, _) in rules.items()]
    broken = [F.count_if(of & ~F.coalesce(ok, F.lit(False))).alias(f"v_{n}") for n, (of, ok) in rules.items()]
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"n_{n}").alias("rows"), F.col(f"v_{n}").alias("violations")) for n in rules])
    return known.agg(*counts, *broken).select(F.inline(cells)).withColumn("passed", F.col("violations") == 0)
