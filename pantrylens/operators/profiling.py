"""Profiles of whole tables, the issues in them, and a readiness score; a catalogue maps table names to frames.

Every table is read once for all measures of all its columns. Duplicates need a shuffle of their own, quantiles two
passes. Defined cases: an empty table has measures with 0 rows, a share of it is 0, and it is never ready; a column
of nulls only has no numeric summary; two nulls are equal when rows or keys are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrylens.functions.stats import exact_quantiles

Catalogue = dict[str, DataFrame]

# Parts of column names that tell the role of a column.
TIME_WORDS = ("created", "updated", "time", "date")
AMOUNT_WORDS = ("quantity", "amount", "price", "cost")
NUMERIC_WORDS = ("amount", "price", "cost", "quantity", "points")
CATEGORY_WORDS = ("status", "type", "channel", "method")
# The prefix of fact tables, the range of seconds that look like a point in time, shares in percent.
FACT = "fct_"
LEAST_EPOCH, MOST_EPOCH = 1_000_000_000, 2_147_483_647
SUSPICIOUS, CRITICAL, WARNING = 80, 20, 5
DUPLICATES_CRITICAL, DUPLICATES_WARNING = 100, 10
WHOLE = ("tinyint", "smallint", "int", "bigint")


def is_number(kind: str) -> bool:
    return kind in WHOLE or kind in ("float", "double") or kind.startswith("decimal")


def quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def numbers(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if is_number(kind)]


def share(part: str, whole: str = "rows") -> Column:
    """Percent with two decimals, half up in whole numbers; 0 of nothing."""
    return F.expr(f"coalesce(((20000 * {part} + {whole}) div nullif(2 * {whole}, 0)) / 100.0D, 0.0D)")


def named_like(words: Sequence[str], column: str = "column") -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.lower(column).contains(word)
    return out


def is_key() -> Column:
    return (F.col("column") == "id") | F.col("column").endswith("_id")


def united(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def measures(tables: Catalogue) -> DataFrame:
    """One row per table and column: kind, rows, nulls and, of numbers, mean, std, min, max, negatives and fractions."""
    return united([_measured(name, df) for name, df in tables.items()])


def _measured(name: str, df: DataFrame) -> DataFrame:
    cells = []
    for column, kind in df.dtypes:
        value = quoted(column)
        number = value.cast("double") if is_number(kind) else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(column).alias("column"),
                F.lit(kind).alias("kind"),
                F.count("*").alias("rows"),
                F.count_if(value.isNull()).alias("nulls"),
                F.avg(number).alias("mean"),
                F.stddev_samp(number).alias("std"),
                F.min(number).alias("least"),
                F.max(number).alias("most"),
                F.count_if(number < 0).alias("negatives"),
                F.count_if(number != F.floor(number)).alias("fractions"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.lit(name).alias("table"), F.inline("cells"))


def null_profile(measured: DataFrame) -> DataFrame:
    return measured.select("table", "column", "nulls", share("nulls").alias("null_pct"))


def duplicate_rows(tables: Catalogue) -> DataFrame:
    """Rows of each table that repeat an earlier one in all columns."""
    return united([_repeats(name, df, df.columns, "duplicate_rows") for name, df in tables.items()])


def duplicate_keys(tables: Catalogue, key: str = "id") -> DataFrame:
    """Rows beyond the first of each key, of the tables that have it; rows without a key count as one key."""
    return united([_repeats(name, df, [key], "duplicate_keys") for name, df in tables.items() if key in df.columns])


def _repeats(name: str, df: DataFrame, columns: list[str], as_name: str) -> DataFrame:
    grouped = df.groupBy(*[quoted(c).alias(f"c{k}") for k, c in enumerate(columns)]).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return grouped.agg(
        F.lit(name).alias("table"),
        F.coalesce(F.sum("n"), zero).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias(as_name),
    )


def numeric_profile(tables: Catalogue, measured: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, least and most of every numeric column that has a value."""
    medians = united(
        [exact_quantiles(df, numbers(df), [0.5]).select(F.lit(name).alias("table"), "column", F.col("value").alias("median")) for name, df in tables.items()]
    )
    known = measured.select("table", "column", "mean", "std", "least", "most", (F.col("rows") - F.col("nulls")).alias("non_null"))
    return known.join(medians, ["table", "column"])


def looks_like_time(least_epoch: int) -> Column:
    return named_like(TIME_WORDS) & (F.col("least") > least_epoch) & (F.col("most") < MOST_EPOCH)


def date_ranges(measured: DataFrame, least_epoch: int = LEAST_EPOCH) -> DataFrame:
    """First and last second and day of the columns that tell when a row was made or changed."""
    seconds = measured.where(named_like(TIME_WORDS[:2]) & (F.col("least") > least_epoch))
    first, last = F.col("least").cast("long"), F.col("most").cast("long")
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    return seconds.select(
        "table", "column", first.alias("first_second"), last.alias("last_second"), day(first).alias("first_day"), day(last).alias("last_day")
    )


def column_roles(measured: DataFrame, least_epoch: int = LEAST_EPOCH) -> DataFrame:
    """The role of each column, by its values where its name speaks of time, else by name, else by kind."""
    role = (
        F.when(looks_like_time(least_epoch), "timestamp")
        .when(is_key(), "id")
        .when(named_like(NUMERIC_WORDS), "numeric")
        .when(named_like(CATEGORY_WORDS), "categorical")
        .when(F.col("kind").isin(*WHOLE), "integer")
        .when(F.col("kind").isin("float", "double"), "float")
        .otherwise(F.col("kind"))
    )
    return measured.select("table", "column", role.alias("role"))


def negative_issues(tables: Catalogue, samples: int = 5) -> DataFrame:
    """Amount columns with negative values: how many, the least, and the smallest few that differ, as JSON.

    Values are counted before they are ranked, and a rank is cut off where it is made.
    """
    cells = []
    for name, df in tables.items():
        amounts = [c for c in numbers(df) if any(w in c.lower() for w in AMOUNT_WORDS)]
        if amounts:
            each = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in amounts])
            cells.append(df.select(F.lit(name).alias("table"), F.inline(each)).where("value < 0"))
    on = ["table", "column"]
    counted = united(cells).groupBy(*on, "value").agg(F.count("*").alias("n"))
    totals = counted.groupBy(*on).agg(F.sum("n").alias("negatives"), F.min("value").alias("least"))
    rank = F.row_number().over(Window.partitionBy(*on).orderBy("value"))
    few = counted.withColumn("rank", rank).where(F.col("rank") <= samples)
    shown = few.groupBy(*on).agg(F.to_json(F.sort_array(F.collect_list("value"))).alias("samples"))
    return totals.join(shown, on)


def missing_keys(measured: DataFrame) -> DataFrame:
    """Foreign keys of fact tables with nulls."""
    keys = F.col("column").endswith("_id") & F.col("table").startswith(FACT) & (F.col("nulls") > 0)
    return null_profile(measured.where(keys))


def outlier_issues(tables: Catalogue, measured: DataFrame, factor: float = 3.0, least_values: int = 10) -> DataFrame:
    """Numeric columns with values further than ``factor`` interquartile ranges outside the quartiles."""
    found = []
    for name, df in tables.items():
        columns = numbers(df)
        quartile = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
        quartiles = exact_quantiles(df, columns, [0.25, 0.75]).groupBy("column").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
        each = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns])
        reach = factor * (F.col("q3") - F.col("q1"))
        outside = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
        # one row per column of the table, whatever its size
        known = df.select(F.inline(each)).where("value is not null").join(F.broadcast(quartiles.where("q3 > q1")), "column")
        counts = known.groupBy("column").agg(F.count("*").alias("values"), F.count_if(outside).alias("outliers"))
        found.append(counts.where((F.col("values") > least_values) & (F.col("outliers") > 0)).withColumn("table", F.lit(name)))
    rows = measured.select("table", "column", "rows")
    return united(found).join(rows, ["table", "column"]).select("table", "column", "outliers", share("outliers").alias("outlier_pct"))


def readiness(measured: DataFrame, keys: DataFrame) -> DataFrame:
    """Points of 100 that each table keeps, how many issues took the rest, and a status. ``keys``: from duplicate_keys."""
    pct = share("nulls")
    foreign = F.col("column").endswith("_id") & F.col("table").startswith(FACT)
    counts = measured.groupBy("table").agg(
        F.max("rows").alias("rows"),
        F.count_if(is_key() & (pct > 50)).alias("gaps_in_keys"),
        F.count_if(~is_key() & (pct > 20)).alias("gaps"),
        F.count_if(named_like(AMOUNT_WORDS) & (F.col("negatives") > 0)).alias("negative_columns"),
        F.count_if(foreign & (pct > 30)).alias("gaps_in_foreign"),
    )
    flag = lambda c: c.cast("int")
    empty, repeated = flag(F.col("rows") == 0), flag(F.coalesce(F.col("duplicate_keys"), F.lit(0)) > 0)
    gaps, negative, foreign_gaps = flag(F.col("gaps") > 5), flag(F.col("negative_columns") > 0), flag(F.col("gaps_in_foreign") > 0)
    points = 100 - 50 * empty - 30 * repeated - 20 * F.col("gaps_in_keys") - 10 * gaps - 5 * negative - 10 * foreign_gaps
    status = F.when(points >= 80, "ready").when(points >= 50, "needs_cleaning").otherwise("critical_issues")
    judged = counts.join(keys.select("table", "duplicate_keys"), "table", "left")
    issues = empty + repeated + F.col("gaps_in_keys") + gaps + negative + foreign_gaps
    return judged.select("table", F.greatest(points, F.lit(0)).cast("long").alias("score"), status.alias("status"), issues.cast("long").alias("issues"))


def suspicious_columns(measured: DataFrame, stock_table: str = "dim_skus") -> DataFrame:
    """Columns that are nearly all null, and negative quantities in the stock table."""
    empty = share("nulls") > SUSPICIOUS
    negative = (F.col("table") == stock_table) & F.lower("column").contains("quantity") & (F.col("negatives") > 0)
    issues = F.array_compact(
        F.array(
            F.when(empty, F.struct(F.lit("missing values").alias("issue"), F.lit("high").alias("severity"))),
            F.when(negative, F.struct(F.lit("negative quantities").alias("issue"), F.lit("critical").alias("severity"))),
        )
    )
    return measured.select("table", "column", F.inline(issues))


def quality_report(ready: DataFrame) -> DataFrame:
    """Tables of each status, in order of their names."""
    names = F.array_join(F.sort_array(F.collect_list("table")), ", ")
    return ready.groupBy("status").agg(F.count("*").alias("n_tables"), names.alias("tables"), F.min("score").alias("least_score"))


def required_columns(measured: DataFrame, schemas: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Each declared column, whether it is there and filled. ``schemas``: table to need (required, optional) to columns."""
    spark = measured.sparkSession
    declared = [(t, c, need) for t, needs in schemas.items() for need, columns in needs.items() for c in columns]
    wanted = spark.createDataFrame(declared, "table string, column string, need string")
    found = measured.select("table", "column", (F.col("rows") - F.col("nulls")).alias("filled"))
    absent = F.col("filled").isNull()
    status = F.when(absent & (F.col("need") == "required"), "error").when(absent, "absent").otherwise("present")
    return wanted.join(found, ["table", "column"], "left").select(
        "table", "column", "need", F.coalesce("filled", F.lit(0).cast("long")).alias("filled"), status.alias("status")
    )


def valid_timestamps(tables: Catalogue, columns: Sequence[str], first_second: int = 1_577_836_800, end_second: int = 1_893_456_000) -> DataFrame:
    """Columns that should hold points in time: seconds outside the range, or texts that are none."""
    found = []
    for name, df in tables.items():
        for column, kind in df.dtypes:
            if column not in columns:
                continue
            value = quoted(column)
            if is_number(kind):
                bad, wrong = (value <= first_second) | (value >= end_second), "unusual"
            else:
                bad, wrong = F.try_to_timestamp(value.cast("string")).isNull(), "unparseable"
            counted = df.where(value.isNotNull()).agg(F.count("*").alias("filled"), F.count_if(bad).alias("bad_rows"))
            status = F.when(F.col("filled") == 0, "empty").when(F.col("bad_rows") > 0, wrong).otherwise("ok")
            found.append(
                counted.select(
                    F.lit(name).alias("table"), F.lit(column).alias("column"), "filled", "bad_rows", share("bad_rows", "filled").alias("bad_pct"), status.alias("status")
                )
            )
    return united(found)


def missing_thresholds(measured: DataFrame) -> DataFrame:
    """Columns with nulls, and how bad that is; compared as counts, so that nothing is rounded."""
    nulls, rows = F.col("nulls"), F.col("rows")
    severity = F.when(100 * nulls > CRITICAL * rows, "critical").when(100 * nulls > WARNING * rows, "warning").otherwise("info")
    return measured.where(nulls > 0).select("table", "column", "nulls", share("nulls").alias("null_pct"), severity.alias("severity"))


def valid_duplicates(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Repeated rows and keys of each table and how bad they are. From duplicate_rows and duplicate_keys."""
    n, k = F.col("duplicate_rows"), F.coalesce("duplicate_keys", F.lit(0).cast("long"))
    severity = F.when(n > DUPLICATES_CRITICAL, "critical").when((n > DUPLICATES_WARNING) | (k > 0), "warning").otherwise("ok")
    both = rows.join(keys.select("table", "duplicate_keys"), "table", "left")
    return both.select("table", "duplicate_rows", k.alias("duplicate_keys"), severity.alias("severity"))


def negative_demand(datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows of each dataset whose demand (the named column) is negative."""
    rows = [
        df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.count_if(quoted(column) < 0).alias("negative_rows"))
        for name, (df, column) in datasets.items()
    ]
    return united(rows).withColumn("passed", F.col("negative_rows") == 0)


def whole_numbers(measured: DataFrame, declared: dict[str, list[str]]) -> DataFrame:
    """Columns that are declared to be integers: values that are none."""
    pairs = [F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, columns in declared.items() for c in columns]
    wanted = measured.where(F.struct("table", "column").isin(pairs))
    return wanted.select("table", "column", "kind", "fractions", (F.col("fractions") == 0).alias("passed"))


def tables_present(tables: Catalogue, required: Sequence[str]) -> DataFrame:
    """Each required table: whether it is there, and its rows."""
    first = next(iter(tables.values())).sparkSession
    wanted = first.createDataFrame([(name,) for name in required], "table string")
    counts = united([df.agg(F.count("*").alias("rows")).withColumn("table", F.lit(name)) for name, df in tables.items()])
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").otherwise("ok")
    return wanted.join(counts, "table", "left").select("table", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), status.alias("status"))
