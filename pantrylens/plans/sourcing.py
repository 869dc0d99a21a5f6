"""Queries through files: a star schema of delimited files, and tables written and read back."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from pantrylens.plans.demand import weekly
from pantrylens.plans.registry import query
from pantrylens.session import shared_dir
from pantrylens.sources import sinks, star

WEEK = ["place_id", "item_id", "week_start", "demand"]


def fields(**kinds):
    return StructType([StructField(n, k()) for n, k in kinds.items()])


SCHEMAS = {
    "fct_orders": fields(id=LongType, place_id=LongType, created=TimestampType, total_amount=DoubleType, status=StringType),
    "fct_order_items": fields(id=LongType, order_id=LongType, item_id=LongType, quantity=DoubleType, price=DoubleType),
    "dim_items": fields(id=LongType, title=StringType, price=DoubleType),
}


def folder(b, name):
    """A new folder in the shared one."""
    return f"{shared_dir(b.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_star(b):
    """The bound tables as delimited files; prices of orders whose key 41 divides are the word 'unknown', which does not fit."""
    path = folder(b, "star")
    price = F.when(F.col("order_id") % 41 == 0, F.lit("unknown")).otherwise(F.col("price").cast("string"))
    tables = {
        "fct_orders": b.orders.select(*SCHEMAS["fct_orders"].names),
        "fct_order_items": b.lines.select("id", "order_id", "item_id", "quantity", price.alias("price")),
        "dim_items": b.items.select(*SCHEMAS["dim_items"].names),
        "nation": b.raw("nation"),
    }
    for name, table in tables.items():
        table.write.option("header", "true").csv(f"{path}/{name}.csv")
    return path


@query(
    "scan_star_csv",
    """SELECT 'fct_orders' AS name, 'fact' AS role, 5 AS columns, count(*) AS rows, 0::BIGINT AS broken_rows, 0::BIGINT AS null_cells FROM orders
UNION ALL SELECT 'fct_order_items', 'fact', 5, count(*), count(*) FILTER (l_orderkey % 41 = 0), count(*) FILTER (l_orderkey % 41 = 0) FROM lineitem
UNION ALL SELECT 'dim_items', 'dimension', 3, count(*), 0, 0 FROM part
UNION ALL SELECT 'nation', 'other', (SELECT count(*)::INTEGER FROM (DESCRIBE nation)), count(*), 0, 0 FROM nation""",
)
def _(b):
    return star.load_counts(star.scan_star(b.spark, written_star(b), SCHEMAS))


@query("sink_clean_tables", "SELECT place_id, item_id, week_start, demand FROM weekly")
def _(b):
    path = folder(b, "weekly")
    sinks.write_clustered(weekly(b).select(*WEEK), path, ["place_id"], ["item_id", "week_start"])
    return b.spark.read.parquet(path)


def by_place(b):
    """Weekly demand by place, one partition each; the second write replaces place 3 alone."""
    path = folder(b, "by-place")
    rows = weekly(b).select(*WEEK)
    sinks.write_partitions(rows, path, ["place_id"], order=["item_id", "week_start"])
    sinks.write_partitions(rows.where("place_id = 3"), path, ["place_id"], order=["item_id", "week_start"])
    return path


@query("sink_by_place", "SELECT place_id, item_id, week_start, demand FROM weekly")
def _(b):
    return b.spark.read.parquet(by_place(b)).select(F.col("place_id").cast("long").alias("place_id"), *WEEK[1:])


@query("scan_parquet_pruned", "SELECT item_id, week_start, demand FROM weekly WHERE place_id = 3")
def _(b):
    return sinks.read_pruned(b.spark, by_place(b), WEEK[1:], "place_id = 3")
