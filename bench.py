"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pantrylens.operators import classify, demand as d, features as f
from pantrylens.plans import load_all
from pantrylens.plans.features import TRAIN_END, VAL_END, holidays
from pantrylens.session import build_session
from pantrylens.sources.bindings import Bound

HEADLINE = [
    "daily_demand",
    "weekly_place_item",
    "fill_missing_dates",
    "expand_full_calendar",
    "feature_matrix",
    "class_distribution",
    "pair_density",
    "hierarchy_rollup",
    "forecast_long",
    "rolling_backtest",
    "check_leakage",
]
#: Pairs of places and items that the wide run is about: as many rows as the reference's feature table.
WIDE = "wide_feature_matrix"


def wide_features(spark, sf_dir):
    """The feature matrix over five places times the brands and sizes of parts: several thousand pairs instead of 125."""
    b = Bound(spark, sf_dir)
    size = F.col("p_size").cast("bigint")
    items = b.raw("part").select(F.col("p_partkey").alias("item_id"), (b.brand_code * 100 + size).alias("menu_item"))
    lines = b.lines.join(items, "item_id").drop("item_id").withColumnRenamed("menu_item", "item_id")
    weekly = d.weekly_place_item(lines, b.orders)
    return f.feature_matrix(d.expand_full_calendar(weekly), classify.sbc_classify(weekly), holidays(b), TRAIN_END, VAL_END)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    took: dict[str, float] = {}
    rows: dict[str, int] = {}
    timed = {n: queries[n] for n in HEADLINE if n in queries} | {WIDE: wide_features}
    for name, query in timed.items():
        began = time.perf_counter()
        seen = Observation(name)
        query(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        took[name], rows[name] = round(time.perf_counter() - began, 3), seen.get["rows"]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "rows": rows,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
