"""A directory of delimited files as a star schema: tables found by name, roles told by prefix, broken rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BROKEN = "_broken"
# Roles by prefix of a table's name.
ROLES = {"fct_": "fact", "dim_": "dimension"}


def role_of(name: Column) -> Column:
    out = None
    for prefix, role in ROLES.items():
        hit = F.startswith(name, F.lit(prefix))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("other")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(name, role, files, bytes) of every table in a folder: ``<name>.csv``, one file or a folder of parts.

    Only names and sizes are read, through Spark, so any store that it can open will do. Empty files count, files of
    other names do not. A folder without tables gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_extract("path", rf"/\Q{root}\E/([^/]+)\.csv(/[^/]*)?$", 1)
    found = files.select(name.alias("name"), "length").where("name <> ''")
    return found.groupBy("name").agg(role_of(F.col("name")).alias("role"), F.count("*").alias("files"), F.sum("length").alias("bytes"))


def scan_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """One table. With a schema, values that do not fit are null and their whole line is in ``_broken``; without, all is text."""
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    if schema is None:
        return reader.csv(path)
    broken = StructField(BROKEN, StringType())
    return reader.option("columnNameOfCorruptRecord", BROKEN).schema(StructType([*schema.fields, broken])).csv(path)


def scan_star(spark: SparkSession, path: str, schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """Every table of a folder by its name; nothing is read before it is used. There are as many names as tables."""
    names = [r["name"] for r in discover(spark, path).select("name").collect()]
    return {n: scan_csv(spark, f"{path.rstrip('/')}/{n}.csv", (schemas or {}).get(n)) for n in sorted(names)}


def load_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, role, columns, rows, broken_rows, null_cells): one pass over each table.

    Spark skips columns that nobody asks for, and with them what may be wrong in them; the nulls ask for all.
    """
    out = None
    for name, table in tables.items():
        columns = [c for c in table.columns if c != BROKEN]
        broken = F.col(BROKEN).isNotNull() if BROKEN in table.columns else F.lit(False)
        nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
        counts = [F.count("*").alias("rows"), F.count_if(broken).alias("broken_rows"), F.coalesce(F.sum(nulls), F.lit(0).cast("long")).alias("null_cells")]
        row = table.agg(*counts).select(
            F.lit(name).alias("name"), role_of(F.lit(name)).alias("role"), F.lit(len(columns)).alias("columns"), "rows", "broken_rows", "null_cells"
        )
        out = row if out is None else out.unionByName(row)
    return out
