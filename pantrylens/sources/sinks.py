"""Written tables: partitioned, clustered, and safe to write twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clustered(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = (), files: int | None = None) -> None:
    """Replaces the table at ``path``; rows of a key lie together and in order, so that readers can skip row groups.

    Ranges instead of hashes: a key with a third of the rows is cut in several files where ``order`` tells its rows apart.
    """
    columns = [*by, *order]
    dealt = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    dealt.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str], spread: int = 4, order: Sequence[str] = ()) -> None:
    """Replaces the partitions that ``df`` has rows of, and leaves all others; a second run of the same rows changes nothing.

    Rows of a partition go to ``spread`` tasks at most, so that a large one is not written by a single task and a
    small one has few files. A null key has a partition of its own.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    dealt = df.repartition(*by, salt).sortWithinPartitions(*by, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_pruned(spark: SparkSession, path: str, columns: Sequence[str], where: str | None = None) -> DataFrame:
    """``columns`` of the rows that meet ``where``: the filter reaches the files, partitions that fail it are not opened."""
    table = spark.read.parquet(path)
    return (table if where is None else table.where(where)).select(*columns)
