"""Exact top-k inner-product search by a Voronoi join.

Rows are grouped by their nearest pivot. Each group's summary (size, radius) bounds the score of any
query against any of its rows: |q.x - q.p| <= |q| * radius. A query is first solved in the group of
its best pivot, which gives a score that the k-th best result cannot fall below; it then goes only to
groups whose upper bound reaches that score. Large groups are dealt into blocks of rows and of
queries, so no task holds a whole group, and each block is solved as one matrix product.

Components are floor(1024 * x), so scores are exact integers.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, as
query or candidate. Vectors of another length than the query's are not its candidates. A repeated
row is a candidate of its own; rows with the query's id are the query's own and left out; of several
query rows with one id the smallest vector is asked. Equal scores go to the smaller id. Null ids are
candidates only if every id is present: rows without an id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pantrylens.llm.shared import saved

#: Most pivots; their vectors and summaries are the only things held on the driver.
MAX_PIVOTS = 512
#: Rows of a data block, and queries of a query block.
DATA_BLOCK, QUERY_BLOCK = 20_000, 4_000
SCALE = 1024
MATCHES = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim and x: the usable vectors as integers."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda a: a.isNull() | F.isnan(a) | (F.abs(a.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.size(v).alias("dim"),
        F.transform(v, lambda a: F.floor(a.cast("double") * SCALE).cast("double")).alias("x"),
    )


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 1))


def top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> pd.DataFrame:
    """The k best (score, then smaller id) of ``data`` for each query, without its own id."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    out = []
    for lo in range(0, len(query_ids), 256):
        q = query_ids[lo : lo + 256]
        scores = queries[lo : lo + 256] @ data.T
        scores[q[:, None] == ids[None, :]] = -np.inf
        if scores.shape[1] > k:
            kth = np.partition(scores, -k, axis=1)[:, -k]
        else:
            kth = np.full(len(q), -1e300)
        row, col = np.nonzero((scores >= kth[:, None]) & np.isfinite(scores))
        value = scores[row, col]
        ranked = np.lexsort((col, -value, row))
        row, col, value = row[ranked], col[ranked], value[ranked]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < k
        out.append(pd.DataFrame({"query_id": q[row[keep]], "vec_id": ids[col[keep]], "score": value[keep].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for the ``is_query`` rows (over ``vec_id``) against all rows."""
    spark = vectors.sparkSession
    usable = quantized(vectors, id_col, vector_col)
    n = usable.count()
    pivots = min(MAX_PIVOTS, max(1, math.isqrt(n) // 2))
    chosen = usable.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(pivots).select("dim", "x").distinct().collect()
    by_dim: dict[int, list] = {}
    for r in sorted(chosen, key=lambda r: (r["dim"], r["x"])):
        by_dim.setdefault(r["dim"], []).append(r["x"])
    for r in usable.select("dim").distinct().collect():
        by_dim.setdefault(r["dim"], [[0.0] * r["dim"]])
    first, centres = {}, {}
    for dim, rows in sorted(by_dim.items()):
        first[dim] = sum(len(c) for c in centres.values())
        centres[dim] = np.array(rows)
    shared = spark.sparkContext.broadcast((first, centres))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, centres = shared.value
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x, c = matrix(part["x"]), centres[dim]
                near = np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy(),
                        "x": part["x"].to_numpy(),
                        "dim": dim,
                        "cell": (near + first[dim]).astype(np.int64),
                        "away": np.sqrt(((x - c[near]) ** 2).sum(1)),
                    }
                )

    schema = "vec_id long, x array<double>, dim int, cell long, away double"
    rows = saved(usable.mapInPandas(assign, schema), "knn-rows")
    summaries = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    summary = spark.sparkContext.broadcast({r["cell"]: (r["n"], r["radius"]) for r in summaries})
    queries = saved(
        rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("x", "dim")).alias("q")).select("vec_id", "q.x", "q.dim"), "knn-queries"
    )
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def bounds(x: np.ndarray, dim: int):
        first, centres = shared.value
        c = centres[dim]
        size = np.array([summary.value.get(first[dim] + i, (0, 0.0)) for i in range(len(c))])
        mid = x @ c.T
        slack = np.sqrt((x * x).sum(1))[:, None] * (size[:, 1] * (1 + 1e-9))[None, :]
        upper = np.where(size[:, 0][None, :] > 0, mid + slack + 1e-6 * np.abs(mid) + 1, -np.inf)
        return first[dim], size[:, 0], mid, upper

    def emit(part: pd.DataFrame, x: np.ndarray, wanted: np.ndarray, base: int, sizes: np.ndarray, home) -> Iterator[pd.DataFrame]:
        q, cell = np.nonzero(wanted)
        blocks = np.maximum(1, np.ceil(sizes[cell] / DATA_BLOCK)).astype(np.int64)
        rep = np.repeat(np.arange(len(q)), blocks)
        block = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        ids = part["vec_id"].to_numpy()[q[rep]]
        for lo in range(0, len(rep), 4000):
            s = slice(lo, lo + 4000)
            yield pd.DataFrame(
                {
                    "cell": cell[rep[s]] + base,
                    "block": block[s],
                    "deal": ids[s] // 100 % query_blocks if query_blocks > 1 else np.zeros(len(ids[s]), np.int64),
                    "query_id": ids[s],
                    "q": [x[i] for i in q[rep[s]]],
                    "home": home[q[rep[s]]],
                }
            )

    dealt = "cell long, block long, deal long, query_id long, q array<double>, home long"

    def to_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = matrix(part["x"])
                base, sizes, mid, _ = bounds(x, dim)
                best = np.argmax(np.where(sizes[None, :] > 0, mid, -np.inf), axis=1)
                yield from emit(part, x, np.arange(len(sizes))[None, :] == best[:, None], base, sizes, best + base)

    def to_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = matrix(part["x"])
                base, sizes, _, upper = bounds(x, dim)
                home = part["home"].to_numpy()
                wanted = (upper >= part["least"].to_numpy()[:, None]) & (np.arange(len(sizes))[None, :] + base != home[:, None])
                yield from emit(part, x, wanted, base, sizes, home)

    spread = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30))
    counts = F.broadcast(spark.createDataFrame([(r["cell"], math.ceil(r["n"] / DATA_BLOCK)) for r in summaries] or [(0, 1)], "cell long, blocks long"))
    data = (
        rows.join(counts, "cell")
        .select("cell", (spread % F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("deal"), "vec_id", "x")
    )

    def solve(asked: DataFrame) -> DataFrame:
        def local(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(d):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            return top(q["query_id"].to_numpy(), matrix(q["q"]), d["vec_id"].to_numpy(), matrix(d["x"]), k)

        keys = ["cell", "block", "deal"]
        return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(local, MATCHES)

    homes = saved(queries.mapInPandas(to_home, dealt), "knn-homes")
    near = saved(solve(homes), "knn-near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    at_home = homes.select(F.col("query_id").alias("vec_id"), "home").distinct()
    again = queries.join(at_home, "vec_id").join(least, "vec_id", "left").withColumn(
        "least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
    )
    far = solve(again.mapInPandas(to_rest, dealt))
    return near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
