"""Runs registered queries on Spark and their SQL on DuckDB and compares the two results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_cell(x) for x in v])
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name, df, sql, con):
    """None when equal, else a short description of the first difference."""
    spark_types = dict(df.dtypes)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    want = rel.fetchall()
    if sorted(spark_types) != sorted(want_types):
        return f"columns {sorted(spark_types)} vs {sorted(want_types)}"
    bad = {
        c: (t, want_types[c])
        for c, t in spark_types.items()
        if SPARK_TO_DUCK.get(t, t) != want_types[c] and not t.startswith("array")
    }
    if bad:
        return f"types {bad}"
    a, b = rows_of(list(df.columns), got), rows_of(list(rel.columns), want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if not a:
        return "EMPTY on both sides"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        cols = sorted(df.columns)
        x, y = diff[0]
        where = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"{len(diff)} of {len(a)} rows differ; first: {where[:3]} in {x}"
    return None


def main(argv):
    from pantrylens.plans import load_all
    from pantrylens.session import build_session

    sf = argv[0] if argv else "0.001"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load_all()
    names = [n for n in queries if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    if wanted and wanted[0].startswith("@"):
        from pantrylens.plans import group_names

        names = [n for g in wanted for n in group_names(g[1:])]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    fails = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in oracles:
                msg = compare(n, df, oracles[n], con)
            else:
                c = df.count()
                msg = None if c else "EMPTY"
        except Exception as e:  # report and go on to the next query
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        dt = time.time() - t
        if msg:
            fails += 1
            print(f"FAIL {n} ({dt:.1f}s): {msg}", flush=True)
        elif dt > 5:
            print(f"slow {n} {dt:.1f}s", flush=True)
    print(f"{len(names) - fails}/{len(names)} ok at sf{sf}; {sum(n in oracles for n in names)} with SQL")


if __name__ == "__main__":
    main(sys.argv[1:])
