"""Catalogue of named queries: a Spark plan plus, where SQL can say it, the SQL to check it with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pantrylens.plans.ctes import CTES
from pantrylens.session import pin_utc, use_order
from pantrylens.sources.bindings import Bound

Plan = Callable[[Bound], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the shared definitions it mentions, dependencies first."""
    library = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in library and word not in ordered:
                visit(library[word].replace(word, ""))
                if word not in ordered:
                    ordered.append(word)

    visit(body)
    if not ordered:
        return body
    recursive = any(re.search(rf"\b{n}\b", library[n]) for n in ordered)
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(f"{n} AS ({library[n].strip()})" for n in ordered) + "\n" + body.strip()


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register a plan under ``name``; ``sql`` may use the shared CTE names."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            use_order(spark)
            return plan(Bound(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, ctes)
        return plan

    return register
