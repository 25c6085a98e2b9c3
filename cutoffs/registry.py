"""All registered queries of the library with their SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
PLANS = ("members", "graph", "networks", "series", "spatial", "rasters", "rainfall", "text", "serving", "sets", "streams", "build")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the driver tables that it names, without registering views."""
    named = {n: table(spark, sf_dir, n) for n in TABLES if re.search(rf"\b{n}\b", text)}
    text = text.replace("{", "{{").replace("}", "}}")
    for n in named:
        text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}} AS {n}", text)
    return spark.sql(text, **named)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows in another engine."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _load() -> None:
    for p in PLANS:
        importlib.import_module(f"cutoffs.plans.{p}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["G4_isolation_times"](spark, sf_dir)
