"""Registry of queries, and inputs that Spark and DuckDB derive by the same SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

TABLES = ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


class Registry(dict[str, Query]):
    def add(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        def register(build: Build) -> Build:
            self[name] = Query(build, sql)
            return build

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL text in which driver tables stand as ``{name}``."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    return spark.sql(text, **used)


def oracle(text: str) -> str:
    """The same text for DuckDB, where the tables are views."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def quote_all(values) -> str:
    return ", ".join("'" + v + "'" for v in values)
