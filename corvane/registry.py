"""Queries and their SQL, by name; the catalogue's modules fill them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql gives the same rows over the same tables, where SQL can express them."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, label, s) of the embeddings table."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
