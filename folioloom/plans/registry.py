"""Registering a query with its SQL, and reading tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
Registry = dict[str, tuple[Query, str | None]]


def registrar(into: Registry):
    def query(name: str, sql: str | None = None):
        def add(f: Query) -> Query:
            into[name] = (f, sql)
            return f

        return add

    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where a scan has fewer tasks than that: before heavy work on a table of few files."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
