"""JDBC reader and appender with pushed-down queries and partitioned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, query: str, split: tuple[str, int, int, int] | None = None, **extra: str):
    """Options of a sub-query read; `split` = (column, low, high, partitions) parallelises it."""
    options = {"url": url, "dbtable": f"({query}) pushed", **extra}
    if split:
        column, low, high, partitions = split
        options |= {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc_query(spark: SparkSession, url: str, query: str, split=None, **extra: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, split, **extra)).load()


def jdbc_append(frame: DataFrame, url: str, table: str, **extra: str) -> None:
    frame.write.format("jdbc").options(url=url, dbtable=table, **extra).mode("append").save()
