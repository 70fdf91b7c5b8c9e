"""Typed staging views and the frozen per-build snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.contract import EVENT_SCHEMA
from cargolume.functions.exprs import utc_hour


def stg_events(events: DataFrame) -> DataFrame:
    """The 19 event columns with their declared types."""
    return events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])


def stg_processed_events(events: DataFrame) -> DataFrame:
    """Classifier-line staging: every event with its UTC hour."""
    return events.select("*", utc_hour("event_timestamp").alias("event_hour"))


def stg_minute_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        F.col("window_start").cast("timestamp"),
        F.col("window_end").cast("timestamp"),
        F.col("event_type").cast("string"),
        F.col("event_count").cast("bigint"),
        F.col("total_amount").cast("decimal(24,2)"),
        F.col("updated_at").cast("timestamp"),
    )


def freeze(events: DataFrame, path: str) -> DataFrame:
    """Write one committed snapshot and return a reader over it.

    Partitioned by event_type, so each fact reads only its own files; being a written
    table it also cuts lineage, and a lost executor costs a re-read and not a rebuild.
    """
    stg_events(events).write.mode("overwrite").partitionBy("event_type").parquet(path)
    return read_frozen(events.sparkSession, path)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path).select(*EVENT_SCHEMA.names)
