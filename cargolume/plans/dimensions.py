"""Dimensions of both model lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.contract import REGIONS
from cargolume.functions.exprs import key_of


def dim_members(stg: DataFrame, id_column: str, key_column: str) -> DataFrame:
    """id -> surrogate key, first and last sighting, event count.

    The surrogate key is hashed after grouping: once per member and not once per event.
    """
    return (
        stg.filter(F.col(id_column).isNotNull())
        .groupBy(id_column)
        .agg(
            F.min("event_ts").alias("first_seen_at"),
            F.max("event_ts").alias("last_seen_at"),
            F.count("*").alias("source_event_count"),
        )
        .select(
            key_of(id_column).alias(key_column),
            id_column,
            "first_seen_at",
            "last_seen_at",
            "source_event_count",
        )
    )


def dim_customers(stg: DataFrame) -> DataFrame:
    return dim_members(stg, "customer_id", "customer_key")


def dim_products(stg: DataFrame) -> DataFrame:
    return dim_members(stg, "product_id", "product_key")


def dim_regions(spark: SparkSession) -> DataFrame:
    """The contract's regions; a constant relation of four rows."""
    listed = spark.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region_code")
    )
    return listed.select(key_of("region_code").alias("region_key"), "region_code")


def observed_members(stg: DataFrame, id_column: str) -> DataFrame:
    """Classifier line: id -> sightings, events and distinct orders.

    Grouping by (id, order) first lets map-side aggregation absorb a hot member; the
    second grouping then only counts non-null orders.
    """
    per_order = (
        stg.filter(F.col(id_column).isNotNull())
        .groupBy(id_column, "order_id")
        .agg(
            F.min("event_timestamp").alias("first_at"),
            F.max("event_timestamp").alias("last_at"),
            F.count("*").alias("events"),
        )
    )
    return per_order.groupBy(id_column).agg(
        F.min("first_at").alias("first_seen_at"),
        F.max("last_at").alias("last_seen_at"),
        F.sum("events").alias("observed_event_count"),
        F.count("order_id").alias("observed_order_count"),
    )


def observed_regions(stg: DataFrame) -> DataFrame:
    per_customer = stg.groupBy("region", "customer_id").agg(
        F.min("event_timestamp").alias("first_at"),
        F.max("event_timestamp").alias("last_at"),
        F.count("*").alias("events"),
    )
    return per_customer.groupBy("region").agg(
        F.min("first_at").alias("first_seen_at"),
        F.max("last_at").alias("last_seen_at"),
        F.sum("events").alias("observed_event_count"),
        F.count("customer_id").alias("observed_customer_count"),
    )
