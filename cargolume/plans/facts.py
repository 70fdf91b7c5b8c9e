"""Facts of both model lines. Each reads only its own event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolume.contract import PAYMENT_TYPES, SHIPMENT_TYPES
from cargolume.functions.exprs import key_of

_TAIL = [
    "metadata",
    "source_topic",
    "source_partition",
    "source_offset",
    "source_timestamp",
    "ingested_at",
]


def _keys() -> list[Column]:
    return [
        key_of("customer_id").alias("customer_key"),
        key_of("product_id").alias("product_key"),
        key_of("region").alias("region_key"),
        F.col("customer_id"),
        F.col("product_id"),
        F.col("region").alias("region_code"),
    ]


def fct_orders(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("event_type") == "order_created").select(
        key_of("event_id").alias("order_event_key"),
        F.col("event_id").alias("source_event_id"),
        F.col("event_ts").alias("order_created_at"),
        "order_id",
        *_keys(),
        F.col("amount").alias("order_amount"),
        "currency",
        "status",
        *_TAIL,
    )


def fct_payment_attempts(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("event_type").isin(*PAYMENT_TYPES)).select(
        key_of("event_id").alias("payment_attempt_key"),
        F.col("event_id").alias("source_event_id"),
        "event_type",
        F.col("event_ts").alias("payment_event_ts"),
        "order_id",
        *_keys(),
        F.col("amount").alias("payment_amount"),
        "currency",
        "payment_provider",
        "status",
        (F.col("event_type") == "payment_processed").alias("payment_succeeded"),
        *_TAIL,
    )


def fct_refund_requests(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("event_type") == "refund_requested").select(
        key_of("event_id").alias("refund_request_key"),
        F.col("event_id").alias("source_event_id"),
        F.col("event_ts").alias("refund_requested_at"),
        "order_id",
        *_keys(),
        F.col("amount").alias("requested_amount"),
        "currency",
        "status",
        *_TAIL,
    )


def delay_links(stg: DataFrame) -> DataFrame:
    """One row per delay signal: the unbounded form of an order's delay ids."""
    return stg.filter(F.col("event_type") == "shipment_delayed").select(
        "order_id",
        F.col("event_ts").alias("delayed_at"),
        F.col("event_id").alias("delay_event_id"),
    )


def shipment_delay_counts(stg: DataFrame) -> DataFrame:
    """order -> delay count, first and last delay. Combines map-side, whatever the skew."""
    return (
        delay_links(stg)
        .groupBy("order_id")
        .agg(
            F.count("*").alias("delay_event_count"),
            F.min("delayed_at").alias("first_delayed_at"),
            F.max("delayed_at").alias("last_delayed_at"),
        )
    )


def shipment_delays_by_order(stg: DataFrame) -> DataFrame:
    """order -> delay count, first and last delay, first id. Every id stands in `shipment_delay_ids`."""
    earliest = F.min(F.struct("delayed_at", "delay_event_id"))
    return (
        delay_links(stg)
        .groupBy("order_id")
        .agg(
            F.count("*").alias("delay_event_count"),
            F.min("delayed_at").alias("first_delayed_at"),
            F.max("delayed_at").alias("last_delayed_at"),
            earliest["delay_event_id"].alias("first_delay_source_event_id"),
        )
    )


def shipment_delay_ids(stg: DataFrame) -> DataFrame:
    """Every delay id of an order with its place in (time, id) order: one row each, no lists."""
    place = Window.partitionBy("order_id").orderBy("delayed_at", "delay_event_id")
    return delay_links(stg).select(
        "order_id",
        F.row_number().over(place).cast("bigint").alias("ordinal"),
        "delayed_at",
        F.col("delay_event_id").alias("delay_source_event_id"),
    )


def fct_shipments(stg: DataFrame, delays: DataFrame | None = None) -> DataFrame:
    """Creations with their order's delays; the creation side keeps every row.

    The delay side is unique per order, so a hot order on the creation side can be split
    by adaptive skew handling.
    """
    created = stg.filter(F.col("event_type") == "shipment_created")
    late = shipment_delays_by_order(stg) if delays is None else delays
    count = F.coalesce(F.col("delay_event_count"), F.lit(0).cast("bigint"))
    return created.join(late, "order_id", "left").select(
        key_of("event_id").alias("shipment_key"),
        F.col("event_id").alias("source_event_id"),
        F.col("event_ts").alias("shipment_created_at"),
        "order_id",
        *_keys(),
        "shipment_provider",
        "status",
        count.alias("delay_event_count"),
        (count > 0).alias("was_delayed"),
        "first_delayed_at",
        "last_delayed_at",
        "first_delay_source_event_id",
        *_TAIL,
    )


def shipment_cohorts(stg: DataFrame) -> DataFrame:
    """Creations with their delay count only: all the hourly mart needs, no lists."""
    created = stg.filter(F.col("event_type") == "shipment_created").select(
        "order_id",
        F.col("event_ts").alias("shipment_created_at"),
        F.col("region").alias("region_code"),
    )
    counts = shipment_delay_counts(stg).select("order_id", "delay_event_count")
    count = F.coalesce(F.col("delay_event_count"), F.lit(0).cast("bigint"))
    return created.join(counts, "order_id", "left").select(
        "shipment_created_at",
        key_of("region_code").alias("region_key"),
        "region_code",
        count.alias("delay_event_count"),
        (count > 0).alias("was_delayed"),
    )


# Classifier line: plain projections of the processed log.


def _party() -> list[str]:
    return ["order_id", "customer_id", "product_id", "region"]


def fct_orders_a(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("event_type") == "order_created").select(
        F.col("event_id").alias("order_event_id"),
        *_party(),
        F.col("event_timestamp").alias("ordered_at"),
        F.col("amount").alias("order_amount"),
        "currency",
        "processing_latency_ms",
    )


def fct_payment_attempts_a(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("event_type").isin(*PAYMENT_TYPES)).select(
        F.col("event_id").alias("payment_event_id"),
        *_party(),
        F.col("event_timestamp").alias("attempted_at"),
        "amount",
        "currency",
        "payment_provider",
        (F.col("event_type") == "payment_processed").alias("is_successful"),
        "processing_latency_ms",
    )


def fct_refund_requests_a(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("event_type") == "refund_requested").select(
        F.col("event_id").alias("refund_event_id"),
        *_party(),
        F.col("event_timestamp").alias("requested_at"),
        "amount",
        "currency",
        "processing_latency_ms",
    )


def fct_shipments_a(stg: DataFrame) -> DataFrame:
    """One row per creation or delay signal."""
    kind = F.col("event_type")
    return stg.filter(kind.isin(*SHIPMENT_TYPES)).select(
        F.col("event_id").alias("shipment_event_id"),
        *_party(),
        F.col("event_timestamp").alias("occurred_at"),
        "shipment_provider",
        (kind == "shipment_created").alias("is_created"),
        (kind == "shipment_delayed").alias("is_delay_signal"),
        "processing_latency_ms",
    )
