"""Minute metrics of both lines and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume.contract import PAYMENT_TYPES
from cargolume.functions.exprs import count_where, sum_where, utc_minute

#: What `minute_metrics_a` reads of an event.
MINUTE_COLUMNS_A = ("event_timestamp", "region", "event_type", "amount", "processing_latency_ms", "processed_at")


def minute_metrics_a(events: DataFrame) -> DataFrame:
    """One-minute tumbling window x region. Rate is 0.0 when nothing was attempted."""
    kind = F.col("event_type")
    grouped = events.groupBy(F.window("event_timestamp", "1 minute").alias("w"), "region").agg(
        F.count("*").alias("event_count"),
        count_where(kind == "order_created").alias("order_count"),
        count_where(kind == "payment_processed").alias("successful_payment_count"),
        count_where(kind == "payment_failed").alias("failed_payment_count"),
        count_where(kind.isin(*PAYMENT_TYPES)).alias("payment_attempt_count"),
        F.coalesce(sum_where(kind == "payment_processed", "amount"), F.lit(0))
        .cast("decimal(18,2)")
        .alias("successful_revenue"),
        count_where(kind == "shipment_created").alias("shipment_created_count"),
        count_where(kind == "shipment_delayed").alias("shipment_delayed_count"),
        count_where(kind == "refund_requested").alias("refund_request_count"),
        F.avg("processing_latency_ms").alias("avg_processing_latency_ms"),
        F.max("processed_at").alias("updated_at"),
    )
    share = F.col("failed_payment_count").cast("double") / F.nullif(
        "payment_attempt_count", F.lit(0)
    )
    return grouped.select(
        F.col("w.start").alias("minute_start"),
        F.col("w.end").alias("minute_end"),
        *[c for c in grouped.columns if c != "w"],
        F.coalesce(share, F.lit(0.0)).alias("payment_failure_rate"),
    )


def minute_totals(events: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Minute x event type -> count and amount."""
    stamp = F.max("ingested_at") if updated_at is None else F.max(updated_at)
    return (
        events.groupBy(utc_minute("event_ts").alias("window_start"), "event_type")
        .agg(
            F.count("*").alias("event_count"),
            F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(24,2)").alias("total_amount"),
            stamp.alias("updated_at"),
        )
        .select(
            "window_start",
            (F.col("window_start") + F.make_dt_interval(mins=F.lit(1))).alias("window_end"),
            "event_type",
            "event_count",
            "total_amount",
            "updated_at",
        )
    )


def reconcile_minute_metrics(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Minutes whose stored totals differ from the totals recomputed from events."""
    keys = ["window_start", "event_type"]
    fresh = minute_totals(events).select(
        *keys,
        F.col("event_count").alias("expected_count"),
        F.col("total_amount").alias("expected_amount"),
    )
    kept = stored.select(
        *keys,
        F.col("event_count").alias("stored_count"),
        F.col("total_amount").alias("stored_amount"),
    )
    return fresh.join(kept, keys, "full").filter(
        ~F.col("expected_count").eqNullSafe(F.col("stored_count"))
        | ~F.col("expected_amount").eqNullSafe(F.col("stored_amount"))
    )
