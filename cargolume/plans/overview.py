"""Read-side rollups over the hourly marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume.functions.exprs import seconds_between

FRESH_MINUTES = 30
MATURITY_HOURS = 24


def _recent(mart: DataFrame, now: Column, hours: int) -> DataFrame:
    """Last hours of a mart; the bound is on the raw column, so it is pushed to the scan."""
    return mart.filter(F.col("metric_hour") >= now - F.make_dt_interval(hours=F.lit(hours)))


def _totals(*names: str):
    return [F.sum(name).alias(name) for name in names]


def _amount(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("double").alias(name)


def revenue(mart: DataFrame, now: Column, hours: int) -> DataFrame:
    return _recent(mart, now, hours).groupBy("metric_hour").agg(
        *_totals("successful_payment_count"), _amount("successful_revenue")
    )


def payments(mart: DataFrame, now: Column, hours: int) -> DataFrame:
    """The rate is recomputed from the summed counts; zero when nothing was attempted."""
    totals = _recent(mart, now, hours).groupBy("metric_hour").agg(
        *_totals("payment_attempt_count", "failed_payment_count")
    )
    share = F.col("failed_payment_count").cast("double") / F.nullif(
        "payment_attempt_count", F.lit(0)
    )
    return totals.withColumn("payment_failure_rate", F.coalesce(share, F.lit(0.0)))


def shipments(mart: DataFrame, now: Column, hours: int) -> DataFrame:
    return _recent(mart, now, hours).groupBy("metric_hour").agg(
        *_totals("shipment_created_count", "shipment_delay_signal_count")
    )


def refunds(mart: DataFrame, now: Column, hours: int) -> DataFrame:
    return _recent(mart, now, hours).groupBy("metric_hour").agg(
        *_totals("refund_request_count"), _amount("requested_refund_amount")
    )


def operations(mart: DataFrame, now: Column, hours: int) -> DataFrame:
    """Latency is the unweighted mean of the regions' means."""
    return _recent(mart, now, hours).groupBy("metric_hour").agg(
        *_totals("event_count"),
        F.avg("average_processing_latency_ms").alias("average_processing_latency_ms"),
        F.max("warehouse_updated_at").alias("warehouse_updated_at"),
    )


def quality(mart: DataFrame, now: Column, hours: int) -> DataFrame:
    return _recent(mart, now, hours).groupBy("metric_hour").agg(
        *_totals("orphan_payment_attempt_count", "orphan_shipment_event_count")
    )


ROLLUPS = {
    "revenue": revenue,
    "payments": payments,
    "shipments": shipments,
    "refunds": refunds,
    "operations": operations,
    "quality": quality,
}


def freshness(mart: DataFrame, now: Column) -> DataFrame:
    """fresh / stale / empty by the newest warehouse update."""
    newest = mart.agg(F.max("warehouse_updated_at").alias("warehouse_updated_at"))
    minutes = seconds_between(now, "warehouse_updated_at") / 60
    return newest.select(
        F.when(F.col("warehouse_updated_at").isNull(), "empty")
        .when(minutes <= FRESH_MINUTES, "fresh")
        .otherwise("stale")
        .alias("status"),
        "warehouse_updated_at",
        F.round(minutes, 2).alias("minutes_since_update"),
    )


def with_cohort_maturity(shipments: DataFrame, hour: str, now: Column) -> DataFrame:
    """A creation cohort is mature once its delays had a day to arrive."""
    mature = F.col(hour) <= now - F.make_dt_interval(hours=F.lit(MATURITY_HOURS))
    return shipments.withColumn("cohort_mature", mature)


def dashboard_totals(revenue: DataFrame, payments: DataFrame, shipments: DataFrame) -> DataFrame:
    """Headline sums; delays only over mature cohorts. Three one-row aggregates side by side."""
    parts = [
        revenue.agg(F.sum("revenue_amount").alias("revenue")),
        payments.agg(
            F.sum("payment_attempt_count").alias("payments"),
            F.sum("failed_payment_count").alias("failed"),
        ),
        shipments.agg(
            F.sum("shipment_created_count").alias("shipments"),
            F.sum(F.when(F.col("cohort_mature"), F.col("delayed_shipment_count"))).alias("delayed"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(
        *[F.max(c).alias(c) for c in ("revenue", "payments", "failed", "shipments", "delayed")]
    )
