"""Hourly marts. Groups are (UTC hour, region), so partial aggregation leaves at most
hours x regions rows per task to shuffle, whatever the size or skew of the facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume.contract import PAYMENT_TYPES, SHIPMENT_TYPES
from cargolume.functions.exprs import count_where, money, rate, sum_where, utc_hour


def _zero_if_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


# ---- warehouse line -------------------------------------------------------------------


def mart_revenue_hourly(payments: DataFrame) -> DataFrame:
    return (
        payments.filter("payment_succeeded")
        .groupBy(
            utc_hour("payment_event_ts").alias("revenue_hour_utc"), "region_key", "region_code"
        )
        .agg(
            F.count("*").alias("successful_payment_count"),
            money(F.sum("payment_amount")).alias("revenue_amount"),
        )
    )


def mart_payment_health_hourly(payments: DataFrame) -> DataFrame:
    ok = F.col("payment_succeeded")
    amount = F.col("payment_amount")
    grouped = payments.groupBy(
        utc_hour("payment_event_ts").alias("payment_hour_utc"), "region_key", "region_code"
    ).agg(
        F.count("*").alias("payment_attempt_count"),
        count_where(ok).alias("successful_payment_count"),
        count_where(~ok).alias("failed_payment_count"),
        money(F.sum(amount)).alias("attempted_amount"),
        money(_zero_if_null(sum_where(ok, amount))).alias("successful_payment_amount"),
        money(_zero_if_null(sum_where(~ok, amount))).alias("failed_payment_amount"),
    )
    return grouped.withColumn(
        "failure_rate", rate(F.col("failed_payment_count"), F.col("payment_attempt_count"))
    )


def mart_shipment_health_hourly(cohorts: DataFrame) -> DataFrame:
    """By hour of creation; delays count towards the cohort they belong to."""
    late = F.col("was_delayed")
    grouped = cohorts.groupBy(
        utc_hour("shipment_created_at").alias("shipment_creation_hour_utc"),
        "region_key",
        "region_code",
    ).agg(
        F.count("*").alias("shipment_created_count"),
        count_where(late).alias("delayed_shipment_count"),
        F.sum("delay_event_count").alias("shipment_delay_event_count"),
    )
    return grouped.withColumn(
        "delayed_shipment_rate",
        rate(F.col("delayed_shipment_count"), F.col("shipment_created_count")),
    )


def mart_refunds_hourly(refunds: DataFrame) -> DataFrame:
    return refunds.groupBy(
        utc_hour("refund_requested_at").alias("refund_request_hour_utc"),
        "region_key",
        "region_code",
    ).agg(
        F.count("*").alias("refund_request_count"),
        money(F.sum("requested_amount")).alias("requested_amount"),
    )


def orders_hourly(orders: DataFrame) -> DataFrame:
    return orders.groupBy(
        utc_hour("order_created_at").alias("metric_hour_utc"), "region_key", "region_code"
    ).agg(F.count("*").alias("order_count"))


def operations_grain(
    orders: DataFrame,
    revenue: DataFrame,
    payments: DataFrame,
    shipments: DataFrame,
    refunds: DataFrame,
) -> DataFrame:
    """Distinct (hour, region) over the five hourly inputs."""
    grains = [
        frame.select(F.col(hour).alias("metric_hour_utc"), "region_key", "region_code")
        for frame, hour in (
            (orders, "metric_hour_utc"),
            (revenue, "revenue_hour_utc"),
            (payments, "payment_hour_utc"),
            (shipments, "shipment_creation_hour_utc"),
            (refunds, "refund_request_hour_utc"),
        )
    ]
    return reduce(DataFrame.unionByName, grains).distinct()


def mart_operations_health_hourly(
    orders: DataFrame,
    revenue: DataFrame,
    payments: DataFrame,
    shipments: DataFrame,
    refunds: DataFrame,
) -> DataFrame:
    """The five hourly inputs side by side.

    Each input has at most one row per (hour, region), so stacking them and taking the
    only non-null value per column equals the outer join on the grain with one shuffle.
    """
    hour = "metric_hour_utc"
    parts = [
        orders.select(hour, "region_key", "region_code", "order_count"),
        revenue.select(
            F.col("revenue_hour_utc").alias(hour),
            "region_key",
            "region_code",
            "successful_payment_count",
            "revenue_amount",
        ),
        payments.select(
            F.col("payment_hour_utc").alias(hour),
            "region_key",
            "region_code",
            "payment_attempt_count",
            "failed_payment_count",
            F.col("failure_rate").alias("payment_failure_rate"),
        ),
        shipments.select(
            F.col("shipment_creation_hour_utc").alias(hour),
            "region_key",
            "region_code",
            "shipment_created_count",
            "delayed_shipment_count",
            "shipment_delay_event_count",
            "delayed_shipment_rate",
        ),
        refunds.select(
            F.col("refund_request_hour_utc").alias(hour),
            "region_key",
            "region_code",
            "refund_request_count",
            F.col("requested_amount").alias("refund_requested_amount"),
        ),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    measures = [c for c in stacked.columns if c not in (hour, "region_key", "region_code")]
    one = stacked.groupBy(hour, "region_key", "region_code").agg(
        *[F.max(c).alias(c) for c in measures]
    )
    nullable = ("payment_failure_rate", "delayed_shipment_rate")
    amounts = ("revenue_amount", "refund_requested_amount")

    def filled(c: str) -> Column:
        if c in nullable:
            return F.col(c)
        zeroed = _zero_if_null(c)
        return (money(zeroed) if c in amounts else zeroed.cast("bigint")).alias(c)

    return one.select(
        hour,
        "region_key",
        "region_code",
        *[filled(c) for c in measures],
        rate(_zero_if_null("refund_request_count"), F.col("order_count")).alias(
            "refund_requests_per_order"
        ),
    )


# ---- classifier line ------------------------------------------------------------------


def mart_revenue_hourly_a(payments: DataFrame) -> DataFrame:
    return (
        payments.filter("is_successful")
        .groupBy(utc_hour("attempted_at").alias("metric_hour"), "region")
        .agg(
            F.count("*").alias("successful_payment_count"),
            F.sum("amount").alias("successful_revenue"),
            F.avg("amount").alias("average_successful_payment"),
        )
    )


def mart_payment_failure_hourly_a(payments: DataFrame) -> DataFrame:
    ok = F.col("is_successful")
    grouped = payments.groupBy(utc_hour("attempted_at").alias("metric_hour"), "region").agg(
        F.count("*").alias("payment_attempt_count"),
        count_where(~ok).alias("failed_payment_count"),
        count_where(ok).alias("successful_payment_count"),
    )
    return grouped.withColumn(
        "payment_failure_rate",
        F.col("failed_payment_count").cast("double")
        / F.nullif("payment_attempt_count", F.lit(0)),
    )


def mart_shipment_performance_hourly_a(shipments: DataFrame) -> DataFrame:
    """By hour of the signal, so signals per creation may exceed one."""
    grouped = shipments.groupBy(utc_hour("occurred_at").alias("metric_hour"), "region").agg(
        count_where(F.col("is_created")).alias("shipment_created_count"),
        count_where(F.col("is_delay_signal")).alias("shipment_delay_signal_count"),
    )
    return grouped.withColumn(
        "delay_signals_per_created_shipment",
        F.col("shipment_delay_signal_count").cast("double")
        / F.nullif("shipment_created_count", F.lit(0)),
    )


def mart_refunds_hourly_a(refunds: DataFrame) -> DataFrame:
    return refunds.groupBy(utc_hour("requested_at").alias("metric_hour"), "region").agg(
        F.count("*").alias("refund_request_count"),
        F.sum("amount").alias("requested_refund_amount"),
    )


def mart_operational_health_hourly_a(stg: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return stg.groupBy(F.col("event_hour").alias("metric_hour"), "region").agg(
        F.count("*").alias("event_count"),
        count_where(kind == "order_created").alias("order_count"),
        count_where(kind.isin(*PAYMENT_TYPES)).alias("payment_attempt_count"),
        count_where(kind == "payment_failed").alias("failed_payment_count"),
        _zero_if_null(sum_where(kind == "payment_processed", "amount")).alias(
            "successful_revenue"
        ),
        count_where(kind == "shipment_created").alias("shipment_created_count"),
        count_where(kind == "shipment_delayed").alias("shipment_delay_signal_count"),
        count_where(kind == "refund_requested").alias("refund_request_count"),
        F.avg("processing_latency_ms").alias("average_processing_latency_ms"),
        F.max("processed_at").alias("warehouse_updated_at"),
    )


def mart_data_quality_hourly_a(stg: DataFrame, orders: DataFrame) -> DataFrame:
    """Orphan payments and shipments per hour, with `NOT IN` null semantics.

    Candidates are pre-counted per (hour, region, family, order), so a hot order is one
    row before it meets the anti join. A NULL order id is an orphan only when there are
    no orders at all; a NULL among the orders makes every comparison unknown.
    """
    kind = F.col("event_type")
    hours = stg.groupBy(F.col("event_hour").alias("metric_hour"), "region").agg(
        F.max("processed_at").alias("measured_at")
    )
    family = F.when(kind.isin(*PAYMENT_TYPES), "payment").when(
        kind.isin(*SHIPMENT_TYPES), "shipment"
    )
    candidates = (
        stg.filter(kind.isin(*PAYMENT_TYPES, *SHIPMENT_TYPES))
        .groupBy(F.col("event_hour").alias("metric_hour"), "region", family.alias("family"), "order_id")
        .agg(F.count("*").alias("events"))
    )
    known = orders.select("order_id").distinct()
    state = orders.agg(
        F.count("*").alias("orders"), count_where(F.col("order_id").isNull()).alias("nulls")
    )
    state_of = lambda c: state.select(c).scalar()
    orphans = candidates.join(known, "order_id", "left_anti").filter(
        (state_of("orders") == 0) | (F.col("order_id").isNotNull() & (state_of("nulls") == 0))
    )
    counted = orphans.groupBy("metric_hour", "region").agg(
        _zero_if_null(sum_where(F.col("family") == "payment", "events")).alias("payments"),
        _zero_if_null(sum_where(F.col("family") == "shipment", "events")).alias("shipments"),
    )
    return hours.join(counted, ["metric_hour", "region"], "left").select(
        "metric_hour",
        "region",
        _zero_if_null("payments").alias("orphan_payment_attempt_count"),
        _zero_if_null("shipments").alias("orphan_shipment_event_count"),
        "measured_at",
    )
