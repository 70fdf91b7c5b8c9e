"""Data-quality checks. A check returns the violating rows, or one row of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume.contract import SOURCE_KEY, STATUS_OF_TYPE
from cargolume.functions.exprs import count_where, seconds_between

PASSING = ("pass", "success")
TOLERATED = (*PASSING, "warn")


def check_unique(frame: DataFrame, *columns: str) -> DataFrame:
    """Column combinations that occur more than once; combines map-side."""
    return (
        frame.groupBy(*columns).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")
    )


def check_columns(
    frame: DataFrame,
    not_null: tuple[str, ...] = (),
    accepted: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One pass over the frame: (check, column, violations) for all column checks."""
    tests: list[tuple[str, str, Column]] = [
        ("not_null", name, F.col(name).isNull()) for name in not_null
    ]
    tests += [
        ("accepted_values", name, ~F.col(name).isin(*values))
        for name, values in (accepted or {}).items()
    ]
    counted = frame.agg(*[count_where(test).alias(f"c{i}") for i, (_, _, test) in enumerate(tests)])
    rows = F.array(
        *[
            F.struct(
                F.lit(check).alias("check"),
                F.lit(name).alias("column_name"),
                F.col(f"c{i}").alias("violations"),
            )
            for i, (check, name, _) in enumerate(tests)
        ]
    )
    return counted.select(F.inline(rows))


def check_relationships(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-null child keys without a parent, with the number of child rows.

    Children are counted per key first, so a hot key crosses the network as one row.
    """
    keys = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return keys.join(known, key, "left_anti")


def check_lineage_unique(stg: DataFrame) -> DataFrame:
    return check_unique(stg, *SOURCE_KEY).withColumnRenamed("occurrences", "duplicate_count")


def check_status_matches_type(stg: DataFrame) -> DataFrame:
    """Status disagrees with the type; NULL passes, as in SQL."""
    legal = F.create_map(*[F.lit(x) for pair in STATUS_OF_TYPE.items() for x in pair])
    return stg.filter(F.col("status") != legal[F.col("event_type")]).select(
        "event_id", "event_type", "status"
    )


def check_payment_status(payments: DataFrame) -> DataFrame:
    kind, status, ok = (F.col(c) for c in ("event_type", "status", "payment_succeeded"))
    return payments.filter(
        ((kind == "payment_processed") & ((status != "paid") | ~ok))
        | ((kind == "payment_failed") & ((status != "failed") | ok))
    ).select("source_event_id", "event_type", "status", "payment_succeeded")


def check_amounts_nonnegative(orders: DataFrame, payments: DataFrame, refunds: DataFrame) -> DataFrame:
    parts = [
        frame.filter(F.col(amount) < 0).select(
            F.lit(name).alias("fact_name"), "source_event_id", F.col(amount).alias("amount")
        )
        for name, frame, amount in (
            ("orders", orders, "order_amount"),
            ("payment_attempts", payments, "payment_amount"),
            ("refund_requests", refunds, "requested_amount"),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


def check_rates_bounded(payments: DataFrame, shipments: DataFrame, operations: DataFrame) -> DataFrame:
    parts = [
        frame.filter(~F.col(rate).between(0, 1)).select(
            F.lit(name).alias("model_name"), F.col(rate).alias("rate")
        )
        for name, frame, rate in (
            ("payment_health", payments, "failure_rate"),
            ("shipment_health", shipments, "delayed_shipment_rate"),
            ("operations_payment", operations, "payment_failure_rate"),
            ("operations_shipment", operations, "delayed_shipment_rate"),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


def check_minute_windows(metrics: DataFrame) -> DataFrame:
    minute = F.col("window_start") + F.make_dt_interval(mins=F.lit(1))
    return metrics.filter(
        (F.col("window_end") != minute) | (F.col("event_count") < 0) | (F.col("total_amount") < 0)
    )


def check_single_shipment_per_order(stg: DataFrame) -> DataFrame:
    created = stg.filter(F.col("event_type") == "shipment_created")
    return check_unique(created, "order_id").withColumnRenamed("occurrences", "creation_count")


def check_counts_reconcile(operations: DataFrame) -> DataFrame:
    return operations.filter(
        (F.col("event_count") < F.col("order_count"))
        | (F.col("event_count") < F.col("payment_attempt_count"))
        | (F.col("failed_payment_count") > F.col("payment_attempt_count"))
    )


def check_failure_rate(payments: DataFrame) -> DataFrame:
    return payments.filter((F.col("payment_failure_rate") < 0) | (F.col("payment_failure_rate") > 1))


def check_revenue_nonnegative(revenue: DataFrame) -> DataFrame:
    return revenue.filter(F.col("successful_revenue") < 0)


def source_freshness(
    frame: DataFrame, column: str, now: Column, warn_minutes: int = 30, error_hours: int = 24
) -> DataFrame:
    newest = frame.agg(F.max(column).alias("newest"))
    age = seconds_between(now, "newest")
    return newest.select(
        "newest",
        age.alias("age_seconds"),
        F.when(F.col("newest").isNull() | (age > error_hours * 3600), "error")
        .when(age > warn_minutes * 60, "warn")
        .otherwise("pass")
        .alias("status"),
    )


def quality_summary(results: DataFrame) -> DataFrame:
    """Results per status, and whether the status counts as failed."""
    status = F.coalesce("status", F.lit("unknown"))
    return (
        results.groupBy(status.alias("status"))
        .agg(F.count("*").alias("results"))
        .withColumn("failed", ~F.col("status").isin(*PASSING))
    )


def require_verified(results: DataFrame) -> None:
    """Gate: at least one result, and every one passing. Fails closed."""
    counts = results.agg(
        F.count("*").alias("results"),
        count_where(~F.coalesce(F.col("status").isin(*PASSING), F.lit(False))).alias("failed"),
    ).first()
    if counts["results"] == 0:
        raise ValueError("no check results")
    if counts["failed"]:
        raise ValueError(f"{counts['failed']} check results are not passing")
