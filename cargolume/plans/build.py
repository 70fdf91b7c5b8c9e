"""The whole model build, lazily or onto storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cargolume.plans import dimensions, facts, marts, staging


@dataclass(frozen=True)
class Models:
    """Every model of the warehouse line by name."""

    frames: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


def lazy_models(stg: DataFrame) -> Models:
    orders = facts.fct_orders(stg)
    payments = facts.fct_payment_attempts(stg)
    refunds = facts.fct_refund_requests(stg)
    hourly = {
        "orders_hourly": marts.orders_hourly(orders),
        "mart_revenue_hourly": marts.mart_revenue_hourly(payments),
        "mart_payment_health_hourly": marts.mart_payment_health_hourly(payments),
        "mart_shipment_health_hourly": marts.mart_shipment_health_hourly(
            facts.shipment_cohorts(stg)
        ),
        "mart_refunds_hourly": marts.mart_refunds_hourly(refunds),
    }
    return Models(
        {
            "stg_stream_events": stg,
            "dim_customers": dimensions.dim_customers(stg),
            "dim_products": dimensions.dim_products(stg),
            "dim_regions": dimensions.dim_regions(stg.sparkSession),
            "fct_orders": orders,
            "fct_payment_attempts": payments,
            "fct_refund_requests": refunds,
            "fct_shipments": facts.fct_shipments(stg),
            **hourly,
            "mart_operations_health_hourly": marts.mart_operations_health_hourly(
                *hourly.values()
            ),
        }
    )


def build_models(events: DataFrame, root: str) -> Models:
    """Freeze staging, write the five marts, and return readers plus lazy facts.

    Hourly inputs are written once and reread by the operations mart, so no fact is
    scanned twice for it.
    """
    spark = events.sparkSession
    stg = staging.freeze(events, f"{root}/stg_stream_events")
    lazy = lazy_models(stg)
    written = {}
    names = (
        "orders_hourly",
        "mart_revenue_hourly",
        "mart_payment_health_hourly",
        "mart_shipment_health_hourly",
        "mart_refunds_hourly",
    )
    for name in names:
        lazy[name].write.mode("overwrite").parquet(f"{root}/{name}")
        written[name] = spark.read.parquet(f"{root}/{name}")
    operations = marts.mart_operations_health_hourly(*[written[n] for n in names])
    operations.write.mode("overwrite").parquet(f"{root}/mart_operations_health_hourly")
    written["mart_operations_health_hourly"] = spark.read.parquet(
        f"{root}/mart_operations_health_hourly"
    )
    return Models({**lazy.frames, **written})
