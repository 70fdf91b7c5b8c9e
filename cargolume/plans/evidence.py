"""Evidence rows behind the hourly marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolume.contract import PAYMENT_TYPES
from cargolume.plans.facts import delay_links

COLUMNS = ("source_event_id", "evidence_kind", "event_ts", "evaluation_ts", "region_code")


def shipment_delay_evidence(stg: DataFrame) -> DataFrame:
    """Each delay signal under the creation it belongs to; judged at creation time.

    Joined from the one-row-per-signal links, so no id list is built or unpacked.
    """
    created = stg.filter(F.col("event_type") == "shipment_created").select(
        "order_id", F.col("event_ts").alias("evaluation_ts"), F.col("region").alias("region_code")
    )
    return delay_links(stg).join(created, "order_id").select(
        F.col("delay_event_id").alias("source_event_id"),
        F.lit("shipment_delay").alias("evidence_kind"),
        F.col("delayed_at").alias("event_ts"),
        "evaluation_ts",
        "region_code",
    )


def analytics_evidence(stg: DataFrame) -> DataFrame:
    """Union of the five evidence kinds. Four come from one narrow pass over the events."""
    kind = (
        F.when(F.col("event_type").isin(*PAYMENT_TYPES), "payment_attempt")
        .when(F.col("event_type") == "shipment_created", "shipment_cohort")
        .when(F.col("event_type") == "refund_requested", "refund_request")
        .when(F.col("event_type") == "order_created", "order")
    )
    direct = stg.filter(
        F.col("event_type").isin(
            *PAYMENT_TYPES, "shipment_created", "refund_requested", "order_created"
        )
    ).select(
        F.col("event_id").alias("source_event_id"),
        kind.alias("evidence_kind"),
        "event_ts",
        F.col("event_ts").alias("evaluation_ts"),
        F.col("region").alias("region_code"),
    )
    return reduce(DataFrame.unionByName, [direct, shipment_delay_evidence(stg)])
