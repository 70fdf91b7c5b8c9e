from decimal import Decimal

import golden
import pytest
from pyspark.sql import functions as F

from cargolume.plans import facts, marts, staging
from cargolume.plans.build import build_models, lazy_models
from cargolume.operators.merge import incremental_delete_insert, merge_new_events


@pytest.fixture(params=["UTC", "Asia/Kathmandu"])
def zoned(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def by(frame, *columns):
    epoch = [F.unix_seconds(c).alias(c) if c.endswith("_utc") else F.col(c) for c in columns]
    return sorted(tuple(r) for r in frame.select(*epoch).collect())


def at(h):
    return int(golden.hour(h).timestamp())


def test_golden_marts(zoned):
    models = lazy_models(golden.frame(zoned))
    assert by(
        models["mart_revenue_hourly"],
        "revenue_hour_utc", "region_code", "successful_payment_count", "revenue_amount",
    ) == [
        (at(10), "us-east", 1, Decimal("100.00")),
        (at(10), "us-west", 1, Decimal("200.00")),
        (at(11), "us-east", 1, Decimal("80.00")),
    ]
    health = by(
        models["mart_payment_health_hourly"].filter("region_code = 'us-east'"),
        "payment_hour_utc", "payment_attempt_count", "successful_payment_count",
        "failed_payment_count", "failure_rate", "attempted_amount",
    )
    assert health[0] == (at(10), 2, 1, 1, Decimal("0.500000"), Decimal("150.00"))
    assert by(
        models["mart_refunds_hourly"], "refund_request_count", "requested_amount"
    ) == [(1, Decimal("30.00"))]
    counts = [
        models[n].count()
        for n in ("fct_orders", "fct_payment_attempts", "fct_shipments", "fct_refund_requests",
                  "dim_customers", "dim_products", "dim_regions")
    ]
    assert counts == [4, 4, 2, 1, 4, 4, 4]
    ships = {
        r["order_id"]: (r["delay_event_count"], r["was_delayed"], r["first_delay_source_event_id"])
        for r in models["fct_shipments"].collect()
    }
    assert ships["order-1"][:2] == (1, True) and ships["order-1"][2]
    assert ships["order-3"] == (0, False, None)
    operations = {
        (r[0], r[1]): r[2]
        for r in by(
            models["mart_operations_health_hourly"],
            "metric_hour_utc", "region_code", "refund_requests_per_order",
        )
    }
    assert operations[(at(11), "us-east")] == Decimal("0.000000")


def test_late_events_and_frozen_staging(spark, tmp_path):
    first, late = golden.frame(spark), golden.frame(spark, golden.LATE, 12)
    models = build_models(first, str(tmp_path / "one"))
    assert models["fct_orders"].count() == 4
    rebuilt = build_models(first.unionByName(late), str(tmp_path / "two"))
    assert models["fct_orders"].count() == 4
    assert rebuilt["fct_orders"].count() == 5
    ops = {r["region_code"]: r for r in rebuilt["mart_operations_health_hourly"].collect()}
    assert ops["eu-west"]["payment_failure_rate"] is None
    assert ops["eu-west"]["refund_requests_per_order"] == Decimal("0.000000")
    assert (ops["ap-south"]["order_count"], ops["ap-south"]["refund_request_count"]) == (0, 1)
    assert ops["ap-south"]["refund_requests_per_order"] is None
    revenue = rebuilt["mart_revenue_hourly"].agg(F.sum("revenue_amount")).first()[0]
    assert revenue == Decimal("380.00")
    delayed = rebuilt["fct_shipments"].filter("order_id = 'order-3'").first()
    assert (delayed["delay_event_count"], delayed["was_delayed"]) == (1, True)


def test_replay_inserts_nothing_and_facts_refresh(spark):
    events = golden.frame(spark)
    assert merge_new_events(events.limit(1), events).count() == 0
    orders = facts.fct_orders(events)
    assert incremental_delete_insert(orders, orders).count() == 4


def test_every_delay_id_has_its_place(spark):
    many = [("shipment_delayed", f"12:{m:02d}", 1, "us-east", None, None, "ups") for m in range(5)]
    events = golden.frame(spark).unionByName(golden.frame(spark, many, 50))
    row = facts.shipment_delays_by_order(events).first()
    assert row["delay_event_count"] == 6
    ids = facts.shipment_delay_ids(events).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in ids] == [1, 2, 3, 4, 5, 6]
    assert ids[0]["delay_source_event_id"] == row["first_delay_source_event_id"]
    assert facts.delay_links(events).count() == 6


@pytest.mark.parametrize(
    ("order_ids", "expected"),
    [(["order-1"], 1), ([], 3), (["order-1", None], 0)],
)
def test_orphans_follow_not_in(spark, order_ids, expected):
    log = spark.createDataFrame(
        [("order-1", "payment_failed"), ("order-2", "payment_failed"), (None, "payment_failed")],
        "order_id string, event_type string",
    ).selectExpr("*", "timestamp'2026-09-08 10:00:00' event_hour", "'us-east' region",
                 "timestamp'2026-09-08 10:00:00' processed_at")
    orders = spark.createDataFrame([(o,) for o in order_ids], "order_id string")
    assert marts.mart_data_quality_hourly_a(log, orders).first()["orphan_payment_attempt_count"] == expected


def test_frozen_snapshot_reads_only_its_event_type(spark, tmp_path):
    frozen = staging.freeze(golden.frame(spark), str(tmp_path / "stg"))
    plan = facts.fct_refund_requests(frozen)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan
