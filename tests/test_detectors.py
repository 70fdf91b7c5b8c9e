from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cargolume.contract import EVENT_SCHEMA
from cargolume.plans import detectors, evidence
from cargolume.plans.build import lazy_models
from cargolume.plans.publication import detector_gate

H = datetime(2026, 9, 8, 12, tzinfo=UTC)


def payments(spark, current, history):
    rows = [("us-east", H - timedelta(hours=n + 1), 0, 0, rate) for n, rate in enumerate(history)]
    rows.append(("us-east", H, *current, None))
    return spark.createDataFrame(
        rows,
        "region_code string, payment_hour_utc timestamp, failed_payment_count bigint, "
        "payment_attempt_count bigint, failure_rate decimal(12,6)",
    )


@pytest.mark.parametrize(
    ("current", "hours", "found"), [((9, 19), 6, 0), ((8, 20), 6, 1), ((8, 20), 5, 0), ((3, 20), 6, 0)]
)
def test_rate_rule(spark, current, hours, found):
    rows = detectors.payment_failure_rate(
        payments(spark, current, [Decimal("0.100000")] * hours)
    ).collect()
    assert len(rows) == found
    if found:
        assert rows[0]["observed_metric"] == Decimal("0.400000")
        assert rows[0]["threshold"] == Decimal("0.200000")
        assert rows[0]["summary"].endswith("observed 0.400 versus baseline 0.100")


@pytest.mark.parametrize(
    ("current", "history", "severity"),
    [(0, [30] * 11, None), (0, [10] * 12, None), (10, [40] * 12, "critical"), (None, [40] * 12, "critical"),
     (20, [40] * 12, "warning"), (21, [40] * 12, None)],
)
def test_volume_rule(spark, current, history, severity):
    rows = [("us-east", H - timedelta(hours=n + 1), v) for n, v in enumerate(history)]
    rows.append(("eu-west", H, 1) if current is None else ("us-east", H, current))
    frame = spark.createDataFrame(rows, "region_code string, metric_hour_utc timestamp, order_count bigint")
    got = detectors.order_volume_drop(frame).filter("region_code = 'us-east'").collect()
    assert [r["severity"] for r in got if r["evaluation_start"].timestamp() == H.timestamp()] == (
        [severity] if severity else []
    )


def test_acceptance(spark):
    def rows():
        n = 0
        for back in range(6, -1, -1):
            at = H - timedelta(hours=back) + timedelta(minutes=5)
            kind, status = ("payment_processed", "paid") if back else ("payment_failed", "failed")
            for _ in range(20):
                n += 1
                yield (1, f"00000000-0000-4000-a000-{n:012d}", kind, at, f"c{n}", f"o{n}", "p", Decimal("25.00"),
                       "USD", "stripe", None, "ap-south", status, "{}", "t", 0, n, at, at)

    stg = spark.createDataFrame(list(rows()), EVENT_SCHEMA)
    models = lazy_models(stg)
    now = F.lit(H + timedelta(hours=1, minutes=1))
    found = detectors.with_identity(
        detectors.evaluate_hour(
            models["mart_payment_health_hourly"],
            models["mart_shipment_health_hourly"],
            models["mart_operations_health_hourly"],
            now,
        ),
        F.lit("build"),
    )
    incident = found.collect()
    assert len(incident) == 1
    row = incident[0]
    assert (row["detector_name"], row["severity"]) == ("payment_failure_rate_increase", "critical")
    assert (row["observed_metric"], row["observed_denominator"]) == (Decimal("1.000000"), 20)
    assert (row["baseline_metric"], row["threshold"]) == (Decimal("0.000000"), Decimal("0.100000"))
    assert detectors.incident_evidence(found, evidence.analytics_evidence(stg)).count() == 20
    assert detectors.insert_incidents(found, found).count() == 0
    assert detectors.suppress_recent(found, found, now).count() == 0


def test_gate(spark):
    schema = "build_id string, status string, published_at timestamp"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([("b", "succeeded", H)], schema)
    gate = lambda frame, hours: tuple(detector_gate(frame, F.lit(H + timedelta(hours=hours))).first())
    assert gate(none, 0) == (None, "no_publication")
    assert gate(one, 1) == ("b", None)
    assert gate(one, 3) == (None, "stale_publication")


def test_cooldown_folds_in_time_order(spark):
    rows = [("d", "us-east", H + timedelta(hours=h), f"k{h:02d}") for h in (0, 3, 6, 7, 13, 14)]
    frame = spark.createDataFrame(
        rows, "detector_name string, region_code string, detected_at timestamp, uniqueness_key string"
    )
    kept = sorted(r["uniqueness_key"] for r in detectors.cooldown_sequence(frame).collect())
    assert kept == ["k00", "k07", "k14"]
