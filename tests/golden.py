"""The twelve-event journey fixture and its late additions."""

from datetime import UTC, datetime, timedelta
from decimal import Decimal

from cargolume.contract import EVENT_SCHEMA, STATUS_OF_TYPE

# type, time, journey, region, amount, payment provider, shipment provider
EVENTS = [
    ("order_created", "10:00", 1, "us-east", "100.00", None, None),
    ("payment_processed", "10:05", 1, "us-east", "100.00", "stripe", None),
    ("shipment_created", "10:10", 1, "us-east", None, None, "ups"),
    ("shipment_delayed", "10:20", 1, "us-east", None, None, "ups"),
    ("refund_requested", "10:30", 1, "us-east", "30.00", None, None),
    ("order_created", "10:02", 2, "us-east", "50.00", None, None),
    ("payment_failed", "10:07", 2, "us-east", "50.00", "adyen", None),
    ("order_created", "10:03", 3, "us-west", "200.00", None, None),
    ("payment_processed", "10:08", 3, "us-west", "200.00", "paypal", None),
    ("shipment_created", "10:12", 3, "us-west", None, None, "fedex"),
    ("order_created", "11:00", 4, "us-east", "80.00", None, None),
    ("payment_processed", "11:05", 4, "us-east", "80.00", "stripe", None),
]
LATE = [
    ("order_created", "09:00", 5, "eu-west", "25.00", None, None),
    ("shipment_delayed", "12:00", 3, "us-west", None, None, "fedex"),
    ("refund_requested", "12:00", 6, "ap-south", "5.00", None, None),
]


def rows(events, start=0):
    out = []
    for n, (kind, time, journey, region, amount, pay, ship) in enumerate(events, start):
        at = datetime.fromisoformat(f"2026-09-08T{time}:00+00:00")
        out.append(
            (
                1, f"00000000-0000-4000-a000-{n:012d}", kind, at, f"customer-{journey}",
                f"order-{journey}", f"product-{journey}", Decimal(amount) if amount else None, "USD",
                pay, ship, region, STATUS_OF_TYPE[kind], "{}", "analytics.acceptance.v1", 0, n, at,
                at + timedelta(minutes=1),
            )
        )
    return out


def frame(spark, events=EVENTS, start=0):
    return spark.createDataFrame(rows(events, start), EVENT_SCHEMA)


def hour(h):
    return datetime(2026, 9, 8, h, tzinfo=UTC)
