"""Version-one commerce event contract: fixed values and declared schemas.

The word lists and patterns below are fixed values of the contract. They must
equal what producers and consumers already agree on, so they are stated plainly.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
CURRENCY = "USD"

# Event type -> the only legal status for that type.
STATUS_OF_TYPE = {
    "order_created": "created",
    "payment_processed": "paid",
    "payment_failed": "failed",
    "shipment_created": "shipped",
    "shipment_delayed": "delayed",
    "refund_requested": "requested",
    "inventory_updated": "updated",
    "customer_login": "authenticated",
}
EVENT_TYPES = tuple(STATUS_OF_TYPE)
REGIONS = ("us-east", "us-west", "eu-west", "ap-south")
PAYMENT_PROVIDERS = ("stripe", "adyen", "paypal")
SHIPMENT_PROVIDERS = ("ups", "fedex", "dhl")

PAYMENT_TYPES = ("payment_processed", "payment_failed")
SHIPMENT_TYPES = ("shipment_created", "shipment_delayed")
MONEY_TYPES = ("order_created", "payment_processed", "payment_failed", "refund_requested")

# Earliest event time accepted and tolerated producer clock lead.
EARLIEST_EVENT = "2020-01-01 00:00:00"
CLOCK_LEAD_MINUTES = 5

# Rejection code -> constant detail text (never record content).
REJECTION_DETAIL = {
    "malformed_json": "Payload is not valid UTF-8 JSON.",
    "missing_event_id": "Required event_id is absent or null.",
    "invalid_event_type": "event_type is not supported by contract v1.",
    "schema_validation": "Payload does not match contract v1 shape or field types.",
    "invalid_business_fields": "Required business fields or business rules failed.",
    "other_validation": "Payload cannot be validated as a commerce object.",
}

_PAYLOAD = [
    ("schema_version", T.IntegerType()),
    ("event_id", T.StringType()),
    ("event_type", T.StringType()),
    ("timestamp", T.StringType()),
    ("customer_id", T.StringType()),
    ("order_id", T.StringType()),
    ("product_id", T.StringType()),
    ("amount", T.DecimalType(14, 2)),
    ("currency", T.StringType()),
    ("payment_provider", T.StringType()),
    ("shipment_provider", T.StringType()),
    ("region", T.StringType()),
    ("status", T.StringType()),
]
PAYLOAD_FIELDS = tuple(name for name, _ in _PAYLOAD) + ("metadata",)


def _struct(pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


# JSON payload as text-typed timestamp plus open metadata.
PAYLOAD_SCHEMA = _struct(_PAYLOAD + [("metadata", T.MapType(T.StringType(), T.StringType()))])

# Broker record as the Kafka source delivers it.
ENVELOPE_SCHEMA = _struct(
    [
        ("topic", T.StringType()),
        ("partition", T.IntegerType()),
        ("offset", T.LongType()),
        ("timestamp", T.TimestampType()),
        ("key", T.BinaryType()),
        ("value", T.BinaryType()),
    ]
)

# Lossless archive row.
RAW_SCHEMA = _struct(
    [
        ("source_topic", T.StringType()),
        ("source_partition", T.IntegerType()),
        ("source_offset", T.LongType()),
        ("source_timestamp", T.TimestampType()),
        ("key", T.BinaryType()),
        ("raw_payload", T.BinaryType()),
        ("ingested_at", T.TimestampType()),
        ("ingest_date", T.DateType()),
    ]
)

_BUSINESS = [
    ("event_ts", T.TimestampType()) if name == "timestamp" else (name, kind)
    for name, kind in _PAYLOAD
] + [("metadata", T.StringType())]
_LINEAGE = [
    ("source_topic", T.StringType()),
    ("source_partition", T.IntegerType()),
    ("source_offset", T.LongType()),
    ("source_timestamp", T.TimestampType()),
    ("ingested_at", T.TimestampType()),
]
BUSINESS_SCHEMA = _struct(_BUSINESS)
EVENT_SCHEMA = _struct(_BUSINESS + _LINEAGE)
EVENT_COLUMNS = tuple(EVENT_SCHEMA.names)
BUSINESS_COLUMNS = tuple(BUSINESS_SCHEMA.names)
SOURCE_KEY = ("source_topic", "source_partition", "source_offset")

# Texts of single fields.
UUID_TEXT = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
)
ID_TEXT = r"^\S{1,100}$"
MONEY_TEXT = r"^(0|[1-9][0-9]{0,11})(\.[0-9]{1,2})?$"
WHOLE_TEXT = "^(0|[1-9][0-9]*)$"
TIME_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"

# Codes of the classifier line, in the order a record reports them.
CLASSIFIER_CODES = (
    "malformed_json",
    "unknown_field",
    "unsupported_schema_version",
    "invalid_event_id",
    "invalid_event_type",
    "invalid_timestamp",
    "invalid_region",
    "invalid_currency",
    "invalid_status",
    "invalid_customer_id",
    "invalid_order_id",
    "invalid_product_id",
    "invalid_amount",
    "invalid_payment_provider",
    "invalid_shipment_provider",
    "invalid_inventory_quantity",
)

# Columns of the classifier line's archive, of its event sink, and the members of its
# dead-letter body.
PLACE_COLUMNS = ("source_topic", "source_partition", "source_offset", "kafka_timestamp")
ARCHIVE_COLUMNS = (
    *PLACE_COLUMNS,
    "kafka_key",
    "raw_bytes",
    "raw_value",
    "source_event_id",
    "validation_errors",
    "is_valid",
    "processed_at",
    "ingest_date",
)
SINK_COLUMNS = (
    "event_id",
    "schema_version",
    "event_type",
    "event_timestamp",
    "customer_id",
    "order_id",
    "product_id",
    "amount",
    "currency",
    "payment_provider",
    "shipment_provider",
    "region",
    "status",
    "metadata_json",
    *PLACE_COLUMNS,
    "processed_at",
    "processing_latency_ms",
    "raw_value",
)
REJECTION_MEMBERS = (
    "rejection_schema",
    "source_event_id",
    "validation_errors",
    "raw_payload_base64",
    "raw_value",
    "source",
    "processed_at",
)

# One row per state change of an analytics build; newest row per build wins.
BUILD_SCHEMA = _struct(
    [
        ("build_id", T.StringType()),
        ("build_key", T.StringType()),
        ("status", T.StringType()),
        ("started_at", T.TimestampType()),
        ("completed_at", T.TimestampType()),
        ("published_at", T.TimestampType()),
        ("source_max_event_ts", T.TimestampType()),
        ("source_max_ingested_at", T.TimestampType()),
        ("source_event_count", T.LongType()),
        ("manifest_sha256", T.StringType()),
        ("failure_reason", T.StringType()),
    ]
)
