"""Envelope, classifier, validator and dead-letter queries over the derived broker log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolume import contract as c
from cargolume.catalog.logs import with_log
from cargolume.catalog.registry import query
from cargolume.operators import classify, envelope, validate
from cargolume.sources.derived_log import envelope_log, event_log


def _words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def clock():
    """Fixed processing clock of the registered queries."""
    return F.lit("2026-09-08 00:00:00Z").cast("timestamp")


def raw_log(spark, sf):
    """Archive rows stamped one minute after their broker timestamp."""
    ingested = F.col("timestamp") + F.make_dt_interval(secs=F.lit(60))
    return envelope.raw_rows(envelope_log(spark, sf), ingested)


def classified(spark, sf, strict=False):
    return classify.classify_events(envelope_log(spark, sf), clock(), strict)


def validated(spark, sf):
    return validate.validate_events(raw_log(spark, sf))


_ALLOWED = "[" + ", ".join(f"'{name}'" for name in c.PAYLOAD_FIELDS) + "]"
_STATUS = " ".join(f"when '{k}' then '{v}'" for k, v in c.STATUS_OF_TYPE.items())
_UUID = c.UUID_TEXT

# Fields of every parseable payload, then the two verdicts.
_FIELDS = f"""
fld as (select *, case when ok then raw_value end doc from js),
fl as (select *, json_keys(doc) names, {", ".join(
    f"json_extract_string(doc, '$.{name}') j_{name}" for name in c.PAYLOAD_FIELDS
    if name != "metadata")},
  json_extract_string(doc, '$.metadata.quantity') quantity from fld),
fx as (select *, try_cast(j_timestamp as timestamptz) at time zone 'UTC' at_utc from fl)"""

_CODES_A = f"""
ca as (select *, list_filter([
  case when not ok then 'malformed_json' end,
  case when len(list_filter(names, lambda x: x not in {_words(c.PAYLOAD_FIELDS)})) > 0
    then 'unknown_field' end,
  case when j_schema_version <> '1' then 'unsupported_schema_version' end,
  case when j_event_id is null or not regexp_matches(j_event_id, '{_UUID}')
    then 'invalid_event_id' end,
  case when j_event_type not in {_words(c.EVENT_TYPES)} then 'invalid_event_type' end,
  case when at_utc is null or at_utc < timestamp '2020-01-01' or
    at_utc > timestamp '2026-09-08 00:05:00' then 'invalid_timestamp' end,
  case when j_region not in {_words(c.REGIONS)} then 'invalid_region' end,
  case when j_currency <> 'USD' then 'invalid_currency' end,
  case when j_status <> case j_event_type {_STATUS} end then 'invalid_status' end,
  case when j_event_type <> 'inventory_updated' and (j_customer_id is null or
    not regexp_matches(j_customer_id, '^\\S{{1,100}}$')) then 'invalid_customer_id' end,
  case when j_event_type not in ('inventory_updated', 'customer_login') and (j_order_id is null
    or not regexp_matches(j_order_id, '^\\S{{1,100}}$')) then 'invalid_order_id' end,
  case when j_event_type <> 'customer_login' and (j_product_id is null or
    not regexp_matches(j_product_id, '^\\S{{1,100}}$')) then 'invalid_product_id' end,
  case when j_event_type in {_words(c.MONEY_TYPES)} and (j_amount is null or
    not regexp_matches(j_amount, '^(0|[1-9][0-9]{{0,11}})(\\.[0-9]{{1,2}})?$'))
    then 'invalid_amount' end,
  case when j_event_type in {_words(c.PAYMENT_TYPES)} and
    j_payment_provider not in {_words(c.PAYMENT_PROVIDERS)} then 'invalid_payment_provider' end,
  case when j_event_type in {_words(c.SHIPMENT_TYPES)} and
    j_shipment_provider not in {_words(c.SHIPMENT_PROVIDERS)} then 'invalid_shipment_provider' end,
  case when j_event_type = 'inventory_updated' and
    not regexp_matches(quantity, '^(0|[1-9][0-9]*)$') then 'invalid_inventory_quantity' end
  ], lambda x: x is not null) codes from fx)"""

_CODE_B = f"""
cb as (select *, "timestamp" + interval 60 second ingested, case
  when not ok then 'malformed_json'
  when j_event_id is null then 'missing_event_id'
  when j_event_type is null or j_event_type not in {_words(c.EVENT_TYPES)} then 'invalid_event_type'
  when at_utc is null or j_status is null or coalesce(j_region not in {_words(c.REGIONS)}, true)
    or coalesce(j_currency, 'USD') <> 'USD' or coalesce(try_cast(j_amount as decimal(14,2)), 0) < 0
    then 'invalid_business_fields'
  when len(list_filter(names, lambda x: x not in {_words(c.PAYLOAD_FIELDS)})) > 0
    or coalesce(j_schema_version, '1') <> '1' or not regexp_matches(j_event_id, '{_UUID}')
    then 'schema_validation'
  when at_utc < timestamp '2020-01-01' or at_utc > "timestamp" + interval 360 second
    or j_status <> case j_event_type {_STATUS} end
    or (j_event_type <> 'inventory_updated' and j_customer_id is null)
    or (j_event_type not in ('inventory_updated', 'customer_login') and j_order_id is null)
    or (j_event_type <> 'customer_login' and j_product_id is null)
    or (j_event_type in {_words(c.MONEY_TYPES)} and j_amount is null)
    or (j_event_type in {_words(c.PAYMENT_TYPES)} and j_payment_provider is null)
    or (j_event_type in {_words(c.SHIPMENT_TYPES)} and j_shipment_provider is null)
    or (j_event_type = 'inventory_updated' and quantity is null) then 'invalid_business_fields'
  end code from fx)"""


def env_sql(select: str) -> str:
    return with_log(f"with {_FIELDS.strip()},{_CODES_A},{_CODE_B}\n{select}", "env")


_SRC = '''topic source_topic, "partition"::bigint source_partition, "offset" source_offset'''


@query(
    "read_envelopes",
    env_sql(
        '''select topic, "partition"::bigint "partition", count(*) records,
        min("offset") first_offset, max("offset") last_offset, min("timestamp") first_at,
        max("timestamp") last_at, sum(octet_length("value"))::bigint payload_bytes
        from js group by 1, 2'''
    ),
)
def _(spark, sf):
    return envelope_log(spark, sf).groupBy("topic", "partition").agg(
        F.count("*").alias("records"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
        F.sum(F.octet_length("value")).alias("payload_bytes"),
    )


@query(
    "project_envelope",
    env_sql(
        f'''select {_SRC}, "timestamp" kafka_timestamp, decode("key") kafka_key,
        to_base64("value") payload, raw_value from js'''
    ),
)
def _(spark, sf):
    projected = envelope.project_envelope(envelope_log(spark, sf))
    # All bytes come through; only their text differs between engines where it is no UTF-8.
    return (
        projected.withColumn("payload", F.regexp_replace(F.base64("raw_bytes"), r"\s", ""))
        .withColumn("raw_value", F.expr("if(is_valid_utf8(raw_value), raw_value, null)"))
        .drop("raw_bytes")
    )


@query(
    "parse_event_json",
    env_sql(
        f"""select {_SRC}, j_event_id source_event_id, j_event_type event_type,
        at_utc event_timestamp, j_customer_id customer_id, j_order_id order_id,
        j_product_id product_id, try_cast(j_amount as double) amount, j_amount amount_text,
        quantity quantity_text, array_to_string(names, '|') field_names, ok readable from fx"""
    ),
)
def _(spark, sf):
    parsed = classify.parse_event_json(envelope.project_envelope(envelope_log(spark, sf)))
    # Unreadable records stay, with no fields: what a broken text half yields differs by engine.
    readable = "coalesce(is_valid_utf8(raw_value) and parsed._corrupt_record is null, false)"
    fields = [
        "source_event_id", "event_type", "event_timestamp", "customer_id", "order_id", "product_id",
        "amount", "amount_text", "quantity_text", "field_names",
    ]
    return parsed.withColumn("readable", F.expr(readable)).select(
        *c.SOURCE_KEY, *[F.when(F.col("readable"), F.col(n)).alias(n) for n in fields], "readable"
    )


_CLASSES = f"""select {_SRC}, j_event_id source_event_id, array_to_string(codes, '|')
  validation_errors, len(codes) = 0 is_valid from ca"""


@query("classify_events_a", env_sql(_CLASSES))
def _(spark, sf):
    return classified(spark, sf).select(
        *c.SOURCE_KEY, "source_event_id", "validation_errors", "is_valid"
    )


@query(
    "classify_events_a_strict",
    env_sql(
        _CLASSES.replace(
            "array_to_string(codes, '|')",
            "case when ok then array_to_string(codes, '|') else 'malformed_json|invalid_event_id|"
            "invalid_event_type|invalid_timestamp|invalid_region|invalid_status' end",
        )
    ),
)
def _(spark, sf):
    return classified(spark, sf, strict=True).select(
        *c.SOURCE_KEY, "source_event_id", "validation_errors", "is_valid"
    )


@query(
    "validate_events_b",
    env_sql(
        f"""select {_SRC}, code error_code, case code {" ".join(
            f"when '{k}' then '{v}'" for k, v in c.REJECTION_DETAIL.items())} end error_detail,
        case when code is null then j_event_id end event_id,
        case when code is null then j_event_type end event_type,
        case when code is null then at_utc end event_ts,
        case when code is null then try_cast(j_amount as double) end amount from cb"""
    ),
)
def _(spark, sf):
    e = "validation.event"
    return validated(spark, sf).select(
        *c.SOURCE_KEY,
        "validation.error_code",
        "validation.error_detail",
        f"{e}.event_id",
        f"{e}.event_type",
        f"{e}.event_ts",
        f"{e}.amount",
    )


@query(
    "split_valid_invalid",
    env_sql(
        f"""select 1::bigint schema_version, j_event_id event_id, j_event_type event_type,
        at_utc event_ts, j_customer_id customer_id, j_order_id order_id, j_product_id product_id,
        try_cast(j_amount as double) amount, 'USD' currency, j_payment_provider payment_provider,
        j_shipment_provider shipment_provider, j_region region, j_status status,
        json_extract(doc, '$.metadata')::varchar metadata, {_SRC}, "timestamp" source_timestamp,
        ingested ingested_at from cb where code is null"""
    ),
)
def _(spark, sf):
    return envelope.accepted_events(validated(spark, sf))


@query(
    "rejection_counts",
    env_sql("select code error_code, count(*) rejections from cb where code is not null group by 1"),
)
def _(spark, sf):
    return envelope.rejection_counts(validated(spark, sf))


_KEY = """concat(topic, ':', "partition", ':', "offset")"""


@query(
    "dead_letters_a",
    env_sql(
        f"""select coalesce(j_event_id, {_KEY}) "key", array_to_string(codes, '|') errors,
        to_base64("value") payload, "offset" source_offset, '{envelope.REJECTION_TAG}' tag
        from ca where len(codes) > 0"""
    ),
)
def _(spark, sf):
    read = lambda path: F.get_json_object("value", path)
    return envelope.dead_letters_a(classified(spark, sf)).select(
        "key",
        F.array_join(F.from_json(read("$.validation_errors"), "array<string>"), "|").alias("errors"),
        F.regexp_replace(read("$.raw_payload_base64"), r"\s", "").alias("payload"),
        read("$.source.source_offset").cast("bigint").alias("source_offset"),
        read("$.rejection_schema").alias("tag"),
    )


@query(
    "dead_letters_b",
    env_sql(
        f"""select {_KEY} "key", code error_code, to_base64("value") payload,
        to_base64("key") record_key from cb where code is not null"""
    ),
)
def _(spark, sf):
    read = lambda path: F.get_json_object("value", path)
    return envelope.dead_letters_b(validated(spark, sf)).select(
        "key",
        read("$.error_code").alias("error_code"),
        F.regexp_replace(read("$.payload_base64"), r"\s", "").alias("payload"),
        F.regexp_replace(read("$.key_base64"), r"\s", "").alias("record_key"),
    )


@query(
    "raw_archive_rows",
    env_sql(
        f"""select {_SRC}, "timestamp" kafka_timestamp, decode("key") kafka_key,
        j_event_id source_event_id, array_to_string(codes, '|') validation_errors,
        len(codes) = 0 is_valid, cast("timestamp" as date) ingest_date,
        octet_length("value") payload_bytes from ca"""
    ),
)
def _(spark, sf):
    return envelope.raw_archive_rows(classified(spark, sf)).select(
        *c.SOURCE_KEY,
        "kafka_timestamp",
        "kafka_key",
        "source_event_id",
        "validation_errors",
        "is_valid",
        "ingest_date",
        F.octet_length("raw_bytes").cast("bigint").alias("payload_bytes"),
    )


_SINK = f"""j_event_id event_id, j_schema_version::bigint schema_version, j_event_type event_type,
  at_utc event_timestamp, j_customer_id customer_id, j_order_id order_id, j_product_id product_id,
  try_cast(j_amount as double) amount, j_currency currency, j_payment_provider payment_provider,
  j_shipment_provider shipment_provider, j_region region, j_status status,
  quantity, {_SRC}, "timestamp" kafka_timestamp,
  timestamp '2026-09-08' processed_at,
  (epoch(timestamp '2026-09-08') - epoch(at_utc)) * 1000.0 processing_latency_ms, raw_value"""


@query("event_sink_rows", env_sql(f"select {_SINK} from ca where len(codes) = 0"))
def _(spark, sf):
    # The 21 sink columns; metadata JSON is compared by its one varying key.
    accepted = classified(spark, sf).filter("is_valid")
    return (
        envelope.event_sink_rows(accepted)
        .withColumn("quantity", F.get_json_object("metadata_json", "$.quantity"))
        .drop("metadata_json")
    )


@query(
    "archived_events",
    env_sql(
        """select cast(at_utc as date) event_date, j_event_type event_type, count(*) events,
        sum(try_cast(j_amount as decimal(14,2)))::double amount
        from ca where len(codes) = 0 group by 1, 2"""
    ),
)
def _(spark, sf):
    return (
        envelope.archived_events(classified(spark, sf).filter("is_valid"))
        .groupBy("event_date", "event_type")
        .agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))
    )


@query(
    "valid_events_dedup",
    env_sql(
        """select j_event_id event_id, j_event_type event_type, at_utc event_timestamp,
        j_region region from ca where len(codes) = 0 group by all"""
    ),
)
def _(spark, sf):
    return classify.valid_events(classified(spark, sf)).select(
        "event_id", "event_type", "event_timestamp", "region"
    )


@query(
    "processing_latency",
    with_log(
        """select event_type, min(processing_latency_ms) fastest, max(processing_latency_ms) slowest,
        avg(processing_latency_ms) average from p group by 1""".replace("avg(processing_latency_ms)", "round(avg(processing_latency_ms), 6)"),
        "p",
    ),
)
def _(spark, sf):
    from cargolume.sources.derived_log import processed_log

    log = processed_log(spark, sf).withColumn(
        "latency", classify.processing_latency_ms("processed_at", "event_timestamp")
    )
    return log.groupBy("event_type").agg(
        F.min("latency").alias("fastest"),
        F.max("latency").alias("slowest"),
        F.round(F.avg("latency"), 6).alias("average"),
    )


@query(
    "curated_events",
    with_log(
        """select event_id, cast(event_ts as date) event_date, hour(event_ts)::bigint event_hour,
        event_type = 'payment_failed' is_payment_failure,
        event_type = 'shipment_delayed' is_shipment_delay,
        event_type = 'refund_requested' is_refund from e"""
    ),
)
def _(spark, sf):
    return envelope.curated_events(event_log(spark, sf)).select(
        "event_id",
        "event_date",
        "event_hour",
        "is_payment_failure",
        "is_shipment_delay",
        "is_refund",
    )


@query(
    "unknown_field_diff",
    env_sql(
        f"""select x field, count(*) records from fx, unnest(names) u(x)
        where ok and x not in {_words(c.PAYLOAD_FIELDS)} group by 1"""
    ),
)
def _(spark, sf):
    allowed = F.array(*[F.lit(name) for name in c.PAYLOAD_FIELDS])
    return (
        envelope_log(spark, sf)
        .select(F.explode(F.array_except(F.json_object_keys(F.col("value").cast("string")), allowed)).alias("field"))
        .groupBy("field")
        .agg(F.count("*").alias("records"))
    )
