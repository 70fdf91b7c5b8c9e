"""Commerce event log derived from the order tables.

Every order becomes one journey (login, order, payment, shipment, ...), so the log
grows with the given tables. One scan and one join feed an `inline` of the steps;
steps the caller does not need are never generated, which is what partition pruning
on event_type gives on a stored log.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from cargolume.contract import EVENT_COLUMNS, EVENT_TYPES
from cargolume.sources.tables import table

TOPIC = "commerce.events.v1"
#: Tasks a core that the records of the broker log are made in.
TASKS_A_CORE = 3

# (event types, condition, step number, type, status, seconds after the order)
_STEPS = [
    (("customer_login",), "true", 0, "'customer_login'", "'authenticated'", -60),
    (("order_created",), "true", 1, "'order_created'", "'created'", 0),
    (
        ("payment_processed", "payment_failed"),
        "true",
        2,
        "if(failed, 'payment_failed', 'payment_processed')",
        "if(failed, 'failed', 'paid')",
        120,
    ),
    (("shipment_created",), "not failed", 3, "'shipment_created'", "'shipped'", 300),
    (("shipment_delayed",), "not failed and late", 4, "'shipment_delayed'", "'delayed'", 7200),
    (("refund_requested",), "not failed and refund", 5, "'refund_requested'", "'requested'", 1800),
    (("inventory_updated",), "true", 6, "'inventory_updated'", "'updated'", 360),
]

# 1788220800 is 2026-09-01 00:00:00 UTC; s is the order's second in the log.
_LOG = """
with located as (
  select o_orderkey k, o_custkey c, cast(o_totalprice as decimal(14,2)) amt,
    o_orderkey div 120 q, (o_orderkey * 7919) % 120 h0,
    case n_regionkey % 4 when 0 then 'us-east' when 1 then 'us-west'
      when 2 then 'eu-west' else 'ap-south' end region
  from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey),
placed as (
  select *, if(h0 = 102 and region = 'us-east' and (q + k) % 10 <> 0, 103, h0) h from located),
journey as (
  select k, c, amt, region, h * 3600 + (k * 104729) % 1500 s,
    (q * 37 + k) % 100 < if(h = 100 and region = 'ap-south', 65, 3) failed,
    (q * 53 + k) % 100 < if(h = 60 and region = 'eu-west', 65, 4) late,
    (q * 71 + k) % 100 < if(h = 101 and region = 'us-west', 50, 2) refund
  from placed),
step as (
  select k, c, amt, region, i, t, st, timestamp_seconds(1788220800 + s2) ts,
    md5(concat(t, ':', k)) d
  from journey lateral view inline(array_compact(array(%(steps)s))) as i, t, st, s2
  where t in (%(kinds)s)),
event as (
  select 1 schema_version,
    concat(substr(d,1,8), '-', substr(d,9,4), '-4', substr(d,14,3), '-a', substr(d,18,3), '-',
      substr(d,21,12)) event_id,
    t event_type, ts event_ts,
    if(i < 6, concat('customer-', c), null) customer_id,
    if(i between 1 and 5, concat('order-', k), null) order_id,
    if(i > 0, concat('product-', k % 80), null) product_id,
    if(i in (1, 2, 5), amt, null) amount, 'USD' currency,
    if(i = 2, case k % 3 when 0 then 'stripe' when 1 then 'adyen' else 'paypal' end, null)
      payment_provider,
    if(i in (3, 4), case k % 3 when 0 then 'ups' when 1 then 'fedex' else 'dhl' end, null)
      shipment_provider,
    region, st status,
    if(i = 6, concat('{{"quantity":', k % 1000, ',"synthetic":true}}'), '{{"synthetic":true}}')
      metadata,
    '%(topic)s' source_topic, cast(k % 3 as int) source_partition,
    (k div 3) * 7 + i source_offset, ts source_timestamp,
    timestamp_seconds(unix_seconds(ts) + 60) ingested_at, k, i
  from step)
"""

# The order's event, one planted fault per two hundred orders and kind. 17: wrong status on
# order and payment; 23: negative amount; 29: login reuses the order's offset; 31: NULL
# customer; 37: a second shipment creation; 41: order event lost, children stay.
_FAULTY = """
select schema_version, event_id,
  if(k % 200 = 37 and i = 6, 'shipment_created', event_type) event_type,
  event_ts, if(k % 200 = 31, null, customer_id) customer_id,
  if(k % 200 = 37 and i = 6, concat('order-', k), order_id) order_id, product_id,
  cast(if(k % 200 = 23, -amount, amount) as decimal(14,2)) amount, currency, payment_provider,
  shipment_provider, region,
  case when k % 200 = 17 and i in (1, 2) then 'wrong'
    when k % 200 = 37 and i = 6 then 'shipped' else status end status,
  metadata, source_topic, source_partition,
  if(k % 200 = 29 and i = 0, source_offset + 1, source_offset) source_offset,
  source_timestamp, ingested_at
from event where not (k % 200 = 41 and i = 1)
"""

_PROCESSED = """
select event_id, schema_version, event_type, event_ts event_timestamp, customer_id, order_id,
  product_id, amount, currency, payment_provider, shipment_provider, region, status, metadata,
  source_topic, source_partition, source_offset, source_timestamp kafka_timestamp,
  timestamp_seconds(unix_seconds(event_ts) + k % 7 * 13 + i + 1) processed_at,
  cast((k % 7 * 13 + i + 1) * 1000 as double) processing_latency_ms
from event
"""

# Broker records, with planted faults on order rows (k mod 200). 7: exact duplicate with
# offset + 10^9; 11: truncated JSON; 13: no event_id; 17: unknown field; 19: wrong status;
# 23: payload is not UTF-8.
_ENVELOPES = """
, body as (
  select *, if(i = 1, k % 200, -1) r, concat('{{"schema_version":1',
    if(i = 1 and k % 200 = 13, '', concat(',"event_id":"', event_id, '"')),
    ',"event_type":"', event_type, '","timestamp":"',
    date_format(%(naive)s, "yyyy-MM-dd'T'HH:mm:ss"), 'Z"',
    if(customer_id is null, '', concat(',"customer_id":"', customer_id, '"')),
    if(order_id is null, '', concat(',"order_id":"', order_id, '"')),
    if(product_id is null, '', concat(',"product_id":"', product_id, '"')),
    if(amount is null, '', concat(',"amount":', amount)), ',"currency":"USD"',
    if(payment_provider is null, '', concat(',"payment_provider":"', payment_provider, '"')),
    if(shipment_provider is null, '', concat(',"shipment_provider":"', shipment_provider, '"')),
    ',"region":"', region, '","status":"', if(i = 1 and k % 200 = 19, 'wrong', status), '"',
    if(i = 1 and k % 200 = 17, ',"coupon":"x"', ''), ',"metadata":', metadata, '}}') b
  from event)
select source_topic topic, source_partition `partition`, source_offset + shift `offset`,
  source_timestamp `timestamp`, cast(coalesce(order_id, customer_id, product_id) as binary) key,
  case when r = 11 then cast(substr(b, 1, 40) as binary)
    when r = 23 then concat(unhex('FF'), cast(b as binary)) else cast(b as binary) end value
from body lateral view explode(if(r = 7, array(0L, 1000000000L), array(0L))) as shift
"""


def _log(
    spark: SparkSession, sf_dir: str, kinds: Iterable[str], select: str, spread: bool = False
) -> DataFrame:
    """`select` over the log; `spread`: by all cores, even if the orders lie in one small file."""
    wanted = tuple(kinds)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    if spread:
        orders = orders.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    steps = ", ".join(
        f"if({condition}, named_struct('i', {i}, 't', {kind}, 'st', {status}, 's2', s + {shift}),"
        " null)"
        for types, condition, i, kind, status, shift in _STEPS
        if set(wanted) & set(types)
    )
    naive = "cast(event_ts as timestamp_ntz)"
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":  # zones are looked up by name for every row
        naive = f"convert_timezone(current_timezone(), 'UTC', {naive})"
    values = {
        "naive": naive,
        "steps": steps,
        "kinds": ", ".join(f"'{kind}'" for kind in wanted),
        "topic": TOPIC,
    }
    text = _LOG + select
    for name, value in values.items():
        text = text.replace(f"%({name})s", value)
    return spark.sql(
        text,
        orders=orders,
        customer=table(spark, sf_dir, "customer"),
        nation=table(spark, sf_dir, "nation"),
    )


def numbered_log(
    spark: SparkSession, sf_dir: str, kinds: Iterable[str] = EVENT_TYPES
) -> DataFrame:
    """Contract events plus the order number `k` and step `i` they came from."""
    return _log(spark, sf_dir, kinds, "select * from event")


def event_log(spark: SparkSession, sf_dir: str, kinds: Iterable[str] = EVENT_TYPES) -> DataFrame:
    """Contract events (19 columns)."""
    return _log(spark, sf_dir, kinds, f"select {', '.join(EVENT_COLUMNS)} from event")


def faulty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with planted contract faults, for the data-quality checks."""
    return _log(spark, sf_dir, EVENT_TYPES, _FAULTY)


def processed_log(
    spark: SparkSession, sf_dir: str, kinds: Iterable[str] = EVENT_TYPES
) -> DataFrame:
    """Classifier-line shape of the log: event_timestamp, processed_at and latency."""
    return _log(spark, sf_dir, kinds, _PROCESSED)


def envelope_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker records of the log, some of them broken.

    An order of 24 bytes becomes five records to write, parse and judge, so orders are dealt out first.
    """
    return _log(spark, sf_dir, EVENT_TYPES, _ENVELOPES, spread=True)
