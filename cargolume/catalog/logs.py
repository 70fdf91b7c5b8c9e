"""SQL text of the derived logs, for the counterpart queries."""

from __future__ import annotations

_JOURNEYS = """
o as (
  select *, case when h0 = 102 and region = 'us-east' and (q + k) % 10 <> 0 then 103 else h0 end h
  from (select o_orderkey k, o_orderkey // 120 q, (o_orderkey * 7919) % 120 h0,
    cast(o_totalprice as decimal(14,2)) amt, o_custkey c,
    case n_regionkey % 4 when 0 then 'us-east' when 1 then 'us-west'
      when 2 then 'eu-west' else 'ap-south' end region
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)),
j as (
  select *, h * 3600 + (k * 104729) % 1500 s,
    (q * 37 + k) % 100 < (case when h = 100 and region = 'ap-south' then 65 else 3 end) failed,
    (q * 53 + k) % 100 < (case when h = 60 and region = 'eu-west' then 65 else 4 end) late,
    (q * 71 + k) % 100 < (case when h = 101 and region = 'us-west' then 50 else 2 end) refund
  from o),
v as (
  select 0 i, 'customer_login' t, 'authenticated' st, s - 60 s2, k, c, region,
    cast(null as decimal(14,2)) amt, true cu, false od, false pr from j
  union all select 1, 'order_created', 'created', s, k, c, region, amt, true, true, true from j
  union all select 2, case when failed then 'payment_failed' else 'payment_processed' end,
    case when failed then 'failed' else 'paid' end, s + 120, k, c, region, amt, true, true, true
    from j
  union all select 3, 'shipment_created', 'shipped', s + 300, k, c, region, null, true, true, true
    from j where not failed
  union all select 4, 'shipment_delayed', 'delayed', s + 7200, k, c, region, null, true, true, true
    from j where not failed and late
  union all select 5, 'refund_requested', 'requested', s + 1800, k, c, region, amt, true, true, true
    from j where not failed and refund
  union all select 6, 'inventory_updated', 'updated', s + 360, k, c, region, null, false, false,
    true from j),
m as (select *, md5(concat(t, ':', cast(k as varchar))) d from v),
e as (
  select 1 schema_version,
    concat(substr(d,1,8), '-', substr(d,9,4), '-4', substr(d,14,3), '-a', substr(d,18,3), '-',
      substr(d,21,12)) event_id,
    t event_type, timestamp '2026-09-01 00:00:00' + to_seconds(s2) event_ts,
    case when cu then concat('customer-', cast(c as varchar)) end customer_id,
    case when od then concat('order-', cast(k as varchar)) end order_id,
    case when pr then concat('product-', cast(k % 80 as varchar)) end product_id,
    amt amount, 'USD' currency,
    case when i = 2 then case k % 3 when 0 then 'stripe' when 1 then 'adyen' else 'paypal' end end
      payment_provider,
    case when i in (3, 4) then case k % 3 when 0 then 'ups' when 1 then 'fedex' else 'dhl' end end
      shipment_provider,
    region, st status,
    case when i = 6 then concat('{"quantity":', cast(k % 1000 as varchar), ',"synthetic":true}')
      else '{"synthetic":true}' end metadata,
    'commerce.events.v1' source_topic, cast(k % 3 as int) source_partition,
    (k // 3) * 7 + i source_offset,
    timestamp '2026-09-01 00:00:00' + to_seconds(s2) source_timestamp,
    timestamp '2026-09-01 00:00:00' + to_seconds(s2 + 60) ingested_at, k, i
  from m)"""

_FAULTY = """
f as (
  select schema_version, event_id,
    case when k % 200 = 37 and i = 6 then 'shipment_created' else event_type end event_type,
    event_ts, case when k % 200 <> 31 then customer_id end customer_id,
    case when k % 200 = 37 and i = 6 then concat('order-', cast(k as varchar)) else order_id end
      order_id,
    product_id, case when k % 200 = 23 then -amount else amount end amount, currency,
    payment_provider, shipment_provider, region,
    case when k % 200 = 17 and i in (1, 2) then 'wrong'
      when k % 200 = 37 and i = 6 then 'shipped' else status end status,
    metadata, source_topic, source_partition,
    case when k % 200 = 29 and i = 0 then source_offset + 1 else source_offset end source_offset,
    source_timestamp, ingested_at
  from e where not (k % 200 = 41 and i = 1))"""

_PROCESSED = """
p as (
  select * exclude (event_ts, source_timestamp, ingested_at), event_ts event_timestamp,
    source_timestamp kafka_timestamp,
    event_ts + to_seconds(k % 7 * 13 + i + 1) processed_at,
    cast((k % 7 * 13 + i + 1) * 1000 as double) processing_latency_ms,
    date_trunc('hour', event_ts) event_hour
  from e)"""

_ENVELOPES = """
body as (
  select *, case when i = 1 then k % 200 else -1 end r, concat('{"schema_version":1',
    case when i = 1 and k % 200 = 13 then '' else concat(',"event_id":"', event_id, '"') end,
    ',"event_type":"', event_type, '","timestamp":"',
    strftime(event_ts, '%Y-%m-%dT%H:%M:%S'), 'Z"',
    case when customer_id is not null then concat(',"customer_id":"', customer_id, '"') else '' end,
    case when order_id is not null then concat(',"order_id":"', order_id, '"') else '' end,
    case when product_id is not null then concat(',"product_id":"', product_id, '"') else '' end,
    case when amount is not null then concat(',"amount":', cast(amount as varchar)) else '' end,
    ',"currency":"USD"',
    case when payment_provider is not null
      then concat(',"payment_provider":"', payment_provider, '"') else '' end,
    case when shipment_provider is not null
      then concat(',"shipment_provider":"', shipment_provider, '"') else '' end,
    ',"region":"', region, '","status":"',
    case when i = 1 and k % 200 = 19 then 'wrong' else status end, '"',
    case when i = 1 and k % 200 = 17 then ',"coupon":"x"' else '' end,
    ',"metadata":', metadata, '}') b
  from e),
env as (
  select source_topic topic, source_partition "partition", source_offset + shift "offset",
    source_timestamp "timestamp", encode(coalesce(order_id, customer_id, product_id)) "key",
    case when r = 11 then encode(substr(b, 1, 40))
      when r = 23 then cast('\\xFF' as blob) || encode(b) else encode(b) end "value"
  from body, unnest(case when r = 7 then [0, 1000000000] else [0] end) s(shift)),
txt as (select *, try(decode("value")) raw_value from env),
js as (select *, coalesce(json_valid(raw_value), false) ok from txt)"""

_PARTS = {"e": "", "f": _FAULTY, "p": _PROCESSED, "env": _ENVELOPES}


def with_log(sql: str, *parts: str) -> str:
    """`with <derived logs>, <rest of sql>`; `sql` starts with `select` or more CTEs."""
    ctes = [_JOURNEYS, *[_PARTS[p] for p in parts if _PARTS[p]]]
    text = sql.strip()
    if text.lower().startswith("with "):
        return "with recursive " + ",".join(ctes) + ",\n" + text[5:]
    return "with " + ",".join(ctes) + "\n" + text
