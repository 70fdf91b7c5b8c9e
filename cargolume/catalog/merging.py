"""Deduplication, insert-ignore merge, upserts, ledger and minute metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolume import contract as c
from cargolume.catalog.logs import with_log
from cargolume.catalog.registry import query
from cargolume.operators import merge, metrics
from cargolume.sources.derived_log import event_log, processed_log

# The batch: the whole log, every payment a second time (upper-cased id, later offset), and
# every us-east login again under another id on its order's source position. The table: all
# events of the first two days.
_BATCH = """
bt as (
  select event_id, event_type, event_ts, amount, source_topic, source_partition, source_offset,
    ingested_at from e
  union all select upper(event_id), event_type, event_ts, amount, source_topic, source_partition,
    source_offset + 1000000000, ingested_at from e where event_type like 'payment%'
  union all select concat(event_id, 'x'), event_type, event_ts, amount, source_topic,
    source_partition, source_offset + 1, ingested_at from e where event_type = 'customer_login' and region = 'us-east'),
ex as (select * from e where event_ts < timestamp '2026-09-03'),
cand as (select * replace (lower(event_id) as event_id), row_number() over (
  partition by lower(event_id) order by source_topic, source_partition, source_offset) rn from bt),
dd as (select * from cand where rn = 1),
na as (select * from dd where not exists (select 1 from ex where ex.event_id = dd.event_id)),
ns as (select * from dd where not exists (select 1 from ex where ex.source_topic = dd.source_topic
  and ex.source_partition = dd.source_partition and ex.source_offset = dd.source_offset)),
nb as (select *, row_number() over (partition by source_topic, source_partition, source_offset
  order by event_id) rs from na where not exists (select 1 from ex
  where ex.source_topic = na.source_topic and ex.source_partition = na.source_partition
  and ex.source_offset = na.source_offset)),
ins as (select * from nb where rs = 1)"""
_COLS = "event_id, event_type, event_ts, source_topic, source_partition::bigint source_partition, source_offset"


def merge_sql(select: str) -> str:
    return with_log(f"with {_BATCH.strip()}\n{select}")


def _batch(spark, sf):
    log = event_log(spark, sf)
    again = log.filter("event_type like 'payment%'").selectExpr(
        "* except (event_id, source_offset)",
        "upper(event_id) event_id",
        "source_offset + 1000000000 source_offset",
    )
    clash = log.filter("event_type = 'customer_login' and region = 'us-east'").selectExpr(
        "* except (event_id, source_offset)",
        "concat(event_id, 'x') event_id",
        "source_offset + 1 source_offset",
    )
    return log.unionByName(again).unionByName(clash)


def _existing(spark, sf):
    return event_log(spark, sf).filter("event_ts < timestamp'2026-09-03 00:00:00Z'")


_KEEP = ["event_id", "event_type", "event_ts", *c.SOURCE_KEY]


@query("dedup_candidates", merge_sql(f"select {_COLS} from dd"))
def _(spark, sf):
    return merge.dedup_candidates(_batch(spark, sf)).select(*_KEEP)


@query("anti_existing_event_ids", merge_sql(f"select {_COLS} from na"))
def _(spark, sf):
    candidates = merge.dedup_candidates(_batch(spark, sf))
    return merge.anti_existing_event_ids(candidates, _existing(spark, sf)).select(*_KEEP)


@query("anti_existing_source", merge_sql(f"select {_COLS} from ns"))
def _(spark, sf):
    candidates = merge.dedup_candidates(_batch(spark, sf))
    return merge.anti_existing_source(candidates, _existing(spark, sf)).select(*_KEEP)


@query("merge_new_events", merge_sql(f"select {_COLS} from ins"))
def _(spark, sf):
    return merge.merge_new_events(_batch(spark, sf), _existing(spark, sf)).select(*_KEEP)


_MINUTE = """date_trunc('minute', event_ts) window_start,
  date_trunc('minute', event_ts) + interval 1 minute window_end, event_type,
  count(*) event_count, coalesce(sum(amount), 0)::double total_amount,
  max(ingested_at) updated_at"""


@query("minute_totals_b", with_log(f"select {_MINUTE} from e group by 1, 2, 3"))
def _(spark, sf):
    return metrics.minute_totals(event_log(spark, sf))


@query(
    "stg_stream_metrics_minute",
    with_log(f"select {_MINUTE} from e group by 1, 2, 3"),
)
def _(spark, sf):
    from cargolume.plans.staging import stg_minute_metrics

    return stg_minute_metrics(metrics.minute_totals(event_log(spark, sf)))


@query(
    "upsert_minute_additive_b",
    merge_sql(
        f"select {_MINUTE} from (select event_ts, event_type, amount, ingested_at from ex "
        "union all select event_ts, event_type, amount, ingested_at from ins) group by 1, 2, 3"
    ),
)
def _(spark, sf):
    existing = _existing(spark, sf)
    fresh = merge.merge_new_events(_batch(spark, sf), existing)
    return merge.upsert_minute_additive(metrics.minute_totals(existing), metrics.minute_totals(fresh))


_MINUTE_A = """minute_start, minute_start + interval 1 minute minute_end, region,
  count(*) event_count, count(*) filter (where event_type = 'order_created') order_count,
  count(*) filter (where event_type = 'payment_processed') successful_payment_count,
  count(*) filter (where event_type = 'payment_failed') failed_payment_count,
  count(*) filter (where event_type in ('payment_processed', 'payment_failed'))
    payment_attempt_count,
  coalesce(sum(amount) filter (where event_type = 'payment_processed'), 0)::double
    successful_revenue,
  coalesce(count(*) filter (where event_type = 'payment_failed')::double / nullif(count(*) filter
    (where event_type in ('payment_processed', 'payment_failed')), 0), 0) payment_failure_rate,
  count(*) filter (where event_type = 'shipment_created') shipment_created_count,
  count(*) filter (where event_type = 'shipment_delayed') shipment_delayed_count,
  count(*) filter (where event_type = 'refund_requested') refund_request_count,
  round(avg(processing_latency_ms), 6) avg_processing_latency_ms, max(processed_at) updated_at
  from (select *, date_trunc('minute', event_timestamp) minute_start from p)"""


def _rounded(frame):
    return frame.withColumn(
        "avg_processing_latency_ms", F.round("avg_processing_latency_ms", 6)
    )


@query("minute_metrics_a", with_log(f"select {_MINUTE_A} group by 1, 2, 3", "p"))
def _(spark, sf):
    return _rounded(metrics.minute_metrics_a(processed_log(spark, sf)))


@query(
    "upsert_minute_replace_a",
    with_log(
        f"""with fresh as (select {_MINUTE_A} where event_timestamp >= timestamp '2026-09-02' group by 1, 2, 3),
        old as (select {_MINUTE_A} where event_timestamp < timestamp '2026-09-03' group by 1, 2, 3)
        select * from fresh union all select * from old where (minute_start, region) not in
          (select (minute_start, region) from fresh)""",
        "p",
    ),
)
def _(spark, sf):
    log = processed_log(spark, sf)
    old = log.filter("event_timestamp < timestamp'2026-09-03 00:00:00Z'")
    fresh = log.filter("event_timestamp >= timestamp'2026-09-02 00:00:00Z'")
    old, fresh = (_rounded(metrics.minute_metrics_a(part)) for part in (old, fresh))
    return merge.replace_by_key(old, fresh, ["minute_start", "region"])


@query(
    "reconcile_minute_metrics",
    with_log(
        f"""with st as (select {_MINUTE} from e where not (event_type = 'payment_failed' and region = 'us-west') group by 1, 2, 3),
        full_set as (select {_MINUTE} from e group by 1, 2, 3)
        select coalesce(f.window_start, st.window_start) window_start,
          coalesce(f.event_type, st.event_type) event_type, f.event_count expected_count,
          f.total_amount expected_amount, st.event_count stored_count,
          st.total_amount stored_amount
        from full_set f full join st
          on f.window_start = st.window_start and f.event_type = st.event_type
        where f.event_count is distinct from st.event_count
          or f.total_amount is distinct from st.total_amount"""
    ),
)
def _(spark, sf):
    stored = metrics.minute_totals(
        event_log(spark, sf).filter("not (event_type = 'payment_failed' and region = 'us-west')")
    )
    return metrics.reconcile_minute_metrics(event_log(spark, sf), stored)


@query(
    "incremental_delete_insert",
    with_log(
        """select event_id source_event_id, order_id, case when event_ts >= timestamp '2026-09-03'
        then 'updated' else 'kept' end origin from e where event_type = 'order_created'"""
    ),
)
def _(spark, sf):
    # The target already holds the first three days; the new scan starts on the third.
    orders = event_log(spark, sf, ("order_created",))
    shape = ("event_id source_event_id", "order_id")
    target = orders.filter("event_ts < timestamp'2026-09-04 00:00:00Z'").selectExpr(*shape, "'kept' origin")
    source = orders.filter("event_ts >= timestamp'2026-09-03 00:00:00Z'").selectExpr(*shape, "'updated' origin")
    return merge.incremental_delete_insert(target, source)


@query(
    "stage_identity",
    with_log(
        """select distinct source_partition::bigint batch_id, concat('stage_', substr(sha256(
        concat(source_topic, ':', source_partition)), 1, 24)) stage from e"""
    ),
)
def _(spark, sf):
    name = F.sha2(F.concat_ws(":", "source_topic", "source_partition"), 256)
    return (
        event_log(spark, sf)
        .select(F.col("source_partition").alias("batch_id"), "source_topic", "source_partition")
        .distinct()
        .select("batch_id", F.concat(F.lit("stage_"), F.substring(name, 1, 24)).alias("stage"))
    )
