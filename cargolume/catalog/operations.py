"""Publication ledger, serving reads and operational summaries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from cargolume import contract as c
from cargolume.catalog import detection
from cargolume.catalog.logs import with_log
from cargolume.catalog.models import HOURLY, marts_sql
from cargolume.catalog.registry import query
from cargolume.operators import quality
from cargolume.plans import ops, publication
from cargolume.plans.build import build_models
from cargolume.session import scratch_dir
from cargolume.sources.derived_log import event_log
from cargolume.sources.tables import table

# A build ledger that grows with the orders: one attempt per order date.
_BUILDS = """
select concat('b-', cast(cast(o_orderdate as date) as {text})) build_id,
  concat('key-', cast(cast(o_orderdate as date) as {text})) build_key,
  case when n % 5 = 0 then 'failed' when n % 7 = 0 then 'running' else 'succeeded' end status,
  {ts} started_at,
  case when n % 5 <> 0 and n % 7 = 0 then null else {ts} + interval '20' minute end completed_at,
  case when n % 5 <> 0 and n % 7 <> 0 then {ts} + interval '20' minute end published_at,
  {ts} source_max_event_ts, {ts} + interval '1' minute source_max_ingested_at,
  n source_event_count, cast(null as {text}) manifest_sha256,
  case when n % 5 = 0 then concat('checks failed: ', cast(n as {text})) end failure_reason
from (select o_orderdate, count(*) n from {orders} group by o_orderdate) d"""
_SQL_BUILDS = "bl as (" + _BUILDS.format(text="varchar", ts="o_orderdate", orders="orders") + ")"
_RUNS = """rn as (select build_id run_id, started_at, completed_at, case when status = 'running'
  then 'running' when source_event_count % 3 = 0 then 'skipped' else 'succeeded' end status,
  case when status <> 'running' and source_event_count % 3 = 0 then 'stale_publication' end
  skip_reason from bl)"""
_QUAL = """ql as (select build_id, source_event_count pass_count, source_event_count * 2
  success_count from bl where status = 'succeeded' and source_event_count % 2 = 0)"""


def ops_sql(select: str) -> str:
    return f"with {_SQL_BUILDS},\n{_RUNS},\n{_QUAL}\n{select}"


def builds(spark, sf):
    text = _BUILDS.format(text="string", ts="timestamp_seconds(unix_date(cast(o_orderdate as date)) * 86400L)", orders="{orders}")  # noqa: E501
    return spark.sql(text, orders=table(spark, sf, "orders"))


def detector_runs(spark, sf):
    return builds(spark, sf).selectExpr(
        "build_id run_id",
        "started_at",
        "completed_at",
        "case when status = 'running' then 'running' when source_event_count % 3 = 0 "
        "then 'skipped' else 'succeeded' end status",
        "case when status <> 'running' and source_event_count % 3 = 0 "
        "then 'stale_publication' end skip_reason",
    )


def quality_runs(spark, sf):
    return builds(spark, sf).filter("status = 'succeeded' and source_event_count % 2 = 0").selectExpr(
        "build_id", "source_event_count pass_count", "source_event_count * 2 success_count"
    )


def now():
    return F.lit("2001-08-02 00:00:00Z").cast("timestamp")


_NOW = "timestamp '2001-08-02 00:00:00'"
_LATEST = "(select * from bl where status = 'succeeded' order by published_at desc, build_id desc limit 1)"


@query(
    "source_watermark",
    with_log(
        """select max(event_ts) source_max_event_ts, max(ingested_at) source_max_ingested_at,
        count(*) source_event_count from e"""
    ),
)
def _(spark, sf):
    return publication.source_watermark(event_log(spark, sf))


@query(
    "latest_successful_build",
    ops_sql(f"select build_id, published_at, source_event_count from {_LATEST}"),
)
def _(spark, sf):
    return publication.latest_successful_build(builds(spark, sf)).select(
        "build_id", "published_at", "source_event_count"
    )


@query(
    "build_context",
    ops_sql(
        f"""select build_id, published_at, floor(epoch({_NOW}) - epoch(published_at))::bigint
        age_seconds, case when epoch({_NOW}) - epoch(published_at) > 7200 then 'stale' else 'fresh'
        end state from {_LATEST}"""
    ),
)
def _(spark, sf):
    latest = publication.latest_successful_build(builds(spark, sf))
    return publication.build_context(latest, now()).select(
        "build_id", "published_at", "age_seconds", "state"
    )


@query(
    "latest_failure_reason",
    ops_sql(
        """select failure_reason latest_failure_reason from bl where status = 'failed'
        order by completed_at desc limit 1"""
    ),
)
def _(spark, sf):
    return publication.latest_failure_reason(builds(spark, sf))


@query(
    "quality_state",
    ops_sql(
        f"""select (select max(started_at) from bl where status = 'running')
        running_build_started_at, (select max(completed_at) from bl where status = 'failed')
        latest_failed_build_at, (select failure_reason from bl where status = 'failed'
        order by completed_at desc limit 1) latest_failure_reason,
        (select case when epoch({_NOW}) - epoch(max(published_at)) > 7200 then 'stale'
        when max(published_at) is null then 'unavailable' else 'fresh' end
        from bl where status = 'succeeded') state"""
    ),
)
def _(spark, sf):
    return publication.quality_state(builds(spark, sf), now())


@query(
    "consecutive_failures",
    ops_sql(
        """select count(*) filter (where broken = 0) consecutive_failures from (select sum(case when
        status <> 'failed' then 1 else 0 end) over (order by started_at desc, build_id desc) broken
        from bl)"""
    ),
)
def _(spark, sf):
    return publication.consecutive_failures(builds(spark, sf))


@query(
    "detector_gate",
    ops_sql(
        f"""select case when epoch({_NOW}) - epoch(published_at) <= 7200 then build_id end build_id,
        case when epoch({_NOW}) - epoch(published_at) > 7200 then 'stale_publication' end
        skip_reason from {_LATEST}"""
    ),
)
def _(spark, sf):
    return publication.detector_gate(builds(spark, sf), now())


@query(
    "publication_with_quality",
    ops_sql(
        f"""select l.build_id, published_at, source_event_count, pass_count, success_count
        from {_LATEST} l left join ql using (build_id)"""
    ),
)
def _(spark, sf):
    return publication.publication_with_quality(builds(spark, sf), quality_runs(spark, sf))


@query(
    "publication_gap",
    with_log(
        f"""with {_SQL_BUILDS} select max(ingested_at) warehouse_max_ingested_at,
        (select source_max_ingested_at from {_LATEST}) published_max_ingested_at,
        (epoch(max(ingested_at)) - epoch((select source_max_ingested_at from {_LATEST})))::double
        gap_seconds from e"""
    ),
)
def _(spark, sf):
    return ops.publication_gap(builds(spark, sf), event_log(spark, sf))


_SUMMARY_SQL = f"""
nw as (select * from bl order by started_at desc, build_id desc limit 1),
pu as (select * from {_LATEST}),
bt as (select source_partition, event_type, count(*) row_count from e group by 1, 2),
sm(metric, label, "value") as (
  select 'builds', status, count(*)::double from bl group by status
  union all select 'latest_attempt_failed', null, (status = 'failed')::int from nw
  union all select 'last_build_seconds', null, epoch(completed_at) - epoch(started_at) from nw
    where completed_at is not null
  union all select 'consecutive_failures', null, count(*) filter (where broken = 0) from (select
    sum(case when status <> 'failed' then 1 else 0 end) over (order by started_at desc, build_id desc)
    broken from bl)
  union all select 'publication_present', null, count(*) from pu
  union all select 'last_success_epoch', null, epoch(published_at) from pu
  union all select 'published_ingested_epoch', null, epoch(source_max_ingested_at) from pu
  union all select 'published_events', null, source_event_count from pu
  union all select 'quality_results', 'pass', pass_count from pu join ql using (build_id)
  union all select 'quality_results', 'success', success_count from pu join ql using (build_id)
  union all select 'committed_rows', null, count(*) from e
  union all select 'warehouse_ingested_epoch', null, epoch(max(ingested_at)) from e
  union all select 'committed_batches', null, count(*) from bt
  union all select 'inserted_rows', null, sum(row_count)::double from bt
  union all select 'detector_evaluations', concat(status, '/', coalesce(skip_reason, 'none')),
    count(*) from rn group by 2
  union all select 'incidents_created', null, count(*) from inc
  union all select 'last_evaluation_epoch', null, max(epoch(completed_at)) from rn
  union all select 'last_detector_seconds', null, epoch(completed_at) - epoch(started_at) from (
    select * from rn where completed_at is not null order by completed_at desc limit 1))"""


def summary_sql(select: str) -> str:
    return marts_sql(
        select, f"{detection._D.strip()},\n{_SQL_BUILDS},\n{_RUNS},\n{_QUAL},{_SUMMARY_SQL}"
    )


def summary(spark, sf):
    batches = event_log(spark, sf).groupBy("source_partition", "event_type").agg(
        F.count("*").alias("row_count")
    )
    return ops.ops_summary(
        builds(spark, sf),
        quality_runs(spark, sf),
        event_log(spark, sf),
        batches,
        detector_runs(spark, sf),
        detection.incidents(spark, sf),
    )


@query("ops_summary", summary_sql('select metric, label, "value"::double "value" from sm'))
def _(spark, sf):
    return summary(spark, sf)


@query(
    "ops_alerts",
    summary_sql(
        f"""select 'latest_attempt_failed' alert, (select max("value") from sm
          where metric = 'latest_attempt_failed') = 1 firing
        union all select 'repeated_failures', (select max("value") from sm
          where metric = 'consecutive_failures') >= 2
        union all select 'publication_behind_ingestion', epoch({_NOW}) - (select max("value") from sm
          where metric = 'last_success_epoch') > 3600 and (select max("value") from sm where
          metric = 'warehouse_ingested_epoch') > (select max("value") from sm where
          metric = 'published_ingested_epoch')
        union all select 'publication_missing_with_data', (select max("value") from sm
          where metric = 'publication_present') = 0
        union all select 'raw_progress_silent', false"""
    ),
)
def _(spark, sf):
    return ops.ops_alerts(summary(spark, sf), now())


@query(
    "snapshot_fingerprint",
    with_log(
        """select count(*) event_count, count(distinct event_id) distinct_ids,
        count(distinct (source_topic, source_partition, source_offset)) distinct_sources,
        sum(amount)::double total_amount, count(*) <> count(distinct event_id) or
        count(*) <> count(distinct (source_topic, source_partition, source_offset)) has_duplicates
        from f""",
        "f",
    ),
)
def _(spark, sf):
    from cargolume.sources.derived_log import faulty_log

    return ops.snapshot_fingerprint(faulty_log(spark, sf))


_P = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "latency_percentiles",
    """select event_type, count(*) samples, round(avg("value"), 6) mean,
    round(quantile_cont("value", 0.5), 6) p50, round(quantile_cont("value", 0.95), 6) p95,
    round(quantile_cont("value", 0.99), 6) p99 from events group by 1""",
)
def _(spark, sf):
    found = ops.exact_percentiles(table(spark, sf, "events"), "event_type", "value", _P)
    return found.withColumns({name: F.round(name, 6) for name in ("mean", *_P)})


@query(
    "nearest_rank_percentile",
    """select event_type, n samples, p50, p95, p99 from (select event_type, max(n) n,
    max(case when r = floor((n - 1) * 0.5::double) then "value" end) p50,
    max(case when r = floor((n - 1) * 0.95::double) then "value" end) p95,
    max(case when r = floor((n - 1) * 0.99::double) then "value" end) p99
    from (select event_type, "value", row_number() over (partition by event_type order by "value")
    - 1 r, count(*) over (partition by event_type) n from events) group by 1)""",
)
def _(spark, sf):
    return ops.exact_percentiles(
        table(spark, sf, "events"), "event_type", "value", _P, interpolate=False
    ).drop("mean")


# ---- publication and serving --------------------------------------------------------------


def published(spark, sf):
    """Build, check, publish: returns the store and its one build id."""
    root = scratch_dir(spark, "published")
    models = build_models(event_log(spark, sf), f"{root}/models")
    stg = models["stg_stream_events"]
    store = publication.Publications(spark, f"{root}/product")
    build_id = store.begin("nightly")
    counts = quality.check_columns(
        stg, ("event_id", "region"), {"status": tuple(c.STATUS_OF_TYPE.values())}
    )
    results = counts.selectExpr(
        "concat_ws('.', check, column_name) unique_id",
        "if(violations = 0, 'pass', 'fail') status",
    )
    store.publish(build_id, models, results)
    return store, build_id


@query(
    "publish_build",
    marts_sql(
        """select 'succeeded' status, (select count(*) from e) source_event_count,
        (select max(ingested_at) from e) source_max_ingested_at,
        (select sum(revenue_amount::decimal(24,2))::double from revenue) published_revenue,
        (select count(*) from health) operations_rows, (select count(*) from e where event_type not
        in ('customer_login', 'inventory_updated')) evidence_rows"""
    ),
)
def _(spark, sf):
    store, _ = published(spark, sf)
    scalar = lambda name, agg: store.snapshot(name).agg(agg.alias("x")).scalar()
    return store.builds().select(
        "status",
        "source_event_count",
        "source_max_ingested_at",
        scalar("revenue", F.sum("revenue_amount")).alias("published_revenue"),
        scalar("operations", F.count("*")).alias("operations_rows"),
        scalar("evidence", F.count("*")).alias("evidence_rows"),
    )


@query(
    "metric_range_read",
    marts_sql(
        """select payment_hour_utc, payment_attempt_count, failed_payment_count, failure_rate, false more
        from payments where region_code = 'us-east' and payment_hour_utc >=
        timestamp '2026-09-02 00:00:00' and payment_hour_utc < timestamp '2026-09-04 00:00:00'"""
    ),
)
def _(spark, sf):
    # Two published builds; the read prunes one and pushes the hours and the region to the files.
    path = scratch_dir(spark, "snapshot")
    mart = HOURLY["payments"](spark, sf)
    for build in ("b0", "b1"):
        mart.write.parquet(f"{path}/build_id={build}")
    return publication.metric_range_read(
        spark.read.parquet(path),
        "payment_hour_utc",
        "b1",
        datetime(2026, 9, 2, tzinfo=UTC),
        datetime(2026, 9, 4, tzinfo=UTC),
        "us-east",
    ).select(
        "payment_hour_utc", "payment_attempt_count", "failed_payment_count", "failure_rate", "more"
    )


@query(
    "incident_page",
    detection.detect_sql(
        """select uniqueness_key incident_id, detector_name, region_code, detected_at from inc
        where detected_at < timestamp '2026-09-05 05:00:00'
        order by detected_at desc, uniqueness_key desc limit 6"""
    ),
)
def _(spark, sf):
    rows = detection.incidents(spark, sf).withColumnRenamed("uniqueness_key", "incident_id")
    page = publication.incident_page(
        rows, 5, status="open", before=(datetime(2026, 9, 5, 5, tzinfo=UTC), "")
    )
    return page.select("incident_id", "detector_name", "region_code", "detected_at")


@query(
    "incident_evidence_top100",
    detection.detect_sql(
        """select source_event_id, evidence_role, event_ts from ie where uniqueness_key =
        (select max(uniqueness_key) from inc) order by event_ts, source_event_id limit 100"""
    ),
)
def _(spark, sf):
    found = detection.incidents(spark, sf)
    key = found.agg(F.max("uniqueness_key")).first()[0]
    linked = detection.detectors.incident_evidence(
        found.filter(F.col("uniqueness_key") == key), detection.all_evidence(spark, sf)
    )
    return publication.incident_evidence_top(linked, key or "").select(
        "source_event_id", "evidence_role", "event_ts"
    )


# The original build lacks all refund evidence, so refund incidents lose their references.
_LINEAGE = """
rk as (select *, row_number() over (partition by uniqueness_key order by event_ts,
  source_event_id) pos, count(*) over (partition by uniqueness_key) total from ie),
ln as (select uniqueness_key, max(total) source_reference_count, count(*) references_included,
  count(*) filter (where evidence_role = 'refund_request') missing_in_original_build
  from rk where pos <= 12 group by 1)"""


def _lineage_inputs(spark, sf):
    found = detection.incidents(spark, sf)
    proof = detection.all_evidence(spark, sf)
    linked = detection.detectors.incident_evidence(found, proof)
    original = proof.filter("evidence_kind <> 'refund_request'").withColumn(
        "build_id", F.lit(detection.BUILD)
    )
    return found, linked, original


@query(
    "evidence_lineage_check",
    marts_sql(
        """select inc.uniqueness_key, detector_name, source_reference_count, references_included,
        missing_in_original_build from inc left join ln using (uniqueness_key)""",
        f"{detection._D.strip()},{_LINEAGE}",
    ),
)
def _(spark, sf):
    found, linked, original = _lineage_inputs(spark, sf)
    return publication.evidence_lineage(linked, found, original).select(
        "uniqueness_key",
        "detector_name",
        "source_reference_count",
        "references_included",
        "missing_in_original_build",
    )


@query(
    "evidence_bundle",
    marts_sql(
        f"""select inc.uniqueness_key, references_included,
        (select build_id from {_LATEST}) current_build_id,
        (select published_at from {_LATEST}) current_published_at,
        (select max(completed_at) from bl where status = 'failed') latest_failed_at,
        (select max(started_at) from bl where status = 'running') running_at
        from inc left join ln using (uniqueness_key)""",
        f"{detection._D.strip()},{_LINEAGE},\n{_SQL_BUILDS}",
    ),
)
def _(spark, sf):
    found, linked, original = _lineage_inputs(spark, sf)
    return publication.evidence_bundle(found, linked, original, builds(spark, sf)).select(
        "uniqueness_key",
        "references_included",
        "current_build_id",
        "current_published_at",
        "latest_failed_at",
        "running_at",
    )
