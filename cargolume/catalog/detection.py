"""Detectors, incidents and evidence over the whole derived log."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from cargolume.catalog.models import HOURLY, marts_sql, operations_mart
from cargolume.catalog.registry import query
from cargolume.plans import detectors, evidence, marts
from cargolume.plans.runs import DetectorRuns
from cargolume.session import scratch_dir
from cargolume.sources.derived_log import event_log
from cargolume.streaming.cooldown import KEY, start_cooldown

BUILD = "build-1"

# Baselines as integers: sum of micro-rates over n hours; all comparisons cross-multiplied.
_D = """
pw as (select payment_hour_utc hr, region_code rg, failed_payment_count a, payment_attempt_count b,
  round(failure_rate * 1000000)::bigint r from payments),
sw as (select shipment_creation_hour_utc hr, region_code rg, delayed_shipment_count a,
  shipment_created_count b, round(delayed_shipment_rate * 1000000)::bigint r from shipments),
ow as (select metric_hour_utc hr, region_code rg, refund_request_count a, order_count b,
  round(refund_requests_per_order * 1000000)::bigint r from health),
pb as (select *, count(r) over w n, coalesce(sum(r) over w, 0)::hugeint s from pw window w as
  (partition by rg order by hr range between interval 24 hour preceding and interval 1 hour preceding)),
sb as (select *, count(r) over w n, coalesce(sum(r) over w, 0)::hugeint s from sw window w as
  (partition by rg order by hr range between interval 24 hour preceding and interval 1 hour preceding)),
rb as (select *, count(r) over w n, coalesce(sum(r) over w, 0)::hugeint s from ow window w as
  (partition by rg order by hr range between interval 24 hour preceding and interval 1 hour preceding)),
grid as (select hr, rg from (select unnest(generate_series(min(hr), max(hr), interval 1 hour)) hr
  from ow), (values ('us-east'), ('us-west'), ('eu-west'), ('ap-south')) t(rg)),
vb as (select g.hr, g.rg, coalesce(ow.b, 0) b, count(ow.b) over w n,
  coalesce(sum(ow.b) over w, 0)::hugeint s from grid g left join ow using (hr, rg) window w as
  (partition by g.rg order by g.hr range between interval 24 hour preceding and interval 1 hour preceding)),
c1 as (select 'payment_failure_rate_increase' d, rg, hr, hr + interval 1 hour seen, a, b, n, s,
  100000 inc, 3 f, 2 fd, 100000 step from pb where b >= 20 and n >= 6),
c2 as (select 'shipment_delay_rate_increase' d, rg, hr, hr + interval 25 hour seen, a, b, n, s,
  150000 inc, 3 f, 2 fd, 150000 step from sb where b >= 10 and n >= 6),
c3 as (select 'refund_request_spike' d, rg, hr, hr + interval 1 hour seen, a, b, n, s,
  50000 inc, 2 f, 1 fd, null::int step from rb where b >= 20 and n >= 6),
cr as (select *, greatest(fd * (s + inc * n), f * s) lim from (
  select * from c1 union all select * from c2 union all select * from c3)),
hit as (select d, rg, hr, seen, b den, ((2 * a::hugeint * 1000000 + b) // (2 * b))::bigint / 1000000.0 obs,
  ((2 * s + n) // (2 * n))::bigint / 1000000.0 base,
  ((2 * lim + n * fd) // (2 * n * fd))::bigint / 1000000.0 thr,
  case when step is not null then a::hugeint * n * fd * 1000000 >= b * (lim + step * n * fd)
    else a::hugeint * n * fd * 1000000 >= 2 * b * lim end crit
  from cr where a::hugeint * n * fd * 1000000 >= b * lim),
cand as (
  select d detector_name, rg region_code, hr evaluation_start, hr + interval 1 hour evaluation_end,
    obs::double observed_metric, den observed_denominator, base::double baseline_metric,
    thr::double threshold, case when crit then 'critical' else 'warning' end severity,
    seen detected_at from hit
  union all
  select 'order_volume_drop', rg, hr, hr + interval 1 hour, b, null,
    ((2 * s * 1000000 + n) // (2 * n))::bigint / 1000000.0,
    ((s * 1000000 + n) // (2 * n))::bigint / 1000000.0, case when 4 * b * n <= s then 'critical' else 'warning' end,
    hr + interval 1 hour
  from vb where n >= 12 and s >= 20 * n and 2 * b * n <= s),
inc as (select *, sha256(concat_ws('|', detector_name, '1.0.0', region_code,
  strftime(evaluation_start, '%Y-%m-%dT%H:%M:%S+00:00'),
  strftime(evaluation_end, '%Y-%m-%dT%H:%M:%S+00:00'), 'build-1')) uniqueness_key from cand),
ord as (select *, row_number() over (partition by detector_name, region_code
  order by detected_at, uniqueness_key) pos from inc),
walk as (
  select detector_name, region_code, pos, uniqueness_key, true kept, detected_at last_at
    from ord where pos = 1
  union all
  select o.detector_name, o.region_code, o.pos, o.uniqueness_key,
    o.detected_at > w.last_at + interval 6 hour,
    case when o.detected_at > w.last_at + interval 6 hour then o.detected_at else w.last_at end
  from walk w join ord o on o.detector_name = w.detector_name and o.region_code = w.region_code
    and o.pos = w.pos + 1),
ev as (
  select source_event_id, 'payment_attempt' evidence_kind, payment_event_ts event_ts,
    payment_event_ts evaluation_ts, region_code from fct_payment_attempts
  union all select source_event_id, 'shipment_cohort', shipment_created_at, shipment_created_at,
    region_code from fct_shipments
  union all select x.event_id, 'shipment_delay', x.event_ts, s.shipment_created_at, s.region_code
    from fct_shipments s join e x on x.order_id = s.order_id and x.event_type = 'shipment_delayed'
  union all select source_event_id, 'refund_request', refund_requested_at, refund_requested_at,
    region_code from fct_refund_requests
  union all select source_event_id, 'order', order_created_at, order_created_at, region_code
    from fct_orders),
kinds as (select * from (values ('payment_failure_rate_increase', 'payment_attempt'),
  ('shipment_delay_rate_increase', 'shipment_cohort'),
  ('shipment_delay_rate_increase', 'shipment_delay'), ('refund_request_spike', 'refund_request'),
  ('order_volume_drop', 'order')) t(detector_name, evidence_kind)),
ie as (select * from (select i.uniqueness_key, v.source_event_id, v.evidence_kind evidence_role,
  v.event_ts, i.detector_name, i.region_code, row_number() over (partition by i.uniqueness_key
  order by v.event_ts, v.source_event_id, v.evidence_kind) rk
  from inc i join kinds using (detector_name) join ev v on v.evidence_kind = kinds.evidence_kind
    and v.region_code = i.region_code and v.evaluation_ts >= i.evaluation_start
    and v.evaluation_ts < i.evaluation_end) where rk <= 25)"""


def detect_sql(select: str) -> str:
    return marts_sql(select, _D.strip())


def frozen_marts(spark, sf):
    """(payments, shipments, operations) written once and reread, as detectors see them.

    The five hourly inputs are each computed once; everything downstream reads files of
    hours x regions rows.
    """
    root = scratch_dir(spark, "marts")
    hourly = {}
    for name, build in HOURLY.items():
        build(spark, sf).write.mode("overwrite").parquet(f"{root}/{name}")
        hourly[name] = spark.read.parquet(f"{root}/{name}")
    operations = marts.mart_operations_health_hourly(*hourly.values())
    operations.write.mode("overwrite").parquet(f"{root}/operations")
    return hourly["payments"], hourly["shipments"], spark.read.parquet(f"{root}/operations")


def candidates(spark, sf):
    return detectors.backtest(*frozen_marts(spark, sf))


def incidents(spark, sf):
    return detectors.with_identity(candidates(spark, sf), F.lit(BUILD))


def all_evidence(spark, sf):
    return evidence.analytics_evidence(event_log(spark, sf))


_SHOWN = (
    "detector_name region_code evaluation_start evaluation_end observed_metric "
    "observed_denominator baseline_metric threshold severity detected_at"
).split()
_SHOWN_SQL = """detector_name, region_code, evaluation_start, evaluation_end,
  observed_metric::double observed_metric, observed_denominator::bigint observed_denominator,
  baseline_metric::double baseline_metric, threshold::double threshold, severity, detected_at"""


def _one(name: str, detector: str, build):
    @query(name, detect_sql(f"select {_SHOWN_SQL} from cand where detector_name = '{detector}'"))
    def _(spark, sf):
        return build(spark, sf).select(*_SHOWN)


_one(
    "detect_payment_failure_rate",
    "payment_failure_rate_increase",
    lambda spark, sf: detectors.payment_failure_rate(HOURLY["payments"](spark, sf)),
)
_one(
    "detect_shipment_delay_rate",
    "shipment_delay_rate_increase",
    lambda spark, sf: detectors.shipment_delay_rate(HOURLY["shipments"](spark, sf)),
)
_one(
    "detect_refund_spike",
    "refund_request_spike",
    lambda spark, sf: detectors.refund_spike(operations_mart(spark, sf)),
)
_one(
    "detect_order_volume_drop",
    "order_volume_drop",
    lambda spark, sf: detectors.order_volume_drop(frozen_marts(spark, sf)[2]),
)


@query("backtest_detectors", detect_sql(f"select {_SHOWN_SQL} from cand"))
def _(spark, sf):
    return candidates(spark, sf).select(*_SHOWN)


@query(
    "baseline_windows",
    detect_sql(
        """select hr payment_hour_utc, rg region_code, n baseline_windows,
        ((2 * s + n) // nullif(2 * n, 0))::bigint / 1000000.0::double baseline from pb"""
    ),
)
def _(spark, sf):
    frame = detectors.baseline_windows(
        HOURLY["payments"](spark, sf), "payment_hour_utc", "failure_rate"
    )
    return frame.select(
        "payment_hour_utc",
        "region_code",
        "baseline_windows",
        F.col("baseline").cast("decimal(24,6)").alias("baseline"),
    )


@query("region_hour_grid", detect_sql("select hr metric_hour_utc, rg region_code from grid"))
def _(spark, sf):
    return detectors.region_hour_grid(operations_mart(spark, sf))


@query(
    "incident_uniqueness_key",
    detect_sql("select uniqueness_key, detector_name, region_code, severity from inc"),
)
def _(spark, sf):
    return incidents(spark, sf).select("uniqueness_key", "detector_name", "region_code", "severity")


@query(
    "incident_cooldown",
    detect_sql("select uniqueness_key, detector_name, region_code from walk where kept"),
)
def _(spark, sf):
    return detectors.cooldown_sequence(incidents(spark, sf)).select(
        "uniqueness_key", "detector_name", "region_code"
    )


@query(
    "streamed_cooldown",
    detect_sql("select uniqueness_key, detector_name, region_code, last_at detected_at from walk where kept"),
)
def _(spark, sf):
    # Incidents in files of rising time, a file a trigger; the query ends half way and restarts on its state.
    path, out = scratch_dir(spark, "incidents"), scratch_dir(spark, "cooled")
    whole = scratch_dir(spark, "incidents_whole")
    incidents(spark, sf).select("uniqueness_key", *KEY, "detected_at").write.parquet(whole)
    found = spark.read.parquet(whole)
    edges = found.agg(F.min("detected_at").alias("low"), F.max("detected_at").alias("high")).first()
    slices = 6
    step = (edges["high"] - edges["low"]) / slices if edges["low"] else timedelta(0)
    for n in range(slices):
        own = F.lit(True)
        if n:
            own &= F.col("detected_at") >= edges["low"] + n * step
        if n < slices - 1:
            own &= F.col("detected_at") < edges["low"] + (n + 1) * step
        found.filter(own).coalesce(1).write.mode("append").parquet(path)
        if n in (slices // 2 - 1, slices - 1):
            stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(path)
            start_cooldown(stream, out, {"availableNow": True}).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query(
    "insert_incidents",
    detect_sql(
        """select uniqueness_key, detector_name from inc
        where evaluation_start >= timestamp '2026-09-04'"""
    ),
)
def _(spark, sf):
    # Incidents of the first three days are stored already.
    found = incidents(spark, sf)
    stored = found.filter("evaluation_start < timestamp'2026-09-04 00:00:00Z'")
    return detectors.insert_incidents(found, stored).select("uniqueness_key", "detector_name")


@query(
    "detect_last_hour",
    detect_sql(
        f"""select {_SHOWN_SQL.replace("detected_at", "timestamp '2026-09-05 05:10:00' detected_at")}
        from cand where evaluation_start = case when detector_name = 'shipment_delay_rate_increase'
        then timestamp '2026-09-04 04:00:00' else timestamp '2026-09-05 04:00:00' end"""
    ),
)
def _(spark, sf):
    now = F.lit("2026-09-05 05:10:00Z").cast("timestamp")
    found = detectors.evaluate_hour(*frozen_marts(spark, sf), now)
    return found.select(*_SHOWN)


@query("analytics_evidence", detect_sql("select * from ev"))
def _(spark, sf):
    return all_evidence(spark, sf)


@query("evidence_shipment_delay", detect_sql("select * from ev where evidence_kind = 'shipment_delay'"))
def _(spark, sf):
    return evidence.shipment_delay_evidence(
        event_log(spark, sf, ("shipment_created", "shipment_delayed"))
    )


@query(
    "incident_evidence",
    detect_sql("select uniqueness_key, source_event_id, evidence_role, event_ts from ie"),
)
def _(spark, sf):
    return detectors.incident_evidence(incidents(spark, sf), all_evidence(spark, sf))


@query(
    "evidence_top25",
    detect_sql(
        """select detector_name, region_code, count(*) evidence_rows, min(event_ts) first_ts,
        max(event_ts) last_ts from ie group by 1, 2"""
    ),
)
def _(spark, sf):
    found = incidents(spark, sf)
    linked = detectors.incident_evidence(found, all_evidence(spark, sf))
    named = linked.join(
        found.select("uniqueness_key", "detector_name", "region_code"), "uniqueness_key"
    )
    return named.groupBy("detector_name", "region_code").agg(
        F.count("*").alias("evidence_rows"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )


# Three runs at one time: over a fresh build, over a stale one, and over marts that cannot be read.
@query(
    "recorded_evaluate",
    detect_sql(
        f"""select 1::bigint run, 'succeeded' status, null::varchar skip_reason,
        '{BUILD}' analytics_build_id, (select count(*) from cand where evaluation_start =
          case when detector_name = 'shipment_delay_rate_increase' then timestamp '2026-09-04 04:00:00'
          else timestamp '2026-09-05 04:00:00' end) created_incidents, null::varchar error_type
        union all select 2, 'skipped', 'stale_publication', null, null, null
        union all select 3, 'failed', null, null, null, 'AnalysisException'
        union all select 4, 'succeeded', null, '{BUILD}', 0, null"""
    ),
)
def _(spark, sf):
    kept = DetectorRuns(spark, scratch_dir(spark, "runs"))
    frozen = frozen_marts(spark, sf)
    at = datetime(2026, 9, 5, 5, 10, tzinfo=UTC)

    def builds(minutes):
        return spark.createDataFrame(
            [(BUILD, "succeeded", at - timedelta(minutes=minutes))],
            "build_id string, status string, published_at timestamp",
        )

    kept.evaluate(builds(10), lambda _: frozen, at)
    kept.evaluate(builds(500), lambda _: frozen, at)
    try:
        kept.evaluate(builds(10), lambda _: [spark.read.parquet(f"{kept.root}/none")] * 3, at)
    except AnalysisException:
        pass
    # The same hour again: its keys are stored and its incidents still open.
    kept.evaluate(builds(10), lambda _: frozen, at)
    order = Window.orderBy("started_at")  # four rows
    return kept.runs().select(
        F.row_number().over(order).alias("run"), "status", "skip_reason", "analytics_build_id",
        "created_incidents", "error_type",
    )
