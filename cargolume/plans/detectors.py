"""Statistical incident detectors over the hourly marts, all regions and hours in one plan.

The marts hold at most hours x regions rows, so windows partitioned by region and the
broadcast of incidents are bounded by time covered and never by event volume.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolume.contract import REGIONS
from cargolume.functions.exprs import utc_hour, utc_text

VERSION = "1.0.0"
COOLDOWN_HOURS = 6
BASELINE_HOURS = 24
EVIDENCE_CAP = 25
STALE_SECONDS = 7200

# Evidence kinds that support each detector.
EVIDENCE_KINDS = {
    "payment_failure_rate_increase": ("payment_attempt",),
    "shipment_delay_rate_increase": ("shipment_cohort", "shipment_delay"),
    "refund_request_spike": ("refund_request",),
    "order_volume_drop": ("order",),
}

INCIDENT_COLUMNS = (
    "uniqueness_key",
    "detector_name",
    "detector_version",
    "region_code",
    "evaluation_start",
    "evaluation_end",
    "observed_metric",
    "observed_denominator",
    "baseline_metric",
    "threshold",
    "severity",
    "summary",
    "analytics_build_id",
    "detected_at",
    "status",
)


def _past_day(hour: str) -> Window:
    """The 24 hours before the current one, by time and not by row, so gaps stay gaps."""
    return (
        Window.partitionBy("region_code")
        .orderBy(F.unix_seconds(hour))
        .rangeBetween(-BASELINE_HOURS * 3600, -1)
    )


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def baseline_windows(mart: DataFrame, hour: str, rate: str) -> DataFrame:
    """Adds the count and unweighted mean of the past day's hourly rates (NULLs ignored)."""
    past = _past_day(hour)
    total = F.sum(F.col(rate).cast("decimal(12,6)")).over(past).cast("decimal(18,6)")
    number = F.count(rate).over(past)
    return mart.withColumn("baseline_windows", number).withColumn(
        "baseline", total / F.nullif(number, F.lit(0)).cast("decimal(12,0)")
    )


def _candidates(
    frame: DataFrame, name: str, hour: str, detected_at: Column, denominator: Column, summary: Column
) -> DataFrame:
    return frame.select(
        F.lit(name).alias("detector_name"),
        "region_code",
        F.col(hour).alias("evaluation_start"),
        (F.col(hour) + F.make_dt_interval(hours=F.lit(1))).alias("evaluation_end"),
        F.col("observed").cast("decimal(24,6)").alias("observed_metric"),
        denominator.cast("bigint").alias("observed_denominator"),
        F.col("baseline").cast("decimal(24,6)").alias("baseline_metric"),
        F.col("limit").cast("decimal(24,6)").alias("threshold"),
        F.when(F.col("critical"), "critical").otherwise("warning").alias("severity"),
        summary.alias("summary"),
        detected_at.alias("detected_at"),
    )


def _fixed(c: str, digits: int) -> Column:
    return F.bround(F.col(c), digits).cast(f"decimal(24,{digits})").cast("string")


def _hours_after(hour: str, hours: int) -> Column:
    return F.col(hour) + F.make_dt_interval(hours=F.lit(hours))


def rate_increase(
    mart: DataFrame,
    name: str,
    hour: str,
    numerator: str,
    denominator: str,
    rate: str,
    min_denominator: int,
    increase: str,
    detected_after_hours: int,
    multiplier: str = "1.5",
    min_windows: int = 6,
) -> DataFrame:
    """Rate at or above max(mean + increase, mean x multiplier) of its past day."""
    step, factor = F.lit(increase).cast("decimal(4,2)"), F.lit(multiplier).cast("decimal(2,1)")
    judged = (
        baseline_windows(mart, hour, rate)
        .filter((F.col(denominator) >= min_denominator) & (F.col("baseline_windows") >= min_windows))
        .withColumn("observed", _exact(numerator) / _exact(denominator))
        .withColumn("limit", F.greatest(F.col("baseline") + step, F.col("baseline") * factor))
        .filter(F.col("observed") >= F.col("limit"))
        .withColumn("critical", F.col("observed") >= F.col("limit") + step)
    )
    summary = F.concat(
        F.lit(f"{name} observed "), _fixed("observed", 3), F.lit(" versus baseline "), _fixed("baseline", 3)
    )
    return _candidates(
        judged, name, hour, _hours_after(hour, detected_after_hours), F.col(denominator), summary
    )


def payment_failure_rate(payments: DataFrame) -> DataFrame:
    return rate_increase(
        payments,
        "payment_failure_rate_increase",
        "payment_hour_utc",
        "failed_payment_count",
        "payment_attempt_count",
        "failure_rate",
        min_denominator=20,
        increase="0.10",
        detected_after_hours=1,
    )


def shipment_delay_rate(shipments: DataFrame) -> DataFrame:
    """Judged a day later, when the creation cohort is mature."""
    return rate_increase(
        shipments,
        "shipment_delay_rate_increase",
        "shipment_creation_hour_utc",
        "delayed_shipment_count",
        "shipment_created_count",
        "delayed_shipment_rate",
        min_denominator=10,
        increase="0.15",
        detected_after_hours=25,
    )


def refund_spike(operations: DataFrame) -> DataFrame:
    """Refunds per order at or above max(2 x mean, mean + 0.05)."""
    hour = "metric_hour_utc"
    double, step = F.lit(2).cast("decimal(2,0)"), F.lit("0.05").cast("decimal(4,2)")
    judged = (
        baseline_windows(operations, hour, "refund_requests_per_order")
        .filter((F.col("order_count") >= 20) & (F.col("baseline_windows") >= 6))
        .withColumn("observed", _exact("refund_request_count") / _exact("order_count"))
        .withColumn("limit", F.greatest(F.col("baseline") * double, F.col("baseline") + step))
        .filter(F.col("observed") >= F.col("limit"))
        .withColumn("critical", F.col("observed") >= F.col("limit") * double)
    )
    summary = F.concat(
        F.lit("Refund requests per order reached "),
        _fixed("observed", 3),
        F.lit(" from baseline "),
        _fixed("baseline", 3),
    )
    return _candidates(
        judged, "refund_request_spike", hour, _hours_after(hour, 1), F.col("order_count"), summary
    )


def region_hour_grid(operations: DataFrame) -> DataFrame:
    """Every region x hour between the first and last hour, from one aggregated row."""
    hours = F.sequence("first", "last", F.make_dt_interval(hours=F.lit(1)))
    return (
        operations.agg(
            F.min("metric_hour_utc").alias("first"), F.max("metric_hour_utc").alias("last")
        )
        .filter(F.col("first").isNotNull())
        .select(F.explode(hours).alias("metric_hour_utc"))
        .select(
            "metric_hour_utc", F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region_code")
        )
    )


def order_volume_drop(operations: DataFrame) -> DataFrame:
    """Orders at or below half the mean of at least 12 present hours; no row means zero."""
    hour = "metric_hour_utc"
    present = operations.select(hour, "region_code", "order_count")
    past = _past_day(hour)
    judged = (
        region_hour_grid(operations)
        .join(present, [hour, "region_code"], "left")
        .withColumn("history", F.count("order_count").over(past))
        .withColumn("total", F.sum("order_count").over(past))
        .filter("history >= 12")
        .withColumn("observed", F.coalesce("order_count", F.lit(0)).cast("decimal(24,6)"))
        .withColumn("baseline", _exact("total") / _exact("history"))
        .filter(F.col("baseline") >= 20)
        .withColumn("limit", F.col("baseline") * F.lit("0.5").cast("decimal(2,1)"))
        .filter(F.col("observed") <= F.col("limit"))
        .withColumn(
            "critical", F.col("observed") <= F.col("baseline") * F.lit("0.25").cast("decimal(3,2)")
        )
    )
    summary = F.concat(
        F.lit("Order volume fell to "),
        F.coalesce("order_count", F.lit(0)).cast("string"),
        F.lit(" from hourly baseline "),
        _fixed("baseline", 2),
    )
    nothing = F.lit(None)
    return _candidates(judged, "order_volume_drop", hour, _hours_after(hour, 1), nothing, summary)


def backtest(payments: DataFrame, shipments: DataFrame, operations: DataFrame) -> DataFrame:
    """Candidates of all four detectors over every hour of the marts."""
    return reduce(
        DataFrame.unionByName,
        [
            payment_failure_rate(payments),
            shipment_delay_rate(shipments),
            refund_spike(operations),
            order_volume_drop(operations),
        ],
    )


def evaluate_hour(
    payments: DataFrame, shipments: DataFrame, operations: DataFrame, now: Column
) -> DataFrame:
    """Candidates of the last complete hour before `now`, as one scheduled run sees them.

    Hours outside the windows are cut before anything is computed.
    """
    hour = utc_hour(now) - F.make_dt_interval(hours=F.lit(1))

    def span(frame: DataFrame, column: str, back: int) -> DataFrame:
        end = hour - F.make_dt_interval(hours=F.lit(back))
        begin = end - F.make_dt_interval(hours=F.lit(BASELINE_HOURS))
        return frame.filter((F.col(column) >= begin) & (F.col(column) <= end))

    operations = span(operations, "metric_hour_utc", 0)
    # A region without a row in the evaluated hour still gets one, holding no counts.
    latest = operations.sparkSession.range(1).select(
        hour.alias("metric_hour_utc"),
        F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region_code"),
    )
    padded = operations.unionByName(
        latest.join(operations, ["metric_hour_utc", "region_code"], "left_anti"),
        allowMissingColumns=True,
    )
    found = backtest(
        span(payments, "payment_hour_utc", 0),
        span(shipments, "shipment_creation_hour_utc", 24),
        padded,
    )
    start = F.when(
        F.col("detector_name") == "shipment_delay_rate_increase",
        hour - F.make_dt_interval(hours=F.lit(24)),
    ).otherwise(hour)
    return found.filter(F.col("evaluation_start") == start).withColumn("detected_at", now)


def with_identity(candidates: DataFrame, build_id: Column) -> DataFrame:
    """Incident rows with their uniqueness key."""
    keyed = candidates.withColumn("analytics_build_id", build_id).withColumn(
        "detector_version", F.lit(VERSION)
    )
    key = F.sha2(
        F.concat_ws(
            "|",
            "detector_name",
            "detector_version",
            "region_code",
            utc_text("evaluation_start"),
            utc_text("evaluation_end"),
            "analytics_build_id",
        ),
        256,
    )
    return (
        keyed.withColumn("uniqueness_key", key)
        .withColumn("status", F.lit("open"))
        .select(*INCIDENT_COLUMNS)
    )


def cooldown_sequence(incidents: DataFrame) -> DataFrame:
    """Keep an incident only if none of its detector and region was kept in the last 6 hours.

    The rule is sequential, so each (detector, region) is folded in time order; such a
    group holds at most one incident per hour.
    """
    columns = incidents.columns
    seconds = COOLDOWN_HOURS * 3600
    folded = incidents.groupBy("detector_name", "region_code").agg(
        F.array_sort(
            F.collect_list(F.struct("detected_at", "uniqueness_key"))
        ).alias("timeline")
    )
    kept = folded.select(
        F.expr(
            f"""aggregate(timeline,
              named_struct('last', cast(null as bigint), 'kept', cast(array() as array<string>)),
              (acc, x) -> if(acc.last is not null and unix_seconds(x.detected_at) - acc.last <= {seconds},
                acc,
                named_struct('last', unix_seconds(x.detected_at),
                  'kept', concat(acc.kept, array(x.uniqueness_key)))),
              acc -> acc.kept)"""
        ).alias("keys")
    ).select(F.explode("keys").alias("uniqueness_key"))
    return incidents.join(kept, "uniqueness_key", "left_semi").select(*columns)


def suppress_recent(candidates: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Single run: drop candidates whose detector and region has a recent open incident."""
    recent = existing.filter(
        (F.col("status") == "open")
        & (F.col("detected_at") >= now - F.make_dt_interval(hours=F.lit(COOLDOWN_HOURS)))
    ).select("detector_name", "region_code").distinct()
    return candidates.join(recent, ["detector_name", "region_code"], "left_anti")


def insert_incidents(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: uniqueness keys not stored yet."""
    return candidates.join(existing.select("uniqueness_key"), "uniqueness_key", "left_anti").select(
        *candidates.columns
    )


def incident_evidence(
    incidents: DataFrame, evidence: DataFrame, cap: int = EVIDENCE_CAP
) -> DataFrame:
    """First `cap` evidence rows per incident by (event time, id, kind).

    Incidents are expanded to the evidence kinds they use and broadcast: at most
    4 detectors x 4 regions x hours rows. The cap is the operator's definition; it is
    applied per map task before the shuffle, so a hot hour ships `cap` rows per task.
    """
    kinds = F.create_map(
        *[x for name, values in EVIDENCE_KINDS.items() for x in (F.lit(name), F.array(*map(F.lit, values)))]
    )
    wanted = incidents.select(
        "uniqueness_key",
        "region_code",
        F.explode(kinds[F.col("detector_name")]).alias("evidence_kind"),
        F.col("evaluation_start").alias("evaluation_hour"),
    )
    linked = evidence.withColumn("evaluation_hour", utc_hour("evaluation_ts")).join(
        F.broadcast(wanted), ["evidence_kind", "region_code", "evaluation_hour"]
    )
    order = Window.partitionBy("uniqueness_key").orderBy(
        "event_ts", "source_event_id", "evidence_kind"
    )
    return (
        linked.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= cap)
        .select(
            "uniqueness_key",
            "source_event_id",
            F.col("evidence_kind").alias("evidence_role"),
            "event_ts",
        )
    )
