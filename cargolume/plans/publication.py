"""Build ledger, immutable build-tagged snapshots, and the reads pinned to them."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolume.contract import BUILD_SCHEMA
from cargolume.functions.exprs import seconds_between
from cargolume.operators.quality import require_verified
from cargolume.plans.build import Models
from cargolume.plans.evidence import analytics_evidence
from cargolume.session import path_exists

STALE_SECONDS = 7200
MAX_READ_ROWS = 2000
MAX_READ_DAYS = 31

# snapshot -> (model, its hour column); the snapshot carries no surrogate keys.
SNAPSHOTS = {
    "payments": ("mart_payment_health_hourly", "payment_hour_utc"),
    "revenue": ("mart_revenue_hourly", "revenue_hour_utc"),
    "shipments": ("mart_shipment_health_hourly", "shipment_creation_hour_utc"),
    "refunds": ("mart_refunds_hourly", "refund_request_hour_utc"),
    "operations": ("mart_operations_health_hourly", "metric_hour_utc"),
}


# ---- ledger reads (DataFrame in, DataFrame out) ----------------------------------------


def current_builds(ledger: DataFrame) -> DataFrame:
    """Latest recorded state of each build."""
    newest = Window.partitionBy("build_id").orderBy(F.desc("recorded_at"))
    return (
        ledger.withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .drop("_rank", "recorded_at")
    )


def source_watermark(stg: DataFrame) -> DataFrame:
    return stg.agg(
        F.max("event_ts").alias("source_max_event_ts"),
        F.max("ingested_at").alias("source_max_ingested_at"),
        F.count("*").alias("source_event_count"),
    )


def latest_successful_build(builds: DataFrame) -> DataFrame:
    return (
        builds.filter("status = 'succeeded'")
        .orderBy(F.desc("published_at"), F.desc("build_id"))
        .limit(1)
    )


def build_context(build: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    age = F.greatest(F.lit(0), F.floor(seconds_between(now, "published_at"))).cast("bigint")
    return build.withColumn("age_seconds", age).withColumn(
        "state", F.when(F.col("age_seconds") > stale_seconds, "stale").otherwise("fresh")
    )


def latest_failure_reason(builds: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return builds.agg(
        F.max_by(F.when(failed, F.col("failure_reason")), F.when(failed, F.col("completed_at"))).alias(
            "latest_failure_reason"
        )
    )


def quality_state(builds: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """Running start, last failure with reason, and the state of what is being served."""
    failed, done = F.col("status") == "failed", F.col("status") == "succeeded"
    row = builds.agg(
        F.max(F.when(F.col("status") == "running", F.col("started_at"))).alias(
            "running_build_started_at"
        ),
        F.max(F.when(failed, F.col("completed_at"))).alias("latest_failed_build_at"),
        F.max_by(
            F.when(failed, F.col("failure_reason")), F.when(failed, F.col("completed_at"))
        ).alias("latest_failure_reason"),
        F.max(F.when(done, F.col("published_at"))).alias("_published"),
    )
    age = F.floor(seconds_between(now, "_published"))
    return row.select(
        "running_build_started_at",
        "latest_failed_build_at",
        "latest_failure_reason",
        F.when(F.col("_published").isNull(), "unavailable")
        .when(age > stale_seconds, "stale")
        .otherwise("fresh")
        .alias("state"),
    )


def consecutive_failures(builds: DataFrame) -> DataFrame:
    """Failed attempts after the newest attempt that did not fail: two partial aggregates, no ranking."""
    place = F.struct("started_at", "build_id")
    good = builds.filter("status <> 'failed'").agg(F.max(place).alias("last_good"))
    failed = builds.filter("status = 'failed'").select(place.alias("at"))
    after = F.col("last_good").isNull() | (F.col("at") > F.col("last_good"))
    # the single row of `good` is the broadcast side; `failed` is neither shuffled nor sorted
    return failed.join(F.broadcast(good), after).agg(F.count("*").alias("consecutive_failures"))


def detector_gate(builds: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """One row: the build to evaluate, or why evaluation is skipped."""
    newest = builds.filter("status = 'succeeded'").agg(
        F.max(F.struct("published_at", "build_id")).alias("b")
    )
    late = seconds_between(now, "b.published_at") > stale_seconds
    reason = F.when(F.col("b").isNull(), "no_publication").when(late, "stale_publication")
    return newest.select(
        F.when(reason.isNull(), F.col("b.build_id")).alias("build_id"), reason.alias("skip_reason")
    )


def publication_with_quality(builds: DataFrame, quality_runs: DataFrame) -> DataFrame:
    return latest_successful_build(builds).join(
        quality_runs.select("build_id", "pass_count", "success_count"), "build_id", "left"
    ).select("build_id", "published_at", "source_event_count", "pass_count", "success_count")


# ---- serving reads ----------------------------------------------------------------------


def read_interval(start: datetime | None, end: datetime | None, now: datetime):
    """Default last 24 hours; at most 31 days; start before end; offsets required."""
    end = end or now
    start = start or datetime.fromtimestamp(end.timestamp() - 86400, UTC)
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("interval bounds must carry a timezone")
    if not start < end:
        raise ValueError("interval start must precede its end")
    if (end - start).total_seconds() > MAX_READ_DAYS * 86400:
        raise ValueError(f"interval must not exceed {MAX_READ_DAYS} days")
    return start, end


def metric_range_read(
    snapshot: DataFrame,
    hour: str,
    build_id: str,
    start: datetime,
    end: datetime,
    region: str | None = None,
    limit: int = MAX_READ_ROWS,
) -> DataFrame:
    """Rows of one build in [start, end), and whether there were more than `limit` of them.

    `build_id` prunes partitions, the rest is pushed to the scan.
    """
    if not 1 <= limit <= MAX_READ_ROWS:
        raise ValueError(f"limit must be within 1..{MAX_READ_ROWS}")
    rows = snapshot.filter(F.col("build_id") == build_id).filter(
        (F.col(hour) >= F.lit(start)) & (F.col(hour) < F.lit(end))
    )
    if region:
        rows = rows.filter(F.col("region_code") == region)
    first = rows.orderBy(hour, "region_code").limit(limit + 1)
    place = F.row_number().over(Window.orderBy(hour, "region_code"))  # of at most limit + 1 rows
    more = F.count("*").over(Window.partitionBy()) > limit
    return first.withColumns({"_place": place, "more": more}).filter(F.col("_place") <= limit).drop("_place")


def incident_page(
    incidents: DataFrame,
    limit: int,
    region: str | None = None,
    status: str | None = None,
    before: tuple[datetime, str] | None = None,
) -> DataFrame:
    """Newest-first page; `before` is the (detected_at, incident_id) of the last row seen.

    One row more than `limit` is returned when there is a next page.
    """
    rows = incidents
    if region:
        rows = rows.filter(F.col("region_code") == region)
    if status:
        rows = rows.filter(F.col("status") == status)
    if before:
        at, key = F.lit(before[0]), F.lit(before[1])
        rows = rows.filter(
            (F.col("detected_at") < at)
            | ((F.col("detected_at") == at) & (F.col("incident_id") < key))
        )
    return rows.orderBy(F.desc("detected_at"), F.desc("incident_id")).limit(limit + 1)


def incident_evidence_top(evidence: DataFrame, incident_key: str, limit: int = 100) -> DataFrame:
    return (
        evidence.filter(F.col("uniqueness_key") == incident_key)
        .orderBy("event_ts", "source_event_id")
        .limit(limit)
    )


def evidence_lineage(
    linked: DataFrame, incidents: DataFrame, original: DataFrame, cap: int = 12
) -> DataFrame:
    """Per incident: references kept, first `cap` checked against the original build.

    `original` is the build-tagged evidence table; the three-column equi join marks which
    references it still holds.
    """
    order = Window.partitionBy("uniqueness_key").orderBy("event_ts", "source_event_id")
    totals = linked.groupBy("uniqueness_key").agg(F.count("*").alias("source_reference_count"))
    first = linked.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap)
    first = first.join(incidents.select("uniqueness_key", "analytics_build_id"), "uniqueness_key")
    held = original.select(
        F.col("build_id").alias("analytics_build_id"),
        "source_event_id",
        F.col("evidence_kind").alias("evidence_role"),
        F.lit(True).alias("held"),
    ).distinct()
    checked = first.join(held, ["analytics_build_id", "source_event_id", "evidence_role"], "left")
    per = checked.groupBy("uniqueness_key").agg(
        F.count("*").alias("references_included"),
        F.count_if(F.col("held").isNull()).alias("missing_in_original_build"),
        F.array_sort(
            F.collect_list(
                F.struct("event_ts", "source_event_id", "evidence_role", F.coalesce("held", F.lit(False)).alias("in_original_build"))
            )
        ).alias("references"),
    )
    return incidents.select("uniqueness_key", "detector_name", "analytics_build_id").join(
        totals.join(per, "uniqueness_key"), "uniqueness_key", "left"
    )


def evidence_bundle(
    incidents: DataFrame, linked: DataFrame, original: DataFrame, builds: DataFrame
) -> DataFrame:
    """Incident, its original build, the build now served, last failure and running start."""
    lineage = evidence_lineage(linked, incidents, original)
    own = builds.filter("status = 'succeeded'").select(
        F.col("build_id").alias("analytics_build_id"),
        F.col("published_at").alias("original_published_at"),
        F.col("source_event_count").alias("original_source_event_count"),
    )
    state = builds.agg(
        F.max(F.when(F.col("status") == "running", F.col("started_at"))).alias("running_at"),
        F.max(F.when(F.col("status") == "failed", F.col("completed_at"))).alias("latest_failed_at"),
    )
    served = latest_successful_build(builds)
    return lineage.join(own, "analytics_build_id", "left").select(
        "*",
        served.select("build_id").scalar().alias("current_build_id"),
        served.select("published_at").scalar().alias("current_published_at"),
        state.select("latest_failed_at").scalar().alias("latest_failed_at"),
        state.select("running_at").scalar().alias("running_at"),
    )


# ---- storage ----------------------------------------------------------------------------


class Publications:
    """Snapshots and ledger below one root. Single writer; readers go through the ledger.

    Data partitions are written first and the ledger row last, so a build is visible only
    when whole; a lost executor or driver leaves at most an unlisted partition behind.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _record(self, **state) -> None:
        row = {name: state.get(name) for name in BUILD_SCHEMA.names}
        self.spark.createDataFrame([row], BUILD_SCHEMA).withColumn(
            "recorded_at", F.lit(datetime.now(UTC))
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def builds(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.root}/ledger"):
            return self.spark.createDataFrame([], BUILD_SCHEMA)
        schema = BUILD_SCHEMA.simpleString()[7:-1].replace(":", " ") + ", recorded_at timestamp"
        return current_builds(self.spark.read.schema(schema).parquet(f"{self.root}/ledger"))

    def _state(self, column: str, value: str) -> dict | None:
        row = self.builds().filter(F.col(column) == value).first()
        return row.asDict() if row else None

    def successful_build_for_key(self, build_key: str) -> str | None:
        state = self._state("build_key", build_key)
        return state["build_id"] if state and state["status"] == "succeeded" else None

    def begin(self, build_key: str) -> str:
        """Start a build; a failed or interrupted key is resumed, a succeeded one refused."""
        state = self._state("build_key", build_key)
        if state and state["status"] == "succeeded":
            raise ValueError(f"build key {build_key!r} already succeeded")
        build_id = state["build_id"] if state else str(uuid.uuid4())
        self._record(
            build_id=build_id, build_key=build_key, status="running", started_at=datetime.now(UTC)
        )
        return build_id

    def fail(self, build_id: str, reason: str) -> None:
        state = self._state("build_id", build_id)
        if state and state["status"] == "running":
            self._record(
                **{
                    **state,
                    "status": "failed",
                    "completed_at": datetime.now(UTC),
                    "failure_reason": reason,
                }
            )

    def publish(self, build_id: str, models: Models, results: DataFrame) -> str:
        """Gate on the check results, write snapshots and evidence, then flip the ledger."""
        state = self._state("build_id", build_id)
        if not state or state["status"] != "running":
            raise ValueError("build is not running")
        require_verified(results)
        stg = models["stg_stream_events"]
        for name, (model, _) in SNAPSHOTS.items():
            columns = [c for c in models[model].columns if c != "region_key"]
            models[model].select(*columns).write.mode("overwrite").parquet(
                f"{self.root}/{name}/build_id={build_id}"
            )
        analytics_evidence(stg).write.mode("overwrite").partitionBy("evidence_kind").parquet(
            f"{self.root}/evidence/build_id={build_id}"
        )
        mark = source_watermark(stg).first().asDict()
        digest = results.agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "unique_id", "status"))), "|"), 256)
        ).first()[0]
        now = datetime.now(UTC)
        self._record(
            **{
                **state,
                **mark,
                "status": "succeeded",
                "completed_at": now,
                "published_at": now,
                "manifest_sha256": digest,
                "failure_reason": None,
            }
        )
        return build_id

    def snapshot(self, name: str) -> DataFrame:
        """All published builds of a snapshot; unlisted partitions stay invisible."""
        rows = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(
            f"{self.root}/{name}"
        )
        listed = self.builds().filter("status = 'succeeded'").select("build_id")
        return rows.join(F.broadcast(listed), "build_id", "left_semi")


