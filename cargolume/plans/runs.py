"""Scheduled detector runs: gate, evaluation, cooldown, insertion and evidence, on record.

The run ledger is append-only: one row when a run starts, one when it ends. A run that dies in between
stays `running`; the last word on a run is its end, if there is one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.plans import detectors
from cargolume.plans.publication import STALE_SECONDS, detector_gate
from cargolume.session import path_exists

RUN_SCHEMA = (
    "run_id string, evaluation_at timestamp, started_at timestamp, status string, "
    "completed_at timestamp, skip_reason string, analytics_build_id string, "
    "created_incidents bigint, error_type string"
)
Marts = Callable[[str], tuple[DataFrame, DataFrame, DataFrame]]


class DetectorRuns:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _record(self, run_id: str, at: datetime, started: datetime, status: str, **more) -> None:
        done = None if status == "running" else datetime.now(UTC)
        row = (
            run_id, at, started, status, done, more.get("skip_reason"), more.get("build_id"),
            more.get("created"), more.get("error_type"),
        )
        frame = self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1)
        frame.write.mode("append").json(f"{self.root}/runs")

    def runs(self) -> DataFrame:
        """One row per run, in its last known state."""
        if not path_exists(self.spark, f"{self.root}/runs"):
            return self.spark.createDataFrame([], RUN_SCHEMA)
        rows = self.spark.read.schema(RUN_SCHEMA).json(f"{self.root}/runs")
        body = [c for c in rows.columns if c != "run_id"]
        last = F.max_by(F.struct(*body), F.coalesce("completed_at", F.lit(0).cast("timestamp")))
        return rows.groupBy("run_id").agg(last.alias("_last")).select("run_id", "_last.*")

    def incidents(self, like: DataFrame) -> DataFrame:
        """Incidents of all runs; `like` gives the columns while there are none."""
        path = f"{self.root}/incidents"
        if not path_exists(self.spark, path):
            return like.limit(0)
        return self.spark.read.schema(like.schema).option("recursiveFileLookup", True).parquet(path)

    def evaluate(
        self, builds: DataFrame, marts: Marts, now: datetime, stale_seconds: int = STALE_SECONDS
    ) -> int:
        """One scheduled run over the last complete hour. Returns how many incidents it created.

        The newest published build is evaluated, or the run is skipped with the reason. An error is
        recorded by its type and raised again.
        """
        run_id, started = uuid.uuid4().hex, datetime.now(UTC)
        clock = F.lit(now)
        self._record(run_id, now, started, "running")
        try:
            gate = detector_gate(builds, clock, stale_seconds).first()
            if gate["skip_reason"]:
                self._record(run_id, now, started, "skipped", skip_reason=gate["skip_reason"])
                return 0
            found = detectors.evaluate_hour(*marts(gate["build_id"]), clock)
            rows = detectors.with_identity(found, F.lit(gate["build_id"]))
            known = self.incidents(rows)
            fresh = detectors.insert_incidents(detectors.suppress_recent(rows, known, clock), known)
            path = f"{self.root}/incidents/{run_id}"
            fresh.write.parquet(path)
            created = self.spark.read.schema(fresh.schema).parquet(path).count()
        except Exception as error:
            self._record(run_id, now, started, "failed", error_type=type(error).__name__)
            raise
        self._record(run_id, now, started, "succeeded", build_id=gate["build_id"], created=created)
        return created
