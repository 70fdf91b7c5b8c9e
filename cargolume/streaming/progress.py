"""Progress of streaming queries as rows."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS_SCHEMA = (
    "query string, batch_id bigint, at string, input_rows bigint, rows_per_second double, "
    "trigger_ms bigint, watermark_dropped bigint, end_offset string"
)
STATE_SCHEMA = "query string, terminated boolean, failed boolean"


def progress_row(event_json: str) -> tuple:
    """One progress report as a row."""
    report = json.loads(event_json)
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for op in report.get("stateOperators", []))
    offsets = json.dumps([source.get("endOffset") for source in report.get("sources", [])])
    return (
        report.get("name"),
        report.get("batchId"),
        report.get("timestamp"),
        max(0, report.get("numInputRows", 0)),
        float(max(0, report.get("processedRowsPerSecond") or 0)),
        report.get("durationMs", {}).get("triggerExecution"),
        max(0, dropped),
        offsets,
    )


class ProgressTable(StreamingQueryListener):
    """Keeps one row per progress report until `flush` appends them to storage."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.states: dict[str, list] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name
        self.states[event.name] = [event.name, False, False]

    def onQueryProgress(self, event) -> None:
        self.rows.append(progress_row(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.id), "other")
        self.states[name] = [name, True, bool(event.exception)]

    def wait_terminated(self, name: str, seconds: float = 60) -> None:
        """Events arrive behind the query; returns once its end has."""
        end = time.monotonic() + seconds
        while not self.states.get(name, [name, False])[1]:
            if time.monotonic() > end:
                raise TimeoutError(f"no end of {name!r} reported")
            time.sleep(0.05)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, PROGRESS_SCHEMA)

    def state_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(s) for s in self.states.values()], STATE_SCHEMA)

    def flush(self, spark: SparkSession, path: str) -> None:
        """Append the collected rows and forget them, so memory stays bounded."""
        rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(path)
