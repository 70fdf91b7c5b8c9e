"""The incident cooldown of a running stream, kept as state per detector and region."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from cargolume.plans.detectors import COOLDOWN_HOURS
from cargolume.streaming.queries import rocksdb_state

KEY = ("detector_name", "region_code")
#: The instant as a number, whatever the session's zone.
AT = "detected_at_micros"
#: State outlives the cooldown by far, so that a stream which lags by a day forgets nothing it needs.
STATE_HOURS = 48
#: Keys are few (detectors x regions), so state needs few partitions. Triggers without rows would only look for
#: expired state, for ever: a query that ends with its input would not end. Expired state is never read anyway.
SETTINGS = {"spark.sql.shuffle.partitions": "8", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class Cooldown(StatefulProcessor):
    """Passes an incident on only if none of its key was passed on in the hours before.

    A trigger's incidents of a key, at most one an hour, are taken in time order. One that comes a
    trigger late, before the last one passed on, is suppressed.
    """

    def __init__(self, hours: int = COOLDOWN_HOURS, state_hours: int = STATE_HOURS):
        if state_hours < hours:
            raise ValueError("state must be kept at least as long as the cooldown")
        self.micros, self.ttl = hours * 3_600_000_000, state_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([AT, "uniqueness_key"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for at in batch[AT].tolist():
            keep = last is None or at - last > self.micros
            passed.append(keep)
            last = at if keep else last
        if any(passed):
            self.last.update((last,))
            yield batch[passed].drop(columns=AT)

    def close(self) -> None:
        pass


def cooled(incidents: DataFrame, hours: int = COOLDOWN_HOURS, state_hours: int = STATE_HOURS) -> DataFrame:
    """Streamed incidents without those inside a cooldown; columns stay as they are."""
    timed = incidents.withColumn(AT, F.unix_micros("detected_at"))
    return timed.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=Cooldown(hours, state_hours),
        outputStructType=incidents.schema,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def start_cooldown(incidents: DataFrame, path: str, trigger: dict) -> StreamingQuery:
    """Incidents that survive the cooldown, appended at `path`; the state lives in its checkpoint."""
    with rocksdb_state(incidents.sparkSession, SETTINGS):
        writer = cooled(incidents).writeStream.format("parquet").outputMode("append").option("path", path)
        return writer.option("checkpointLocation", f"{path}-checkpoint").queryName("cooldown").trigger(**trigger).start()
