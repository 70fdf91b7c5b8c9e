"""Streaming jobs of both lines: raw first, then everything else from the raw archive."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cargolume.contract import RAW_SCHEMA
from cargolume.operators.classify import classify_events, valid_events
from cargolume.operators.envelope import (
    accepted_events,
    archived_events,
    dead_letters_b,
    raw_rows,
)
from cargolume.operators.merge import merge_stored_batch
from cargolume.operators.validate import validate_events
from cargolume.session import hadoop_path
from cargolume.streaming.sinks import STORED, EventStore, checkpoint_query_id, numbered

CRITICAL = ("raw", "dlq", "valid-events")


def read_envelopes(
    spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000, **options: str
) -> DataFrame:
    """Kafka stream of envelopes; needs the connector on the session's class path."""
    reader = spark.readStream.format("kafka").options(
        **{
            "kafka.bootstrap.servers": servers,
            "subscribe": topic,
            "startingOffsets": "earliest",
            "failOnDataLoss": "true",
            "maxOffsetsPerTrigger": str(max_offsets),
            **options,
        }
    )
    return reader.load()


@dataclass(frozen=True)
class Layout:
    """Where a stream job keeps its layers and checkpoints."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def archive(self) -> str:
        return f"{self.root}/archive"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


def _start(writer, layout: Layout, name: str, trigger: dict) -> StreamingQuery:
    return (
        writer.option("checkpointLocation", layout.checkpoint(name))
        .queryName(name)
        .trigger(**trigger)
        .start()
    )


def start_raw(
    envelopes: DataFrame, layout: Layout, trigger: dict, ingested_at: Column | None = None
) -> StreamingQuery:
    """Lossless archive, partitioned by ingest date."""
    rows = raw_rows(envelopes, ingested_at)
    writer = rows.writeStream.format("parquet").options(**STORED).partitionBy("ingest_date").option("path", layout.raw)
    return _start(writer, layout, "raw", trigger)


def read_raw_stream(spark: SparkSession, layout: Layout, files_per_trigger: int = 1000) -> DataFrame:
    """Stream over the committed raw files, oldest first, with the declared schema."""
    fs, path = hadoop_path(spark, layout.raw)
    fs.mkdirs(path)
    return (
        spark.readStream.schema(RAW_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(layout.raw)
    )


def start_dead_letters(
    validated: DataFrame, layout: Layout, trigger: dict, kafka: dict | None = None
) -> StreamingQuery:
    """Rejections to a topic, or to Parquet files where no broker is given."""
    letters = dead_letters_b(validated)
    if kafka:
        writer = letters.writeStream.format("kafka").options(**kafka)
    else:
        writer = letters.writeStream.format("parquet").option("path", layout.dead_letters)
    return _start(writer, layout, "dlq", trigger)


def start_valid_events(
    validated: DataFrame, layout: Layout, trigger: dict, watermark: str | None = None
) -> StreamingQuery:
    """Accepted events into the event store, whose merge alone keeps ids unique.

    With a watermark, repeats within it are dropped before the merge and rows behind it are dropped
    and counted; a live job may do so and recover them by `late_reconciliation`. A replay of the raw
    archive reads files in any event-time order and must not.
    """
    spark = validated.sparkSession
    rows = accepted_events(validated)
    if watermark:
        rows = rows.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["event_id"])

    def commit(frame: DataFrame, batch_id: int) -> None:
        query_id = checkpoint_query_id(spark, layout.checkpoint("valid-events"))
        EventStore(frame.sparkSession, layout.root).write_batch(frame, batch_id, query_id)

    return _start(rows.writeStream.foreachBatch(commit), layout, "valid-events", trigger)


def start_event_archive(
    envelopes: DataFrame, layout: Layout, trigger: dict, clock: Column | None = None
) -> StreamingQuery:
    """Classifier line: accepted events partitioned by event date and type."""
    rows = archived_events(valid_events(classify_events(envelopes, clock)))
    writer = (
        rows.writeStream.format("parquet")
        .options(**STORED)
        .partitionBy("event_date", "event_type")
        .option("path", layout.archive)
    )
    return _start(writer, layout, "event-archive", trigger)


def start_queries(
    envelopes: DataFrame,
    layout: Layout,
    trigger: dict | None = None,
    ingested_at: Column | None = None,
    dead_letter_topic: dict | None = None,
    watermark: str | None = None,
    files_per_trigger: int = 1000,
) -> list[StreamingQuery]:
    """Raw, dead letters and valid events; if one fails to start, none is left running."""
    trigger = trigger or {"processingTime": "5 seconds"}
    spark = envelopes.sparkSession
    started: list[StreamingQuery] = []
    try:
        started.append(start_raw(envelopes, layout, trigger, ingested_at))
        if "availableNow" in trigger:
            started[0].awaitTermination()
        validated = validate_events(read_raw_stream(spark, layout, files_per_trigger))
        started.append(start_dead_letters(validated, layout, trigger, dead_letter_topic))
        started.append(start_valid_events(validated, layout, trigger, watermark))
        return started
    except BaseException:
        for query in started:
            query.stop()
        raise


def first_stopped(queries: list[StreamingQuery]) -> str | None:
    """Name of the first critical query that is no longer running."""
    return next((q.name for q in queries if q.name in CRITICAL and not q.isActive), None)


def late_reconciliation(spark: SparkSession, layout: Layout) -> DataFrame:
    """Accepted raw events the store lacks, late ones included; same uniqueness rules.

    Both sides are whole tables. The accepted rows are validated once and stored: a plan that validates
    and merges repeats the validator's expressions until it no longer fits the driver. They stay below
    `reconciling`, as the result is read from them.
    """
    raw = spark.read.schema(RAW_SCHEMA).parquet(layout.raw)
    stored = EventStore(spark, layout.root).read_committed("keys")
    stage = f"{layout.root}/reconciling/{uuid.uuid4().hex}"
    accepted = numbered(accepted_events(validate_events(raw)), f"{stage}/rows")
    return merge_stored_batch(accepted, stored, stored, accepted.count(), f"{stage}/merging")


def deduplicated(stream: DataFrame, time: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """Watermarked dedup for a stream, plain distinct-by-key for a table."""
    marked = stream.withWatermark(time, delay)
    if stream.isStreaming:
        return marked.dropDuplicatesWithinWatermark([key])
    return marked.dropDuplicates([key])


def tumbling_minutes(stream: DataFrame, time: str, *keys: str) -> DataFrame:
    """One-minute windows of a (deduplicated) stream."""
    return (
        stream.groupBy(F.window(time, "1 minute").alias("w"), *keys)
        .agg(F.count("*").alias("event_count"))
        .select(F.col("w.start").alias("minute_start"), *keys, "event_count")
    )


def start_minutes(
    stream: DataFrame, path: str, time: str, key: str, keys: tuple[str, ...], trigger: dict, delay: str = "10 minutes"
) -> StreamingQuery:
    """Minutes of a stream as one query: ids unique within the watermark, then windows, each appended
    once the watermark has passed its end. Both states live in the one checkpoint."""
    minutes = tumbling_minutes(deduplicated(stream, time, key, delay), time, *keys)
    writer = minutes.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", f"{path}-checkpoint").queryName("minutes").trigger(**trigger).start()


ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb_state(spark: SparkSession, more: dict[str, str] | None = None):
    """Queries started inside keep their state in RocksDB, off the heap, and upload changes only.

    `more`: further settings of those queries.
    """
    wanted = {**ROCKSDB, **(more or {})}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
