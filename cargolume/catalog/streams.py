"""Stream jobs run to completion over the derived broker log."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from cargolume.catalog.validation import clock, env_sql
from cargolume.catalog.registry import query
from cargolume.contract import ENVELOPE_SCHEMA, RAW_SCHEMA
from cargolume.operators import metrics
from cargolume.operators.classify import classify_events
from cargolume.operators.envelope import accepted_events, event_sink_rows
from cargolume.operators.validate import validate_events
from cargolume.session import scratch_dir
from cargolume.sources.derived_log import envelope_log
from cargolume.sources.retention import retention_candidates
from cargolume.sources.tables import table
from cargolume.streaming import queries as jobs
from cargolume.streaming import sinks
from cargolume.streaming.progress import PROGRESS_SCHEMA, ProgressTable

NOW_TRIGGER = {"availableNow": True}
_VALID = """vd as (select j_event_id event_id, j_event_type event_type, at_utc event_ts,
  j_region region, min(ingested) ingested_at, any_value(try_cast(j_amount as decimal(14,2))) amount
  from cb where code is null group by 1, 2, 3, 4)"""


def vd_sql(select: str) -> str:
    """`select` over `vd`, the accepted events once per id."""
    return env_sql("select 1").replace("\nselect 1", f",\n{_VALID}\n{select}")


def stored_envelopes(spark, sf):
    """Broker records written as files, and a stream over them."""
    path = scratch_dir(spark, "broker")
    envelope_log(spark, sf).write.options(**sinks.STORED).parquet(path)
    return spark.readStream.schema(ENVELOPE_SCHEMA).parquet(path)


def _ingested():
    return F.col("timestamp") + F.make_dt_interval(secs=F.lit(60))


def raw_layer(spark, sf):
    layout = jobs.Layout(scratch_dir(spark, "stream"))
    query_ = jobs.start_raw(stored_envelopes(spark, sf), layout, NOW_TRIGGER, _ingested())
    query_.awaitTermination()
    return layout, query_


def accepted_once(spark, layout):
    """Accepted rows of the raw archive, validated once and stored for all batches that hold them."""
    accepted = accepted_events(validate_events(spark.read.schema(RAW_SCHEMA).parquet(layout.raw)))
    return sinks.numbered(accepted, scratch_dir(spark, "accepted")).drop("_row")


def store(spark, sf, files_per_trigger=1000):
    """Raw archive and event store after one complete run."""
    layout, _ = raw_layer(spark, sf)
    validated = validate_events(jobs.read_raw_stream(spark, layout, files_per_trigger))
    jobs.start_valid_events(validated, layout, NOW_TRIGGER).awaitTermination()
    return layout, sinks.EventStore(spark, layout.root)


@query(
    "write_raw_archive",
    env_sql(
        """select cast("timestamp" + interval 60 second as date) ingest_date, count(*) records,
        sum(octet_length("value"))::bigint payload_bytes from js group by 1"""
    ),
)
def _(spark, sf):
    layout, _ = raw_layer(spark, sf)
    # A batch read of a stream's directory follows the sink's own commit log.
    return spark.read.schema(RAW_SCHEMA).parquet(layout.raw).groupBy("ingest_date").agg(
        F.count("*").alias("records"),
        F.sum(F.octet_length("raw_payload")).alias("payload_bytes"),
    )


@query("progress_table", env_sql("select count(*) input_rows, 0::bigint watermark_dropped from js"))
def _(spark, sf):
    # Reports reach the listener one by one; none is lost however long the query runs.
    listener, path = ProgressTable(), scratch_dir(spark, "progress")
    spark.streams.addListener(listener)
    try:
        raw_layer(spark, sf)
        listener.wait_terminated("raw")
    finally:
        spark.streams.removeListener(listener)
    listener.flush(spark, path)
    return spark.read.schema(PROGRESS_SCHEMA).parquet(path).filter("query = 'raw'").agg(
        F.sum("input_rows").alias("input_rows"), F.sum("watermark_dropped").alias("watermark_dropped")
    )


@query(
    "write_dead_letters",
    env_sql(
        """select code error_code, count(*) letters, count(distinct concat(topic, ':', "partition",
        ':', "offset")) keys from cb where code is not null group by 1"""
    ),
)
def _(spark, sf):
    layout, _ = raw_layer(spark, sf)
    validated = validate_events(jobs.read_raw_stream(spark, layout))
    jobs.start_dead_letters(validated, layout, NOW_TRIGGER).awaitTermination()
    return (
        spark.read.schema("key string, value string")
        .parquet(layout.dead_letters)
        .groupBy(F.get_json_object("value", "$.error_code").alias("error_code"))
        .agg(F.count("*").alias("letters"), F.count_distinct("key").alias("keys"))
    )


@query(
    "write_event_batch_b",
    vd_sql("select event_id, event_type, event_ts, region, amount::double amount from vd"),
)
def _(spark, sf):
    _, kept = store(spark, sf)
    return kept.read_committed("cleaned").select(
        "event_id", "event_type", "event_ts", "region", "amount"
    )


@query(
    "read_committed_layer",
    vd_sql(
        """select cast(event_ts as date) event_date, hour(event_ts)::bigint event_hour,
        count(*) events, count(*) filter (where event_type = 'payment_failed') failures,
        count(*) filter (where event_type = 'shipment_delayed') delays,
        count(*) filter (where event_type = 'refund_requested') refunds from vd group by 1, 2"""
    ),
)
def _(spark, sf):
    _, kept = store(spark, sf)
    return kept.read_committed("curated").groupBy("event_date", "event_hour").agg(
        F.count("*").alias("events"),
        F.count_if("is_payment_failure").alias("failures"),
        F.count_if("is_shipment_delay").alias("delays"),
        F.count_if("is_refund").alias("refunds"),
    )


@query(
    "batch_ledger_commit",
    vd_sql(
        """select count(*) first_inserted, count(*) replay_inserted, count(*) stored_rows,
        0::bigint other_query_inserted from vd"""
    ),
)
def _(spark, sf):
    # The same rows again: as a replay of the last batch, then as a batch of another query.
    layout, kept = store(spark, sf)
    ledger = kept.manifests().agg(
        F.sum("row_count").alias("rows"), F.max_by(F.struct("query_id", "batch_id", "row_count"), "batch_id").alias("last")
    ).first()
    rows = accepted_once(spark, layout)
    again = kept.write_batch(rows, ledger["last"]["batch_id"], ledger["last"]["query_id"])
    other = kept.write_batch(rows, 0, "second-query")
    return kept.read_committed("cleaned").agg(F.count("*").alias("stored_rows")).select(
        F.lit(ledger["rows"]).alias("first_inserted"),
        F.lit(ledger["rows"] - ledger["last"]["row_count"] + again).alias("replay_inserted"),
        F.lit(other).alias("other_query_inserted"),
        "stored_rows",
    )


class _Interrupted(RuntimeError):
    pass


@query(
    "replay_after_crash",
    vd_sql("select count(*) stored_rows, count(distinct event_id) stored_ids, 0::bigint retried from vd"),
)
def _(spark, sf):
    # An attempt dies before its manifest, another query commits the same rows, then the retry runs.
    layout, _ = raw_layer(spark, sf)
    rows = accepted_once(spark, layout)

    class Dying(sinks.EventStore):
        def publish_manifest(self, *args):
            raise _Interrupted

    try:
        Dying(spark, layout.root).write_batch(rows, 0, "first-query")
    except _Interrupted:
        pass
    kept = sinks.EventStore(spark, layout.root)
    kept.write_batch(rows, 0, "second-query")
    retried = kept.write_batch(rows, 0, "first-query")
    return kept.read_committed("cleaned").agg(
        F.count("*").alias("stored_rows"), F.count_distinct("event_id").alias("stored_ids")
    ).withColumn("retried", F.lit(retried).cast("bigint"))


@query(
    "interleaved_writers",
    vd_sql(
        "select count(*) stored_rows, count(distinct event_id) stored_ids, count(*) inserted_by_both, 2::bigint batches from vd"
    ),
)
def _(spark, sf):
    # Between merge and commit of one writer another commits half of the same rows.
    layout, _ = raw_layer(spark, sf)
    rows = accepted_once(spark, layout)
    first, inserted = sinks.EventStore(spark, layout.root), []

    class Slow(sinks.EventStore):
        def publish_manifest(self, *args):
            if not inserted:
                half = rows.filter(F.xxhash64("event_id") % 2 == 0)
                inserted.append(first.write_batch(half, 0, "first-query"))
            return super().publish_manifest(*args)

    inserted.append(Slow(spark, layout.root).write_batch(rows, 0, "second-query"))
    batches = first.manifests().count()
    return first.read_committed("cleaned").agg(
        F.count("*").alias("stored_rows"), F.count_distinct("event_id").alias("stored_ids")
    ).withColumns({"inserted_by_both": F.lit(sum(inserted)).cast("bigint"), "batches": F.lit(batches).cast("bigint")})


@query(
    "indexed_keys",
    vd_sql("select event_id, count(*) over () known_keys, 0::bigint accepted_again from vd"),
)
def _(spark, sf):
    # Eight batches with a compaction every two: keys come from merged runs, and all are known.
    layout, _ = raw_layer(spark, sf)
    rows = accepted_once(spark, layout)
    kept = sinks.EventStore(spark, layout.root, every=2)
    for part in range(8):
        kept.write_batch(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(8)) == part), part, "parts")
    again = kept.write_batch(rows, 0, "all-again")
    keys = kept.read_committed("keys")
    known = keys.count()
    return keys.select("event_id", F.lit(known).cast("bigint").alias("known_keys"), F.lit(again).cast("bigint").alias("accepted_again"))


@query(
    "replay_in_small_triggers",
    vd_sql("select event_id, event_type, event_ts from vd"),
)
def _(spark, sf):
    # Three raw files a trigger: files come in any event-time order, and nothing may be lost.
    _, kept = store(spark, sf, files_per_trigger=3)
    return kept.read_committed("cleaned").select("event_id", "event_type", "event_ts")


@query(
    "store_after_expiry",
    vd_sql("select 0::bigint visible_rows, count(*) known_keys, 0::bigint accepted_again from vd"),
)
def _(spark, sf):
    # All events expire; their keys stay, and a replay under another name accepts nothing.
    layout, kept = store(spark, sf)
    kept.expire_batches(datetime(2100, 1, 1, tzinfo=UTC))
    visible = kept.read_committed("cleaned").count()
    raw = spark.read.schema(RAW_SCHEMA).parquet(layout.raw)
    again = kept.write_batch(accepted_events(validate_events(raw)), 0, "second-query")
    return kept.read_committed("keys").agg(F.count("*").alias("known_keys")).select(
        F.lit(visible).cast("bigint").alias("visible_rows"),
        "known_keys",
        F.lit(again).cast("bigint").alias("accepted_again"),
    )


@query(
    "stream_minute_totals",
    vd_sql(
        """select date_trunc('minute', event_ts) window_start, event_type, count(*) event_count,
        coalesce(sum(amount), 0)::double total_amount from vd group by 1, 2"""
    ),
)
def _(spark, sf):
    _, kept = store(spark, sf)
    return kept.minute_totals().select("window_start", "event_type", "event_count", "total_amount")


@query(
    "late_reconciliation",
    vd_sql("select event_id, event_type, event_ts from vd where event_type <> 'customer_login'"),
)
def _(spark, sf):
    # The store holds the logins alone, so the pass recovers every other accepted event from raw.
    layout, _ = raw_layer(spark, sf)
    raw = spark.read.schema(RAW_SCHEMA).parquet(layout.raw)
    logins = accepted_events(validate_events(raw)).filter("event_type = 'customer_login'")
    sinks.EventStore(spark, layout.root).write_batch(logins, 0, "logins")
    return jobs.late_reconciliation(spark, layout).select("event_id", "event_type", "event_ts")


@query(
    "write_event_archive",
    vd_sql(
        "select cast(event_ts as date) event_date, event_type, count(*) events from vd group by 1, 2"
    ),
)
def _(spark, sf):
    layout = jobs.Layout(scratch_dir(spark, "archive"))
    stream = stored_envelopes(spark, sf)
    jobs.start_event_archive(stream, layout, NOW_TRIGGER, clock()).awaitTermination()
    return spark.read.parquet(layout.archive).groupBy("event_date", "event_type").agg(
        F.count("*").alias("events")
    )


@query("write_event_batch_a", vd_sql("select event_id, event_type from vd"))
def _(spark, sf):
    # The whole log as batch 0, then again as batch 1, which must insert nothing.
    # Both read the accepted events from storage, so that records are classified once.
    path = scratch_dir(spark, "events_a")
    rows = event_sink_rows(classify_events(envelope_log(spark, sf), clock()).filter("is_valid"))
    rows = sinks.numbered(rows, scratch_dir(spark, "events_a_rows")).drop("_row")
    for batch in (0, 1):
        sinks.write_event_batch_a(rows, batch, path)
    return spark.read.parquet(path).select("event_id", "event_type")


@query(
    "write_metric_batch_a",
    vd_sql(
        """select date_trunc('minute', event_ts) minute_start, region, count(*) event_count
        from vd group by 1, 2"""
    ),
)
def _(spark, sf):
    # A first batch of failed payments only is replaced by the complete second batch. Both read the
    # accepted events from storage, so that records are classified once and not once a batch.
    path, accepted = scratch_dir(spark, "metrics_a"), scratch_dir(spark, "metrics_a_events")
    valid = classify_events(envelope_log(spark, sf), clock()).filter("is_valid")
    once = valid.dropDuplicates(["event_id"]).select(*metrics.MINUTE_COLUMNS_A)
    once.write.parquet(accepted)
    once = spark.read.schema(once.schema).parquet(accepted)
    sinks.write_metric_batch_a(
        metrics.minute_metrics_a(once.filter("event_type = 'payment_failed'")), 0, path
    )
    sinks.write_metric_batch_a(metrics.minute_metrics_a(once), 1, path)
    return sinks.read_metrics_a(spark, path).select("minute_start", "region", "event_count")


_CLICKS = """select date_trunc('minute', ts) minute_start, event_type, count(*) event_count
  from events group by 1, 2"""


@query("watermark_dedup_minutes", _CLICKS)
def _(spark, sf):
    # The events table as a stream in which every record arrives twice.
    path = scratch_dir(spark, "clicks")
    events = table(spark, sf, "events").selectExpr(
        "event_id", "convert_timezone('UTC', current_timezone(), ts)::timestamp ts", "event_type"
    )
    events.unionByName(events).write.parquet(path)
    stream = spark.readStream.schema("event_id bigint, ts timestamp, event_type string").parquet(path)
    out = scratch_dir(spark, "clicks_out")
    once = jobs.deduplicated(stream, "ts", "event_id")
    (
        once.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return jobs.tumbling_minutes(spark.read.parquet(out), "ts", "event_type")


_SLICES = 6


def _click_slices(spark, sf):
    """The events table in files of rising time, written one after the other, and a stream over them."""
    path = scratch_dir(spark, "clicks")
    events = table(spark, sf, "events").selectExpr(
        "event_id", "convert_timezone('UTC', current_timezone(), ts)::timestamp ts", "event_type"
    )
    edges = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    step = (edges["high"] - edges["low"]) / _SLICES
    for n in range(_SLICES):
        low, high = edges["low"] + n * step, edges["low"] + (n + 1) * step
        own = (F.col("ts") >= low) & ((F.col("ts") < high) if n < _SLICES - 1 else F.lit(True))
        part = events.filter(own)
        part.unionByName(part).coalesce(1).write.mode("append").parquet(path)
    return path


@query(
    "streamed_minutes",
    """with m as (select date_trunc('minute', ts) minute_start, event_type, count(*) n from events group by 1, 2),
    c as (select epoch_ms(max(ts)) - 600000 closed from events)
    select minute_start, event_type, n one_file, n three_files from m, c
    where epoch_ms(minute_start) + 60000 <= closed""",
)
def _(spark, sf):
    # One query: dedup state, then window state, closed minutes appended. Every record comes twice.
    path, closed = _click_slices(spark, sf), {}
    for files in (1, 3):
        out = scratch_dir(spark, "minutes")
        stream = (
            spark.readStream.schema("event_id bigint, ts timestamp, event_type string")
            .option("maxFilesPerTrigger", files)
            .parquet(path)
        )
        jobs.start_minutes(stream, out, "ts", "event_id", ("event_type",), NOW_TRIGGER).awaitTermination()
        closed[files] = spark.read.schema("minute_start timestamp, event_type string, event_count bigint").parquet(out)
    keys = ["minute_start", "event_type"]
    one, three = (closed[n].withColumnRenamed("event_count", name) for n, name in ((1, "one_file"), (3, "three_files")))
    return one.join(three, keys, "full")


@query(
    "stream_restart",
    """with e as (select event_id, ts, epoch_us(ts) us from events),
    h as (select us, us < (select min(us) + (max(us) - min(us)) // 2 from e) early from e),
    w as (select (max(us) // 1000 - 600000) * 1000 mark from h where early)
    select (select count(*) from e) stored_rows, (select count(distinct event_id) from e) stored_ids,
    count(*) filter (where us <= mark) late_dropped from h, w where early""",
)
def _(spark, sf):
    # The earlier half runs, the query ends; it restarts on its checkpoint with the later half and the
    # earlier one again: what lies behind the watermark is dropped and counted, the rest is known by its id.
    path, out = scratch_dir(spark, "clicks"), scratch_dir(spark, "restart")
    events = table(spark, sf, "events").selectExpr(
        "event_id", "convert_timezone('UTC', current_timezone(), ts)::timestamp ts", "event_type", "unix_micros(convert_timezone('UTC', current_timezone(), ts)::timestamp) us"
    )
    edges = events.agg(F.min("us").alias("low"), F.max("us").alias("high")).first()
    early = F.col("us") < edges["low"] + (edges["high"] - edges["low"]) // 2
    listener = ProgressTable()
    spark.streams.addListener(listener)
    try:
        with jobs.rocksdb_state(spark):
            for rows in (events.filter(early), events):
                rows.drop("us").coalesce(1).write.mode("append").parquet(path)
                stream = spark.readStream.schema("event_id bigint, ts timestamp, event_type string").parquet(path)
                once = jobs.deduplicated(stream, "ts", "event_id")
                writer = once.writeStream.format("parquet").option("path", out).queryName("restart")
                writer.option("checkpointLocation", f"{out}-checkpoint").trigger(**NOW_TRIGGER).start().awaitTermination()
                listener.wait_terminated("restart")
                listener.states.pop("restart")
    finally:
        spark.streams.removeListener(listener)
    dropped = listener.table(spark).filter("query = 'restart'").agg(F.sum("watermark_dropped")).first()[0]
    stored = spark.read.schema("event_id bigint").parquet(out)
    return stored.agg(F.count("*").alias("stored_rows"), F.count_distinct("event_id").alias("stored_ids")).withColumn(
        "late_dropped", F.lit(dropped).cast("bigint")
    )


@query(
    "retention_candidates",
    env_sql(
        """select distinct cast("timestamp" + interval 60 second as date)::varchar ingest_date
        from js"""
    ),
)
def _(spark, sf):
    layout, _ = raw_layer(spark, sf)
    files = retention_candidates(spark, [layout.raw], datetime(2100, 1, 1, tzinfo=UTC))
    day = F.regexp_extract("path", r"ingest_date=(\d{4}-\d{2}-\d{2})", 1)
    return files.filter(day != "").select(day.alias("ingest_date")).distinct()


@query("layer_sample", env_sql("select count(*) row_count, 5::bigint sample_rows from js"))
def _(spark, sf):
    layout, _ = raw_layer(spark, sf)
    count, sample = sinks.layer_sample(spark.read.schema(RAW_SCHEMA).parquet(layout.raw))
    return sample.agg(F.count("*").alias("sample_rows")).withColumn("row_count", F.lit(count))
