import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cargolume.contract import ENVELOPE_SCHEMA, RAW_SCHEMA
from cargolume.operators.metrics import reconcile_minute_metrics
from cargolume.sources.jdbc import jdbc_options
from cargolume.sources.retention import expire, retention_candidates
from cargolume.streaming import queries as jobs
from cargolume.streaming.progress import progress_row
from cargolume.streaming.sinks import EventStore

T0 = datetime(2026, 9, 8, 10, tzinfo=UTC)


def record(n, at, **fields):
    body = {
        "event_id": f"00000000-0000-4000-a000-{n:012d}", "event_type": "customer_login",
        "timestamp": at.isoformat(), "customer_id": f"c{n}", "region": "us-east",
        "status": "authenticated", **fields,
    }
    return json.dumps(body).encode()


def send(spark, path, offset, *payloads):
    rows = [("t", 0, offset + i, T0, b"k", p) for i, p in enumerate(payloads)]
    spark.createDataFrame(rows, ENVELOPE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, layout):
    stream = spark.readStream.schema(ENVELOPE_SCHEMA).parquet(source)
    started = jobs.start_queries(
        stream, layout, {"availableNow": True}, F.lit(T0 + timedelta(hours=2)), watermark="10 minutes"
    )
    for query in started:
        query.awaitTermination()
    return {q.name: q for q in started}


def test_restart_dedup_late_drop_and_reconciliation(spark, tmp_path):
    source, layout = str(tmp_path / "in"), jobs.Layout(str(tmp_path / "job"))
    store = EventStore(spark, layout.root)
    send(spark, source, 0, record(1, T0), record(1, T0), record(2, T0), b"{broken")
    first = run(spark, source, layout)
    assert store.read_committed("cleaned").count() == 2
    assert spark.read.parquet(layout.dead_letters).count() == 1
    # After a restart the id is still known; the watermark then moves an hour on.
    send(spark, source, 10, record(2, T0), record(3, T0 + timedelta(hours=1)))
    second = run(spark, source, layout)
    assert first["valid-events"].id == second["valid-events"].id
    assert store.read_committed("cleaned").count() == 3
    # A late event stays in raw, is counted as dropped, and is found by reconciliation.
    send(spark, source, 20, record(4, T0 + timedelta(minutes=1)), record(5, T0 + timedelta(hours=1)))
    third = run(spark, source, layout)
    drops = sum(progress_row(p.json)[6] for p in third["valid-events"].recentProgress)
    assert drops == 1
    assert store.read_committed("cleaned").count() == 4
    missing = jobs.late_reconciliation(spark, layout).collect()
    assert [r["customer_id"] for r in missing] == ["c4"]
    assert reconcile_minute_metrics(store.read_committed("cleaned"), store.minute_totals()).count() == 0
    assert jobs.first_stopped(list(third.values())) == "raw"
    with pytest.raises(ValueError):
        store.read_committed("raw")


def test_retention_lists_then_deletes(spark, tmp_path):
    path = str(tmp_path / "lake")
    spark.range(3).coalesce(1).write.parquet(path)
    later = datetime.now(UTC) + timedelta(days=31)
    old = retention_candidates(spark, [path], later, 30)
    assert expire(old)["deleted"] == 0
    done = expire(old, dry_run=False)
    assert done["deleted"] == done["candidates"] >= 1
    assert retention_candidates(spark, [path], datetime.now(UTC), 30).count() == 0


def test_jdbc_options_push_the_query():
    options = jdbc_options("jdbc:x", "select 1", ("id", 0, 100, 8), user="u")
    assert options["dbtable"] == "(select 1) pushed"
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "8")


def test_reconciliation_plans_no_validation(spark, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    rows = [("t", 0, i, T0, b"k", record(n, T0), T0 + timedelta(hours=2), T0.date()) for i, n in enumerate((1, 1, 2, 3))]
    spark.createDataFrame(rows, RAW_SCHEMA).write.parquet(layout.raw)
    known = jobs.accepted_events(jobs.validate_events(spark.read.schema(RAW_SCHEMA).parquet(layout.raw))).filter("customer_id = 'c3'")
    EventStore(spark, layout.root).write_batch(known, 0, "q")
    missing = jobs.late_reconciliation(spark, layout)
    assert "parse_json" not in missing._jdf.queryExecution().toString().lower()
    assert sorted((r["customer_id"], r["source_offset"]) for r in missing.collect()) == [("c1", 0), ("c2", 2)]
