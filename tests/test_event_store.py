"""Ledger, key index and concurrent writers of the event store."""

import threading
from datetime import UTC, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cargolume.catalog import QUERIES
from cargolume.contract import EVENT_SCHEMA
from cargolume.operators import merge
from cargolume.operators.merge import stage_identity
from cargolume.sources.derived_log import envelope_log
from cargolume.streaming import keyindex, ledger, sinks

T0 = datetime(2026, 9, 8, 10, tzinfo=UTC)


def events(spark, ids, offset=0):
    """Rows of the event table with these ids, at consecutive source positions."""
    rows = spark.createDataFrame([(f"e{i}", offset + k) for k, i in enumerate(ids)], "id string, n bigint")
    made = {
        "event_id": F.col("id"), "source_topic": F.lit("t"), "source_partition": F.lit(0), "source_offset": F.col("n"),
        "event_type": F.lit("customer_login"), "event_ts": F.lit(T0) + F.make_dt_interval(mins=F.col("n").cast("int")), "ingested_at": F.lit(T0),
    }
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])


def test_a_version_is_made_once(spark, tmp_path):
    path = str(tmp_path / "log" / "1")
    won = []

    def attempt(n):
        if ledger.create_if_absent(spark, path, f"writer {n}"):
            won.append(n)

    threads = [threading.Thread(target=attempt, args=(n,)) for n in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and ledger.read_text(spark, path) == f"writer {won[0]}"
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["1"]


def test_files_read_do_not_grow_with_batches(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path), every=8)
    read = []
    plain = ledger.read_text
    monkeypatch.setattr(ledger, "read_text", lambda s, p: read.append(p) or plain(s, p))
    most = []
    for version in range(1, 42):
        entry = {"query_id": "q", "batch_id": version, "attempt": "a", "row_count": version}
        assert book.append(version, entry) and not book.append(version, {**entry, "query_id": "other"})
        if book.due(version):
            assert book.compact(version) and not book.compact(version)
        read.clear()
        pointer = book.pointer()
        assert pointer["version"] + len(book.tail(pointer["version"])) == version
        most.append(len(read))
    assert max(most[8:]) <= 8 + 4
    rows = book.rows().collect()
    assert sorted(r["batch_id"] for r in rows) == list(range(1, 42)) and {r["query_id"] for r in rows} == {"q"}
    # a marker that is lost or half written costs probes only
    for text in ("", "000000000000000"):
        (tmp_path / "newest").write_text(text)
        for crc in tmp_path.glob(".newest.crc"):
            crc.write_bytes(b"")
            crc.unlink()
        assert book.rows().count() == 41


def test_keys_of_the_batch_are_found_among_few_prefixes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyindex, "PER_PREFIX", 8)
    monkeypatch.setattr(keyindex, "POSITIONS", 16)
    stored = events(spark, range(400)).select(*keyindex.KEY_COLUMNS)
    run = keyindex.write_run(stored, 400, str(tmp_path))
    assert run["prefixes"] == 64 and keyindex.all_keys(spark, [run]).count() == 400
    batch = events(spark, [5, 77, 1000], offset=90)
    near = keyindex.keys_near(batch, 3, [run], "ids")
    assert {"e5", "e77"} <= {r["event_id"] for r in near.collect()} and near.count() < 100
    near = keyindex.keys_near(batch, 3, [run], "sources")
    assert {90, 91, 92} <= {r["source_offset"] for r in near.collect()} and near.count() < 100
    assert len(near.inputFiles()) < len(spark.read.parquet(f"{run['path']}/sources").inputFiles()) or "prefix" in near._jdf.queryExecution().toString()


def test_runs_are_merged_by_level(spark, tmp_path):
    runs = []
    for n in range(9):
        new = keyindex.write_run(events(spark, range(10 * n, 10 * n + 10), 10 * n).select(*keyindex.KEY_COLUMNS), 10, str(tmp_path))
        runs = keyindex.merged_runs(spark, [*runs, new], str(tmp_path))
    assert [(r["level"], r["rows"]) for r in runs] == [(1, 40), (1, 40), (0, 10)]
    assert {r["event_id"] for r in keyindex.all_keys(spark, runs).collect()} == {f"e{i}" for i in range(90)}


class Interrupting(sinks.EventStore):
    """Lets another writer go first, once."""

    def publish_manifest(self, *args):
        if self.other:
            other, self.other = self.other, None
            other()
        return super().publish_manifest(*args)


def test_interleaved_writers_store_each_id_once(spark, tmp_path):
    plain, slow = sinks.EventStore(spark, str(tmp_path)), Interrupting(spark, str(tmp_path))
    slow.other = lambda: plain.write_batch(events(spark, range(5, 15), 100), 0, "one")
    assert slow.write_batch(events(spark, range(10)), 0, "two") == 5
    assert sorted(r["event_id"] for r in plain.read_committed("cleaned").collect()) == sorted(f"e{i}" for i in range(15))
    assert sorted(r["row_count"] for r in plain.manifests().collect()) == [5, 10]
    # two attempts of the very same batch: the later one takes over what the earlier committed
    slow.other = lambda: plain.write_batch(events(spark, range(20, 23), 200), 1, "two")
    assert slow.write_batch(events(spark, range(20, 23), 200), 1, "two") == 3
    assert plain.read_committed("cleaned").count() == 18 and plain.manifests().count() == 3
    attempts = {r["attempt"].split("-")[0] for r in plain.manifests().filter("query_id = 'two'").collect()}
    assert attempts == {stage_identity("two", 0), stage_identity("two", 1)}


def test_compacted_store_answers_like_a_young_one(spark, tmp_path):
    store = sinks.EventStore(spark, str(tmp_path), every=2)
    for n in range(5):
        assert store.write_batch(events(spark, range(4 * n, 4 * n + 6), 10 * n), n, "q") == (6 if n == 0 else 4)
    assert store.ledger.pointer()["version"] == 4
    assert [store.committed("q", n) for n in range(6)] == [6, 4, 4, 4, 4, None]
    assert store.write_batch(events(spark, range(22), 500), 9, "again") == 0
    assert store.write_batch(events(spark, [100, 101], 12), 10, "taken positions") == 0
    assert store.write_batch(events(spark, range(2)), 0, "q") == 6
    assert store.read_committed("keys").count() == store.read_committed("cleaned").count() == 22
    store.expire_batches(datetime.now(UTC) + timedelta(days=1))
    assert store.read_committed("cleaned").count() == 0 and store.read_committed("keys").count() == 22
    with pytest.raises(ValueError):
        stage_identity("", 0)


def odd_batch(spark):
    """Rows that meet by id in either case, by source position, by both, or not at all."""
    rows = [
        ("A", 0), ("a", 7), ("a", 0), ("b", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("stored", 3), ("f", 90),
        (None, 4), (None, 5), ("g", None), ("h", None), *[(f"n{i}", 100 + i) for i in range(40)],
    ]
    frame = spark.createDataFrame(rows, "event_id string, source_offset bigint").coalesce(1)
    return frame.selectExpr("event_id", "'t' source_topic", "0 source_partition", "source_offset", "repeat('x', 9) body")


@pytest.mark.parametrize("bound", [0, 3, 200_000])
def test_stored_batch_merges_like_rows(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(merge, "BROADCAST_ROWS", bound)
    existing = spark.createDataFrame([("stored", "t", 0, 50), ("other", "t", 0, 90)], "event_id string, source_topic string, source_partition int, source_offset bigint")
    batch = sinks.numbered(odd_batch(spark), str(tmp_path / "rows"))
    for known in (existing, existing.limit(0), batch.drop("_row", "body")):
        want = merge.merge_new_events(batch.drop("_row"), known, 54)
        got = merge.merge_stored_batch(batch, known, known, 54, str(tmp_path / str(id(known))))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_rows_of_a_stored_batch_are_not_shuffled(spark, tmp_path):
    batch = sinks.numbered(odd_batch(spark), str(tmp_path / "rows"))
    fresh = merge.merge_stored_batch(batch, batch.limit(0), batch.limit(0), 54, str(tmp_path / "merging"))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_stored_keys_are_probed_and_not_shuffled(spark, monkeypatch):
    batch, stored = spark.range(50).selectExpr("id % 45 k"), spark.range(40, 4000).selectExpr("id k")
    plans = []
    for bound in (0, 50):
        monkeypatch.setattr(merge, "BROADCAST_CODES", bound)
        met = merge._met_twice(batch, stored, F.col("k"), 50)
        assert sorted(r[0] for r in met.filter("_code < 45").collect()) == [0, 1, 2, 3, 4, 40, 41, 42, 43, 44]
        plans.append(met._jdf.queryExecution().executedPlan().toString())
    assert "LeftSemi" not in plans[0] and "BroadcastHashJoin" in plans[1] and "LeftSemi" in plans[1]


def test_event_files_have_many_row_groups(spark, tmp_path):
    rows = spark.range(0, 1_500_000, 1, 1).selectExpr("sha2(string(id), 256) text")
    rows.write.options(**sinks.STORED).parquet(str(tmp_path / "rows"))
    (file,) = (tmp_path / "rows").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1


def test_committed_rows_are_read_without_a_shuffle(spark, tmp_path):
    store = sinks.EventStore(spark, str(tmp_path))
    store.write_batch(events(spark, range(10)), 0, "q")
    plan = store.read_committed("cleaned")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "BroadcastHashJoin" in joins[0] and "LeftSemi" in joins[0]
    assert store.read_committed("cleaned").count() == 10


def test_a_batch_leaves_no_stage(spark, tmp_path):
    sinks.write_event_batch_a(odd_batch(spark), 0, str(tmp_path / "a"))
    sinks.write_event_batch_a(odd_batch(spark), 1, str(tmp_path / "a"))
    assert not list((tmp_path / "a_stage").glob("*/*.parquet")) and not list((tmp_path / "a_stage").glob("*/rows"))


def test_nine_batches_validate_once(spark, monkeypatch):
    seen, plain = [], sinks.EventStore.write_batch
    monkeypatch.setattr(sinks.EventStore, "write_batch", lambda self, frame, *more: seen.append(frame) or plain(self, frame, *more))
    QUERIES["indexed_keys"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 9
    assert not any("parse_json" in frame._jdf.queryExecution().toString().lower() for frame in seen)


@pytest.mark.parametrize("name", ["batch_ledger_commit", "replay_after_crash", "interleaved_writers"])
def test_batches_of_the_same_rows_validate_once(spark, monkeypatch, name):
    seen, plain = [], sinks.EventStore.write_batch
    monkeypatch.setattr(sinks.EventStore, "write_batch", lambda self, frame, *more: seen.append(frame) or plain(self, frame, *more))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    batch = [frame for frame in seen if "parse_json" in frame._jdf.queryExecution().toString().lower()]
    assert len(seen) >= 2 and len(batch) == 0


def test_both_batches_classify_once(spark, monkeypatch):
    seen, plain = [], sinks.write_event_batch_a
    monkeypatch.setattr(sinks, "write_event_batch_a", lambda frame, *more: seen.append(frame) or plain(frame, *more))
    assert QUERIES["write_event_batch_a"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 2 and not any("from_json" in frame._jdf.queryExecution().toString().lower() for frame in seen)


def test_a_run_has_few_folders(spark, tmp_path):
    keys = spark.range(200_000).selectExpr("string(id) event_id", "'t' source_topic", "0 source_partition", "id source_offset")
    assert keyindex.write_run(keys, 200_000, str(tmp_path))["prefixes"] <= 4


def test_broker_records_are_made_by_all_cores(spark):
    assert envelope_log(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
