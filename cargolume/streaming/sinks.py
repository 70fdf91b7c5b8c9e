"""Micro-batch sinks onto append-only Parquet layers with a ledger-last commit.

Every attempt of a batch writes below a name of its own and then makes the next version of the ledger;
readers join the layers with the ledger, so an interrupted attempt is invisible for ever. A version can
be made once: a writer that finds it taken merges again with what was committed meanwhile. Uniqueness
rests on the keys, which expiry of the events leaves alone and which are indexed by hash prefix.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolume.contract import EVENT_COLUMNS, EVENT_SCHEMA
from cargolume.operators import merge, metrics
from cargolume.operators.envelope import curated_events
from cargolume.session import hadoop_path, path_exists
from cargolume.streaming.keyindex import KEY_COLUMNS, KEY_SCHEMA, all_keys, keys_near, merged_runs, write_run
from cargolume.streaming.ledger import EVERY, MANIFEST_SCHEMA, Ledger

ATTEMPT = ("query_id", "batch_id", "attempt")
MINUTE_SCHEMA = (
    "window_start timestamp, window_end timestamp, event_type string, event_count bigint, "
    "total_amount decimal(24,2), updated_at timestamp"
)

#: How event rows lie in storage: ids are random hex, which only an entropy coder halves.
#: A file has many row groups, so that even a trigger of few files is read by all cores.
STORED = {"compression": "zstd", "parquet.block.size": 16 * 1024 * 1024}


def numbered(frame: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """The rows, stored once with a row number `_row`."""
    made = frame.withColumn("_row", F.monotonically_increasing_id())
    made.write.options(**STORED).mode(mode).parquet(path)
    return frame.sparkSession.read.schema(made.schema).parquet(path)


def checkpoint_query_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of a streaming query; it survives restarts on the same checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


class EventStore:
    """Cleaned events, their keys, minute totals and the batch ledger.

    Layers: `keys` and `cleaned` hold what a batch inserted, `minutes` its totals; `curated` is a
    projection of `cleaned`. Any number of writers may commit to one store.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = EVERY):
        self.spark, self.root = spark, root.rstrip("/")
        self.ledger = Ledger(spark, f"{self.root}/ledger", every)

    def attempt_path(self, layer: str, query_id: str, batch_id: int, attempt: str) -> str:
        return f"{self.root}/{layer}/query_id={query_id}/batch_id={batch_id}/attempt={attempt}"

    def _expired(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.root}/expired"):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", True).json(
            f"{self.root}/expired"
        )

    def manifests(self) -> DataFrame:
        """The batch ledger: one row per committed batch, whether its events are still kept or not."""
        return self.ledger.rows()

    def committed(self, query_id: str, batch_id: int) -> int | None:
        """Rows a batch inserted; None if it never committed."""
        pointer = self.ledger.pointer()
        for entry in self.ledger.tail(pointer["version"]):
            if (entry["query_id"], entry["batch_id"]) == (query_id, batch_id):
                return entry["row_count"]
        if not pointer["table"]:
            return None
        rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(pointer["table"])
        found = rows.filter((F.col("query_id") == query_id) & (F.col("batch_id") == batch_id)).first()
        return found and found["row_count"]

    def _keys_of(self, entries: list[dict]) -> DataFrame:
        """Keys of a bounded number of batches, each from its own folder."""
        paths = [self.attempt_path("keys", e["query_id"], e["batch_id"], e["attempt"]) for e in entries if e["row_count"]]
        if not paths:
            return self.spark.createDataFrame([], KEY_SCHEMA)
        return self.spark.read.schema(KEY_SCHEMA).parquet(*paths)

    def read_committed(self, layer: str) -> DataFrame:
        """Rows of committed batches that have not expired, joined on the layer's partitions."""
        if layer not in ("cleaned", "curated", "minutes", "keys"):
            raise ValueError("layer must be cleaned, curated, minutes or keys")
        if layer == "curated":
            return curated_events(self.read_committed("cleaned"))
        if layer == "keys":
            pointer = self.ledger.pointer()
            recent = self._keys_of(self.ledger.tail(pointer["version"]))
            return all_keys(self.spark, pointer.get("runs", [])).unionByName(recent)
        minutes = T.StructType.fromDDL(MINUTE_SCHEMA).fields
        fields = EVENT_SCHEMA.fields if layer == "cleaned" else minutes
        schema = T.StructType(fields)
        path = f"{self.root}/{layer}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        named = [T.StructField("query_id", T.StringType()), T.StructField("batch_id", T.LongType())]
        rows = self.spark.read.schema(
            T.StructType([*fields, *named, T.StructField("attempt", T.StringType())])
        ).parquet(path)
        pointer = self.ledger.pointer()
        batches = pointer["version"] + len(self.ledger.tail(pointer["version"]))
        valid = self.manifests().select(*ATTEMPT)
        valid = valid.join(self._expired().select(*ATTEMPT), list(ATTEMPT), "left_anti")
        if batches <= merge.BROADCAST_ROWS:
            # An attempt is one key however many rows it has: shuffled, it would meet in one task.
            valid = F.broadcast(valid)
        return rows.join(valid, list(ATTEMPT), "left_semi").select(*schema.names)

    def minute_totals(self) -> DataFrame:
        """Additive minute totals: the sum of what each batch inserted."""
        return (
            self.read_committed("minutes")
            .groupBy("window_start", "window_end", "event_type")
            .agg(
                F.sum("event_count").alias("event_count"),
                F.sum("total_amount").cast("decimal(24,2)").alias("total_amount"),
                F.max("updated_at").alias("updated_at"),
            )
        )

    def write_batch(self, frame: DataFrame, batch_id: int, query_id: str) -> int:
        """Insert what is new, once per (query, batch). Returns the inserted row count."""
        prior = self.committed(query_id, batch_id)
        if prior is not None:
            frame.write.format("noop").mode("overwrite").save()  # a replay's state advances too
            return prior
        name = merge.stage_identity(query_id, batch_id)
        # Staged to storage and not cached: the batch is read several times, and an executor
        # lost between them costs a re-read.
        stage = self.attempt_path("staged", query_id, batch_id, f"{name}-{uuid.uuid4().hex}")
        staged = numbered(frame.select(*EVENT_COLUMNS), stage)
        rows = staged.count()
        while True:
            pointer = self.ledger.pointer()
            tail = self.ledger.tail(pointer["version"])
            inserted = self._other_attempt(tail, query_id, batch_id)
            if inserted is not None:
                break
            seen = pointer["version"] + len(tail)
            attempt = f"{name}-{uuid.uuid4().hex}"
            inserted = self._write_layers(staged, rows, pointer.get("runs", []), tail, query_id, batch_id, attempt)
            if self.publish_manifest(query_id, batch_id, attempt, inserted, seen):
                if self.ledger.due(seen + 1):
                    self.compact(seen + 1)
                break
        fs, path = hadoop_path(self.spark, stage)
        fs.delete(path, True)
        return inserted

    def _other_attempt(self, tail: list[dict], query_id: str, batch_id: int) -> int | None:
        """Another attempt of this very batch may have committed since this one began."""
        own = [e["row_count"] for e in tail if (e["query_id"], e["batch_id"]) == (query_id, batch_id)]
        return own[0] if own else None

    def _write_layers(self, staged: DataFrame, rows: int, runs: list[dict], tail: list[dict], query_id: str, batch_id: int, attempt: str) -> int:
        """The rows of a batch that are new as of a ledger version, below the attempt's own name."""
        paths = {
            layer: self.attempt_path(layer, query_id, batch_id, attempt)
            for layer in ("cleaned", "keys", "minutes")
        }
        recent = self._keys_of(tail)
        ids, sources = (keys_near(staged, rows, runs, side).unionByName(recent) for side in ("ids", "sources"))
        work = self.attempt_path("merging", query_id, batch_id, attempt)
        fresh = merge.merge_stored_batch(staged, ids, sources, rows, work)
        fresh.select(*EVENT_COLUMNS).write.options(**STORED).parquet(paths["cleaned"])
        fs, path = hadoop_path(self.spark, work)
        fs.delete(path, True)
        cleaned = self.spark.read.schema(EVENT_SCHEMA).parquet(paths["cleaned"])
        cleaned.select(*KEY_COLUMNS).write.options(**STORED).parquet(paths["keys"])
        metrics.minute_totals(cleaned).write.parquet(paths["minutes"])
        return cleaned.count()

    def publish_manifest(
        self, query_id: str, batch_id: int, attempt: str, rows: int, version: int
    ) -> bool:
        """Commits an attempt that merged with this ledger version; false if there is a later one."""
        entry = {"query_id": query_id, "batch_id": batch_id, "attempt": attempt, "row_count": rows}
        return self.ledger.append(version + 1, entry)

    def compact(self, version: int) -> None:
        """Ledger and keys up to a version as one table and a few runs. Safe beside writers and readers."""
        pointer = self.ledger.pointer()
        entries = [e for e in self.ledger.tail(pointer["version"]) if e["ledger_version"] <= version]
        runs, rows = pointer.get("runs", []), sum(e["row_count"] for e in entries)
        if rows:
            new = write_run(self._keys_of(entries), rows, f"{self.root}/keyindex")
            runs = merged_runs(self.spark, [*runs, new], f"{self.root}/keyindex")
        self.ledger.compact(version, runs=runs)

    def expire_batches(self, before: datetime) -> int:
        """Retire the events of batches committed before a time: out of the readers' sight first,
        then off the store. Keys and ledger stay, so nothing expired is ever accepted again."""
        old = self.manifests().filter(F.col("committed_at") < F.lit(before))
        old = old.join(self._expired().select(*ATTEMPT), list(ATTEMPT), "left_anti")
        retired = f"{self.root}/expired/{uuid.uuid4().hex}"
        old.select(*T.StructType.fromDDL(MANIFEST_SCHEMA).names).write.json(retired)
        gone = self.spark.read.schema(MANIFEST_SCHEMA).json(retired)
        total = 0
        for row in gone.toLocalIterator():
            for layer in ("cleaned", "minutes"):
                path = self.attempt_path(layer, row["query_id"], row["batch_id"], row["attempt"])
                fs, target = hadoop_path(self.spark, path)
                fs.delete(target, True)
            total += 1
        return total


def layer_sample(frame: DataFrame, limit: int = 5) -> tuple[int, DataFrame]:
    """Row count and a few rows of a layer."""
    if limit < 0:
        raise ValueError("limit must be nonnegative")
    return frame.count(), frame.limit(limit)


# ---- classifier line ------------------------------------------------------------------


def write_event_batch_a(frame: DataFrame, batch_id: int, table_path: str) -> None:
    """Insert-ignore on event id and source position; a batch replaces its own attempt."""
    spark = frame.sparkSession
    target = f"{table_path}/batch_id={batch_id}"
    # Staged first: the merge reads the batch several times, its lineage runs once.
    stage = f"{table_path.rstrip('/')}_stage/batch_id={batch_id}-{uuid.uuid4().hex}"
    columns = frame.schema.fields
    frame = numbered(frame, f"{stage}/rows")
    rows, existing = frame.count(), frame.drop("_row").limit(0)
    if path_exists(spark, table_path):
        existing = (
            spark.read.schema(T.StructType([*columns, T.StructField("batch_id", T.LongType())]))
            .parquet(table_path)
            .filter(F.col("batch_id") < batch_id)
            .drop("batch_id")
        )
    fresh = merge.merge_stored_batch(frame, existing, existing, rows, f"{stage}/merging")
    fresh.write.options(**STORED).mode("overwrite").parquet(target)
    fs, path = hadoop_path(spark, stage)
    fs.delete(path, True)


def write_metric_batch_a(frame: DataFrame, batch_id: int, table_path: str) -> None:
    """Replace-upsert on (minute, region) as versions; `read_metrics_a` keeps the newest."""
    frame.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")


def read_metrics_a(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest version of every minute: one partial maximum per key, no ranking."""
    rows = spark.read.parquet(table_path)
    keys = ["minute_start", "region"]
    body = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*body), "batch_id").alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def compact_metrics_a(spark: SparkSession, table_path: str, target_path: str) -> None:
    """The newest versions alone, as one new table that continues under the last batch id."""
    last = spark.read.parquet(table_path).agg(F.max("batch_id")).first()[0]
    if last is not None:
        read_metrics_a(spark, table_path).write.parquet(f"{target_path}/batch_id={last}")
