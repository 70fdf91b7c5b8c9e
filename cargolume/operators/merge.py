"""Idempotent merges as DataFrame operators over append-only tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolume.contract import SOURCE_KEY
from cargolume.functions.exprs import packed_id, unpacked_id

# A micro-batch below this many rows may be broadcast as keys (16 bytes hash each and some).
BROADCAST_ROWS = 200_000
# A batch below this many rows may be broadcast as 64-bit codes of its keys.
BROADCAST_CODES = 2_000_000


def stage_identity(query_id: str, batch_id: int) -> str:
    """Deterministic name of a batch attempt."""
    if batch_id < 0 or not query_id:
        raise ValueError("query identity and nonnegative batch id required")
    return "stage_" + hashlib.sha256(f"{query_id}:{batch_id}".encode()).hexdigest()[:24]


def first_per(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key. Spark limits each map task to one row per key before the
    shuffle, so a hot key sends one row per task and not its whole group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def dedup_candidates(batch: DataFrame) -> DataFrame:
    """One row per event id: the lowest source position."""
    return _unpacked(_candidates(batch))


def _candidates(batch: DataFrame) -> DataFrame:
    """`dedup_candidates` with ids as bytes, as rows are shuffled by them."""
    return first_per(_packed(batch.withColumn("event_id", F.lower("event_id"))), ["event_id"], list(SOURCE_KEY))


def _packed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("event_id", packed_id("event_id"))


def _unpacked(frame: DataFrame) -> DataFrame:
    return frame.withColumn("event_id", unpacked_id("event_id"))


def _absent(batch: DataFrame, existing: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Batch rows whose key the existing table lacks.

    With a small batch the existing side is only scanned for its key columns and probed
    against the broadcast batch keys, so the large table is never shuffled. Otherwise one
    shuffled anti join does it.
    """
    present = existing.select(*keys)
    if small:
        wanted = batch.select(*keys).distinct()
        present = present.join(F.broadcast(wanted), keys, "left_semi").distinct()
    return batch.join(present, keys, "left_anti").select(*batch.columns)


def anti_existing_event_ids(batch: DataFrame, existing: DataFrame, small: bool = False) -> DataFrame:
    return _absent(batch, existing, ["event_id"], small)


def anti_existing_source(batch: DataFrame, existing: DataFrame, small: bool = False) -> DataFrame:
    return _absent(batch, existing, list(SOURCE_KEY), small)


def merge_new_events(
    batch: DataFrame,
    existing: DataFrame,
    batch_rows: int | None = None,
    existing_sources: DataFrame | None = None,
) -> DataFrame:
    """Rows of the batch to insert: first version of an id wins, as does a source position.

    `batch_rows` is the counted size of the batch; only a batch below the bound is
    broadcast, any other is joined by shuffle. `existing_sources` has the stored source
    positions where `existing` has only the ids that matter.
    """
    small = batch_rows is not None and batch_rows <= BROADCAST_ROWS
    fresh = anti_existing_source(
        anti_existing_event_ids(_candidates(batch), _packed(existing), small),
        existing if existing_sources is None else existing_sources,
        small,
    )
    return first_per(_unpacked(fresh), list(SOURCE_KEY), ["event_id"])


def _met_twice(batch: DataFrame, existing: DataFrame, code, rows: int) -> DataFrame:
    """Codes of keys that the batch holds more than once, or the batch and the existing table do.

    The existing table is probed against the codes of a batch that may be broadcast, so what is
    shuffled follows the batch and not the table.
    """
    own, known = batch.select(code.alias("_code")), existing.select(code.alias("_code"))
    if rows <= BROADCAST_CODES:
        known = known.join(F.broadcast(own), "_code", "left_semi").distinct()
    codes = own.unionByName(known)
    return codes.groupBy("_code").count().filter("count > 1").select("_code")


def merge_stored_batch(
    batch: DataFrame, ids: DataFrame, sources: DataFrame, rows: int, folder: str
) -> DataFrame:
    """`merge_new_events` for a batch that lies in storage, without its rows in a shuffle.

    `batch` has a row number `_row`, stored with it; `ids` and `sources` are what `existing` and
    `existing_sources` are there. Only 64-bit codes of the keys are shuffled. A row none of whose codes
    is met twice is new and concerns no other row; the few others are merged by their keys. Where they
    are many, all are merged by their keys alone. `folder` takes the numbers in between.
    """
    spark = batch.sparkSession
    id_code, at_code = F.xxhash64(F.lower("event_id")), F.xxhash64(*SOURCE_KEY)
    keys = batch.select("_row", "event_id", *SOURCE_KEY)

    def stored(frame: DataFrame, name: str) -> tuple[DataFrame, int]:
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.schema(frame.schema).parquet(f"{folder}/{name}")
        return frame, frame.count()

    met_ids, id_count = stored(_met_twice(batch, ids, id_code, rows), "ids")
    met_sources, source_count = stored(_met_twice(batch, sources, at_code, rows), "sources")
    lowered = batch.withColumn("event_id", F.lower("event_id"))
    if id_count == source_count == 0:
        return lowered.drop("_row")
    few = max(id_count, source_count) <= BROADCAST_ROWS
    if few:
        in_ids, in_sources = F.broadcast(met_ids), F.broadcast(met_sources)
        marked = keys.withColumns({"_id": id_code, "_at": at_code})
        by_id = marked.join(in_ids, F.col("_id") == F.col("_code"), "left_semi")
        rest = marked.join(in_ids, F.col("_id") == F.col("_code"), "left_anti")
        by_source = rest.join(in_sources, F.col("_at") == F.col("_code"), "left_semi")
        keys = by_id.unionByName(by_source).drop("_id", "_at")
        ids = ids.join(in_ids, id_code == F.col("_code"), "left_semi")
        sources = sources.join(in_sources, at_code == F.col("_code"), "left_semi")
    won, won_count = stored(merge_new_events(keys, ids, rows, sources).select("_row"), "won")
    if not few:
        won = F.broadcast(won) if won_count <= BROADCAST_ROWS else won
        return lowered.join(won, "_row", "left_semi").drop("_row")
    lost, lost_count = stored(keys.select("_row").join(won, "_row", "left_anti"), "lost")
    lost = F.broadcast(lost) if lost_count <= BROADCAST_ROWS else lost
    return lowered.join(lost, "_row", "left_anti").drop("_row")


def upsert_minute_additive(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Add the delta's counts and amounts to the minute totals."""
    both = existing.unionByName(delta)
    return both.groupBy("window_start", "window_end", "event_type").agg(
        F.sum("event_count").alias("event_count"),
        F.sum("total_amount").cast("decimal(24,2)").alias("total_amount"),
        F.max("updated_at").alias("updated_at"),
    )


def replace_by_key(existing: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed replace: rows of the delta win, all other existing rows stay."""
    kept = existing.join(delta.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(delta)


def incremental_delete_insert(target: DataFrame, source: DataFrame) -> DataFrame:
    """Fact refresh: rows with a source event in the new scan are replaced."""
    return replace_by_key(target, source, ["source_event_id"])
