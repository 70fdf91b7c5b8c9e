"""Ids are shuffled as bytes and come back as they were."""

import re

from pyspark.sql import functions as F

from cargolume.functions.exprs import packed_id, unpacked_id
from cargolume.operators import merge

IDS = [
    "0a1b2c3d-0000-4fff-a123-0123456789ab", "0a1b2c3d-0000-4fff-a123-0123456789abx", "0A1B2C3D-0000-4fff-a123-0123456789ab",
    "0a1b2c3d00004fffa1230123456789ab", "0a1b2c3d-0000-4fff-a123-0123456789ab\n", "", "é中\U0001f600", "\x00", None,
]


def test_round_trip_without_collisions(spark):
    rows = spark.createDataFrame([(i,) for i in IDS], "id string").select("id", packed_id("id").alias("p"))
    got = rows.select("id", "p", unpacked_id("p").alias("back")).collect()
    assert all(r["id"] == r["back"] for r in got)
    assert len({r["p"] and bytes(r["p"]) for r in got}) == len(IDS)
    assert len(got[0]["p"]) == 17


def test_ids_are_shuffled_as_bytes(spark):
    batch = spark.range(5).selectExpr(
        "concat('0A1B2C3D-0000-4fff-a123-0123456789a', id % 2) event_id", "'t' source_topic", "0 source_partition", "id source_offset")
    plan = merge.dedup_candidates(batch)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window .*event_id#\d+", plan)
    assert merge._candidates(batch).schema["event_id"].dataType.simpleString() == "binary"
    got = {tuple(r) for r in merge.dedup_candidates(batch).select("event_id", "source_offset").collect()}
    assert got == {(f"0a1b2c3d-0000-4fff-a123-0123456789a{n}", n) for n in (0, 1)}
    known = batch.filter("source_offset = 2").withColumn("event_id", F.lower("event_id"))
    fresh = merge.merge_new_events(batch, known)
    assert [tuple(r) for r in fresh.select("event_id", "source_offset").collect()] == [("0a1b2c3d-0000-4fff-a123-0123456789a1", 1)]
