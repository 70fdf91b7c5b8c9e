"""The streamed cooldown against the batch fold, over a restart and any number of files a trigger."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cargolume.plans.detectors import cooldown_sequence
from cargolume.streaming.cooldown import Cooldown, start_cooldown

SCHEMA = "uniqueness_key string, detector_name string, region_code string, detected_at timestamp"


def incidents(seed, hours=60):
    rng = random.Random(seed)
    start = datetime(2026, 9, 1)
    return [
        (f"{detector}-{region}-{h:03}", detector, region, start + timedelta(hours=h))
        for h in range(hours)
        for detector in ("a", "b")
        for region in ("x", "y")
        if rng.random() < 0.4
    ]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_fold_after_restart(spark, tmp_path, files):
    rows = incidents(files)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        for n in range(3):
            part = half[n * len(half) // 3 : (n + 1) * len(half) // 3]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
        start_cooldown(stream, out, {"availableNow": True}).awaitTermination()
    got = sorted(r[0] for r in spark.read.schema(SCHEMA).parquet(out).collect())
    fold = cooldown_sequence(spark.createDataFrame(rows, SCHEMA))
    assert got == sorted(r[0] for r in fold.select("uniqueness_key").collect())
    assert 0 < len(got) < len(rows)
    # no two kept ones of a key lie within the cooldown
    kept = spark.read.schema(SCHEMA).parquet(out)
    apart = kept.alias("l").join(kept.alias("r"), ["detector_name", "region_code"]).filter("r.detected_at > l.detected_at")
    least = apart.agg(F.min(F.expr("unix_seconds(r.detected_at) - unix_seconds(l.detected_at)"))).first()[0]
    assert least > 6 * 3600


def test_state_must_outlive_the_cooldown():
    with pytest.raises(ValueError):
        Cooldown(hours=6, state_hours=5)
