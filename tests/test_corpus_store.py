"""Corpus versions, percentile ranges over many groups, expiry in tasks."""

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolume.plans import ops
from cargolume.plans.corpus import CorpusStore

DOCUMENT = "document_id string, title string, topic string, source_path string, content string"


def documents(spark, rows):
    return spark.createDataFrame([(*r[:2], "t", "p", r[2]) for r in rows], DOCUMENT).withColumn("content_sha256", F.sha2("content", 256))


def words(frame):
    return frame.select("document_id", F.posexplode(F.split("content", " ")).alias("ordinal", "chunk_text"))


def seen(store, version=None):
    return sorted((r["document_id"], r["title"], r["ordinal"], r["chunk_text"]) for r in store.chunks(version).collect())


def test_versions_show_whole_documents(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "corpus"))
    first = documents(spark, [("a", "A", "one two"), ("b", "B", "three"), ("c", "C", "four five")])
    second = documents(spark, [("a", "A!", "one two"), ("b", "B", "six seven"), ("d", "D", "eight")])
    assert store.newest() == 0
    assert store.load(first, words) == 1
    assert store.load(first, words) == 1  # nothing changed, no version
    assert store.load(second, words) == 2
    assert seen(store, 1) == [("a", "A", 0, "one"), ("a", "A", 1, "two"), ("b", "B", 0, "three"), ("c", "C", 0, "four"), ("c", "C", 1, "five")]
    assert seen(store) == [("a", "A!", 0, "one"), ("a", "A!", 1, "two"), ("b", "B", 0, "six"), ("b", "B", 1, "seven"), ("d", "D", 0, "eight")]
    assert store.load(first, words) == 3  # the deleted one comes back
    assert seen(store) == seen(store, 1)
    with pytest.raises(ValueError):
        store.load(first.unionByName(first), words)


def test_interleaved_loads_commit_one_after_the_other(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "corpus"))
    other = CorpusStore(spark, str(tmp_path / "corpus"))
    mine = documents(spark, [("a", "A", "one"), ("b", "B", "two")])
    theirs = documents(spark, [("b", "B", "three"), ("c", "C", "four")])
    calls = []

    def meanwhile(frame):
        if not calls:
            calls.append(other.load(theirs, words))
        return words(frame)

    assert store.load(mine, meanwhile) == 2
    assert calls == [1]
    assert seen(store) == [("a", "A", 0, "one"), ("b", "B", 0, "two")]
    assert seen(store, 1) == [("b", "B", 0, "three"), ("c", "C", 0, "four")]


def test_percentiles_of_many_groups_and_ties(spark):
    rng = random.Random(11)
    rows = [(g, float(rng.randrange(40))) for g in ("x", "y", None) for _ in range(400)] + [("z", 5.0), ("w", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    marks = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r["g"]: r for r in ops.exact_percentiles(frame, "g", "v", marks).collect()}
    assert set(got) == {"x", "y", None, "z"}
    for g, row in got.items():
        values = [v for h, v in rows if h == g and v is not None]
        assert row["samples"] == len(values)
        assert row["mean"] == pytest.approx(np.mean(values))
        for name, fraction in marks.items():
            assert row[name] == pytest.approx(np.quantile(values, fraction))
    assert ops.exact_percentiles(frame.limit(0), "g", "v", marks).count() == 0


def test_expiry_deletes_in_tasks_and_may_run_twice(spark, tmp_path):
    from cargolume.sources.retention import expire, retention_candidates

    path = str(tmp_path / "old files")
    spark.range(40).repartition(5).write.parquet(path)
    later = datetime.now(UTC) + timedelta(days=90)
    old = retention_candidates(spark, [path], later, 30)
    listed = spark.createDataFrame(old.select("path").collect(), "path string")
    files = listed.count()
    for _ in range(2):
        assert expire(listed, dry_run=False) == {"dry_run": False, "candidates": files, "deleted": files}
    assert retention_candidates(spark, [path], later, 30).count() == 0
