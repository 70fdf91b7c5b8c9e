import random
from datetime import UTC, datetime, timedelta

import golden
import numpy as np
import pytest

from cargolume.operators import chunking, merge, quality, retrieval
from cargolume.plans import ops, publication
from cargolume.plans.build import build_models


def results(spark, *statuses):
    return spark.createDataFrame(
        [(f"c{n}", s) for n, s in enumerate(statuses)], "unique_id string, status string"
    )


@pytest.mark.parametrize("statuses", [[], ["pass", "fail"], ["warn"], [None], ["pass", "skipped"]])
def test_gate_fails_closed(spark, statuses):
    with pytest.raises(ValueError):
        quality.require_verified(results(spark, *statuses))


def test_publication_lifecycle(spark, tmp_path):
    models = build_models(golden.frame(spark), str(tmp_path / "models"))
    store = publication.Publications(spark, str(tmp_path / "product"))
    build_id = store.begin("k")
    with pytest.raises(ValueError):
        store.publish(build_id, models, results(spark, "fail"))
    assert publication.latest_successful_build(store.builds()).count() == 0
    store.fail(build_id, "checks failed")
    assert store.begin("k") == build_id
    store.publish(build_id, models, results(spark, "pass", "success"))
    assert store.successful_build_for_key("k") == build_id
    with pytest.raises(ValueError):
        store.begin("k")
    build = store.builds().first()
    assert (build["status"], build["source_event_count"]) == ("succeeded", 12)
    rows = publication.metric_range_read(
        store.snapshot("payments"), "payment_hour_utc", build_id, golden.hour(10), golden.hour(11)
    )
    assert rows.count() == 2
    other = store.begin("k2")
    models["mart_revenue_hourly"].write.parquet(f"{store.root}/revenue/build_id={other}")
    assert store.snapshot("revenue").count() == 3  # unfinished build stays invisible


def test_read_bounds():
    now = datetime(2026, 9, 8, tzinfo=UTC)
    assert publication.read_interval(None, None, now)[0] == now - timedelta(days=1)
    for start, end in ((now, now), (now - timedelta(days=32), now), (datetime(2026, 9, 7), now)):
        with pytest.raises(ValueError):
            publication.read_interval(start, end, now)


def test_percentiles_match_numpy(spark):
    rng = random.Random(7)
    values = [round(rng.lognormvariate(2, 1), 3) for _ in range(5000)] + [3.0] * 2500
    frame = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(8)
    marks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    row = ops.exact_percentiles(frame, "g", "v", marks).first()
    for name, fraction in marks.items():
        assert row[name] == pytest.approx(np.quantile(values, fraction), abs=1e-9)
    ranked = ops.exact_percentiles(frame, "g", "v", marks, interpolate=False).first()
    assert ranked["p95"] == sorted(values)[int((len(values) - 1) * 0.95)]


def test_vector_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    frame = spark.createDataFrame(
        [(str(i), [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, embedding array<float>"
    ).repartition(5)
    queries = [("a", [float(x) for x in vectors[0]]), ("b", [float(x) for x in vectors[1]])]
    got = retrieval.vector_topk(frame, queries, 7).orderBy("query_id", "rank").collect()
    wide = vectors.astype("float64")
    for n, (name, _) in enumerate(queries):
        d = 1 - wide @ wide[n] / np.linalg.norm(wide, axis=1) / np.linalg.norm(wide[n])
        best = sorted(range(300), key=lambda i: (d[i], str(i)))[:7]
        assert [r["id"] for r in got if r["query_id"] == name] == [str(i) for i in best]


def test_chunks_are_bounded_and_stable(spark):
    text = (
        "before\n# One\n\npara one\n\npara two\n## Empty\n# One\n" + "x" * 4000 + "\n\nlast\r\n### Ünï & co \nend"
    )
    frame = spark.createDataFrame([("d", text), ("e", ""), ("f", "# only")], "document_id string, text string")
    rows = chunking.chunk_documents(frame).orderBy("section_id", "ordinal").collect()
    assert {r["document_id"] for r in rows} == {"d"}
    ids = [r["chunk_id"] for r in rows]
    assert ids == ["d:introduction-1:0", "d:n-co-1:0", "d:one-1:0", "d:one-2:0", "d:one-2:1", "d:one-2:2"]
    assert [len(r["chunk_text"]) for r in rows if r["section_id"] == "one-2"] == [1800, 1800, 406]
    assert rows[2]["chunk_text"] == "para one\n\npara two"


def test_retrieval_modes():
    assert retrieval.retrieval_mode(None, "m") == "unavailable"
    assert retrieval.retrieval_mode("m", None) == "lexical_fallback"
    assert retrieval.retrieval_mode("m", "m") == "semantic"
    with pytest.raises(ValueError):
        retrieval.retrieval_mode("m", "n")


def test_hot_event_id_is_cut_before_the_shuffle(spark):
    batch = golden.frame(spark)
    plan = merge.dedup_candidates(batch)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_stage_identity_is_deterministic():
    assert merge.stage_identity("q", 1) == merge.stage_identity("q", 1) != merge.stage_identity("q", 2)
    for bad in (("", 1), ("q", -1)):
        with pytest.raises(ValueError):
            merge.stage_identity(*bad)


def test_corpus_rebuild_keeps_unchanged(spark):
    schema = "document_id string, title string, topic string, source_path string, content_sha256 string"
    old = spark.createDataFrame([("a", "t", "x", "p", "1"), ("b", "t", "x", "p", "1"), ("c", "t", "x", "p", "1")], schema)
    new = spark.createDataFrame([("a", "t", "x", "p", "1"), ("b", "t2", "x", "p", "1"), ("d", "t", "x", "p", "1")], schema)
    actions = retrieval.reconcile_corpus(old, new)
    assert {r[0]: r[1] for r in actions.collect()} == {"a": "keep", "b": "update", "c": "delete", "d": "insert"}
    chunk = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document_id string")
    rebuilt = retrieval.rebuild_chunks(chunk("a", "b", "c"), actions, chunk("a", "b", "d"))
    assert sorted(r[0] for r in rebuilt.collect()) == ["a", "b", "d"]
