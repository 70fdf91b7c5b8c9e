"""Exact top-k, sharding, embedding near-dedup, LM scoring, quality, mixing, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cargolume.llm import levels, mixing, mtree, ngrams, quality, sharding, vectors
from cargolume.llm.queries.op10 import op10_mixing
from cargolume.session import scratch_dir

from .helpers import DOCUMENTS, SMALL, WORD, classes, corpus, shingle_sets


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(corpus(), DOCUMENTS)


def points(seed=1, width=8):
    """Clusters, isolated and equal vectors; null, empty, zero, short and broken ones."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, width))
    rows = [*base, *(base[0] + rng.normal(scale=0.05, size=(30, width))), *(base[1] * 3 for _ in range(5)), base[2], base[2]]
    rows = [[float(x) for x in r] for r in rows]
    rows += [None, [], [0.0] * width, [1.0] * (width - 1), [2.0] * (width - 1), [math.nan] * width, [math.inf] * width, [None] + [1.0] * (width - 1)]
    return [(i, r, 0) for i, r in enumerate(rows)] + [(3, rows[3], 0), (None, rows[4], 0)]


VECTORS = "vec_id bigint, embedding array<double>, node int"


def good(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def test_mtree_equals_brute_force(spark):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in points() if i is not None and good(v)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<bigint>")
    for k in (3, 500):
        got: dict = {}
        for r in mtree.top_inner_products(frame, frame.filter("id % 3 = 0").dropDuplicates(["id"]), k).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], int(r["score"]))
        for i, v in rows:
            if i % 3 == 0:
                want = sorted(((-sum(map(lambda a, b: a * b, v, w)), j) for j, w in rows if j != i and len(w) == len(v)))[:k]
                assert got.get(i, {}) == {n: (j, -s) for n, (s, j) in enumerate(want, 1)}
    assert mtree.top_inner_products(frame.limit(0), frame, 3).count() == 0


def test_mtree_avoids_distances(spark, monkeypatch):
    """On clustered points most pages of the tree are never opened."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 6)) * 50
    rows = np.rint(np.repeat(centres, 200, axis=0) + rng.normal(size=(12_800, 6))).astype(int)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id bigint, vector array<bigint>")
    tree = mtree.build_trees(frame)[6]
    opened = Counter()
    real = mtree.pages_of
    monkeypatch.setattr(mtree, "pages_of", lambda *a: opened.update([a]) or real(*a))
    scores = rows @ rows[7]
    order = np.lexsort((np.arange(len(rows)), -scores))
    assert tree.search(rows[7:8].astype(float), np.array([7]), 5) == [[(float(scores[j]), int(j)) for j in order if j != 7][:5]]
    assert len(opened) < 0.5 * sum(tree.groups)


def test_near_vectors_equal_brute_force(spark):
    rows = points()
    usable = [(n, i, np.array(v) / np.linalg.norm(v)) for n, (i, v, _) in enumerate(rows) if i is not None and good(v) and any(v)]
    links = [(a, b) for a, i, v in usable for b, j, w in usable if a < b and len(v) == len(w) and v @ w >= 0.95]
    count = Counter(x for pair in links for x in pair)
    ids = {n: i for n, i, _ in usable}
    want = classes(set(ids.values()), [(ids[a], ids[b]) for a, b in links])
    got = vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    by_id = {ids[n]: count[n] for n in ids}
    for r in got:
        assert (r["n_links"], r["component_id"]) == (by_id.get(r["vec_id"], 0), want.get(r["vec_id"], r["vec_id"]))
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert vectors.near_vectors(spark.createDataFrame(rows, VECTORS).limit(0)).count() == 0


def chained(count=90, width=6, seed=4):
    """Unit vectors in a chain of close steps, a tight group, and loose ones."""
    rng = np.random.default_rng(seed)
    walk = [rng.normal(size=width)]
    for _ in range(count):
        step = walk[-1] / np.linalg.norm(walk[-1]) + rng.normal(size=width) * 0.05
        walk.append(step)
    tight = rng.normal(size=width) + rng.normal(size=(count, width)) * 0.02
    return [v.tolist() for v in [*walk, *tight, *rng.normal(size=(count, width))]]


@pytest.mark.parametrize("blind", [False, True])
def test_near_vectors_deal_blocks_and_follow_the_audit(spark, monkeypatch, blind):
    """Components of many blocks; and, where the candidate search finds nothing, the audit's links count."""
    rows = list(enumerate(chained()))
    points = np.array([v for _, v in rows])
    points /= np.linalg.norm(points, axis=1)[:, None]
    near = points @ points.T >= 0.95
    np.fill_diagonal(near, False)
    want = classes(set(range(len(rows))), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    monkeypatch.setattr(vectors, "BLOCK", 16)
    if blind:
        monkeypatch.setattr(vectors, "AUDITED", 4096)
        monkeypatch.setattr(vectors, "first_edges", lambda nodes, *a: spark.createDataFrame([], vectors.EDGES))
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(near[i].sum()), want.get(i, i)) for i, _ in rows}


def test_codes_follow_bits():
    few = [vectors.codes_for(bits, 0.95, 16) for bits in (1, 13, 24, 30)]
    assert few[0] == 16 and few == sorted(few)
    agree = 1 - math.acos(0.95) / math.pi
    assert all(1 - (1 - agree**b) ** c >= vectors.RECALL for b, c in zip((1, 13, 24, 30), few))


def test_quantiser_clips_nothing():
    for logs in (np.array([-1e-3, -9.5, -14.25, -0.5]), np.array([-3.0, -3.0]), np.zeros(0)):
        level = ngrams.quantised(logs, "x")
        back = ngrams.restored(level, "x", np.arange(len(logs)))
        assert (np.abs(back - logs) <= level["x_range"][1] / 2 + 1e-12).all()


def test_elias_fano():
    rng = random.Random(8)
    for n, top in ((0, 1), (1, 10), (500, 400), (3000, 10**9)):
        values = np.array(sorted(rng.sample(range(top + n), n)), dtype=np.int64)
        code = levels.EliasFano(levels.ef_arrays(values, "x"), "x")
        if n:
            assert (code.get(np.arange(n)) == values).all()
        assert (code.find(values) == np.arange(n)).all()
        absent = np.setdiff1d(np.array([rng.randrange(top + n + 5) for _ in range(500)]), values)
        assert (code.find(absent) == -1).all()


def test_level_files(spark):
    folder = scratch_dir(spark, "levels")
    arrays = {"a": np.arange(5, dtype=np.uint32), "b": np.zeros(0), "c": np.array([1.5])}
    levels.save_arrays(folder, "f", arrays)
    assert all((levels.map_arrays(folder, "f")[k] == v).all() for k, v in arrays.items())


def test_language_model_equals_brute_force(spark, documents):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = [[*WORD.findall((r[1] or "").translate(low)), None] for r in corpus()]
    fold = [zlib.crc32(str(r[0]).encode()) % 5 == 1 if r[0] is not None else False for r in corpus()]
    c, pairs = Counter(), Counter()
    for t, out in zip(texts, fold):
        if not out:
            c.update(t)
            pairs.update(zip([None, *t[:-1]], t))
    n, v, after = sum(c.values()), len(c), Counter(u for u, _ in pairs)
    once, twice = (sum(x == y for x in pairs.values()) for y in (1, 2))
    d = once / (once + 2 * twice)
    from cargolume.llm.common import fold_of

    model = ngrams.train_model(documents.filter(fold_of("doc_id", 5) != 1))
    assert (model.n, model.v) == (n, v)
    tries = [ngrams.segment_trie(model.folder, segment) for segment in model.offsets]
    step = max(t[f"{k}_range"][1] for t in tries for k in ("probability", "weight"))
    got = documents.select("doc_id", "text", ngrams.score_texts(model).alias("s")).collect()
    for (doc, text, s), t in zip(got, texts):
        base = score = 0.0
        for u, w in zip([None, *t[:-1]], t):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            score += math.log10(max(pairs[u, w] - d, 0) / c[u] + d * after[u] / c[u] * p) if c[u] else math.log10(p)
        assert (s["n_tokens"], s["n_known"]) == (len(t), sum(c[w] > 0 for w in t))
        assert s["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(s["score"] - score) <= len(t) * step / 2 + 1e-9
    empty = ngrams.train_model(documents.limit(0))
    assert documents.select(ngrams.score_texts(empty)["score"]).distinct().collect()[0][0] == 0


def test_quality_on_held_out_rows(spark):
    from cargolume.llm.queries.op9 import op9_quality

    rows = {r["doc_id"]: r for r in op9_quality(spark, SMALL).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [(rows[i]["score"], q) for i, q in labels.items() if rows[i]["held_out"]]
    ones, zeros = ([s for s, q in held if q == x] for x in (1, 0))
    assert zeros and sum(a > b for a in ones for b in zeros) >= 0.95 * len(ones) * len(zeros)


def test_quality_edges(spark, documents):
    nothing = spark.createDataFrame([], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    model = quality.train(documents, nothing, F.lit(False))
    assert {r[0] for r in documents.select(quality.scorer(model)("text")).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 1), (2, None), (None, 1)], "doc_id bigint, quality int")
    scores = [r[0] for r in documents.select(quality.scorer(quality.train(documents, some, F.lit(False)))("text")).collect()]
    assert len(scores) == len(corpus()) and all(0 <= s <= 1 for s in scores)


def test_hypergeometric_law():
    rng = random.Random(1)
    drawn = [sharding.draw_hypergeometric(rng, 30, 50, 20) for _ in range(20_000)]
    assert np.mean(drawn) == pytest.approx(7.5, abs=0.06) and np.var(drawn) == pytest.approx(20 * 0.375 * 0.625 * 60 / 79, rel=0.05)
    counts = [rng.randrange(50) for _ in range(30)]
    matrix = sharding.draw_matrix(counts, 7, 3)
    assert [sum(r) for r in matrix] == counts
    assert sorted({sum(c) for c in zip(*matrix)}) in ([sum(counts) // 7], [sum(counts) // 7, sum(counts) // 7 + 1])
    assert sharding.draw_hypergeometric(rng, 10**12, 10**13, 10**9) > 0


def test_shards(spark, documents):
    from pyspark.sql import functions as F

    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rank"))
    got = sharding.uniform_shards(rows, F.col("rank"), 24, partitions=16, parts=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in corpus())
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.uniform_shards(rows.repartition(5), F.col("rank"), 24, partitions=16, parts=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.uniform_shards(rows.limit(0), F.col("rank"), 24).count() == 0


def water(sizes, weights, total, most):
    """Water-filling by repeated clamping."""
    full: set = set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        target = [most * sizes[i] if i in full else left * weights[i] / sum(weights[j] for j in open_) for i in range(len(sizes))]
        over = {i for i in open_ if target[i] >= most * sizes[i]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 5, 7], [3, 900, 900, 0, 2], [5]])
def test_water_filling(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "key string, source_size bigint")
    got = {r["key"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mixture(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op10_mixing(spark, str(tmp_path)).collect()
    assert len(rows) == len(corpus()) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for target in {(r["source_size"], r["target"]) for r in rows}:
        own = [r for r in rows if (r["source_size"], r["target"]) == target]
        assert abs(sum(r["taken"] for r in own) - target[1]) <= largest
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == documents.columns
    # rows without words are repeated like the others of their source; all others as often as taken
    copies = Counter((r["doc_id"], r["text"]) for r in mixed.collect() if WORD.search(r["text"] or ""))
    want = Counter()
    for r in rows:
        if r["size"]:
            want[r["doc_id"]] += r["taken"] // r["size"]
    assert Counter({i: n for i, n in want.items() if n}) == sum((Counter({i: n}) for (i, _), n in copies.items()), Counter())
    assert mixing.mix_documents(documents.limit(0)).count() == 0


def test_mixture_never_repeats_beyond_the_maximum(spark):
    # source a is clamped at two readings, rows without words included; the caller's names are its own
    rows = [(n, "" if n % 4 == 0 else "one two", "a", 1, 2, 3, 4, 5) for n in range(40)]
    rows += [(100 + n, "word " * 50, "b", 1, 2, 3, 4, 5) for n in range(40)]
    frame = spark.createDataFrame(rows, 'doc_id long, text string, source string, `__key` int, `__whole` int, `__cut` int, whole int, `a.b` int')
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == frame.columns
    got = mixed.collect()
    copies = Counter(r["doc_id"] for r in got)
    assert max(copies.values()) <= 2
    assert all(copies[n] == 2 for n in range(40))
    assert {tuple(r)[3:] for r in got} == {(1, 2, 3, 4, 5)}


def test_pipeline_stages(spark, documents, tmp_path):
    """Every stage against a brute-force version on its own input."""
    sf = str(tmp_path)
    documents.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i != 7)) for i in range(40)], "doc_id bigint, quality int").write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_classifier", "minhash_near_dedup", "source_mixing", "bpe_encoding"]
    kept = stages["quality_classifier"](spark, documents, sf)
    assert kept.columns == documents.columns and kept.count() >= 35
    unique = stages["minhash_near_dedup"](spark, documents, sf).collect()
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    sets = shingle_sets(texts)
    groups = classes(texts, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert sorted(r["doc_id"] for r in unique if r["doc_id"] is not None) == sorted(set(groups.values()))
    assert sum(r["doc_id"] is None for r in unique) == 1
    mixed = stages["source_mixing"](spark, documents, sf)
    words = sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect())
    total = sum(len(WORD.findall(r[1] or "")) for r in corpus())
    assert words <= 1.5 * total + 20_000
    whole = corpus_pipeline.run(spark, sf)
    assert {"token_ids", "n_tokens", "decoded_text", *documents.columns} <= set(whole.columns)
    assert whole.count() > 0
    empty = documents.limit(0)
    for stage in stages.values():
        assert stage(spark, empty, sf).count() == 0
