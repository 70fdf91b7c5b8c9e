import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolume.llm import dedup, vectors
from tests.llm.helpers import DOCUMENTS, classes, corpus, prose, shingle_sets


def linked(texts: dict) -> dict:
    sets = shingle_sets(texts)
    return classes(texts, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def one_bucket(monkeypatch):
    """All texts with words meet in one band, and in no other."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n]+"), lambda w: w != "")) > 0
    keys = F.when(words, F.array(F.lit(1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    monkeypatch.setattr(dedup, "signature_udf", lambda *_: lambda _: keys)


def test_large_buckets_are_tested_in_full(spark, monkeypatch):
    one_bucket(monkeypatch)
    rows = [r for r in corpus() if r[0] is not None]
    # a group of near copies, and outliers near to one member only
    rng = random.Random(5)
    base = prose(rng, 100).split()
    for n in range(40):
        words = base.copy()
        words[2 * n] = "group"
        rows.append((1000 + n, " ".join(words), "en", "a", 1))
    for n in range(3):
        words = rows[-30 + n][1].split()
        words[90 - n :] = [f"tail{n}"] * (4 + n)
        rows.append((2000 + n, " ".join(words), "en", "a", 1))
    want = linked({r[0]: r[1] for r in rows})
    got = dedup.near_duplicates(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert len(got) == len(rows)


@pytest.mark.parametrize("counted", [False, True])
def test_reaching_pairs_hold_every_similar_pair(spark, counted):
    rng = random.Random(6)
    base = [prose(rng, 60, 60) for _ in range(4)]
    rows = []
    for n in range(120):
        words = base[n % 4].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((n, " ".join(words[: rng.randrange(48, 61)])))
    texts = spark.createDataFrame(rows, "node bigint, text string")
    held = texts.select("node", dedup.shingle_udf(5, counted)("text").alias("codes"))
    members = held.select("node", (F.col("node") % 7).alias("label"))
    codes = {r["node"]: set(r["codes"]) for r in held.collect()}
    want = {(a, b) for a in codes for b in codes if a < b and a % 7 != b % 7 and len(codes[a] & codes[b]) >= 0.8 * len(codes[a] | codes[b])}
    got = {tuple(r) for r in dedup._reaching(members, held, 0.8).collect()}
    assert want and want <= got


def test_links_out_of_saturated_groups(spark):
    # groups of more vectors than a list holds: near inside, still linked across, and one group apart
    rng = np.random.default_rng(4)
    axis = np.eye(32)
    centres = [axis[0], 0.961 * axis[0] + np.sqrt(1 - 0.961**2) * axis[1], axis[2]]
    points = np.concatenate([c + rng.normal(size=(60, 32)) * 0.004 for c in centres])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    unit = vectors.unit(points)
    near = unit @ unit.T >= 0.95
    assert near[:60, 60:120].any() and near.sum(axis=1).min() > vectors.NEIGHBOURS
    want = classes(range(180), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == want
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(near[i].sum()) - 1 for i in range(180)}
