"""Similarity of near-copy candidates: right for sets and multisets, and taken row by row."""

from collections import Counter

from pyspark.sql import functions as F

from cargolume.llm import dedup

TEXTS = ["a b c d e f g h", "a b c d e f g x", "a b c d e f g h a b c d e f g h", "u v", ""]


def test_similarity_is_exact_and_leaves_no_row(spark):
    for counted in (False, True):
        texts = spark.createDataFrame([*enumerate(TEXTS)], "node bigint, text string")
        held = texts.select("node", dedup.shingle_udf(5, counted)("text").alias("codes")).localCheckpoint()
        pairs = held.select(F.col("node").alias("a")).crossJoin(held.select(F.col("node").alias("b")))
        links = dedup._verified(pairs, held, 0.0)
        assert "EvalPython" not in links._jdf.queryExecution().toString()  # batches of pairs with both lists
        shingles = []
        for text in TEXTS:
            words = text.split()
            own = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
            shingles.append(own if counted else Counter({*own}))
        got = {(a, b): s for a, b, s in links.collect()}
        assert len(got) == len(TEXTS) ** 2
        for (a, b), s in got.items():
            union = max((shingles[a] | shingles[b]).total(), 1)
            assert s == (shingles[a] & shingles[b]).total() / union
