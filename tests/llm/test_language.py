"""Language identification: held-out accuracy, the model against a direct computation, defined cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cargolume.llm import language as lm
from cargolume.llm.queries.op11 import op11_language_id

from .helpers import SMALL


def direct(grams, counts, alphabet, text):
    """Cross-entropy by the recursion itself, over dictionaries of strings."""
    levels = [Counter({"".join(map(chr, g)): int(c) for g, c in zip(grams, counts)})]
    while len(next(iter(levels[-1]))) > 1:
        levels.append(Counter(g[1:] for g in levels[-1]))
    tables = {}
    for level in levels:
        order = len(next(iter(level)))
        n1, n2 = (sum(c == k for c in level.values()) for k in (1, 2))
        total, kinds = defaultdict(float), defaultdict(int)
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables[order] = level, n1 / (n1 + 2 * n2) if n1 else 0.0, total, kinds

    def p(gram):
        if not gram:
            return 1 / alphabet
        level, d, total, kinds = tables[len(gram)]
        h = gram[:-1]
        if h not in total:
            return p(gram[1:])
        weight = max(d * kinds[h] / total[h], 1e-9)
        if gram in level:
            return (level[gram] - d) / total[h] + weight * p(gram[1:])
        return weight * p(gram[1:])

    padded = " " * (lm.ORDER - 1) + text
    return -sum(math.log(p(padded[i : i + lm.ORDER])) for i in range(len(text))) / len(text)


def test_model_equals_the_recursion():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab bcé") for _ in range(60)).strip().replace("  ", " ") for _ in range(6)]
    grams = Counter()
    for t in texts[:4]:
        t = " ".join(t.split())
        padded = " " * (lm.ORDER - 1) + t
        grams.update(padded[i : i + lm.ORDER] for i in range(len(t)))
    rows, counts = np.array([[ord(c) for c in g] for g in grams], dtype=np.uint32), np.array(list(grams.values()))
    model = lm.LanguageModel(["x"], [lm.kneser_ney(rows, counts, 7)])
    checked = [" ".join(t.split()) for t in texts] + ["zzé", "b"]
    got, found = model.entropies(pa.array(checked))
    for t, e, n in zip(checked, got[:, 0], found):
        assert n == sum(c.isalpha() for c in t)
        assert e == pytest.approx(direct(rows, counts, 7, t), rel=1e-5), t


def test_probabilities_add_up_to_one():
    rng = random.Random(2)
    text = " " * (lm.ORDER - 1) + "".join(rng.choice("abcd") for _ in range(500))
    grams = Counter(text[i : i + lm.ORDER] for i in range(len(text) - lm.ORDER + 1))
    model = lm.kneser_ney(np.array([[ord(c) for c in g] for g in grams], dtype=np.uint32), np.array(list(grams.values())), 6)
    for head in ("abcd", "zzzz", "   a"):
        windows = np.array([[ord(c) for c in head + last] for last in "abcd z"], dtype=np.uint32)
        codes = [lm.codes_of(windows[:, lm.ORDER - 1 - k :]) for k in range(lm.ORDER)]
        behind = [lm.codes_of(windows[:, lm.ORDER - 1 - k : -1]) for k in range(lm.ORDER)]
        assert np.exp(model.logs(windows, codes, behind)).sum() == pytest.approx(1, abs=1e-4)


def test_slices_of_a_long_text_equal_one_run(monkeypatch):
    text = "Añb, ÇÉ 12 中文 def\U0001f600g " * 400
    model = lm.LanguageModel(["x"], [lm.kneser_ney(np.array([[32, 32, 32, 32, 97], [32, 98, 99, 100, 101]], dtype=np.uint32), np.array([2, 1]), 9)])
    monkeypatch.setattr(lm, "BLOCK", 1 << 20)
    whole = model.entropies(pa.array(["q", text, None, ""]))
    for size in (1000, 777, 4097):
        monkeypatch.setattr(lm, "BLOCK", size)
        sliced = model.entropies(pa.array(["q", text, None, ""]))
        assert np.allclose(whole[0], sliced[0]) and (whole[1] == sliced[1]).all()


def made(rng, letters, words):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(words))


def test_defined_cases(spark):
    rng = random.Random(3)
    rows = [(made(rng, "abcde", 40), "aa", "x") for _ in range(40)] + [(made(rng, "cdefg", 40), "bb", "x") for _ in range(40)]
    rows += [(rows[0][0], "aa", "x")] * 30 + [("1234", "aa", None), (None, "bb", None), ("abc", None, None)]
    model = lm.train(spark.createDataFrame(rows, "text string, lang string, score string"))
    assert model.names == ["aa", "bb"]
    asked = ["", None, "12 !?", "AB CAB", "gfe gfe", "é", "ab " * 100_000, "中文", rows[0][0]]
    frame = spark.createDataFrame([(t, 1) for t in asked], "text string, lang_pred int")
    got = {r["text"]: r["told"] for r in frame.select("text", lm.identify(model, "text").alias("told")).collect()}
    for t in ("", None, "12 !?"):
        assert (got[t]["lang_pred"], got[t]["score"], got[t]["accepted"], got[t]["entropy"]) == ("und", 0.0, False, None)
    assert got["AB CAB"]["lang_pred"] == got["ab " * 100_000]["lang_pred"] == "aa"
    assert got["gfe gfe"]["lang_pred"] == "bb"
    assert got["中文"]["lang_pred"] in ("aa", "bb") and not got["中文"]["accepted"]
    assert got[rows[0][0]]["accepted"] and all(0 <= v["score"] <= 1 for v in got.values())


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = lm.train(empty)
    told = spark.createDataFrame([("abc",)], "text string").select(lm.identify(model, "text").alias("t")).first()["t"]
    assert (told["lang_pred"], told["score"]) == ("und", 0.0)
    assert empty.select(lm.identify(model, "text")).count() == 0


def test_sample_is_bounded_and_of_different_texts(spark):
    rows = [(f"text {i % 500}", "a") for i in range(5000)]
    drawn = lm.sampled(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", sample=100).collect()
    assert 0 < len({r["text"] for r in drawn}) == len(drawn) <= 100


def test_held_out_accuracy(spark):
    told = op11_language_id(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = told.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
