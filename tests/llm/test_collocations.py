"""Phrase collocations against brute force; the trie under tight limits."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cargolume.llm import collocations as co


def brute(rows, least=co.LEAST, shown=co.SHOWN):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f = {}
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    inside[part] = max(inside[part], a)
        kept = []
        for p, a in found.items():
            if len(p) == 2 and 100 * inside[p] >= 50 * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:shown], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows(seed, lines=60):
    rng = random.Random(seed)
    out = []
    for _ in range(lines):
        words = [rng.choice(["The", "of", "a", "new", "york", "city", "É", "中文", "x-1", "\x00", "w\xa0w"] + [f"w{k}" for k in range(30)]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?"]) for w in words)
        out.append((text + "New York City " * rng.randrange(3), rng.choice(["en", "fr", None])))
    return [*out, ("", "en"), (None, None), (" ,. ", "fr"), ("a" * 5000 + " b", "en"), out[0], out[0], ("The of. " * 400 + "a new " * 500, "en"), ("lone", "zz")]


def frame(spark, some):
    return spark.createDataFrame([(*r, 1, "x") for r in some], "text string, lang string, n int, w1 string").repartition(3)


def result(made):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in made.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    some = rows(seed)
    assert result(co.collocations(frame(spark, some))) == brute(some)
    assert result(co.collocations(frame(spark, some), least=2, shown=7)) == brute(some, 2, 7)


def pairs_and_triples(some):
    want = Counter()
    for text, lang in some:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", *w[i : i + 2], None) for i in range(len(w) - 1))
            want.update((lang or "und", *w[i : i + 3]) for i in range(len(w) - 2))
    return want


LONG = ("one two three. " * 300 + "a b " * 400 + "," + " " * 3000 + "c d" + " " * 3000 + "e " + "x" * 3000 + " f " * 50, "en")


def counted(runs):
    got = Counter()
    for r in runs.collect():
        got[(r["lang"], *(bytes(r[w]).decode() if r[w] is not None else None for w in ("w1", "w2", "w3")))] += r["n"]
    return got


def test_tight_limits_change_nothing(spark):
    some = [*rows(3, 20), LONG]
    every = np.full(8, 255, dtype=np.uint8)
    assert counted(co.phrase_runs(frame(spark, some), every, every, entries=500, burst=8)) == pairs_and_triples(some)


@pytest.mark.parametrize("block", [64, 997])
def test_slices_count_every_phrase_once(monkeypatch, block):
    some = [*rows(3, 20), LONG]
    monkeypatch.setattr(co, "BLOCK", block)
    monkeypatch.setattr("cargolume.llm.blocks.BLOCK", block)
    batch = pa.record_batch([pa.array([r[1] or "und" for r in some]), pa.array([r[0] for r in some])], ["lang", "text"])
    got, vocabulary = Counter(), co.Vocabulary()
    for ids, piece, text, fresh in co.tokens(batch, vocabulary, 2):
        told = [bytes(vocabulary.words[i]).decode() for i in ids]
        for i in range(len(told)):
            lang = some[text[i]][1] or "und"
            if i >= 1 and i >= fresh and piece[i - 1] == piece[i]:
                got[(lang, told[i - 1], told[i], None)] += 1
            if i >= 2 and i >= fresh and piece[i - 2] == piece[i]:
                got[(lang, *told[i - 2 : i + 1])] += 1
    assert got == pairs_and_triples(some)


def test_slices_carry_phrases_over_cuts(monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 7)
    monkeypatch.setattr("cargolume.llm.blocks.BLOCK", 7)
    text = "aa bb cc dd ee, ff gg hh ii jj kk"
    parts = [bytes(d).decode() for _, d, _, _, _ in co.slices(pa.array([text]))]
    assert "".join(parts) == text and len(parts) > 3
    assert all(not (a[-1:].isalpha() and b[:1].isalpha()) for a, b in zip(parts, parts[1:]))


def test_trie_bursts_and_spills_whole_subtrees():
    trie, rng = co.Trie(burst=5), np.random.default_rng(1)
    want, got, burst = Counter(), Counter(), False

    def take(room):
        for first, keys, counts in trie.spill(room):
            assert (np.diff(keys) > 0).all() and first not in trie.root
            got.update({(first, k): n for k, n in zip(keys.tolist(), counts.tolist())})

    for _ in range(30):
        some = Counter((int(a), int(b) << 31 | int(c)) for a, b, c in rng.integers(0, 6, (50, 3)))
        want += some
        keys = sorted(some)
        trie.add(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([some[k] for k in keys]))
        burst |= bool(trie.nodes)
        if trie.entries > 120:
            take(60)
            assert trie.entries <= 60
    assert burst and trie.entries == sum(trie.sizes.values())
    take(0)
    assert got == want and not trie.root and trie.entries == 0


def test_bit_map_holds_every_code(spark):
    codes = [0, 1, 63, 64, -1, -(2**63), 2**63 - 1, 123456789123]
    bits = co.bit_map(spark.createDataFrame([(c,) for c in codes], "code bigint"), 12)
    assert {int(i) for i in np.flatnonzero(np.unpackbits(bits, bitorder="little"))} == {c & 4095 for c in codes}


def test_large_counts_stay_exact(spark):
    big = 9_999_999_999_999_99
    row = spark.createDataFrame([(big - 1, big, big)], "a bigint, l bigint, r bigint").select(co.strength("a", "l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * (big - 1) ** 2 // big**2 == 999_999


def test_empty_table(spark):
    assert result(co.collocations(spark.createDataFrame([], "text string, lang string"))) == []


@pytest.mark.parametrize("size, least, shown", [(3, 2, 5), (6, 2, 40), (6, 4, 2000), (32, 2, 40)])
def test_words_that_share_a_code_change_nothing(spark, size, least, shown):
    some = [*rows(4), ("of the sea . " * 12 + "by the sea . " * 11 + "on the sea at all . " * 10, "fr")]
    assert result(co.collocations(frame(spark, some), least=least, shown=shown, size=size)) == brute(some, least, shown)


def test_pass_with_texts_counts_what_is_shown_and_its_parts(spark, monkeypatch):
    rng, made = random.Random(5), []
    some = [(" ".join(rng.choice([f"w{k}" for k in range(12)]) for _ in range(400)), "en") for _ in range(40)]
    runs = co.phrase_runs
    monkeypatch.setattr(co, "phrase_runs", lambda *a, **k: made.append(runs(*a, **k)) or made[-1])
    assert result(co.collocations(frame(spark, some), shown=20)) == brute(some, shown=20)
    assert made[0].groupBy("w1", "w2", "w3").count().count() <= 3 * 20 < len([p for p, n in pairs_and_triples(some).items() if n >= co.LEAST]) / 10
