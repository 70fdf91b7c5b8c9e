"""Fill-in-middle: brute force, exact round trip, repeated rows, long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cargolume.llm import fim
from cargolume.llm.blocks import BLOCK

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


def texts():
    rng = random.Random(4)
    letters = "abcXYZ  \n<>PSM</é中\U0001f600.1"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(120)]
    long = "".join(rng.choice(letters.replace("<", "")) for _ in range(150_000))
    some += ["", None, "<P>", "a<S>", "<", "<M", "ab" * 40_000, "é" * 30_000, long, "<" * 5000 + "x", "x y " * (BLOCK // 2)]
    return some


@pytest.fixture(scope="module")
def rows():
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    return [*rows, rows[3], rows[3], rows[-1], (None, "no id <", "x"), (None, None, "x"), (3, "same id", "x"), (-5, "below", "x")]


def test_equals_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, task string").repartition(3)
    got = Counter(tuple(r) for r in fim.fill_in_middle(frame).collect())
    assert got == Counter(brute(i, t)[0] for i, t, _ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_their_restoration(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, task string").repartition(3)
    out = fim.output_texts(fim.outputs(frame))
    got = out.select("doc_id", "form", "output", fim.restored_text(out["form"], out["output"]).alias("text")).collect()
    assert Counter((r["doc_id"], r["output"], r["text"]) for r in got) == Counter((i, brute(i, t)[1], t or "") for i, t, _ in rows)


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_marker_split_between_pieces():
    reader, got = fim.Reader("psm"), []
    for piece in (b"<", b"P", b">ab<", b"S>c", b"d<<", b"M", b">e"):
        got += reader.feed(piece)
    got += reader.close()
    assert [b"".join(d for p, d in got if p == k) for k in range(3)] == [b"ab", b"e", b"cd<"]


def test_long_units_equal_short_ones():
    data = np.frombuffer(("ab é1" * 3000 + "x" * 9000).encode(), dtype=np.uint8)
    long, whole = fim.Units(data), fim.unit_starts(data)
    assert long.n == len(whole)
    for j in (0, 1, 2047, 2048, 2049, long.n - 1):
        assert long.offset(j) == whole[j]
    assert long.offset(long.n) == len(data)
