"""The corpus pipeline: its stages and its whole result against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cargolume.llm import dedup, mixing
from cargolume.llm.quality import scorer, train
from cargolume.llm.queries.op3 import TOKENIZER
from cargolume.llm.queries.op10 import op10_mixing

from .helpers import DOCUMENTS, WORD, classes, corpus, prose, shingle_sets


def first_of_classes(rows):
    """Rows left by brute force: of each class of texts the one that comes first by (id, digest)."""
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    named = {(r[0], digest(r[1])): r for r in rows if r[0] is not None}
    texts = {}
    for key in sorted(named):
        if WORD.search(named[key][1] or ""):
            texts.setdefault(key[1], key)  # one node per text, under its smallest id
    keys = sorted(texts.values())
    sets = shingle_sets({k: named[k][1] for k in keys})
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    head = classes(keys, links)
    kept = [named[k] for k in keys if head[k] == k]
    kept += [r for k, r in named.items() if not WORD.search(r[1] or "")]
    return Counter([*kept, *(r for r in rows if r[0] is None)])


def clashing(rng):
    """Equal ids with different texts, copies under them, null ids, one long text."""
    a, b, c, d, e = (prose(rng, 40) for _ in range(5))
    rows = [(1, a), (2, b), (2, c), (3, c), (3, d), (4, e), (2, b), (5, a), (None, a), (None, "w"), (6, ""), (6, ""), (7, ""), (8, None)]
    rows += [(0, d + " more"), (9, "long " + prose(rng, 300_000, 10**6))]
    return [(i, t, "en", "s", 1) for i, t in rows]


@pytest.mark.parametrize("make", [lambda: corpus(), lambda: clashing(random.Random(8))])
def test_no_text_is_lost_and_none_stays_twice(spark, make):
    rows = make()
    frame = spark.createDataFrame(rows, DOCUMENTS)
    got = Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert got == first_of_classes(rows)


def test_names_that_clash_are_kept(spark):
    rows = [(*r, "own", 5, "x") for r in corpus()]
    frame = spark.createDataFrame(rows, DOCUMENTS + ", __digest string, __n int, kept string")
    kept = dedup.without_near_duplicates(frame)
    assert kept.columns == frame.columns and {tuple(r)[5:] for r in kept.collect()} == {("own", 5, "x")}


def test_unlabelled_corpus_stays(spark, tmp_path):
    frame = spark.createDataFrame(corpus(), DOCUMENTS)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality(spark, frame, str(tmp_path)).count() == frame.count()


def test_whole_result(spark, tmp_path):
    rng = random.Random(9)
    good = [prose(rng, rng.randrange(20, 60)) + "." for _ in range(120)]
    junk = [" ".join("#$% | !!" for _ in range(rng.randrange(20, 60))) for _ in range(60)]
    rows = [(i, t, "en", rng.choice("abc"), len(t)) for i, t in enumerate([*good, *junk])]
    rows += [(500 + k, rows[k][1], "en", "a", 1) for k in range(10)] + [(3, prose(rng, 30), "en", "b", 1)]
    labels = [(i, int(i < 120), 0) for i in range(180)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the classifier's decision is its own; the rest is computed anew from what it keeps
    documents, marks = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    model = train(documents, marks, corpus_pipeline.fold_of("doc_id", corpus_pipeline.FOLDS) == corpus_pipeline.HELD_OUT)
    good_rows = [tuple(r)[:5] for r in documents.withColumn("s", scorer(model)("text")).filter("s >= 0.7").collect()]
    assert len([r for r in good_rows if r[1] in good]) > 100 and not [r for r in good_rows if r[1] in junk]
    left = first_of_classes(good_rows)
    assert {r["doc_id"] for r in got} <= {r[0] for r in left}
    spark.createDataFrame(list(left.elements()), DOCUMENTS).write.parquet(str(tmp_path / "kept" / "documents.parquet"))
    taken = {r["doc_id"]: r["taken"] for r in op10_mixing(spark, str(tmp_path / "kept")).collect() if r["doc_id"] != 3}
    words, library = defaultdict(int), Tokenizer.from_file(TOKENIZER)
    for r in got:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert list(memoryview(bytes(r["token_ids"])).cast("I")) == ids
        assert r["decoded_text"] == library.decode(ids, skip_special_tokens=False)
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in words.items() if i != 3}
    assert mixing.SEED
