"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn. Each step fits a shallow tree of one feature's bins to the
loss gradient and adds it to that feature's lookup table; the strongest pairs then get tables of two
features the same way. A score is the sum of a row's table entries, looked up by bin, through a logistic.

The model is fitted on about `SAMPLE` labelled rows at most, drawn by a hash of id and text and brought to
the driver as numbers; scoring covers every row.

Cases: a null text is empty, an empty text scores by the bins of zero counts; texts of any length are
read whole; repeated labels of one id count as their mean, null labels not at all; without labels, or
with one class only, every score is the smoothed share of label 1 (0.5 without labels); empty tables
give empty results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolume.llm.common import written
from cargolume.llm.blocks import MIX, blocks, word_codes, word_starts

#: Largest number of labelled rows the model is fitted on.
SAMPLE = 20_000
#: Bytes of text looked at together: worker memory follows it.
TOGETHER = 1 << 18
FEATURES = (
    "log_chars log_words upper_share letter_share digit_share bangs_per_word bars_per_word "
    "symbols_per_word stops_per_word repeated_share distinct_share mean_word longest_word lines_per_word"
).split()

# one bit per kind of byte
SPACE, UPPER, LETTER, DIGIT, BANG, BAR, SYMBOL, STOP, LINE, HEAD = (1 << n for n in range(10))


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint16)
    for codes, bits in (
        (b" \t\v\f\r\n", SPACE), (b"\n", LINE), (range(65, 91), UPPER | LETTER), (range(97, 123), LETTER),
        (range(48, 58), DIGIT), (b"!?", BANG), (b"|", BAR), (b"#$%&*~^_=+<>@\\/{}[]", SYMBOL), (b".,;:", STOP),
        (range(192, 256), LETTER), (range(192), HEAD), (range(192, 256), HEAD),
    ):
        for c in codes:
            kinds[c] |= bits
    kinds[128:192] &= ~np.uint16(HEAD)  # continuation bytes are no characters of their own
    return kinds


KINDS = _kinds()


def _block(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Features of the texts data[cuts[i]:cuts[i + 1]]."""
    docs = len(cuts) - 1
    kinds = KINDS[data]
    after = data[1:]
    kinds[1:][(data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E)] |= UPPER

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[cuts[1:]] - total[cuts[:-1]]).astype(float)

    chars, letters = count((kinds & HEAD) > 0), count((kinds & LETTER) > 0)
    solid = (kinds & SPACE) == 0
    starts, owner = word_starts(solid, cuts)
    words = np.bincount(owner, minlength=docs).astype(float)
    repeated, distinct, longest, total = (np.zeros(docs) for _ in range(4))
    if len(starts):
        code = word_codes(data, solid, starts)
        size = np.add.reduceat((solid & ((kinds & HEAD) > 0)).astype(np.int64), starts)
        same = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        repeated = np.bincount(owner[1:][same], minlength=docs).astype(float)
        mixed = code ^ (owner.astype(np.uint64) * MIX[0])
        by = np.argsort(mixed)
        new = np.concatenate([[True], mixed[by][1:] != mixed[by][:-1]])
        distinct = np.bincount(owner[by][new], minlength=docs).astype(float)
        total = np.bincount(owner, weights=size, minlength=docs)
        np.maximum.at(longest, owner, size)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    per_word = [count((kinds & k) > 0) / w for k in (BANG, BAR, SYMBOL, STOP)]
    return np.column_stack([
        np.log1p(chars), np.log1p(words), count((kinds & UPPER) > 0) / np.maximum(letters, 1), letters / c,
        count((kinds & DIGIT) > 0) / c, *per_word, repeated / w, distinct / w, total / w, np.log1p(longest),
        count((kinds & LINE) > 0) / w,
    ])


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; whole texts, a bounded number of bytes at a time."""
    return np.concatenate([np.zeros((0, len(FEATURES))), *(_block(*b) for b in blocks(texts, TOGETHER))])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = features_of(texts)
        yield pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), pa.array(rows.ravel()))


@dataclass
class Gam:
    """Lookup tables: `edges[f]` cuts feature f into bins, `single[f]` and `pairs` hold what bins add."""

    base: float
    learnt: int = 0
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.single)):
            out += table[np.searchsorted(edges, rows[:, f], "left")]
        for (f, g), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[f], rows[:, f], "left"), np.searchsorted(self.coarse[g], rows[:, g], "left")]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(rows), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges between quantiles: halfway between two values met, so none lies on an edge."""
    seen = np.unique(values)
    at = np.unique(np.searchsorted(seen, np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]), "left"))
    at = at[at < len(seen) - 1]
    return (seen[at] + seen[at + 1]) / 2


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> int:
    """Bins [0, k) against the rest, k of largest gain; 0: no split."""
    if len(g) < 2:
        return 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b, ridge) + _gain(g.sum() - a, h.sum() - b, ridge) - _gain(g.sum(), h.sum(), ridge)
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """What a shallow tree over the ordered bins adds to each of them."""
    k = _split(g, h, ridge) if depth else 0
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:k], h[:k], ridge, depth - 1), _tree(g[k:], h[k:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """One cut across, then the best cut of each half along the other axis; and its gain."""
    best, found = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            table, gain = np.zeros_like(a), 0.0
            for part in (slice(0, k), slice(k, None)):
                u, v = a[part].sum(axis=0), b[part].sum(axis=0)
                table[part] = _tree(u, v, ridge, 1)
                j = _split(u, v, ridge)
                gain += _gain(u[:j].sum(), v[:j].sum(), ridge) + _gain(u[j:].sum(), v[j:].sum(), ridge)
            if gain > best:
                best, found = gain, table.T if turned else table
    return found, best - float(_gain(g.sum(), h.sum(), ridge))


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15, bins: int = 48, coarse: int = 8, pairs: int = 6, ridge: float = 4.0) -> Gam:
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Gam(float(np.log(share / (1 - share))), len(labels))
    if len(np.unique(labels)) < 2:
        return model
    model.edges = [_cuts(v, bins) for v in rows.T]
    model.coarse = [_cuts(v, coarse) for v in rows.T]
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    place = [np.searchsorted(e, v, "left") for e, v in zip(model.edges, rows.T)]
    wide = [np.searchsorted(e, v, "left") for e, v in zip(model.coarse, rows.T)]
    logit = np.full(len(rows), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for f, at in enumerate(place):
            g, h = slopes()
            n = len(model.single[f])
            step = rate * _tree(np.bincount(at, g, n), np.bincount(at, h, n), ridge)
            model.single[f] += step
            logit += step[at]

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[f]) + 1, len(model.coarse[g]) + 1
        return np.bincount(wide[f] * shape[1] + wide[g], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    both = [(f, k) for f in range(rows.shape[1]) for k in range(f) if len(model.coarse[f]) and len(model.coarse[k])]
    gains = {p: _pair_tree(grid(*p, g), grid(*p, h), ridge)[1] for p in both}
    for p in sorted(gains, key=lambda p: (-gains[p], p))[:pairs]:
        model.pairs[p] = np.zeros((len(model.coarse[p[0]]) + 1, len(model.coarse[p[1]]) + 1))
    for _ in range(pair_rounds):
        for (f, k), table in model.pairs.items():
            g, h = slopes()
            step = rate * _pair_tree(grid(f, k, g), grid(f, k, h), ridge)[0]
            table += step
            logit += step[wide[f], wide[k]]
    return model


def train(documents: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> Gam:
    """A model from rows with `doc_id` and `text`, and labels with `doc_id` and `quality`.

    `held_out` is a column expression over doc_id: rows where it is true are never learnt from. Learnt
    from are about `sample` labelled rows, those whose hash of id and text lies below a share taken from
    their count, so features are computed for them alone and no more of them reach the driver. Rows
    equal in id and text count once.
    """
    marks = labels.filter("quality is not null and doc_id is not null").filter(~held_out)
    marks, _ = written(marks.groupBy("doc_id").agg(F.avg("quality").alias("quality")), "quality-labels")
    labelled = documents.select("doc_id").join(marks, "doc_id").count()
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    drawn = documents.select("doc_id", "text").filter(place < int(min(1.0, sample / max(labelled, 1)) * (1 << 40)))
    drawn = drawn.join(marks, "doc_id").withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = drawn.dropDuplicates(["doc_id", "digest"]).select("quality", text_features("text").alias("features")).toPandas()
    if kept.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    rows, good = np.stack(kept["features"]), (kept["quality"] >= 0.5).to_numpy(dtype=float)
    by = np.lexsort((*rows.T, good))  # sums do not depend on the order rows arrive in
    return fit(rows[by], good[by])


def scorer(model: Gam):
    """text -> score; features and look-ups in one pass over a batch."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(features_of(texts)))

    return run
