"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as its letters, lower-cased, every run of other characters one space. Each language has
an order-ORDER model in sorted arrays of 64-bit n-gram hashes beside their log probabilities, and of
context hashes beside their back-off weights:

    P_k(c | h) = (c_k(hc) - D_k) / c_k(h) + D_k t(h) / c_k(h) P_{k-1}(c | h'),   D_k = n1 / (n1 + 2 n2)

with raw counts at the highest order, below it the number of different characters seen in front, and
t(h) the different characters seen behind h; the lowest order mixes with a uniform one. A text goes to
the language of lowest cross-entropy per character. Texts of the learning sample that no model has seen
calibrate a temperature, which turns entropies into a score, and each language's highest entropy still
accepted: `accepted` is false where the best language fits worse than that.

The sample: at most about SAMPLE different texts a language, those of smallest text hash, read whole;
their n-grams are counted by Spark, and the GRAMS most frequent a language are kept. So the model is
bounded by languages x GRAMS whatever the corpus. Everything else covers all rows.

Cases: a null text or one without a letter is `und`, score 0, not accepted; ties go to the first
language by code point; texts of any length are read whole, a slice at a time; equal texts of a language
count once in the sample; without learning rows every text is `und`; empty tables give empty results;
other columns do not matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume.llm.blocks import MIX, blocks, mixed
from cargolume.llm.common import written

ORDER = 5
#: Bounds of the learning sample: different texts, and n-grams kept, a language.
SAMPLE, GRAMS = 2000, 400_000
#: One sampled text of so many calibrates instead of being counted.
CALIBRATING = 8
#: Bytes of text looked at together.
BLOCK = 1 << 18
UNKNOWN = "und"
SPACE = 32
TEMPERATURES = 2.0 ** np.arange(0, 9)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks that go with them."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.frombuffer(bytes(2 if k == "L" else k == "M" for k in kinds), dtype=np.uint8)


def decoded(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 sequences that begin at these offsets."""
    wide = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    lead = data[at].astype(np.uint32)
    one, two, three = ((wide[at + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3))
    out = np.where(lead < 0x80, lead, ((lead & 0x1F) << 6) | one)
    out = np.where(lead >= 0xE0, ((lead & 0x0F) << 12) | (one << 6) | two, out)
    out = np.where(lead >= 0xF0, ((lead & 0x07) << 18) | (one << 12) | (two << 6) | three, out)
    return np.minimum(out, 0x10FFFF)


def symbol_runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, symbols, begins, letters): text first + i owns symbols[begins[i]:begins[i + 1]].

    Its own are preceded by ORDER - 1 symbols of context: spaces, or, where a long text goes on in
    another run, what stood before. `letters` counts each text's letters in the run.
    """
    first = 0
    for data, cuts in blocks(pc.utf8_lower(texts), BLOCK):
        if len(cuts) == 2 and len(data) > BLOCK:
            context, at = None, 0
            while at < len(data):
                end = min(at + BLOCK, len(data))
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                symbols, begins, found = _symbols(data[at:end], np.array([0, end - at]), context)
                yield first, symbols, begins, found
                context, at = symbols[-(ORDER - 1) :], end
        else:
            yield first, *_symbols(data, cuts, None)
        first += len(cuts) - 1


def _symbols(data: np.ndarray, cuts: np.ndarray, context: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = decoded(data, at)
    owner = np.searchsorted(cuts, at, "right") - 1
    kinds = letters()[points]
    texts = len(cuts) - 1
    found = np.bincount(owner[kinds == 2], minlength=texts)
    points = np.where(kinds > 0, points, SPACE)
    pad = ORDER - 1
    spaces = np.full((texts, pad), SPACE, dtype=np.uint32)
    if context is not None:
        spaces[0] = context
    before = np.empty(len(points), dtype=np.uint32)
    before[1:] = points[:-1]
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    before[heads] = spaces[owner[heads], -1]
    kept = (points != SPACE) | (before != SPACE)
    points, owner = points[kept], owner[kept]
    sizes = np.bincount(owner, minlength=texts) + pad
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begins[-1], dtype=np.uint32)
    out[(begins[:-1, None] + np.arange(pad)).ravel()] = spaces.ravel()
    out[np.arange(len(points)) + (owner + 1) * pad] = points
    return out, begins, found


def codes_of(windows: np.ndarray) -> np.ndarray:
    """A 64-bit code of each row of symbols."""
    out = np.zeros(len(windows), dtype=np.uint64)
    for k in range(windows.shape[1]):
        out = mixed((out + windows[:, windows.shape[1] - 1 - k].astype(np.uint64) + np.uint64(1)) * MIX[k])
    return out


@dataclass
class CharacterModel:
    """One language: per order, sorted hashes of n-grams and of contexts with their logarithms."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    unknown: float = 0.0

    def logs(self, windows: np.ndarray, codes: list[np.ndarray], behind: list[np.ndarray]) -> np.ndarray:
        """log P of the last symbol of each window; codes[k]: of its last k + 1 symbols, behind[k]: of the k before the last."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        for k in range(len(self.grams) - 1, -1, -1):
            hit, value = found_in(*self.grams[k], codes[k][left])
            out[left] += value
            left = left[~hit]
            out[left] += found_in(*self.contexts[k], behind[k][left])[1]
        out[left] += self.unknown
        return out


def found_in(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


def kneser_ney(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> CharacterModel:
    """The model of these n-grams (rows of ORDER code points) and their counts; alphabet: symbols in use, known or not."""
    levels = [(grams, counts.astype(float), None)]
    while levels[-1][0].shape[1] > 1:
        shorter, of = np.unique(levels[-1][0][:, 1:], axis=0, return_inverse=True)
        of = of.ravel()
        levels[-1] = (*levels[-1][:2], of)
        levels.append((shorter, np.bincount(of, minlength=len(shorter)).astype(float), None))
    model, lower, floor = CharacterModel(), None, 1.0 / alphabet
    for rows, seen, of in reversed(levels):
        once, twice = (seen == 1).sum(), (seen == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.0
        _, heads, context = np.unique(codes_of(rows[:, :-1]), return_index=True, return_inverse=True)
        total, kinds = np.bincount(context, weights=seen), np.bincount(context)
        weight = np.maximum(discount * kinds / total, 1e-9)  # what is left for shorter contexts
        p = (seen - discount) / total[context] + weight[context] * (floor if of is None else lower[of])
        keys, behind = codes_of(rows), codes_of(rows[heads][:, :-1])
        by, under = np.argsort(keys), np.argsort(behind)
        model.grams.append((keys[by], np.log(p)[by].astype(np.float32)))
        model.contexts.append((behind[under], np.log(weight)[under].astype(np.float32)))
        lower = p
    model.unknown = float(np.log(floor))
    return model


@dataclass
class LanguageModel:
    names: list[str]
    models: list[CharacterModel]
    temperature: float = 16.0
    limits: list[float] = field(default_factory=list)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text x language) cross-entropies in nats per symbol, and the letters of each text."""
        sums, length, found = np.zeros((len(texts), len(self.names))), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        pad = ORDER - 1
        for first, symbols, begins, letters_in in symbol_runs(texts):
            texts_in = len(begins) - 1
            found[first : first + texts_in] += letters_in
            sizes = np.diff(begins) - pad
            length[first : first + texts_in] += sizes
            if not sizes.sum():
                continue
            windows = np.lib.stride_tricks.sliding_window_view(symbols, ORDER)
            own = np.ones(len(windows), dtype=bool)
            own[(begins[1:-1, None] - 1 - np.arange(pad)).ravel()] = False  # windows across two texts
            windows = windows[own]
            told = pa.array(codes_of(windows)).dictionary_encode()
            index = told.indices.to_numpy()
            heads = np.empty(len(told.dictionary), dtype=np.int64)
            heads[index[::-1]] = np.arange(len(index))[::-1]
            windows = windows[heads]
            codes = [codes_of(windows[:, ORDER - 1 - k :]) for k in range(ORDER)]
            behind = [codes_of(windows[:, ORDER - 1 - k : -1]) for k in range(ORDER)]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            full = np.flatnonzero(sizes)
            for j, model in enumerate(self.models):
                logs = model.logs(windows, codes, behind)[index]
                sums[first + full, j] -= np.add.reduceat(logs, edges[full])
        return sums / np.maximum(length, 1)[:, None], found

    def scores(self, entropies: np.ndarray) -> np.ndarray:
        z = -self.temperature * (entropies - entropies.min(axis=1, keepdims=True))
        return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray) -> None:
        """The temperature of least log loss on texts no model has seen, and each language's limit."""
        self.limits = [np.inf] * len(self.names)
        if not len(truth):
            return
        losses = []
        for self.temperature in TEMPERATURES:
            of_truth = self.scores(entropies)[np.arange(len(truth)), truth]
            losses.append(-np.log(np.maximum(of_truth, 1e-12)).mean())
        self.temperature = float(TEMPERATURES[int(np.argmin(losses))])
        for j in range(len(self.names)):
            own = entropies[truth == j, j]
            if len(own):
                middle = np.median(own)
                self.limits[j] = float(middle + 3 * max(np.quantile(own, 0.99) - middle, 0.1))


def sampled(documents: DataFrame, text: str, lang: str, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, calibrating): about `sample` different texts of each language, of smallest hash."""
    named = documents.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    share = named.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = named.withColumn("place", place).join(F.broadcast(share), "lang").filter("place <= share")
    digest = F.md5(F.col("text").cast("binary"))
    calibrating = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(CALIBRATING)) == 0
    return drawn.withColumn("digest", digest).dropDuplicates(["lang", "digest"]).select("lang", "text", calibrating.alias("calibrating"))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of a table of lang and text: n-grams of ORDER symbols, as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            for j, name in enumerate(names.dictionary.to_pylist()):
                own = batch.column(1).filter(pc.equal(names.indices, j))
                for _, symbols, begins, _ in symbol_runs(own):
                    windows = np.lib.stride_tricks.sliding_window_view(symbols, ORDER) if len(symbols) >= ORDER else np.zeros((0, ORDER), np.uint32)
                    keep = np.ones(len(windows), dtype=bool)
                    keep[(begins[1:-1, None] - 1 - np.arange(ORDER - 1)).ravel()] = False
                    windows = windows[keep]
                    _, heads, n = np.unique(codes_of(windows), return_index=True, return_counts=True)
                    flat = windows[heads].astype("<u4").tobytes().decode("utf-32-le")
                    grams = [flat[k : k + ORDER] for k in range(0, len(flat), ORDER)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, grams: int = GRAMS) -> LanguageModel:
    """Models of every language named in `documents`."""
    drawn, _ = written(sampled(documents, text, lang, sample), "language-sample")
    counted, _ = written(gram_counts(drawn.filter("not calibrating")), "language-grams")
    least: dict[str, int] = {}
    room: dict[str, int] = {}
    for name, n, rows in sorted(counted.groupBy("lang", "n").count().collect(), key=lambda r: (r[0], -r[1])):  # one row a count met
        room[name] = room.get(name, grams) - rows
        if room[name] >= 0:
            least[name] = n
    names, models = [], []
    if least:
        bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
        kept = counted.filter(F.col("n") >= F.coalesce(F.element_at(bound, F.col("lang")), F.lit(2**62))).toArrow()
        points = {n: _points(kept.filter(pc.equal(kept["lang"], n))["gram"]) for n in sorted(least)}
        alphabet = len(np.unique(np.concatenate([p.ravel() for p in points.values()]))) + 1
        for name in sorted(least):
            counts = kept.filter(pc.equal(kept["lang"], name))["n"].to_numpy()
            names.append(name)
            models.append(kneser_ney(points[name], counts, alphabet))
    model = LanguageModel(names, models)
    if names:
        rows = drawn.filter("calibrating").filter(F.col("lang").isin(names)).select("lang", entropy_udf(model)("text").alias("e")).filter("e is not null").collect()
        model.calibrate(np.array([r["e"] for r in rows]).reshape(len(rows), len(names)), np.array([names.index(r["lang"]) for r in rows], dtype=int))
    return model


def _points(grams: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, ORDER)


def entropy_udf(model: LanguageModel):
    """text -> cross-entropies by language; null for texts without a letter."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            entropies, found = model.entropies(texts)
            yield pa.array([e if n else None for e, n in zip(entropies.tolist(), found.tolist())], pa.list_(pa.float64()))

    return run


def identify(model: LanguageModel, text: Column | str) -> Column:
    """struct(lang_pred, score, accepted, entropy) of a text."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_()), ("entropy", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double, accepted: boolean, entropy: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if not model.names:
                yield pa.array([{"lang_pred": UNKNOWN, "score": 0.0, "accepted": False, "entropy": None}] * len(texts), kind)
                continue
            entropies, found = model.entropies(texts)
            best = entropies.argmin(axis=1)
            lowest = entropies[np.arange(len(best)), best]
            score = model.scores(entropies)[np.arange(len(best)), best]
            limit = np.array(model.limits or [np.inf] * len(model.names))[best]
            some = found > 0
            names = np.where(some, np.array(model.names, dtype=object)[best], UNKNOWN)
            fields = [pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(some & (lowest <= limit)), pa.array(lowest, mask=~some)]
            yield pa.StructArray.from_arrays(fields, fields=list(kind))

    return run(text)
