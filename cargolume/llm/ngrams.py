"""Scores by a bigram language model in an Elias-Fano trie.

Counting: each Arrow batch's word pairs are counted at once and sent, sorted and compressed, to the
segment of their first word's code. A segment's task merges them; its words, in code order, get the ids
from the segment's offset on, so ids need no second sort. Then each segment's trie is built: a word's
pointer and, made monotone by what came before, its successors' ids are Elias-Fano sequences; the
interpolated, absolutely discounted probabilities and the back-off weights are quantised to a byte, over
the range each level holds, so no value is clipped.
Levels are files in the shared folder that tasks memory-map; scoring looks a successor up in its
context's range by successor search.

    P(w | u) = max(c(u, w) - D, 0) / c(u) + D t(u) / c(u) P(w),   P(w) = (c + 0.5) / (N + 0.5 (V + 1))

with t(u) the different successors of u, D = n1 / (n1 + 2 n2) from the pairs seen once and twice. A text
begins behind an end token; an unseen context leaves P(w).

Cases: null texts are empty, an empty text is one end token; texts of any length are read whole;
repeated rows are learnt and scored as often as they occur; without training rows every probability is
1 / 1, log 0; empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolume.llm.blocks import BLANK, MIX, blocks, mixed, word_codes, word_starts
from cargolume.session import scratch_dir

END = int(mixed(MIX[50:51])[0])
#: Word pairs counted together before they are sent.
TOGETHER = 2_000_000


def tokens(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text) of a block: A-Z lowered, words, and an end token behind each text."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~BLANK[data]
    starts, owner = word_starts(solid, cuts)
    codes = word_codes(data, solid, starts)
    texts = len(cuts) - 1
    words = np.bincount(owner, minlength=texts)
    place = np.arange(len(codes)) + owner
    out = np.full(len(codes) + texts, END, dtype=np.uint64)
    out[place] = codes
    return out, np.repeat(np.arange(texts), words + 1)


def contexts(codes: np.ndarray) -> np.ndarray:
    """The token before each: the end token before a text's first."""
    return np.concatenate([np.array([END], dtype=np.uint64), codes[:-1]])


def summed(one: np.ndarray, two: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((two, one))
    one, two, counts = one[by], two[by], counts[by]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    heads = np.flatnonzero(new)
    return one[heads], two[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def packed(one: np.ndarray, two: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(one, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([steps.tobytes(), two.tobytes(), counts.astype(np.uint32).tobytes()]))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 20
    return np.cumsum(np.frombuffer(raw, np.uint64, n)), np.frombuffer(raw, np.uint64, n, 8 * n), np.frombuffer(raw, np.uint32, n, 16 * n).astype(np.int64)


def pair_counts(texts: DataFrame, bits: int) -> DataFrame:
    """(segment, pairs): packed counts; texts has one string column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> pa.RecordBatch:
            one = np.concatenate([h[0] for h in held])
            two = np.concatenate([h[1] for h in held])
            held.clear()
            one, two, counts = summed(one, two, np.ones(len(one), dtype=np.int64))
            cuts = np.searchsorted(one >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            parts = [(s, packed(one[a:b], two[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["segment", "pairs"])

        for batch in batches:
            for data, cuts in blocks(batch.column(0)):
                codes, _ = tokens(data, cuts)
                held.append((contexts(codes), codes))
                n += len(codes)
                if n >= TOGETHER:
                    yield send()
                    n = 0
        if held:
            yield send()

    return texts.mapInArrow(run, "segment int, pairs binary")


SUMMARY = "segment int, words bigint, tokens bigint, pairs bigint, once bigint, twice bigint"


def merge_segments(counted: DataFrame, folder: str) -> DataFrame:
    """Writes each segment's words and pairs; returns one row of sums per segment."""

    def run(table: pa.Table) -> pa.Table:
        segment = table["segment"][0].as_py()
        one, two, counts = (np.concatenate(x) for x in zip(*(unpacked(b.as_py()) for b in table["pairs"])))
        one, two, counts = summed(one, two, counts)
        heads = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(one)]]))
        totals = np.add.reduceat(counts, heads)
        save_arrays(folder, f"words-{segment}", {"codes": one[heads], "counts": totals})
        save_arrays(folder, f"pairs-{segment}", {"two": two, "counts": counts, "sizes": sizes})
        row = (segment, len(heads), int(totals.sum()), len(one), int((counts == 1).sum()), int((counts == 2).sum()))
        kinds = [pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in SUMMARY.split(", ")])

    from cargolume.llm.levels import save_arrays

    return counted.groupBy("segment").applyInArrow(run, SUMMARY)


class Words:
    """Ids and counts of words, over the memory-mapped files of all segments."""

    def __init__(self, folder: str, bits: int, offsets: dict[int, int]):
        from cargolume.llm.levels import map_arrays

        self.bits, self.offsets = bits, offsets
        self.levels = {s: map_arrays(folder, f"words-{s}") for s in offsets}

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each code of a sorted array; -1 and 0 where unknown."""
        ids, counts = np.full(len(codes), -1, dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        cuts = np.searchsorted(codes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1))
        for s, offset in self.offsets.items():
            part = slice(cuts[s], cuts[s + 1])
            level = self.levels[s]
            at = np.minimum(np.searchsorted(level["codes"], codes[part]), len(level["codes"]) - 1)
            known = level["codes"][at] == codes[part]
            ids[part] = np.where(known, at + offset, -1)
            counts[part] = np.where(known, level["counts"][at], 0)
        return ids, counts


def quantised(logs: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Bytes from the smallest (0) to the largest (255) of the values, and that range."""
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    step = (high - low) / 255
    return {name: np.rint((logs - low) / (step or 1.0)).astype(np.uint8), f"{name}_range": np.array([low, step])}


def restored(trie: dict, name: str, at: np.ndarray) -> np.ndarray:
    low, step = trie[f"{name}_range"]
    return low + trie[name][at] * step


def build_tries(spark: SparkSession, folder: str, bits: int, offsets: dict[int, int], n: int, v: int, discount: float) -> None:
    """Each segment's successor level, from its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cargolume.llm.levels import ef_arrays, map_arrays, save_arrays

        for batch in batches:
            for s in batch.column(0).to_pylist():
                words = segment_words(folder, bits, tuple(offsets.items()))
                pairs = map_arrays(folder, f"pairs-{s}")
                total = words.levels[s]["counts"]
                sizes, counts = pairs["sizes"], pairs["counts"]
                unique, inverse = np.unique(pairs["two"], return_inverse=True)
                ids, seen = words.find(unique)
                ids, seen = ids[inverse], seen[inverse]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                ends = np.cumsum(sizes)
                by = np.lexsort((ids, owner))  # ids follow codes already; segments may not
                ids, seen, counts = ids[by], seen[by], counts[by]
                context = total[owner]
                lower = (seen + 0.5) / (n + 0.5 * (v + 1))
                p = (counts - discount) / context + discount * sizes[owner] / context * lower
                base = np.concatenate([[0], np.cumsum(ids[ends - 1] + 1)])
                save_arrays(folder, f"trie-{s}", {
                    **ef_arrays(np.concatenate([[0], ends]), "pointer"),
                    **ef_arrays(base, "base"),
                    **ef_arrays(ids + base[owner], "next"),
                    **quantised(np.log10(p), "probability"),
                    **quantised(np.log10(discount * sizes / total), "weight"),
                })
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], ["segment"])

    rows = spark.createDataFrame([(int(s),) for s in offsets], "segment bigint")
    rows.repartition(max(1, len(offsets)), "segment").mapInArrow(run, "segment bigint").count()


@lru_cache(maxsize=1)
def segment_words(folder: str, bits: int, offsets: tuple[tuple[int, int], ...]) -> Words:
    return Words(folder, bits, dict(offsets))


class Model:
    """A model in the shared folder; picklable, its files are mapped where it is used."""

    def __init__(self, folder: str, bits: int, offsets: dict[int, int], n: int, v: int):
        self.folder, self.bits, self.offsets, self.n, self.v = folder, bits, offsets, n, v

    def score(self, data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """n_tokens, n_known, base score, score of each text of a block."""
        words = segment_words(self.folder, self.bits, tuple(self.offsets.items()))
        codes, owner = tokens(data, cuts)
        texts = len(cuts) - 1
        unique, inverse = np.unique(codes, return_inverse=True)
        ids, counts = words.find(unique)
        lower = np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))[inverse]
        known = counts[inverse] > 0
        first = int(np.searchsorted(unique, np.uint64(END)))
        before = np.concatenate([[first], inverse[:-1]])
        logs = lower.copy()
        where = (unique >> np.uint64(64 - self.bits)).astype(np.int64)
        by = np.argsort(where[before].astype(np.int16) if self.bits < 15 else where[before], kind="stable")
        edges = np.searchsorted(where[before][by], np.arange((1 << self.bits) + 1))
        spans = np.searchsorted(where, np.arange((1 << self.bits) + 1))
        for s, offset in self.offsets.items():
            trie = segment_trie(self.folder, s)
            some = np.arange(spans[s], spans[s + 1])[ids[spans[s] : spans[s + 1]] >= 0]
            if not len(some):
                continue
            place = ids[some] - offset
            start, weight = np.full(len(unique), -1, dtype=np.int64), np.zeros(len(unique))
            start[some] = trie["base"].get(place)
            weight[some] = restored(trie, "weight", place)
            at = by[edges[s] : edges[s + 1]]
            at = at[start[before[at]] >= 0]
            logs[at] += weight[before[at]]
            both = at[known[at]]
            found = trie["next"].find(start[before[both]] + ids[inverse[both]])
            inside = found >= 0
            low, high = trie["pointer"].get(ids[before[both[inside]]] - offset), trie["pointer"].get(ids[before[both[inside]]] - offset + 1)
            inside[inside] = (found[inside] >= low) & (found[inside] < high)  # of this context, not of a later one
            logs[both[inside]] = restored(trie, "probability", found[inside])
        sums = [np.bincount(owner, w, texts) for w in (known, lower, logs)]
        return [np.bincount(owner, minlength=texts), sums[0].astype(np.int64), sums[1], sums[2]]


@lru_cache(maxsize=4096)
def segment_trie(folder: str, segment: int) -> dict:
    from cargolume.llm.levels import EliasFano, map_arrays

    arrays = map_arrays(folder, f"trie-{segment}")
    return {k: EliasFano(arrays, k) for k in ("pointer", "base", "next")} | {k: arrays[k] for k in ("probability", "weight", "probability_range", "weight_range")}


def train_model(documents: DataFrame, text: str = "text") -> Model:
    spark = documents.sparkSession
    folder = scratch_dir(spark, "lm")
    bits = max(3, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    rows = sorted(merge_segments(pair_counts(documents.select(text), bits), folder).collect())  # one per segment
    offsets, n, v = {}, 0, 0
    for r in rows:
        offsets[r["segment"]] = v
        v, n = v + r["words"], n + r["tokens"]
    once, twice = sum(r["once"] for r in rows), sum(r["twice"] for r in rows)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    build_tries(spark, folder, bits, offsets, n, v, discount)
    return Model(folder, bits, offsets, n, v)


SCORES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score_texts(model: Model, text: str | Column = "text") -> Column:
    @F.arrow_udf(SCORES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.score(*block) for block in blocks(texts)]
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=k) for k in (int, int, float, float)]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names=SCORES.names)

    return run(text)
