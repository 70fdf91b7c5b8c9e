"""Phrase collocation mining by HAT-trie counting.

Each map task counts in a trie of word ids whose first levels are nodes and whose leaves are hash
containers: a container that outgrows BURST is burst into one container per next word. When a task's
trie outgrows ENTRIES, whole subtrees, largest first, leave it as sorted runs and are emptied. Spark merges
the runs of all tasks per partition; the prefix that decides the partition is the whole phrase, as the
subtree of one frequent first word may hold a good part of all rows.

Three passes over the texts. The first counts words, and pairs by the 32-bit codes of their two words:
codes that do not reach LEAST rule their pairs out, and the rest goes to the tasks as a bit map of fixed
size (2 ** BITS bits). The second does so with triples made of two such pairs. Where no two words share a
code, these counts are exact, and tell which phrases lie behind the SHOWN strongest of their language
whatever the others are; those are ruled out too. The third pass counts, in the trie and as words, what
may be shown, its parts, what may hold a pair of it, and every phrase with a word whose code is shared. A
bit shared by chance costs a useless count, never a wrong one, so the result is exact, and no broadcast
grows with the corpus.

Everything is per language. For phrases a = f(phrase) >= LEAST of two and three words and each cut into
parts of l and r occurrences, floor(1000000 a a / (l r)) is taken in 38-digit decimals.

Cases: a null text is empty, a null language is `und`; a text without words gives nothing; a text of any
length is read in slices, phrases across slices included; repeated rows count as often as they occur;
empty tables give empty results; other columns do not matter; bytes that are no UTF-8 are replaced in the
phrases shown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolume.llm.blocks import BLOCK, blocks, mixed
from cargolume.llm.common import written

#: Fixed values of the contract.
LEAST, LONGEST, SHARE, SHOWN = 10, 3, 50, 2000
#: A container of more entries is burst; a trie of more spills down to half of it.
BURST, ENTRIES = 4096, 300_000
#: Different words a task remembers, and pairs it counts together, before it sends them.
WORDS, TOGETHER = 300_000, 1_500_000
#: Bits of a word's code, 32 at most, and of the maps of phrases.
CODE, BITS = 32, 26
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK, BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
BLANK[[9, 32]] = True
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
SOLID = ~(BLANK | BREAK)
UNKNOWN = "und"
#: In place of a third word.
NOTHING = (1 << 31) - 1


class Trie:
    """Counts of phrases of two and three word ids: nodes for first words, hash containers for the rest.

    `root[w]` is a container {rest: count}, rest being the packed ids behind w, or, burst, a node
    {next word: container}.
    """

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict[int, dict] = {}
        self.nodes: set[int] = set()
        self.sizes: dict[int, int] = {}
        self.entries = 0

    def add(self, firsts: np.ndarray, rests: np.ndarray, counts: np.ndarray) -> None:
        """Different phrases, those of one first word together, with their counts."""
        heads = np.flatnonzero(np.diff(firsts, prepend=-1))
        keys, counts = rests.tolist(), counts.tolist()
        for first, lo, hi in zip(firsts[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)]):
            own = self.root.setdefault(first, {})
            before = self.sizes.get(first, 0)
            if first in self.nodes:
                new = 0
                for key, n in zip(keys[lo:hi], counts[lo:hi]):
                    leaf = own.setdefault(key >> 31, {})
                    new += key not in leaf
                    leaf[key] = leaf.get(key, 0) + n
            else:
                for key, n in zip(keys[lo:hi], counts[lo:hi]):
                    own[key] = own.get(key, 0) + n
                new = len(own) - before
                if len(own) > self.burst:
                    self._burst(first)
            self.sizes[first] = before + new
            self.entries += new

    def _burst(self, first: int) -> None:
        node: dict[int, dict] = {}
        for key, n in self.root[first].items():
            node.setdefault(key >> 31, {})[key] = n
        self.root[first] = node
        self.nodes.add(first)

    def spill(self, room: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first word, rests, counts): sorted runs of whole subtrees, largest first, until at most `room` entries are left."""
        for first in sorted(self.sizes, key=lambda w: (-self.sizes[w], w)):
            if self.entries <= room:
                return
            own = self.root.pop(first)
            leaves = own.values() if first in self.nodes else [own]
            keys = np.fromiter((k for leaf in leaves for k in leaf), dtype=np.int64)
            counts = np.fromiter((n for leaf in leaves for n in leaf.values()), dtype=np.int64)
            self.nodes.discard(first)
            self.entries -= self.sizes.pop(first)
            by = np.argsort(keys)
            yield first, keys[by], counts[by]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, bool]]:
    """(first text, lowered bytes, cuts, goes on, more): a long text comes in slices that end between words."""
    first = 0
    for data, cuts in blocks(texts):
        data = LOWER[data]
        at, long = 0, len(cuts) == 2 and len(data) > BLOCK
        while long and at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data):
                ends = np.flatnonzero(~SOLID[data[end : end + BLOCK]])
                end = end + int(ends[0]) if len(ends) else min(end + BLOCK, len(data))
                if len(ends):
                    break
            yield first, data[at:end], np.array([0, end - at]), at > 0, end < len(data)
            at = end
        if not long:
            yield first, data, cuts, False, False
        first += len(cuts) - 1


def words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of a block, dictionary-encoded; the text of each; and the piece each lies in."""
    breaks = BREAK[data]
    solid = SOLID[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads = cuts[:-1][cuts[:-1] < cuts[1:]]
    begins[heads] = solid[heads]
    tails = cuts[1:][cuts[:-1] < cuts[1:]] - 1
    ends[tails] = solid[tails]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(cuts, starts, "right") - 1
    offsets = np.empty(2 * len(starts), dtype=np.int64)  # words and what lies between, in turn
    offsets[0::2], offsets[1::2] = starts, stops
    if not len(starts):
        return pa.array([], pa.large_binary()).dictionary_encode(), owner, owner
    runs = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    words = runs.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    piece = np.cumsum(breaks)[starts] + owner  # grows at every break and every text
    return words, owner, piece


class Vocabulary:
    """Ids of the words a task has met, and a 64-bit code of each."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.codes = np.zeros(0, dtype=np.uint64)

    def of(self, words: pa.DictionaryArray) -> np.ndarray:
        ids, told = self.ids, words.dictionary.to_pylist()
        new = [w for w in told if w not in ids]
        if new:
            ids.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words += new
            codes = np.fromiter(map(xxhash.xxh64_intdigest, new), dtype=np.uint64, count=len(new))
            self.codes = np.concatenate([self.codes, codes])
        return np.fromiter(map(ids.__getitem__, told), dtype=np.int64, count=len(told))[words.indices.to_numpy()]

    def word_codes(self, ids: np.ndarray, langs: np.ndarray, size: int = CODE) -> np.ndarray:
        """A code of so many bits of each word in its language."""
        return mixed(self.codes[ids] + langs) >> np.uint64(64 - size)


def place(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Place in a bit map of the phrases of so many words that begin at `at`; `place_of` in Spark."""
    out = codes[at].copy()
    for k in range(1, length):
        out ^= codes[at + k] >> np.uint64(3 * k)
    return out


def place_of(code: str, third: str | None = None) -> Column:
    out = first_word(code).bitwiseXOR(F.shiftrightunsigned(second_word(code), 3))
    return out.bitwiseXOR(F.shiftrightunsigned(third, 6)) if third else out


def first_word(code: str) -> Column:
    return F.shiftrightunsigned(code, 32)


def second_word(code: str) -> Column:
    return F.col(code).bitwiseAND(F.lit((1 << 32) - 1))


def pair_codes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (codes[at] << np.uint64(32)) | codes[at + 1]


def in_map(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def phrases_in(codes: np.ndarray, piece: np.ndarray, pairs: np.ndarray | None, triples: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs and where triples begin that lie in one piece and that the bit maps let through."""
    whole = piece[1:] == piece[:-1]
    if pairs is not None:
        at = np.flatnonzero(whole)
        whole[at] = in_map(pairs, place(codes, at, 2))
    three = np.flatnonzero(whole[:-1] & whole[1:])
    if triples is not None:
        three = three[in_map(triples, place(codes, three, 3))]
    return np.flatnonzero(whole), three


def lang_codes(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(n) for n in names), dtype=np.uint64, count=len(names))


def tokens(batch: pa.RecordBatch, vocabulary: Vocabulary, context: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, piece, text, fresh) of every slice of a batch of (lang, text); the first `fresh` ids are the
    last words, at most `context`, of the slice before, if the same piece goes on."""
    carry = np.zeros(0, dtype=np.int64)
    for first, data, cuts, goes_on, more in slices(batch.column(1)):
        words, owner, piece = words_of(data, cuts)
        ids, fresh = vocabulary.of(words), 0
        if goes_on and len(carry):
            lead = data[: int(np.argmax(SOLID[data]))] if len(ids) else data
            before = carry[:0] if BREAK[lead].any() else carry
            fresh = len(before)
            owner = np.concatenate([np.zeros(fresh, dtype=np.int64), owner])
            piece = np.concatenate([np.full(fresh, piece[0] if len(piece) else 0), piece])
            ids = np.concatenate([before, ids])
        carry = ids[:0]
        if more and len(ids) and not BREAK[data[np.max(np.flatnonzero(SOLID[data]), initial=0) :]].any():
            carry = ids[max(len(ids) - context, int(np.searchsorted(piece, piece[-1]))) :]
        yield ids, piece, first + owner, fresh


def summed(*codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different codes, in order, and how often each occurs."""
    if not len(codes[0]):
        return *codes, np.zeros(0, dtype=np.int64)
    if len(codes) > 1:
        by = np.lexsort(codes[::-1])
        codes = tuple(c[by] for c in codes)
    else:
        codes = (np.sort(codes[0]),)
    heads = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
    return *(c[heads] for c in codes), np.diff(np.concatenate([heads, [len(codes[0])]]))


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def code_runs(documents: DataFrame, pairs: np.ndarray | None = None, size: int = CODE) -> DataFrame:
    """Parts of sums. Without `pairs`, (lang, w1, code, n): counts of words with their codes, and of pairs by
    the codes of both words alone (lang, w1 null); with the bit map of pairs that may count, (code, third, n):
    counts of triples by the codes of the first two words and of the third."""
    shared = documents.sparkSession.sparkContext.broadcast(pairs)
    if pairs is None:
        schema, ddl = pa.schema([("lang", pa.string()), ("w1", pa.binary()), ("code", pa.int64()), ("n", pa.int64())]), "lang string, w1 binary, code bigint, n bigint"
    else:
        schema, ddl = pa.schema([("code", pa.int64()), ("third", pa.int64()), ("n", pa.int64())]), "code bigint, third bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        vocabulary, held, waiting, counted = Vocabulary(), [], 0, {}

        def send_words() -> Iterator[pa.RecordBatch]:
            texts = pa.array(vocabulary.words, pa.binary())
            for lang, sums in sorted(counted.items()):
                found = np.flatnonzero(sums)
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    codes = vocabulary.word_codes(part, lang_codes([lang]), size).view(np.int64)
                    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(part)), texts.take(pa.array(part)), pa.array(codes), pa.array(sums[part])]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        def send_codes() -> Iterator[pa.RecordBatch]:
            *codes, n = summed(*(np.concatenate(h) for h in zip(*held)))
            for at in range(0, len(n), 100_000):
                columns = [pa.array(c[at : at + 100_000].view(np.int64)) for c in codes] + [pa.array(n[at : at + 100_000])]
                if len(codes) == 1:
                    columns = [pa.nulls(len(columns[0]), pa.string()), pa.nulls(len(columns[0]), pa.binary()), *columns]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, of_text = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            marks = lang_codes(names)
            for ids, piece, text, fresh in tokens(batch, vocabulary, 1 if pairs is None else 2):
                of = of_text[text]
                codes = vocabulary.word_codes(ids, marks[of], size)
                two, three = phrases_in(codes, piece, pairs, None)
                if pairs is None:
                    for j in np.unique(of[fresh:]).tolist():
                        sums = np.bincount(ids[fresh:][of[fresh:] == j], minlength=len(vocabulary.words))
                        before = counted.get(names[j], sums[:0])
                        sums[: len(before)] += before
                        counted[names[j]] = sums
                    at = two[two + 1 >= fresh]
                    held.append((pair_codes(codes, at),))
                else:
                    at = three[three + 2 >= fresh]
                    held.append((pair_codes(codes, at), codes[at + 2]))
                waiting += len(at)
                if waiting >= TOGETHER:
                    yield from send_codes()
                    held, waiting = [], 0
            if len(vocabulary.words) > WORDS:
                yield from send_words()
                vocabulary, counted = Vocabulary(), {}
        yield from send_words()
        if held:
            yield from send_codes()

    return _named(documents).mapInArrow(run, ddl)


def phrase_runs(documents: DataFrame, pairs: np.ndarray, triples: np.ndarray, entries: int = ENTRIES, burst: int = BURST, size: int = CODE) -> DataFrame:
    """(lang, w1, w2, w3, n): sorted runs of phrase counts, one subtree after another; w3 is null in pairs.

    `pairs` and `triples` are bit maps of the phrases to count.
    """
    shared = documents.sparkSession.sparkContext.broadcast((pairs, triples))
    schema = pa.schema([("lang", pa.string()), ("w1", pa.binary()), ("w2", pa.binary()), ("w3", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples = shared.value
        vocabulary, tries = Vocabulary(), {}

        def spilled(room: int) -> Iterator[pa.RecordBatch]:
            texts = pa.array(vocabulary.words, pa.binary())
            for lang in sorted(tries):
                held, waiting = [], 0
                for part in tries[lang].spill(room):
                    held.append(part)
                    waiting += len(part[1])
                    if waiting > 50_000:
                        yield batch_of(lang, held, texts)
                        held, waiting = [], 0
                if held:
                    yield batch_of(lang, held, texts)

        def batch_of(lang: str, held: list, texts: pa.Array) -> pa.RecordBatch:
            first = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            rest, n = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            third = rest & NOTHING
            columns = [texts.take(pa.array(first)), texts.take(pa.array(rest >> 31)), texts.take(pa.array(third, mask=third == NOTHING))]
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), *columns, pa.array(n)], schema=schema)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, of_text = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            marks = lang_codes(names)
            for ids, piece, text, fresh in tokens(batch, vocabulary, 2):
                of = of_text[text]
                two, three = phrases_in(vocabulary.word_codes(ids, marks[of], size), piece, pairs, triples)
                two, three = two[two + 1 >= fresh], three[three + 2 >= fresh]
                firsts = np.concatenate([ids[two], ids[three]])
                rests = np.concatenate([(ids[two + 1] << 31) | NOTHING, (ids[three + 1] << 31) | ids[three + 2]])
                of = np.concatenate([of[two], of[three]])
                for j in np.unique(of).tolist():
                    own = of == j
                    f, r = firsts[own], rests[own]
                    by = np.lexsort((r, f))
                    f, r = f[by], r[by]
                    heads = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (r[1:] != r[:-1])]))
                    tries.setdefault(names[j], Trie(burst)).add(f[heads], r[heads], np.diff(np.concatenate([heads, [len(f)]])))
                if sum(t.entries for t in tries.values()) > entries:
                    yield from spilled(entries // (2 * len(tries)))
            if len(vocabulary.words) > WORDS:
                yield from spilled(0)
                vocabulary, tries = Vocabulary(), {}
        yield from spilled(0)

    return _named(documents).mapInArrow(run, "lang string, w1 binary, w2 binary, w3 binary, n bigint")


def bit_map(codes: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits set where a code of the one-column table, cut to `bits`, points: at most 2 ** bits / 64 rows reach the driver."""
    at = F.col(codes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    packed = codes.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({codes.columns[0]} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[packed["at"].to_numpy()] = packed["bits"].to_numpy()
    return out.astype("<i8").view(np.uint8)


def phrases_needed(words: DataFrame, pairs: DataFrame, triples: DataFrame, least: int, share: int, shown: int) -> DataFrame:
    """(code, third) of the phrases that the `shown` strongest of a language follow from; third is null in pairs.

    `words` are all (lang, w1, code, n); `pairs` (code, n) and `triples` (code, third, n) those whose codes reach
    `least`. A phrase is sure to be shown or beaten if its words share their codes with no others and no triple
    may hold half of it. Needed is what is not behind the `shown`-th of the sure ones, triples that hold half of such
    a pair, and all phrases of words with shared codes, whose counts are only upper bounds here.
    """
    told = words.groupBy("code").agg(F.sum("n").alias("n"), F.when(F.count("*") == 1, F.min("lang")).alias("lang")).filter(F.col("n") >= least)
    side = lambda k, c: told.select(F.col("code").alias(f"c{k}"), F.col("n").alias(c), F.col("lang").alias(f"lang{k}"))
    both = lambda: F.when(F.col("lang1").isNotNull(), F.when(F.col("lang2").isNotNull(), F.col("lang1"))).alias("lang")
    two = pairs.select("code", first_word("code").alias("c1"), second_word("code").alias("c2"), F.col("n").alias("a"))
    two = two.join(side(1, "l"), "c1").join(side(2, "r"), "c2").select("code", "a", "l", "r", both())
    two, _ = written(two.withColumn("score", F.when(F.col("lang").isNotNull(), strength("a", "l", "r"))), "phrase-pairs")
    second = F.shiftleft(second_word("code"), 32).bitwiseOR(F.col("third")).alias("second")
    three = triples.select("code", "third", F.col("n").alias("a"), second)
    left = two.select("code", F.col("a").alias("la"), F.col("l").alias("ll"), F.col("score").alias("ls"), F.col("lang").alias("lang1"))
    right = two.select(F.col("code").alias("second"), F.col("a").alias("ra"), F.col("r").alias("rr"), F.col("score").alias("rs"), F.col("lang").alias("lang2"))
    three = three.join(left, "code").join(right, "second").withColumn("lang", both())
    three = three.withColumn("score", F.when(F.col("lang").isNotNull(), F.least(strength("a", "ll", "ra"), strength("a", "la", "rr"))))
    inside = triples.select("code", "n").unionAll(triples.select(second, "n")).groupBy("code").agg(F.max("n").alias("longer"))
    two = two.join(inside, "code", "left").withColumn("sure", F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    scored = three.withColumn("sure", F.lit(True)).unionByName(two.drop("l", "r", "longer"), allowMissingColumns=True)
    scored, _ = written(scored.drop("second", "ll", "rr", "lang1", "lang2"), "phrase-scores")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    last = scored.filter("sure and lang is not null").select("lang", "score", "a").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == shown)
    last = last.select("lang", F.col("score").alias("last_score"), F.col("a").alias("last_a"))  # one row per language

    def may_show(score: str, a: str) -> Column:
        return F.col("last_a").isNull() | (F.col(score) > F.col("last_score")) | ((F.col(score) == F.col("last_score")) & (F.col(a) >= F.col("last_a")))

    def holds(score: str, a: str) -> Column:
        return may_show(score, a) & (100 * F.col("a") >= share * F.col(a))

    needed = scored.join(F.broadcast(last), "lang", "left").filter(may_show("score", "a") | (F.col("third").isNotNull() & (holds("ls", "la") | holds("rs", "ra"))))
    return written(needed.select("code", "third"), "phrase-needs")[0]


def phrase_counts(documents: DataFrame, least: int = LEAST, share: int = SHARE, shown: int = SHOWN, size: int = CODE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(totals per language, words, pairs, triples): words with at least `least` occurrences, and of such pairs
    and triples those that the `shown` strongest of a language follow from."""
    counted = code_runs(documents, size=size).groupBy("lang", "w1", "code").agg(F.sum("n").alias("n"))
    counted, _ = written(counted.filter(F.col("w1").isNotNull() | (F.col("n") >= least)), "phrase-words")
    words, codes = counted.filter("w1 is not null"), counted.filter("w1 is null").select("code", "n")
    triples = code_runs(documents, bit_map(codes.select(place_of("code").alias("place"))), size).groupBy("code", "third").agg(F.sum("n").alias("n"))
    triples, _ = written(triples.filter(F.col("n") >= least), "phrase-triples")
    needed = phrases_needed(words, codes, triples, least, share, shown)
    three = needed.filter("third is not null")
    parts = needed.select("code").unionAll(three.select(F.shiftleft(second_word("code"), 32).bitwiseOR(F.col("third"))))
    maps = bit_map(parts.select(place_of("code").alias("place"))), bit_map(three.select(place_of("code", "third").alias("place")))
    words = words.drop("code")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    phrases = phrase_runs(documents, *maps, size=size).groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    phrases, _ = written(phrases, "phrases")
    return totals, words.filter(F.col("n") >= least), phrases.filter("w3 is null").drop("w3"), phrases.filter("w3 is not null")


def strength(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits; counts below 10 ** 16."""
    wide = {c: F.col(c).cast("decimal(16,0)") for c in (a, left, right)}
    return F.call_function("div", wide[a] * wide[a] * F.lit(1_000_000).cast("decimal(7,0)"), wide[left] * wide[right])


def collocations(documents: DataFrame, least: int = LEAST, share: int = SHARE, shown: int = SHOWN, size: int = CODE) -> DataFrame:
    """The `shown` strongest phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    totals, words, pairs, triples = phrase_counts(documents, least, share, shown, size)
    part = lambda frame, names, n: frame.select("lang", *[F.col(c).alias(d) for c, d in zip(frame.columns[1:-1], names)], F.col("n").alias(n))
    two = pairs.withColumnRenamed("n", "a")
    two = two.join(part(words, ["w1"], "l"), ["lang", "w1"]).join(part(words, ["w2"], "r"), ["lang", "w2"])
    two = two.withColumn("score", strength("a", "l", "r"))
    three = triples.withColumnRenamed("n", "a")
    three = three.join(part(words, ["w1"], "l1"), ["lang", "w1"]).join(part(pairs, ["w2", "w3"], "r1"), ["lang", "w2", "w3"])
    three = three.join(part(pairs, ["w1", "w2"], "l2"), ["lang", "w1", "w2"]).join(part(words, ["w3"], "r2"), ["lang", "w3"])
    three = three.withColumns({"s1": strength("a", "l1", "r1"), "s2": strength("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "w1", "w2", "w3", "a", *[F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(d) for c, d in (("l", "l"), ("r", "r"), ("s", "score"))])
    longer = part(triples, ["w1", "w2", "w3"], "longer")
    inside = longer.select("lang", "w1", "w2", "longer").unionByName(longer.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "longer"))
    inside = inside.groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    two = two.join(inside, ["lang", "w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    blank = F.lit(b" ")
    both = two.select("lang", F.concat("w1", blank, "w2").alias("phrase"), "a", "l", "r", "score")
    both = both.unionByName(three.select("lang", F.concat("w1", blank, "w2", blank, "w3").alias("phrase"), "a", "l", "r", "score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown)
    best = best.join(F.broadcast(totals), "lang")  # one row per language
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")
