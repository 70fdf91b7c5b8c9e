"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set of its five-word shingles: each weighs one, so that similarity is the
Jaccard similarity of shingle sets, or with `counted` as much as it occurs. (Counts make two documents
alike that repeat one common line and share nothing else; hence they are not the default.) Hashing throws
darts onto the (element, weight, rank) space, about one per unit square, the same for all documents.
A document holds the darts below its weights; of those that fall to a coordinate, it keeps the one of
smallest rank. Only ranks up to about k ln k / weight can matter, so a signature costs the number of
shingles plus k ln k, not their product. Two documents agree in a coordinate with the probability of
their weighted Jaccard similarity.

Bands of coordinates are bucket keys. Exact copies are one node, whatever their ids: nodes are numbered in
the order of (smallest id, digest), so two texts never share one. A bucket's pivot is its smallest node;
every node is compared with the smallest of its pivots, those left in another class with the next. Then
all pairs of different classes are gone through in buckets that still hold several: in small ones pair by
pair; the members of large ones by a prefix join, which leaves out none that can be similar enough.
Candidates are verified on the exact weighted shingles, links are joined into classes. So two similar
documents are parted only if they share no band; at 0.8 that has probability 6e-5.

Cases: null texts are empty; texts without words are alone in their class; texts of fewer than five
words have one shingle; texts of any length are read whole; rows with equal id and text have one class, rows with
equal id and different texts are compared like any others; rows with a null id keep a null class; empty
tables give empty results; other columns are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolume.llm.blocks import MIX, blocks, mixed, shingles
from cargolume.llm.common import written
from cargolume.llm.graph import components

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
#: Buckets of up to so many nodes are paired at once. Rounding that bounds on sizes allow for.
SMALL, SLACK = 8, 1e-6
#: Darts in a unit square follow the Poisson law of mean one: its distribution function, as 64-bit numbers.
_LAW = np.exp(-1) * np.cumsum(1 / np.cumprod([1.0, *range(1, 16)]))
POISSON = (_LAW[:12] * 2.0**64).astype(np.uint64)
UNIT = 2.0**-53
#: Bytes of text looked at together: worker memory follows it.
TOGETHER = 1 << 18
#: Squares whose darts are thrown together.
SQUARES = 1 << 17


def _throw(owner: np.ndarray, codes: np.ndarray, weights: np.ndarray, limit: np.ndarray, best: np.ndarray) -> None:
    """Lower best[text, coordinate] to the ranks of the darts below `limit[text]`."""
    k = best.shape[1]
    high = np.ceil(limit).astype(np.int64)[owner]
    squares = np.ceil(weights).astype(np.int64) * high
    ends = np.cumsum(squares)
    at = 0
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SQUARES, "right")))
        part = slice(at, end)
        which = np.repeat(np.arange(at, end), squares[part])
        n = np.arange(len(which)) - np.repeat(ends[part] - squares[part] - (ends[at - 1] if at else 0), squares[part])
        layer, level = n // high[which], n % high[which]
        seed = mixed(codes[which] + mixed(layer.astype(np.uint64) * MIX[20] + level.astype(np.uint64) * MIX[21]))
        darts = np.searchsorted(POISSON, seed, "right")
        which, layer, level, seed = (np.repeat(x, darts) for x in (which, layer, level, seed))
        nth = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        one = mixed(seed + (nth + 1).astype(np.uint64) * MIX[22])
        rank = level + (one >> np.uint64(11)) * UNIT
        two = mixed(one ^ MIX[23])
        text = owner[which]
        inside = (rank < limit[text]) & (layer + (two >> np.uint64(32)) * 2.0**-32 < weights[which])
        to = text * k + ((two & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best.reshape(-1), to[inside], rank[inside])
        at = end


def dart_signatures(owner: np.ndarray, codes: np.ndarray, weights: np.ndarray, texts: int, k: int) -> np.ndarray:
    """best[text, coordinate]: rank of the earliest dart, which names it; infinite only without elements."""
    best = np.full((texts, k), np.inf)
    total = np.bincount(owner, weights, texts)
    limit = k * (np.log(k) + 2) / np.maximum(total, 1e-9)
    open_ = total > 0
    while open_.any():
        now = open_[owner]
        again = np.full((texts, k), np.inf)
        _throw(owner[now], codes[now], weights[now], limit, again)
        done = open_ & np.isfinite(again).all(axis=1)
        best[done] = again[done]
        open_ &= ~done
        limit = limit * 2
    return best


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = best.view(np.uint64).reshape(len(best), bands, rows)
    out = np.zeros((len(best), bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * MIX[24]
    for r in range(rows):
        out = mixed(out + bits[:, :, r] * MIX[25 + r])
    return out.view(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()), pa.array(values))


def signature_udf(width: int, bands: int, rows: int, counted: bool):
    """text -> band keys; empty for a text without words."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            keys, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for data, cuts in blocks(texts, TOGETHER):
                owner, codes, counts = shingles(data, cuts, width)
                n = len(cuts) - 1
                weights = counts.astype(float) if counted else np.ones(len(codes))
                best = dart_signatures(owner, codes, weights, n, bands * rows)
                some = np.isfinite(best[:, 0])
                keys.append(band_keys(best[some], bands, rows).reshape(-1))
                sizes.append(some * bands)
            yield lists(np.concatenate(keys), np.concatenate(sizes))

    return run


def shingle_udf(width: int, counted: bool):
    """text -> its shingle codes, sorted; if counted, one that occurs n times as n codes of its own."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for data, cuts in blocks(texts, TOGETHER):
                owner, codes, counts = shingles(data, cuts, width)
                counts = counts if counted else np.ones_like(counts)
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                codes = mixed(np.repeat(codes, counts) + nth.astype(np.uint64) * MIX[40])
                owner = np.repeat(owner, counts)
                values.append(codes[np.lexsort((codes, owner))].view(np.int64))
                sizes.append(np.bincount(owner, minlength=len(cuts) - 1))
            yield lists(np.concatenate(values), np.concatenate(sizes))

    return run


def similarity(one: str, two: str) -> Column:
    """Weighted Jaccard of two documents' shingles as `shingle_udf` gives them: distinct codes, so nothing but
    the number in common is needed, and no batch of pairs with both lists leaves the row."""
    both = F.size(F.array_intersect(one, two))
    return both / F.greatest(F.size(one) + F.size(two) - both, F.lit(1))


def _verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, with their similarity."""
    with_b = pairs.join(held.select(F.col("node").alias("b"), F.col("codes").alias("codes_b")), "b")
    near = F.array_size("codes_b")
    sides = with_b.join(held.select(F.col("node").alias("a"), F.col("codes").alias("codes_a")), "a")
    far = F.array_size("codes_a")
    sides = sides.filter(F.least(near, far) >= least * F.greatest(near, far))  # else out of reach by size
    return sides.select("a", "b", similarity("codes_a", "codes_b").alias("similarity")).filter(F.col("similarity") >= least)


def _parted(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose classes differ."""
    if labels is None:
        return pairs
    for c in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")), c, "left")
    return pairs.filter(~F.coalesce("of_a", "a").eqNullSafe(F.coalesce("of_b", "b"))).select("a", "b")


def _linked(pairs: DataFrame, held: DataFrame, least: float, links: DataFrame | None, tested: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links, all pairs tested and all labels, after these pairs."""
    pairs, _ = written(pairs, "dedup-pairs")
    found, _ = written(_verified(pairs, held, least), "dedup-links")
    links = found if links is None else links.unionByName(found)
    return links, pairs if tested is None else tested.unionByName(pairs), components(links)


def _within(members: DataFrame) -> DataFrame:
    """(a, b): all pairs of other classes of buckets of up to SMALL nodes."""
    one, two = (members.select("key", F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    return one.join(two, "key").filter("a < b and of_a <> of_b").select("a", "b")


def _reaching(members: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(a, b): every pair of other classes among these nodes that can be similar enough, and some more.

    Shingles are ordered by the number of members that have them. What two sets share lies at and after
    the first shingle they share, so that must leave enough on both sides: only the rarest `1 - least` of
    a set are joined. Of each shingle, members outside its commonest class are held against all members.
    """
    sets = members.join(held, "node").withColumn("size", F.array_size("codes"))
    each, _ = written(sets.select("node", "label", "size", F.explode("codes").alias("code")), "dedup-each")
    by_class = each.groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"))
    common = by_class.groupBy("code").agg(F.sum("n").alias("on"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("classes"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("on", "code"))
    ranked = each.join(common, "code").withColumn("left", F.col("size") - rank + 1)  # it and the later ones
    early, _ = written(ranked.filter(F.col("left") >= least * F.col("size") - SLACK).filter("classes > 1").select("code", "node", "label", "size", "left", "main"), "dedup-early")
    other = early.filter("label <> main").select("code", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "size", "left")))
    needed = least / (1 + least) * (F.col("size") + F.col("size_b")) - SLACK
    reach = (F.least("left", "left_b") >= needed) & (F.least("size", "size_b") >= least * F.greatest("size", "size_b") - SLACK)
    pairs = early.join(other, "code").filter("label <> label_b and (label = main or node < node_b)").filter(reach)
    return pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def duplicate_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """(id, digest, class_id, kept) per row: the digest of its text, the smallest id its class holds, and
    whether this text under this id is the one of its class that comes first by (id, digest)."""
    rows_of = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    signed, _ = written(rows_of.select("id", digest_of("text").alias("digest"), signature_udf(width, bands, rows, counted)("text").alias("keys")), "dedup-signatures")
    with_words = signed.filter("size(keys) > 0 and id is not null")
    groups = with_words.groupBy("digest").agg(F.min("id").alias("first"))
    groups = groups.repartitionByRange("first", "digest").sortWithinPartitions("first", "digest")
    groups, _ = written(groups.withColumn("node", F.monotonically_increasing_id()), "dedup-groups")
    nodes = with_words.withColumnRenamed("id", "first").join(groups, ["digest", "first"]).dropDuplicates(["node"])
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("far")).filter("pivot < far")
    buckets, _ = written(keyed.join(ends, "key"), "dedup-buckets")
    met = groups.join(buckets.select("node").distinct(), "node").select("digest", "first", "node")
    texts = rows_of.withColumn("digest", digest_of("text")).withColumnRenamed("id", "first").join(met, ["digest", "first"])
    held, _ = written(texts.dropDuplicates(["node"]).select("node", shingle_udf(width, counted)("text").alias("codes")), "dedup-shingles")
    # one pivot per node at first, twice: most of a group of copies is one class then
    links, tested, labels = None, None, None
    for _ in range(2):
        pairs = _parted(buckets.filter("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), labels)
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        links, tested, labels = _linked(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), held, least, links, tested)
    # then every pair of other classes in buckets that still hold several: small ones first, as they join classes
    for most in (SMALL, None):
        members = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
        members, _ = written(members.join(several.select("key", "n"), "key"), "dedup-members")
        if most:
            ends = members.select(F.explode(F.array("pivot", "far")).alias("end"), "node").filter("end <> node")
            ends = ends.select(F.least("end", "node").alias("a"), F.greatest("end", "node").alias("b"))
            more = _within(members.filter(F.col("n") <= most)).unionByName(_parted(ends.distinct(), labels))
        else:
            more = _reaching(members.filter(F.col("n") > SMALL).select("node", "label").distinct(), held, least)
        links, tested, labels = _linked(more.distinct().join(tested, ["a", "b"], "left_anti"), held, least, links, tested)
    heads = groups.select(F.col("node").alias("label"), F.col("first").alias("class"))
    to = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(heads, "label")
    out = signed.join(to.select("digest", "first", "class", (F.col("node") == F.col("label")).alias("head")), "digest", "left")
    words = (F.size("keys") > 0) & F.col("id").isNotNull()
    kept = F.when(words, F.col("head") & (F.col("id") == F.col("first"))).otherwise(True)
    return out.select("id", "digest", F.when(words, F.col("class")).otherwise(F.col("id")).alias("class_id"), kept.alias("kept"))


def digest_of(text: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, class_id) per row; the class is the smallest id joined by links, or the row's own."""
    classes = duplicate_classes(documents, doc_id, text, **options)
    return classes.select(F.col("id").alias(doc_id), "class_id")


def without_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `documents`, one of each class of near copies: the one that comes first by (id, digest).

    Rows equal in id and text are one; rows with a null id all stay.
    """
    classes, _ = written(duplicate_classes(documents, doc_id, text, **options), "dedup-classes")
    others = classes.filter("id is not null").groupBy("id", "digest").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    others = others.filter("not kept or n > 1")
    names = [f"__{k}" for k in ("id", "digest", "kept", "n", "salt")]
    while any(name in documents.columns for name in names):
        names = [f"_{name}" for name in names]
    own, digest, kept, n, salt = names
    marked = documents.withColumns({own: F.col(f"`{doc_id}`"), digest: digest_of(text)})
    marked = marked.join(others.toDF(own, digest, kept, n), [own, digest], "left").filter(F.coalesce(kept, F.lit(True)))
    # only rows that repeat need to meet; all others get a number of their own
    marked = marked.withColumn(salt, F.when(F.col(n).isNull(), F.monotonically_increasing_id()))
    return marked.dropDuplicates([own, digest, salt]).select(*[F.col(f"`{c}`") for c in documents.columns])
