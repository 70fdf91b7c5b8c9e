"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Every source asks for its weight's share of the mixture. Sources that would be read more than
`max_epochs` times are clamped there and the excess goes to the others by weight until none is above;
the fixed point is target = min(max_epochs * size, level * weight) with one level for all, found by
sorting sources by the level at which they fill. A source is then read a whole number of times, plus a
seeded part: its documents in the order of a keyed hash, as long as their middle lies below the rest.

The cut of that order is found from sums per hash bucket and the rows of one bucket per source, so no
source, however large, is sorted or gathered.

Cases: a null text or one without words has size 0; null sources are one source, last in the order;
rows with equal id and text are taken together; empty tables and mixtures of size 0 give targets of 0;
ties do not matter for other rows, as the hash covers id and text; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolume.llm.common import WORD, written

#: Buckets of the keyed hash: the first characters of its hex digits.
PREFIX = 3
SEED = "mix-1"


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: str, text: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))


def source_key(source: str) -> Column:
    """Never null, and in code-point order with nulls last."""
    return F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source)))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """(key, source_size) -> the same with weight and target; one row per source."""
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint"))
    # by the level at which each is full; what is left for it and those after it
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    everything = Window.partitionBy()
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = F.sum("source_size").over(by) - F.col("source_size")
    ranked = ranked.withColumns({
        "left": percent * F.sum("source_size").over(everything) - 100 * max_epochs * before,
        "open": F.sum("weight").over(rest),
    })
    full = F.col("left") * F.col("weight") >= 100.0 * max_epochs * F.col("source_size") * F.col("open")
    ranked = ranked.withColumn("full", full)
    of_open = lambda c: F.sum(F.when(~F.col("full"), F.col(c)).otherwise(0)).over(everything)
    clamped = F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything)
    level = percent * F.sum("source_size").over(everything) - 100 * max_epochs * clamped
    target = F.when(F.col("full"), (max_epochs * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * level.cast("double") / (100 * of_open("weight")).cast("double")
    )
    return ranked.select("key", "source_size", "weight", target.alias("target"))


def plan_mixture(keyed: DataFrame, **options) -> DataFrame:
    """(key, size, order) of all documents -> per source: source_size, weight, target, whole, cut.

    A document is read `whole` times, and once more if its order is at most `cut`.
    """
    bucket = F.substring("order", 1, PREFIX)
    sums = keyed.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    sums, _ = written(sums, "mix-buckets")  # at most 16 ** PREFIX rows a source
    targets = source_targets(sums.groupBy("key").agg(F.sum("size").alias("source_size")), **options)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets, _ = written(targets, "mix-targets")
    run = F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))
    edges = sums.withColumn("end", run).join(targets.select("key", "rest"), "key")
    edges = edges.filter("end - size <= rest and rest < end").select("key", "bucket", "rest", (F.col("end") - F.col("size")).alias("begin"))
    inside = keyed.withColumn("bucket", bucket).join(edges, ["key", "bucket"])
    upto = F.col("begin") + F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("order")) - F.col("size") / 2
    inside = inside.withColumn("middle", upto)
    cuts = inside.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("order"))), F.max("bucket")).alias("cut"))
    # nothing left over: no document is read once more, not even one without words
    cut = F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(""))).otherwise("")
    plan = targets.join(cuts, "key", "left").withColumn("cut", cut)
    return written(plan.drop("rest"), "mix-plan")[0]


def copies_of(order: str = "order") -> Column:
    return F.col("whole") + (F.col(order) <= F.col("cut")).cast("bigint")


def mix_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **options) -> DataFrame:
    """Every row of the documents as often as the mixture reads it; the columns stay as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])  # the caller's names cannot clash with ours
    rows = documents.select(row.alias("given"), source_key(source).alias("key"), order_key(doc_id, text, seed).alias("order"), words_in(text).alias("size"))
    keyed, _ = written(rows.select("key", "size", "order"), "mix-keys")
    plan = plan_mixture(keyed, **options).select("key", "whole", "cut")
    times = copies_of()
    copies = rows.join(plan, "key").filter(times > 0).select("given", F.explode(F.sequence(F.lit(1), times)))
    return copies.select(*[F.col(f"given.`{c}`").alias(c) for c in documents.columns])
