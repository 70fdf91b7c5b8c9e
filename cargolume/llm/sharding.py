"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Law `rows`: shard sizes differ by at most one row. Rows fall into logical partitions by a keyed hash of
the whole row. How many rows each partition sends to each shard is drawn from the law a uniform
permutation would give: row by row of the matrix, hypergeometric given what the shards still hold. Then
partitions are permuted locally, their rows dealt to shards by the drawn counts, and each shard is
permuted again. DataFrame operations only; the driver sees one count per partition.

Cases: null texts have size 8 and checksum 0; repeated rows each take a slot of their own and are
interchangeable; equal texts may part, as no law of theirs holds; ids may be null or repeated; empty
tables give empty results; other columns are not needed.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolume.llm.common import written

#: Logical partitions of the exchange, and parts in which a shard is permuted the second time.
PARTITIONS, PARTS = 256, 64


def draw_hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` items, taken without replacement, are good. Any size of numbers.

    Inverse of the distribution function, summed outward from the mode; what lies beyond 12 standard
    deviations (below 1e-30 of the mass) is left out.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    share = good / total
    wide = 20 + int(12 * math.sqrt(drawn * share * (1 - share)))
    a, b = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(a, b, dtype=float)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def draw_matrix(counts: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that partition i sends to shard j; rows sum to counts, columns to the exact shard sizes."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for count in counts:
        row, left, others = [], count, sum(room)
        for j in range(shards):
            others -= room[j]
            got = draw_hypergeometric(rng, room[j], others, left)
            row.append(got)
            left -= got
        room = [r - g for r, g in zip(room, row)]
        out.append(row)
    return out


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def uniform_shards(rows: DataFrame, key: Column, shards: int, seed: int = 1, partitions: int = PARTITIONS, parts: int = PARTS) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    key: a long column expression that tells rows apart, such as a hash of all that matters in a row.
    """
    mixed = lambda n: F.xxhash64(key, F.lit(f"{seed}:{n}"))
    spark = rows.sparkSession
    named = [F.col(f"`{c}`") for c in rows.columns]
    cell = F.pmod(mixed(1), F.lit(partitions)).cast("int")
    placed, _ = written(rows.select(*named, cell.alias("__cell"), mixed(2).alias("__first"), mixed(3).alias("__second")), "shard-rows")
    seen = {r["__cell"]: r["count"] for r in placed.groupBy("__cell").count().collect()}  # at most `partitions` rows
    matrix = draw_matrix([seen.get(i, 0) for i in range(partitions)], shards, seed)
    ends = ",".join(f"({i},array({','.join(f'{int(e)}L' for e in np.cumsum(row))}))" for i, row in enumerate(matrix))
    ends = spark.sql(f"select * from values {ends} as t(__cell, __ends)")  # partitions x shards numbers
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy("__first", "__second"))
    dealt = placed.withColumn("__rank", rank).join(F.broadcast(ends), "__cell")
    shard = sum(((F.col("__rank") > F.col("__ends")[j]).cast("int") for j in range(shards - 1)), F.lit(0))
    part = F.pmod(F.hash("__second"), F.lit(parts))
    dealt, _ = written(dealt.select(*named, shard.alias("shard"), part.alias("__part"), "__second", "__first"), "shard-dealt")
    sums = dealt.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))  # shards x parts rows
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")
    starts = sums.select("shard", "__part", before.alias("__start"))
    at = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__second", "__first")) - 1
    slotted = dealt.withColumn("__at", at).join(F.broadcast(starts), ["shard", "__part"])
    return slotted.select(*named, "shard", (F.col("__start") + F.col("__at")).cast("bigint").alias("slot"))
