"""Near-duplicate vectors by NN-descent.

Equal vectors are one node with a multiplicity. A first neighbour graph links nodes that lie close
together in the order of random hyperplane codes. NN-descent then refines it: around every node, its
neighbours and the nodes that have it as neighbour are compared with one another, and each keeps its
nearest, until a round brings hardly any edge above the threshold. Threshold edges join nodes into
components.

A node all of whose listed neighbours are above the threshold is saturated: its list may hide more. Links
that lead out of its component are searched with lists of nodes of other components only, which its own
cannot fill; components joined by them are searched from again, with lists twice as long where one was
full of links, until no list holds a link. Inside a component all nodes are compared, block against
block, so a link is counted exactly if its ends share a component; the pairs of blocks are dealt by
(component, block), and only counts leave a pair.

The number of codes follows the bits of a code, so that a pair at the threshold shares a bucket of some
code with probability RECALL at any size. An audit compares nodes drawn by hash with all nodes: AUDITED
of them, four times as many until LINKS links were met, MOST_AUDITED at most. While less than RECALL of
the links met lie inside components, those missed are joined and the graph is refined again with twice
the codes; below LOWEST after WIDENED times, the search raises.

A cosine within TIE of the threshold is computed again as a plain sum of products, so that every step
decides it alike.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; repeated rows are vectors of their own, linked with each
other; rows with a null id keep a null component; empty tables give empty results; other columns are
not needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolume.llm.common import written
from cargolume.llm.graph import components
from cargolume.llm.mtree import finite, rows_matrix

LEAST, NEIGHBOURS, CODES, RECALL, LOWEST, WIDENED = 0.95, 12, 16, 0.995, 0.9, 4
#: Nodes of the first and of the largest audit, links an audit should meet; the longest neighbour list.
AUDITED, MOST_AUDITED, LINKS, LONGEST = 256, 4096, 200, 192
TIE = 1e-9
#: Nodes compared along the order of a code; nodes of a block; share of new edges that ends the descent.
NEAR, BLOCK, STILL = 6, 512, 0.002
EDGES = "a bigint, b bigint, similarity double"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Cosines of unit rows, those at the threshold independent of the shapes multiplied."""
    s = a @ b.T
    i, j = np.nonzero(np.abs(s - least) < TIE)
    s[i, j] = (a[i] * b[j]).sum(axis=1)
    return s


def codes_for(bits: int, least: float, codes: int) -> int:
    """Codes with which a pair at the threshold shares a bucket with probability RECALL, `codes` at least."""
    agree = (1 - math.acos(least) / math.pi) ** bits
    return max(codes, math.ceil(math.log(1 - RECALL) / math.log1p(-agree))) if agree < 1 else codes


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])


def coded(nodes: DataFrame, codes: int, bits: int, first: int = 0) -> DataFrame:
    """(code, bucket, along, node, vector, label): each node once per code, with its sign bits and a place in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(rows_matrix(batch.column(1)))  # node, vector, label
            for c in range(first, first + codes):
                planes = np.random.default_rng([c, rows.shape[1]]).normal(size=(rows.shape[1], bits + 1))
                sides = rows @ planes
                bucket = (sides[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, dtype=np.int32)), pa.array(bucket), pa.array(sides[:, bits]), *batch.columns], ["code", "bucket", "along", "node", "vector", "label"])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.select("node", "vector", "label").mapInArrow(run, f"code int, bucket bigint, along double, node bigint, vector {kind}, label bigint")


def first_edges(nodes: DataFrame, codes: int, bits: int, first: int = 0) -> DataFrame:
    """Each node with the nodes of other labels just before it in its buckets. Ranges split buckets of any size.

    Those before the run of its own label: a group does not hide what lies next to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            ids, rows, labels = batch.column(2).to_numpy(), unit(rows_matrix(batch.column(3))), batch.column(4).to_numpy()
            if before is not None and before[2].shape[1] == rows.shape[1]:
                place, ids, rows, labels = (np.concatenate(x) for x in zip(before, (place, ids, rows, labels)))
            new = np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1) | (labels[1:] != labels[:-1])])
            heads = np.flatnonzero(new)[np.cumsum(new) - 1]
            for step in range(1, NEAR + 1):
                one = np.flatnonzero(heads >= step)
                two = heads[one] - step
                fit = (place[one] == place[two]).all(axis=1) & (labels[one] != labels[two])
                one, two = one[fit], two[fit]
                yield _edges(ids[one], ids[two], (rows[one] * rows[two]).sum(axis=1))
            last = heads[-1]
            held = np.r_[max(0, last - NEAR) : last, max(last, len(ids) - NEAR) : len(ids)]
            before = place[held], ids[held], rows[held], labels[held]

    ordered = coded(nodes, codes, bits, first).repartitionByRange("code", "bucket", "along").sortWithinPartitions("code", "bucket", "along")
    return ordered.select("code", "bucket", "node", "vector", "label").mapInArrow(run, EDGES)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """Both directions of the edges, the k nearest of each node."""
    both = edges.filter("a <> b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    once = both.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def around(graph: DataFrame, nodes: DataFrame, least: float, k: int) -> DataFrame:
    """Edges between labels among the neighbours, and the nodes whose neighbour it is, of every node.

    Of the latter a node looks at no more than k, by hash: they look at it in turn.
    """
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))
    back = back.withColumn("rank", rank).filter(F.col("rank") <= k).select("a", "b")
    members = graph.select("a", "b").unionByName(back).distinct()
    held = members.join(nodes.select(F.col("node").alias("b"), "vector", "label"), "b")
    held = held.repartition("a").sortWithinPartitions("a").select("a", "b", "vector", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            centre, ids, labels = (table[c].to_numpy() for c in ("a", "b", "label"))
            rows = unit(rows_matrix(table["vector"].combine_chunks()))
            heads = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]])).tolist()
            out: tuple[list, ...] = ([], [], [])
            for i, j in zip(heads, [*heads[1:], len(ids)]):
                if j - i < 2:
                    continue
                s = cosines(rows[i:j], rows[i:j], least)
                s[labels[i:j, None] == labels[i:j]] = -2
                best = np.argpartition(-s, min(k, j - i - 1) - 1, axis=1)[:, : min(k, j - i - 1)]
                for column, values in zip(out, (np.repeat(ids[i:j], best.shape[1]), ids[i:j][best.ravel()], np.take_along_axis(s, best, 1).ravel())):
                    column.append(values)
            a, b, s = (np.concatenate(c) if c else np.zeros(0) for c in out)
            a, b, s = (x[s > -2] for x in (a, b, s))
            low, high = np.minimum(a, b), np.maximum(a, b)
            _, kept = np.unique(np.column_stack([low, high]), axis=0, return_index=True) if len(a) else (0, np.zeros(0, dtype=int))
            return _edges(low[kept].astype(np.int64), high[kept].astype(np.int64), s[kept])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            centre = table["a"].to_numpy()
            cut = int(np.searchsorted(centre, centre[-1])) if len(centre) else 0  # the last node may go on
            if cut:
                yield compared(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield compared(rest)

    return held.mapInArrow(run, EDGES)


def descend(nodes: DataFrame, start: DataFrame, least: float, k: int, rounds: int = 8) -> DataFrame:
    """The refined graph, a table in the shared folder."""
    graph, _ = written(nearest(start, k), "nn-graph")
    had = graph.filter(F.col("similarity") >= least).count()
    for _ in range(rounds):
        graph, _ = written(nearest(graph.unionByName(around(graph, nodes, least, k)), k), "nn-graph")
        has = graph.filter(F.col("similarity") >= least).count()
        if has - had <= STILL * has:
            break
        had = has
    return graph


def block_counts(members: DataFrame, least: float) -> DataFrame:
    """members: label, node, copies, vector. (node, links): other vectors of the component above the threshold.

    Of a component's blocks in a circle, each meets the following half, so every block has as many partners.
    """
    sizes = members.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.repartition("label", "block")  # the join's own partitioning would keep a component in one task
    parts = placed.groupBy("label", "block", "blocks").agg(F.collect_list(F.struct("node", "copies", "vector")).alias("rows"))  # about BLOCK rows
    parts, _ = written(parts, "nn-blocks")
    turns = parts.filter("blocks > 1").select("label", "block", "blocks", F.explode(F.expr("sequence(1, cast(blocks div 2 as int))")).alias("step"))
    turns = turns.filter("2 * step < blocks or block < step")  # opposite blocks meet once
    turns = turns.select("label", "block", F.pmod(F.col("block") + F.col("step"), F.col("blocks")).alias("block_too"))
    other = parts.select("label", F.col("block").alias("block_too"), F.col("rows").alias("rows_too"))
    pairs = turns.join(parts.select("label", "block", "rows"), ["label", "block"]).join(other, ["label", "block_too"]).select("rows", "rows_too")
    pairs = pairs.unionByName(parts.select("rows", F.lit(None).cast(parts.schema["rows"].dataType).alias("rows_too")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat = rows.values
            return flat.field("node").to_numpy(), flat.field("copies").to_numpy(), unit(rows_matrix(flat.field("vector")))

        for batch in batches:
            for own, too in zip(*batch.columns):
                ids, copies, points = read(own)
                both = read(too) if too.is_valid else (ids, copies, points)
                near = cosines(points, both[2], least) >= least
                out = [(ids, near @ both[1])]
                if too.is_valid:
                    out.append((both[0], near.T @ copies))
                for node, links in out:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links.astype(np.int64))], ["node", "links"])

    counted = pairs.mapInArrow(run, "node bigint, links bigint")
    return counted.groupBy("node").agg((F.sum("links") - 1).alias("links"))  # a node is near itself


def audited_links(labelled: DataFrame, least: float, audited: int, turn: int) -> DataFrame:
    """(a, b, met) of the links of a sample of nodes, by comparing it with every node.

    labelled: node, vector, label. A row for every link between labels, and rows of null ends whose met
    add up to all links, so that links inside components leave the task as a number.
    """
    sample = labelled.orderBy(F.xxhash64("node", F.lit(f"audit {turn}")), "node").limit(audited).collect()
    ids, labels = (np.array([r[c] for r in sample], dtype=np.int64) for c in ("node", "label"))
    points = unit(np.array([r["vector"] for r in sample], dtype=float)) if sample else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            own, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            near = cosines(unit(rows_matrix(batch.column(1))), points, least) >= least
            near &= own[:, None] != ids
            at, to = np.nonzero(near & (of[:, None] != labels))
            ends = [pa.array([None, *x.tolist()], pa.int64()) for x in (ids[to], own[at])]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(np.r_[near.sum(), np.zeros(len(at))].astype(np.int64))], ["a", "b", "met"])

    return labelled.select("node", "vector", "label").mapInArrow(run, "a bigint, b bigint, met bigint")


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "node", "left").select("node", "vector", F.coalesce("label", "node").alias("label"))


def audit(nodes: DataFrame, found: DataFrame, least: float, n: int, turn: int) -> tuple[DataFrame, float]:
    """Labels with the links the audit found missing, and the share of links that were not; every turn has a sample of its own."""
    own, _ = written(labelled(nodes, found), "nn-own")
    audited = AUDITED
    while True:
        links, _ = written(audited_links(own, least, audited, turn), "nn-audit")
        missed, met = links.agg(F.count("a"), F.coalesce(F.sum("met"), F.lit(0))).first()
        if met >= LINKS or audited >= min(n, MOST_AUDITED):
            return (joined(found, links.filter("a is not null")) if missed else found), 1 - missed / max(1, met)
        audited *= 4


def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links; what was joined stays joined."""
    links = links.select("a", "b")
    if found is not None:
        links = links.unionByName(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    return written(components(links), "nn-labels")[0]


def outward(nodes: DataFrame, found: DataFrame, least: float, k: int, codes: int, bits: int) -> DataFrame:
    """Labels after neighbour lists of other components only were searched, until they hold no link.

    Where a list is full of links, the lists of the next turn are twice as long, LONGEST at most.
    """
    while True:
        own, _ = written(labelled(nodes, found), "nn-own")
        graph = descend(own, first_edges(own, codes, bits), least, k)
        links = graph.filter(F.col("similarity") >= least)
        longest = links.groupBy("a").count().agg(F.max("count")).first()[0]
        if longest is None:
            return found
        if longest >= k:
            k = min(2 * k, LONGEST)
        found = joined(found, links)


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST, k: int = NEIGHBOURS, codes: int = CODES) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    own = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    fit = finite("vector") & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull()
    keyed, _ = written(own.select("id", F.when(fit, F.col("vector")).alias("vector")), "nn-rows")
    alike, _ = written(keyed.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "nn-nodes")
    labels, links = None, None
    for width, n in sorted(tuple(r) for r in alike.groupBy(F.size("vector")).count().collect()):  # a row per length
        nodes = alike.filter(F.size("vector") == width)
        bits = max(1, (n // 8).bit_length())
        used = few = codes_for(bits, least, codes)
        own = nodes.withColumn("label", F.col("node"))
        start, found = first_edges(own, few, bits), None
        for widened in range(WIDENED + 1):
            graph = descend(own, start, least, k)
            found = joined(found, graph.filter(F.col("similarity") >= least))
            found = outward(nodes, found, least, k, few, bits)
            found, recall = audit(nodes, found, least, n, widened)
            if recall >= RECALL:
                break
            if widened == WIDENED and recall < LOWEST:
                raise RuntimeError(f"{recall:.3f} of the audited links were found with {used} codes")
            start = graph.unionByName(first_edges(own, used, bits, used))
            used *= 2
        counts = block_counts(found.join(nodes, "node"), least)
        labels = found if labels is None else labels.unionByName(found)
        links = counts if links is None else links.unionByName(counts)
    if labels is None:
        return keyed.select(F.col("id").alias(vec_id), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    known = alike.join(labels, "node", "left").join(links, "node", "left")
    known = known.select(F.col("vector").alias("same"), F.coalesce("label", "node").alias("component"), F.coalesce(F.col("links"), F.col("copies") - 1).alias("n"))
    out = keyed.join(known, F.col("vector") == F.col("same"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
