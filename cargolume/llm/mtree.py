"""Exact top-k by inner product: best-first search of a paged M-tree.

Inner products become distances by one more coordinate: x' = (x, sqrt(R^2 - |x|^2)) with R the largest
norm, q' = (q, 0), so |q' - x'|^2 = |q|^2 + R^2 - 2 q x. The root holds pivots with covering radii; below
a pivot lie pages, each with its centre, covering radius and distance to the pivot; a page's entries
carry their distance to its centre. Those stored distances bound a distance from below by the triangle
inequality, so most are never computed.

Pivots are a bounded sample of the rows (at most PIVOTS, smallest hash first); every row is indexed. The
rows of a pivot are paged in groups of at most GROUP, however many there are. Pages are files in the
shared folder that searching tasks memory-map; only queries are dealt out, no pair of rows is.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors are
compared with those of their own length; rows that repeat an id are candidates each, only the query's
own id is left out; equal scores go to the smaller id; fewer rows than k give them all; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume.llm.common import written
from cargolume.session import scratch_dir

PIVOTS, GROUP, PAGE = 256, 4096, 96
#: Queries that go through the tree together, and queries of a task.
TOGETHER, QUERIES = 128, 256
#: Slack of bounds, in units of the largest norm, for rounding.
SLACK = 1e-9


def finite(vector: str) -> Column:
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(whole, F.lit(False))


def rows_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def lifted(rows: np.ndarray, square: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms equal."""
    return np.column_stack([rows, np.sqrt(np.maximum(square - (rows * rows).sum(axis=1), 0))])


def _halves(points: np.ndarray, members: np.ndarray, size: int) -> list[np.ndarray]:
    """Members in pages of at most `size`, each half nearer to one of two points far apart."""
    out, todo = [], [members]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        own = points[part]
        far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
        by = np.argsort(((own - far) ** 2).sum(axis=1) - ((own - other) ** 2).sum(axis=1), kind="stable")
        todo += [part[by[: len(part) // 2]], part[by[len(part) // 2 :]]]
    return out


def _pages(rows: np.ndarray, ids: np.ndarray, pivot: np.ndarray, square: float) -> dict[str, np.ndarray]:
    points = lifted(rows, square)
    parts = _halves(points, np.arange(len(ids)), PAGE)
    centres = np.array([points[p].mean(axis=0) for p in parts])
    order = np.concatenate(parts)
    page = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    to_centre = np.sqrt(((points[order] - centres[page]) ** 2).sum(axis=1))
    ends = np.cumsum([len(p) for p in parts])
    return {
        "rows": rows[order].ravel(), "ids": ids[order], "to_centre": to_centre,
        "centres": centres.ravel(), "radii": np.maximum.reduceat(to_centre, ends - [len(p) for p in parts]),
        "to_pivot": np.sqrt(((centres - pivot) ** 2).sum(axis=1)), "ends": ends,
    }


class Tree:
    """The root: pivots and radii of one vector length, and where their pages are."""

    def __init__(self, folder: str, square: float, pivots: np.ndarray, radii: np.ndarray, groups: list[int]):
        self.folder, self.square, self.pivots, self.radii, self.groups = folder, square, pivots, radii, groups

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """The k best (score, id) of each query, best first.

        Queries go through the tree together: a node is opened in the order of the least bound any of
        them has on it, and only for those whose bound is within their reach.
        """
        n, width = queries.shape
        lifted_queries = np.column_stack([queries, np.zeros(n)])
        norms = (queries * queries).sum(axis=1)
        slack = SLACK * (np.sqrt(norms) + np.sqrt(self.square) + 1)

        def distances(points: np.ndarray) -> np.ndarray:
            squares = norms[:, None] + (points * points).sum(axis=1) - 2 * lifted_queries @ points.T
            return np.sqrt(np.maximum(squares, 0))

        to = distances(self.pivots)
        turn = itertools.count()
        heap: list[tuple] = []
        for i, radius in enumerate(self.radii):
            if self.groups[i]:
                bound = np.maximum(to[:, i] - radius, 0)
                heap.append((float(bound.min()), next(turn), i, -1, -1, bound, to[:, i]))
        heapq.heapify(heap)
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        reach = np.full(n, np.inf)
        while heap and heap[0][0] <= (reach + slack).max():
            _, _, pivot, group, page, bound, distance = heapq.heappop(heap)
            live = np.flatnonzero(bound <= reach + slack)
            if not len(live):
                continue
            limit = (reach + slack)[live]
            if page < 0:
                for g in range(self.groups[pivot]):
                    node = pages_of(self.folder, width, pivot, g)
                    gap = np.abs(distance[live, None] - node["to_pivot"]) - node["radii"]
                    near = np.flatnonzero((gap <= limit[:, None]).any(axis=0))
                    if not len(near):
                        continue
                    own_to = distances(node["centres"][near])
                    low = np.maximum(own_to - node["radii"][near], bound[:, None])
                    for j, p in enumerate(near.tolist()):
                        heapq.heappush(heap, (float(low[:, j].min()), next(turn), pivot, g, p, low[:, j], own_to[:, j]))
                continue
            node = pages_of(self.folder, width, pivot, group)
            part = slice(int(node["ends"][page - 1]) if page else 0, int(node["ends"][page]))
            some = (np.abs(distance[live, None] - node["to_centre"][part]) <= limit[:, None]).any(axis=0)
            if not some.any():
                continue
            entries = node["ids"][part][some]
            found = queries[live] @ node["rows"][part][some].T
            found[entries == own[live, None]] = -np.inf
            better = (found >= scores[live, -1:]) & (found > -np.inf)
            rows = np.flatnonzero(better.any(axis=1))
            if not len(rows):
                continue
            at = live[rows]
            both = np.concatenate([scores[at], np.where(better[rows], found[rows], -np.inf)], axis=1)
            named = np.concatenate([ids[at], np.broadcast_to(entries, (len(rows), len(entries)))], axis=1)
            best = np.lexsort((named, -both), axis=1)[:, :k]
            scores[at], ids[at] = np.take_along_axis(both, best, 1), np.take_along_axis(named, best, 1)
            last = scores[at, -1]
            reach[at] = np.where(last > -np.inf, np.sqrt(np.maximum(norms[at] + self.square - 2 * last, 0)), np.inf)
        return [[(s, i) for s, i in zip(a, b) if s > -np.inf] for a, b in zip(scores.tolist(), ids.tolist())]


@lru_cache(maxsize=1024)
def pages_of(folder: str, width: int, pivot: int, group: int) -> dict[str, np.ndarray]:
    from cargolume.llm.levels import map_arrays

    node = map_arrays(folder, f"pages-{width}-{pivot}-{group}")
    return node | {"rows": node["rows"].reshape(-1, width), "centres": node["centres"].reshape(-1, width + 1)}


def build_trees(rows: DataFrame, pivots: int = PIVOTS, group: int = GROUP) -> dict[int, Tree]:
    """A tree for each vector length among rows with `id` and `vector` (arrays of finite numbers)."""
    spark = rows.sparkSession
    folder = scratch_dir(spark, "mtree")
    square = F.expr("aggregate(vector, 0D, (a, x) -> a + cast(x as double) * x)")
    sized = rows.select("id", "vector", F.size("vector").alias("width"))
    stats = sized.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).collect()  # one row per length
    trees: dict[int, Tree] = {}
    for s in sorted(stats):
        width, squared = int(s["width"]), float(s["square"])
        own = sized.filter(F.col("width") == width)
        few = max(1, min(pivots, s["n"] // 256))
        chosen = own.orderBy(F.xxhash64("id", "vector"), "id").limit(few).select("vector").collect()
        roots = lifted(np.array([r["vector"] for r in chosen], dtype=float), squared)
        nearest = _nearest(roots, squared)
        placed, _ = written(own.select("id", "vector", nearest("vector").alias("at")).select("id", "vector", "at.*"), "mtree-rows")
        seen = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}  # a row per pivot
        groups = [-(-seen[i]["n"] // group) if i in seen else 0 for i in range(few)]
        radii = np.array([seen[i]["radius"] if i in seen else 0.0 for i in range(few)])
        salt = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(max(1, g)) for g in groups]), F.col("pivot") + 1)).cast("int")
        grouped = placed.select("pivot", salt.alias("part"), "id", "vector").groupBy("pivot", "part")
        made = grouped.applyInArrow(_page_writer(folder, width, roots, squared), "pivot int, part int")
        have = {(r["pivot"], r["part"]) for r in made.collect()}  # a row per file
        for i, n in enumerate(groups):
            if any((i, g) not in have for g in range(n)):  # a salt without rows
                groups[i] = _renumbered(folder, width, i, sorted(g for p, g in have if p == i))
        trees[width] = Tree(folder, squared, roots, radii, groups)
    return trees


def _renumbered(folder: str, width: int, pivot: int, parts: list[int]) -> int:
    from cargolume.llm.levels import map_arrays, save_arrays

    for to, part in enumerate(parts):
        if to != part:
            save_arrays(folder, f"pages-{width}-{pivot}-{to}", dict(map_arrays(folder, f"pages-{width}-{pivot}-{part}")))
    return len(parts)


def _nearest(roots: np.ndarray, square: float):
    @F.arrow_udf("struct<pivot: int, distance: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            points = lifted(rows_matrix(vectors), square)
            squares = (roots * roots).sum(axis=1) - 2 * points @ roots.T
            at = squares.argmin(axis=1)
            distance = np.sqrt(((points - roots[at]) ** 2).sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(distance)], names=["pivot", "distance"])

    return run


def _page_writer(folder: str, width: int, roots: np.ndarray, square: float):
    def run(table: pa.Table) -> pa.Table:
        from cargolume.llm.levels import save_arrays

        pivot, part = table["pivot"][0].as_py(), table["part"][0].as_py()
        by = np.argsort(table["id"].to_numpy(), kind="stable")
        rows = rows_matrix(table["vector"].combine_chunks())[by]
        save_arrays(folder, f"pages-{width}-{pivot}-{part}", _pages(rows, table["id"].to_numpy()[by], roots[pivot], square))
        return pa.table({"pivot": pa.array([pivot], pa.int32()), "part": pa.array([part], pa.int32())})

    return run


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows and queries: `id` and `vector`. Returns query_id, rank from 1, id, score (double, exact for
    whole numbers below 2^53)."""
    trees = build_trees(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            sizes = batch.column(1).value_lengths().to_numpy()
            for width in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == width))
                if width not in trees:
                    continue
                tree, own, vectors = trees[width], part.column(0).to_numpy(), rows_matrix(part.column(1))
                near = ((tree.pivots[:, :-1] ** 2).sum(axis=1) - 2 * vectors @ tree.pivots[:, :-1].T).argmin(axis=1)
                order = np.lexsort((own, near))  # neighbours look at the same pages
                for at in range(0, len(order), TOGETHER):
                    block = order[at : at + TOGETHER]
                    for query, found in zip(own[block].tolist(), tree.search(vectors[block], own[block], k)):
                        for rank, (score, other) in enumerate(found, 1):
                            for column, value in zip(out, (query, rank, other, score)):
                                column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["query_id", "rank", "id", "score"])

    tasks = max(1, -(-queries.count() // QUERIES))  # a number, or adaptive execution makes them one task
    spread = queries.select("id", "vector").repartition(tasks, "id")
    return spread.mapInArrow(run, "query_id bigint, rank int, id bigint, score double")
