"""Near-duplicate vectors by dual traversal of a cover tree.

The tree has nested levels of centres with halving radii. Its upper levels are fitted on a bounded sample and every vector is
routed through them to a leaf cell; a cell's covering radius is the largest distance of a vector of its own from its centre,
so bounds hold for all vectors, whatever the sample. Traversal starts with the root paired with itself and replaces each pair
of nodes by the pairs of their children, level by level, as joins; a pair is dropped when the distance of the centres is
more than the threshold plus both covering radii. Cells are cut into chunks of a bounded number of vectors, and for the pairs
of chunks that are left a task builds the lower levels of the tree and settles them in the same way: node pairs are pruned by
the covering radii, whole pairs are taken where the radii allow nothing else, and the rest is computed in double precision.

Equal vectors are one row from the start, with a weight. A chunk pair reports how many vectors each of its vectors links with and
a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilume.llm.components import components
from vigilume.session import stored

#: Single precision decides a distance that is further than this from a bound.
DOUBT = 1e-5


@dataclass(frozen=True)
class Tree:
    """``cosine``: threshold. ``sample``: vectors the upper levels are fitted on (those with the least hash).
    ``fanout``: the most centres an upper level may have. ``chunk``: vectors in a chunk."""

    cosine: float = 0.95
    sample: int = 4096
    fanout: int = 512
    chunk: int = 4096

    @property
    def reach(self) -> float:
        """The distance of unit vectors at the threshold."""
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def leaf(self) -> float:
        """Radius of the tree's last level: the largest 2 to the power -k at which all of a node lies within reach."""
        return 2.0 ** math.floor(math.log2(max(self.reach, 1e-6) / 2))


@dataclass(frozen=True)
class Upper:
    """Upper levels, each an array of centres; ``parents[l][k]`` is the centre of level l - 1 above centre k of level l."""

    levels: tuple[np.ndarray, ...]
    parents: tuple[np.ndarray, ...]


def fit_upper(points: np.ndarray, fanout: int, least: float) -> Upper:
    """Nested levels of radius 1, 1/2, ... over the root, down to ``least`` or as long as a level has at most ``fanout`` centres."""
    levels, parents = [points[:1]], [np.zeros(1, np.int64)]
    nearest, chosen, radius = np.linalg.norm(points - points[:1], axis=1), [0], 1.0
    while radius >= least:
        added = list(chosen)
        while nearest.max() > radius and len(added) <= fanout:
            added.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(points - points[added[-1]], axis=1))
        if len(added) > fanout:
            break
        if len(added) > len(chosen):
            parents.append(np.argmax(points[added] @ levels[-1].T, axis=1))
            levels.append(points[added])
            chosen = added
        radius /= 2
    return Upper(tuple(levels), tuple(parents))


def node_pairs(upper: Upper, radii: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Dual traversal of the upper levels: pairs of last-level cells that can hold vectors within ``reach``.

    ``radii``: of each last-level cell, the largest distance of a vector of its own; below 0 where it has none.
    """
    last = len(upper.levels) - 1
    cover = [np.full(len(c), -np.inf) for c in upper.levels]
    cover[last] = np.where(radii < 0, -np.inf, radii)
    for level in range(last, 0, -1):  # a node covers its children and what they cover
        up = upper.parents[level]
        far = np.linalg.norm(upper.levels[level] - upper.levels[level - 1][up], axis=1) + cover[level]
        np.maximum.at(cover[level - 1], up, far)
    pairs = np.zeros((1, 2), np.int64)
    for level in range(last + 1):
        if level:
            under = [np.flatnonzero(upper.parents[level] == k) for k in range(len(upper.levels[level - 1]))]
            found = [(x, y) for a, b in pairs.tolist() for x in under[a] for y in under[b] if a != b or x <= y]
            pairs = np.array(found, np.int64).reshape(-1, 2)
        a, b = pairs[:, 0], pairs[:, 1]
        apart = np.linalg.norm(upper.levels[level][a] - upper.levels[level][b], axis=1)
        pairs = pairs[apart <= reach + cover[level][a] + cover[level][b] + DOUBT]
    return [(int(min(p)), int(max(p))) for p in pairs.tolist()]


def lower_nodes(points: np.ndarray, radius: float) -> list[np.ndarray]:
    """The last level of a chunk's own tree: for each node the members, the centre first, all within ``radius`` of it.

    Levels are nested, with halving radii from 1 down: a node is split as long as it reaches further than its level.
    """
    near = points.astype(np.float32) @ points.astype(np.float32).T if len(points) else np.zeros((0, 0), np.float32)
    nodes, r = [np.arange(len(points))] if len(points) else [], 1.0
    while True:
        least = np.float32(1 - max(r - DOUBT, 0) ** 2 / 2)  # cosine at distance r
        after = []
        for members in nodes:
            left = members
            while len(left):
                close = near[left[0], left] >= least
                close[0] = True
                after.append(left[close])
                left = left[~close]
        nodes = after
        if r <= radius or len(nodes) == len(points):
            return nodes
        r /= 2


@dataclass
class Chunk:
    """Vectors in the order of their nodes, a node's centre first."""

    ids: np.ndarray
    weights: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    radii: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], len(self.ids))


def chunk_of(rows: list[tuple]) -> Chunk:
    """From (node, id, weight, vector) rows in order."""
    node = np.array([r[0] for r in rows])
    points = np.array([r[3] for r in rows], np.float64)
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    sizes = np.diff(np.append(starts, len(rows)))
    far = np.linalg.norm(points - np.repeat(points[starts], sizes, axis=0), axis=1)
    return Chunk(np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), points, starts, np.maximum.reduceat(far, starts))


def settle(a: Chunk, b: Chunk | None, tree: Tree) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights that each vector of ``a`` and of ``b`` links with, and a spanning forest of the links.

    Without ``b``, the vectors of ``a`` among each other; a vector's own class is left out.
    """
    same, b = b is None, b or a
    apart = np.sqrt(np.maximum(2 - 2 * (a.points[a.starts].astype(np.float32) @ b.points[b.starts].astype(np.float32).T), 0))
    both = (a.radii[:, None] + b.radii[None, :]).astype(np.float32)
    linked = apart + both <= tree.reach - DOUBT  # whole nodes
    doubtful = (apart - both <= tree.reach + DOUBT) & ~linked
    if same:
        np.fill_diagonal(linked, True)  # the vectors of a leaf lie within reach of each other
        np.fill_diagonal(doubtful, False)
        doubtful = np.triu(doubtful)
    of_a, of_b = np.add.reduceat(a.weights, a.starts), np.add.reduceat(b.weights, b.starts)
    to_a = np.repeat(linked @ of_b, a.ends - a.starts)
    to_b = to_a if same else np.repeat(linked.T @ of_a, b.ends - b.starts)
    for p, q in zip(*np.nonzero(doubtful), strict=True):
        in_a, in_b = slice(a.starts[p], a.ends[p]), slice(b.starts[q], b.ends[q])
        close = a.points[in_a] @ b.points[in_b].T >= tree.cosine
        if close.any():
            to_a[in_a] += close @ b.weights[in_b]
            to_b[in_b] += close.T @ a.weights[in_a]
            linked[p, q] = True
            if same:
                linked[q, p] = True
    if same:
        to_a -= a.weights
        np.fill_diagonal(linked, False)
    return to_a, to_b, [*spanning(a, b, linked, same)]


def spanning(a: Chunk, b: Chunk, linked: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """Links that connect the same vectors as all links between linked nodes and, within one chunk, inside of nodes."""
    if same:
        for start, end in zip(a.starts.tolist(), a.ends.tolist(), strict=True):
            for k in range(start + 1, end):
                yield int(a.ids[start]), int(a.ids[k])
    name_a, name_b = a.ids[a.starts], b.ids[b.starts]
    new_a = linked.any(axis=1)
    new_b = new_a if same else linked.any(axis=0)
    for root in np.flatnonzero(new_a).tolist():
        if not new_a[root]:
            continue
        new_a[root] = False
        queue = [(root, True)]
        while queue:
            k, left = queue.pop()
            found = np.flatnonzero(linked[k] & new_b) if left else np.flatnonzero(linked[:, k] & new_a)
            (new_b if left else new_a)[found] = False
            for other in found.tolist():
                yield int(name_a[root]), int((name_b if left else name_a)[other])
                queue.append((other, same or not left))


def cells_of(vectors: DataFrame, upper: Upper) -> DataFrame:
    """(cell, far) added to (id, weight, v): the leaf cell and the distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = upper.levels[-1]
        for batch in batches:
            points = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if not len(points):
                continue
            cell = np.argmax(points @ last.T, axis=1)
            far = np.linalg.norm(points - last[cell], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "weight", "v")), pa.array(cell, pa.int64()), pa.array(far)],
                ["id", "weight", "v", "cell", "far"],
            )

    return vectors.mapInArrow(run, "id long, weight long, v array<double>, cell long, far double")


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal first ``by`` columns; the last column is a vector. Holds one group."""
    key, rows = None, []
    for batch in batches:
        *plain, vector = [batch.column(i) for i in range(batch.num_columns)]
        width = len(vector[0])
        matrix = vector.flatten().to_numpy().reshape(-1, width)
        for k, values in enumerate(zip(*[c.to_pylist() for c in plain], strict=True)):
            if values[:by] != key:
                if rows:
                    yield key, rows
                key, rows = values[:by], []
            rows.append((*values[by:], matrix[k].copy()))
    if rows:
        yield key, rows


def link_vectors(
    vectors: DataFrame, tree: Tree = Tree(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row for each row of ``vectors``: (vec_id, n_links, component_id, kept).

    Two rows link when the cosine of their vectors, in double precision, is ``tree.cosine`` or more. ``n_links``: rows that a row
    links with; ``component_id``: the least id reachable; ``kept``: whether that is the row's own. Vectors that are NULL or zero,
    hold NULL or non-finite components, or haven't the table's commonest length (the greatest of several) link with nothing.
    Rows with equal ids are rows of their own; a row without an id takes part, and its component's least id is NULL if there is
    none. Classes of equal vectors are told apart by a 64-bit hash. Other columns are left behind.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    widths = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = widths[0][0] if widths else 0
    largest = F.array_max(F.transform("v", F.abs))
    usable = (F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (largest > 0) & (largest < float("inf"))
    known = rows.withColumn("class", F.when(usable, F.xxhash64("v")))
    distinct = known.where("class is not null").groupBy("class").agg(F.count("*").alias("weight"), F.first("v").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if len(points):
                # scaled first: squares of very large or small components would leave the range of doubles
                points = points / np.abs(points).max(axis=1, keepdims=True)
                points = points / np.linalg.norm(points, axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(np.arange(len(points) + 1, dtype=np.int32) * (points.shape[1] if len(points) else 0), points.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("weight"), lists], ["id", "weight", "v"])

    units = stored(distinct.mapInArrow(unit, "id long, weight long, v array<double>"), "units")
    sample = units.orderBy(F.xxhash64("id"), "id").limit(tree.sample).select("v").collect()
    if sample:
        links = stored(_links(units, fit_upper(np.array([r[0] for r in sample]), tree.fanout, tree.leaf), tree), "vector-links")
    else:
        links = spark.createDataFrame([], "a long, b long, n long")
    weights = known.where("class is not null").groupBy("class").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    counts = links.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    reached = components(links.where("b is not null"), "a", "b").withColumnRenamed("node", "class")
    named = weights.join(counts, "class", "left").join(reached, "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(first, "component").select(
        F.col("class").alias("of"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component_id"
    )
    return known.join(of, F.col("class") == F.col("of"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(units: DataFrame, upper: Upper, tree: Tree) -> DataFrame:
    """(a, NULL, n): the weight that class a links with, in parts to be summed; (a, b, 0): links that span the components."""
    spark = units.sparkSession
    routed = stored(cells_of(units, upper), "cells")
    # one row for each of at most ``fanout`` cells
    cells = routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    radii = np.full(len(upper.levels[-1]), -1.0)
    parts = {}
    for cell, n, far in cells:
        radii[cell], parts[cell] = far, -(-n // tree.chunk)
    pairs = [(a, b) for a, b in node_pairs(upper, radii, tree.reach) if a in parts and b in parts]
    sizes = spark.createDataFrame([(c, p) for c, p in parts.items()], "cell long, parts long")
    chunk = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))
    chunked = routed.join(sizes, "cell").select(chunk.alias("chunk"), "id", "weight", "v").repartition("chunk").sortWithinPartitions("chunk", "id")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "node", "pos", "id", "weight", "v"]
        for (number,), rows in _groups(batches, 1):
            points = np.array([r[2] for r in rows])
            found = lower_nodes(points, tree.leaf)
            order = np.concatenate(found)
            node = np.repeat(np.arange(len(found)), [len(m) for m in found])
            lists = pa.ListArray.from_arrays(np.arange(len(order) + 1, dtype=np.int32) * points.shape[1], points[order].ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(order), number)), pa.array(node), pa.array(np.arange(len(order))), pa.array([rows[k][0] for k in order]), pa.array([rows[k][1] for k in order]), lists],
                names,
            )

    tables = stored(chunked.select("chunk", "id", "weight", "v").mapInArrow(nodes, "chunk long, node long, pos long, id long, weight long, v array<double>"), "chunks")
    part = lambda cell, n, name: F.explode(F.expr(f"transform(sequence(0L, {n} - 1L), k -> {cell} * {1 << 32}L + k)")).alias(name)
    cell_pairs = spark.createDataFrame([(a, b, parts[a], parts[b]) for a, b in pairs], "ca long, cb long, na long, nb long")
    chunk_pairs = cell_pairs.select("cb", "nb", part("ca", "na", "a")).select("a", part("cb", "nb", "b")).where("a <= b")
    sides = chunk_pairs.select("a", "b", F.col("a").alias("chunk"), F.lit(0).alias("side")).unionAll(
        chunk_pairs.where("a != b").select("a", "b", F.col("b").alias("chunk"), F.lit(1).alias("side"))
    )
    work = (
        tables.join(sides, "chunk").repartition("a", "b").sortWithinPartitions("a", "b", "side", "pos")
        .select("a", "b", "side", "node", "id", "weight", "v")
    )

    def pairwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for (a, b, side), rows in _groups(batches, 3):
            one = chunk_of(rows)
            if side == 0 and a != b:
                held = one
                continue
            left, right = (one, None) if a == b else (held, one)
            to_a, to_b, links = settle(left, right, tree)
            ids, n = (left.ids, to_a) if right is None else (np.concatenate([left.ids, right.ids]), np.concatenate([to_a, to_b]))
            some = n > 0
            ends_a = [*ids[some].tolist(), *(x for x, _ in links)]
            ends_b = [*[None] * int(some.sum()), *(y for _, y in links)]
            counts = [*n[some].tolist(), *[0] * len(links)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ends_a, ends_b, counts)], ["a", "b", "n"])

    return work.mapInArrow(pairwise, "a long, b long, n long")
