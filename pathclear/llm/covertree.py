"""Exact near-duplicate vectors by cover trees and dual traversal.

Vectors of one label and length are compared on the unit sphere, where a cosine is a distance. Equal
vectors are one node with a number of copies. The nodes of a label are dealt to cells by the nearest of a
few pivots, cells to blocks of at most about ``BLOCK`` nodes, and only pairs of cells closer than the
threshold plus both covering radii go on. Within a pair of blocks two cover trees, whose nested levels halve
their radius, are traversed together: a pair of tree nodes is dropped when their centres are farther apart
than the threshold and both covering radii, and taken whole when no member pair can be farther. What is
left is decided by the cosine itself.

Where vectors have no clusters (all about at right angles), no exact method prunes much, and every block
of a label meets every other one; the work there grows with the square of a label's nodes.

No pairs leave a block: link counts are summed and links reduced to a spanning forest there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.functions.settling import settle
from pathclear.operators.graph import connected_components, merge_labels

#: Nodes of a block, most pivots (cells) of a label, and its nodes that one task assigns to them.
BLOCK, PIVOTS, PART = 1024, 64, 16_384
#: Members of a tree node that are its children without another level; slack of distance bounds.
FEW, SLACK = 8, 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so neither very large nor very small ones overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Tree:
    """Members of a ball; children are balls of at most half its radius, the first around the same centre."""

    def __init__(self, points: np.ndarray, members: np.ndarray, radius: float):
        self.points, self.members = points, members
        self.parts: list[np.ndarray] = []
        self.radii: list[float] = []
        self.trees: dict[int, Tree] = {}
        if len(members) <= FEW or radius == 0:
            self.parts, self.radii = [members[i : i + 1] for i in range(len(members))], [0.0] * len(members)
        else:
            # A level at which one ball would hold all is passed over.
            reach = min(radius, float(_apart(points[members] @ points[members[0]]).max()))
            left = members
            while len(left):
                away = _apart(points[left] @ points[left[0]])
                away[0] = 0
                take = away <= reach / 2
                self.parts.append(left[take])
                self.radii.append(float(away[take].max()))
                left = left[~take]
        self.centres = points[[p[0] for p in self.parts]]
        self.cover = np.array(self.radii)
        self.single = np.array([len(p) == 1 for p in self.parts])

    def child(self, i: int) -> Tree:
        if i not in self.trees:
            self.trees[i] = Tree(self.points, self.parts[i], self.radii[i])
        return self.trees[i]


class Links:
    """Links between members of two sides (or within one), as counts and as edges that connect alike."""

    def __init__(self, threshold: float, copies: tuple[np.ndarray, np.ndarray], same: bool):
        self.threshold, self.far = threshold, math.sqrt(2 - 2 * threshold)
        self.copies, self.same = copies, same
        self.counts = (np.zeros(len(copies[0]), np.int64), np.zeros(len(copies[1]), np.int64))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.counts[0], a, self.copies[1][b])
        np.add.at(self.counts[1], b, self.copies[0][a])
        self.edges.append((a, b))

    def _all(self, a: np.ndarray, b: np.ndarray) -> None:
        self.counts[0][a] += self.copies[1][b].sum()
        self.counts[1][b] += self.copies[0][a].sum()
        self.edges += [(a, np.full(len(a), b[0])), (np.full(len(b), a[0]), b)]

    def visit(self, a: Tree, b: Tree) -> None:
        own = self.same and a is b
        cosine = a.centres @ b.centres.T
        away = _apart(cosine)
        reach = a.cover[:, None] + b.cover[None, :]
        near = away <= self.far + reach + SLACK
        if own:
            near = np.triu(near)
        single = a.single[:, None] & b.single[None, :]
        if own:
            hit = near & single & (cosine >= self.threshold)
            np.fill_diagonal(hit, False)
        else:
            hit = near & single & (cosine >= self.threshold)
        i, j = np.nonzero(hit)
        if len(i):
            first_a, first_b = np.array([p[0] for p in a.parts]), np.array([p[0] for p in b.parts])
            self._add(first_a[i], first_b[j])
        for i, j in zip(*np.nonzero(near & ~single), strict=True):
            if (not own or i != j) and away[i, j] + reach[i, j] <= self.far - SLACK:
                self._all(a.parts[i], b.parts[j])
            else:
                self.visit(a.child(i), b.child(j))


def block_links(
    a: np.ndarray, b: np.ndarray | None, copies_a: np.ndarray, copies_b: np.ndarray | None, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of both sides and edges (places in a, then those in b) for unit vectors; no b: within a."""
    left = Tree(a, np.arange(len(a)), 2.0)
    right = left if b is None else Tree(b, np.arange(len(b)), 2.0)
    links = Links(threshold, (copies_a, copies_a if b is None else copies_b), b is None)
    links.visit(left, right)
    u = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in links.edges)])
    v = np.concatenate([np.zeros(0, np.int64), *(y for _, y in links.edges)])
    if b is None:
        total = links.counts[0] + links.counts[1]
        return total, np.zeros(0, np.int64), u, v
    return *links.counts, u, v


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearest pivot and distance of every node. Rows come part by part of a label, its pivots first."""
    key, slots, pivots = None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "part")), strict=True))
        slot = batch.column("slot").to_pylist()
        vectors = batch.column("vector")
        nodes, cells, aways = [], [], []
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at] and (slot[end] is None) == (slot[at] is None):
                end += 1
            points = unit(_vectors(vectors.slice(at, end - at)))
            if keys[at] != key:
                key, slots, pivots = keys[at], [], []
            if slot[at] is not None:
                slots += slot[at:end]
                pivots.append(points)
            else:
                pivots = [np.concatenate(pivots)]
                distance = _apart(points @ pivots[0].T)
                nodes += range(at, end)
                cells.append(np.array(slots, np.int32)[distance.argmin(1)])
                aways.append(distance.min(1))
            at = end
        if nodes:
            part = batch.take(pa.array(nodes))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("node", "label", "dim", "vector", "copies")), pa.array(np.concatenate(cells)), pa.array(np.concatenate(aways))],
                names=["node", "label", "dim", "vector", "copies", "cell", "away"])


def _compared(threshold: float):
    keys = ("label", "dim", "cell_a", "block_a", "cell_b", "block_b")

    def result(key: tuple, rows: list[tuple]) -> list[tuple]:
        same = key[2:4] == key[4:6]
        nodes = [np.array([r[1] for r in rows if same or r[0] == side], np.int64) for side in (0, 1)]
        points = [[r[3] for r in rows if same or r[0] == side] for side in (0, 1)]
        copies = [np.array([r[2] for r in rows if same or r[0] == side], np.int64) for side in (0, 1)]
        if not points[0] or not points[1]:
            return []
        points = [unit(np.stack(p)) for p in points]
        if same:
            one, _, u, v = block_links(points[0], None, copies[0], None, threshold)
            counted, node = one, nodes[0]
        else:
            one, two, u, v = block_links(*points, *copies, threshold)
            counted, node, v = np.r_[one, two], np.r_[nodes[0], nodes[1]], v + len(one)
        label = merge_labels(len(node), u, v)
        out = [(int(node[i]), None, int(counted[i])) for i in np.flatnonzero(counted)]
        return out + [(int(node[i]), int(node[label[i]]), 0) for i in np.flatnonzero(label != np.arange(len(node)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            out: list[tuple] = []
            vectors = batch.column("vector")
            dims = vectors.value_lengths().to_numpy()
            edges = np.r_[0, np.cumsum(dims)]
            flat = vectors.flatten().to_numpy()
            columns = [batch.column(c).to_pylist() for c in (*keys, "side", "node", "copies")]
            for n, row in enumerate(zip(*columns, strict=True)):
                if row[:6] != last:
                    if held:
                        out += result(last, held)
                    held, last = [], row[:6]
                held.append((*row[6:], flat[edges[n] : edges[n + 1]]))
            yield written(out)
        if held:
            yield written(result(last, held))

    def written(rows: list[tuple]) -> pa.RecordBatch:
        u, v, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    return run


def usable(label: Column, vector: Column) -> Column:
    """Vectors that can have links: labelled, with finite components of which one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    cosine = dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding, label).

    Rows are linked if their labels are equal and their cosine is ``threshold`` or more; rows of different
    lengths, without a label, or without a usable vector have no links. Repeated rows are linked to each
    other. Rows without an id are kept, with the component of what they are linked to. Other columns are
    not read.
    """
    kind = dict(vectors.dtypes)
    rows = vectors.select(
        "vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0).cast("float")).alias("vector")
    ).withColumn("good", usable(F.col("label"), F.col("vector")))
    rows = rows.withColumn("node", F.when(F.col("good"), F.xxhash64("label", "vector")))
    nodes = settle(rows.filter("good").groupBy("node", "label", "vector").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")).withColumn("dim", F.size("vector")))
    sizes = nodes.groupBy("label", "dim").agg(
        F.least(F.lit(PIVOTS), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("cells"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    sized = nodes.join(sizes, ["label", "dim"])
    pivots = settle(sized.groupBy("label", "dim", "parts", F.expr("pmod(node, cells)").cast("int").alias("slot")).agg(
        F.min(F.struct("node", "vector")).alias("p")).select("label", "dim", "parts", "slot", "p.vector"))
    # A label's pivots go to each of its parts once, in front of the nodes.
    fields = f"node long, label {kind['label']}, dim int, vector {dict(rows.dtypes)['vector']}, copies long, cell int, away double"
    none = F.lit(None).cast("long")
    ahead = pivots.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slot", none.alias("node"), "vector", none.alias("copies"))
    behind = sized.select("label", "dim", F.expr("pmod(shiftright(node, 20), parts)").cast("int").alias("part"), F.lit(None).cast("int").alias("slot"), "node", "vector", "copies")
    part = ["label", "dim", "part"]
    placed = settle(ahead.unionByName(behind).repartition(*part).sortWithinPartitions(*part, F.col("slot").isNull()).mapInArrow(_assigned, fields))
    cells = placed.groupBy("label", "dim", "cell").agg(
        F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(
        pivots.select("label", "dim", F.col("slot").alias("cell"), F.col("vector").alias("pivot")), ["label", "dim", "cell"])
    cells = settle(cells)  # at most PIVOTS of each label
    other = cells.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("cell", "radius", "blocks", "pivot")])
    far = math.sqrt(2 - 2 * threshold)
    meeting = cells.join(other, ["label", "dim"]).filter(
        _distance(F.col("pivot"), F.col("pivot_b")) <= F.col("radius") + F.col("radius_b") + far + SLACK
    ).select("label", "dim", "cell", "blocks", "cell_b", "blocks_b")
    # A node goes to every block of the cells its own meets; the lower (cell, block) is side a.
    mine = F.expr("pmod(shiftright(node, 7), blocks)").cast("int")
    spread = placed.join(meeting, ["label", "dim", "cell"]).withColumn("block", mine).withColumn(
        "block_o", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    low = F.struct(F.col("cell"), F.col("block")) <= F.struct(F.col("cell_b").alias("cell"), F.col("block_o").alias("block"))
    sent = spread.select(
        "label", "dim",
        F.when(low, F.col("cell")).otherwise(F.col("cell_b")).alias("cell_a"), F.when(low, F.col("block")).otherwise(F.col("block_o")).alias("block_a"),
        F.when(low, F.col("cell_b")).otherwise(F.col("cell")).alias("cell_b"), F.when(low, F.col("block_o")).otherwise(F.col("block")).alias("block_b"),
        F.when(low, F.lit(0)).otherwise(F.lit(1)).alias("side"), "node", "copies", "vector")
    keys = ["label", "dim", "cell_a", "block_a", "cell_b", "block_b"]
    found = settle(sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compared(threshold), "u long, v long, n long"))
    counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    forest = found.filter("v is not null").select("u", "v")
    ends = forest.select(F.col("u").alias("id")).union(forest.select("v")).distinct()
    groups = settle(connected_components(ends, forest, []).withColumnRenamed("id", "node").join(nodes.select("node", "least"), "node"))
    least = groups.groupBy("component").agg(F.min("least").alias("class_least"))
    classes = groups.join(least, "component").select("node", "class_least")
    of_node = nodes.select("node", "least", "copies").join(counts, "node", "left").join(classes, "node", "left").select(
        "node", F.coalesce("class_least", "least").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    linked = rows.filter("good").select("vec_id", "node").join(of_node, "node").select("vec_id", "links", "component")
    alone = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"))
