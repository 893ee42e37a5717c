"""Neighbour joins on grids and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.functions import geometry as g
from pathclear.functions.settling import settle


def shifts(reach: int, axes: int = 2, half: bool = False) -> list[tuple[int, ...]]:
    """Grid offsets within ``reach``; ``half`` keeps one of every opposite pair (and not zero)."""
    span = range(-reach, reach + 1)
    grid = [()]
    for _ in range(axes):
        grid = [(*p, d) for p in grid for d in span]
    zero = (0,) * axes
    return [p for p in grid if (p > zero if half else p != zero)]


def shift_array(offsets: list[tuple[int, ...]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in offsets])


def depth_compatible(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 0.5 + 0.02 * F.least(a, b)


def adjacent_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of evidence cells at most two cells apart at compatible ranges (each pair once).

    An equi-join on the shifted cell: a cell meets at most twelve others.
    """
    left = cells.select(
        *keys, F.col("az").alias("az1"), F.col("el").alias("el1"), F.col("range").alias("range1"),
        F.explode(shift_array(shifts(2, half=True))).alias("s"),
    ).select(*keys, "az1", "el1", "range1", (F.col("az1") + F.col("s.d0")).alias("az"),
             (F.col("el1") + F.col("s.d1")).alias("el"))
    right = cells.select(*keys, "az", "el", "range")
    return left.join(right, [*keys, "az", "el"]).filter(
        depth_compatible(F.col("range1"), F.col("range"))
    ).select(*keys, "az1", "el1", F.col("az").alias("az2"), F.col("el").alias("el2"))


def merge_labels(count: int, a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Smallest member index of every node's component, by hooking and pointer jumping.

    ``known``: labels that earlier links have led to.
    """
    label = np.arange(count) if known is None else known
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def label_cells(az: np.ndarray, el: np.ndarray, range_m: np.ndarray | None, reach: int) -> np.ndarray:
    """Component of every cell (as the index of its smallest cell key)."""
    key = az.astype(np.int64) * g.CELL_STRIDE + el
    order = np.argsort(key)
    keys = key[order]
    heads, tails = [], []
    for da, de in shifts(reach, half=True):
        wanted = keys + da * g.CELL_STRIDE + de
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        i, j = np.flatnonzero(hit), at[hit]
        if range_m is not None:
            r, s = range_m[order[i]], range_m[order[j]]
            near = np.abs(r - s) <= 0.5 + 0.02 * np.minimum(r, s)
            i, j = i[near], j[near]
        heads.append(i)
        tails.append(j)
    label = merge_labels(len(keys), np.concatenate(heads), np.concatenate(tails))
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = keys[label]
    return out


def cell_components(cells: DataFrame, keys: list[str], reach: int = 2, by_range: bool = True, carried=()):
    """Adds ``component`` to angular (or plan) cells, per frame; ``carried`` names columns that go with a cell.

    A frame's cells are distinct places of one fixed grid (1440 x 720 at a quarter degree), so a
    frame is a bounded group however many points it has.
    """
    columns = [*keys, "az", "el", *(["range"] if by_range else []), *carried]
    small = cells.select(*columns)
    schema = ", ".join(f"{c} {t}" for c, t in small.dtypes) + ", component long"

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        depth = frame["range"].to_numpy() if by_range else None
        frame["component"] = label_cells(frame["az"].to_numpy(), frame["el"].to_numpy(), depth, reach)
        return frame

    return small.groupBy(*keys).applyInPandas(label, schema)


def wall_contact(
    boxes: DataFrame, cells: DataFrame, keys: list[str], id_: str, cell_m: float = 0.5, wall_m: float = 1.6
) -> DataFrame:
    """``keys, id_`` of the boxes from which occupied plan cells lead, side by side or corner to corner, to the wall
    zone beside the route.

    ``cells``: keys, ix, iy, offset, one per occupied cell.  ``boxes``: keys, id_, lo_x, lo_y, hi_x, hi_y.  Cells
    are labelled once per frame; a box touches a wall if a cell in it is of a component that reaches one.
    """
    half = g.CELL_STRIDE // 2
    grid = cells.select(*keys, F.col("ix").alias("az"), (F.col("iy") + half).alias("el"), "offset")
    parts = grid.join(cell_components(grid, keys, reach=1, by_range=False), [*keys, "az", "el"])
    walls = parts.groupBy(*keys, "component").agg(F.max(F.abs("offset")).alias("_far")).filter(F.col("_far") >= wall_m)
    leading = parts.join(walls, [*keys, "component"], "left_semi").select(*keys, F.col("az").alias("ix"), (F.col("el") - half).alias("iy"))

    def covered(axis):
        return F.explode(F.sequence(F.floor(F.col(f"lo_{axis}") / cell_m), F.floor(F.col(f"hi_{axis}") / cell_m))).alias(f"i{axis}")

    asked = boxes.select(*keys, id_, "lo_y", "hi_y", covered("x")).select(*keys, id_, "ix", covered("y"))
    return asked.join(leading, [*keys, "ix", "iy"], "left_semi").select(*keys, id_).distinct()


def _signature(edges: DataFrame, keys: list[str]):
    mark = F.xxhash64(*keys, "u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark)).first())


def connected_components(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest ``id`` of every vertex's component, for groups of any size.

    Alternating star contraction: every round replaces edges by edges to the smallest neighbour,
    with minima combined before the shuffle; the edge list is settled after every round.
    """
    edges = settle(
        edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") != F.col("v")).distinct()
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, [*keys, "u"]).filter(F.col("v") > F.col("u")).select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        moved = large.join(least, [*keys, "u"]).filter(F.col("v") != F.col("m")).select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")
        )
        kept = least.select(*keys, "u", F.col("m").alias("v"))
        edges = settle(moved.unionByName(kept).filter(F.col("u") != F.col("v")).distinct())
        now = _signature(edges, keys)
        if now == seen:
            break
        seen = now
    labels = edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.join(labels, [*keys, "id"], "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def neighbour_radius(range_m: Column, az_res_deg: float, el_step_deg: float, k=2.5, low=0.15, high=0.6):
    """Radius that grows with range: k times the larger cell side, clipped."""
    import math

    side = max(math.radians(az_res_deg), math.radians(el_step_deg))
    return F.greatest(F.lit(low), F.least(F.lit(high), k * (range_m * side)))


def unmatched_near(
    left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, radius: float
) -> DataFrame:
    """Rows of ``left`` with no ``right`` row closer than ``radius`` in the plane (anti-join)."""
    cells = {"_ix": F.floor(F.col(x) / radius), "_iy": F.floor(F.col(y) / radius)}
    around = right.withColumns(cells).withColumn(
        "_s", F.explode(shift_array([(0, 0), *shifts(1)]))
    ).select(
        *keys, (F.col("_ix") + F.col("_s.d0")).alias("_ix"), (F.col("_iy") + F.col("_s.d1")).alias("_iy"),
        F.col(x).alias("_rx"), F.col(y).alias("_ry"),
    )
    placed = left.withColumns(cells)
    apart = g.norm(placed[x] - around["_rx"], placed[y] - around["_ry"])
    same = [placed[k] == around[k] for k in [*keys, "_ix", "_iy"]]
    condition = apart < radius
    for c in same:
        condition = condition & c
    return placed.join(around, condition, "left_anti").drop("_ix", "_iy")
