"""Floor plane of one frame from its lowest returns per cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathclear.config import DetectorConfig
from pathclear.operators.grids import lowest_per_cell

# Fixed values of the sampling sequence: attempts, seed, multiplier, increment (modulo 2^32).
ATTEMPTS, SEED, MULTIPLIER, INCREMENT = 256, 0x9E3779B9, 1664525, 1013904223


def sample_draws() -> np.ndarray:
    """Raw draws, three per attempt; every frame reduces the same sequence by its seed count."""
    draws, value = np.empty(3 * ATTEMPTS, dtype=np.int64), SEED
    for i in range(len(draws)):
        value = (value * MULTIPLIER + INCREMENT) % 2**32
        draws[i] = value
    return draws.reshape(ATTEMPTS, 3)


def _plausible(a, b, c, config):
    return (
        np.isfinite(a) & np.isfinite(b) & np.isfinite(c)
        & (np.hypot(a, b) <= config.ground_max_slope) & (c >= -3) & (c <= 0.5)
    )


def _planes(seeds: np.ndarray, picks: np.ndarray, config: DetectorConfig) -> np.ndarray:
    """Plausible planes through the picked triples."""
    p, q, r = (seeds[picks[:, i]] for i in range(3))
    u, v = q - p, r - p
    det = u[:, 0] * v[:, 1] - v[:, 0] * u[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (u[:, 2] * v[:, 1] - v[:, 2] * u[:, 1]) / det
        b = (u[:, 0] * v[:, 2] - v[:, 0] * u[:, 2]) / det
        c = p[:, 2] - a * p[:, 0] - b * p[:, 1]
    good = (np.abs(det) >= 0.5) & _plausible(a, b, c, config)
    return np.stack([a, b, c], axis=1)[good]


def _choose(planes: np.ndarray, support: np.ndarray, tolerance: float) -> np.ndarray:
    """Best supported plane, unless a distinct and well supported one lies below it."""
    level = planes[:, 0] * 10 + planes[:, 2]
    most = support.max()
    top = np.flatnonzero(support == most)
    best = top[np.argmin(level[top])]
    below = np.flatnonzero((support * 10 >= most * 6) & (level < level[best] - 2 * tolerance))
    lower = best
    for i in below:
        if (
            support[lower] == support[best] or support[i] > support[lower]
            or (support[i] == support[lower] and level[i] < level[lower])
        ):
            lower = i
    return planes[lower]


def _refit(seeds: np.ndarray, plane: np.ndarray, config: DetectorConfig) -> np.ndarray:
    """Least squares over the inliers; the sampled plane stays when the refit is not plausible."""
    design = np.column_stack([seeds[:, 0], seeds[:, 1], np.ones(len(seeds))])
    near = np.abs(seeds[:, 2] - design @ plane) <= config.ground_inlier_tolerance_m
    a = design[near]
    normal = a.T @ a
    if abs(np.linalg.det(normal)) < 1e-9:
        return plane
    refit = np.linalg.solve(normal, a.T @ seeds[near, 2])
    return refit if _plausible(*refit, config) else plane


def fit_plane(seeds: np.ndarray, draws: np.ndarray, config: DetectorConfig):
    """(a, b, c) of the route floor, or None."""
    if len(seeds) < config.min_ground_inliers:
        return None
    planes = _planes(seeds, draws % len(seeds), config)
    if not len(planes):
        return None
    x, y, z = seeds.T
    height = z[None, :] - planes[:, :1] * x - planes[:, 1:2] * y - planes[:, 2:]
    inlier = np.abs(height) <= config.ground_inlier_tolerance_m
    support = inlier.sum(axis=1)
    # A small patch, rail or platform edge cannot establish the route surface.
    parts = [x < 25, x >= 25, y < -0.25, y > 0.25]
    spread = np.all([(inlier & part).any(axis=1) for part in parts], axis=0)
    good = spread & (support >= config.min_ground_inliers)
    if not good.any():
        return None
    plane = _choose(planes[good], support[good], config.ground_inlier_tolerance_m)
    return _refit(seeds, plane, config)


def floor_from_seeds(x: Column, y: Column, z: Column, config: DetectorConfig) -> Column:
    """Plane struct per frame from the seed coordinates in cell order.

    The grid bounds the arrays to about 90 x 26 seeds, whatever the cloud holds.
    """
    draws = sample_draws()

    @F.pandas_udf("a double, b double, c double, valid boolean")
    def fit(xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.DataFrame:
        rows = []
        for seeds in zip(xs, ys, zs):
            plane = fit_plane(np.column_stack(seeds), draws, config)
            a, b, c = plane if plane is not None else (0.0, 0.0, 0.0)
            rows.append((a, b, c, plane is not None))
        return pd.DataFrame(rows, columns=["a", "b", "c", "valid"])

    return fit(x, y, z)


def sampled_floor(points: DataFrame, keys: list[str], config: DetectorConfig) -> DataFrame:
    """Floor plane ``a, b, c`` per frame that has one, from the lowest returns of its floor cells."""
    seeds = lowest_per_cell(points, keys, config).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("cell", "x", "y", "z"))).alias("seeds"))
    axes = [F.col(f"seeds.{c}") for c in "xyz"]
    return seeds.select(*keys, floor_from_seeds(*axes, config).alias("p")).filter("p.valid").select(*keys, "p.a", "p.b", "p.c")


def curve_of(now: np.ndarray, then: np.ndarray, last: int) -> list[float]:
    """Mean capped difference per forward shift of two (row, bin) profiles; NaN marks gaps."""
    bins, curve = now.shape[1], []
    for shift in range(last + 1):
        gap = np.abs(now[:, : bins - shift] - then[:, shift:]).astype(np.float64)
        gap = gap[~np.isnan(gap)]
        curve.append(np.minimum(gap, 0.3).mean() if len(gap) >= 200 else np.nan)
    return curve


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def shift_curve(
    at: pd.Series, value: pd.Series, past_at: pd.Series, past_value: pd.Series, last: pd.Series
) -> pd.Series:
    """Error of every forward shift between two lateral profiles, given as occupied bins.

    A shift with fewer than 200 common bins has no error.
    """
    def dense(k, v):
        flat = np.full(6 * 640, np.nan, dtype=np.float32)
        flat[k] = v
        return flat.reshape(6, 640)

    curves = []
    for k, v, pk, pv, top in zip(at, value, past_at, past_value, last):
        missing = pk is None or top is None or np.isnan(top)
        curves.append(None if missing else curve_of(dense(k, v), dense(pk, pv), int(top)))
    return pd.Series(curves)
