"""Column expressions on points: coordinates, heights, route offsets, angular cells, boxes, rays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_STRIDE = 4096  # Above the 3600 elevation cells of the finest allowed angular cell.
INF = float("inf")


def finite(c: Column) -> Column:
    """False for null, infinity and NaN (which orders above infinity)."""
    return F.coalesce(F.abs(c) < INF, F.lit(False))


def all_finite(*columns: Column) -> Column:
    out = finite(columns[0])
    for c in columns[1:]:
        out = out & finite(c)
    return out


def norm(*columns: Column) -> Column:
    total = columns[0] * columns[0]
    for c in columns[1:]:
        total = total + c * c
    return F.sqrt(total)


def rigid(x: Column, y: Column, z: Column, rotation, translation) -> tuple[Column, Column, Column]:
    """R p + t with a row-major rotation; elements may be numbers or columns."""
    r, t = rotation, translation
    return tuple(
        r[3 * i] * x + r[3 * i + 1] * y + r[3 * i + 2] * z + t[i] for i in range(3)
    )


def valid_rotation(rotation: Column, translation: Column, tolerance: float = 1e-6) -> Column:
    """Finite, orthonormal within ``tolerance`` and with determinant one (no reflection)."""
    r = [F.get(rotation, i) for i in range(9)]
    t = [F.get(translation, i) for i in range(3)]
    ok = (F.size(rotation) == 9) & all_finite(*r, *t)
    for i in range(3):
        for j in range(i, 3):
            dot = sum((r[3 * i + k] * r[3 * j + k] for k in range(1, 3)), r[3 * i] * r[3 * j])
            ok = ok & (F.abs(dot - F.lit(1.0 if i == j else 0.0)) <= tolerance)
    det = (
        r[0] * (r[4] * r[8] - r[5] * r[7])
        - r[1] * (r[3] * r[8] - r[5] * r[6])
        + r[2] * (r[3] * r[7] - r[4] * r[6])
    )
    return F.coalesce(ok & (F.abs(det - 1.0) <= tolerance), F.lit(False))


def to_target(x: Column, y: Column, z: Column):
    """Sensor axes to the assumed forward frame (yaw +90 degrees)."""
    return -y, x, z


def to_sensor(x: Column, y: Column, z: Column):
    return y, -x, z


def within(x: Column, y: Column, z: Column, box) -> Column:
    """Inclusive axis-aligned box test."""
    return (
        x.between(box.low[0], box.high[0])
        & y.between(box.low[1], box.high[1])
        & z.between(box.low[2], box.high[2])
    )


def height(x: Column, y: Column, z: Column, plane) -> Column:
    a, b, c = plane
    return z - (a * x + b * y + c)


def route_center(x: Column, route) -> Column:
    c0, c1, c2 = route
    return c0 + c1 * x + c2 * x * x


def route_offset(x: Column, y: Column, route) -> Column:
    return y - route_center(x, route)


def plane_distance(x: Column, y: Column, z: Column, plane: Column) -> Column:
    """Normal distance to a published plane [a, b, c, d]; z itself without a usable plane."""
    a, b, c, d = (F.get(plane, i) for i in range(4))
    usable = plane.isNotNull() & (F.size(plane) == 4) & all_finite(a, b, c, d)
    return F.when(usable, (a * x + b * y + c * z + d) / norm(a, b, c)).otherwise(z)


def published_plane(a: Column, b: Column, c: Column) -> Column:
    scale = F.sqrt(1 + a * a + b * b)
    return F.array(-a / scale, -b / scale, 1 / scale, -c / scale)


def degrees(radians: Column) -> Column:
    return radians * 180.0 / math.pi


def azimuth_deg(x: Column, y: Column) -> Column:
    return degrees(F.atan2(y, x))


def elevation_deg(x: Column, y: Column, z: Column) -> Column:
    return degrees(F.atan2(z, norm(x, y)))


def _clamped_floor(value: Column, count: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor(value))).cast("int")


def azimuth_cell(x: Column, y: Column, cell_deg: float) -> Column:
    return _clamped_floor((azimuth_deg(x, y) + 180.0) / cell_deg, math.ceil(360.0 / cell_deg))


def elevation_cell(x: Column, y: Column, z: Column, cell_deg: float) -> Column:
    return _clamped_floor((elevation_deg(x, y, z) + 90.0) / cell_deg, math.ceil(180.0 / cell_deg))


def cell_key(az: Column, el: Column) -> Column:
    return az.cast("long") * CELL_STRIDE + el


def wrapped_offset_deg(azimuth: Column, center_deg: float) -> Column:
    """Signed angle from ``center_deg``, wrapped into [-180, 180)."""
    return F.pmod(azimuth - center_deg + 180.0, F.lit(360.0)) - 180.0


def ray_box_span(direction, low, high) -> tuple[Column, Column]:
    """Slab test: distances along a unit ray at which it enters and leaves a box."""
    enters, leaves = [], []
    for d, lo, hi in zip(direction, low, high):
        lo, hi = F.lit(lo).cast("double"), F.lit(hi).cast("double")
        flat, spans = d == 0, (lo <= 0) & (hi >= 0)
        near, far = F.try_divide(lo, d), F.try_divide(hi, d)
        enters.append(
            F.when(flat, F.when(spans, -INF).otherwise(INF)).otherwise(F.least(near, far))
        )
        leaves.append(
            F.when(flat, F.when(spans, INF).otherwise(-INF)).otherwise(F.greatest(near, far))
        )
    return F.greatest(*enters), F.least(*leaves)


def entry_distance(enter: Column, leave: Column) -> Column:
    """Distance to the box in front of the origin, +inf on a miss."""
    return F.when((enter <= leave) & (enter > 0), enter).otherwise(F.lit(INF))


def box_contains(center, low, high, margin: float) -> Column:
    """Inclusive containment of a centre in a box widened by ``margin`` on every side."""
    ok = F.lit(True)
    for c, lo, hi in zip(center, low, high):
        ok = ok & (c >= lo - margin) & (c <= hi + margin)
    return ok


def crossing_lateral(time_s: Column, half_width_m: float, speed_mps: float) -> Column:
    """Triangle wave of an object that walks across the route and back."""
    period = 4 * half_width_m / speed_mps
    phase = F.pmod(time_s, F.lit(period)) / period
    return half_width_m * (4 * F.abs(phase - 0.5) - 1)


def floor_at(plane, x: Column, y: Column) -> Column:
    """Height of a published plane [nx, ny, nz, d] at (x, y)."""
    return -(plane[0] * x + plane[1] * y + plane[3]) / plane[2]
