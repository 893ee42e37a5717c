"""Point scenes made of surfaces, and their frame tables.

A scene is a stack of surfaces, each the grid of an x, a y and a z axis; the sensor stands at the origin, one
metre above the floor. Bends and slopes are maps of finished scenes.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

IDENTITY = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
FLOOR_Z = -1.0


def grid(x, y, z):
    """All combinations of three axes as points."""
    mesh = np.meshgrid(np.atleast_1d(x), np.atleast_1d(y), np.atleast_1d(z), indexing="ij")
    return np.column_stack([axis.ravel() for axis in mesh]).astype(float)


def spread(low, high, step):
    """Even places from ``low`` to ``high``, both included, about ``step`` apart."""
    return np.linspace(low, high, max(2, int(round((high - low) / step)) + 1))


def floor(x_from, x_to, grade=0.0, half_width=2.4):
    """Level (or rising) floor, every other row shifted sideways by half a step."""
    x, step = spread(x_from, x_to, 0.9), 0.22
    y = np.arange(-half_width, half_width + 1e-9, step)
    even, odd = grid(x[::2], y, FLOOR_Z), grid(x[1::2], y[:-1] + step / 2, FLOOR_Z)
    points = np.concatenate([even, odd])
    points[:, 2] += grade * points[:, 0]
    return points


def box(x, y0, y1, h0, h1):
    """Solid half a metre deep, from one height above the floor to another."""
    return grid(spread(x, x + 0.48, 0.07), spread(y0, y1, 0.07), FLOOR_Z + spread(h0, h1, 0.07))


def block():
    """A chest of a person's size on the track, twenty metres ahead."""
    return box(20, -0.32, 0.32, 0.3, 1.6)


def flat_scene(obstacle):
    return np.concatenate([floor(4, 50), block()] if obstacle else [floor(4, 50)])


def _line_side(length=300.0):
    """Things along a line, in its own coordinates: posts at uneven gaps, walls that step in and out."""
    rng = np.random.default_rng(20)
    parts, at = [], 4.0
    while at < length:
        parts.append(grid(at + np.array([0.0, 0.08, 0.16, 0.24]), [-1.95, 1.85], FLOOR_Z + spread(0, 2.4, 0.12)))
        at += rng.uniform(8.0, 15.0)
    at, wide = 0.0, 2.55
    while at < length:
        panel = rng.uniform(0.8, 3.2)
        parts.append(grid(np.arange(at, at + panel, 0.1), [-wide, wide], FLOOR_Z + spread(0.3, 2.9, 0.28)))
        at, wide = at + panel, 5.6 - wide
    return np.concatenate(parts)


LINE_SIDE = _line_side()


def moving_tunnel(i, speed, obstacle=False):
    """What is seen of the line after ``i`` frames at 10 Hz; the floor looks the same everywhere."""
    seen = LINE_SIDE - [speed * 0.1 * i, 0, 0]
    seen = seen[(seen[:, 0] >= 1) & (seen[:, 0] <= 100)]
    return np.concatenate([floor(1, 100), seen, *([box(20, -0.4, 0.4, 0.3, 1.7)] if obstacle else [])])


def bend(points, radius):
    """The scene along a track that curves to the left."""
    out = points.copy()
    out[:, 1] += out[:, 0] ** 2 / (2 * radius)
    return out


def curved_tunnel(radius):
    walls = grid(spread(1, 90, 0.24), [-2.3, 2.3], FLOOR_Z + spread(0.2, 3.0, 0.2))
    return bend(np.concatenate([floor(1, 90, half_width=1.8), walls]), radius)


def frame(source, seq, points, stamp_ns=0, session=1, verified=False, allow=True, tf=True,
          rotation=None, translation=(0.0, 0.0, 0.0)):
    return {
        "source": source, "session": session, "frame_sequence": seq, "bag_stamp_ns": stamp_ns,
        "measurement_time_ns": stamp_ns, "points": np.asarray(points, dtype=float).reshape(-1, 3),
        "transform_available": tf, "rotation": rotation or IDENTITY, "translation": list(translation),
        "calibration_verified": verified, "allow_unverified_calibration": allow,
    }


def table(spark, frames):
    """Frame rows as a Spark table with nested points."""
    def points(p):
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(3)], names=["x", "y", "z"])

    sizes = np.cumsum([0] + [len(f["points"]) for f in frames])
    flat = points(np.concatenate([f["points"] for f in frames]))
    data = {
        "points": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat),
        **{k: [f[k] for f in frames] for k in frames[0] if k != "points"},
    }
    path = tempfile.mkdtemp(prefix="scene-") + "/frames.parquet"
    pq.write_table(pa.table(data), path)
    return spark.read.parquet(path)
