"""Per-point filters, flags and frame admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.config import DetectorConfig
from pathclear.functions import geometry as g

# What became of a raw point.
INVALID, BLIND, OUTSIDE, GEOMETRY = 0, 1, 2, 3

# Analysis status on the wire.
OK, BAD_INPUT, TF_UNAVAILABLE, INVALID_GEOMETRY, INTERNAL = 0, 1, 2, 3, 4
# Evidence channels.
MOTION, GAUGE = 1, 2


def classify(df: DataFrame, config: DetectorConfig, rotation, translation) -> DataFrame:
    """Adds target-frame ``x y z``, ``fate`` and ``in_detection`` to sensor points ``sx sy sz``.

    The invalid and blind tests look at the sensor frame, the zones at the target frame.
    """
    sx, sy, sz = F.col("sx"), F.col("sy"), F.col("sz")
    x, y, z = g.rigid(sx, sy, sz, rotation, translation)
    df = df.withColumns({"x": x, "y": y, "z": z})
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    invalid = ~g.all_finite(sx, sy, sz) | ((sx == 0) & (sy == 0) & (sz == 0))
    fate = (
        F.when(invalid, INVALID)
        .when(g.norm(sx, sy, sz) < config.blind_radius_m, BLIND)
        .when(g.within(x, y, z, config.geometry_roi), GEOMETRY)
        .otherwise(OUTSIDE)
    )
    df = df.withColumn("fate", fate)
    seen = (F.col("fate") == GEOMETRY) & g.within(x, y, z, config.detection_roi)
    return df.withColumn("in_detection", seen)


def overflowed() -> Column:
    """A finite, unblinded point whose transformed coordinates are not finite."""
    return (F.col("fate") == OUTSIDE) & ~g.all_finite(F.col("x"), F.col("y"), F.col("z"))


def count_fates(df: DataFrame, keys: list[str]) -> DataFrame:
    fate = F.col("fate")
    return df.groupBy(*keys).agg(
        F.count_if(fate == INVALID).alias("invalid_point_count"),
        F.count_if(fate == BLIND).alias("blind_point_count"),
        F.count_if(fate == OUTSIDE).alias("outside_roi_point_count"),
        F.count_if(fate == GEOMETRY).alias("geometry_point_count"),
        F.count_if("in_detection").alias("detection_point_count"),
        F.count_if(overflowed()).alias("overflow_count"),
    )


def admission_reason(
    point_count: Column, max_points: int | None, transform_available: Column, transform_valid: Column,
    overflow: Column, verified: Column, allow_unverified: Column, geometry_points: Column,
) -> Column:
    """First reason that stops a frame before the detector; null when it is admitted."""
    return (
        F.when(point_count > max_points, "POINT_LIMIT_EXCEEDED")
        .when(point_count == 0, "EMPTY_INPUT")
        .when(~transform_available, "TF_UNAVAILABLE")
        .when(~transform_valid, "INVALID_TRANSFORM")
        .when(overflow, "TRANSFORM_OVERFLOW")
        .when(~verified & ~allow_unverified, "CALIBRATION_UNVERIFIED")
        .when(geometry_points == 0, "EMPTY_GEOMETRY_ROI")
    )


def admission_status(reason: Column) -> Column:
    return (
        F.when(reason.isin("POINT_LIMIT_EXCEEDED", "EMPTY_INPUT"), BAD_INPUT)
        .when(reason == "TF_UNAVAILABLE", TF_UNAVAILABLE)
        .when(reason.isNotNull(), INVALID_GEOMETRY)
        .otherwise(OK)
    )


def calibration_trust(verified: Column, allow_unverified: Column) -> Column:
    return (
        F.when(verified, "VERIFIED").when(allow_unverified, "ASSUMED").otherwise("UNKNOWN")
    )


def in_floor_band(x: Column, y: Column, z: Column, config: DetectorConfig, max_x) -> Column:
    return (
        (x >= 2) & (x <= max_x) & (F.abs(y) <= config.band_half_width_m) & (z >= -3) & (z <= 0.5)
    )


def plausible_plane(a: Column, b: Column, c: Column, config: DetectorConfig) -> Column:
    return (
        g.all_finite(a, b, c) & (g.norm(a, b) <= config.ground_max_slope) & (c >= -3) & (c <= 0.5)
    )


def evidence_limits(config: DetectorConfig, floor_below_sensor: Column | float):
    """(band, gauge) minimum heights, raised above the rail heads where those are known."""
    if config.sensor_height_above_rail_m <= 0:
        rail = F.lit(0.0)
    else:
        above = floor_below_sensor - config.sensor_height_above_rail_m
        rail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), above)) + config.rail_head_margin_m
    return (
        F.greatest(F.lit(config.obstacle_min_height_m), rail),
        F.greatest(F.lit(config.static_min_height_m), rail),
    )


def evidence(
    x: Column, offset: Column, h: Column, config: DetectorConfig, end_x: Column,
    route_valid: Column, route_max_x: Column, far_end: Column, band_min: Column,
    gauge_min: Column,
) -> tuple[Column, Column]:
    """(in_band, in_gauge) for a detection point; ``offset`` is absolute."""
    far = x > end_x
    gauge_on = route_valid & F.lit(config.static_channel)
    reach = ~far | (gauge_on & (x <= far_end))
    start = x >= config.detection_roi.low[0]
    in_band = (
        ~far & start & (offset <= config.band_half_width_m) & (h >= band_min)
        & (h <= config.corridor_height_m)
    )
    near_gauge = (
        (offset <= config.gauge_half_width_m) & (h >= gauge_min) & (h <= config.gauge_max_height_m)
    )
    far_gauge = (
        (offset <= min(config.far_gauge_half_width_m, config.gauge_half_width_m))
        & (h >= config.far_gauge_min_height_m) & (h <= config.gauge_max_height_m)
    )
    in_gauge = (
        start & reach & gauge_on & (x <= route_max_x)
        & F.when(far, far_gauge).otherwise(near_gauge)
    )
    return in_band, in_gauge


def structure_point(offset: Column, h: Column, config: DetectorConfig) -> Column:
    return (offset > config.low_object_half_width_m) & (h < config.low_object_height_m)


def point_label(
    x: Column, y: Column, z: Column, offset: Column, h: Column, candidates: Column,
    floor_valid: Column, corridor_end: Column, config: DetectorConfig,
) -> Column:
    """2 inside any candidate box (+0.1 m), 1 in the evaluated corridor, else 0."""
    box = F.exists(
        candidates,
        lambda c: (F.abs(x - c["cx"]) <= c["sx"] / 2 + 0.1)
        & (F.abs(y - c["cy"]) <= c["sy"] / 2 + 0.1)
        & (F.abs(z - c["cz"]) <= c["sz"] / 2 + 0.1),
    )
    corridor = (
        floor_valid & (x >= config.detection_roi.low[0]) & (x <= corridor_end)
        & (F.abs(offset) <= config.corridor_half_width_m)
        & (h >= -0.3) & (h <= config.corridor_height_m)
    )
    return (
        F.when(F.coalesce(box, F.lit(False)), 2)
        .when(F.coalesce(corridor, F.lit(False)), 1)
        .otherwise(0)
    )


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], salt_on: str, salts: int = 8,
    how: str = "inner",
) -> DataFrame:
    """Join per-frame attributes to points; a frame's points are spread over ``salts`` tasks."""
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.col(salt_on), F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
