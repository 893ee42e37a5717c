"""Queries on single points and on bins of points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pathclear.config import Box, DetectorConfig
from pathclear.functions import geometry as g
from pathclear.functions.ranks import linear_percentiles
from pathclear.operators import grids, points as ops
from pathclear.operators import inserted, synthetic
from pathclear.queries.registry import query
from pathclear.queries.views import FRAMES_SQL, POINTS_SQL, frames, points

FRAME = ["frame_seq"]
PLANE = (1 / 64, 1 / 128, -1.5)
ROUTE = (0.0, 1 / 256, 1 / 8192)
HEIGHT_SQL = "z - (x / 64 + y / 128 - 1.5e0)"
OFFSET_SQL = "y - (x / 256 + x * x / 8192)"
RANGE_SQL = "sqrt(x * x + y * y + z * z)"
PI_SQL = "3.141592653589793e0"


def az_sql(cell: str, x: str = "x", y: str = "y", count: int = 0) -> str:
    n = count or math.ceil(360 / float(cell))
    return (f"CAST(greatest(0, least({n - 1}, floor((atan2({y}, {x}) * 180.0e0 / {PI_SQL} + 180.0e0)"
            f" / {cell}e0))) AS INTEGER)")


def el_sql(cell: str, x: str = "x", y: str = "y", z: str = "z") -> str:
    n = math.ceil(180 / float(cell))
    return (f"CAST(greatest(0, least({n - 1}, floor((atan2({z}, sqrt({x} * {x} + {y} * {y})) * 180.0e0"
            f" / {PI_SQL} + 90.0e0) / {cell}e0))) AS INTEGER)")


def _height():
    return g.height(F.col("x"), F.col("y"), F.col("z"), PLANE)


def _offset():
    return g.route_offset(F.col("x"), F.col("y"), ROUTE)


PRE = DetectorConfig(
    blind_radius_m=8.0, geometry_roi=Box((-10, -20, -10), (90, 20, 15)),
    detection_roi=Box((0, -2, -1.5), (60, 2, 1.5)),
)
YAW_90 = (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


@query("q_preprocess_counts", f"""
WITH {POINTS_SQL}, raw AS (
  SELECT frame_seq, raw_index,
    CASE WHEN ring = 7 AND x <= 11 THEN 0 WHEN ring = 6 AND x <= 11 THEN 'NaN'::DOUBLE ELSE y END AS sx,
    CASE WHEN ring = 7 AND x <= 11 THEN 0 ELSE -x END AS sy,
    CASE WHEN ring = 7 AND x <= 11 THEN 0 ELSE z END AS sz
  FROM points
), fate AS (
  SELECT *, CASE WHEN isnan(sx) OR (sx = 0 AND sy = 0 AND sz = 0) THEN 0
    WHEN sqrt(sx * sx + sy * sy + sz * sz) < 8 THEN 1
    WHEN -sy BETWEEN -10 AND 90 AND sx BETWEEN -20 AND 20 AND sz BETWEEN -10 AND 15 THEN 3
    ELSE 2 END AS f
  FROM raw
)
SELECT frame_seq, count(*) FILTER (f = 0) AS invalid_point_count,
  count(*) FILTER (f = 1) AS blind_point_count, count(*) FILTER (f = 2) AS outside_roi_point_count,
  count(*) FILTER (f = 3) AS geometry_point_count,
  count(*) FILTER (f = 3 AND -sy BETWEEN 0 AND 60 AND sx BETWEEN -2 AND 2 AND sz BETWEEN -1.5 AND 1.5)
    AS detection_point_count,
  CAST(0 AS BIGINT) AS overflow_count
FROM fate GROUP BY frame_seq""")
def preprocess_counts(spark, sf_dir):
    """What becomes of every raw point, counted per frame."""
    pts = points(spark, sf_dir)
    empty = (F.col("ring") == 7) & (F.col("x") <= 11)
    broken = (F.col("ring") == 6) & (F.col("x") <= 11)
    sx, sy, sz = g.to_sensor(F.col("x"), F.col("y"), F.col("z"))
    raw = pts.select(
        "frame_seq", "raw_index",
        F.when(empty, 0.0).when(broken, float("nan")).otherwise(sx).alias("sx"),
        F.when(empty, 0.0).otherwise(sy).alias("sy"),
        F.when(empty, 0.0).otherwise(sz).alias("sz"),
    )
    return ops.count_fates(ops.classify(raw, PRE, YAW_90, (0.0, 0.0, 0.0)), FRAME)


@query("q_rigid_transform", f"""
WITH {POINTS_SQL}
SELECT frame_seq, raw_index, round(0.6e0 * x + -0.8e0 * y + 0.0e0 * z + 1.0e0, 9) AS tx,
  round(0.8e0 * x + 0.6e0 * y + 0.0e0 * z + 2.0e0, 9) AS ty,
  round(0.0e0 * x + 0.0e0 * y + 1.0e0 * z + 3.0e0, 9) AS tz,
  y AS sensor_x, -x AS sensor_y, z AS sensor_z
FROM points""")
def rigid_transform(spark, sf_dir):
    """Rigid transform and the axis swap of the forward profile."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    turned = g.rigid(x, y, z, (0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0), (1.0, 2.0, 3.0))
    sensor = g.to_sensor(x, y, z)
    return points(spark, sf_dir).select(
        "frame_seq", "raw_index",
        *[F.round(c, 9).alias(n) for c, n in zip(turned, ("tx", "ty", "tz"))],
        *[c.alias(n) for c, n in zip(sensor, ("sensor_x", "sensor_y", "sensor_z"))],
    )


@query("q_roi_flags", f"""
WITH {POINTS_SQL}
SELECT frame_seq, raw_index, CAST(x BETWEEN -10 AND 90 AND y BETWEEN -20 AND 20 AND z BETWEEN -10 AND 15 AS INTEGER) AS in_geometry,
  CAST(x BETWEEN 0 AND 60 AND y BETWEEN -2 AND 2 AND z BETWEEN -1.5 AND 1.5 AS INTEGER) AS in_detection
FROM points""")
def roi_flags(spark, sf_dir):
    """Inclusive geometry and detection zones."""
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select(
        "frame_seq", "raw_index",
        g.within(*xyz, PRE.geometry_roi).cast("int").alias("in_geometry"),
        g.within(*xyz, PRE.detection_roi).cast("int").alias("in_detection"),
    )


@query("q_admission_reason", f"""
WITH {FRAMES_SQL}
SELECT bag_id, event_id,
  CASE WHEN k > 95 THEN 'POINT_LIMIT_EXCEEDED' WHEN k = 0 THEN 'EMPTY_INPUT'
    WHEN reason = 'signup' THEN 'TF_UNAVAILABLE' WHEN k % 11 = 0 THEN 'INVALID_TRANSFORM'
    WHEN k = 50 THEN 'TRANSFORM_OVERFLOW' WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'CALIBRATION_UNVERIFIED'
    WHEN k % 7 = 0 THEN 'EMPTY_GEOMETRY_ROI' END AS stop_reason,
  CASE WHEN k > 95 OR k = 0 THEN 1 WHEN reason = 'signup' THEN 2
    WHEN k % 11 = 0 OR k = 50 OR (k % 3 <> 0 AND k % 5 = 0) OR k % 7 = 0 THEN 3 ELSE 0 END AS status,
  CASE WHEN k % 3 = 0 THEN 'VERIFIED' WHEN k % 5 <> 0 THEN 'ASSUMED' ELSE 'UNKNOWN' END AS trust,
  CASE WHEN k % 7 <= 4 THEN CAST(k % 7 AS INTEGER) ELSE 1 END AS wire_status,
  CASE WHEN k % 5 = 1 THEN 'ASSUMED' WHEN k % 5 = 2 THEN 'VERIFIED' ELSE 'UNKNOWN' END AS wire_trust,
  CASE WHEN k % 7 > 4 THEN 'INVALID_PROCESSING_STATUS' ELSE reason END AS wire_reason
FROM frames""")
def admission(spark, sf_dir):
    """Ordered admission chain, trust and fail-closed wire decoding."""
    from pathclear.functions import text

    k = F.col("k")
    mirrored = F.when(k % 11 == 0, -1.0).otherwise(1.0)
    rotation = F.array(mirrored, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    valid = g.valid_rotation(rotation, F.array(*[F.lit(0.0)] * 3))
    reason = ops.admission_reason(
        k, 95, F.col("reason") != "signup", valid, k == 50, k % 3 == 0, k % 5 != 0, k % 7
    )
    return frames(spark, sf_dir).select(
        "bag_id", "event_id", reason.alias("stop_reason"),
        ops.admission_status(reason).alias("status"),
        ops.calibration_trust(k % 3 == 0, k % 5 != 0).alias("trust"),
        text.decode_status((k % 7).cast("int")).alias("wire_status"),
        text.decode_trust((k % 5).cast("int")).alias("wire_trust"),
        text.wire_reason((k % 7).cast("int"), F.col("reason")).alias("wire_reason"),
    )


@query("q_height_offset", f"""
WITH {POINTS_SQL}
SELECT frame_seq, raw_index, {HEIGHT_SQL} AS height, {OFFSET_SQL} AS offset_m,
  CAST(x >= 2 AND x <= 90 AND abs(y) <= 2.5 AND z >= -3 AND z <= 0.5 AS INTEGER) AS in_floor_band,
  CAST(x >= 0 AND abs({OFFSET_SQL}) <= 2.5 AND {HEIGHT_SQL} BETWEEN -0.5 AND 3.5 AS INTEGER) AS in_history_band
FROM points""")
def height_offset(spark, sf_dir):
    """Height over the floor, offset from the route, band filters."""
    config = DetectorConfig()
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    history = (
        (x >= config.detection_roi.low[0]) & (F.abs(_offset()) <= config.band_half_width_m)
        & _height().between(-0.5, config.corridor_height_m)
    )
    return points(spark, sf_dir).select(
        "frame_seq", "raw_index", _height().alias("height"), _offset().alias("offset_m"),
        ops.in_floor_band(x, y, z, config, 90).cast("int").alias("in_floor_band"),
        history.cast("int").alias("in_history_band"),
    )


EVIDENCE = DetectorConfig(far_gauge_max_x_m=90.0, sensor_height_above_rail_m=1.0)
EVIDENCE_SQL = f"""
classed AS (
  SELECT *, {RANGE_SQL} AS range, {az_sql('0.25')} AS az, {el_sql('0.25')} AS el,
    {HEIGHT_SQL} AS h, abs({OFFSET_SQL}) AS off
  FROM points
), evidence AS (
  SELECT *,
    CASE WHEN x <= 60 AND off <= 2.5 AND h >= 0.6e0 AND h <= 3.5 THEN 1 ELSE 0 END
    | CASE WHEN x <= 80 AND (CASE WHEN x > 60 THEN off <= 0.7e0 AND h >= 0.6e0 AND h <= 2.5
                             ELSE off <= 0.9e0 AND h >= 0.6e0 AND h <= 2.5 END) THEN 2 ELSE 0 END AS channels
  FROM classed
)"""


def evidence_points(spark, sf_dir):
    """Points with range, angular cell, height, offset and their channel mask."""
    pts = points(spark, sf_dir)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    floor_below = g.height(F.lit(0.0), F.lit(0.0), F.lit(0.0), PLANE)
    band_min, gauge_min = ops.evidence_limits(EVIDENCE, floor_below)
    df = pts.withColumns({
        "range": g.norm(x, y, z),
        "az": g.azimuth_cell(x, y, EVIDENCE.angular_cell_deg),
        "el": g.elevation_cell(x, y, z, EVIDENCE.angular_cell_deg),
        "h": _height(), "off": F.abs(_offset()),
    })
    band, gauge = ops.evidence(
        x, F.col("off"), F.col("h"), EVIDENCE, F.lit(60.0), F.lit(True), F.lit(80.0), F.lit(80.0),
        band_min, gauge_min,
    )
    mask = F.when(band, ops.MOTION).otherwise(0).bitwiseOR(F.when(gauge, ops.GAUGE).otherwise(0))
    return df.withColumn("channels", mask)


@query("q_evidence_channels", f"""
WITH {POINTS_SQL}, {EVIDENCE_SQL}
SELECT frame_seq, az, el, min(range) AS range, count(*) AS points, bit_or(channels) AS channels
FROM evidence WHERE channels > 0 GROUP BY ALL""")
def evidence_channels(spark, sf_dir):
    """Evidence cells with their nearest range and channel union."""
    return (
        evidence_points(spark, sf_dir).filter(F.col("channels") > 0)
        .groupBy("frame_seq", "az", "el")
        .agg(F.min("range").alias("range"), F.count(F.lit(1)).alias("points"),
             F.bit_or("channels").alias("channels"))
    )


@query("q_depth_layer", f"""
WITH {POINTS_SQL}, {EVIDENCE_SQL}, nearest AS (
  SELECT frame_seq, az, el, min(range) AS near FROM classed GROUP BY ALL
)
SELECT frame_seq, count(*) AS points, count(*) FILTER (range <= near + 0.5) AS front_points,
  count(*) FILTER (range <= near + 5) AS gauge_depth_points,
  count(*) FILTER (range <= near + 0.5 AND off > 0.5 AND h < 1) AS structure_points
FROM classed JOIN nearest USING (frame_seq, az, el) GROUP BY frame_seq""")
def depth_layer(spark, sf_dir):
    """Returns close behind the nearest one of their cell."""
    pts = evidence_points(spark, sf_dir)
    cell = ["frame_seq", "az", "el"]
    nearest = pts.groupBy(*cell).agg(F.min("range").alias("near"))
    front = F.col("range") <= F.col("near") + 0.5
    structure = ops.structure_point(F.col("off"), F.col("h"), EVIDENCE)
    return ops.salted_join(pts, nearest, cell, "raw_index").groupBy("frame_seq").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(front).alias("front_points"),
        F.count_if(F.col("range") <= F.col("near") + 5).alias("gauge_depth_points"),
        F.count_if(front & structure).alias("structure_points"),
    )


BOXES_SQL = """
boxes AS (
  SELECT frame_seq, CAST(floor(x / 10) AS INTEGER) AS box, min(x) AS lo_x, max(x) AS hi_x,
    min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z
  FROM points WHERE z >= 1.5 AND abs(y) <= 0.5 GROUP BY ALL
)"""


def boxes(spark, sf_dir):
    """Boxes around the high central returns of every 10 m of a frame (at most eleven)."""
    high = points(spark, sf_dir).filter((F.col("z") >= 1.5) & (F.abs("y") <= 0.5))
    return high.groupBy("frame_seq", F.floor(F.col("x") / 10).cast("int").alias("box")).agg(
        *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    )


@query("q_point_labels", f"""
WITH {POINTS_SQL}, {BOXES_SQL}, labelled AS (
  SELECT frame_seq, CASE WHEN EXISTS (SELECT 1 FROM boxes b WHERE b.frame_seq = p.frame_seq
      AND abs(p.x - (lo_x + hi_x) / 2) <= (hi_x - lo_x) / 2 + 0.1e0
      AND abs(p.y - (lo_y + hi_y) / 2) <= (hi_y - lo_y) / 2 + 0.1e0
      AND abs(p.z - (lo_z + hi_z) / 2) <= (hi_z - lo_z) / 2 + 0.1e0) THEN 2
    WHEN x >= 0 AND x <= 60 AND abs({OFFSET_SQL}) <= 2 AND {HEIGHT_SQL} >= -0.3e0 AND {HEIGHT_SQL} <= 3.5 THEN 1
    ELSE 0 END AS label
  FROM points p
)
SELECT frame_seq, label, count(*) AS points FROM labelled GROUP BY ALL""")
def point_labels(spark, sf_dir):
    """Obstacle, corridor and background points."""
    candidates = boxes(spark, sf_dir).groupBy("frame_seq").agg(
        F.collect_list(F.struct(
            *[((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias(f"c{c}") for c in "xyz"],
            *[(F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias(f"s{c}") for c in "xyz"],
        )).alias("candidates")
    )
    joined = ops.salted_join(
        points(spark, sf_dir), candidates, FRAME, "raw_index", how="left"
    )
    label = ops.point_label(
        F.col("x"), F.col("y"), F.col("z"), _offset(), _height(), F.col("candidates"),
        F.lit(True), F.lit(60.0), DetectorConfig(),
    )
    return joined.groupBy("frame_seq", label.alias("label")).agg(F.count(F.lit(1)).alias("points"))


CONE_SQL = f"""
cone AS (
  SELECT frame_seq, count(*) AS total, count(*) FILTER (range > 3) AS valid,
    min(range) FILTER (range > 3) AS min_range, min(range) FILTER (range > 3 AND abs(turn) <= 1.5) AS min_range_front
  FROM (SELECT frame_seq, {RANGE_SQL} AS range,
    atan2(y, x) * 180.0e0 / {PI_SQL} - 0.5e0 AS turn FROM points) GROUP BY frame_seq
)"""


def front_cone_stats(spark, sf_dir):
    pts = points(spark, sf_dir).withColumns({
        "range": g.norm(F.col("x"), F.col("y"), F.col("z")),
        "turn": g.wrapped_offset_deg(g.azimuth_deg(F.col("x"), F.col("y")), 0.5),
    })
    valid = g.finite(F.col("range")) & (F.col("range") > 3)
    front = valid & (F.abs("turn") <= 1.5)
    return pts.groupBy("frame_seq").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"),
        F.min(F.when(valid, F.col("range"))).alias("min_range"),
        F.min(F.when(front, F.col("range"))).alias("min_range_front"),
    )


@query("q_front_cone", f"WITH {POINTS_SQL}, {CONE_SQL} SELECT * FROM cone")
def front_cone(spark, sf_dir):
    """Valid returns and nearest range, overall and in the front cone."""
    return front_cone_stats(spark, sf_dir)


@query("q_front_percentiles", f"""
WITH {POINTS_SQL}, {CONE_SQL}
SELECT count(min_range) AS n, round(quantile_cont(min_range, 0.01), 6) AS p1,
  round(quantile_cont(min_range, 0.5), 6) AS p50, round(quantile_cont(min_range, 0.99), 6) AS p99
FROM cone""")
def front_percentiles(spark, sf_dir):
    """Percentiles of the per-frame nearest range."""
    found = linear_percentiles(
        front_cone_stats(spark, sf_dir), [], "min_range", {"p1": 0.01, "p50": 0.5, "p99": 0.99},
        bounds=[5.0, 10.0, 20.0, 50.0],
    )
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("p1", "p50", "p99")])


@query("q_corridor_columns", f"""
WITH {POINTS_SQL}, grid AS (
  SELECT CAST(floor((180.0e0 - degrees(atan2(y, x))) / 0.5e0) AS BIGINT) AS col, count(*) AS points FROM points GROUP BY 1
), centred AS (SELECT *, -180.0e0 + (col + 0.5e0) * 0.5e0 AS center_deg FROM grid)
SELECT col, points, center_deg,
  CAST(abs((center_deg - 170.0e0 + 180.0e0) - 360.0e0 * floor((center_deg - 170.0e0 + 180.0e0) / 360.0e0) - 180.0e0) <= 20 AS INTEGER) AS in_sector
FROM centred""")
def corridor_columns(spark, sf_dir):
    """azimuth columns of all points, looked at backwards, and those in a sector across the seam."""
    backwards = F.floor((180.0 - F.degrees(F.atan2("y", "x"))) / 0.5)
    grid = points(spark, sf_dir).groupBy(backwards.cast("long").alias("col")).agg(F.count(F.lit(1)).alias("points"))
    center = -180.0 + (F.col("col") + 0.5) * 0.5
    turn = g.wrapped_offset_deg(center, 170.0)
    return grid.select(
        "col", "points", center.alias("center_deg"), (F.abs(turn) <= 20).cast("int").alias("in_sector")
    )


LOWEST_SQL = """
lowest AS (
  SELECT frame_seq, least(CAST(trunc(x - 2) AS INTEGER), 88) AS row, least(CAST(trunc((y + 2.5e0) / 0.2e0) AS INTEGER), 25) AS col,
    min({'z': z, 'raw_index': raw_index, 'x': x, 'y': y}) AS p
  FROM points WHERE x >= 2 AND x <= 90 AND abs(y) <= 2.5 AND z >= -3 AND z <= 0.5 GROUP BY ALL
)"""


@query("q_lowest_cell", f"""
WITH {POINTS_SQL}, {LOWEST_SQL}
SELECT frame_seq, row, col, row * 26 + col AS cell, p.raw_index AS raw_index, p.x AS x, p.y AS y, p.z AS z FROM lowest""")
def lowest_cell(spark, sf_dir):
    """G1: lowest return per floor cell, the first one on ties."""
    return grids.lowest_per_cell(points(spark, sf_dir), FRAME, DetectorConfig())


FLOOR = DetectorConfig(ground_min_bin_points=5, ground_max_gap_m=5.0)


@query("q_floor_support", f"""
WITH {POINTS_SQL}, bins AS (
  SELECT frame_seq, least(CAST(trunc((x - 2) / 5) AS INTEGER), 17) AS bin, count(*) AS hits, min(x) AS near_x, max(x) AS far_x
  FROM points WHERE x >= 2 AND x <= 90 AND abs(y) <= 2.5 AND z BETWEEN -3 AND 0.5 AND abs(z + 1.5) <= 0.15e0
  GROUP BY ALL
), kept AS (
  SELECT *, near_x - coalesce(lag(far_x) OVER w, 2) > 5 AS gap FROM bins WHERE hits >= 5 WINDOW w AS (PARTITION BY frame_seq ORDER BY bin)
), walked AS (
  SELECT *, bool_or(gap) OVER (PARTITION BY frame_seq ORDER BY bin) AS broken FROM kept
)
SELECT frame_seq, CAST(sum(hits) AS BIGINT) AS inliers, max(far_x) AS max_supported_x FROM walked WHERE NOT broken GROUP BY frame_seq""")
def floor_support(spark, sf_dir):
    """Floor returns per 5 m bin and the reach before the first long gap."""
    bins = grids.floor_bins(points(spark, sf_dir), FRAME, F.col("z") + 1.5, FLOOR)
    return grids.floor_reach(bins, FRAME, FLOOR)


@query("q_plane_lsq", f"""
WITH {POINTS_SQL}, s AS (
  SELECT frame_seq, sum(x*x) sxx, sum(x*y) sxy, sum(x) sx, sum(y*y) syy, sum(y) sy, count(*) n,
    sum(x*z) sxz, sum(y*z) syz, sum(z) sz FROM points GROUP BY frame_seq
), d AS (
  SELECT *, sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx) AS det FROM s
)
SELECT frame_seq, n,
  CASE WHEN abs(det) >= 1e-9 THEN round((sxz * (syy * n - sy * sy) - sxy * (syz * n - sy * sz) + sx * (syz * sy - syy * sz)) / det, 6) END AS a,
  CASE WHEN abs(det) >= 1e-9 THEN round((sxx * (syz * n - sy * sz) - sxz * (sxy * n - sy * sx) + sx * (sxy * sz - syz * sx)) / det, 6) END AS b,
  CASE WHEN abs(det) >= 1e-9 THEN round((sxx * (syy * sz - syz * sy) - sxy * (sxy * sz - syz * sx) + sxz * (sxy * sy - syy * sx)) / det, 6) END AS c
FROM d""")
def plane_lsq(spark, sf_dir):
    """K3: least-squares plane per frame from nine sums."""
    return grids.least_squares_plane(points(spark, sf_dir), FRAME).select(
        "frame_seq", "n", *[F.round(c, 6).alias(c) for c in "abc"]
    )


WALL_SQL = """
walls AS (
  SELECT frame_seq, CAST(trunc(x - 3) AS INTEGER) AS slice, min(y) FILTER (y BETWEEN 1 AND 6) AS left_y,
    max(y) FILTER (y BETWEEN -6 AND -1) AS right_y
  FROM points WHERE x >= 3 AND x < 60 AND z + 1.5 BETWEEN 0.5 AND 2.5 GROUP BY ALL
)"""


def _walls(spark, sf_dir):
    return grids.wall_samples(
        points(spark, sf_dir), FRAME, F.col("z") + 1.5, F.lit(0.0), 60.0
    )


@query("q_wall_samples", f"WITH {POINTS_SQL}, {WALL_SQL} SELECT * FROM walls")
def wall_samples(spark, sf_dir):
    """Nearest wall return per side and 1 m slice."""
    return _walls(spark, sf_dir)


@query("q_route_fit", f"""
WITH {POINTS_SQL}, {WALL_SQL}, near AS (
  SELECT frame_seq,
    CASE WHEN count(left_y) >= 3 THEN list_sort(list(left_y) FILTER (left_y IS NOT NULL))[count(left_y) // 2 + 1] END AS left0,
    CASE WHEN count(right_y) >= 3 THEN list_sort(list(right_y) FILTER (right_y IS NOT NULL))[count(right_y) // 2 + 1] END AS right0
  FROM walls WHERE slice < 5 GROUP BY frame_seq
), shifts AS (
  SELECT frame_seq, 3.5 + slice AS x, (coalesce(left_y - left0, 0) + coalesce(right_y - right0, 0))
    / nullif(CAST(left_y - left0 IS NOT NULL AS INTEGER) + CAST(right_y - right0 IS NOT NULL AS INTEGER), 0) AS shift
  FROM walls JOIN near USING (frame_seq)
), sums AS (
  SELECT frame_seq, count(*) AS slices, sum(CAST(x AS DOUBLE) * x) s2, sum(CAST(x AS DOUBLE) * x * x) s3, sum(CAST(x AS DOUBLE) * x * x * x) s4,
    sum(CAST(x AS DOUBLE) * shift) sy1, sum(CAST(x AS DOUBLE) * x * shift) sy2
  FROM shifts WHERE shift IS NOT NULL GROUP BY frame_seq
)
SELECT frame_seq, slices, round((sy1 * s4 - sy2 * s3) / (s2 * s4 - s3 * s3), 6) AS c1,
  round((s2 * sy2 - s3 * sy1) / (s2 * s4 - s3 * s3), 6) AS c2
FROM sums WHERE slices >= 3 AND abs(s2 * s4 - s3 * s3) >= 1e-9""")
def route_fit(spark, sf_dir):
    """K4 Q-F: centre shifts against the near walls and the fit without intercept."""
    from pathclear.operators.route import fit_without_intercept, wall_shifts

    shifts = wall_shifts(_walls(spark, sf_dir), FRAME)
    return fit_without_intercept(shifts, FRAME).select(
        "frame_seq", "slices", F.round("c1", 6).alias("c1"), F.round("c2", 6).alias("c2")
    )


SAMPLES_SQL = """
samples AS (
  SELECT frame_seq, CASE WHEN y > 0 THEN 0 ELSE 1 END * 27 + least(CAST(trunc((z + 1 - 0.3e0) / 0.1e0) AS INTEGER), 26) AS section,
    CASE WHEN y > 0 THEN 0 ELSE 1 END * 3 + CASE WHEN z + 1 < 1 THEN 0 WHEN z + 1 < 2 THEN 1 ELSE 2 END AS row,
    least(CAST(trunc((x - 3) / 0.05e0) AS INTEGER), 639) AS bin, abs(y) AS side_m
  FROM points WHERE x >= 3 AND x < 35 AND abs(y) BETWEEN 1 AND 4 AND z + 1 >= 0.3 AND z + 1 < 3
), medians AS (
  SELECT frame_seq, section, list_sort(list(side_m))[count(*) // 2 + 1] AS median, count(*) AS n FROM samples GROUP BY ALL
)"""


@query("q_section_median", f"WITH {POINTS_SQL}, {SAMPLES_SQL} SELECT * FROM medians")
def section_median(spark, sf_dir):
    """G6 Q-B: upper median of the lateral distance per side and height level."""
    samples = grids.profile_points(points(spark, sf_dir), F.col("z") + 1)
    found = grids.section_medians(samples, FRAME)
    return found.withColumn("median", F.col("median").cast("double"))


@query("q_lateral_profile", f"""
WITH {POINTS_SQL}, {SAMPLES_SQL}
SELECT frame_seq, row, bin, min(side_m - median) AS value FROM samples JOIN medians USING (frame_seq, section) GROUP BY ALL""")
def lateral_profile(spark, sf_dir):
    """Least departure from the mean cross-section per row and 5 cm bin."""
    samples = grids.profile_points(points(spark, sf_dir), F.col("z") + 1)
    medians = grids.section_medians(samples, FRAME)
    profile = grids.lateral_profile(samples, medians, FRAME)
    return profile.withColumn("value", F.col("value").cast("double"))


@query("q_rail_medians", f"""
WITH {POINTS_SQL}, railed AS (
  SELECT frame_seq, CAST(trunc((x - 4) / 2) AS INTEGER) AS slice, CASE WHEN y > 0 THEN 'left' ELSE 'right' END AS side, y
  FROM points WHERE x >= 4 AND x < 30 AND abs(z + 1) <= 0.07e0 AND abs(y) BETWEEN 0.45e0 AND 1.15e0
), m AS (
  SELECT frame_seq, slice, side, count(*) AS n, list_sort(list(y))[count(*) // 2 + 1] AS median FROM railed GROUP BY ALL
), sided AS (
  SELECT frame_seq, slice, max(median) FILTER (side = 'left' AND n >= 3) AS l, max(median) FILTER (side = 'right' AND n >= 3) AS r
  FROM m GROUP BY ALL
)
SELECT frame_seq, slice, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (l + r) / 2 WHEN l IS NOT NULL THEN round(l - 0.797e0, 9) ELSE round(r + 0.797e0, 9) END AS shift,
  CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1.0e0 ELSE 0.5e0 END AS weight
FROM sided WHERE (l IS NOT NULL OR r IS NOT NULL) AND NOT (l IS NOT NULL AND r IS NOT NULL AND abs(l - r - 1.594e0) > 0.1e0)""")
def rail_medians(spark, sf_dir):
    """Median rail per 2 m slice and side, paired at the track gauge."""
    from pathclear.operators.route import rail_shifts

    on_rail = points(spark, sf_dir).withColumns({"offset": F.col("y"), "h": F.col("z")})
    return rail_shifts(on_rail, FRAME, F.lit(-1.0)).select(
        "frame_seq", "slice", F.round("shift", 9).alias("shift"), "weight"
    )


@query("q_range_image", f"""
WITH {POINTS_SQL}, nearest AS (
  SELECT frame_seq, {az_sql('0.25')} AS az, {el_sql('0.25')} AS el,
    min({{'range': {RANGE_SQL}, 'raw_index': raw_index}}) AS p FROM points GROUP BY ALL
)
SELECT frame_seq, az, el, az * 4096 + el AS cell, p.range AS range, p.raw_index AS raw_index FROM nearest""")
def range_image(spark, sf_dir):
    """Nearest return per angular cell."""
    image = grids.range_image(points(spark, sf_dir), FRAME, 0.25)
    return image.select(
        "frame_seq", "az", "el", (F.col("az") * g.CELL_STRIDE + F.col("el")).alias("cell"),
        "range", "raw_index",
    )


ELEVATION_SQL = f"atan2(z, sqrt(x * x + y * y)) * 180.0e0 / {PI_SQL}"
CHANNELS_SQL = f"""
steps AS (
  SELECT frame_seq, round({ELEVATION_SQL}, 3) AS value, count(*) AS hits FROM points GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN value - lag(value) OVER w <= 0.02e0 THEN 0 ELSE 1 END AS new FROM steps WINDOW w AS (PARTITION BY frame_seq ORDER BY value)
), grouped AS (
  SELECT *, sum(new) OVER (PARTITION BY frame_seq ORDER BY value) AS grp FROM marked
), summed AS (
  SELECT frame_seq, grp, CAST(sum(hits) AS BIGINT) AS hits, sum(value * hits) / sum(hits) AS elevation FROM grouped GROUP BY ALL
), channels AS (
  SELECT frame_seq, hits, elevation FROM summed QUALIFY hits >= 0.1e0 * max(hits) OVER (PARTITION BY frame_seq)
)"""


def _elevation():
    return g.elevation_deg(F.col("x"), F.col("y"), F.col("z"))


@query("q_channel_groups", f"""
WITH {POINTS_SQL}, {CHANNELS_SQL} SELECT frame_seq, hits, round(elevation, 6) AS elevation FROM channels""")
def channel_groups(spark, sf_dir):
    """Sharp elevation values that make up the lidar channels."""
    found = grids.elevation_channels(points(spark, sf_dir), FRAME, _elevation())
    return found.select("frame_seq", "hits", F.round("elevation", 6).alias("elevation"))


@query("q_ring_order", f"""
WITH {POINTS_SQL}, known AS (
  SELECT frame_seq, CAST(p.ring AS INTEGER) AS ring, median({ELEVATION_SQL}) AS el FROM points p GROUP BY ALL
), rings AS (
  SELECT frame_seq, unnest(range(0, top + 1)) AS ring FROM (SELECT frame_seq, max(ring) AS top FROM known GROUP BY frame_seq)
), filled AS (
  SELECT frame_seq, r.ring, el,
    last_value(CASE WHEN el IS NOT NULL THEN r.ring END IGNORE NULLS) OVER b AS r0, last_value(el IGNORE NULLS) OVER b AS e0,
    first_value(CASE WHEN el IS NOT NULL THEN r.ring END IGNORE NULLS) OVER a AS r1, first_value(el IGNORE NULLS) OVER a AS e1
  FROM rings r LEFT JOIN known k USING (frame_seq, ring)
  WINDOW b AS (PARTITION BY frame_seq ORDER BY r.ring ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY frame_seq ORDER BY r.ring ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), done AS (
  SELECT frame_seq, CAST(ring AS INTEGER) AS ring, coalesce(el, CASE WHEN e0 IS NULL THEN e1 WHEN e1 IS NULL THEN e0 ELSE e0 + (e1 - e0) * (ring - r0) / (r1 - r0) END) AS el FROM filled
)
SELECT frame_seq, ring, round(el, 6) AS elevation, row_number() OVER (PARTITION BY frame_seq ORDER BY el, ring) - 1 AS image_row FROM done""")
def ring_order(spark, sf_dir):
    """Rings in order of their median elevation; empty rings interpolated."""
    seen = points(spark, sf_dir).withColumns({"ring": F.col("ring").cast("int"), "elevation": _elevation()})
    rows = inserted.ring_rows(seen, FRAME)
    return rows.select(
        "frame_seq", "ring", F.round("elevation", 6).alias("elevation"),
        F.col("image_row").cast("long").alias("image_row"),
    )


@query("q_ring_recovery", f"""
WITH {POINTS_SQL}, {CHANNELS_SQL}, numbered AS (
  SELECT frame_seq, tan(elevation * {PI_SQL} / 180.0e0) AS slope, row_number() OVER (PARTITION BY frame_seq ORDER BY elevation) - 1 AS i,
    count(*) OVER (PARTITION BY frame_seq) AS n FROM channels
), sloped AS (
  SELECT frame_seq, raw_index, z / greatest(sqrt(x * x + y * y), 1e-6) AS s FROM points WHERE {RANGE_SQL} >= 0.3e0
), lists AS (
  SELECT frame_seq, list(slope ORDER BY i) AS cs, max(n) AS n FROM numbered GROUP BY frame_seq
), placed AS (
  SELECT frame_seq, raw_index, s, cs, n, least(greatest(len(list_filter(cs, lambda c: c < s)), 1), n - 1) AS up FROM sloped JOIN lists USING (frame_seq) WHERE n > 1
), measured AS (
  SELECT *, (s - cs[up]) * 57.29577951308232e0 / (1 + s * s) AS above, (cs[up + 1] - s) * 57.29577951308232e0 / (1 + s * s) AS below FROM placed
), both_rings AS (
  SELECT frame_seq, raw_index, n - 1 - (CASE WHEN above <= below THEN up - 1 ELSE up END) AS ring FROM measured
  UNION ALL
  SELECT frame_seq, raw_index, n - 1 - (CASE WHEN above <= below THEN up ELSE up - 1 END) AS ring FROM measured WHERE least(above, below) > 0.02e0
)
SELECT frame_seq, CAST(ring AS INTEGER) AS ring, count(*) AS points FROM both_rings GROUP BY ALL""")
def ring_recovery(spark, sf_dir):
    """Rings from elevation; a return between two channels is given to both."""
    pts = points(spark, sf_dir)
    channels = grids.elevation_channels(pts, FRAME, _elevation())
    rings = inserted.recover_rings(pts, channels, FRAME, 0.3)
    return rings.groupBy("frame_seq", "ring").agg(F.count(F.lit(1)).alias("points"))


PIXELS_SQL = f"""
pixels AS (
  SELECT frame_seq, CAST(trunc((ring - lo) * 7 / (hi - lo)) AS INTEGER) AS px_row,
    CAST(trunc((azimuth + 45.0e0) * 255 / 90.0e0) AS INTEGER) AS px_col,
    min({{'near': CAST(trunc(range * 1e4) AS BIGINT), 'raw_index': raw_index, 'range': range, 'flag': flag}}) AS p
  FROM (SELECT *, {RANGE_SQL} AS range, atan2(y, x) * 180.0e0 / {PI_SQL} AS azimuth,
    min(ring) OVER f AS lo, max(ring) OVER f AS hi FROM points WINDOW f AS (PARTITION BY frame_seq))
  WHERE range BETWEEN 3 AND 80 AND azimuth BETWEEN -45 AND 45 GROUP BY ALL
)"""


def _pixels(spark, sf_dir):
    return grids.depth_pixels(
        points(spark, sf_dir), FRAME, "ring", 256, 8, (3.0, 80.0), (-45.0, 45.0), keep=("flag",)
    )


@query("q_depth_pixels", f"""
WITH {POINTS_SQL}, {PIXELS_SQL}
SELECT frame_seq, px_row, px_col, p.raw_index AS raw_index, p.range AS depth, p.flag AS flag FROM pixels""")
def depth_pixels(spark, sf_dir):
    """Nearest point per pixel with its label."""
    return _pixels(spark, sf_dir)


@query("q_depth_equalize", f"""
WITH {POINTS_SQL}, {PIXELS_SQL}, share AS (
  SELECT DISTINCT frame_seq, p.range AS depth, cume_dist() OVER (PARTITION BY frame_seq ORDER BY p.range) AS s,
    count(*) OVER (PARTITION BY frame_seq, p.range) AS pixels FROM pixels
)
SELECT frame_seq, depth, pixels, round(s, 9) AS share, CAST(floor(60 + 195 * (1.0e0 - s)) AS INTEGER) AS grey,
  CAST(floor(CASE WHEN s <= 0.25 THEN 0 WHEN s <= 0.5 THEN 255 * (s - 0.25) / 0.25e0 WHEN s <= 0.75 THEN 255 ELSE 255 + -205 * (s - 0.75) / 0.25e0 END) AS INTEGER) AS red,
  CAST(floor(CASE WHEN s <= 0.25 THEN 255 * s / 0.25e0 WHEN s <= 0.5 THEN 255 WHEN s <= 0.75 THEN 255 + -255 * (s - 0.5) / 0.25e0 ELSE 0 END) AS INTEGER) AS green,
  CAST(floor(CASE WHEN s <= 0.25 THEN 255 WHEN s <= 0.5 THEN 255 + -255 * (s - 0.25) / 0.25e0 ELSE 0 END) AS INTEGER) AS blue
FROM share""")
def depth_equalize(spark, sf_dir):
    """Histogram-equalised depth and its palette colours."""
    shares = grids.equalized(_pixels(spark, sf_dir), FRAME, "depth", [float(v) for v in range(10, 80, 10)])
    s = F.col("share")
    return shares.select(
        "frame_seq", "depth", "pixels", F.round(s, 9).alias("share"),
        grids.grey_level(s).alias("grey"), grids.jet_channel(s, grids.JET_RED).alias("red"),
        grids.jet_channel(s, grids.JET_GREEN).alias("green"),
        grids.jet_channel(s, grids.JET_BLUE).alias("blue"),
    )


@query("q_labelled_cloud", f"""
WITH {POINTS_SQL}, shaded AS (
  SELECT frame_seq, raw_index, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z,
    1.0e0 - least(1.0e0, {RANGE_SQL} / 100.0e0) AS shade, CASE flag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS label FROM points
)
SELECT frame_seq, raw_index, x, y, z, label, CASE label WHEN 2 THEN 255 * 65536 + 40 * 256 + 40
  WHEN 1 THEN 20 * 65536 + CAST(floor(110 + 145 * shade) AS INTEGER) * 256 + 50
  ELSE CAST(floor(45 + 150 * shade) AS INTEGER) * 65793 END AS rgb FROM shaded""")
def labelled_cloud(spark, sf_dir):
    """Packed colour and label of every point."""
    label = F.when(F.col("flag") == "A", 2).when(F.col("flag") == "R", 1).otherwise(0)
    range_m = g.norm(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select(
        "frame_seq", "raw_index", *[F.col(c).cast("float").alias(c) for c in "xyz"],
        label.alias("label"), grids.labelled_rgb(range_m, label).alias("rgb"),
    )


@query("q_inserted_block", f"""
WITH {POINTS_SQL}, {CHANNELS_SQL}, ends AS (
  SELECT frame_seq, max(raw_index) FILTER (flag <> 'A') AS last_other FROM points GROUP BY frame_seq
), nearest AS (
  SELECT p.frame_seq, raw_index, min(abs(atan2(p.z, sqrt(p.x * p.x + p.y * p.y)) * 180.0e0 / {PI_SQL} - elevation)) AS gap
  FROM points p JOIN channels USING (frame_seq) GROUP BY ALL
)
SELECT frame_seq, count(*) AS points, count(*) FILTER (raw_index > coalesce(last_other, -1)) AS block,
  count(*) FILTER (raw_index > coalesce(last_other, -1) AND gap > 0.02e0) AS block_off_channel,
  count(*) FILTER (raw_index <= coalesce(last_other, -1) AND gap > 0.02e0) AS recorded_off_channel
FROM nearest JOIN ends USING (frame_seq) GROUP BY frame_seq""")
def inserted_block(spark, sf_dir):
    """Trailing inserted block of a cloud and returns off every channel."""
    pts = points(spark, sf_dir).withColumn(
        "intensity", F.when(F.col("flag") == "A", 1.0).otherwise(F.col("intensity"))
    )
    channels = grids.elevation_channels(pts, FRAME, _elevation())
    return inserted.block_report(
        pts.withColumn("elevation", _elevation()), channels, FRAME
    )


@query("q_gap_clusters", f"""
WITH {POINTS_SQL}, a AS (
  SELECT *, CASE WHEN x - lag(x) OVER w <= 0.3e0 THEN 0 ELSE 1 END AS new FROM points WINDOW w AS (PARTITION BY frame_seq ORDER BY x, raw_index)
), b AS (
  SELECT *, sum(new) OVER (PARTITION BY frame_seq ORDER BY x, raw_index) AS gx FROM a
), c AS (
  SELECT *, CASE WHEN y - lag(y) OVER w <= 0.4e0 THEN 0 ELSE 1 END AS newy FROM b WINDOW w AS (PARTITION BY frame_seq, gx ORDER BY y, raw_index)
), d AS (
  SELECT *, sum(newy) OVER (PARTITION BY frame_seq, gx ORDER BY y, raw_index) AS gy FROM c
)
SELECT frame_seq, count(*) AS n, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z
FROM d GROUP BY frame_seq, gx, gy""")
def gap_clusters(spark, sf_dir):
    """Clusters cut at gaps along x, then across y."""
    return inserted.gap_clusters(points(spark, sf_dir), FRAME, 0.3, 0.4).drop("gx", "gy")


@query("q_ray_box", f"""
WITH {POINTS_SQL}, rays AS (
  SELECT frame_seq, raw_index, x, y, z, {RANGE_SQL} AS range FROM points
), slabs AS (
  SELECT *,
    range * greatest(least(30 / x, 31 / x), CASE WHEN y = 0 THEN '-inf'::DOUBLE ELSE least(-0.5 / y, 0.5 / y) END, CASE WHEN z = 0 THEN '-inf'::DOUBLE ELSE least(-1 / z, 0.75 / z) END) AS enter,
    range * least(greatest(30 / x, 31 / x), CASE WHEN y = 0 THEN 'inf'::DOUBLE ELSE greatest(-0.5 / y, 0.5 / y) END, CASE WHEN z = 0 THEN 'inf'::DOUBLE ELSE greatest(-1 / z, 0.75 / z) END) AS leave
  FROM rays
)
SELECT frame_seq, raw_index, round(enter, 6) AS entry, round(x * enter / range, 6) AS moved_x, round(y * enter / range, 6) AS moved_y, round(z * enter / range, 6) AS moved_z
FROM slabs WHERE enter <= leave AND enter > 0 AND enter < range - 1e-6""")
def ray_box(spark, sf_dir):
    """Returns hidden behind an inserted box move onto its surface."""
    moved = synthetic.occlude(points(spark, sf_dir), (30.0, -0.5, -1.0), (31.0, 0.5, 0.75))
    return moved.filter("hidden").select(
        "frame_seq", "raw_index", F.round("entry", 6).alias("entry"),
        *[F.round(f"moved_{c}", 6).alias(f"moved_{c}") for c in "xyz"],
    )


@query("q_median_rays", f"""
WITH {POINTS_SQL}
SELECT frame_seq, 'row' AS axis, ring AS line, round(median(asin(z / {RANGE_SQL})), 6) AS angle FROM points GROUP BY ALL
UNION ALL
SELECT frame_seq, 'column', CAST(trunc(y * 2) AS INTEGER), round(median(atan2(y, x)), 6) FROM points GROUP BY ALL""")
def median_rays(spark, sf_dir):
    """Median elevation per row and azimuth per column of an organised cloud."""
    column = grids.trunc(F.col("y") * 2)
    rays = synthetic.median_rays(
        points(spark, sf_dir).withColumnsRenamed({"ring": "row"}).withColumn("column", column), FRAME
    )
    return rays.withColumn("angle", F.round("angle", 6))


@query("q_synth_floor", f"""
WITH {POINTS_SQL}, slices AS (
  SELECT frame_seq, 3 + 2 * CAST(floor((x - 3) / 2) AS INTEGER) + 1.0e0 AS x, quantile_cont(z, 0.1) AS z
  FROM points WHERE abs(y) < 1.2 AND x >= 3 AND x < 60 GROUP BY ALL HAVING count(*) >= 5
), f1 AS (SELECT frame_seq, regr_slope(z, x) AS b, regr_intercept(z, x) AS a FROM slices GROUP BY frame_seq HAVING count(*) >= 5),
k1 AS (SELECT s.* FROM slices s JOIN f1 USING (frame_seq) WHERE abs(z - (a + b * x)) <= 0.2e0),
f2 AS (SELECT frame_seq, regr_slope(z, x) AS b, regr_intercept(z, x) AS a FROM k1 GROUP BY frame_seq HAVING count(*) >= 5),
k2 AS (SELECT s.* FROM slices s JOIN f2 USING (frame_seq) WHERE abs(z - (a + b * x)) <= 0.2e0),
f3 AS (SELECT frame_seq, regr_slope(z, x) AS b, regr_intercept(z, x) AS a FROM k2 GROUP BY frame_seq HAVING count(*) >= 5)
SELECT frame_seq, round(b, 6) AS slope, round(a, 6) AS intercept FROM f3
WHERE (SELECT count(*) FROM slices s WHERE s.frame_seq = f3.frame_seq AND abs(s.z - (f3.a + f3.b * s.x)) <= 0.2e0) >= 5""")
def synth_floor(spark, sf_dir):
    """Floor line from low percentiles per 2 m slice, refitted without outliers."""
    line = synthetic.estimate_floor(points(spark, sf_dir), FRAME, min_returns=5)
    return line.select(
        "frame_seq", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept")
    )
