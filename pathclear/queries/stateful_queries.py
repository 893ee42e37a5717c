"""Queries through the ordered folds and the whole detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathclear.config import DetectorConfig, TemporalConfig
from pathclear.operators.tracking import decide, gate_frames
from pathclear.plans.detector import analyse_points
from pathclear.queries.registry import query
from pathclear.queries.views import FRAMES_SQL, frames
from pathclear.schemas import CANDIDATE


def analyses(spark, sf_dir):
    """Analysed frames made from the event rows of a recording."""
    k, d = F.col("k"), F.col("distance_m")

    def candidate(number, x, y, channels):
        return F.struct(
            F.lit(number).alias("id"), x.alias("distance_m"), (k % 13 != 0).alias("distance_valid"),
            (k * 3).alias("support_points"), F.array(x, y, F.lit(0.0)).alias("center"),
            F.array(*[F.lit(v) for v in (0.5, 0.5, 1.7)]).alias("size"),
            F.array(x, y, F.lit(0.0)).alias("nearest"), channels.cast("int").alias("channels"),
            (k % 9 == 0).alias("edge"), (k / 100.0).alias("closest_offset_m"),
        )

    found = F.when(F.col("state") == "OBSTACLE", F.array(
        candidate(1, d, (k - 50) / 100.0, k % 3 + 1), candidate(2, d + 20, (50 - k) / 100.0, k % 2 + 1)
    )).otherwise(F.array()).cast(f"array<{CANDIDATE}>")
    return frames(spark, sf_dir).select(
        F.concat(F.lit("bag "), F.col("bag_id").cast("string")).alias("source"),
        F.lit(1).cast("long").alias("session"), F.col("event_id").alias("frame_sequence"),
        F.col("stamp_us") * 1000,
        F.when(F.col("reason") == "signup", 3).otherwise(0).alias("status"), "reason",
        F.when(k % 2 == 0, "ASSUMED").otherwise("VERIFIED").alias("calibration_trust"),
        (k % 10 != 0).alias("evaluation_region_valid"), (d + 30).alias("evaluated_range_m"),
        (k % 7 != 0).alias("ego_motion_valid"), (k / 10.0).alias("ego_speed_mps"),
        found.alias("candidates"),
    ).toDF(
        "source", "session", "frame_sequence", "measurement_time_ns", "status", "reason",
        "calibration_trust", "evaluation_region_valid", "evaluated_range_m", "ego_motion_valid",
        "ego_speed_mps", "candidates",
    )


HOURLY = TemporalConfig(
    confirm_hits=2, confirm_window=3, gauge_confirm_hits=2, gauge_confirm_window=3, release_misses=2,
    gate_base_m=20.0, max_gap_s=7200.0, object_max_speed_mps=0.01, unknown_ego_speed_mps=0.01,
    edge_retracts=True, assumed_clear=True, assumed_clear_min_range_m=40.0,
)


@query("q_track_decision")
def track_decision(spark, sf_dir):
    """ST8 to ST11, J10, O2 to O4: tracks and the decision per frame."""
    found = decide(analyses(spark, sf_dir), HOURLY)
    return found.select(
        "source", "frame_sequence", "state", "reason", "distance_m", F.size("tracks").alias("tracks"),
        F.size(F.filter("tracks", lambda t: t["confirmed"])).alias("confirmed"),
    )


GATE_SQL = f"""
WITH RECURSIVE {FRAMES_SQL}, arriving AS (
  SELECT bag_id % 4 AS line, event_id AS received, 'source ' || CAST(bag_id AS VARCHAR) AS source,
    stamp_us // 86400000000 AS session, event_id - CASE WHEN k > 95 THEN 40 ELSE 0 END AS sequence,
    CASE WHEN k <> 3 THEN stamp_us * 1000 END AS stamp_ns,
    row_number() OVER (PARTITION BY bag_id % 4 ORDER BY event_id) AS n
  FROM frames
), gate AS (
  SELECT DISTINCT line, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS gate_reason, CAST(NULL AS VARCHAR) AS a_source,
    CAST(NULL AS BIGINT) AS a_session, CAST(NULL AS BIGINT) AS a_sequence, CAST(NULL AS BIGINT) AS a_stamp, CAST([] AS VARCHAR[]) AS retired
  FROM arriving
  UNION ALL
  SELECT line, n, r, CASE WHEN ok THEN source ELSE a_source END, CASE WHEN ok THEN session ELSE a_session END,
    CASE WHEN ok THEN sequence ELSE a_sequence END, CASE WHEN ok THEN stamp_ns ELSE a_stamp END,
    CASE WHEN r = 'NEW_SOURCE' THEN list_append(retired, a_source) ELSE retired END
  FROM (
    SELECT *, r IN ('FIRST_SOURCE', 'NEW_SOURCE', 'NEW_SESSION', 'IN_ORDER') AS ok FROM (
      SELECT a.*, g.a_source, g.a_session, g.a_sequence, g.a_stamp, g.retired,
        CASE WHEN coalesce(a.source, '') = '' THEN 'INVALID_SOURCE_ID' WHEN a.stamp_ns IS NULL THEN 'INVALID_STAMP'
          WHEN coalesce(a.sequence, 0) = 0 THEN 'INVALID_SEQUENCE' WHEN list_contains(g.retired, a.source) THEN 'RETIRED_SOURCE'
          WHEN g.a_source IS NULL THEN 'FIRST_SOURCE' WHEN a.source <> g.a_source THEN 'NEW_SOURCE'
          WHEN a.session < g.a_session THEN 'OLD_SESSION' WHEN a.session > g.a_session THEN 'NEW_SESSION'
          WHEN a.sequence <= g.a_sequence THEN 'DUPLICATE_OR_LATE_SEQUENCE'
          WHEN a.stamp_ns < g.a_stamp THEN 'STAMP_WENT_BACKWARDS' ELSE 'IN_ORDER' END AS r
      FROM gate g JOIN arriving a ON a.line = g.line AND a.n = g.n + 1)
  )
)
SELECT a.line, received, source, session, sequence, stamp_ns,
  gate_reason IN ('FIRST_SOURCE', 'NEW_SOURCE', 'NEW_SESSION', 'IN_ORDER') AS accepted,
  gate_reason IN ('FIRST_SOURCE', 'NEW_SOURCE', 'NEW_SESSION') AS reset, gate_reason
FROM arriving a JOIN gate g ON g.line = a.line AND g.n = a.n"""


@query("q_order_gate", GATE_SQL)
def order_gate(spark, sf_dir):
    """ST12: verdict of the order gate per arriving frame of every line."""
    arriving = frames(spark, sf_dir).select(
        (F.col("bag_id") % 4).alias("line"), F.col("event_id").alias("received"),
        F.concat(F.lit("source "), (F.col("bag_id").cast("string"))).alias("source"),
        F.expr("stamp_us div 86400000000").alias("session"),
        (F.col("event_id") - F.when(F.col("k") > 95, 40).otherwise(0)).alias("sequence"),
        F.when(F.col("k") != 3, F.col("stamp_us") * 1000).alias("stamp_ns"),
    )
    return gate_frames(arriving)


def tunnel_points(spark, sf_dir):
    """Tunnel scenes made of the order lines: 400 orders are a frame, a line is a return.

    Lines 1 to 4 are floor, 5 and 6 walls, and the rest stands on the track as a box in one frame of three, else at
    the walls. One frame of seven has floor only up close, so that the last floor is held over it. Every
    coordinate comes from the line's quantity, part, supplier and price.
    """
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    seq = F.expr("l_orderkey div 400")
    blind, boxed = seq % 7 == 5, seq % 3 == 1
    mixed = F.expr("pmod(l_partkey * 31 + l_suppkey * 17 + l_orderkey, 64)") / 64.0
    near = F.when(blind, F.col("l_quantity") * 0.25).otherwise(F.col("l_quantity"))
    side = F.when(F.col("l_suppkey") % 2 == 0, 1.0).otherwise(-1.0)
    at = 16.0 + seq % 5
    wall = (line > 4) & ~((line > 6) & boxed)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        seq.alias("frame_seq"), F.xxhash64("l_orderkey", line, part, "l_extendedprice").alias("raw_index"),
        F.when(line <= 4, 2.5 + near + mixed).when(wall, 3.0 + F.col("l_quantity") * 0.9 + mixed)
        .otherwise(at + part % 3 * 0.125).alias("x"),
        F.when(line <= 4, F.expr("pmod(l_partkey, 37) - 18") / 10.0)
        .when(wall, side * 2.75).otherwise(F.expr("pmod(l_partkey, 9) - 4") / 12.0).alias("y"),
        F.when(line <= 4, F.lit(-1.0)).when(wall, -0.25 + F.expr("pmod(l_suppkey, 16)") * 0.125)
        .otherwise(-0.65 + F.expr("pmod(l_partkey + l_suppkey, 12)") * 0.125).alias("z"),
    )


TUNNEL = DetectorConfig(
    background_history_frames=4, background_lag_frames=2, ground_hold_frames=2, ground_min_bin_points=15, gauge_certifies_clear=True,
    route_smoothing=0.5,
)


def tunnel_analysis(spark, sf_dir, rounds=None):
    pts = tunnel_points(spark, sf_dir)
    key = [
        F.concat(F.lit("bag "), F.expr("frame_seq div 20").cast("string")).alias("source"),
        F.lit(1).cast("long").alias("session"), F.col("frame_seq").alias("frame_sequence"),
    ]
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = pts.groupBy("frame_seq").agg(F.count(F.lit(1)).alias("point_count")).select(
        *key, (F.col("frame_seq") * 100_000_000 + 1_000_000_000).alias("measurement_time_ns"),
        F.lit(True).alias("transform_available"), F.lit(False).alias("calibration_verified"),
        F.lit(True).alias("allow_unverified_calibration"),
        F.array(*[F.lit(0.0)] * 3).alias("translation"), "point_count",
        F.lit(True).alias("transform_valid"),
    )
    raw = pts.select(
        *key, "raw_index", *[F.lit(v).alias(f"r{i}") for i, v in enumerate(one)],
        *[F.lit(0.0).alias(f"t{i}") for i in range(3)],
        F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"),
    )
    return analyse_points(rows, raw, TUNNEL, rounds)


@query("q_detect")
def detect(spark, sf_dir):
    """The whole detector over tunnel scenes of all order lines: routes, boxes on the track, held floors."""
    found = tunnel_analysis(spark, sf_dir)
    return found.select(
        "source", "session", "frame_sequence", "status", "reason", "calibration_trust",
        F.round("evaluated_range_m", 3).alias("evaluated_range_m"), "evaluation_region_valid",
        F.col("route.valid").alias("route_valid"), F.round("route.max_x", 3).alias("route_max_x"),
        F.size("candidates").alias("candidates"), F.round(F.get("candidates", 0)["distance_m"], 3).alias("distance_m"),
        "geometry_point_count", "ground_inliers",
    )
