"""Exported frame rows as JSON lines, and JSON summaries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathclear.schemas import EXPORT


# Calibration trust by number, from 0.
TRUST = ["UNKNOWN", "ASSUMED", "VERIFIED"]


class OutputExists(FileExistsError):
    """Results are never overwritten."""


def result_paths(run_dir: str, bag_ids: list[str]) -> dict[str, str]:
    """``<run>/<bag>/frames.jsonl``, else ``<run>/<bag>.jsonl``, for every recording that has one."""
    found = {}
    for bag in bag_ids:
        for path in (Path(run_dir) / bag / "frames.jsonl", Path(run_dir) / f"{bag}.jsonl"):
            if path.exists():
                found[bag] = str(path)
                break
    return found


def read_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Frame rows with a fixed schema; blank lines are skipped, a line that is no frame row is an error.

    ``route`` is a mixed array on disk and becomes a struct.  Rows of exports without tracks keep
    a null ``tracks``.
    """
    rows = spark.read.schema(f"{EXPORT}, _line string").option("columnNameOfCorruptRecord", "_line").json(paths)
    bad = F.col("_line").isNotNull() | F.col("bag_stamp_ns").isNull()
    told = F.concat(F.lit("not a frame row: "), F.coalesce("_line", F.lit("no bag_stamp_ns")))
    rows = rows.filter(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).drop("_line")
    r = F.col("route")

    def number(i):
        return F.get(r, i).try_cast("double")

    route = F.struct(
        F.coalesce(number(4), F.lit(0.0)).alias("c0"), number(0).alias("c1"), number(1).alias("c2"),
        F.get(r, 2).try_cast("boolean").alias("valid"), number(3).alias("max_x"),
        number(5).cast("int").alias("rail_slices"),
    )
    return rows.withColumn("route", F.when(r.isNotNull(), route))


def write_exports(frames: DataFrame, path: str) -> None:
    """One JSON object per frame in ``bag_id`` folders; fails when the output exists."""
    frames.write.mode("error").partitionBy("bag_id").json(path, ignoreNullFields=False)


def export_rows(analyses: DataFrame, assessments: DataFrame, frames: DataFrame, bag_id) -> DataFrame:
    """Joins analysis, decision and input facts into export rows.

    ``route`` is an array of numbers and one boolean, in the order that :func:`read_exports` takes. ``rejected`` is there
    where the analysis recorded it; ``processing_ms`` is null, as frames are not worked on one after another.
    """
    key = ["source", "session", "frame_sequence"]
    d = assessments.select(
        *key, "state", F.col("reason").alias("decision_reason"), "distance_m", "distance_valid", "tracks"
    )
    times = frames.select(*key, "bag_stamp_ns", "calibration_verified", "allow_unverified_calibration")
    j = analyses.join(d, key).join(times, key)
    line = F.col("route")
    return j.select(
        F.lit(1).alias("schema_version"), F.lit("geometric_rolling").alias("mode"), bag_id.alias("bag_id"),
        F.col("session").alias("session_id"), "frame_sequence",
        F.col("measurement_time_ns").alias("measurement_stamp_ns"), "bag_stamp_ns", "state",
        F.col("decision_reason").alias("reason"),
        F.when(F.col("distance_valid"), F.col("distance_m")).alias("distance_m"), "distance_valid",
        F.size("candidates").alias("candidate_count"), "candidates", "evaluation_region_valid",
        "evaluated_range_m", "ego_motion_valid", "ego_speed_mps", "ground_inliers", "ground_plane",
        "tracks",
        F.parse_json(F.concat(F.lit("["), F.concat_ws(",", *[
            F.coalesce(line[c].cast("string"), F.lit(empty)) for c, empty in
            (("c1", "0"), ("c2", "0"), ("valid", "false"), ("max_x", "0"), ("c0", "0"), ("rail_slices", "0"))
        ]), F.lit("]"))).alias("route"),
        F.col("status").alias("processing_status"),
        (F.array_position(F.array(*[F.lit(t) for t in TRUST]), F.col("calibration_trust")) - 1).cast("int").alias("calibration_trust"),
        "transform_applied",
        "calibration_verified",
        (~F.col("calibration_verified") & F.col("allow_unverified_calibration")).alias("calibration_assumed"),
        "geometry_point_count", "detection_point_count", "invalid_point_count", "blind_point_count",
        "outside_roi_point_count", F.lit(None).cast("double").alias("processing_ms"),
        *(["rejected"] if "rejected" in analyses.columns else []),
    )


def write_summary(summary: dict, path: str) -> None:
    """A summary document in a new file; NaN and infinity are refused."""
    text = json.dumps(summary, indent=2, allow_nan=False, ensure_ascii=False)
    try:
        with open(path, "x") as out:
            out.write(text + "\n")
    except FileExistsError as error:
        raise OutputExists(path) from error
