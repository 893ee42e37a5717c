"""Bag files, cloud bytes, exports, annotations and the scoring plan on small known inputs."""

import json
import sqlite3
import struct

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from pathclear.config import CloudLimits, ConfigError, override_profile, profile_from_mapping
from pathclear.plans import report
from pathclear.plans.provenance import file_hashes, run_issues, working_range
from pathclear.plans.scoring import bag_counts, holdout, range_totals, score, totals
from pathclear.schemas import CLOUD, EXPORT
from pathclear.sources import annotations, clouds, jsonl, rosbag

S = 1_000_000_000


def message(points, fmt="<f4", step=16, pad=0, offsets=(0, 4, 8), fields=None, height=1, stamp=(5, 7), **change):
    """Cloud row with the given layout."""
    points = np.asarray(points, dtype=float).reshape(height, -1, 3)
    width = points.shape[1]
    row_step = width * step + pad
    data = bytearray(row_step * height)
    for r in range(height):
        for c in range(width):
            for axis in range(3):
                at = r * row_step + c * step + offsets[axis]
                raw = np.array(points[r, c, axis], dtype=fmt).tobytes()
                data[at : at + len(raw)] = raw
    kind = 7 if fmt.endswith("4") else 8
    fields = fields if fields is not None else [(n, o, kind, 1) for n, o in zip("xyz", offsets)]
    row = dict(
        source="bag", session=1, frame_sequence=1, bag_stamp_ns=1, stamp_sec=stamp[0], stamp_nanosec=stamp[1],
        frame_id="lidar", width=width, height=height, point_step=step, row_step=row_step,
        is_bigendian=fmt.startswith(">"), fields=fields, data=bytes(data),
    )
    row.update(change)
    return row


PTS = [[1, 2, 3], [0, 0, 0], [4.5, -1, np.nan], [7, 8, 9]]
LAYOUTS = [
    (message(PTS), None), (message(PTS, pad=5, height=2), None), (message(PTS, fmt=">f4"), None),
    (message(PTS, fmt="<f8", step=32, offsets=(0, 8, 16)), None), (message(PTS, step=19, offsets=(1, 6, 13)), None),
    (message(PTS, stamp=(-1, 0)), "INVALID_TIMESTAMP"), (message(PTS, stamp=(0, 0)), "INVALID_TIMESTAMP"),
    (message(PTS, stamp=(1, S)), "INVALID_TIMESTAMP"),
    (message(PTS, row_step=3), "Invalid PointCloud2 strides or data length"),
    (message(PTS, data=b"short"), "Invalid PointCloud2 strides or data length"),
    (message(PTS, fields=[("x", 0, 7, 1), ("x", 4, 7, 1), ("y", 4, 7, 1), ("z", 8, 7, 1)]), "Duplicate XYZ field"),
    (message(PTS, fields=[("x", 0, 7, 1), ("y", 4, 2, 1), ("z", 8, 7, 1)]), "XYZ must be scalar FLOAT32/FLOAT64"),
    (message(PTS, fields=[("x", 0, 7, 1), ("y", 4, 7, 1)]), "XYZ must be scalar FLOAT32/FLOAT64"),
    (message(PTS, fields=[("x", 0, 7, 1), ("y", 4, 7, 1), ("z", 14, 7, 1)]), "XYZ field exceeds point_step"),
    (message(PTS, fields=[("x", 0, 7, 1), ("y", 2, 7, 1), ("z", 8, 7, 1)]), "XYZ fields overlap"),
    (message(np.zeros((0, 3))), None), (message(np.zeros((9, 3))), "POINT_LIMIT_EXCEEDED"),
]


def test_cloud_layouts(spark):
    names = [f.split()[0] for f in CLOUD.split(", ")]
    rows = [tuple({**row, "frame_sequence": i}[n] for n in names) for i, (row, _) in enumerate(LAYOUTS)]
    decoded = clouds.decode(spark.createDataFrame(rows, CLOUD), CloudLimits(max_points=8))
    found = {r["frame_sequence"]: r for r in decoded.collect()}
    for i, (row, error) in enumerate(LAYOUTS):
        assert found[i]["decode_error"] == error, i
        if error is None and row["width"]:
            got = np.array([[p["x"], p["y"], p["z"]] for p in found[i]["points"]])
            np.testing.assert_array_equal(got, np.array(PTS))
            assert found[i]["measurement_time_ns"] == 5 * S + 7
    with pytest.raises(ConfigError):
        CloudLimits(max_points=0)
    refused = {r["reason"] for r in clouds.refused(decoded).collect()}
    assert "XYZ fields overlap" in refused and None not in refused


def test_edited_clouds_are_written_and_read_back(spark, tmp_path):
    names = [f.split()[0] for f in CLOUD.split(", ")]
    rows = [tuple({**row, "frame_sequence": i}[n] for n in names) for i, (row, error) in enumerate(LAYOUTS) if error is None]
    given = spark.createDataFrame(rows, CLOUD)
    decoded = clouds.decode(given).select("frame_sequence", F.transform("points", lambda p: F.struct(
        (p["x"] + 1).alias("x"), p["y"].alias("y"), (p["z"] * 2).alias("z"))).alias("points"))
    path = str(tmp_path / "edited")
    clouds.write_edited(given.join(decoded, "frame_sequence").select(*names, "points"), path)
    back = {r["frame_sequence"]: r for r in clouds.decode(spark.read.parquet(path)).collect()}
    messages = {r["frame_sequence"]: r for r in spark.read.parquet(path).collect()}
    for row in given.collect():
        got = np.array([[p["x"], p["y"], p["z"]] for p in back[row["frame_sequence"]]["points"]]).reshape(-1, 3)
        want = np.array(PTS) * [1, 1, 2] + [1, 0, 0] if row["width"] else np.empty((0, 3))
        np.testing.assert_array_equal(got, want)
        new = messages[row["frame_sequence"]]
        assert {k: v for k, v in new.asDict().items() if k != "data"} == {k: v for k, v in row.asDict().items() if k != "data"}
        assert len(new["data"]) == len(row["data"])
    # The bytes between the fields stay.
    row = message(PTS, step=19, offsets=(1, 6, 13))
    row["data"] = bytes(b or 7 for b in row["data"])
    one = spark.createDataFrame([tuple(row[n] for n in names)], CLOUD)
    same = clouds.encode(one.join(clouds.decode(one).select("frame_sequence", "points"), "frame_sequence").select(*names, "points")).first()
    assert bytes(same["data"])[::19] == row["data"][::19]
    # A wrong number of points ends the write and leaves nothing.
    wrong = given.withColumn("points", F.expr("array(named_struct('x', 1D, 'y', 1D, 'z', 1D))"))
    with pytest.raises(Exception, match="points for a cloud"):
        clouds.write_edited(wrong, str(tmp_path / "wrong"))
    assert not [f for f in (tmp_path / "wrong").rglob("*") if f.suffix == ".parquet"]


def cdr(row):
    """Serialized message, little-endian."""
    out = bytearray(b"\0\1\0\0")

    def put(code, value):
        size = struct.calcsize(code)
        out.extend(b"\0" * (-(len(out) - 4) % size))
        out.extend(struct.pack("<" + code, value))

    def text(value):
        put("I", len(value) + 1)
        out.extend(value.encode() + b"\0")

    put("i", row["stamp_sec"]), put("I", row["stamp_nanosec"]), text(row["frame_id"])
    put("I", row["height"]), put("I", row["width"]), put("I", len(row["fields"]))
    for name, offset, kind, count in row["fields"]:
        text(name), put("I", offset), put("B", kind), put("I", count)
    put("B", row["is_bigendian"]), put("I", row["point_step"]), put("I", row["row_step"])
    put("I", len(row["data"]))
    out.extend(row["data"] + b"\1")
    return bytes(out)


def test_bag_source(spark, tmp_path):
    path = str(tmp_path / "bag.db3")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/points", rosbag.CLOUD_TYPE), (2, "/tf", "tf")])
        for i in range(25):
            broken = i == 7
            data = b"\0\1\0\0\1" if broken else cdr(message(np.array(PTS) + i, stamp=(i + 1, 0)))
            db.execute("INSERT INTO messages VALUES (NULL, 1, ?, ?)", (1000 + i, data))
            db.execute("INSERT INTO messages VALUES (NULL, 2, ?, ?)", (1000 + i, b"x"))
    rosbag.register(spark)
    raw = spark.read.format("rosbag").option("path", path).option("messages_per_task", "8").load()
    assert raw.rdd.getNumPartitions() > 3
    assert raw.filter("topic = '/tf' AND timestamp >= 1010 AND timestamp < 1015").count() == 5
    assert [r["timestamp"] for r in raw.filter("timestamp = 1003 AND topic = '/points'").collect()] == [1003]
    assert rosbag.message_index(spark, [path], "/points").count() == 25
    found = rosbag.read_clouds(spark, [path], "/points")
    assert [r["bag_stamp_ns"] for r in found.filter("parse_error = 'DESERIALIZATION_ERROR'").collect()] == [1007]
    ready = found.filter("parse_error IS NULL").select(
        F.lit("bag").alias("source"), F.lit(1).cast("long").alias("session"),
        F.col("bag_stamp_ns").alias("frame_sequence"), "bag_stamp_ns", "stamp_sec", "stamp_nanosec", "frame_id",
        "width", "height", "point_step", "row_step", "is_bigendian", "fields", "data",
    )
    frames = clouds.to_frames(clouds.decode(ready), (1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 0), False, True)
    rows = {r["frame_sequence"]: r for r in frames.collect()}
    assert len(rows) == 24 and rows[1003]["points"][0]["x"] == 4.0 and rows[1003]["measurement_time_ns"] == 4 * S


def export(bag, t, state, distance=None, center=None, ms=10.0, reach=60.0, reason="R"):
    tracks = [] if center is None else [{
        "id": 1, "confirmed": True, "coasting": False, "hits": 2, "age": 3, "distance_m": distance,
        "center": center, "size": [0.5, 0.5, 1.7], "channels": 2}]
    return {"schema_version": 1, "bag_id": bag, "frame_sequence": int(t * 10) + 1, "bag_stamp_ns": int(t * S),
            "measurement_stamp_ns": int(t * S), "state": state, "reason": reason, "distance_m": distance,
            "tracks": tracks, "candidates": [], "processing_ms": ms, "evaluated_range_m": reach,
            "route": [0.01, 0.002, True, 70.0, 0.1, 4], "ego_motion_valid": True, "ego_speed_mps": 10.0}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    clear, hit = "NO_OBSTACLE_DETECTED", "OBSTACLE"
    one = [export("one", t, hit if t in (0, 0.1, 0.2, 1.0, 1.1, 3.0) else clear) for t in [i / 10 for i in range(61)]]
    two = [export("two", 0.0, "UNKNOWN", reach=0.0), export("two", 0.1, hit, 20.3, [20.5, 0.0, 0.5]),
           export("two", 0.2, hit, 40.0, [40.0, 0.0, 0.5]), export("two", 0.3, clear)]
    (folder / "one").mkdir()
    (folder / "one" / "frames.jsonl").write_text("\n\n".join(map(json.dumps, one)) + "\n")
    (folder / "two.jsonl").write_text("\n".join(map(json.dumps, two)))
    roi = {"min": [20, -1, 0], "max": [21, 1, 2]}
    docs = {
        "one": {"reviewed": True, "time_basis": "bag_stamp_ns",
                "reviewed_intervals": [{"start_ns": 0, "end_ns": 6 * S, "label": "negative"}]},
        "two": {"reviewed": True, "time_basis": "bag_stamp_ns",
                "reviewed_intervals": [{"start_ns": 0, "end_ns": 3 * S // 10, "label": "positive"}],
                "events": [{"id": "person", "start_ns": 0, "end_ns": S, "label": "positive", "reference_frames": [
                    {"bag_stamp_ns": S // 10, "distance_m": 20.0, "person_roi_assumed_m": roi},
                    {"bag_stamp_ns": S // 5, "person_roi_assumed_m": roi},
                    {"bag_stamp_ns": 3 * S // 10, "person_roi_assumed_m": roi},
                    {"bag_stamp_ns": S, "person_roi_assumed_m": roi}]},
                    {"id": "sign", "start_ns": 0, "end_ns": S, "label": "negative", "reference_frames": [
                        {"bag_stamp_ns": S // 5, "person_roi_assumed_m": {"min": [39, -1, 0], "max": [41, 1, 2]}}]}]},
    }
    paths = {}
    for bag, doc in docs.items():
        paths[bag] = str(folder / f"{bag}.yaml")
        (folder / f"{bag}.yaml").write_text(yaml.safe_dump(doc))
    (folder / "splits.yaml").write_text(yaml.safe_dump(
        {"validation": ["two"], "blind_holdout": [{"bag": "one", "from_bag_stamp_ns": S}, {"bag": "gone", "from_bag_stamp_ns": 0}]}))
    found = jsonl.result_paths(str(folder), ["one", "two", "three"])
    assert set(found) == {"one", "two"}
    exports = jsonl.read_exports(spark, list(found.values()))
    return folder, exports, annotations.read_annotations(spark, paths)


def test_scoring_of_a_run(spark, run, tmp_path):
    folder, exports, (intervals, events, references) = run
    assert exports.count() == 65
    assert exports.first()["route"].asDict() == {
        "c0": 0.1, "c1": 0.01, "c2": 0.002, "valid": True, "max_x": 70.0, "rail_slices": 4}
    ranges = spark.createDataFrame([("two", 20.0)], "bag_id string, working_range_m double")
    tables = score(exports, intervals, events, references, ranges)
    frame = {r["bag_id"]: r for r in tables["frame"].collect()}
    assert (frame["one"]["fp"], frame["one"]["negative_frames"], frame["one"]["frame_precision"]) == (6, 61, None)
    assert (frame["two"]["tp"], frame["two"]["fn"], frame["two"]["unknown_on_positive"]) == (2, 2, 1)
    assert tables["alarm_events"].count() == 3
    assert tables["negative_time"].filter("bag_id = 'one'").first()["negative_duration_s"] == 6.0
    assert tables["occupancy"].filter("bag_id = 'one'").first()["alarm_duration_s"] == pytest.approx(0.6)
    checks = {r["ref_stamp_ns"]: r for r in tables["checks"].collect()}
    assert [checks[t]["result"] for t in sorted(checks)] == ["hit", "wrong_object", "miss", "no_frame"]
    assert checks[S // 10]["error_m"] == pytest.approx(0.3) and checks[S]["object_m"] == 20.0
    event = tables["events"].first()
    assert event["detected"] and event["first_alarm_delay_s"] == pytest.approx(0.1)
    assert event["object_confirmed"] and event["first_matched_distance_m"] == pytest.approx(20.3)
    assert tables["negative_objects"].first()["alarm_frames"] == 1
    assert tables["coverage_scored"].filter("bag_id = 'two'").first()["observed"] == 0.75
    splits, blind = annotations.read_splits(spark, str(folder / "splits.yaml"))
    total = {r["split"]: r for r in totals(bag_counts(tables), splits).collect()}
    assert set(total) == {"validation", "unassigned", "total"}
    assert total["total"]["fp_events_per_min"] == pytest.approx(30.0)
    assert total["total"]["object_recall"] == pytest.approx(0.25)
    near = {r["split"]: r for r in range_totals(tables, splits).collect()}
    assert near["total"]["ranges_m"] == [20.0] and near["total"]["hits"] == 1
    lines = report.quality_report(tables, totals(bag_counts(tables), splits), range_totals(tables, splits))
    text = "\n".join(r["line"] for r in lines.collect())
    assert "| unassigned | 0 | 61 | 0 | 0 | 0 | 0 | 6 | - | - | 9.8 % |" in text
    assert text.index("| validation |") < text.index("| total |") < text.index("within the working range") < text.index("## Recordings")
    late = {r["bag_id"]: r for r in holdout(exports, blind).collect()}
    assert (late["one"]["frames"], late["one"]["events"], late["gone"]["frames"]) == (51, 2, None)
    report.write_new(lines, str(tmp_path / "q.md"))
    assert (tmp_path / "q.md").read_text() == text + "\n"
    with pytest.raises(FileExistsError):
        report.write_new(lines, str(tmp_path / "q.md"))


def test_summary_refuses_nan_and_old_files(tmp_path):
    path = str(tmp_path / "s.json")
    with pytest.raises(ValueError):
        jsonl.write_summary({"a": float("nan")}, str(tmp_path / "n.json"))
    jsonl.write_summary({"a": None}, path)
    with pytest.raises(jsonl.OutputExists):
        jsonl.write_summary({"a": 1}, path)


def test_annotations_must_be_reviewed():
    with pytest.raises(annotations.AnnotationError):
        annotations.annotation_rows("b", {"time_basis": "bag_stamp_ns"})
    with pytest.raises(annotations.AnnotationError):
        annotations.annotation_rows("b", {"reviewed": True, "time_basis": "header"})


def test_profiles_are_strict():
    base = {"detector": {"corridor_half_width_m": 1.05}, "temporal": {"confirm_hits": 2, "confirm_window": 3}}
    profile = profile_from_mapping({**base, "allow_unverified_calibration": True})
    assert profile.detector.corridor_half_width_m == 1.05 and profile.working_range_m == 120.0
    assert profile_from_mapping(base).working_range_m is None
    patched = override_profile(base, ["angular_cell_deg=0.5", "temporal.confirm_hits=1"])
    assert profile_from_mapping(patched).detector.angular_cell_deg == 0.5 and "angular_cell_deg" not in base["detector"]
    for wrong in ({"detector": {"nope": 1}}, {"detector": {"min_candidate_cells": 1.5}},
                  {"temporal": {"edge_retracts": 1}}, {"source_frame_mode": "latest"}):
        with pytest.raises(ConfigError):
            profile_from_mapping(wrong)
    turned = profile_from_mapping({"translation_m": [0, 0, 0], "rotation_rpy_rad": [0, 0, np.pi / 2]})
    np.testing.assert_allclose(np.array(turned.rotation).reshape(3, 3) @ [0, -1, 0], [1, 0, 0], atol=1e-12)


def test_provenance(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = file_hashes(spark, [str(tmp_path / "a.bin")]).first()
    assert row["hash"].startswith("ba7816bf") and row["length"] == 3
    manifest = spark.createDataFrame(
        [("r", False, "img", None, ["x"], [])],
        "run_id string, dirty boolean, image_id string, commit string, config_sha256 array<string>, executable_sha256 array<string>")
    bags = spark.createDataFrame(
        [("r", "one", "exported", 5, 5, "h", "h", True), ("r", "two", "exported", 5, 4, "h", "g", False)],
        "run_id string, bag_id string, status string, declared long, exported long, recorded_hash string, current_hash string, ordered boolean")
    assert {r["issue"] for r in run_issues(manifest, bags).collect()} == {
        "source commit missing", "executable hashes missing", "incomplete frame export: two",
        "result hash missing or changed: two", "duplicate or unordered frames: two"}
    recorded = spark.createDataFrame(
        [("a", "p", "h", True, 90.0), ("b", "p", "h", False, None), ("c", "p", "old", False, None)],
        "bag_id string, sensor_profile string, profile_hash string, has_range boolean, working_range_m double")
    profiles = spark.createDataFrame([("p", "h", 120.0)], "sensor_profile string, hash string, profile_range_m double")
    assert {r[0]: r[1] for r in working_range(recorded, profiles).collect()} == {"a": 90.0, "b": 120.0, "c": None}
