"""From a written bag with clouds and transforms to export rows and their scoring."""

import sqlite3
import struct

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from pathclear.config import DetectorConfig, Profile
from pathclear.operators import frametree
from pathclear.plans.recording import export_recordings, numbered, recording_frames
from pathclear.plans.scoring import score
from pathclear.sources import annotations, jsonl, rosbag, transforms
from tests import scenes
from tests.test_sources import cdr, message

S = 1_000_000_000
MS = S // 1000


def tf_message(*given):
    """Serialized transforms ``(stamp_ns, parent, child, translation, quaternion)``, little-endian."""
    out = bytearray(b"\0\1\0\0")

    def put(code, value):
        out.extend(b"\0" * (-(len(out) - 4) % struct.calcsize(code)))
        out.extend(struct.pack("<" + code, value))

    put("I", len(given))
    for stamp, parent, child, move, turn in given:
        put("i", stamp // S), put("I", stamp % S)
        for name in (parent, child):
            put("I", len(name) + 1)
            out.extend(name.encode() + b"\0")
        for value in (*move, *turn):
            put("d", value)
    return bytes(out)


def yaw(angle):
    return (0.0, 0.0, np.sin(angle / 2), np.cos(angle / 2))


def write_bag(path, clouds, moving=(), fixed=()):
    """``clouds``: (record, stamp, frame, points or bytes); transforms: (record, *message parts)."""
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [
            (1, "/points", rosbag.CLOUD_TYPE), (2, "/tf", transforms.TRANSFORM_TYPE), (3, "/tf_static", transforms.TRANSFORM_TYPE)])
        rows = [(r, 1, d if isinstance(d, bytes) else cdr(message(d, stamp=(t // S, t % S), frame_id=f))) for r, t, f, d in clouds]
        rows += [(r, 2, tf_message(m)) for r, *m in moving] + [(r, 3, tf_message(m)) for r, *m in fixed]
        db.executemany("INSERT INTO messages VALUES (NULL, ?, ?, ?)", [
            (kind, record, data) for record, kind, data in sorted(rows, key=lambda row: row[:2])])


POINT = [[1.0, 2.0, 3.0], [4.0, 0.0, 0.0]]
PROFILE = Profile(target_frame="train", allow_unverified_calibration=True)


def test_transforms_of_a_bag_place_the_clouds(spark, tmp_path):
    path = str(tmp_path / "tree.db3")
    # train <- mast (moving) <- lidar (fixed); train <- other hangs the other way round.
    fixed = [(1, 0, "/mast", "lidar", (0.0, 0.0, 1.0), yaw(np.pi / 2)), (1, 0, "cab", "train", (2.0, 0.0, 0.0), yaw(0.0))]
    moving = [
        (10 * S + MS, 10 * S, "train", "mast", (0.0, 0.0, 0.0), yaw(0.0)),
        (11 * S + MS, 11 * S, "train", "mast", (10.0, 0.0, 0.0), yaw(np.pi / 2)),
        (12 * S + 200 * MS, 12 * S, "train", "mast", (20.0, 0.0, 0.0), yaw(np.pi / 2)),
        (30 * S, 30 * S, "train", "mast", (0.0, 0.0, 0.0), yaw(0.0)),
        (30 * S, 30 * S, "train", "train", (9.0, 0.0, 0.0), yaw(0.0)),
        (30 * S, 10 * S + 1, "train", "mast", (0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 2.0)),
    ]
    half, exact, ahead, beyond, old = 10 * S + S // 2, 11 * S, 11 * S + S // 2, 40 * S, 12 * S + 1
    clouds = [
        (half + 490 * MS, half, "lidar", POINT), (exact + 5 * MS, exact, "lidar", POINT),
        (ahead + 10 * MS, ahead, "lidar", POINT),  # the neighbour arrives 690 ms later
        (ahead + 660 * MS, ahead + MS, "lidar", POINT),  # 40 ms later
        (13 * S, 11 * S + 2 * S // 3, "train", POINT), (13 * S, 12 * S, "cab", POINT), (13 * S + 1, 12 * S, "nowhere", POINT),
        (31 * S, old, "lidar", POINT),  # its neighbour is more than ten seconds older than the newest
        (41 * S, beyond, "lidar", POINT),
    ]
    write_bag(path, clouds, moving, fixed)
    found = transforms.read_transforms(spark, [path])
    assert found.count() == 6 and found.filter("is_static").count() == 2  # to itself and of no length left out
    frames, refused = recording_frames(spark, [path], "/points", PROFILE)
    assert refused.isEmpty()
    rows = {r["frame_sequence"]: r for r in frames.collect()}
    assert [n for n in sorted(rows) if rows[n]["transform_available"]] == [1, 2, 4, 5, 6]

    def placed(n):
        turn, move = np.array(rows[n]["rotation"]).reshape(3, 3), np.array(rows[n]["translation"])
        return np.array([[p["x"], p["y"], p["z"]] for p in rows[n]["points"]]) @ turn.T + move

    def turned(angle, points):
        c, s = np.cos(angle), np.sin(angle)
        return np.asarray(points) @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T

    on_mast = turned(np.pi / 2, POINT) + [0, 0, 1]
    np.testing.assert_allclose(placed(1), turned(np.pi / 4, on_mast) + [5, 0, 0], atol=1e-12)
    np.testing.assert_allclose(placed(2), turned(np.pi / 2, on_mast) + [10, 0, 0], atol=1e-12)
    np.testing.assert_allclose(placed(5), POINT, atol=0)
    np.testing.assert_allclose(placed(6), np.array(POINT) - [2, 0, 0], atol=1e-12)
    with pytest.raises(ValueError):
        frametree.place_clouds(frames, found, "train", lookahead=2 * S)


def test_sessions_see_their_own_transforms(spark):
    """A bag that starts again: what was recorded before the last old cloud is forgotten, fixed ones are not."""
    stamps = spark.createDataFrame(
        [("b", 100 * S + i, i, None if i == 1 else t * S) for i, t in enumerate((5, 0, 6, 2, 3))],
        "source string, record_ns long, message_id long, stamp_ns long")
    rows = {r["message_id"]: r for r in numbered(stamps).collect()}
    assert [(rows[i]["frame_sequence"], rows[i]["session"]) for i in range(5)] == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    clouds = [("b", 0, 1, 10 * S, 10 * S, "l"), ("b", 1, 2, 20 * S, 5 * S, "l"), ("b", 1, 3, 21 * S, 6 * S, "l"), ("b", 1, 4, 22 * S, None, "l")]
    flat = [0.0, 0.0, 0.0, 1.0]
    given = [("b", 1 * S, 1, 0, False, 5 * S, "t", "m", [1.0, 0.0, 0.0], flat), ("b", 2 * S, 2, 0, False, 10 * S, "t", "m", [2.0, 0.0, 0.0], flat),
             ("b", 3 * S, 3, 0, True, 0, "m", "l", [0.0, 7.0, 0.0], flat), ("b", 20 * S, 4, 0, False, 6 * S, "t", "m", [3.0, 0.0, 0.0], flat),
             ("b", 20 * S, 5, 0, False, 6 * S, "t", "m", [4.0, 0.0, 0.0], flat)]
    # No transforms, two parents, a circle: no place, and an end.
    clouds += [(name, *row[1:]) for name in ("none", "two", "circle") for row in clouds[:4]]
    given += [("two", *row[1:]) for row in given[:5]] + [("two", 0, 9, 0, True, 0, "x", "l", [0.0, 0.0, 0.0], flat)]
    given += [("circle", 0, 9, i, True, 0, p, c, [0.0, 0.0, 0.0], flat) for i, (p, c) in enumerate((("m", "l"), ("l", "m")))]
    clouds = spark.createDataFrame(clouds, "source string, session long, frame_sequence long, record_ns long, stamp_ns long, frame_id string")
    table = spark.createDataFrame(given, transforms.TRANSFORMS.replace("file", "source"))
    placed = frametree.place_clouds(clouds, table, "t").collect()
    found = {r["frame_sequence"]: r for r in placed if r["source"] == "b"}
    assert found[1]["translation"] == [2.0, 7.0, 0.0] and found[3]["translation"] == [3.0, 7.0, 0.0]
    assert not found[2]["transform_available"] and not found[4]["transform_available"]
    assert len(placed) == 16 and not any(r["transform_available"] for r in placed if r["source"] != "b")
    assert frametree.place_clouds(clouds.limit(0), table, "t").isEmpty()


def test_bag_to_export_to_score(spark, tmp_path):
    path, n = str(tmp_path / "ride.db3"), 8
    clouds = [(i * S // 10 + S, i * S // 10 + S, "lidar", scenes.flat_scene(i >= 5)) for i in range(n)]
    clouds[3] = (*clouds[3][:3], b"\0\1\0\0\1")
    write_bag(path, clouds, fixed=[(1, 0, "train", "lidar", (0.0, 0.0, 0.0), yaw(0.0))])
    profile = Profile(target_frame="train", allow_unverified_calibration=True, detector=DetectorConfig(background_history_frames=0))
    out = str(tmp_path / "run")
    jsonl.write_exports(export_recordings(spark, [path], "/points", profile), out)
    line = next(f for f in (tmp_path / "run" / "bag_id=ride").glob("*.json") if f.stat().st_size).read_text().splitlines()[0]
    assert '"route":[' in line and '"route":["' not in line
    back = jsonl.read_exports(spark, [out + "/bag_id=ride"]).withColumn("bag_id", F.lit("ride"))
    rows = {r["frame_sequence"]: r for r in back.collect()}
    assert sorted(rows) == list(range(1, n + 1))
    assert rows[4]["reason"] == "DESERIALIZATION_ERROR" and rows[4]["state"] == "UNKNOWN" and rows[4]["measurement_stamp_ns"] == 0
    assert rows[8]["state"] == "OBSTACLE" and rows[8]["candidates"][0]["distance_m"] == pytest.approx(20.0, abs=0.2)
    assert {r["calibration_trust"] for k, r in rows.items() if k != 4} == {1} and rows[4]["calibration_trust"] == 0
    notes = tmp_path / "ride.yaml"
    notes.write_text(yaml.safe_dump({"reviewed": True, "time_basis": "bag_stamp_ns", "reviewed_intervals": [
        {"start_ns": S + S // 2, "end_ns": 3 * S, "label": "positive"}], "events": [
        {"id": "e", "start_ns": S + S // 2, "end_ns": 3 * S, "label": "positive", "reference_frames": []}]}))
    intervals, events, refs = annotations.read_annotations(spark, {"ride": str(notes)})
    frame = score(back, intervals, events, refs)["frame"].first()
    assert frame["tp"] >= 1 and frame["fp"] == 0


def test_bound_source_frames(spark, tmp_path):
    path = str(tmp_path / "bound.db3")
    clouds = [(i * S, t * S, f, POINT) for i, (t, f) in enumerate(((1, "train"), (2, "a"), (3, "b"), (4, "a"), (1, "b"), (2, "a")), 1)]
    write_bag(path, clouds)
    profile = Profile(source_frame_mode="bind_first", target_frame="train", has_transform=True, translation=(1.0, 0.0, 0.0))
    frames, _ = recording_frames(spark, [path], "/points", profile)
    rows = {r["frame_sequence"]: r for r in frames.collect()}
    assert [n for n in sorted(rows) if rows[n]["transform_available"]] == [2, 4, 5]
    assert rows[2]["translation"] == [1.0, 0.0, 0.0]
