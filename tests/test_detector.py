"""Scenes through the batch detector."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathclear.config import Box, ConfigError, DetectorConfig, TemporalConfig
from pathclear.functions.settling import settle
from pathclear.operators import points as ops
from pathclear.operators.floor import curve_of, sample_draws
from pathclear.operators.graph import connected_components, label_cells
from pathclear.operators.tracking import decide
from pathclear.plans.detector import analyse
from tests import scenes as s

YAW_90 = [0.0, -1, 0, 1, 0, 0, 0, 0, 1]


def ns(i):
    return 1_000_000_000 + i * 100_000_000


@pytest.fixture(scope="module")
def single(spark):
    y = 1600 / 600
    seven = [[0, 0, 0], [np.nan, 1, 2], [1, np.inf, 2], [0.1, 0, 0], [0, -10, -1], [8, -10, 0], [0, -200, 0]]
    frames = [
        s.frame("block", 1, s.flat_scene(True)), s.frame("clear", 1, s.flat_scene(False)),
        s.frame("verified", 1, s.flat_scene(False), verified=True),
        s.frame("sparse", 1, np.column_stack([np.full(20, 20.0), np.arange(20) * 0.02, np.full(20, 0.5)])),
        s.frame("gap", 1, np.concatenate([s.floor(4, 40), s.floor(60, 88)])),
        s.frame("far floor", 1, s.floor(20, 88)), s.frame("curve", 1, s.curved_tunnel(300)),
        s.frame("curve block", 1, np.concatenate([s.curved_tunnel(300), s.box(40, y - 0.3, y + 0.3, 0.3, 1.7)])),
        s.frame("slope", 1, s.floor(4, 50, 0.02)), s.frame("empty", 1, np.zeros((0, 3))),
        s.frame("low", 1, np.concatenate([s.floor(4, 50), s.box(20, 1.6, 1.96, 0.3, 0.5)])),
        s.frame("low beside tall", 1, np.concatenate(
            [s.floor(4, 50), s.box(20, 1.6, 1.96, 0.3, 0.5), s.box(20, 2.04, 2.4, 0.3, 1.7)])),
        s.frame("no tf", 1, [[10, 0, 0]], tf=False), s.frame("unverified", 1, [[10, 0, 0]], allow=False),
        s.frame("mirror", 1, [[10, 0, 0]], rotation=[-1.0, 0, 0, 0, 1, 0, 0, 0, 1]),
        s.frame("zero", 1, [[0, 0, 0]]),
        s.frame("seven", 1, seven, verified=True, rotation=YAW_90, translation=(1.0, 2.0, 3.0)),
    ]
    config = DetectorConfig(background_history_frames=0, record_rejected=True)
    found = settle(analyse(s.table(spark, frames), config))
    rows = {r["source"]: r.asDict(recursive=True) for r in found.collect()}
    states = {r["source"]: r for r in decide(found, TemporalConfig()).collect()}
    return rows, states


def test_obstacle_and_clear_scenes(single):
    rows, states = single
    assert rows["block"]["candidates"][0]["distance_m"] == pytest.approx(20.0, abs=0.2)
    assert states["block"]["state"] == "OBSTACLE"
    assert states["block"]["reason"] == "OBSTACLE_WITH_ASSUMED_CALIBRATION"
    assert not rows["clear"]["candidates"] and states["clear"]["state"] == "UNKNOWN"
    assert states["verified"]["state"] == "NO_OBSTACLE_DETECTED"
    assert states["sparse"]["reason"] == "GROUND_UNSUPPORTED"


def test_floor_support(single):
    rows, _ = single
    assert rows["gap"]["evaluated_range_m"] == pytest.approx(43.0)
    assert rows["far floor"]["reason"] == "CORRIDOR_UNOBSERVABLE"
    assert rows["slope"]["floor"][0] == pytest.approx(0.02) and not rows["slope"]["candidates"]


def test_route_follows_the_curve(single):
    rows, _ = single
    route = rows["curve"]["route"]
    assert route["valid"] and route["c2"] == pytest.approx(1 / 600, rel=0.2) and abs(route["c1"]) < 0.01
    assert route["max_x"] > 60 and not rows["curve"]["candidates"]
    last = rows["curve"]["corridor"][-1]["end"]
    assert len(rows["curve"]["corridor"]) > 1
    assert last["y"] == pytest.approx(route["c0"] + route["c1"] * last["x"] + route["c2"] * last["x"] ** 2)
    assert [round(c["distance_m"], 1) for c in rows["curve block"]["candidates"]] == [40.0]


def test_height_counts_only_inside_returns(single):
    rows, _ = single
    assert not rows["low"]["candidates"] and not rows["low beside tall"]["candidates"]
    assert {r["reason"] for r in rows["low beside tall"]["rejected"]} == {"LOW_EXTENT"}


def test_admission_order_and_counters(single):
    rows, _ = single
    reasons = {n: rows[n]["reason"] for n in ("empty", "no tf", "unverified", "mirror", "zero")}
    assert reasons == {
        "empty": "EMPTY_INPUT", "no tf": "TF_UNAVAILABLE", "unverified": "CALIBRATION_UNVERIFIED",
        "mirror": "INVALID_TRANSFORM", "zero": "EMPTY_GEOMETRY_ROI",
    }
    seven = rows["seven"]
    assert [seven[f"{n}_point_count"] for n in ("invalid", "blind", "outside_roi", "geometry", "detection")] == [3, 1, 1, 2, 1]


@pytest.fixture(scope="module")
def rolling(spark):
    short = np.concatenate([s.floor(1, 100), np.stack(np.meshgrid(
        np.arange(3, 4.79, 0.05), [-2.6, 2.6], -1 + np.array([0.5, 1.5, 2.5]), indexing="ij"), -1).reshape(-1, 3)])
    frames = [s.frame("move", i + 1, s.moving_tunnel(i, 10, i == 16), ns(i)) for i in range(17)]
    frames += [s.frame("still", i + 1, s.moving_tunnel(i, 0), ns(i)) for i in range(12)]
    frames += [s.frame("rolling", i + 1, s.flat_scene(i == 11)) for i in range(12)]
    frames += [s.frame("short", i + 1, short, ns(i)) for i in range(8)]
    frames += [s.frame("back", i + 1, s.flat_scene(False), ns(i if i < 11 else 0)) for i in range(13)]
    frames += [s.frame("refused", i + 1, s.flat_scene(False), ns(i), tf=i != 10) for i in range(13)]
    found = settle(analyse(s.table(spark, frames), DetectorConfig()))
    return {(r["source"], r["frame_sequence"]): r for r in found.collect()}


def test_warm_up_then_background(rolling):
    assert all(rolling["rolling", i]["reason"] == "BASELINE_WARMUP" for i in range(1, 11))
    assert rolling["rolling", 11]["reason"] == "BACKGROUND_CANNOT_CONFIRM_CLEAR"
    assert rolling["rolling", 12]["candidates"][0]["distance_m"] == pytest.approx(20.0, abs=0.2)


def test_moving_tunnel_stays_in_the_background(rolling):
    assert rolling["move", 16]["ego_speed_mps"] == pytest.approx(10.0, abs=0.6)
    assert not rolling["move", 16]["candidates"]
    assert rolling["move", 17]["candidates"][0]["distance_m"] == pytest.approx(20.0, abs=0.1)
    assert rolling["still", 12]["ego_motion_valid"] and rolling["still", 12]["ego_speed_mps"] == 0
    assert not rolling["still", 12]["candidates"]


def test_no_speed_without_comparable_shifts(rolling):
    assert not any(rolling["short", i]["ego_motion_valid"] for i in range(1, 9))


def test_resets_restart_the_warm_up(rolling):
    assert rolling["back", 11]["reason"] == "BACKGROUND_CANNOT_CONFIRM_CLEAR"
    assert rolling["back", 12]["reason"] == "BASELINE_WARMUP"
    assert rolling["refused", 11]["reason"] == "TF_UNAVAILABLE"
    assert rolling["refused", 12]["reason"] == "BASELINE_WARMUP"


def test_held_floor_reveals_but_never_certifies(spark):
    near = np.concatenate([s.floor(4, 15), s.block()])
    bare = s.floor(4, 15)
    plan = [s.flat_scene(False)] * 3 + [near, bare, bare, bare, s.flat_scene(False)]
    frames = [s.frame("hold", i + 1, p, ns(i)) for i, p in enumerate(plan)]
    config = DetectorConfig(
        ground_hold_frames=3, background_history_frames=2, background_lag_frames=1,
        ego_motion_compensation=False,
    )
    rows = {r["frame_sequence"]: r for r in analyse(s.table(spark, frames), config).collect()}
    assert rows[4]["reason"] == "CANDIDATES_FOUND"
    assert rows[5]["reason"] == "GROUND_UNSUPPORTED" and rows[5]["evaluated_range_m"] == 0
    assert rows[6]["floor"] is not None and rows[7]["floor"] is None
    assert rows[8]["reason"] == "BACKGROUND_CANNOT_CONFIRM_CLEAR"


def test_hanging_strip_and_gauge_certification(spark):
    strip = np.column_stack([np.full(12, 25.0), np.zeros(12), np.linspace(1.95, 2.6, 12)])
    frames = [
        s.frame("strip", 1, np.concatenate([s.curved_tunnel(3000), strip])),
        s.frame("none", 1, s.curved_tunnel(3000)),
    ]
    config = replace(
        DetectorConfig(background_history_frames=0), hanging_channel=True, pole_rejection=True,
        corridor_half_width_m=1.05, candidate_margin_m=0.4, corridor_height_m=3.0,
        hanging_tip_max_height_m=3.0, sensor_height_above_rail_m=0.9, rail_route_weight=1.0,
        far_gauge_max_x_m=110.0, gauge_certifies_clear=True, route_margin_per_m=0.005,
    )
    rows = {r["source"]: r for r in analyse(s.table(spark, frames), config).collect()}
    assert [(round(c["distance_m"], 2), c["channels"]) for c in rows["strip"]["candidates"]] == [(25.0, 2)]
    assert not rows["none"]["candidates"]


def test_points_beyond_the_limit_are_refused(spark):
    frames = [s.frame("big", 1, s.flat_scene(True)), s.frame("small", 1, s.flat_scene(False))]
    config = DetectorConfig(background_history_frames=0, max_points=1500)
    rows = {r["source"]: r["reason"] for r in analyse(s.table(spark, frames), config).collect()}
    assert rows["big"] == "POINT_LIMIT_EXCEEDED" and rows["small"] == "NO_CANDIDATE_IN_EVALUATED_REGION"


def test_sampling_sequence_and_curves():
    draws = sample_draws()
    assert draws.shape == (256, 3) and draws[0, 0] == (0x9E3779B9 * 1664525 + 1013904223) % 2**32
    profile = np.tile(np.sin(np.arange(640) * 0.3), (6, 1)).astype(np.float32)
    moved = np.roll(profile, -7, axis=1)
    curve = curve_of(moved, profile, 20)
    assert int(np.argmin(curve)) == 7 and curve[7] == pytest.approx(0, abs=1e-6)


def brute_components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)]
    ids = spark.range(300).select(F.lit(1).alias("g"), F.col("id"))
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "g int, u long, v long")
    found = {r["id"]: r["component"] for r in connected_components(ids, edges, ["g"]).collect()}
    assert [found[i] for i in range(300)] == brute_components(300, pairs)
    cells = np.unique(rng.integers(0, 40, (300, 2)), axis=0)
    near = [(i, j) for i in range(len(cells)) for j in range(i)
            if abs(cells[i] - cells[j]).max() <= 2]
    label = label_cells(cells[:, 0], cells[:, 1], None, 2)
    keys = cells[:, 0] * 4096 + cells[:, 1]
    assert label.tolist() == [int(keys[i]) for i in brute_components(len(cells), near)]


@pytest.mark.parametrize("change", [
    {"max_points": 0}, {"ground_max_gap_m": 4.9}, {"low_bump_min_prominence_m": 0.0},
    {"static_inner_half_width_m": 1.0}, {"hanging_tip_max_height_m": 3.6}, {"blind_radius_m": -1.0},
    {"background_lag_frames": 10}, {"detection_roi": Box((0, -5, -3), (500, 5, 5))},
])
def test_config_bounds(change):
    with pytest.raises(ConfigError):
        DetectorConfig(**change)
    with pytest.raises(ConfigError):
        Box((float("nan"), 0, 0), (1, 1, 1))
