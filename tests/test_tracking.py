"""Decision table, track sequences, speed curves and the order gate."""

import math
import random

import pytest

from pathclear.config import ConfigError, TemporalConfig
from pathclear.operators.speed import SpeedTracker
from pathclear.operators.tracking import Monitor, OrderGate, gate_frames


def candidate(x, y=0.0, channels=1, points=100, valid=True, edge=False, offset=0.0):
    return {"center": [x, y, 0.0], "size": [0.5, 0.5, 1.7], "distance_m": x - 0.25, "distance_valid": valid,
            "support_points": points, "channels": channels, "edge": edge, "closest_offset_m": offset}


def frame(step=1, seen=(), status=0, trust="VERIFIED", region=True, reach=80.0, reason="", speed=0.0, ego=False):
    return {"status": status, "reason": reason, "calibration_trust": trust, "evaluation_region_valid": region,
            "evaluated_range_m": reach, "ego_motion_valid": ego, "ego_speed_mps": speed, "candidates": list(seen),
            "measurement_time_ns": step * 100_000_000}


NAN, INF = math.nan, math.inf
CASES = [
    (frame(status=1, reason="EMPTY_INPUT"), "UNKNOWN", "EMPTY_INPUT"),
    (frame(status=3), "UNKNOWN", "ANALYSIS_FAILED"),
    (frame(seen=[candidate(20)]), "OBSTACLE", "OBSTACLE_CANDIDATE"),
    (frame(seen=[candidate(20)], trust="ASSUMED"), "OBSTACLE", "OBSTACLE_WITH_ASSUMED_CALIBRATION"),
    (frame(seen=[candidate(20)], trust="UNKNOWN"), "OBSTACLE", "OBSTACLE_WITH_UNKNOWN_CALIBRATION"),
    (frame(seen=[candidate(20, valid=False)]), "UNKNOWN", "CANDIDATE_DISTANCE_INVALID"),
    (frame(seen=[candidate(NAN)]), "UNKNOWN", "CANDIDATE_DISTANCE_INVALID"),
    (frame(seen=[candidate(INF)]), "UNKNOWN", "CANDIDATE_DISTANCE_INVALID"),
    (frame(seen=[candidate(0.1)]), "UNKNOWN", "CANDIDATE_DISTANCE_INVALID"),
    (frame(), "NO_OBSTACLE_DETECTED", "NO_CANDIDATE_IN_EVALUATED_REGION"),
    (frame(trust="UNKNOWN"), "UNKNOWN", "CALIBRATION_TRUST_UNKNOWN"),
    (frame(trust="ASSUMED"), "UNKNOWN", "ASSUMED_CALIBRATION_CANNOT_CONFIRM_CLEAR"),
    (frame(region=False), "UNKNOWN", "CORRIDOR_UNOBSERVABLE"),
    (frame(reach=0.0), "UNKNOWN", "EVALUATION_REGION_INVALID"),
    (frame(reach=NAN), "UNKNOWN", "EVALUATION_REGION_INVALID"),
    (frame(region=False, reason="BACKGROUND_CANNOT_CONFIRM_CLEAR"), "UNKNOWN", "BACKGROUND_CANNOT_CONFIRM_CLEAR"),
]


def check(out):
    """Invariants of every decision."""
    assert (out["state"] == "OBSTACLE") == out["distance_valid"]
    if out["distance_valid"]:
        assert out["distance_m"] > 0 and math.isfinite(out["distance_m"])
    assert out["reason"]
    if out["state"] == "NO_OBSTACLE_DETECTED":
        assert out["calibration_trust"] != "UNKNOWN"
    return out


@pytest.mark.parametrize("given, state, reason", CASES)
def test_decision_table(given, state, reason):
    out = check(Monitor(TemporalConfig()).step(given))
    assert (out["state"], out["reason"]) == (state, reason)


@pytest.mark.parametrize("reach, reason", [
    (60.0, "NO_CANDIDATE_ASSUMED_CALIBRATION"), (49.9, "EVALUATED_RANGE_TOO_SHORT"),
    (0.0, "EVALUATION_REGION_INVALID"),
])
def test_assumed_clear(reach, reason):
    out = check(Monitor(TemporalConfig(assumed_clear=True)).step(frame(trust="ASSUMED", reach=reach)))
    assert out["reason"] == reason


def test_two_confirmations_keep_one_track():
    m = Monitor(TemporalConfig(confirm_hits=2, confirm_window=3))
    first = check(m.step(frame(1, [candidate(50)], speed=10, ego=True)))
    second = check(m.step(frame(2, [candidate(49)], speed=10, ego=True)))
    assert first["reason"] == "CANDIDATE_UNCONFIRMED"
    assert (second["state"], second["distance_m"], second["tracks"][0]["id"]) == ("OBSTACLE", 48.75, 1)


def test_confirmed_track_coasts_then_is_released():
    m = Monitor(TemporalConfig(confirm_hits=2, confirm_window=3, release_misses=3))
    for step, x in ((1, 40), (2, 39)):
        m.step(frame(step, [candidate(x)], speed=10, ego=True))
    for miss in (1, 2):
        out = check(m.step(frame(2 + miss, speed=10, ego=True)))
        assert out["distance_m"] == pytest.approx(38.75 - miss) and out["reason"] == "OBSTACLE_COASTING"
    assert m.step(frame(5, speed=10, ego=True))["state"] == "NO_OBSTACLE_DETECTED"


def test_failed_frame_leaves_tracks_alone_and_equal_stamp_is_no_evidence():
    m = Monitor(TemporalConfig(confirm_hits=2, confirm_window=2))
    m.step(frame(1, [candidate(30)]))
    again = m.step(frame(1, [candidate(30)]))
    assert again["reason"] == "CANDIDATE_UNCONFIRMED" and again["tracks"][0]["age"] == 1
    failed = m.step(frame(2, status=3, reason="GROUND_UNSUPPORTED"))
    assert failed["tracks"][0]["age"] == 1
    assert m.step(frame(2, [candidate(30)]))["state"] == "OBSTACLE"


def test_pause_and_step_back_clear_tracks_but_ids_go_on():
    m = Monitor(TemporalConfig())
    m.step(frame(10, [candidate(30)]))
    assert m.step(frame(20, [candidate(30)]))["tracks"][0]["id"] == 2
    assert m.step(frame(5, [candidate(30)]))["tracks"][0]["id"] == 3


def test_edge_evidence_retracts_when_drifting_out():
    m = Monitor(TemporalConfig(edge_retracts=True))
    for step, (offset, edge) in enumerate([(0.2, False), (0.3, False), (0.4, True)], 1):
        out = m.step(frame(step, [candidate(30, edge=edge, offset=offset)]))
    assert not out["tracks"][0]["confirmed"] and out["reason"] == "CANDIDATE_UNCONFIRMED"


def test_far_and_gauge_rules_and_standstill():
    far = Monitor(TemporalConfig(far_confirm_hits=2, far_confirm_window=2, far_confirm_from_m=70))
    assert far.step(frame(1, [candidate(75)]))["state"] == "UNKNOWN"
    assert far.step(frame(2, [candidate(75)]))["state"] == "OBSTACLE"
    gauge = Monitor(TemporalConfig(motion_gauge_speed_mps=3))
    assert gauge.step(frame(1, [candidate(30)], speed=5, ego=True))["state"] == "UNKNOWN"
    assert gauge.step(frame(2, [candidate(29.5, channels=2)], speed=5, ego=True))["state"] == "OBSTACLE"
    still = Monitor(TemporalConfig(confirm_hits=3, confirm_window=3, still_speed_mps=0.5))
    assert still.step(frame(1, [candidate(30, points=50)], ego=True))["state"] == "OBSTACLE"


def test_track_cap_keeps_confirmed_ones():
    m = Monitor(TemporalConfig(confirm_hits=2, confirm_window=2, max_tracks=3))
    m.step(frame(1, [candidate(10), candidate(20)]))
    out = m.step(frame(2, [candidate(10), candidate(20), *[candidate(60 + 10 * i) for i in range(4)]]))
    assert len(out["tracks"]) == 3 and sum(t["confirmed"] for t in out["tracks"]) == 2
    assert out["tracks"][2]["distance_m"] == 59.75


def test_state_survives_dump_and_load():
    cfg = TemporalConfig(confirm_hits=2, confirm_window=3, release_misses=2)
    whole, parts = Monitor(cfg), Monitor(cfg)
    for step in range(1, 12):
        seen = [candidate(50 - step)] if step % 3 else []
        a = whole.step(frame(step, seen, speed=10, ego=True))
        parts = Monitor(cfg).load(parts.dump())
        assert parts.step(frame(step, seen, speed=10, ego=True)) == a


def curve(*minima):
    e = [0.10] * 51
    for shift, depth in minima:
        e = [min(v, 0.10 - depth * max(0.0, 1.0 - abs(i - shift) / 3)) for i, v in enumerate(e)]
    return e


def feed(tracker, errors, frames):
    for _ in range(frames):
        step = tracker.update(errors, 0.1)
    return step


def test_speed_is_acquired_on_the_third_frame():
    t = SpeedTracker(0.005)
    assert not feed(t, curve((32, 0.02)), 2)[0]
    valid, moved = feed(t, curve((32, 0.02)), 1)
    assert valid and moved / 0.1 == 16.0
    doubtful = SpeedTracker(0.005)
    feed(doubtful, curve((32, 0.02), (12, 0.018)), 10)
    assert not doubtful.known


def test_speed_alias_escape_slew_and_standstill():
    t = SpeedTracker(0.005)
    feed(t, curve((32, 0.02)), 3)
    assert feed(t, curve((12, 0.03), (32, 0.01)), 16)[1] / 0.1 == pytest.approx(16.0, abs=0.5)
    t = SpeedTracker(0.005)
    feed(t, curve((32, 0.02)), 3)
    assert feed(t, curve((12, 0.03)), 24) == (True, pytest.approx(1.6))
    assert feed(t, curve((12, 0.03)), 1)[1] / 0.1 == pytest.approx(6.0)
    t = SpeedTracker(0.005)
    feed(t, curve((32, 0.02)), 3)
    assert feed(t, curve((30, 0.02)), 1)[1] / 0.1 == pytest.approx(15.8)
    t = SpeedTracker(0.005)
    assert feed(t, curve((0, 0.06)), 3) == (True, 0.0)
    assert feed(t, curve((0, 0.02), (6, 0.04)), 3)[1] / 0.1 == pytest.approx(3.0)
    t = SpeedTracker(0.005)
    feed(t, curve((32, 0.02)), 3)
    for _ in range(200):
        valid, moved = t.update(curve((0, 0.02)), 0.1)
        assert not valid or moved / 0.1 > 10
    t = SpeedTracker(0.005)
    feed(t, curve((32, 0.02)), 3)
    assert not t.update([], 0.1)[0] and t.known and t.speed == 16.0


def test_order_gate():
    g = OrderGate()
    steps = [
        (("", 1, 1, 5), (False, False, "INVALID_SOURCE_ID")), (("a", 1, 1, None), (False, False, "INVALID_STAMP")),
        (("a", 1, 0, 5), (False, False, "INVALID_SEQUENCE")), (("a", 1, 1, 5), (True, True, "FIRST_SOURCE")),
        (("a", 1, 1, 6), (False, False, "DUPLICATE_OR_LATE_SEQUENCE")),
        (("a", 1, 2, 4), (False, False, "STAMP_WENT_BACKWARDS")), (("a", 1, 2, 5), (True, False, "IN_ORDER")),
        (("a", 2, 1, 1), (True, True, "NEW_SESSION")), (("a", 1, 9, 9), (False, False, "OLD_SESSION")),
        (("b", 1, 1, 1), (True, True, "NEW_SOURCE")), (("a", 3, 1, 9), (False, False, "RETIRED_SOURCE")),
    ]
    for key, verdict in steps:
        assert g.admit(*key) == verdict
        g = OrderGate().load(g.dump())


def test_batch_gate_equals_the_one_that_is_stepped(spark):
    rng, rows = random.Random(3), []
    for line in range(4):
        gate = OrderGate()
        for n in range(300):
            key = (rng.choice(["a", "b", "c", "", None, "d"]) if n > 20 else "a", n // 40 + rng.choice([0, 0, 0, 1, -1]),
                   rng.choice([0, n, n, n, n - 5, n + 9]), rng.choice([None, n, n, n, n - 7, n + 8]))
            rows.append((line, n, *key, *gate.admit(*key)))
    kinds = "line int, received long, source string, session long, sequence long, stamp_ns long"
    frames = spark.createDataFrame([r[:6] for r in rows], kinds)
    found = sorted(map(tuple, gate_frames(frames).select(
        "line", "received", "accepted", "reset", "gate_reason").collect()))
    assert found == [(*r[:2], *r[6:]) for r in rows] and len({r[8] for r in rows}) >= 9


def test_config_bounds():
    with pytest.raises(ConfigError):
        TemporalConfig(confirm_hits=2, confirm_window=1)
    with pytest.raises(ConfigError):
        TemporalConfig(max_tracks=0)
