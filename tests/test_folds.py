"""Chains cut in any way give the rows of one run over them."""

import random

import pytest

from pathclear.functions.ordering import SlicedOrder
from pathclear.operators import folds


def one_run(rows, hold):
    """Floor hold frame by frame."""
    kept, age, failures, life, out = None, 0, 0, 0, []
    for r in rows:
        short = not r["floor_valid"] or r["end_x"] < 25
        held = bool(short and kept and age < hold and r["detection_point_count"])
        mine, reason, before = (r["a"], r["end_x"]), None, life
        if held:
            mine, age, failures = kept, age + 1, 0
        elif short or not r["detection_point_count"]:
            reason = "CORRIDOR_UNOBSERVABLE" if r["floor_valid"] else "GROUND_UNSUPPORTED"
            failures += 1
            if failures > 5:
                kept, age, failures, life = None, 0, 0, life + 1
        else:
            kept, age, failures = mine, 0, 0
        out.append((r["n"], held, before, reason, *mine))
    return out


def floor_rows(seed, n, fresh):
    rng = random.Random(seed)
    return [{"chain": None if seed == 3 else seed, "n": i, "a": float(i), "b": 0.0, "c": 0.0, "end_x": 30.0 if rng.random() < fresh else 20.0,
             "floor_valid": rng.random() < 0.8, "detection_point_count": int(rng.random() < 0.6)} for i in range(n)]


@pytest.mark.parametrize(("bounds", "hold"), [([], 1), ([7, 8, 40, 41, 42, 90, 150, 151], 4), (list(range(0, 200, 25)), 0)])
def test_held_floors(spark, bounds, hold):
    chains = [floor_rows(s, 200, f) for s, f in ((1, 0.5), (2, 0.1), (3, 0.0), (4, 0.05), (5, 1.0))]
    df = spark.createDataFrame([r for c in chains for r in c], "chain int, n int, a double, b double, c double, end_x double, floor_valid boolean, detection_point_count int")
    order = SlicedOrder(["chain"], ["n"], bounds)
    got = {}
    for r in folds.hold_floors(df, ["chain"], ["n"], hold, order).collect():
        got.setdefault(r.chain, []).append((r.n, r.held, r.life, r.geometry_reason, r.a, r.end_x))
    for rows in chains:
        assert sorted(got[rows[0]["chain"]]) == one_run(rows, hold)


def curve_rows(seed, n):
    """Dips that wander with the speed, with gaps and frames of noise."""
    rng, rows, speed = random.Random(seed), [], rng_speed(seed)
    for i in range(n):
        speed += rng.uniform(-0.1, 0.1)
        at = speed * 0.1 / 0.05
        errors = [min(0.2, 0.02 * abs(s - at)) + rng.uniform(0, 0.004) for s in range(40)]
        if rng.random() < 0.1 or 200 < i < 330:
            errors = [rng.choice([None, 0.2]) for _ in range(40)]
        rows.append((seed, i, errors if rng.random() > 0.02 else None, 0.1 if rng.random() > 0.02 else 0.0,
                     rng.random() < 0.9, 0.0, rng.uniform(-0.01, 0.01), rng.uniform(-1e-4, 1e-4), rng.random() < 0.97))
    return rows


def rng_speed(seed):
    return 3.0 + seed * 4


MOTION = "chain int, n int, errors array<double>, dt_s double, route_valid boolean, raw_c0 double, raw_c1 double, raw_c2 double, motion boolean"


def test_speed_and_route_do_not_depend_on_the_cut(spark):
    rows = curve_rows(0, 700) + curve_rows(1, 90) + curve_rows(2, 1)
    df = spark.createDataFrame(rows, MOTION)
    want = []
    for seed in range(3):
        step = folds.MotionStep(None, 0.005, 0.6)
        way = epoch = last = 0
        for _, i, errors, dt, valid, *raw, motion in (r for r in rows if r[0] == seed):
            good, moved, speed, *line = step(motion, errors, dt, valid, *raw)
            way, last = way + (moved if good else 0), speed if good else last
            epoch += motion and not good
            want.append((seed, i, good, *line, epoch, last < 0.5, way))
    for slice_rows in (2000, 97):
        got = folds.motion_and_route(df, ["chain"], ["n"], 0.005, 0.6, slice_rows).collect()
        got = sorted((r.chain, r.n, r.ego_motion_valid, r.c0, r.c1, r.c2, r.epoch, r.stood_still, r.odometry_m) for r in got)
        assert [g[:-1] for g in got] == [w[:-1] for w in want]
        assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want])
    assert sum(w[2] for w in want) > 400 and want[-92][6] > 3


def test_slices_agree_after_a_few_rounds(spark):
    df = spark.createDataFrame(curve_rows(1, 900), MOTION)
    rounds = []
    cut = folds.speed_track(df, ["chain"], ["n"], 0.005, 100, rounds).orderBy("n").collect()
    whole = folds.speed_track(df, ["chain"], ["n"], 0.005).orderBy("n").collect()
    assert [(r.valid, r.moved_m, r.speed_mps) for r in cut] == [(r.valid, r.moved_m, r.speed_mps) for r in whole]
    assert rounds[0] == 9 and rounds[1] == 8 and sum(rounds[2:]) <= 8, rounds


def test_empty_chains(spark):
    empty = spark.createDataFrame([], MOTION)
    assert folds.motion_and_route(empty, ["chain"], ["n"], 0.005, 0.6).count() == 0
