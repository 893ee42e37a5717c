"""Synthetic obstacles: rays, plans and annotations; region verification."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pathclear.functions.ordering import SlicedOrder
from pathclear.operators import annotate, synthetic

S = 1_000_000_000


def test_rays_move_hidden_returns_and_fill_empty_cells(spark):
    pts = spark.createDataFrame([(40.0, 0.0, 0.0), (10.0, 0.0, 0.0), (40.0, 5.0, 0.0), (-40.0, 0.0, 0.0)], "x double, y double, z double")
    moved = {r["x"]: r for r in synthetic.occlude(pts.filter("y = 0"), (20.0, -1.0, -1.0), (21.0, 1.0, 1.0)).collect()}
    assert moved[40.0]["hidden"] and moved[40.0]["moved_x"] == 20.0
    assert not moved[10.0]["hidden"] and not moved[-40.0]["hidden"] and moved[10.0]["moved_x"] == 10.0
    cells = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], "dx double, dy double, dz double")
    assert [r["x"] for r in synthetic.fill_empty(cells, (20.0, -1.0, -1.0), (21.0, 1.0, 1.0)).collect()] == [20.0]
    assert synthetic.fill_empty(cells, (220.0, -1.0, -1.0), (221.0, 1.0, 1.0)).count() == 0


def test_plan_ends_at_the_final_distance_and_is_annotated(spark):
    speeds = [0, 0, 10, 10, 10, 0, 0]
    rows = spark.createDataFrame(
        [("b", i * S, float(v), [0.0, 0.0, 1.0, 1.9]) for i, v in enumerate(speeds)],
        "bag_id string, bag_stamp_ns long, ego_speed_mps double, ground_plane array<double>")
    order = SlicedOrder(["bag_id"], ["bag_stamp_ns"], [])
    plan = {r["bag_stamp_ns"] // S: r["x_center"] for r in synthetic.plan_obstacle(rows, order, 3 * S, 15.0).collect()}
    assert plan == {1: 45.0, 2: 35.0, 3: 25.0, 4: 15.0}
    log = spark.createDataFrame([("b", i * S, 4 + 4 * i, 45.0 - 10 * i) for i in range(4)],
                                "bag_id string, bag_stamp_ns long, hidden_points int, distance_m double")
    found = sorted((r["label"], r["start_ns"] // S, r["end_ns"] // S)
                   for r in synthetic.injection_annotation(log, ["bag_id"]).collect())
    assert found == [("negative", 0, 2), ("positive", 2, 3)]


def test_region_verification(spark):
    refs = spark.createDataFrame(
        [("ok", [19.0, -3.0, -1.0], [22.0, 3.0, 2.0], 20.0, 0.1), ("dirty", [19.0, -3.0, -1.0], [22.0, 3.0, 2.0], 20.0, 0.1)],
        "ref string, lo array<double>, hi array<double>, reference_m double, uncertainty_m double")
    pts = spark.range(120).select(F.explode(F.array(F.lit("ok"), F.lit("dirty"))).alias("ref"),
                                  (20 + F.col("id") / 200).alias("x"), (F.col("id") % 3 - 1.0).alias("y"), F.lit(0.0).alias("z"))
    empty = spark.createDataFrame([("dirty", 20.5, 0.0, 0.0), ("ok", 50.0, 0.0, 0.0)], "ref string, x double, y double, z double")
    cand = spark.createDataFrame([(r, [20.3, 0.0, 0.5], 20.05) for r in ("ok", "dirty")],
                                 "ref string, center array<double>, distance_m double")
    found = {r["ref"]: r for r in annotate.verify_roi(refs, pts, empty, cand).collect()}
    assert found["ok"]["passed"] and not found["dirty"]["passed"]
    assert found["ok"]["points"] == 120 and found["ok"]["nearest"] == pytest.approx(20.0)


def test_floor_keeps_a_slice_at_the_residual_limit(spark):
    # The residual of one slice is 0.2 m in real numbers; it stays, and every fit is that of all slices.
    xs, rows, expected = [4 + 2 * i for i in range(28)], [], {}
    mean = Fraction(sum(xs), len(xs))
    spread = sum((x - mean) ** 2 for x in xs)
    for frame in range(60):
        at = frame % len(xs)
        share = Fraction(1, len(xs)) + (xs[at] - mean) ** 2 / spread
        lift = float(Fraction(1, 5) / (1 - share))
        zs = [-1.5 + 0.01 * frame + (lift if i == at else 0.0) for i in range(len(xs))]
        expected[frame] = float((xs[at] - mean) / spread) * lift
        rows += [(frame, x - 0.5, 0.0, z) for x, z in zip(xs, zs) for _ in range(5)]
    points = spark.createDataFrame(rows, "frame_seq int, x double, y double, z double").repartition(7)
    found = {r.frame_seq: r.slope for r in synthetic.estimate_floor(points, ["frame_seq"], 5).collect()}
    assert found == pytest.approx(expected, abs=1e-9)
