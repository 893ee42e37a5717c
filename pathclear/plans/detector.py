"""Batch detector: clouds in, candidates and evaluated range per frame out.

Stages run on whole tables.  Points are partitioned by frame once and settled; every later stage
joins per-frame parameters to them on the same keys, so points move a single time.  Only scalars
per frame pass through the two ordered folds (floor hold, speed and route), keyed by chain: a
session is cut into independent chains wherever the detector state is reset.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathclear.config import DetectorConfig
from pathclear.functions import geometry as g
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.ranks import array_upper_median
from pathclear.functions.settling import settle, settle_by
from pathclear.operators import background as bg
from pathclear.operators import candidates as cand
from pathclear.operators import folds, graph, grids, route
from pathclear.operators import points as ops
from pathclear.operators.floor import sampled_floor, shift_curve
from pathclear.schemas import CANDIDATE, FRAME_KEY as KEY

CHAIN = ["source", "session", "chain"]
LIFE = [*CHAIN, "life"]
MAX_GAP_NS = 2_000_000_000


def unfold(frames: DataFrame, config: DetectorConfig) -> DataFrame:
    """One row per raw point of every frame that may be transformed.

    Frames are spread before they grow.  Where a profile sets ``max_points``, a frame beyond it is
    refused before it is unfolded.
    """
    count = F.coalesce(F.size("points"), F.lit(0))
    usable = frames.filter(
        (F.lit(True) if config.max_points is None else count <= config.max_points) & F.col("transform_available")
        & g.valid_rotation(F.col("rotation"), F.col("translation"))
    )
    turn = [F.get("rotation", i).alias(f"r{i}") for i in range(9)]
    move = [F.get("translation", i).alias(f"t{i}") for i in range(3)]
    spread = usable.select(*KEY, *turn, *move, "points").repartition(*KEY)
    return spread.select(
        *KEY, *[f"r{i}" for i in range(9)], *[f"t{i}" for i in range(3)],
        F.posexplode("points").alias("raw_index", "p"),
    ).select(
        *KEY, "raw_index", *[f"r{i}" for i in range(9)], *[f"t{i}" for i in range(3)],
        *[F.col(f"p.{c}").alias(f"s{c}") for c in "xyz"],
    )


def frame_rows(frames: DataFrame) -> DataFrame:
    """Frames without their points."""
    return frames.select(
        *KEY, "measurement_time_ns", "transform_available", "calibration_verified",
        "allow_unverified_calibration", "translation",
        F.coalesce(F.size("points"), F.lit(0)).alias("point_count"),
        g.valid_rotation(F.col("rotation"), F.col("translation")).alias("transform_valid"),
    )


def admission(rows: DataFrame, points: DataFrame, config: DetectorConfig) -> DataFrame:
    """Frames with counters, trust and the first reason that keeps them from the detector."""
    counts = ops.count_fates(points, KEY)
    meta = rows.join(counts, KEY, "left").na.fill(0, [c for c in counts.columns if c.endswith("_count")])
    reason = ops.admission_reason(
        F.col("point_count"), config.max_points, F.col("transform_available"),
        F.col("transform_valid"), F.col("overflow_count") > 0, F.col("calibration_verified"),
        F.col("allow_unverified_calibration"), F.col("geometry_point_count"),
    )
    trust = ops.calibration_trust(
        F.col("calibration_verified"), F.col("allow_unverified_calibration")
    )
    late = F.col("stop_reason").isin("POINT_LIMIT_EXCEEDED", "EMPTY_INPUT", "TF_UNAVAILABLE", "INVALID_TRANSFORM")
    return meta.withColumn("stop_reason", reason).withColumns({
        "calibration_trust": F.when(late, "UNKNOWN").otherwise(trust),
        "stop_status": ops.admission_status(F.col("stop_reason")),
        "transform_applied": ~F.coalesce(late, F.lit(False)),
    })


def chains(meta: DataFrame) -> DataFrame:
    """Cuts sessions where the detector starts afresh: refused frames, steps back, long pauses."""
    order = SlicedOrder.fit(
        meta.select("source", "session", "frame_sequence"), ["source", "session"], ["frame_sequence"]
    )
    stopped = F.when(F.col("stop_reason").isNotNull(), 1).otherwise(0)
    df = order.running_sum(meta.withColumn("_stop", stopped), {"stops": F.col("_stop")})
    df = order.finish(df)
    inner = SlicedOrder(["source", "session", "stops"], ["frame_sequence"], order.bounds, order.hot)
    stamp = F.when((F.col("_stop") == 0) & (F.col("measurement_time_ns") != 0), F.col("measurement_time_ns"))
    df = inner.last_known(df, {"_last": stamp}, inclusive=False)
    gap = F.col("measurement_time_ns") - F.col("_last")
    jump = (F.col("_stop") == 0) & (F.col("measurement_time_ns") != 0) & ((gap <= 0) | (gap > MAX_GAP_NS))
    df = inner.finish(df).withColumn("_cut", F.col("_stop") + F.coalesce(jump, F.lit(False)).cast("int"))
    df = order.running_sum(df, {"chain": F.col("_cut")})
    return order.finish(df).drop("_stop", "_last", "_cut", "stops")


def _plane():
    return F.col("a"), F.col("b"), F.col("c")


def _h():
    return g.height(F.col("x"), F.col("y"), F.col("z"), _plane())


def _each(array: str, field: str):
    """One field of an array of structs."""
    return F.transform(array, lambda item: item[field])


def floors(points: DataFrame, config: DetectorConfig) -> DataFrame:
    """Fitted plane and its followed reach per frame."""
    planes = settle(sampled_floor(points, KEY, config))
    with_plane = points.join(planes, KEY)
    reach = grids.floor_reach(grids.floor_bins(with_plane, KEY, _h(), config), KEY, config)
    return planes.join(reach, KEY, "left").na.fill({"inliers": 0, "max_supported_x": 2.0})


def hold_floor(meta: DataFrame, floor: DataFrame, config: DetectorConfig) -> DataFrame:
    """Plane to use per admitted frame, with life and failure reason."""
    rows = meta.filter(F.col("stop_reason").isNull()).join(floor, KEY, "left")
    reach = F.coalesce(F.col("max_supported_x"), F.lit(0.0))
    rows = rows.select(
        *CHAIN, "frame_sequence", "measurement_time_ns", "translation", "detection_point_count",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "abc"],
        F.col("a").isNotNull().alias("floor_valid"), F.coalesce("inliers", F.lit(0)).alias("inliers"),
        F.least(F.lit(float(config.detection_roi.high[0])), reach + 3.0).alias("end_x"),
    )
    # Chains are measured on the settled frames, not on the floors that are yet to be fitted.
    admitted = meta.filter(F.col("stop_reason").isNull()).select(*CHAIN, "frame_sequence")
    order = SlicedOrder.fit(admitted, CHAIN, ["frame_sequence"])
    return folds.hold_floors(rows, CHAIN, ["frame_sequence"], config.ground_hold_frames, order)


def motion_inputs(used: DataFrame, points: DataFrame, config: DetectorConfig, order: SlicedOrder) -> DataFrame:
    """Error curve against the previous analysable frame and the raw route, per frame."""
    near = points.join(used.select(*KEY, "a", "b", "c"), KEY)
    ys = (
        near.withColumn("h", _h())
        .filter(
            (F.col("x") >= grids.WALL_MIN_X) & (F.abs("y") <= 12) & F.col("h").between(0.5, 2.5)
            & (F.col("x") < min(config.detection_roi.high[0], 150.0))
        )
        .groupBy(*KEY, grids.trunc(F.col("x") - grids.WALL_MIN_X).alias("slice"))
        .agg(F.array_sort(F.collect_set(F.col("y").cast("float"))).alias("ys"))
        .groupBy(*KEY).agg(F.collect_list(F.struct("slice", "ys")).alias("walls"))
    )
    # Settled: rails and the rest read a finished route, not its expression over and over.
    found = settle(route.follow_walls(used.join(ys, KEY, "left"), "walls", config).drop("walls"))
    rows = found.select(
        *LIFE, "frame_sequence", "measurement_time_ns",
        F.col("raw.valid").alias("route_valid"), F.col("raw.max_x").alias("route_max_x"),
        *[F.col(f"raw.{c}").alias(f"raw_{c}") for c in ("c0", "c1", "c2")],
        F.col("raw.shifts").alias("shifts"), F.lit(0).alias("rail_slices"),
    )
    if config.rail_route_weight > 0 and config.sensor_height_above_rail_m > 0:
        rows = _with_rails(rows, used, points, config)
    rows = rows.drop("shifts")
    if not (config.background_history_frames and config.ego_motion_compensation):
        return rows.withColumns({
            "errors": F.lit(None).cast("array<double>"), "dt_s": F.lit(0.0), "motion": F.lit(False)
        })
    samples = grids.profile_points(near, _h())
    medians = samples.groupBy(*KEY, "section").agg(
        array_upper_median(F.collect_list("lateral")).alias("median")
    )
    bins = grids.lateral_profile(samples, medians, KEY)
    flat = (F.col("row") * grids.PROFILE_BINS + F.col("bin")).cast("int")
    profile = bins.groupBy(*KEY).agg(
        F.collect_list(F.struct(flat.alias("k"), F.col("value").alias("v"))).alias("m")
    ).select(*KEY, F.struct(
        _each("m", "k").alias("at"), _each("m", "v").alias("value")
    ).alias("profile"))
    rows = order.running_sum(rows, {"place": F.lit(1)})
    stamp = F.when(F.col("measurement_time_ns") != 0, F.col("measurement_time_ns"))
    rows = order.finish(order.last_known(rows, {"_before": stamp}, inclusive=False))
    dt = F.when(F.col("measurement_time_ns") > F.col("_before"),
                (F.col("measurement_time_ns") - F.col("_before")) * 1e-9).otherwise(0.0)
    rows = rows.withColumn("dt_s", F.coalesce(dt, F.lit(0.0))).drop("_before")
    nothing = F.struct(
        F.array().cast("array<int>").alias("at"), F.array().cast("array<float>").alias("value")
    )
    placed = rows.join(profile, KEY, "left").withColumn("profile", F.coalesce("profile", nothing))
    # The previous profile is found by its place, not by a window: profiles are wide rows.
    earlier = placed.select(*LIFE, (F.col("place") + 1).alias("place"), F.col("profile").alias("then"))
    last = bg.max_shift(F.col("dt_s"), config.ego_max_speed_mps)
    last = F.when((F.col("dt_s") > 0) & (last >= 4) & F.col("then").isNotNull(), last)
    paired = placed.join(earlier, [*LIFE, "place"], "left")
    return paired.withColumns({
        "errors": shift_curve(
            F.col("profile.at"), F.col("profile.value"), F.col("then.at"), F.col("then.value"),
            last.cast("double"),
        ),
        "motion": F.lit(True),
    }).drop("profile", "then", "place")


def _with_rails(rows, used, points, config):
    """Route refitted to the rails seen near the lidar."""
    params = rows.join(used.select(*KEY, "a", "b", "c", "translation"), KEY)
    t = [F.get("translation", i) for i in range(3)]
    level = g.height(*t, _plane()) - config.sensor_height_above_rail_m
    p = points.join(
        params.select(*KEY, "a", "b", "c", "raw_c0", "raw_c1", "raw_c2", level.alias("rail_height")), KEY
    )
    line = (F.col("raw_c0"), F.col("raw_c1"), F.col("raw_c2"))
    p = p.withColumns({"h": _h(), "offset": g.route_offset(F.col("x"), F.col("y"), line)})
    rails = route.rail_shifts(p, KEY, F.col("rail_height")).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("slice", "shift", "weight"))).alias("rails")
    )
    raw = F.struct(
        F.col("raw_c0").alias("c0"), F.col("raw_c1").alias("c1"), F.col("raw_c2").alias("c2"),
        F.col("route_valid").alias("valid"), "shifts",
    )
    refit = route.refit_with_rails(
        raw, F.col("rails"), F.lit(config.rail_route_weight), F.lit(config.route_min_radius_m)
    )
    out = rows.join(rails, KEY, "left").withColumn("refit", refit)
    return out.withColumns({
        **{f"raw_{c}": F.col(f"refit.{c}") for c in ("c0", "c1", "c2")},
        "rail_slices": F.col("refit.rail_slices"),
    }).drop("refit", "rails")


def _line():
    return F.col("c0"), F.col("c1"), F.col("c2")


def _origin():
    return [F.get("translation", i) for i in range(3)]


def placed_points(points: DataFrame, params: DataFrame, config: DetectorConfig) -> DataFrame:
    """Detection points with height, offset, range, angular cell and evidence tests."""
    wanted = [*KEY, "a", "b", "c", "c0", "c1", "c2", "route_valid", "route_max_x", "end_x", "far_end",
              "band_min", "gauge_min", "translation"]
    p = points.filter("in_detection").join(params.select(*wanted), KEY)
    ox, oy, oz = _origin()
    p = p.withColumns({
        "h": _h(), "soff": g.route_offset(F.col("x"), F.col("y"), _line()),
        "dx": F.col("x") - ox, "dy": F.col("y") - oy, "dz": F.col("z") - oz,
    })
    p = p.withColumns({
        "off": F.abs("soff"), "range": g.norm(F.col("dx"), F.col("dy"), F.col("dz")),
        "az": g.azimuth_cell(F.col("dx"), F.col("dy"), config.angular_cell_deg),
        "el": g.elevation_cell(F.col("dx"), F.col("dy"), F.col("dz"), config.angular_cell_deg),
    })
    band, gauge = ops.evidence(
        F.col("x"), F.col("off"), F.col("h"), config, F.col("end_x"), F.col("route_valid"),
        F.col("route_max_x"), F.col("far_end"), F.col("band_min"), F.col("gauge_min"),
    )
    positive = F.col("range") > 0
    in_history = (
        (F.col("x") >= config.detection_roi.low[0]) & (F.col("off") <= config.band_half_width_m)
        & F.col("h").between(-0.5, config.corridor_height_m)
    )
    near_gauge = (
        F.col("route_valid") & F.lit(config.static_channel) & (F.col("off") <= config.gauge_half_width_m)
        & (F.col("h") >= F.col("gauge_min")) & (F.col("h") <= config.gauge_max_height_m)
    )
    return p.withColumns({
        "in_band": band & positive, "in_gauge": gauge & positive, "in_history": in_history,
        "gauge_near": near_gauge, "origin_x": ox,
    }).select(
        *KEY, "raw_index", "x", "y", "z", "h", "soff", "off", "range", "az", "el", "in_band",
        "in_gauge", "in_history", "gauge_near", "origin_x", "end_x", "route_valid",
    )


def frame_parameters(used: DataFrame, moved: DataFrame, config: DetectorConfig) -> DataFrame:
    """One row per analysable frame with everything the point stages need."""
    rows = used.join(moved.drop("measurement_time_ns", *CHAIN[2:], "life"), KEY)
    below = g.height(*_origin(), _plane())
    band_min, gauge_min = ops.evidence_limits(config, below)
    straight = F.lit(True)
    if config.far_gauge_max_curvature > 0:
        straight = 2 * F.abs("c2") <= config.far_gauge_max_curvature
    far = F.least(
        F.lit(config.far_gauge_max_x_m), F.lit(float(config.detection_roi.high[0])), F.col("route_max_x")
    )
    return rows.withColumns({
        "band_min": band_min, "gauge_min": gauge_min,
        "far_end": F.when(straight & F.col("route_valid"), far).otherwise(0.0),
    })


def push_order(params: DataFrame, empty_held: DataFrame | None) -> DataFrame:
    """Adds ``pushed`` (enters the history) and ``ordinal`` (frames pushed before it)."""
    if empty_held is None:
        rows = params.withColumn("_skip", F.lit(False))
    else:
        rows = params.join(empty_held.withColumn("_skip", F.lit(True)), KEY, "left").withColumn(
            "_skip", F.coalesce("_skip", F.lit(False))
        )
    order = SlicedOrder.fit(rows, LIFE, ["frame_sequence"])
    pushed = F.when(F.col("_skip"), 0).otherwise(1)
    rows = order.running_sum(rows.withColumn("pushed", pushed), {"ordinal": F.col("pushed")})
    return order.finish(rows).withColumn("ordinal", F.col("ordinal") - F.col("pushed")).drop("_skip")


def history_links(asking: DataFrame, params: DataFrame, config: DetectorConfig) -> DataFrame:
    """Usable baseline frames of every asking frame (all past their warm-up), with the odometry shift."""
    n, lag = config.background_history_frames, config.background_lag_frames
    asked = asking.select(
        *KEY, "chain", "life", "ordinal", "odometry_m", "epoch", "stood_still",
        F.explode(F.sequence(F.col("ordinal") - n, F.col("ordinal") - lag - 1)).alias("past"),
    )
    past = params.filter("pushed = 1").select(
        *LIFE, F.col("ordinal").alias("past"), F.col("odometry_m").alias("past_odometry"),
        F.col("epoch").alias("past_epoch"), F.col("frame_sequence").alias("past_sequence"),
    )
    pairs = asked.join(past, [*LIFE, "past"])
    same = F.col("epoch") == F.col("past_epoch")
    if not config.ego_motion_compensation:
        return pairs.withColumn("shift", F.lit(0.0))
    shift = F.when(same, F.col("odometry_m") - F.col("past_odometry")).otherwise(0.0)
    return pairs.filter(same | F.col("stood_still")).withColumn("shift", shift)


def history_image(placed: DataFrame) -> DataFrame:
    """Nearest return per angular cell of the background's region, and whether evidence is asked of it."""
    xyz = F.struct("range", "raw_index", "x", "y", "z")
    return placed.filter("in_history").groupBy(*KEY, "az", "el").agg(
        F.min(xyz).alias("p"), F.bool_or("in_band").alias("asked")
    ).select(*KEY, "az", "el", "asked", "p.range", "p.x", "p.y", "p.z")


def foreground_cells(image, params, links, config: DetectorConfig) -> DataFrame:
    """Cells of the frames ``params`` whose nearest return is nearer than the moved background, or newly occupied."""
    current = image.filter("asked").join(params.select(*KEY), KEY, "left_semi").withColumnRenamed("frame_sequence", "ordinal")
    pairs = links.select(
        "source", "session", F.col("frame_sequence").alias("ordinal"),
        F.col("past_sequence").alias("past"), "shift",
    )
    origins = params.select("source", "session", F.col("frame_sequence").alias("ordinal"), "translation")
    past = image.withColumnRenamed("frame_sequence", "ordinal")
    chain = ["source", "session"]
    here = current.join(origins, [*chain, "ordinal"])
    found = bg.history_clearance(
        here, pairs, past, chain, config.angular_cell_deg, float(config.detection_roi.high[0]),
        tuple(_origin()),
    )
    votes = bg.foreground_vote(found, chain, config.background_margin_m, config.background_relative_margin)
    moving = pairs.groupBy(*chain, "ordinal").agg(F.bool_or(F.col("shift") > 0).alias("moved"))
    cells = current.join(moving, [*chain, "ordinal"]).join(
        votes, [*chain, "ordinal", "az", "el"], "left"
    )
    new = F.col("votes").isNull() & ~F.col("moved")
    front = F.coalesce(F.col("foreground"), F.lit(False)) | new
    return cells.filter(front).select(
        "source", "session", F.col("ordinal").alias("frame_sequence"), "az", "el"
    )


def evidence_cells(placed: DataFrame, front: DataFrame | None) -> DataFrame:
    """Cells with evidence: nearest range, channels and whether band points count."""
    per = placed.filter(F.col("in_band") | F.col("in_gauge")).groupBy(*KEY, "az", "el").agg(
        F.min(F.when(F.col("in_gauge"), F.col("range"))).alias("gauge_range"),
        F.min(F.when(F.col("in_band"), F.col("range"))).alias("band_range"),
    )
    if front is None:
        per = per.withColumn("motion", F.col("band_range").isNotNull())
    else:
        per = per.join(front.withColumn("motion", F.lit(True)), [*KEY, "az", "el"], "left").withColumn(
            "motion", F.coalesce("motion", F.lit(False)) & F.col("band_range").isNotNull()
        )
    gauge = F.col("gauge_range").isNotNull()
    channels = F.when(F.col("motion"), ops.MOTION).otherwise(0) + F.when(gauge, ops.GAUGE).otherwise(0)
    nearest = F.when(F.col("motion"), F.least("gauge_range", "band_range")).otherwise(F.col("gauge_range"))
    return per.filter(F.col("motion") | gauge).select(
        *KEY, "az", "el", nearest.alias("cell_range"), channels.alias("cell_channels"), "motion"
    )


def judged_components(placed, points, cells, params, config: DetectorConfig):
    """Components with features and their rejection reason (null for candidates)."""
    cells = settle(graph.cell_components(
        cells.withColumnRenamed("cell_range", "range"), KEY, carried=["cell_channels", "motion"]
    ).withColumnRenamed("range", "cell_range"))
    merged = settle(cand.component_features(cand.cell_features(placed, cells, KEY, config), KEY))
    line = params.select(*KEY, "a", "b", "c", "c0", "c1", "c2", F.col("end_x").alias("_end"))
    if config.static_channel:
        low = points.join(line, KEY).withColumn("h", _h()).filter(
            F.col("x").between(0, F.col("_end")) & F.col("h").between(0, config.low_object_height_m)
            & (F.abs(g.route_offset(F.col("x"), F.col("y"), _line())) <= config.static_half_width_m + 0.25)
        )
        feats = cand.raised_low(merged, low, KEY, config)
    else:
        feats = merged.withColumn("raised", F.lit(False))
    feats = cand.evidence_features(feats)
    if config.pole_rejection:
        feats = cand.pole_reach(
            feats, placed.filter(F.col("x").between(0, F.col("end_x"))), KEY, config
        )
    else:
        feats = feats.withColumn("pole", F.lit(False))
    feats = feats.join(params.select(*KEY, "end_x", "far_end", "c0", "c1", "c2", "moving"), KEY)
    feats = feats.withColumn("wall", F.lit(False))
    if config.far_gauge_max_x_m > 0:
        feats = _with_wall_contact(feats, placed, params)
    middle = F.abs(g.route_offset(
        (F.col("lo_x") + F.col("hi_x")) / 2, (F.col("lo_y") + F.col("hi_y")) / 2, _line()
    ))
    reason = cand.rejection_reason(
        config, F.col("end_x"), F.col("moving"), F.col("wall"), F.col("pole"), middle
    )
    return feats.withColumn("rejected", reason).drop("c0", "c1", "c2", "moving", "far_end"), cells


def _with_wall_contact(feats, placed, params):
    reach = params.filter("far_end > end_x").select(*KEY, F.col("far_end").alias("_far"))
    near = placed.join(reach, KEY).filter(
        (F.col("x") > F.col("end_x") - 20) & (F.col("x") <= F.col("_far") + 20)
        & F.col("h").between(0.5, 2.8) & (F.col("off") <= 2.6)
    )
    plan = near.groupBy(*KEY, F.floor(F.col("x") / 0.5).alias("ix"), F.floor(F.col("y") / 0.5).alias("iy")).agg(
        F.min(F.struct("raw_index", "soff")).alias("f")).select(*KEY, "ix", "iy", F.col("f.soff").alias("offset"))
    far = feats.filter(F.col("near.distance") > F.col("end_x")).select(*KEY, "component", "lo_x", "lo_y", "hi_x", "hi_y")
    touching = graph.wall_contact(far, plan, KEY, "component").withColumn("_wall", F.lit(True))
    return feats.join(touching, [*KEY, "component"], "left").withColumn(
        "wall", F.coalesce("_wall", F.lit(False))
    ).drop("_wall")


def _candidate_rows(accepted, params, config: DetectorConfig) -> DataFrame:
    line = F.struct(*[F.col(c) for c in ("c0", "c1", "c2")], F.col("route_valid").alias("valid"))
    raw = F.struct(*[F.col(f"raw_{c}").alias(c) for c in ("c0", "c1", "c2")], F.col("route_valid").alias("valid"))
    rows = accepted.drop("end_x").join(
        params.select(*KEY, "c0", "c1", "c2", "raw_c0", "raw_c1", "raw_c2", "route_valid", "route_max_x"), KEY
    )
    margin = route.route_margin(F.col("near.x"), line, raw, config)
    edge = (margin > 0) & (F.col("closest_offset") > config.corridor_half_width_m - margin)
    if config.route_support_margin_m > 0:
        edge = edge | (
            F.col("route_valid") & (F.col("near.x") > F.col("route_max_x") - config.route_support_margin_m)
        )
    return rows.filter(F.col("near.distance") >= 0).select(
        *KEY, F.col("near.distance").alias("distance_m"), F.lit(True).alias("distance_valid"),
        F.col("support").alias("support_points"),
        F.array(*[(F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in "xyz"]).alias("center"),
        F.array(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]).alias("size"),
        F.array("near.x", "near.y", "near.z").alias("nearest"),
        F.col("channels").cast("int").alias("channels"), edge.alias("edge"),
        F.col("closest_offset").alias("closest_offset_m"),
    )


def hanging_candidates(placed, found, config: DetectorConfig) -> DataFrame:
    """Thin suspended columns whose tip enters the vehicle height; none beside a candidate."""
    high = placed.filter(
        F.col("route_valid") & (F.col("x") >= config.detection_roi.low[0]) & (F.col("x") <= F.col("end_x"))
        & (F.col("off") <= config.low_object_half_width_m)
        & F.col("h").between(config.hanging_tip_max_height_m - 0.5, config.corridor_height_m + 1.5)
    )
    az = F.floor(F.col("x") / 0.25).cast("int")
    el = (F.floor(F.col("y") / 0.25) + 1024).cast("int")
    cells = high.groupBy(*KEY, az.alias("az"), el.alias("el")).agg(
        *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))],
        F.min("h").alias("tip"), F.max("h").alias("top"), F.count(F.lit(1)).alias("n"),
        F.max("origin_x").alias("origin_x"),
    )
    parts = graph.cell_components(cells, KEY, reach=1, by_range=False)
    columns = cells.join(parts, [*KEY, "az", "el"]).groupBy(*KEY, "component").agg(
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))],
        F.min("tip").alias("tip"), F.max("top").alias("top"), F.sum("n").alias("n"),
        F.max("origin_x").alias("origin_x"),
    ).filter(
        (F.col("n") >= config.hanging_min_points) & (F.col("tip") <= config.hanging_tip_max_height_m)
        & (F.col("top") - F.col("tip") >= config.hanging_min_vertical_span_m)
        & (F.col("hi_x") - F.col("lo_x") <= config.hanging_max_footprint_m)
        & (F.col("hi_y") - F.col("lo_y") <= config.hanging_max_footprint_m)
        & (F.col("lo_x") - F.col("origin_x") > 0)
    ).withColumns({
        "cx": (F.col("lo_x") + F.col("hi_x")) / 2, "cy": (F.col("lo_y") + F.col("hi_y")) / 2,
    })
    taken = found.select(*KEY, F.get("center", 0).alias("cx"), F.get("center", 1).alias("cy"))
    lone = graph.unmatched_near(columns, taken, KEY, "cx", "cy", 0.5)
    return lone.select(
        *KEY, (F.col("lo_x") - F.col("origin_x")).alias("distance_m"), F.lit(True).alias("distance_valid"),
        F.col("n").alias("support_points"),
        F.array(*[(F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in "xyz"]).alias("center"),
        F.array(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]).alias("size"),
        F.array("lo_x", "lo_y", "lo_z").alias("nearest"), F.lit(ops.GAUGE).alias("channels"),
        F.lit(False).alias("edge"), F.lit(None).cast("double").alias("closest_offset_m"),
    )


def find_candidates(points, params, placed, front, config: DetectorConfig):
    """(candidate rows, judged components) of all frames past their warm-up."""
    cells = settle(evidence_cells(placed, front))
    judged, cells = judged_components(placed, points, cells, params, config)
    judged = settle(judged)
    accepted = judged.filter(F.col("rejected").isNull())
    wide = cand.widen_with_structure(accepted, placed, cells, KEY, config)
    rows = _candidate_rows(wide, params, config)
    if config.hanging_channel and config.static_channel:
        rows = settle(rows)
        rows = rows.unionByName(hanging_candidates(placed, rows, config))
    return settle(rows), judged


def candidate_arrays(rows: DataFrame) -> DataFrame:
    """Candidates of a frame, nearest first, numbered from one."""
    fields = [c.split(":")[0] for c in CANDIDATE[len("struct<"):-1].split(",") if ":" in c]
    fields = [f for f in fields if f != "id"]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    return rows.groupBy(*KEY).agg(ordered.alias("_c")).select(
        *KEY, F.transform("_c", lambda c, i: F.struct(
            (i + 1).cast("int").alias("id"), *[c[f].alias(f) for f in fields]
        )).cast(f"array<{CANDIDATE}>").alias("candidates")
    )


def analyse(frames: DataFrame, config: DetectorConfig) -> DataFrame:
    """Analysis of every frame: status, reason, trust, floor, route, range and candidates."""
    return analyse_points(frame_rows(frames), unfold(frames, config), config)


def analyse_points(rows: DataFrame, raw: DataFrame, config: DetectorConfig, rounds: list[int] | None = None) -> DataFrame:
    """The same for clouds stored as one row per point.

    ``rows`` as from ``frame_rows``; ``raw`` as from ``unfold``.  Frames over the point limit are
    refused from their combined counts before any per-frame group is formed.  ``rounds`` gets the frames
    that each round over the history looks at.
    """
    turn, move = [F.col(f"r{i}") for i in range(9)], [F.col(f"t{i}") for i in range(3)]
    # Written as they come: a filter on the fate would carry whatever makes the clouds down into one method, too
    # long for the JIT, and every reader would make them again.
    fates = settle(ops.classify(raw, config, turn, move).select(*KEY, "raw_index", "fate", "in_detection", *"xyz"))
    meta = settle(chains(settle(admission(rows, fates, config))))
    live = meta.filter(F.col("stop_reason").isNull()).select(*KEY)
    kept = fates.filter(F.col("fate") == ops.GEOMETRY).drop("fate")
    points = settle_by(kept.join(live, KEY, "left_semi"), KEY)
    held = settle(hold_floor(meta, floors(points, config), config))
    used = held.filter(F.col("geometry_reason").isNull())
    order = SlicedOrder.fit(used.select(*LIFE, "frame_sequence"), LIFE, ["frame_sequence"])
    moved = folds.motion_and_route(
        motion_inputs(used, points, config, order), LIFE, ["frame_sequence"], config.ego_min_contrast, config.route_smoothing,
        sliced=order)
    params = settle(frame_parameters(used, moved, config).withColumn(
        "moving", F.col("ego_motion_valid") & (F.col("ego_speed_mps") >= config.envelope_min_speed_mps)
    ))
    placed = settle_by(placed_points(points, params, config), KEY)
    history = config.background_history_frames
    if not history:
        rows, judged = find_candidates(points, params, placed, None, config)
        ready = params.withColumns({"ordinal": F.lit(0), "pushed": F.lit(1)})
        return _results(meta, held, ready, rows, judged, config)
    image = settle(history_image(placed))
    # A held frame without candidates does not enter the history, which later frames look back on. Start from
    # "all enter"; where the outcome differs from the assumption, only what follows in that life is done again.
    # The first frame that differs is right then, so the next one comes later, and rounds shrink to none.
    skipped = settle(params.filter("false").select(*LIFE, "frame_sequence"))
    redo, rows, judged = None, None, None
    while True:
        ready = settle(push_order(params, skipped.select(*KEY)))
        past = ready.filter(F.col("ordinal") >= history)
        todo = settle(past if redo is None else past.join(redo, LIFE).filter(F.col("frame_sequence") > F.col("_from")).drop("_from"))
        if rounds is not None:
            rounds.append(todo.count())
        links = settle(history_links(todo, ready, config))
        front = foreground_cells(image, todo, links, config)
        more, judged_more = find_candidates(points, todo, placed.join(todo.select(*KEY), KEY, "left_semi"), front, config)
        if redo is None:
            rows, judged = more, judged_more
        else:
            gone = params.join(redo, LIFE).filter(F.col("frame_sequence") > F.col("_from")).select(*KEY)
            rows = settle(rows.join(gone, KEY, "left_anti").unionByName(more))
            judged = settle(judged.join(gone, KEY, "left_anti").unionByName(judged_more))
        empty = settle(past.filter("held").join(rows.select(*KEY).distinct(), KEY, "left_anti").select(*LIFE, "frame_sequence"))
        changed = empty.exceptAll(skipped).unionAll(skipped.exceptAll(empty))
        redo = settle(changed.groupBy(*LIFE).agg(F.min("frame_sequence").alias("_from")))
        if redo.isEmpty():
            break
        skipped = empty
    return _results(meta, held, ready, rows, judged, config)


def _results(meta, held, ready, rows, judged, config: DetectorConfig) -> DataFrame:
    history = config.background_history_frames
    found = candidate_arrays(rows)
    rejected = judged.filter(F.col("rejected").isNotNull() & F.col("lo_x").isNotNull()).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("rejected").alias("reason"),
            F.array(*[(F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in "xyz"]).alias("center"),
            F.array(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]).alias("size"),
            "cells", F.col("support").alias("points"), "channels",
        ))).alias("rejected")
    )
    fails = held.filter(F.col("geometry_reason").isNotNull()).select(*KEY, "geometry_reason")
    shown = ready.select(
        *KEY, "a", "b", "c", "inliers", "end_x", "held", "ordinal", "c0", "c1", "c2", "route_valid",
        "route_max_x", "rail_slices", "ego_motion_valid", "ego_speed_mps",
    )
    df = meta.join(fails, KEY, "left").join(shown, KEY, "left").join(found, KEY, "left")
    if config.record_rejected:
        df = df.join(rejected, KEY, "left")
    none = F.array().cast(f"array<{CANDIDATE}>")
    df = df.withColumn("candidates", F.coalesce("candidates", none))
    warm = F.lit(False) if not history else F.col("ordinal") < history
    empty = F.size("candidates") == 0
    gauge_end = F.least("end_x", "route_max_x")
    gauge_on = F.lit(config.static_channel and config.gauge_certifies_clear) & F.col("route_valid")
    clear = F.coalesce(gauge_on & (gauge_end > config.detection_roi.low[0]), F.lit(False))
    lost = F.coalesce(F.col("held") & empty, F.lit(False)) & ~warm
    reason = (
        F.when(F.col("stop_reason").isNotNull(), F.col("stop_reason"))
        .when(F.col("geometry_reason").isNotNull(), F.col("geometry_reason"))
        .when(warm, "BASELINE_WARMUP").when(lost, "GROUND_UNSUPPORTED")
        .when(~empty, "CANDIDATES_FOUND")
        .when(F.lit(not history) | clear, "NO_CANDIDATE_IN_EVALUATED_REGION")
        .otherwise("BACKGROUND_CANNOT_CONFIRM_CLEAR")
    )
    status = (
        F.when(F.col("stop_reason").isNotNull(), F.col("stop_status"))
        .when(F.col("geometry_reason").isNotNull() | warm | lost, ops.INVALID_GEOMETRY)
        .otherwise(ops.OK)
    )
    df = df.withColumns({"reason": reason, "status": status})
    good = F.col("status") == ops.OK
    region = good & (F.lit(not history) | clear)
    seen_range = F.when(good & F.lit(bool(history)) & clear, gauge_end).when(good, F.col("end_x")).otherwise(0.0)
    df = df.withColumns({"evaluation_region_valid": region, "evaluated_range_m": seen_range})
    has_floor = F.col("a").isNotNull()
    line = F.struct(
        "c0", "c1", "c2", F.col("route_valid").alias("valid"), F.col("route_max_x").alias("max_x"),
        F.col("rail_slices").cast("int").alias("rail_slices"),
    )
    covered = (
        F.when(~region, F.lit(-math.inf)).when(F.lit(not history), F.col("end_x")).otherwise(gauge_end)
    )
    corridor = route.corridor_segments(
        F.col("end_x"), line, _plane(), float(config.detection_roi.low[0]),
        2.0 * config.corridor_half_width_m, config.corridor_height_m, F.col("inliers"), covered,
    )
    return df.select(
        *KEY, "measurement_time_ns", "status", "reason", "calibration_trust", "transform_applied",
        "evaluation_region_valid", "evaluated_range_m",
        F.coalesce("ego_motion_valid", F.lit(False)).alias("ego_motion_valid"),
        F.coalesce("ego_speed_mps", F.lit(0.0)).alias("ego_speed_mps"), "candidates",
        F.when(has_floor, g.published_plane(*_plane())).alias("ground_plane"),
        F.when(has_floor, F.array("a", "b", "c")).alias("floor"),
        F.coalesce("inliers", F.lit(0)).alias("ground_inliers"),
        F.when(has_floor, line).alias("route"), F.when(has_floor, corridor).alias("corridor"),
        *[c for c in meta.columns if c.endswith("_point_count")],
        *(["rejected"] if config.record_rejected else []),
    )
