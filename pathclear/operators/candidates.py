"""From evidence cells to candidates: mergeable features and the ordered rejection chain.

Points are first reduced to one row per angular cell, then cells to components; every feature is a
minimum, maximum, count or sum, so both steps combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathclear.config import DetectorConfig
from pathclear.functions import geometry as g
from pathclear.functions.ranks import ninth_tenth_inclusive, rank_values
from pathclear.operators.points import GAUGE, MOTION, salted_join, structure_point

DEPTH_M, GAUGE_DEPTH_M = 0.5, 5.0
XYZ = ("x", "y", "z")


def _box(prefix: str, condition: Column) -> list[Column]:
    return [
        f(F.when(condition, F.col(c))).alias(f"{prefix}_{n}_{c}")
        for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))
    ]


def _part(prefix: str, condition: Column, inside: Column, origin_x: Column) -> list[Column]:
    """Evidence features of one part of the points (plain evidence, or structure)."""
    both = condition & inside
    near = F.struct((F.col("x") - origin_x).alias("distance"), "raw_index", "x", "y", "z")
    return [
        *_box(prefix, condition),
        F.min(F.when(condition, F.col("off"))).alias(f"{prefix}_offset"),
        F.min(F.when(both, F.col("z"))).alias(f"{prefix}_in_lo_z"),
        F.max(F.when(both, F.col("z"))).alias(f"{prefix}_in_hi_z"),
        F.min(F.when(both, near)).alias(f"{prefix}_near"),
        F.count_if(both).alias(f"{prefix}_support"),
    ]


def cell_features(points: DataFrame, cells: DataFrame, keys: list[str], config: DetectorConfig):
    """One row per cell, with its ``component`` if the cells have one.

    ``points``: keys, raw_index, az, el, x, y, z, range, h, off (absolute), soff (signed),
    gauge_near (near-gauge test incl. an active gauge), in_gauge, in_band, origin_x.
    ``cells``: keys, az, el, cell_range, cell_channels, motion (band points count as evidence).
    """
    cell = [*keys, "az", "el"]
    # A cell is a small part of a frame: its key alone spreads the points.
    p = points.join(cells, cell)
    p = p.filter(F.col("in_gauge") | (F.col("in_band") & F.col("motion")))
    facts = [c for c in ("cell_range", "cell_channels", "component") if c in cells.columns]
    front = F.col("range") <= F.col("cell_range") + DEPTH_M
    inside = F.col("off") <= config.corridor_half_width_m
    structure = (F.col("cell_channels").bitwiseAND(MOTION) == 0) & structure_point(
        F.col("off"), F.col("h"), config
    )
    long_part = F.col("gauge_near") & (F.col("range") <= F.col("cell_range") + GAUGE_DEPTH_M)
    inner = long_part & (F.col("off") <= config.static_inner_half_width_m)
    origin = F.col("origin_x")
    return p.groupBy(*cell, *facts).agg(
        *_box("possible", front & inside),
        F.max(F.when(front & inside, F.col("h"))).alias("top"),
        F.sum(F.when(front & inside, F.col("soff"))).alias("offset_sum"),
        F.count_if(front & inside).alias("inside_points"),
        F.min(F.when(long_part, F.col("x"))).alias("gauge_lo_x"),
        F.max(F.when(long_part, F.col("x"))).alias("gauge_hi_x"),
        F.min(F.when(inner, F.col("x"))).alias("inner_lo_x"),
        F.max(F.when(inner, F.col("x"))).alias("inner_hi_x"),
        *_part("plain", front & ~structure, inside, origin),
        *_part("struct", front & structure, inside, origin),
    )


def _merge_part(prefix: str) -> list[Column]:
    mins = [f"{prefix}_lo_{c}" for c in XYZ] + [f"{prefix}_offset", f"{prefix}_in_lo_z", f"{prefix}_near"]
    maxs = [f"{prefix}_hi_{c}" for c in XYZ] + [f"{prefix}_in_hi_z"]
    return [
        *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs],
        F.sum(f"{prefix}_support").alias(f"{prefix}_support"),
    ]


def component_features(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cell rows with ``component`` merged into one row per component."""
    plain_in, struct_in = F.col("plain_support") > 0, F.col("struct_support") > 0
    return cells.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("cells"), F.bit_or("cell_channels").alias("channels"),
        *[F.min(f"possible_lo_{c}").alias(f"possible_lo_{c}") for c in XYZ],
        *[F.max(f"possible_hi_{c}").alias(f"possible_hi_{c}") for c in XYZ],
        F.max("top").alias("top"), F.sum("offset_sum").alias("offset_sum"),
        F.sum("inside_points").alias("inside_points"),
        F.min("gauge_lo_x").alias("gauge_lo_x"), F.max("gauge_hi_x").alias("gauge_hi_x"),
        F.min("inner_lo_x").alias("inner_lo_x"), F.max("inner_hi_x").alias("inner_hi_x"),
        F.count_if(plain_in).alias("plain_cells"), F.count_if(plain_in | struct_in).alias("all_cells"),
        *_merge_part("plain"), *_merge_part("struct"),
    )


def mean_offset() -> Column:
    return F.try_divide(F.col("offset_sum"), F.col("inside_points"))


def may_be_raised(config: DetectorConfig) -> Column:
    """Low, off-centre and short enough to be a single bump beside the rails."""
    low = (F.col("top") < config.low_object_height_m) & (
        F.abs(mean_offset()) > config.low_object_half_width_m
    )
    return F.coalesce(
        low & (F.col("possible_hi_x") - F.col("possible_lo_x") <= config.low_bump_max_length_m)
        & (F.col("possible_hi_y") - F.col("possible_lo_y") >= config.low_bump_min_width_m),
        F.lit(False),
    )


BIN_M, CONTEXT_INNER_M, CONTEXT_OUTER_M = 0.5, 0.75, 2.5


def bump_context(
    bumps: DataFrame, low_points: DataFrame, keys: list[str], id_: str, min_points: int
) -> DataFrame:
    """High low-return height (9/10 rank) of the strip before and behind every bump.

    ``bumps``: keys, id, bx, by.  ``low_points``: keys, x, y, h.  Bins along x make it an
    equi-join; heights are counted per value before they are ranked.
    """
    first = F.floor(F.greatest(F.lit(0.0), F.col("bx") - CONTEXT_OUTER_M) / BIN_M)
    last = F.floor((F.col("bx") + CONTEXT_OUTER_M) / BIN_M)
    asked = bumps.select(*keys, id_, "bx", "by", F.explode(F.sequence(first, last)).alias("bin"))
    placed = low_points.select(*keys, "x", "y", "h", F.floor(F.col("x") / BIN_M).alias("bin"))
    d = F.col("x") - F.col("bx")
    side = (
        F.when(d.between(-CONTEXT_OUTER_M, -CONTEXT_INNER_M), "before")
        .when(d.between(CONTEXT_INNER_M, CONTEXT_OUTER_M), "after")
    )
    near = placed.join(asked, [*keys, "bin"]).filter(F.abs(F.col("y") - F.col("by")) <= 0.25)
    near = near.select(*keys, id_, side.alias("side"), "h").filter(F.col("side").isNotNull())
    upper = rank_values(
        near, [*keys, id_, "side"], "h", {"upper": ninth_tenth_inclusive}, [0.25, 0.5, 0.75]
    ).filter(F.col("n") >= min_points)
    return upper.groupBy(*keys, id_).agg(
        F.count(F.lit(1)).alias("sides"), F.max("upper").alias("upper")
    ).filter(F.col("sides") == 2).select(*keys, id_, "upper")


def raised_low(features: DataFrame, low_points: DataFrame, keys, config: DetectorConfig):
    """Adds ``raised``: a low off-centre component that rises above the strip on both sides."""
    asked = features.filter(may_be_raised(config)).select(
        *keys, "component",
        ((F.col("possible_lo_x") + F.col("possible_hi_x")) / 2).alias("bx"),
        ((F.col("possible_lo_y") + F.col("possible_hi_y")) / 2).alias("by"),
    )
    context = bump_context(asked, low_points, keys, "component", config.low_bump_min_context_points)
    above = F.col("top") >= F.col("upper") + config.low_bump_min_prominence_m
    return features.join(context, [*keys, "component"], "left").withColumn(
        "raised", may_be_raised(config) & F.coalesce(above, F.lit(False))
    ).drop("upper")


def evidence_features(features: DataFrame) -> DataFrame:
    """Final evidence: plain points, and structure points too where the component is raised."""
    def low(name):
        plain, struct = F.col(f"plain_{name}"), F.col(f"struct_{name}")
        return F.when(F.col("raised"), F.least(plain, struct)).otherwise(plain)

    def high(name):
        plain, struct = F.col(f"plain_{name}"), F.col(f"struct_{name}")
        return F.when(F.col("raised"), F.greatest(plain, struct)).otherwise(plain)

    near = F.when(
        F.col("raised") & (F.col("plain_near").isNull() | (F.col("struct_near") < F.col("plain_near"))),
        F.col("struct_near"),
    ).otherwise(F.col("plain_near"))
    inner = F.col("inner_hi_x") - F.col("inner_lo_x")
    out = features.withColumns({
        **{f"lo_{c}": low(f"lo_{c}") for c in XYZ}, **{f"hi_{c}": high(f"hi_{c}") for c in XYZ},
        "closest_offset": low("offset"), "in_lo_z": low("in_lo_z"), "in_hi_z": high("in_hi_z"),
        "near": near,
        "support": F.col("plain_support") + F.when(F.col("raised"), F.col("struct_support")).otherwise(0),
        "inside_cells": F.when(F.col("raised"), F.col("all_cells")).otherwise(F.col("plain_cells")),
        "mean_offset": mean_offset(),
        "gauge_length": F.coalesce(inner, F.col("gauge_hi_x") - F.col("gauge_lo_x")),
    })
    parts = [c for c in out.columns if c.split("_")[0] in ("plain", "struct", "possible")]
    return out.drop(*parts)


def pole_reach(features: DataFrame, points: DataFrame, keys, config: DetectorConfig) -> DataFrame:
    """Adds ``pole``: a thin column that stands from the floor up past the corridor.

    ``points``: keys, x, y, h of detection returns.  The height chain is walked over distinct
    heights per component.
    """
    thin = (
        (F.col("hi_x") - F.col("lo_x") <= 0.8) & (F.col("hi_y") - F.col("lo_y") <= 0.8)
        & (F.col("support") >= config.min_candidate_points)
    )
    asked = features.filter(thin).select(*keys, "component", "lo_x", "hi_x", "lo_y", "hi_y", F.explode(F.sequence(
        F.floor(F.greatest(F.lit(0.0), F.col("lo_x") - 0.2) / BIN_M),
        F.floor((F.greatest(F.lit(0.0), F.col("hi_x") + 0.2)) / BIN_M),
    )).alias("bin"))
    placed = points.select(*keys, "x", "y", "h", F.floor(F.col("x") / BIN_M).alias("bin"))
    inside = (
        F.col("x").between(F.col("lo_x") - 0.2, F.col("hi_x") + 0.2)
        & F.col("y").between(F.col("lo_y") - 0.2, F.col("hi_y") + 0.2)
    )
    heights = placed.join(asked, [*keys, "bin"]).filter(inside).select(
        *keys, "component", "h"
    ).distinct()
    w = Window.partitionBy(*keys, "component").orderBy("h")
    gap = F.coalesce(F.col("h") - F.lag("h").over(w), F.lit(0.0)) > 1.0
    walked = heights.withColumn("_gap", gap.cast("int")).withColumn(
        "_broken", F.max("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    reach = walked.groupBy(*keys, "component").agg(
        F.min("h").alias("_foot"), F.max(F.when(F.col("_broken") == 0, F.col("h"))).alias("_reach")
    )
    stands = (F.col("_foot") <= config.obstacle_min_height_m + 0.3) & (
        F.col("_reach") >= config.corridor_height_m + 0.1
    )
    return features.join(reach, [*keys, "component"], "left").withColumn(
        "pole", F.coalesce(stands, F.lit(False))
    ).drop("_foot", "_reach")


def rejection_reason(
    config: DetectorConfig, end_x: Column, moving: Column, wall: Column, pole: Column,
    centre_offset: Column,
) -> Column:
    """First matching reason, null for a candidate."""
    length = F.col("hi_x") - F.col("lo_x")
    width = F.col("hi_y") - F.col("lo_y")
    extent = F.col("in_hi_z") - F.col("in_lo_z")
    channels, distance = F.col("channels"), F.col("near.distance")
    gauge = channels.bitwiseAND(GAUGE) > 0
    gauge_length = F.coalesce(F.col("gauge_length"), F.lit(0.0))
    low = F.col("top") < config.low_object_height_m
    never = F.lit(False)
    side = (
        (F.col("closest_offset") > config.low_object_half_width_m)
        & (F.greatest(length, gauge_length) > config.side_structure_max_length_m)
        if config.side_structure_max_length_m > 0 else never
    )
    weak = (
        gauge & (centre_offset > config.static_inner_half_width_m)
        & ((length > config.static_outer_max_length_m) | (width < config.static_outer_min_width_m)
           | (F.col("support") < config.static_outer_min_points))
        if config.static_inner_half_width_m < config.gauge_half_width_m else never
    )
    return (
        F.when(F.col("inside_cells") < config.min_candidate_cells, "FEW_CELLS")
        .when(F.col("support") < config.min_candidate_points, "FEW_POINTS")
        .when(extent < F.when(gauge, 0.1).otherwise(config.obstacle_min_height_m), "LOW_EXTENT")
        .when((distance > end_x) & (extent < config.far_min_extent_m), "FAR_LOW_EXTENT")
        .when((distance > end_x) & wall, "FAR_WALL_CONTACT")
        .when((channels == GAUGE) & (gauge_length > config.static_max_length_m), "LONG_GAUGE_STRUCTURE")
        .when(pole, "POLE_STRUCTURE")
        .when((F.col("closest_offset") > config.gauge_half_width_m)
              & (length > config.static_max_length_m), "LONG_EDGE_STRUCTURE")
        .when(side, "LONG_SIDE_STRUCTURE")
        .when(weak, "WEAK_OUTER_STATIC")
        .when(moving & ~gauge & (centre_offset > config.envelope_half_width_m), "OUTSIDE_ENVELOPE")
        .when(low & (F.abs(F.col("mean_offset")) > config.low_object_half_width_m)
              & ~F.col("raised"), "LOW_OFF_CENTRE")
    )


def widen_with_structure(accepted: DataFrame, points: DataFrame, cells: DataFrame, keys, config):
    """Structure returns within the evidence's x range complete the box in y and z.

    ``points`` as in ``cell_features``; ``cells`` carry component and cell facts.
    """
    member = cells.select(*keys, "az", "el", "component", "cell_range", "cell_channels", "motion")
    boxes = accepted.filter(~F.col("raised")).select(*keys, "component", "lo_x", "hi_x")
    wanted = member.join(boxes, [*keys, "component"])
    p = salted_join(
        points.filter(structure_point(F.col("off"), F.col("h"), config)), wanted, [*keys, "az", "el"],
        "raw_index",
    )
    evidence = F.col("in_gauge") | (F.col("in_band") & F.col("motion"))
    keep = (
        evidence & (F.col("cell_channels").bitwiseAND(MOTION) == 0)
        & (F.col("range") <= F.col("cell_range") + DEPTH_M)
        & F.col("x").between(F.col("lo_x"), F.col("hi_x"))
    )
    extra = p.filter(keep).groupBy(*keys, "component").agg(
        *[f(c).alias(f"s{n}_{c}") for c in "yz" for n, f in (("lo", F.min), ("hi", F.max))]
    )
    wide = accepted.join(extra, [*keys, "component"], "left")
    return wide.withColumns({
        **{f"lo_{c}": F.least(f"lo_{c}", f"slo_{c}") for c in "yz"},
        **{f"hi_{c}": F.greatest(f"hi_{c}", f"shi_{c}") for c in "yz"},
    }).drop("slo_y", "shi_y", "slo_z", "shi_z")
