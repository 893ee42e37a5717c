"""Background differencing: rolling baselines, foreground masks, history clearance and shifts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.functions import geometry as g
from pathclear.functions.ranks import array_upper_median
from pathclear.operators.graph import shift_array, shifts


def baseline_picks(lag: int, span: int, count: int) -> list[int]:
    """How far back the baseline frames of a window [t - lag - span, t - lag) lie, evenly picked."""
    low, high = -(lag + span), -lag - 1
    steps = [low + int((high - low) * i / max(count - 1, 1)) for i in range(count)]
    return sorted({-s for s in steps}, reverse=True)


def rolling_baseline(images: DataFrame, frame: str, picks: list[int], first: int) -> DataFrame:
    """Median range and share of frames with a return per cell, from the picked past frames.

    Every image row is sent to the frames it serves; a cell meets at most ``len(picks)`` rows.
    Frames whose window starts before ``first`` have no baseline.
    """
    served = images.select(
        F.explode(F.array(*[F.lit(p) for p in picks])).alias("_back"), frame, "az", "el", "range"
    ).select((F.col(frame) + F.col("_back")).alias(frame), "az", "el", "range")
    ordered = F.array_sort(F.collect_list("range"))
    return (
        served.filter(F.col(frame) >= first + max(picks))
        .groupBy(frame, "az", "el").agg(ordered.alias("_r"))
        .select(frame, "az", "el", small_median(F.col("_r")).alias("base"),
                (F.size("_r") / len(picks)).alias("share"))
    )


def small_median(ordered: Column) -> Column:
    """Median of a short sorted array with linear interpolation."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int"))
            + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def foreground(image, baseline, keys: list[str], margin=0.5, relative=0.02, empty_share=0.2):
    """Cells nearer than the baseline by a margin, or seen where the baseline saw nothing."""
    joined = image.join(baseline, [*keys, "az", "el"], "left")
    nearer = F.coalesce(
        F.col("range") < F.col("base") - (margin + relative * F.col("base")), F.lit(False)
    )
    appeared = F.coalesce(F.col("share"), F.lit(0.0)) < empty_share
    return joined.withColumns({"nearer": nearer, "appeared": appeared}).filter(nearer | appeared)


def history_clearance(
    current: DataFrame, links: DataFrame, history: DataFrame, keys: list[str], cell_deg: float,
    max_x: float, origin: tuple[Column, Column, Column],
) -> DataFrame:
    """Least clearance of every current cell against each linked past frame.

    ``current``: keys, ordinal, az, el, x, y, z - nearest return per cell.  ``links``: keys,
    ordinal, past (ordinal), shift, at most one row for each ordinal and past.  ``history``: keys,
    ordinal, az, el, range.  A return moved back by the shift meets the nearest of nine neighbouring
    cells in the past frame; these are found once per past frame, on its own bounded grid.
    """
    at = [*keys, "ordinal"]
    moved = current.join(links, at).withColumn("px", F.col("x") + F.col("shift")).filter(
        F.col("px") <= max_x
    )
    dx, dy, dz = F.col("px") - origin[0], F.col("y") - origin[1], F.col("z") - origin[2]
    moved = moved.withColumns({
        "paz": g.azimuth_cell(dx, dy, cell_deg), "pel": g.elevation_cell(dx, dy, dz, cell_deg),
        "prange": g.norm(dx, dy, dz),
    })
    # A frame's image is in one task, so its nine copies are combined where they are made.
    around = history.select(*keys, F.col("ordinal").alias("past"), "az", "el", "range").repartition(*keys, "past")
    seen = around.withColumn("s", F.explode(shift_array([(0, 0), *shifts(1)]))).groupBy(
        *keys, "past", (F.col("az") + F.col("s.d0")).alias("paz"), (F.col("el") + F.col("s.d1")).alias("pel")
    ).agg(F.min("range").alias("seen"))
    asked = moved.select(*at, "az", "el", "past", "prange", "paz", "pel")
    return asked.join(seen, [*keys, "past", "paz", "pel"]).select(
        *at, "az", "el", "past", (F.col("seen") - F.col("prange")).alias("clearance"), "seen"
    )


def foreground_vote(
    clearances: DataFrame, keys: list[str], margin: float, relative: float
) -> DataFrame:
    """Per current cell: number of clearances, their upper median, mean seen range and the vote.

    A cell has one clearance per baseline frame, so its array is as short as the history.
    """
    votes = clearances.groupBy(*keys, "ordinal", "az", "el").agg(
        F.count(F.lit(1)).alias("votes"), F.collect_list("clearance").alias("_c"),
        F.avg("seen").alias("reference"),
    )
    median = array_upper_median(F.col("_c"))
    votes = votes.withColumn("median_clearance", median).drop("_c")
    nearer = F.col("median_clearance") > margin + relative * F.col("reference")
    return votes.withColumn("foreground", (F.col("votes") >= 2) & nearer)


def shift_errors(
    now: Column, then: Column, max_shift: Column | int, cap: float, min_pairs: int
) -> Column:
    """Mean capped difference of two profiles for every forward shift; null with too few pairs.

    Profiles are arrays of one row per side and height band; empty bins are null.
    """
    bins = F.size(F.get(now, 0))

    def one(shift):
        def row(r):
            a, b = F.get(now, r), F.get(then, r)
            return F.filter(
                F.zip_with(F.slice(a, F.lit(1), bins - shift), F.slice(b, shift + 1, bins - shift),
                           lambda p, q: F.least(F.abs(p - q).cast("double"), F.lit(cap))),
                lambda d: d.isNotNull(),
            )

        gaps = F.flatten(F.transform(F.sequence(F.lit(0), F.size(now) - 1), row))
        total = F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d)
        return F.when(F.size(gaps) >= min_pairs, total / F.size(gaps))

    last = F.lit(max_shift) if isinstance(max_shift, int) else max_shift
    return F.transform(F.sequence(F.lit(0), last), one)


def curve_statistics(errors: Column) -> dict[str, Column]:
    """Upper median, best shift and contrast of an error curve."""
    known = F.filter(errors, lambda e: e.isNotNull())
    median = F.when(F.size(known) >= 4, array_upper_median(known))
    best = F.array_min(known)
    return {
        "median": median, "best": best,
        "best_shift": F.array_position(errors, best) - 1, "contrast": median - best,
    }


def speed_of_shift(shift: Column, dt_s: Column, step_m: float = 0.05) -> Column:
    return shift * step_m / dt_s


def max_shift(dt_s: Column, max_speed: float, bins: int = 640, step_m: float = 0.05) -> Column:
    return F.least(F.lit(bins // 2), F.ceil(F.lit(max_speed) * dt_s / step_m)).cast("int")


def plausible_person(
    cells: Column, range_m: Column, size: tuple[Column, Column, Column], az_res_deg: float,
    el_step_deg: float, support_min=4, cells_share=0.3, width=0.5, tall=1.7, min_height=1.0,
    max_height=2.2, max_width=1.2,
) -> Column:
    """A candidate that could be a person at its own range."""
    side_h, side_v = range_m * math.radians(az_res_deg), range_m * math.radians(el_step_deg)
    expected = (width / side_h) * (tall / side_v)
    dx, dy, dz = size
    return (
        (cells >= F.greatest(F.lit(float(support_min)), cells_share * expected))
        & (dz >= min_height - side_v) & (dz <= max_height + side_v)
        & (F.greatest(dx, dy) <= max_width + side_h)
    )
