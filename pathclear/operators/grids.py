"""Binning of points and the nearest, lowest or median return per bin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathclear.config import DetectorConfig
from pathclear.functions import geometry as g
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.ranks import rank_values, upper_median
from pathclear.operators.points import in_floor_band, salted_join

# Fixed values of the floor, wall and profile grids.
FLOOR_MIN_X, FLOOR_FIT_MAX_X, FLOOR_BIN_M = 2.0, 90.0, 5.0
WALL_MIN_X, WALL_NEAR_MAX_X, WALL_MIN_M, WALL_MAX_M = 3.0, 8.0, 1.0, 6.0
PROFILE_MIN_X, PROFILE_MAX_X, PROFILE_STEP_M, PROFILE_BINS, PROFILE_ROWS = 3.0, 35.0, 0.05, 640, 6
SECTION_BINS = 27


def trunc(value: Column) -> Column:
    """Integer part towards zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("int")


def first_by(order: list[str], *values: str) -> Column:
    """min(struct): the row that is first by ``order``, with its values."""
    return F.min(F.struct(*order, *values))


def lowest_per_cell(points: DataFrame, keys: list[str], config: DetectorConfig) -> DataFrame:
    """Lowest return of every 1 m x 0.2 m floor cell, in row-major cell order ``cell``."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    half = config.band_half_width_m
    columns = math.ceil(2 * half / 0.2) + 1
    max_x = min(FLOOR_FIT_MAX_X, config.ground_max_x_m)
    rows = math.ceil(max_x - FLOOR_MIN_X) + 1
    row = F.least(trunc(x - FLOOR_MIN_X), F.lit(rows - 1))
    col = F.least(trunc((y + half) / 0.2), F.lit(columns - 1))
    return (
        points.filter(in_floor_band(x, y, z, config, max_x))
        .groupBy(*keys, row.alias("row"), col.alias("col"))
        .agg(first_by(["z", "raw_index"], "x", "y").alias("p"))
        .select(
            *keys, "row", "col", (F.col("row") * columns + F.col("col")).alias("cell"),
            "p.raw_index", "p.x", "p.y", "p.z",
        )
    )


def floor_bins(points: DataFrame, keys: list[str], h: Column, config: DetectorConfig) -> DataFrame:
    """Supporting floor returns per 5 m bin: count, nearest and farthest x."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    bins = math.ceil((config.ground_max_x_m - FLOOR_MIN_X) / FLOOR_BIN_M)
    at = F.least(trunc((x - FLOOR_MIN_X) / FLOOR_BIN_M), F.lit(bins - 1))
    near = in_floor_band(x, y, z, config, config.ground_max_x_m) & (
        F.abs(h) <= config.ground_inlier_tolerance_m
    )
    return points.filter(near).groupBy(*keys, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("hits"), F.min("x").alias("near_x"), F.max("x").alias("far_x")
    )


def needed_in_bin(bin_: Column, config: DetectorConfig) -> Column:
    if not config.ground_far_min_bin_points:
        return F.lit(config.ground_min_bin_points)
    far = FLOOR_MIN_X + bin_ * FLOOR_BIN_M >= config.ground_far_from_m
    return F.when(far, config.ground_far_min_bin_points).otherwise(config.ground_min_bin_points)


def floor_reach(bins: DataFrame, keys: list[str], config: DetectorConfig) -> DataFrame:
    """Followed floor: accepted returns and the far end before the first long gap.

    A frame has at most a few dozen bins, so a window per frame is bounded by the grid.
    """
    w = Window.partitionBy(*keys).orderBy("bin")
    kept = bins.filter(F.col("hits") >= needed_in_bin(F.col("bin"), config))
    before = F.coalesce(F.lag("far_x").over(w), F.lit(FLOOR_MIN_X))
    broken = (F.col("near_x") - before > config.ground_max_gap_m).cast("int")
    kept = kept.withColumn("broken", broken).withColumn(
        "broken", F.max("broken").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        kept.filter(F.col("broken") == 0)
        .groupBy(*keys)
        .agg(F.sum("hits").alias("inliers"), F.max("far_x").alias("max_supported_x"))
    )


def least_squares_plane(points: DataFrame, keys: list[str]) -> DataFrame:
    """Closed-form z = a x + b y + c per group; null when the normal equations are singular."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    sums = points.groupBy(*keys).agg(
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(x).alias("sx"),
        F.sum(y * y).alias("syy"), F.sum(y).alias("sy"), F.count(F.lit(1)).alias("n"),
        F.sum(x * z).alias("sxz"), F.sum(y * z).alias("syz"), F.sum(z).alias("sz"),
    )
    c = {n: F.col(n) for n in ("sxx", "sxy", "sx", "syy", "sy", "n", "sxz", "syz", "sz")}

    def det(p, q, r):
        (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = p, q, r
        return (
            a1 * (b2 * c3 - c2 * b3) - b1 * (a2 * c3 - c2 * a3) + c1 * (a2 * b3 - b2 * a3)
        )

    u, v = (c["sxx"], c["sxy"], c["sx"]), (c["sxy"], c["syy"], c["sy"])
    w, t = (c["sx"], c["sy"], c["n"]), (c["sxz"], c["syz"], c["sz"])
    whole = det(u, v, w)
    solid = F.abs(whole) >= 1e-9
    return sums.select(
        *keys, "n",
        F.when(solid, det(t, v, w) / whole).alias("a"),
        F.when(solid, det(u, t, w) / whole).alias("b"),
        F.when(solid, det(u, v, t) / whole).alias("c"),
    )


def wall_samples(points: DataFrame, keys: list[str], h: Column, center: Column, max_x: float):
    """Nearest wall return left and right of ``center`` per 1 m slice."""
    x, y = F.col("x"), F.col("y").cast("float").cast("double")
    seen = (
        (x >= WALL_MIN_X) & (x < max_x) & (F.abs(F.col("y")) <= 12) & (h >= 0.5) & (h <= 2.5)
    )
    left = y.between(center + WALL_MIN_M, center + WALL_MAX_M)
    right = y.between(center - WALL_MAX_M, center - WALL_MIN_M)
    return points.filter(seen).groupBy(*keys, trunc(x - WALL_MIN_X).alias("slice")).agg(
        F.min(F.when(left, y)).alias("left_y"), F.max(F.when(right, y)).alias("right_y")
    )


def profile_points(points: DataFrame, h: Column) -> DataFrame:
    """Side structure returns with their cross-section level, profile row and 5 cm bin."""
    x, y = F.col("x"), F.col("y")
    side = F.when(y > 0, 0).otherwise(1)
    level = F.least(trunc((F.col("h") - 0.3) / 0.1), F.lit(SECTION_BINS - 1))
    band = F.when(F.col("h") < 1, 0).when(F.col("h") < 2, 1).otherwise(2)
    return (
        points.withColumn("h", h)
        .filter(
            (x >= PROFILE_MIN_X) & (x < PROFILE_MAX_X) & F.abs(y).between(1, 4)
            & (F.col("h") >= 0.3) & (F.col("h") < 3)
        )
        .withColumns({
            "section": (side * SECTION_BINS + level).cast("int"),
            "row": (side * 3 + band).cast("int"),
            "bin": F.least(trunc((x - PROFILE_MIN_X) / PROFILE_STEP_M), F.lit(PROFILE_BINS - 1)),
            "lateral": F.abs(y).cast("float"),
        })
    )


def section_medians(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median of the lateral distance per side and 10 cm of height."""
    edges = [float(1 + i / 16) for i in range(1, 48)]
    found = rank_values(samples, [*keys, "section"], "lateral", {"median": upper_median}, edges)
    return found.select(*keys, "section", "median", "n")


def lateral_profile(samples: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    """Least departure from the section median per profile row and bin (float32)."""
    nearest = samples.groupBy(*keys, "section", "row", "bin").agg(F.min("lateral").alias("lateral"))
    return (
        nearest.join(medians.select(*keys, "section", "median"), [*keys, "section"])
        .groupBy(*keys, "row", "bin")
        .agg(F.min(F.col("lateral") - F.col("median")).alias("value"))
    )


def range_image(
    points: DataFrame, keys: list[str], cell_deg: float, origin=(0.0, 0.0, 0.0), keep=()
) -> DataFrame:
    """Nearest return per angular cell (the first one on ties)."""
    x, y, z = (F.col(n) - o for n, o in zip("xyz", origin))
    return (
        points.withColumns({
            "az": g.azimuth_cell(x, y, cell_deg), "el": g.elevation_cell(x, y, z, cell_deg),
            "range": g.norm(x, y, z),
        })
        .groupBy(*keys, "az", "el")
        .agg(first_by(["range", "raw_index"], "x", "y", "z", *keep).alias("p"))
        .select(*keys, "az", "el", "p.*")
    )


def elevation_channels(
    points: DataFrame, keys: list[str], elevation: Column, tolerance: float = 0.02,
    share: float = 0.1, bounds=None,
) -> DataFrame:
    """Sharp elevation values: groups of close values with a weighted centre.

    ``bounds`` cut the elevation axis; by default one slice per 10 degrees.
    """
    rounded = F.round(elevation, 3)
    counts = (
        points.groupBy(*keys, rounded.alias("value")).agg(F.count(F.lit(1)).alias("hits"))
    )
    bounds = bounds if bounds is not None else [float(v) for v in range(-80, 90, 10)]
    groups = SlicedOrder(keys, ["value"], bounds).islands(
        counts, tolerance,
        {"hits": F.col("hits"), "moment": F.col("value") * F.col("hits")},
    )
    largest = groups.groupBy(*keys).agg(F.max("hits").alias("largest"))
    strong = F.col("hits") >= share * F.col("largest")
    return (
        groups.join(largest, keys).filter(strong)
        .select(*keys, "hits", (F.col("moment") / F.col("hits")).alias("elevation"))
    )


def depth_pixels(
    points: DataFrame, keys: list[str], ring: str, width: int, height: int, depth: tuple,
    azimuth: tuple, keep=(),
) -> DataFrame:
    """Nearest point per image pixel, rows from rings and columns from azimuth."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    spread = points.groupBy(*keys).agg(
        F.min(ring).alias("_lo"), F.max(ring).alias("_hi")
    )
    seen = points.withColumns({"range": g.norm(x, y, z), "azimuth": g.azimuth_deg(x, y)})
    seen = salted_join(seen, spread, keys, "raw_index").filter(
        g.finite(F.col("range")) & F.col("range").between(*depth) & F.col("azimuth").between(*azimuth)
    )
    column = trunc((F.col("azimuth") - azimuth[0]) * (width - 1) / (azimuth[1] - azimuth[0]))
    flat = F.col("_hi") == F.col("_lo")
    row = F.when(flat, 0).otherwise(
        trunc((F.col(ring) - F.col("_lo")) * (height - 1)
              / F.when(flat, 1).otherwise(F.col("_hi") - F.col("_lo")))
    )
    tenth_mm = (F.col("range") * 1e4).cast("long")
    return (
        seen.withColumns({
            "px_row": F.least(F.greatest(row, F.lit(0)), F.lit(height - 1)),
            "px_col": F.least(F.greatest(column, F.lit(0)), F.lit(width - 1)),
            "near": tenth_mm,
        })
        .groupBy(*keys, "px_row", "px_col")
        .agg(first_by(["near", "raw_index"], "range", *keep).alias("p"))
        .select(*keys, "px_row", "px_col", "p.raw_index", F.col("p.range").alias("depth"),
                *[F.col(f"p.{k}") for k in keep])
    )


def equalized(pixels: DataFrame, keys: list[str], value: str, bounds) -> DataFrame:
    """Share of pixels at or below each distinct depth (histogram equalisation)."""
    counts = pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("pixels"))
    order = SlicedOrder(keys, [value], bounds)
    counts = order.running_sum(counts, {"upto": F.col("pixels")}, totals={"upto": "total"})
    return order.finish(
        counts.withColumn("share", F.col("upto") / F.col("total")).drop("upto", "total")
    )


def jet_channel(share: Column, anchors: list[float]) -> Column:
    """Piecewise linear palette over five equally spaced stops."""
    out = F.lit(anchors[-1])
    for i in range(len(anchors) - 2, -1, -1):
        lo, hi = i * 0.25, (i + 1) * 0.25
        line = anchors[i] + (anchors[i + 1] - anchors[i]) * (share - lo) / 0.25
        out = F.when(share <= hi, line).otherwise(out)
    return F.floor(out).cast("int")


# Palette anchors per colour channel.
JET_RED, JET_GREEN, JET_BLUE = [0, 0, 255, 255, 50], [0, 255, 255, 0, 0], [255, 255, 0, 0, 0]


def grey_level(share: Column) -> Column:
    return F.floor(60 + 195 * (1.0 - share)).cast("int")


def shared_labels_color(level: Column, label: Column) -> Column:
    """RGB of a labelled depth pixel: green corridor, red obstacle, grey otherwise."""
    sixth, quarter = F.floor(level / 6).cast("int"), F.floor(level / 4).cast("int")
    return (
        F.when(label == 2, F.array(F.lit(255), F.lit(40), F.lit(40)))
        .when(label == 1, F.array(sixth, level, quarter))
        .otherwise(F.array(level, level, level))
    )


def labelled_rgb(range_m: Column, label: Column, shade_range_m: float = 100.0) -> Column:
    """Packed 24-bit colour of a labelled point."""
    shade = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), range_m / shade_range_m))
    level = F.floor(45 + 150 * shade).cast("int")
    green = F.floor(110 + 145 * shade).cast("int")

    def pack(r, gr, b):
        return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(gr, 8)).bitwiseOR(b)

    return (
        F.when(label == 1, pack(F.lit(20), green, F.lit(50)))
        .when(label == 2, pack(F.lit(255), F.lit(40), F.lit(40)))
        .otherwise(pack(level, level, level))
    )
