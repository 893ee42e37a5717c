"""Synthetic obstacles in recorded clouds: rays, occlusion, placement and the benchmark report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathclear.functions import geometry as g
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.ranks import linear_percentiles

# Fixed values of the synthetic benchmark.
SCENARIOS = {
    "static": {"size": (0.5, 0.5, 1.7), "lateral": 0.0, "crossing": False, "on_rails": False},
    "box": {"size": (1.0, 1.0, 0.5), "lateral": 0.3, "crossing": False, "on_rails": True},
    "crossing": {"size": (0.5, 0.5, 1.7), "lateral": 0.0, "crossing": True, "on_rails": False},
}
CROSSING_SPEED_MPS, CROSSING_HALF_WIDTH_M, RAIL_BELOW_LIDAR_M = 1.0, 1.5, 1.075
MIN_VISIBLE_POINTS, MAX_EVENT_DISTANCE_M, MAX_RANGE_M, ROI_PAD_M = 10, 200.0, 200.0, 0.1
FLOOR_RESIDUAL_M, ROUNDING_M = 0.2, 1e-9


def _box_entry(df: DataFrame, direction: list[str], low, high, unit: Column) -> DataFrame:
    """Adds ``entry``; directions may have any length, ``unit`` is that length in metres."""
    enter, leave = g.ray_box_span([F.col(d) for d in direction], low, high)
    df = df.withColumns({"_enter": enter, "_leave": leave})
    entry = g.entry_distance(F.col("_enter"), F.col("_leave")) * unit
    return df.withColumn("entry", entry).drop("_enter", "_leave")


def occlude(points: DataFrame, low, high) -> DataFrame:
    """Returns behind the box move along their ray onto its surface.

    The slab test runs on the point itself as direction: cheap to push down with ``hidden``.
    """
    df = points.withColumn("range", g.norm(*[F.col(c) for c in "xyz"]))
    df = _box_entry(df, ["x", "y", "z"], low, high, F.col("range"))
    hidden = g.finite(F.col("range")) & (F.col("entry") < F.col("range") - 1e-6)
    df = df.withColumn("hidden", hidden)
    share = F.when(F.col("hidden"), F.col("entry") / F.col("range")).otherwise(1.0)
    return df.withColumns({f"moved_{c}": F.col(c) * share for c in "xyz"})


def fill_empty(cells: DataFrame, low, high) -> DataFrame:
    """Cells without a return whose ray meets the box in range get a return on its surface."""
    hit = _box_entry(cells, ["dx", "dy", "dz"], low, high, F.lit(1.0))
    return hit.filter(F.col("entry") <= MAX_RANGE_M).withColumns(
        {c: F.col(f"d{c}") * F.col("entry") for c in "xyz"}
    )


def median_rays(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median elevation per cloud row and median azimuth per column, in radians."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    range_m = g.norm(x, y, z)
    seen = points.filter(g.finite(range_m) & (range_m > 0)).select(
        *keys, F.explode(F.array(
            F.struct(F.lit("row").alias("axis"), F.col("row").cast("int").alias("line"),
                     F.asin(z / range_m).alias("angle")),
            F.struct(F.lit("column").alias("axis"), F.col("column").cast("int").alias("line"),
                     F.atan2(y, x).alias("angle")),
        )).alias("ray"),
    ).select(*keys, "ray.*")
    return linear_percentiles(
        seen, [*keys, "axis", "line"], "angle", {"angle": 0.5},
        bounds=[-1.0, -0.5, -0.2, -0.1, 0.0, 0.1, 0.2, 0.5, 1.0],
    ).drop("n")


def ray_directions(rays: DataFrame, keys: list[str]) -> DataFrame:
    """Unit ray of every (row, column) cell from the median angles."""
    rows = rays.filter("axis = 'row'").select(*keys, F.col("line").alias("row"), F.col("angle").alias("el"))
    cols = rays.filter("axis = 'column'").select(*keys, F.col("line").alias("column"), F.col("angle").alias("az"))
    return rows.join(cols, keys).select(
        *keys, "row", "column", (F.cos("el") * F.cos("az")).alias("dx"),
        (F.cos("el") * F.sin("az")).alias("dy"), F.sin("el").alias("dz"),
    )


def estimate_floor(points: DataFrame, keys: list[str], min_returns: int = 20) -> DataFrame:
    """Floor line per group: low percentile per 2 m slice, refitted without outliers.

    A slice exactly at the residual limit stays; the rounding of sums, which depends on the order in which rows
    arrive, does not decide it.
    """
    x = F.col("x")
    band = points.filter((F.abs("y") < 1.2) & (x >= 3) & (x < 60)).withColumn(
        "slice", F.floor((x - 3) / 2)
    )
    slices = linear_percentiles(
        band, [*keys, "slice"], "z", {"z": 0.1}, bounds=[-2.0, -1.5, -1.0, 0.0]
    ).filter(F.col("n") >= min_returns).select(
        *keys, (3 + 2 * F.col("slice") + 1.0).alias("x"), "z"
    )
    kept, line = slices, None
    for _ in range(3):
        line = kept.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("slices"), F.regr_slope("z", "x").alias("slope"),
            F.regr_intercept("z", "x").alias("intercept"),
        ).filter(F.col("slices") >= 5)
        near = F.abs(F.col("z") - (F.col("intercept") + F.col("slope") * F.col("x")))
        near = near <= FLOOR_RESIDUAL_M + ROUNDING_M
        kept = slices.join(line.select(*keys, "slope", "intercept"), keys).filter(near).select(
            *keys, "x", "z"
        )
    enough = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("left")).filter(F.col("left") >= 5)
    return line.join(enough.select(*keys), keys).select(*keys, "slope", "intercept")


def odometry(rows: DataFrame, order: SlicedOrder, stamp: str, speed: Column, per_s: float):
    """Travel so far: each step uses the current row's non-negative speed."""
    df = order.lag(rows, "_before", F.col(stamp))
    step = F.coalesce(
        F.greatest(F.coalesce(speed, F.lit(0.0)), F.lit(0.0))
        * ((F.col(stamp) - F.col("_before")) / per_s), F.lit(0.0)
    )
    df = order.running_sum(df.withColumn("_step", step), {"travel": F.col("_step")})
    return df.drop("_before", "_step")


def widest_window(rows: DataFrame, order: SlicedOrder, stamp: str, window) -> DataFrame:
    """Per group: the window of at most ``window`` with the largest travel (earliest on ties).

    The first row inside each window is found by placing a marker at its start.
    """
    keys = order.keys
    ends = rows.select(*keys, F.col(stamp).alias("at"), F.col(stamp).alias("last"),
                       F.col("travel"), F.lit(1).alias("kind"))
    starts = ends.withColumns({"at": F.col("at") - window, "kind": F.lit(0)})
    sweep = SlicedOrder(keys, ["at", "kind", "last"], order.bounds)
    first = F.when(F.col("kind") == 1, F.struct(F.col("last").alias("first"), F.col("travel").alias("from")))
    found = sweep.next_known(ends.unionByName(starts), {"begin": first}).filter("kind = 0")
    gain = F.col("travel") - F.col("begin.from")
    return found.groupBy(*keys).agg(
        F.min(F.struct((-gain).alias("less"), F.col("last"), F.col("begin.first").alias("first"))).alias("w")
    ).select(*keys, "w.first", "w.last", (-F.col("w.less")).alias("travel"))


def obstacle_box(
    scenario: str, x_center: Column, time_s: Column, floor_z: Column, centre: Column
) -> tuple[list[Column], list[Column]]:
    """(low, high) corners of the obstacle around the route centre."""
    spec = SCENARIOS[scenario]
    sx, sy, sz = spec["size"]
    lateral = F.lit(spec["lateral"])
    if spec["crossing"]:
        lateral = g.crossing_lateral(time_s, CROSSING_HALF_WIDTH_M, CROSSING_SPEED_MPS)
    y = lateral + centre
    return (
        [x_center - sx / 2, y - sy / 2, floor_z], [x_center + sx / 2, y + sy / 2, floor_z + sz]
    )


def floor_for(scenario: str, plane, x_center: Column, centre: Column) -> Column:
    """Height the object stands on: the floor, or the rail heads for one lying on the track."""
    spec = SCENARIOS[scenario]
    base = g.floor_at(plane, x_center, centre + spec["lateral"])
    if spec["on_rails"]:
        base = base - RAIL_BELOW_LIDAR_M - g.floor_at(plane, F.lit(0.0), F.lit(0.0))
    return base


def plan_obstacle(
    rows: DataFrame, order: SlicedOrder, window_ns: int, final_distance_m: float
) -> DataFrame:
    """Obstacle position per reference frame of the chosen window of every recording."""
    keys = order.keys
    moved = order.finish(
        odometry(rows, order, "bag_stamp_ns", F.col("ego_speed_mps"), 1e9)
    )
    chosen = widest_window(moved, order, "bag_stamp_ns", window_ns).withColumnRenamed("travel", "gain")
    ends = moved.select(*keys, F.col("bag_stamp_ns").alias("last"), F.col("travel").alias("end_travel"))
    plan = moved.join(chosen, keys).join(ends, [*keys, "last"])
    inside = F.col("bag_stamp_ns").between(F.col("first"), F.col("last"))
    return plan.filter(inside).select(
        *keys, "bag_stamp_ns",
        (final_distance_m + F.col("end_travel") - F.col("travel")).alias("x_center"),
        ((F.col("bag_stamp_ns") - F.col("first")) / 1e9).alias("time_s"), "ground_plane",
    )


def injection_annotation(log: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled span per synthetic recording: visible from the first frame with enough returns."""
    visible = (F.col("hidden_points") >= MIN_VISIBLE_POINTS) & (
        F.col("distance_m") <= MAX_EVENT_DISTANCE_M
    )
    spans = log.groupBy(*keys).agg(
        F.min("bag_stamp_ns").alias("begin"), F.max("bag_stamp_ns").alias("end"),
        F.min(F.when(visible, F.col("bag_stamp_ns"))).alias("start"),
    ).filter(F.col("start").isNotNull())
    positive = F.struct(F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), F.lit("positive").alias("label"))
    negative = F.struct(F.col("begin").alias("start_ns"), F.col("start").alias("end_ns"), F.lit("negative").alias("label"))
    parts = F.when(F.col("start") > F.col("begin"), F.array(negative, positive)).otherwise(F.array(positive))
    return spans.select(*keys, F.explode(parts).alias("i")).select(*keys, "i.*")
