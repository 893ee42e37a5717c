"""Lidar channels, rings and the returns inserted into a recorded cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathclear.functions import geometry as g
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.ranks import linear_percentiles
from pathclear.functions.settling import settle
from pathclear.operators.points import salted_join

TOLERANCE_DEG = 0.02
# Rows of a task that sorts whole groups twice, at some 400 bytes each.
TASK_ROWS = 500_000


def ring_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """Image row of every ring by median elevation; a ring without returns is interpolated.

    One row per ring and group: rings are 16-bit numbers, so the windows are bounded.
    """
    medians = linear_percentiles(
        points, [*keys, "ring"], "elevation", {"elevation": 0.5},
        bounds=[float(v) for v in range(-80, 90, 20)],
    ).drop("n")
    tops = medians.groupBy(*keys).agg(F.max("ring").alias("top"))
    rings = tops.select(*keys, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("ring"))
    at = Window.partitionBy(*keys).orderBy("ring")
    before = at.rowsBetween(Window.unboundedPreceding, 0)
    after = at.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("elevation").isNotNull(), F.struct("ring", "elevation"))
    filled = rings.join(medians, [*keys, "ring"], "left").withColumns({
        "lo": F.last(known, ignorenulls=True).over(before),
        "hi": F.first(known, ignorenulls=True).over(after),
    })
    span = F.nullif(F.col("hi.ring") - F.col("lo.ring"), F.lit(0))
    between = F.col("lo.elevation") + (F.col("hi.elevation") - F.col("lo.elevation")) * (
        F.col("ring") - F.col("lo.ring")
    ) / span
    elevation = F.coalesce(
        F.col("elevation"), between, F.col("lo.elevation"), F.col("hi.elevation")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("elevation", "ring")) - 1
    return (
        filled.withColumn("elevation", elevation)
        .select(*keys, "ring", "elevation", rank.alias("image_row"))
    )


def _channel_arrays(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Ascending channel elevations per group (a lidar has a fixed, small channel count)."""
    return channels.groupBy(*keys).agg(F.array_sort(F.collect_list("elevation")).alias("channels"))


def recover_rings(
    points: DataFrame, channels: DataFrame, keys: list[str], min_range: float
) -> DataFrame:
    """One row per point and ring; a point between two channels appears on both."""
    arrays = _channel_arrays(channels, keys).filter(F.size("channels") > 1).withColumn(
        "slopes", F.transform("channels", lambda c: F.tan(F.radians(c)))
    )
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    seen = points.filter(g.norm(x, y, z) >= max(min_range, 1e-3)).withColumn(
        "slope", z / F.greatest(g.norm(x, y), F.lit(1e-6))
    )
    placed = salted_join(seen, arrays, keys, "raw_index")
    n = F.size("slopes")
    below_count = F.size(F.filter("slopes", lambda c: c < F.col("slope")))
    placed = placed.withColumn("up", F.least(F.greatest(below_count, F.lit(1)), n - 1))
    scale = (180.0 / 3.141592653589793) / (1 + F.col("slope") * F.col("slope"))
    above = (F.col("slope") - F.get("slopes", F.col("up") - 1)) * scale
    below = (F.get("slopes", F.col("up")) - F.col("slope")) * scale
    nearest = F.when(above <= below, F.col("up") - 1).otherwise(F.col("up"))
    other = F.when(above <= below, F.col("up")).otherwise(F.col("up") - 1)
    rings = F.when(
        F.least(above, below) > TOLERANCE_DEG, F.array(n - 1 - nearest, n - 1 - other)
    ).otherwise(F.array(n - 1 - nearest))
    return placed.withColumn("ring", F.explode(rings)).drop("channels", "slopes", "up", "slope")


def off_channel(elevation: Column, channels: Column) -> Column:
    """Farther than the tolerance from every channel; never with fewer than two channels."""
    gap = F.array_min(F.transform(channels, lambda c: F.abs(elevation - c)))
    return F.when(F.size(channels) < 2, False).otherwise(gap > TOLERANCE_DEG)


def block_report(points: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """Size of the trailing run of intensity 1.0 and its returns that lie off every channel."""
    ends = points.groupBy(*keys).agg(
        F.max(F.when(F.col("intensity") != 1.0, F.col("raw_index"))).alias("last_other")
    )
    facts = ends.join(_channel_arrays(channels, keys), keys, "left")
    marked = salted_join(points, facts, keys, "raw_index")
    block = F.col("raw_index") > F.coalesce(F.col("last_other"), F.lit(-1))
    off = off_channel(F.col("elevation"), F.col("channels"))
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(block).alias("block"),
        F.count_if(block & off).alias("block_off_channel"),
        F.count_if(~block & off).alias("recorded_off_channel"),
    )


def dealt(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows shuffled by ``keys`` to tasks of about ``task_rows``, whatever the number of shuffle partitions."""
    rows = df.agg(F.count(F.lit(1))).first()[0]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
    return df.repartition(tasks, *keys)


def gap_clusters(
    points: DataFrame, keys: list[str], gap_x: float = 3.0, gap_y: float = 1.5
) -> DataFrame:
    """Points cut at gaps along x, then each part at gaps across y: count and exact box.

    Equal coordinates are merged before the ordered passes, so copies cannot pile up in a slice. Rows are dealt to as
    many tasks as they need, so that a task holds no more of a larger table.
    """
    spread = dealt(points.select(*keys, *"xyz"), [*keys, "x", "y"])
    merged = settle(spread.groupBy(*keys, "x", "y").agg(
        F.count(F.lit(1)).alias("n"), F.min("z").alias("lo_z"), F.max("z").alias("hi_z")
    ))
    x_order = SlicedOrder.fit(merged, keys, ["x", "y"])
    parts = x_order.finish(x_order.tag_islands(merged if x_order.hot else dealt(merged, keys), gap_x, "gx"))
    # Where no group is cut along x, no part of one has to be cut along y.
    along_y = [*keys, "gx"], ["y", "x"]
    y_order = SlicedOrder.fit(parts, *along_y) if x_order.hot else SlicedOrder(*along_y, [])
    parts = y_order.finish(y_order.tag_islands(parts, gap_y, "gy"))
    return parts.groupBy(*keys, "gx", "gy").agg(
        F.sum("n").alias("n"), F.min("x").alias("min_x"), F.min("y").alias("min_y"),
        F.min("lo_z").alias("min_z"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.max("hi_z").alias("max_z"),
    )
