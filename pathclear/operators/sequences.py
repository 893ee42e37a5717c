"""Row sequences: sessions, samples, runs, hit windows and catalogues of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathclear.functions import geometry as g
from pathclear.functions.ordering import SLICE, SlicedOrder
from pathclear.functions.text import fixed
from pathclear.functions.ranks import rank_values, upper_median
from pathclear.operators.scoring import distance_bin, object_class, ratio
from pathclear.operators.synthetic import MAX_EVENT_DISTANCE_M, MIN_VISIBLE_POINTS


def sessions(rows: DataFrame, order: SlicedOrder, stamp: str) -> DataFrame:
    """Session number: grows by one whenever the stamp steps back in arrival order."""
    rows = order.lag(rows, "_before", F.col(stamp))
    back = F.when(F.col(stamp) < F.col("_before"), 1).otherwise(0)
    return order.running_sum(rows.withColumn("_back", back), {"session": F.col("_back")}).drop(
        "_before", "_back"
    )


def bind_first(rows: DataFrame, keys: list[str], order: str, frame_id: str) -> DataFrame:
    """Source bound to a session: the frame id of its first row."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(order, frame_id)).alias("_f")).select(
        *keys, F.col(f"_f.{frame_id}").alias("source_frame")
    )
    return rows.join(first, keys)


def latest_only(rows, keys: list[str], stamp: str, age: str, max_age_ms: float) -> DataFrame:
    """Newest row per trigger with the number of overwritten ones and whether it is fresh."""
    others = [c for c in rows.columns if c not in (*keys, stamp)]
    newest = rows.groupBy(*keys).agg(
        F.max(F.struct(stamp, *others)).alias("_n"), (F.count(F.lit(1)) - 1).alias("dropped")
    )
    return newest.select(
        *keys, "_n.event_id", "dropped", (F.col(f"_n.{age}") <= max_age_ms).alias("fresh")
    )


def head_of_each(rows: DataFrame, order: SlicedOrder, count: int) -> DataFrame:
    """First ``count`` rows of every group, ranked inside slices before the groups are joined up."""
    local = order.cut(rows).withColumn("nth", F.row_number().over(order.local()))
    few = local.filter(F.col("nth") <= count)
    whole = Window.partitionBy(*order.keys).orderBy(*order.order)
    return few.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= count).drop(SLICE)


def hits_in_window(rows: DataFrame, order: SlicedOrder, hit: Column, window: int) -> DataFrame:
    """Number of hits among the last ``window`` rows, the current one included."""
    rows = order.neighbours(rows, "_past", hit, window - 1)
    past = F.size(F.filter("_past", lambda s: s["v"]))
    return rows.withColumn("hits", past + F.when(hit, 1).otherwise(0)).drop("_past")


def drifting(rows: DataFrame, order: SlicedOrder, offset: Column, step: float = 0.02) -> DataFrame:
    """Outward drift over the last three offsets."""
    rows = order.neighbours(rows, "_past", offset, 2)
    one, two = (F.try_element_at("_past", F.lit(-i))["v"] for i in (1, 2))
    moving = (offset > one + step) & (one > two + step)
    return rows.withColumn("drifting", F.coalesce(moving, F.lit(False))).drop("_past")


def persistence(
    rows: DataFrame, order: SlicedOrder, time_s: Column, center: list[Column], window: int,
    radius: float, speed: float,
) -> DataFrame:
    """Frames of the window (this one included) with a candidate near the same place."""
    here = F.struct(time_s.alias("t"), F.array(*center).alias("c"))
    rows = order.neighbours(rows.withColumn("_here", here), "_past", F.col("_here"), window - 1)

    def near(s):
        apart = g.norm(*[F.get(F.col("_here.c"), i) - F.get(s["v"]["c"], i) for i in range(len(center))])
        return apart <= radius + speed * F.abs(F.col("_here.t") - s["v"]["t"])

    return rows.withColumn("hits", 1 + F.size(F.filter("_past", near))).drop("_here", "_past")


def synthetic_recall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hits per distance bin of visible frames, with the rounding of the sweep summary."""
    seen = rows.filter(
        (F.col("hidden_points") >= MIN_VISIBLE_POINTS) & (F.col("distance_m") < MAX_EVENT_DISTANCE_M)
    )
    counts = seen.groupBy(*keys, distance_bin(F.col("distance_m")).alias("from_m")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("hit").alias("hits")
    )
    recall = F.round(ratio(F.col("hits"), F.col("frames")), 3)
    return counts.withColumn("recall", recall).withColumn(
        "swept_hits", F.round(F.col("recall") * F.col("frames")).cast("long")
    )


def false_alarm_catalogue(rows, keys, stamp, route, per_s) -> DataFrame:
    """One row per event of tagged alarm rows (``island``) with spans over its objects."""
    event = [*keys, "island"]
    valid = F.col("ego_motion_valid")
    frames = rows.groupBy(*event).agg(
        F.min(stamp).alias("start"), F.max(stamp).alias("end"), F.count(F.lit(1)).alias("frames"),
        F.count_if("coasting").alias("coasting_frames"),
        F.count_if(~valid).alias("ego_invalid_frames"),
        F.min(F.struct(stamp, "last_break")).alias("_first"),
    )
    speeds = rank_values(
        rows.filter(valid), event, "ego_speed_mps", {"ego_speed_mps": upper_median},
        [0.005, 0.01, 0.05, 0.1, 1.0, 5.0, 10.0, 20.0],
    ).drop("n")
    objects = rows.select(*event, "travelled_m", F.explode("objects").alias("o"))
    x, y, z = (F.get("o.center", i) for i in range(3))
    half = F.get("o.size", 2) / 2
    offset = g.route_offset(x, y, route)
    world = F.col("travelled_m") + x
    spans = objects.groupBy(*event, F.col("o.id").alias("id")).agg(
        (F.max(world) - F.min(world)).alias("travel"), F.min("o.distance_m").alias("d0"),
        F.max("o.distance_m").alias("d1"), F.min(offset).alias("off0"), F.max(offset).alias("off1"),
        F.min(z - half).alias("h0"), F.max(z + half).alias("h1"),
    ).groupBy(*event).agg(
        F.count(F.lit(1)).alias("tracks"), F.max("travel").alias("world_x_travel_m"),
        F.min("d0").alias("min_distance_m"), F.max("d1").alias("max_distance_m"),
        F.min("off0").alias("min_offset_m"), F.max("off1").alias("max_offset_m"),
        F.min("h0").alias("bottom_m"), F.max("h1").alias("top_m"),
    )
    out = frames.join(speeds, event, "left").join(spans, event, "left")
    since = (F.col("start") - F.col("_first.last_break")) / per_s
    return out.withColumns(
        {"since_ego_break_s": since, "tracks": F.coalesce("tracks", F.lit(0))}
    ).drop("_first")


def false_alarm_classes(rows: DataFrame, keys: list[str], route) -> DataFrame:
    objects = rows.select(*keys, "island", F.explode("objects").alias("o"))
    offset = F.abs(g.route_offset(F.get("o.center", 0), F.get("o.center", 1), route))
    name = object_class(offset, F.get("o.size", 0), F.col("o.channels"))
    return objects.groupBy(*keys, "island", name.alias("class")).agg(F.count(F.lit(1)).alias("objects"))


def label_runs(rows: DataFrame, order: SlicedOrder, stamp: str) -> DataFrame:
    """Runs of equal labels with the sorted evidence names and their distance span."""
    keys = order.keys
    rows = order.lag(rows, "_was", F.col("label"))
    start = F.when(F.col("_was").eqNullSafe(F.col("label")), 0).otherwise(1)
    rows = order.running_sum(rows.withColumn("_start", start), {"run": F.col("_start")})
    names = F.array_join(F.array_sort(F.collect_set("reason")), ", ")
    runs = rows.groupBy(*keys, "run").agg(
        F.min(stamp).alias("start"), F.max(stamp).alias("end"), F.max("label").alias("label"),
        F.count(F.lit(1)).alias("frames"), names.alias("_names"),
        F.max("distance_m").alias("_far"), F.min("distance_m").alias("_near"),
    )
    span = F.format_string("%s %s->%s m", "_names", fixed(F.col("_far"), 1), fixed(F.col("_near"), 1))
    return runs.withColumn("evidence", span).drop("_names", "_far", "_near")


def strongest_kind(marks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Strongest kind per frame and the sorted distinct notes of that kind only.

    Notes are made distinct before they meet, so many equal marks on one frame stay one row.
    """
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("kind") == name, i).otherwise(rank)
    per_kind = marks.select(*keys, "kind", "note", rank.alias("_rank")).distinct().groupBy(
        *keys, "_rank", "kind"
    ).agg(F.array_sort(F.collect_set("note")).alias("notes"))
    return per_kind.groupBy(*keys).agg(F.min(F.struct("_rank", "kind", "notes")).alias("_b")).select(
        *keys, "_b.kind", "_b.notes"
    )


def event_references(refs: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Span, number of reference frames and the first and last near distance of every event."""
    edge = F.struct(stamp, "near_m")
    return refs.groupBy(*keys).agg(
        F.min(stamp).alias("start"), F.max(stamp).alias("end"), F.count(F.lit(1)).alias("frames"),
        F.min(edge).alias("_a"), F.max(edge).alias("_z"),
    ).select(
        *keys, "start", "end", "frames", F.col("_a.near_m").alias("first_m"),
        F.col("_z.near_m").alias("last_m"),
    )


def nested_references(refs: DataFrame, keys: list[str], stamp: str, fields: list[str]) -> DataFrame:
    """Reference frames of an annotated event as one ordered array (an event is one passage)."""
    return refs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(stamp, *fields))).alias("reference_frames")
    )


def video_frames(rows: DataFrame, keys: list[str], stamp: str, name: str, per_s: float, fps: float):
    """First frame of every constant-rate index and how often it is written."""
    starts = rows.groupBy(*keys).agg(F.min(stamp).alias("_t0"))
    index = F.bround((F.col(stamp) - F.col("_t0")) / per_s * fps).cast("long")
    kept = rows.join(starts, keys).groupBy(*keys, index.alias("video_index")).agg(
        F.min(F.struct(stamp, name)).alias("_f")
    )
    order = SlicedOrder.fit(kept, keys, ["video_index"])
    kept = order.lead(kept, "_next", F.col("video_index"))
    return order.finish(kept).select(
        *keys, "video_index", F.col(f"_f.{name}").alias(name),
        F.coalesce(F.col("_next") - F.col("video_index"), F.lit(1)).alias("copies"),
    )
