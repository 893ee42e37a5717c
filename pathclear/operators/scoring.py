"""Scoring of exported frames against reviewed annotations.

Everything is computed for all recordings at once, keyed by ``keys``; ratios are formed from sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.functions import geometry as g
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.ranks import linear_percentiles, rank_values, truncated
from pathclear.functions.settling import settle
from pathclear.operators.timeline import count_in_spans, nearest_in_time

STATES = ["OBSTACLE", "NO_OBSTACLE_DETECTED", "UNKNOWN"]
# Object distance bins in metres, the last one open.
DISTANCE_BINS_M = [0, 20, 40, 60, 80, 100, 120, 150, 200]
EVENT_GAP_S, STAMP_TOLERANCE_S, ROI_MARGIN_M = 0.5, 0.05, 0.5


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null when the whole is zero or unknown."""
    return F.try_divide(part, whole)


def is_state(state: str) -> Column:
    return F.col("state") == state


def checked(frames: DataFrame) -> DataFrame:
    """The same rows; reading one with an unknown state or an impossible time ends the job.

    A time that is null was not measured, which is no error.
    """
    state, time = F.col("state"), F.col("processing_ms")
    named = F.coalesce(state.isin(STATES), F.lit(False))
    timed = time.isNull() | (g.finite(time) & (time >= 0))
    told = F.concat(F.lit("no result row: state "), F.coalesce(state, F.lit("null")),
                    F.lit(", processing_ms "), F.coalesce(time.cast("string"), F.lit("null")))
    return frames.filter(F.when(named & timed, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def run_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """State counts, share of UNKNOWN, timing percentiles and counts of rows that are invalid."""
    time = F.col("processing_ms")
    counts = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.count_if(is_state(s)).alias(s.lower()) for s in STATES],
        F.count_if(~F.col("state").isin(STATES)).alias("bad_states"),
        F.count_if(~g.finite(time) | (time < 0)).alias("bad_timings"),
    )
    timing = linear_percentiles(
        frames, keys, "processing_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ).drop("n")
    joined = counts.join(timing, keys) if keys else counts.crossJoin(timing)
    return joined.withColumn("unknown_fraction", ratio(F.col("unknown"), F.col("frames")))


def contingency(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys, "label", "state").agg(F.count(F.lit(1)).alias("frames"))


def confusion(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Frame-level counts; UNKNOWN on a positive frame is a miss."""
    alarm, unknown = is_state("OBSTACLE"), is_state("UNKNOWN")
    on = {name: F.col("label") == name for name in ("positive", "negative", "uncertain")}
    return labelled.groupBy(*keys).agg(
        *[F.count_if(on[n]).alias(f"{n}_frames") for n in on],
        F.count_if(on["positive"] & alarm).alias("tp"),
        F.count_if(on["positive"] & ~alarm).alias("fn"),
        F.count_if(on["negative"] & alarm).alias("fp"),
        F.count_if(on["positive"] & unknown).alias("unknown_on_positive"),
    )


def confusion_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, positive = F.col("tp"), F.col("fp"), F.col("positive_frames")
    return counts.withColumns({
        "frame_recall": ratio(tp, positive),
        "frame_precision": F.when(positive > 0, ratio(tp, tp + fp)),
        "false_alarm_rate": ratio(fp, F.col("negative_frames")),
    })


def alarm_events(frames: DataFrame, order: SlicedOrder, gap) -> DataFrame:
    """OBSTACLE rows whose steps are at most ``gap`` merge into one event."""
    return order.islands(frames.filter(is_state("OBSTACLE")), gap)


def negative_runs(labelled: DataFrame, order: SlicedOrder, stamp: str) -> DataFrame:
    """Runs of negative frames that are consecutive in the full row list."""
    member = F.col("label") == "negative"
    rows = order.lag(labelled, "_was", member)
    started = F.when(member & ~F.coalesce(F.col("_was"), F.lit(False)), 1).otherwise(0)
    rows = order.running_sum(rows.withColumn("_start", started), {"run": F.col("_start")})
    return rows.filter(member).groupBy(*order.keys, "run").agg(
        F.min(stamp).alias("start"), F.max(stamp).alias("end"), F.count(F.lit(1)).alias("frames")
    )


def alarm_occupancy(negative: DataFrame, order: SlicedOrder, stamp: str, gap, per_s: float):
    """Seconds under alarm: each alarm lasts until the next row, at most one median step."""
    keys = order.keys
    rows = order.lead(negative, "_next", F.col(stamp))
    rows = rows.withColumn("_step", F.col("_next") - F.col(stamp))
    steps = rows.withColumn(
        "_usual", F.when((F.col("_step") > 0) & (F.col("_step") <= gap), F.col("_step")).cast("double")
    )
    cadence = linear_percentiles(steps, keys, "_usual", {"cadence": 0.5}).drop("n")
    alarms = rows.groupBy(*keys).agg(
        F.count_if(is_state("OBSTACLE")).alias("alarms"), F.count(F.lit(1)).alias("rows")
    )
    timed = rows.filter(is_state("OBSTACLE")).select(*keys, "_step").join(cadence, keys)
    held = timed.groupBy(*keys).agg(
        F.sum(F.least(F.coalesce(F.col("_step"), F.col("cadence")), F.col("cadence"))).alias("held")
    )
    out = alarms.join(held, keys, "left")
    seconds = (
        F.when(F.col("alarms") == 0, 0.0)
        .when(F.col("rows") >= 2, F.col("held") / per_s)
    )
    return out.select(*keys, "alarms", seconds.alias("alarm_duration_s"))


def coverage(frames: DataFrame, keys: list[str], bounds=None) -> DataFrame:
    """Share of evaluated frames, share of decisions and the median evaluated range."""
    seen = F.col("evaluated_range_m") > 0
    counts = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        ratio(F.count_if(seen), F.count(F.lit(1))).alias("observed"),
        ratio(F.count_if(~is_state("UNKNOWN")), F.count(F.lit(1))).alias("decision_coverage"),
    )
    median = linear_percentiles(
        frames.filter(seen), keys, "evaluated_range_m", {"median_evaluated_range_m": 0.5}, bounds
    ).drop("n")
    return counts.join(median, keys, "left")


def unknown_reasons(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.filter(is_state("UNKNOWN")).groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("frames")
    )


def event_detection(frames, events, keys, stamp, bounds, start="start_ns", end="end_ns", per_s=1e9):
    """Per positive event: frames, alarms and the first alarm's delay and distance."""
    alarm = is_state("OBSTACLE")
    found = count_in_spans(
        frames, events.filter(F.col("label") == "positive"), keys, "id", stamp, bounds,
        {"frames": F.lit(1), "obstacle_frames": alarm},
        {"first": F.when(alarm, F.struct("distance_m"))}, start, end,
    )
    return found.select(
        *keys, "id", "frames", "obstacle_frames", (F.col("obstacle_frames") > 0).alias("detected"),
        ((F.col("first.at") - F.col(start)) / per_s).alias("first_alarm_delay_s"),
        F.col("first.v.distance_m").alias("first_alarm_distance_m"),
    )


def decisive(tracks: Column, candidates: Column | None = None) -> Column:
    """Objects behind a decision: confirmed tracks, or candidates of exports without tracks."""
    confirmed = F.filter(tracks, lambda t: t["confirmed"])
    return confirmed if candidates is None else F.when(tracks.isNotNull(), confirmed).otherwise(candidates)


def _in_roi(obj, low, high, margin):
    return g.box_contains(
        [F.get(obj["center"], i) for i in range(3)], [F.get(low, i) for i in range(3)],
        [F.get(high, i) for i in range(3)], margin,
    )


def _objects(frame):
    return frame["objects"]


def object_checks(refs, frames, keys, ref_stamp, stamp, bounds, tolerance, margin=ROI_MARGIN_M, objects=_objects):
    """hit, miss, wrong_object or no_frame for every positive reference frame with a ROI.

    ``refs`` carry ``reference_m``, ``roi_min`` and ``roi_max`` arrays; ``frames`` carry ``state``
    and ``objects`` (array of structs with ``center`` and ``distance_m``), or what the function ``objects`` makes
    them of: only frames that a reference meets need them, so they are not sorted along time.
    """
    near = nearest_in_time(refs, frames, keys, ref_stamp, stamp, bounds).filter(
        F.col("frame").isNotNull()
    )
    near = near.withColumn("_objects", objects(F.col("frame")))
    matched = F.filter(
        F.col("_objects"), lambda o: _in_roi(o, F.col("roi_min"), F.col("roi_max"), margin)
    )
    near = near.withColumns({
        "far": F.abs(F.col(f"frame.{stamp}") - F.col(ref_stamp)) > tolerance,
        "reported_m": F.array_min(F.transform(matched, lambda o: o["distance_m"])),
        "matched": F.coalesce(F.size(matched) > 0, F.lit(False)),
        "object_m": F.coalesce(F.col("reference_m"), F.get("roi_min", 0)),
    })
    result = (
        F.when(F.col("far"), "no_frame").when(F.col("frame.state") != "OBSTACLE", "miss")
        .when(~F.col("matched"), "wrong_object").otherwise("hit")
    )
    near = near.withColumn("result", result)
    hit = F.col("result") == "hit"
    return near.withColumns({
        "state": F.when(~F.col("far"), F.col("frame.state")),
        "reported_m": F.when(hit, F.col("reported_m")),
        "error_m": F.when(hit, F.col("reported_m") - F.col("reference_m")),
    }).drop("frame", "far", "matched", "_objects")


def distance_error(checks: DataFrame, keys: list[str]) -> DataFrame:
    error = F.abs("error_m")
    return checks.groupBy(*keys).agg(
        F.count("error_m").alias("matched"), F.avg(error).alias("mean_abs_error_m"),
        F.max(error).alias("max_abs_error_m"),
    )


def distance_bin(distance: Column, edges=tuple(DISTANCE_BINS_M)) -> Column:
    """Lower edge of the left-closed bin; anything nearer counts in the first."""
    out = F.lit(edges[0])
    for edge in edges[1:]:
        out = F.when(distance >= edge, edge).otherwise(out)
    return out


def by_distance(checks: DataFrame, keys: list[str]) -> DataFrame:
    hits = F.count_if(F.col("result") == "hit")
    return checks.groupBy(*keys, distance_bin(F.col("object_m")).alias("from_m")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(is_state("OBSTACLE")).alias("obstacle"),
        hits.alias("hits"), ratio(hits, F.count(F.lit(1))).alias("recall"),
    )


def within_range(checks: DataFrame, keys: list[str], range_m: Column) -> DataFrame:
    """State and object recall over the references inside the working range."""
    near = F.col("object_m") <= range_m
    obstacle = F.count_if(near & is_state("OBSTACLE"))
    hits = F.count_if(near & (F.col("result") == "hit"))
    return checks.filter(range_m.isNotNull()).groupBy(*keys).agg(
        F.max(range_m).alias("range_m"), F.count_if(near).alias("reference_frames"),
        F.count_if(~near).alias("beyond_frames"), obstacle.alias("obstacle"), hits.alias("hits"),
        ratio(obstacle, F.count_if(near)).alias("state_recall"),
        ratio(hits, F.count_if(near)).alias("object_recall"),
    )


def event_confirmation(checks: DataFrame, events: DataFrame, keys, ref_stamp, start, per_s=1e9):
    """First matched reference frame of every event, by reference time."""
    hit = F.col("result") == "hit"
    first = checks.filter(hit).groupBy(*keys, "id").agg(
        F.min(F.struct(ref_stamp, "reported_m")).alias("first")
    )
    return events.join(first, [*keys, "id"], "left").select(
        *keys, "id", F.col("first").isNotNull().alias("object_confirmed"),
        F.col("first.reported_m").alias("first_matched_distance_m"),
        ((F.col(f"first.{ref_stamp}") - F.col(start)) / per_s).alias("first_matched_delay_s"),
    )


def negative_object_checks(refs, labelled, keys, ref_stamp, stamp, bounds, tolerance, margin=ROI_MARGIN_M, objects=_objects):
    """Alarms on annotated objects that must not raise one; one row per usable reference.

    ``objects`` as in ``object_checks``.
    """
    near = nearest_in_time(refs, labelled, keys, ref_stamp, stamp, bounds)
    near = near.withColumn("_objects", objects(F.col("frame")))
    close = F.abs(F.col(f"frame.{stamp}") - F.col(ref_stamp)) <= tolerance
    on_object = F.exists(
        F.col("_objects"), lambda o: _in_roi(o, F.col("roi_min"), F.col("roi_max"), margin)
    )
    alarm = (F.col("frame.state") == "OBSTACLE") & F.coalesce(on_object, F.lit(False))
    return near.filter(close).select(
        *keys, "id", F.col(f"frame.{stamp}").alias(stamp), alarm.alias("alarm"),
        F.col("frame.label").alias("label"),
    )


def negative_object_totals(checks: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Distinct frames, not references: one frame may hold several objects."""
    per_frame = checks.groupBy(*keys, stamp).agg(
        F.max("alarm").alias("alarm"), F.max("label").alias("label")
    )
    return per_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reference_frames"), F.count_if("alarm").alias("alarm_frames"),
        F.count_if(F.col("alarm") & (F.col("label") == "negative")).alias("alarm_frames_on_negative"),
    )


def negative_object_events(checks: DataFrame, keys: list[str]) -> DataFrame:
    positive = F.col("label") == "positive"
    return checks.groupBy(*keys, "id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("alarm").alias("alarm_frames"),
        F.count_if(positive).alias("positive_frames"),
        F.count_if(positive & F.col("alarm")).alias("alarm_frames_on_positive"),
    )


def holdout_totals(frames: DataFrame, order: SlicedOrder, stamp: str, gap, per_s: float):
    """Alarm totals only, rounded: frames, alarms, events, duration, rate, share of UNKNOWN."""
    keys = order.keys
    totals = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(is_state("OBSTACLE")).alias("obstacle_frames"),
        F.count_if(is_state("UNKNOWN")).alias("unknown"),
        ((F.max(stamp) - F.min(stamp)) / per_s).alias("seconds"),
    )
    events = alarm_events(frames, order, gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    joined = totals.join(events, keys, "left").withColumn("events", F.coalesce("events", F.lit(0)))
    rate = F.when(F.col("seconds") > 0, F.round(60 * F.col("events") / F.col("seconds"), 3))
    return joined.select(
        *keys, "frames", "obstacle_frames", "events", F.round("seconds", 1).alias("duration_s"),
        rate.alias("events_per_min"),
        F.round(ratio(F.col("unknown"), F.col("frames")), 4).alias("unknown_share"),
    )


def travelled(rows: DataFrame, order: SlicedOrder, stamp: str, per_s: float) -> DataFrame:
    """Distance along the track per row; an invalid speed holds the last valid one."""
    speed = F.when(F.col("ego_motion_valid"), F.col("ego_speed_mps"))
    df = order.last_known(rows, {"_speed": speed})
    df = order.lag(df, "_before", F.col(stamp))
    step = F.coalesce(F.col("_speed"), F.lit(0.0)) * F.greatest(
        F.lit(0.0), (F.col(stamp) - F.col("_before")) / per_s
    )
    df = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return order.running_sum(df, {"travelled_m": F.col("_step")}).drop("_speed", "_before", "_step")


def object_class(offset: Column, length: Column, channels: Column) -> Column:
    """Descriptive class, for example ``edge-long-M``."""
    name = F.when(offset <= 0.9, "gauge").when(offset <= 1.5, "mid").otherwise("edge")
    return F.concat(
        name, F.when(length > 3.0, "-long").otherwise(""),
        F.when(channels.bitwiseAND(1) > 0, "-M").otherwise(""),
        F.when(channels.bitwiseAND(2) > 0, "-G").otherwise(""),
    )


def speed_plausibility(rows, order: SlicedOrder, stamp, per_s, acceleration=3.0, quantisation=0.5):
    """Implausible speed changes and sudden standstills between valid rows."""
    keys = order.keys
    valid = rows.filter(F.col("ego_motion_valid"))
    seen = order.lag(valid, "_was", F.struct(F.col(stamp).alias("at"), F.col("ego_speed_mps").alias("v")))
    dt = F.greatest(F.lit(1e-3), (F.col(stamp) - F.col("_was.at")) / per_s)
    jump = F.abs(F.col("ego_speed_mps") - F.col("_was.v")) > acceleration * dt + quantisation
    drop = (F.col("_was.v") > 5.0) & (F.col("ego_speed_mps") < 0.5)
    changes = seen.groupBy(*keys).agg(
        F.count_if(jump).alias("jumps"), F.count_if(drop).alias("drops_to_standstill")
    )
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(~F.col("ego_motion_valid")).alias("invalid_frames"),
    )
    return totals.join(changes, keys, "left").na.fill(0, ["jumps", "drops_to_standstill"])


def theil_sen(rows, order: SlicedOrder, time_s: Column, distance: Column, half_window: int = 3):
    """Approach speed per row: minus the median of pairwise slopes over neighbouring rows.

    At most ``2 half_window + 1`` points per row, so the pairs stay inside one small array.
    """
    point = F.when(distance.isNotNull(), F.struct(time_s.alias("t"), distance.alias("d")))
    df = order.around(rows.withColumn("_p", point), "_p", F.col("_p"), half_window)
    # Written out pair by pair: lambdas over arrays run interpreted, at many times the cost.
    own = [f"_p_{i}" for i in range(-half_window, 0)] + ["_p"] + [f"_p_{i}" for i in range(1, half_window + 1)]
    near = [F.col("_p") if c == "_p" else F.col(c)["v"] for c in own]
    present = sum((p.isNotNull().cast("int") for p in near), F.lit(0))
    times = [p["t"] for p in near]
    df = df.filter(
        F.col("_p").isNotNull() & (present >= 2 * half_window) & (F.greatest(*times) > F.least(*times))
    )
    slopes = [
        F.when(a["t"] != b["t"], (b["d"] - a["d"]) / (b["t"] - a["t"])) for i, a in enumerate(near) for b in near[i + 1:]
    ]
    df = df.withColumn("_slopes", F.sort_array(F.array_compact(F.array(*slopes))))
    n = F.size("_slopes")
    median = (F.get("_slopes", F.floor((n - 1) / 2).cast("int")) + F.get("_slopes", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("approach_mps", -median).drop("_slopes", *own)


def speed_error(rows: DataFrame, keys: list[str], bounds=None) -> DataFrame:
    """Absolute speed error against the reference; invalid rows are counted apart."""
    error = F.when(F.col("ego_motion_valid"), F.abs(F.col("ego_speed_mps") - F.col("approach_mps")))
    # Settled: the errors are made once, for the counts and for the ranks.
    rows = settle(rows.select(*keys, "ego_motion_valid", error.alias("_error")))
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reference_frames"),
        F.count_if(~F.col("ego_motion_valid")).alias("invalid_frames"),
        F.max("_error").alias("max_mps"), F.count_if(F.col("_error") > 1.0).alias("over_1_mps"),
    )
    half = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)}
    ranks = rank_values(rows, keys, "_error", {"p95_mps": truncated(0.95), **half}, bounds).drop("n")
    middle = F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5
    ranks = ranks.withColumn("median_mps", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(middle))
    return counts.join(ranks.drop("_low", "_high"), keys, "left")


def bag_audit(rows, order: SlicedOrder, stamp, frame_id, points, gap, bounds=None) -> DataFrame:
    """Stamps, periods, gaps, frame ids and cloud sizes of every recording."""
    keys = order.keys
    df = order.lag(rows, "_before", F.col(stamp)).withColumn("_period", F.col(stamp) - F.col("_before"))
    facts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.min(stamp).alias("first_stamp"),
        F.max(stamp).alias("last_stamp"),
        F.array_join(F.array_sort(F.collect_set(frame_id)), ",").alias("frame_ids"),
        F.min(points).alias("min_points"), F.max(points).alias("max_points"),
        F.min("_period").alias("min_period"), F.max("_period").alias("max_period"),
        F.coalesce(F.bool_and(F.col("_period") > 0), F.lit(True)).alias("monotonic"),
        F.count_if(F.col("_period") > gap).alias("gaps"),
    )
    return facts
