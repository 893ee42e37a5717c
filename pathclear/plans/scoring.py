"""Quality of a whole run: every recording scored at once, then totals per split and overall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.settling import settle
from pathclear.operators import scoring as sc
from pathclear.operators import timeline as tl

BAG = ["bag_id"]
STAMP = "bag_stamp_ns"


@dataclass(frozen=True)
class Rules:
    event_gap_s: float = sc.EVENT_GAP_S
    stamp_tolerance_s: float = sc.STAMP_TOLERANCE_S
    roi_margin_m: float = sc.ROI_MARGIN_M

    @property
    def gap_ns(self) -> int:
        return int(self.event_gap_s * 1e9)

    @property
    def tolerance_ns(self) -> int:
        return int(self.stamp_tolerance_s * 1e9)


def score(
    exports: DataFrame, intervals: DataFrame, events: DataFrame, references: DataFrame,
    ranges: DataFrame | None = None, rules: Rules = Rules(),
) -> dict[str, DataFrame]:
    """Tables of one run, keyed by recording.

    ``ranges``: bag_id, working_range_m.  Only recordings with intervals are scored.  A row with an unknown
    state or an impossible time ends the job.
    """
    scored = intervals.select("bag_id").distinct()
    frames = sc.checked(exports.join(scored, BAG, "left_semi")).withColumn(
        "objects", sc.decisive(F.col("tracks"), F.col("candidates"))
    )
    order = SlicedOrder.fit(frames.select("bag_id", STAMP), BAG, [STAMP])
    labelled = settle(tl.label_frames(frames, intervals, BAG, STAMP, order.bounds))
    negative = labelled.filter("label = 'negative'")
    positive_refs = references.filter("label = 'positive'").drop("label")
    negative_refs = references.filter("label = 'negative'").drop("label")
    checks = settle(sc.object_checks(
        positive_refs, labelled, BAG, "ref_stamp_ns", STAMP, order.bounds, rules.tolerance_ns,
        rules.roi_margin_m,
    ))
    on_negative = settle(sc.negative_object_checks(
        negative_refs, labelled, BAG, "ref_stamp_ns", STAMP, order.bounds, rules.tolerance_ns,
        rules.roi_margin_m,
    ))
    runs = sc.negative_runs(labelled, order, STAMP)
    alarms = settle(sc.alarm_events(negative, order, rules.gap_ns))
    detection = sc.event_detection(labelled, events, BAG, STAMP, order.bounds)
    confirmation = sc.event_confirmation(
        checks, events.filter("label = 'positive'"), BAG, "ref_stamp_ns", "start_ns"
    )
    tables = {
        "summary": sc.run_summary(frames, BAG),
        "contingency": sc.contingency(labelled, BAG),
        "frame": sc.confusion_ratios(sc.confusion(labelled, BAG)),
        "coverage": sc.coverage(labelled, [*BAG, "label"]),
        "coverage_scored": sc.coverage(labelled.filter("label <> 'unlabeled'"), BAG),
        "unknown_reasons": sc.unknown_reasons(labelled, [*BAG, "label"]),
        "alarm_events": alarms,
        "negative_time": runs.groupBy(*BAG).agg(
            (F.sum(F.col("end") - F.col("start")) / 1e9).alias("negative_duration_s")
        ),
        "occupancy": sc.alarm_occupancy(negative, order, STAMP, rules.gap_ns, 1e9),
        "events": detection.join(confirmation, [*BAG, "id"], "left"),
        "checks": checks,
        "by_distance": sc.by_distance(checks, BAG),
        "distance_error": sc.distance_error(checks, BAG),
        "negative_objects": sc.negative_object_totals(on_negative, BAG, STAMP),
        "negative_object_events": sc.negative_object_events(on_negative, BAG),
    }
    if ranges is not None:
        ranged = checks.join(ranges, BAG)
        tables["working_range"] = sc.within_range(ranged, BAG, F.col("working_range_m"))
    return tables


def summary_of_run(exports: DataFrame) -> dict:
    """Frames, states and times of a whole run without labels, for ``runtime_report`` and ``write_summary``.

    A run without frames is refused, as are rows that are no results (``scoring.checked``).
    """
    if exports.isEmpty():
        raise ValueError("a run without frames")
    found = sc.run_summary(sc.checked(exports), []).first()
    if found is None:  # no frame has a time
        found = sc.run_summary(sc.checked(exports).withColumn("processing_ms", F.lit(0.0)), []).first()
        return {**found.asDict(), "p50": None, "p95": None, "p99": None, "bad_timings": 0}
    return {**found.asDict(), "bad_timings": 0}


def bag_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of summable counts per recording."""
    events = tables["events"].groupBy(*BAG).agg(
        F.count(F.lit(1)).alias("positive_events"), F.count_if("detected").alias("detected_events")
    )
    alarms = tables["alarm_events"].groupBy(*BAG).agg(F.count(F.lit(1)).alias("fp_events"))
    objects = tables["checks"].groupBy(*BAG).agg(
        F.count(F.lit(1)).alias("object_reference_frames"),
        F.count_if(F.col("result") == "hit").alias("object_hits"),
        F.count_if(F.col("result") == "wrong_object").alias("object_wrong"),
    )
    quiet = tables["negative_objects"].select(
        "bag_id", F.col("reference_frames").alias("negative_object_frames"),
        F.col("alarm_frames").alias("negative_object_alarm_frames"),
        F.col("alarm_frames_on_negative").alias("negative_object_alarm_frames_on_negative"),
    )
    counts = tables["frame"].drop("frame_recall", "frame_precision", "false_alarm_rate")
    for part in (tables["negative_time"], events, alarms, objects, quiet):
        counts = counts.join(part, BAG, "left")
    return counts.na.fill(0)


def totals(counts: DataFrame, splits: DataFrame) -> DataFrame:
    """Sums per split and overall (``total``); ratios are recomputed from the sums."""
    named = counts.join(splits, BAG, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))
    sums = [c for c in counts.columns if c not in BAG]
    rolled = named.rollup("split").agg(
        F.count(F.lit(1)).alias("bags"), *[F.sum(c).alias(c) for c in sums]
    ).withColumn("split", F.coalesce("split", F.lit("total")))
    rate = sc.ratio(F.col("fp_events"), F.col("negative_duration_s") / 60)
    return sc.confusion_ratios(rolled).withColumns({
        "event_recall": sc.ratio(F.col("detected_events"), F.col("positive_events")),
        "fp_events_per_min": rate,
        "object_recall": sc.ratio(F.col("object_hits"), F.col("object_reference_frames")),
    })


def range_totals(tables: dict[str, DataFrame], splits: DataFrame) -> DataFrame:
    """Working-range slice per split and overall, with the set of ranges that took part."""
    named = tables["working_range"].join(splits, BAG, "left").withColumn(
        "split", F.coalesce("split", F.lit("unassigned"))
    )
    rolled = named.rollup("split").agg(
        F.array_sort(F.collect_set("range_m")).alias("ranges_m"), F.count(F.lit(1)).alias("bags"),
        *[F.sum(c).alias(c) for c in ("reference_frames", "beyond_frames", "obstacle", "hits")],
    )
    near = F.col("reference_frames")
    return rolled.withColumns({
        "split": F.coalesce("split", F.lit("total")),
        "state_recall": sc.ratio(F.col("obstacle"), near), "object_recall": sc.ratio(F.col("hits"), near),
    })


def holdout(exports: DataFrame, boundaries: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Alarm totals of blind recordings from their boundary on; null totals without results."""
    late = exports.join(boundaries, BAG).filter(F.col(STAMP) >= F.col("from_ns"))
    order = SlicedOrder.fit(late.select("bag_id", STAMP), BAG, [STAMP])
    found = sc.holdout_totals(late, order, STAMP, rules.gap_ns, 1e9)
    return boundaries.select(*BAG).join(found, BAG, "left")
