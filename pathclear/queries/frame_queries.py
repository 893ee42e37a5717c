"""Queries on exported frames: labels, events, objects, runs and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathclear.functions import text
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.ranks import linear_percentiles, upper_median, rank_values
from pathclear.operators import points as pts_ops
from pathclear.operators import scoring as sc
from pathclear.operators import sequences as sq
from pathclear.operators import timeline as tl
from pathclear.queries.registry import query
from pathclear.queries.views import FRAMES_SQL, frames, frames_order

BAG = ["bag_id"]
GAP_US = 2 * 3600 * 1_000_000
TOLERANCE_US = 300 * 1_000_000

INTERVALS_SQL = """
intervals AS (
  SELECT bag_id, stamp_us AS start_us, stamp_us + (k + 1) * 600000000 AS end_us,
    CASE k % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'uncertain' END AS label
  FROM frames WHERE reason = 'purchase'
)"""
LABELLED_SQL = f"""
{INTERVALS_SQL}, cover AS (
  SELECT f.event_id, min(CASE label WHEN 'positive' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END) AS p
  FROM frames f JOIN intervals i ON f.bag_id = i.bag_id AND f.stamp_us BETWEEN start_us AND end_us GROUP BY 1
), labelled AS (
  SELECT f.*, CASE p WHEN 0 THEN 'positive' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'negative' ELSE 'unlabeled' END AS label
  FROM frames f LEFT JOIN cover USING (event_id)
)"""
FL = f"WITH {FRAMES_SQL}, {LABELLED_SQL}"


def intervals(spark, sf_dir):
    name = F.when(F.col("k") % 3 == 0, "positive").when(F.col("k") % 3 == 1, "negative")
    return frames(spark, sf_dir).filter("reason = 'purchase'").select(
        "bag_id", F.col("stamp_us").alias("start_us"),
        (F.col("stamp_us") + (F.col("k") + 1) * 600_000_000).alias("end_us"),
        name.otherwise("uncertain").alias("label"),
    )


def labelled(spark, sf_dir, source=None):
    order = frames_order(spark, sf_dir)
    return tl.label_frames(
        source if source is not None else frames(spark, sf_dir), intervals(spark, sf_dir), BAG,
        "stamp_us", order.bounds, "start_us", "end_us",
    )


@query("q_label_join", f"{FL} SELECT bag_id, event_id, state, label FROM labelled")
def label_join(spark, sf_dir):
    """Strongest label of all intervals over a frame."""
    return labelled(spark, sf_dir).select("bag_id", "event_id", "state", "label")


@query("q_confusion", f"""{FL}, c AS (
  SELECT bag_id, count(*) FILTER (label = 'positive') AS positive_frames, count(*) FILTER (label = 'negative') AS negative_frames,
    count(*) FILTER (label = 'uncertain') AS uncertain_frames, count(*) FILTER (label = 'positive' AND state = 'OBSTACLE') AS tp,
    count(*) FILTER (label = 'positive' AND state <> 'OBSTACLE') AS fn, count(*) FILTER (label = 'negative' AND state = 'OBSTACLE') AS fp,
    count(*) FILTER (label = 'positive' AND state = 'UNKNOWN') AS unknown_on_positive
  FROM labelled GROUP BY bag_id
)
SELECT *, round(tp / nullif(positive_frames, 0), 9) AS frame_recall,
  CASE WHEN positive_frames > 0 THEN round(tp / nullif(tp + fp, 0), 9) END AS frame_precision,
  round(fp / nullif(negative_frames, 0), 9) AS false_alarm_rate FROM c""")
def confusion(spark, sf_dir):
    """A2 A4: frame-level counts with ratios from sums."""
    counts = sc.confusion_ratios(sc.confusion(labelled(spark, sf_dir), BAG))
    return counts.withColumns(
        {c: F.round(c, 9) for c in ("frame_recall", "frame_precision", "false_alarm_rate")}
    )


@query("q_contingency", f"{FL} SELECT bag_id, label, state, count(*) AS frames FROM labelled GROUP BY ALL")
def contingency(spark, sf_dir):
    """A3: label by state counts."""
    return sc.contingency(labelled(spark, sf_dir), BAG)


def islands_sql(source: str, gap: int = GAP_US) -> str:
    return f"""
marked AS (
  SELECT *, CASE WHEN stamp_us - lag(stamp_us) OVER w <= {gap} THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY bag_id ORDER BY stamp_us)
), numbered AS (
  SELECT *, CAST(sum(new) OVER (PARTITION BY bag_id ORDER BY stamp_us) AS BIGINT) AS island FROM marked
), alarm_events AS (
  SELECT bag_id, island, min(stamp_us) AS start, max(stamp_us) AS "end", count(*) AS rows FROM numbered GROUP BY ALL
)"""


@query("q_alarm_events", f"""WITH {FRAMES_SQL}, alarms AS (SELECT * FROM frames WHERE state = 'OBSTACLE'), {islands_sql('alarms')}
SELECT * FROM alarm_events""")
def alarm_events(spark, sf_dir):
    """Alarms grouped by an inclusive gap."""
    return sc.alarm_events(frames(spark, sf_dir), frames_order(spark, sf_dir), GAP_US)


@query("q_false_alarm_rate", f"""{FL}, alarms AS (SELECT * FROM labelled WHERE state = 'OBSTACLE' AND label = 'negative'), {islands_sql('alarms')},
e AS (SELECT bag_id, count(*) AS events, sum("end" - start) / 1e6 AS event_span_s FROM alarm_events GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY stamp_us) - row_number() OVER (PARTITION BY bag_id, label = 'negative' ORDER BY stamp_us) AS run FROM labelled),
n AS (SELECT bag_id, sum(d) / 1e6 AS negative_s FROM (SELECT bag_id, max(stamp_us) - min(stamp_us) AS d FROM r WHERE label = 'negative' GROUP BY bag_id, run) GROUP BY bag_id)
SELECT bag_id, events, round(event_span_s, 6) AS event_span_s, round(negative_s, 6) AS negative_s, round(events / nullif(negative_s / 60, 0), 6) AS events_per_min FROM e JOIN n USING (bag_id)""")
def false_alarm_rate(spark, sf_dir):
    """False-alarm events per minute of negative time."""
    order, rows = frames_order(spark, sf_dir), labelled(spark, sf_dir)
    events = sc.alarm_events(rows.filter("label = 'negative'"), order, GAP_US).groupBy(*BAG).agg(
        F.count(F.lit(1)).alias("events"),
        (F.sum(F.col("end") - F.col("start")) / 1e6).alias("event_span_s"),
    )
    quiet = sc.negative_runs(rows, order, "stamp_us").groupBy(*BAG).agg(
        (F.sum(F.col("end") - F.col("start")) / 1e6).alias("negative_s")
    )
    rate = sc.ratio(F.col("events"), F.col("negative_s") / 60)
    return events.join(quiet, BAG).select(
        "bag_id", "events", F.round("event_span_s", 6).alias("event_span_s"),
        F.round("negative_s", 6).alias("negative_s"), F.round(rate, 6).alias("events_per_min"),
    )


@query("q_negative_runs", f"""{FL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY stamp_us) - row_number() OVER (PARTITION BY bag_id, label = 'negative' ORDER BY stamp_us) AS g FROM labelled
), runs AS (SELECT bag_id, min(stamp_us) AS start, max(stamp_us) AS "end", count(*) AS frames FROM r WHERE label = 'negative' GROUP BY bag_id, g)
SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY start) AS run FROM runs""")
def negative_runs(spark, sf_dir):
    """Runs of negative frames consecutive in the full list."""
    return sc.negative_runs(labelled(spark, sf_dir), frames_order(spark, sf_dir), "stamp_us")


@query("q_alarm_occupancy", f"""{FL}, neg AS (
  SELECT *, lead(stamp_us) OVER (PARTITION BY bag_id ORDER BY stamp_us) - stamp_us AS step FROM labelled WHERE label = 'negative'
), cad AS (SELECT bag_id, median(CAST(step AS DOUBLE)) FILTER (step > 0 AND step <= {GAP_US}) AS cadence FROM neg GROUP BY 1)
SELECT bag_id, count(*) FILTER (state = 'OBSTACLE') AS alarms,
  CASE WHEN count(*) FILTER (state = 'OBSTACLE') = 0 THEN 0.0e0 WHEN count(*) >= 2 THEN
    round(sum(least(coalesce(step, cadence), cadence)) FILTER (state = 'OBSTACLE' AND cadence IS NOT NULL) / 1e6, 6) END AS alarm_duration_s
FROM neg JOIN cad USING (bag_id) GROUP BY bag_id""")
def alarm_occupancy(spark, sf_dir):
    """Time under alarm, each alarm lasting at most one median step."""
    negative = labelled(spark, sf_dir).filter("label = 'negative'")
    out = sc.alarm_occupancy(negative, frames_order(spark, sf_dir), "stamp_us", GAP_US, 1e6)
    return out.withColumn("alarm_duration_s", F.round("alarm_duration_s", 6))


@query("q_run_summary", f"""WITH {FRAMES_SQL}
SELECT bag_id, count(*) AS frames, count(*) FILTER (state = 'OBSTACLE') AS obstacle,
  count(*) FILTER (state = 'NO_OBSTACLE_DETECTED') AS no_obstacle_detected, count(*) FILTER (state = 'UNKNOWN') AS unknown,
  count(*) FILTER (state NOT IN ('OBSTACLE', 'NO_OBSTACLE_DETECTED', 'UNKNOWN')) AS bad_states,
  count(*) FILTER (distance_m < 0) AS bad_timings, round(count(*) FILTER (state = 'UNKNOWN') / count(*), 9) AS unknown_fraction,
  round(quantile_cont(distance_m, 0.5), 6) AS p50, round(quantile_cont(distance_m, 0.95), 6) AS p95, round(quantile_cont(distance_m, 0.99), 6) AS p99
FROM frames GROUP BY bag_id""")
def run_summary(spark, sf_dir):
    """A1 Q-A: state counts and timing percentiles."""
    rows = frames(spark, sf_dir).withColumn("processing_ms", F.col("distance_m"))
    out = sc.run_summary(rows, BAG)
    return out.withColumns({
        "unknown_fraction": F.round("unknown_fraction", 9),
        **{p: F.round(p, 6) for p in ("p50", "p95", "p99")},
    })


TRACKS_SQL = """
objects AS (
  SELECT bag_id, event_id, event_id % 5 AS id, k % 4 <> 0 AS confirmed, distance_m AS cx, (k - 50) / 20.0e0 AS cy, 0.0e0 AS cz, k / 20.0e0 AS sx, 1.7e0 AS sz, distance_m AS d, k % 4 AS channels FROM frames
  UNION ALL
  SELECT bag_id, event_id, event_id % 5 + 5, k % 3 = 0, distance_m + 5, (50 - k) / 25.0e0, 0.5e0, k / 40.0e0, 1.0e0, distance_m + 5, k % 3 FROM frames
)"""


def tracks(k, distance, event_id):
    """Two objects per frame made from its own columns."""
    def one(number, confirmed, x, y, z, length, tall, channels):
        return F.struct(
            number.alias("id"), confirmed.alias("confirmed"),
            F.array(x, y, F.lit(z)).alias("center"),
            F.array(length, F.lit(0.5), F.lit(tall)).alias("size"),
            x.alias("distance_m"), channels.cast("int").alias("channels"),
        )

    return F.array(
        one(event_id % 5, k % 4 != 0, distance, (k - 50) / 20.0, 0.0, k / 20.0, 1.7, k % 4),
        one(event_id % 5 + 5, k % 3 == 0, distance + 5, (50 - k) / 25.0, 0.5, k / 40.0, 1.0, k % 3),
    )


def objects_of(frame):
    return sc.decisive(tracks(frame["k"], frame["distance_m"], frame["event_id"]))


def plain_frames(spark, sf_dir):
    return frames(spark, sf_dir).select("bag_id", "stamp_us", "event_id", "state", "distance_m", "k")


def frames_with_objects(spark, sf_dir):
    made = tracks(F.col("k"), F.col("distance_m"), F.col("event_id"))
    return frames(spark, sf_dir).withColumn("objects", sc.decisive(made))


REFS_SQL = """
refs AS (
  SELECT bag_id, event_id AS ref_id, stamp_us + 90000000 AS at_us, 'object ' || (k % 10) AS id,
    CASE WHEN k % 2 = 0 THEN 'positive' ELSE 'negative' END AS kind, CASE WHEN k % 3 <> 0 THEN distance_m END AS reference_m,
    distance_m * 0.5e0 - 2 AS lo_x, distance_m * 0.5e0 + 16 AS hi_x
  FROM frames WHERE reason = 'purchase'
)"""
NEAREST_SQL = f"""
{REFS_SQL}, prev AS (
  SELECT r.ref_id, f.event_id, f.stamp_us FROM refs r ASOF LEFT JOIN frames f ON r.bag_id = f.bag_id AND r.at_us >= f.stamp_us
), nxt AS (
  SELECT r.ref_id, f.event_id, f.stamp_us FROM refs r ASOF LEFT JOIN frames f ON r.bag_id = f.bag_id AND r.at_us < f.stamp_us
), nearest AS (
  SELECT r.*, CASE WHEN n.stamp_us IS NULL OR r.at_us - p.stamp_us <= n.stamp_us - r.at_us THEN p.event_id ELSE n.event_id END AS near_id
  FROM refs r JOIN prev p USING (ref_id) JOIN nxt n USING (ref_id)
)"""


def references(spark, sf_dir):
    k, d = F.col("k"), F.col("distance_m")
    return frames(spark, sf_dir).filter("reason = 'purchase'").select(
        "bag_id", F.col("event_id").alias("ref_id"), (F.col("stamp_us") + 90_000_000).alias("at_us"),
        F.concat(F.lit("object "), (k % 10).cast("string")).alias("id"),
        F.when(k % 2 == 0, "positive").otherwise("negative").alias("kind"),
        F.when(k % 3 != 0, d).alias("reference_m"),
        F.array(d * 0.5 - 2, F.lit(-1.5), F.lit(-1.0)).alias("roi_min"),
        F.array(d * 0.5 + 16, F.lit(1.5), F.lit(1.0)).alias("roi_max"),
    )


@query("q_asof_nearest", f"""WITH {FRAMES_SQL}, {NEAREST_SQL}
SELECT r.bag_id, ref_id, near_id, abs(f.stamp_us - at_us) AS apart_us, abs(f.stamp_us - at_us) <= {TOLERANCE_US} AS usable
FROM nearest r JOIN frames f ON f.event_id = near_id""")
def asof_nearest(spark, sf_dir):
    """Nearest frame in time, the earlier one on a tie, with a tolerance."""
    near = tl.nearest_in_time(
        references(spark, sf_dir), frames(spark, sf_dir), BAG, "at_us", "stamp_us",
        frames_order(spark, sf_dir).bounds,
    )
    apart = F.abs(F.col("frame.stamp_us") - F.col("at_us"))
    return near.select(
        "bag_id", "ref_id", F.col("frame.event_id").alias("near_id"), apart.alias("apart_us"),
        (apart <= TOLERANCE_US).alias("usable"),
    )


CHECKS_SQL = f"""
{NEAREST_SQL}, {TRACKS_SQL}, hits AS (
  SELECT ref_id, min(d) AS reported FROM nearest r JOIN objects o ON o.event_id = near_id AND confirmed
    AND cx >= lo_x - 0.5 AND cx <= hi_x + 0.5 AND cy >= -2 AND cy <= 2 AND cz >= -1.5 AND cz <= 1.5 GROUP BY 1
), checks AS (
  SELECT r.*, f.state AS frame_state, f.stamp_us, abs(f.stamp_us - at_us) > {TOLERANCE_US} AS far, reported,
    CASE WHEN abs(f.stamp_us - at_us) > {TOLERANCE_US} THEN 'no_frame' WHEN f.state <> 'OBSTACLE' THEN 'miss' WHEN reported IS NULL THEN 'wrong_object' ELSE 'hit' END AS result,
    coalesce(reference_m, lo_x) AS object_m
  FROM nearest r JOIN frames f ON f.event_id = near_id LEFT JOIN hits USING (ref_id)
), positive_checks AS (
  SELECT bag_id, ref_id, id, at_us, result, CASE WHEN NOT far THEN frame_state END AS state, CASE WHEN result = 'hit' THEN reported END AS reported_m,
    CASE WHEN result = 'hit' THEN reported - reference_m END AS error_m, reference_m, object_m FROM checks WHERE kind = 'positive'
)"""
CHECKS = f"WITH {FRAMES_SQL}, {CHECKS_SQL}"


def checks(spark, sf_dir):
    refs = references(spark, sf_dir).filter("kind = 'positive'")
    return sc.object_checks(
        refs, plain_frames(spark, sf_dir), BAG, "at_us", "stamp_us",
        frames_order(spark, sf_dir).bounds, TOLERANCE_US, objects=objects_of,
    )


@query("q_object_checks", f"""{CHECKS}
SELECT bag_id, ref_id, id, result, state, round(reported_m, 9) AS reported_m, round(error_m, 9) AS error_m, round(object_m, 9) AS object_m FROM positive_checks""")
def object_checks(spark, sf_dir):
    """Annotated objects against the decisive objects of the nearest frame."""
    return checks(spark, sf_dir).select(
        "bag_id", "ref_id", "id", "result", "state",
        *[F.round(c, 9).alias(c) for c in ("reported_m", "error_m", "object_m")],
    )


@query("q_distance_error", f"""{CHECKS}
SELECT bag_id, count(error_m) AS matched, round(avg(abs(error_m)), 6) AS mean_abs_error_m, round(max(abs(error_m)), 6) AS max_abs_error_m FROM positive_checks GROUP BY bag_id""")
def distance_error(spark, sf_dir):
    """Absolute distance error of the hits."""
    return sc.distance_error(checks(spark, sf_dir), BAG).withColumns(
        {c: F.round(c, 6) for c in ("mean_abs_error_m", "max_abs_error_m")}
    )


BIN_SQL = "CASE WHEN object_m >= 200 THEN 200 WHEN object_m >= 150 THEN 150 WHEN object_m >= 120 THEN 120 WHEN object_m >= 100 THEN 100 WHEN object_m >= 80 THEN 80 WHEN object_m >= 60 THEN 60 WHEN object_m >= 40 THEN 40 WHEN object_m >= 20 THEN 20 ELSE 0 END"


@query("q_distance_bins", f"""{CHECKS}
SELECT bag_id, {BIN_SQL} AS from_m, count(*) AS frames, count(*) FILTER (state = 'OBSTACLE') AS obstacle, count(*) FILTER (result = 'hit') AS hits,
  round(count(*) FILTER (result = 'hit') / count(*), 9) AS recall FROM positive_checks GROUP BY ALL""")
def distance_bins(spark, sf_dir):
    """Object checks per distance bin."""
    return sc.by_distance(checks(spark, sf_dir), BAG).withColumn("recall", F.round("recall", 9))


@query("q_working_range", f"""{CHECKS}, w AS (
  SELECT bag_id, CASE WHEN bag_id <> 0 THEN 20.0e0 + bag_id * 10 END AS range_m, p.* EXCLUDE (bag_id) FROM positive_checks p
)
SELECT bag_id, max(range_m) AS range_m, count(*) FILTER (object_m <= range_m) AS reference_frames, count(*) FILTER (object_m > range_m) AS beyond_frames,
  count(*) FILTER (object_m <= range_m AND state = 'OBSTACLE') AS obstacle, count(*) FILTER (object_m <= range_m AND result = 'hit') AS hits,
  round(count(*) FILTER (object_m <= range_m AND state = 'OBSTACLE') / nullif(count(*) FILTER (object_m <= range_m), 0), 9) AS state_recall,
  round(count(*) FILTER (object_m <= range_m AND result = 'hit') / nullif(count(*) FILTER (object_m <= range_m), 0), 9) AS object_recall
FROM w WHERE range_m IS NOT NULL GROUP BY bag_id""")
def working_range(spark, sf_dir):
    """Recall inside the working range of each recording."""
    range_m = F.when(F.col("bag_id") != 0, 20.0 + F.col("bag_id") * 10)
    return sc.within_range(checks(spark, sf_dir), BAG, range_m).withColumns(
        {c: F.round(c, 9) for c in ("state_recall", "object_recall")}
    )


EVENTS_SQL = """
events_dim AS (
  SELECT bag_id, event_id AS id, stamp_us AS start_us, stamp_us + k * 300000000 AS end_us, CASE WHEN k % 2 = 0 THEN 'positive' ELSE 'negative' END AS label
  FROM frames WHERE reason = 'signup'
)"""


def annotated_events(spark, sf_dir):
    return frames(spark, sf_dir).filter("reason = 'signup'").select(
        "bag_id", F.col("event_id").alias("id"), F.col("stamp_us").alias("start_us"),
        (F.col("stamp_us") + F.col("k") * 300_000_000).alias("end_us"),
        F.when(F.col("k") % 2 == 0, "positive").otherwise("negative").alias("label"),
    )


@query("q_event_join", f"""WITH {FRAMES_SQL}, {EVENTS_SQL}
SELECT e.bag_id, e.id, count(*) AS frames, count(*) FILTER (state = 'OBSTACLE') AS obstacle_frames, count(*) FILTER (state = 'OBSTACLE') > 0 AS detected,
  (min(stamp_us) FILTER (state = 'OBSTACLE') - min(start_us)) / 1e6 AS first_alarm_delay_s,
  arg_min(distance_m, stamp_us) FILTER (state = 'OBSTACLE') AS first_alarm_distance_m
FROM events_dim e JOIN frames f ON f.bag_id = e.bag_id AND f.stamp_us BETWEEN start_us AND end_us WHERE label = 'positive' GROUP BY ALL""")
def event_join(spark, sf_dir):
    """Frames and first alarm inside every annotated event."""
    return sc.event_detection(
        frames(spark, sf_dir), annotated_events(spark, sf_dir), BAG, "stamp_us",
        frames_order(spark, sf_dir).bounds, "start_us", "end_us", 1e6,
    )


@query("q_event_confirmation", f"""{CHECKS}, ev AS (SELECT bag_id, id, min(at_us) AS start_us FROM refs GROUP BY ALL),
first_hit AS (SELECT bag_id, id, min({{'at_us': at_us, 'reported_m': reported_m}}) AS f FROM positive_checks WHERE result = 'hit' GROUP BY ALL)
SELECT bag_id, id, f IS NOT NULL AS object_confirmed, f.reported_m AS first_matched_distance_m, (f.at_us - start_us) / 1e6 AS first_matched_delay_s
FROM ev LEFT JOIN first_hit USING (bag_id, id)""")
def event_confirmation(spark, sf_dir):
    """First matched reference of every event, timed by the reference."""
    events = references(spark, sf_dir).groupBy("bag_id", "id").agg(F.min("at_us").alias("start_us"))
    return sc.event_confirmation(checks(spark, sf_dir), events, BAG, "at_us", "start_us", 1e6)


NEG_SQL = f"""{CHECKS}, {LABELLED_SQL}, neg AS (
  SELECT c.bag_id, c.id, c.stamp_us, frame_state = 'OBSTACLE' AND reported IS NOT NULL AS alarm, l.label
  FROM checks c JOIN labelled l ON l.event_id = near_id WHERE kind = 'negative' AND NOT far
)"""


def negative_checks(spark, sf_dir):
    rows = labelled(spark, sf_dir, plain_frames(spark, sf_dir))
    return sc.negative_object_checks(
        references(spark, sf_dir).filter("kind = 'negative'"), rows, BAG, "at_us", "stamp_us",
        frames_order(spark, sf_dir).bounds, TOLERANCE_US, objects=objects_of,
    )


@query("q_negative_objects", f"""{NEG_SQL}
SELECT bag_id, count(DISTINCT stamp_us) AS reference_frames, count(DISTINCT stamp_us) FILTER (alarm) AS alarm_frames,
  count(DISTINCT stamp_us) FILTER (alarm AND label = 'negative') AS alarm_frames_on_negative FROM neg GROUP BY bag_id""")
def negative_objects(spark, sf_dir):
    """Distinct frames that alarm on objects which must not alarm."""
    return sc.negative_object_totals(negative_checks(spark, sf_dir), BAG, "stamp_us")


@query("q_negative_object_events", f"""{NEG_SQL}
SELECT bag_id, id, count(*) AS frames, count(*) FILTER (alarm) AS alarm_frames, count(*) FILTER (label = 'positive') AS positive_frames,
  count(*) FILTER (label = 'positive' AND alarm) AS alarm_frames_on_positive FROM neg GROUP BY ALL""")
def negative_object_events(spark, sf_dir):
    """The same per annotated object."""
    return sc.negative_object_events(negative_checks(spark, sf_dir), BAG)


@query("q_coverage", f"""{FL}, r AS (SELECT *, CASE WHEN k >= 20 THEN distance_m END AS evaluated_range_m FROM labelled)
SELECT bag_id, label, count(*) AS frames, round(count(*) FILTER (evaluated_range_m > 0) / count(*), 9) AS observed,
  round(count(*) FILTER (state <> 'UNKNOWN') / count(*), 9) AS decision_coverage, round(median(evaluated_range_m) FILTER (evaluated_range_m > 0), 6) AS median_evaluated_range_m
FROM r GROUP BY ALL""")
def coverage(spark, sf_dir):
    """A10: observed share, decision coverage, median evaluated range."""
    rows = labelled(spark, sf_dir).withColumn(
        "evaluated_range_m", F.when(F.col("k") >= 20, F.col("distance_m"))
    )
    out = sc.coverage(rows, ["bag_id", "label"])
    return out.withColumns({
        "observed": F.round("observed", 9), "decision_coverage": F.round("decision_coverage", 9),
        "median_evaluated_range_m": F.round("median_evaluated_range_m", 6),
    })


@query("q_unknown_reasons", f"{FL} SELECT bag_id, label, reason, count(*) AS frames FROM labelled WHERE state = 'UNKNOWN' GROUP BY ALL")
def unknown_reasons(spark, sf_dir):
    """A10: why UNKNOWN frames are UNKNOWN."""
    return sc.unknown_reasons(labelled(spark, sf_dir), ["bag_id", "label"])


SPLIT_SQL = "CASE WHEN bag_id < 3 THEN 'development' WHEN bag_id < 6 THEN 'validation' WHEN bag_id = 6 THEN 'holdout' ELSE 'unassigned' END"


@query("q_rollup_splits", f"""{FL}, s AS (SELECT *, {SPLIT_SQL} AS split FROM labelled)
SELECT coalesce(split, 'total') AS split, count(DISTINCT bag_id) AS bags, count(*) FILTER (label = 'positive') AS positive_frames, count(*) FILTER (label = 'negative') AS negative_frames,
  count(*) FILTER (label = 'positive' AND state = 'OBSTACLE') AS tp, count(*) FILTER (label = 'negative' AND state = 'OBSTACLE') AS fp,
  round(count(*) FILTER (label = 'positive' AND state = 'OBSTACLE') / nullif(count(*) FILTER (label = 'positive'), 0), 9) AS frame_recall,
  round(count(*) FILTER (label = 'negative' AND state = 'OBSTACLE') / nullif(count(*) FILTER (label = 'negative'), 0), 9) AS false_alarm_rate,
  array_to_string(list_sort(list(DISTINCT bag_id % 4)), ',') AS ranges
FROM s GROUP BY ROLLUP(split)""")
def rollup_splits(spark, sf_dir):
    """Totals per split and overall, ratios from summed counts."""
    bags = sc.confusion(labelled(spark, sf_dir), BAG)
    split = (
        F.when(F.col("bag_id") < 3, "development").when(F.col("bag_id") < 6, "validation")
        .when(F.col("bag_id") == 6, "holdout").otherwise("unassigned")
    )
    names = bags.select("bag_id", split.alias("split"))
    total = bags.join(names, BAG, "left").rollup("split").agg(
        F.count(F.lit(1)).alias("bags"),
        *[F.sum(c).alias(c) for c in ("positive_frames", "negative_frames", "tp", "fp")],
        F.array_join(F.array_sort(F.collect_set(F.col("bag_id") % 4)), ",").alias("ranges"),
    )
    return total.select(
        F.coalesce("split", F.lit("total")).alias("split"), "bags", "positive_frames",
        "negative_frames", "tp", "fp",
        F.round(sc.ratio(F.col("tp"), F.col("positive_frames")), 9).alias("frame_recall"),
        F.round(sc.ratio(F.col("fp"), F.col("negative_frames")), 9).alias("false_alarm_rate"),
        "ranges",
    )


HOLDOUT_US = 1_705_276_800_000_000


@query("q_holdout_totals", f"""WITH {FRAMES_SQL}, late AS (SELECT * FROM frames WHERE stamp_us >= {HOLDOUT_US}),
alarms AS (SELECT * FROM late WHERE state = 'OBSTACLE'), {islands_sql('alarms')}, e AS (SELECT bag_id, count(*) AS events FROM alarm_events GROUP BY 1),
t AS (SELECT bag_id, count(*) AS frames, count(*) FILTER (state = 'OBSTACLE') AS obstacle_frames, count(*) FILTER (state = 'UNKNOWN') AS u, (max(stamp_us) - min(stamp_us)) / 1e6 AS s FROM late GROUP BY 1)
SELECT bag_id, frames, obstacle_frames, coalesce(events, 0) AS events, round(s, 1) AS duration_s, CASE WHEN s > 0 THEN round(60 * coalesce(events, 0) / s, 3) END AS events_per_min, round(u / frames, 4) AS unknown_share
FROM t LEFT JOIN e USING (bag_id)""")
def holdout_totals(spark, sf_dir):
    """Totals only, from a fixed stamp on."""
    late = frames(spark, sf_dir).filter(F.col("stamp_us") >= HOLDOUT_US)
    return sc.holdout_totals(late, frames_order(spark, sf_dir), "stamp_us", GAP_US, 1e6)


TRAVEL_SQL = """
moving AS (
  SELECT *, reason <> 'signup' AS ego_motion_valid, distance_m / 1000.0e0 AS ego_speed_mps FROM labelled
), held AS (
  SELECT *, coalesce(last_value(CASE WHEN ego_motion_valid THEN ego_speed_mps END IGNORE NULLS) OVER w, 0) AS speed,
    coalesce(stamp_us - lag(stamp_us) OVER w, 0) / 1e6 AS dt, max(CASE WHEN NOT ego_motion_valid THEN stamp_us END) OVER w AS last_break
  FROM moving WINDOW w AS (PARTITION BY bag_id ORDER BY stamp_us)
), travelled AS (
  SELECT *, sum(speed * dt) OVER (PARTITION BY bag_id ORDER BY stamp_us ROWS UNBOUNDED PRECEDING) AS travelled_m FROM held
)"""


def moving_frames(spark, sf_dir):
    rows = frames_with_objects(spark, sf_dir).withColumns({
        "ego_motion_valid": F.col("reason") != "signup",
        "ego_speed_mps": F.col("distance_m") / 1000.0,
    })
    return labelled(spark, sf_dir, rows)


@query("q_odometry", f"""{FL}, {TRAVEL_SQL} SELECT bag_id, event_id, round(travelled_m, 4) AS travelled_m, (stamp_us - last_break) / 1e6 AS since_break_s FROM travelled""")
def odometry(spark, sf_dir):
    """Travelled distance and time since the last odometry break."""
    order = frames_order(spark, sf_dir)
    rows = sc.travelled(moving_frames(spark, sf_dir), order, "stamp_us", 1e6)
    rows = order.last_known(
        rows, {"_break": F.when(~F.col("ego_motion_valid"), F.col("stamp_us"))}
    )
    return rows.select(
        "bag_id", "event_id", F.round("travelled_m", 4).alias("travelled_m"),
        ((F.col("stamp_us") - F.col("_break")) / 1e6).alias("since_break_s"),
    )


FP_SQL = f"""{FL}, {TRAVEL_SQL}, {TRACKS_SQL}, alarms AS (SELECT * FROM travelled WHERE state = 'OBSTACLE' AND label = 'negative'), {islands_sql('alarms')},
fp_objects AS (
  SELECT n.bag_id, n.island, o.id, o.d, o.cx + n.travelled_m AS world_x, o.cy - (o.cx * 0.001e0 + o.cx * o.cx * 0.00001e0) AS off, o.cz - o.sz / 2 AS bottom, o.cz + o.sz / 2 AS top, o.sx, o.channels
  FROM numbered n JOIN objects o USING (event_id) WHERE o.confirmed
)"""


def fp_rows(spark, sf_dir):
    order = frames_order(spark, sf_dir)
    rows = sc.travelled(moving_frames(spark, sf_dir), order, "stamp_us", 1e6)
    rows = order.last_known(
        rows, {"last_break": F.when(~F.col("ego_motion_valid"), F.col("stamp_us"))}
    )
    alarms = rows.filter("state = 'OBSTACLE' AND label = 'negative'")
    return order.finish(order.tag_islands(alarms, GAP_US))


@query("q_fp_catalogue", f"""{FP_SQL}, f AS (
  SELECT bag_id, island, min(stamp_us) AS start, max(stamp_us) AS "end", count(*) AS frames, count(*) FILTER (k % 4 = 0) AS coasting_frames,
    list_sort(list(ego_speed_mps) FILTER (ego_motion_valid))[count(*) FILTER (ego_motion_valid) // 2 + 1] AS ego_speed_mps,
    count(*) FILTER (NOT ego_motion_valid) AS ego_invalid_frames, arg_min(last_break, stamp_us) AS first_break FROM numbered GROUP BY ALL
), t AS (SELECT bag_id, island, id, max(world_x) - min(world_x) AS span FROM fp_objects GROUP BY ALL),
ts AS (SELECT bag_id, island, count(*) AS tracks, max(span) AS travel FROM t GROUP BY ALL),
o AS (SELECT bag_id, island, min(d) AS d0, max(d) AS d1, min(off) AS off0, max(off) AS off1, min(bottom) AS h0, max(top) AS h1 FROM fp_objects GROUP BY ALL)
SELECT bag_id, island, start, "end", frames, coasting_frames, round(ego_speed_mps, 9) AS ego_speed_mps, ego_invalid_frames, (start - first_break) / 1e6 AS since_ego_break_s,
  coalesce(tracks, 0) AS tracks, round(travel, 3) AS world_x_travel_m, round(d0, 6) AS min_distance_m, round(d1, 6) AS max_distance_m, round(off0, 6) AS min_offset_m, round(off1, 6) AS max_offset_m,
  round(h0, 6) AS bottom_m, round(h1, 6) AS top_m FROM f LEFT JOIN ts USING (bag_id, island) LEFT JOIN o USING (bag_id, island)""")
def fp_catalogue(spark, sf_dir):
    """One row per false-alarm event."""
    events = sq.false_alarm_catalogue(
        fp_rows(spark, sf_dir).withColumn("coasting", F.col("k") % 4 == 0), BAG, "stamp_us",
        (0.0, 0.001, 0.00001), 1e6,
    )
    return events.withColumns({
        "ego_speed_mps": F.round("ego_speed_mps", 9), "world_x_travel_m": F.round("world_x_travel_m", 3),
        **{c: F.round(c, 6) for c in ("min_distance_m", "max_distance_m", "min_offset_m", "max_offset_m", "bottom_m", "top_m")},
    })


@query("q_fp_classes", f"""{FP_SQL}
SELECT bag_id, island, CASE WHEN abs(off) <= 0.9 THEN 'gauge' WHEN abs(off) <= 1.5 THEN 'mid' ELSE 'edge' END || CASE WHEN sx > 3 THEN '-long' ELSE '' END
  || CASE WHEN channels & 1 > 0 THEN '-M' ELSE '' END || CASE WHEN channels & 2 > 0 THEN '-G' ELSE '' END AS class, count(*) AS objects FROM fp_objects GROUP BY ALL""")
def fp_classes(spark, sf_dir):
    """Object classes per false-alarm event."""
    return sq.false_alarm_classes(fp_rows(spark, sf_dir), BAG, (0.0, 0.001, 0.00001))


@query("q_speed_plausibility", f"""WITH {FRAMES_SQL}, m AS (SELECT *, reason <> 'signup' AS ok, distance_m / 10.0e0 AS v FROM frames),
s AS (SELECT *, lag(v) OVER w AS v0, lag(stamp_us) OVER w AS t0 FROM m WHERE ok WINDOW w AS (PARTITION BY bag_id ORDER BY stamp_us)),
c AS (SELECT bag_id, count(*) FILTER (abs(v - v0) > 0.001e0 * greatest(1e-3, (stamp_us - t0) / 1e6) + 0.5e0) AS jumps, count(*) FILTER (v0 > 5 AND v < 0.5) AS drops_to_standstill FROM s GROUP BY 1)
SELECT bag_id, count(*) AS frames, count(*) FILTER (NOT ok) AS invalid_frames, max(jumps) AS jumps, max(drops_to_standstill) AS drops_to_standstill FROM m JOIN c USING (bag_id) GROUP BY bag_id""")
def speed_plausibility(spark, sf_dir):
    """Implausible jumps and drops to standstill."""
    rows = frames(spark, sf_dir).withColumns({
        "ego_motion_valid": F.col("reason") != "signup", "ego_speed_mps": F.col("distance_m") / 10.0,
    })
    return sc.speed_plausibility(rows, frames_order(spark, sf_dir), "stamp_us", 1e6, acceleration=0.001)


SLOPES_SQL = """
numbered_rows AS (
  SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY stamp_us) AS rn, stamp_us / 1e6 AS t,
    CASE WHEN reason <> 'signup' AND distance_m > 3 THEN distance_m END AS d FROM frames
), pts AS (
  SELECT i.bag_id, i.event_id, j.t, j.d FROM numbered_rows i JOIN numbered_rows j ON i.bag_id = j.bag_id AND j.rn BETWEEN i.rn - 3 AND i.rn + 3
  WHERE i.d IS NOT NULL AND j.d IS NOT NULL
), enough AS (SELECT event_id FROM pts GROUP BY event_id HAVING count(*) >= 6),
slopes AS (
  SELECT a.bag_id, a.event_id, -median((b.d - a.d) / (b.t - a.t)) AS approach_mps FROM pts a JOIN pts b USING (event_id) JOIN enough USING (event_id) WHERE b.t > a.t GROUP BY ALL
)"""


def approach_rows(spark, sf_dir):
    distance = F.when((F.col("reason") != "signup") & (F.col("distance_m") > 3), F.col("distance_m"))
    return sc.theil_sen(
        frames(spark, sf_dir), frames_order(spark, sf_dir), F.col("stamp_us") / 1e6, distance
    )


@query("q_theil_sen", f"WITH {FRAMES_SQL}, {SLOPES_SQL} SELECT bag_id, event_id, round(approach_mps, 9) AS approach_mps FROM slopes")
def theil_sen(spark, sf_dir):
    """Approach speed as the median of pairwise slopes."""
    return approach_rows(spark, sf_dir).select(
        "bag_id", "event_id", F.round("approach_mps", 9).alias("approach_mps")
    )


@query("q_speed_error", f"""WITH {FRAMES_SQL}, {SLOPES_SQL}, e AS (
  SELECT s.bag_id, f.k % 5 <> 0 AS ok, CASE WHEN f.k % 5 <> 0 THEN abs(f.distance_m / 10.0e0 - approach_mps) END AS err FROM slopes s JOIN frames f USING (event_id)
)
SELECT bag_id, count(*) AS reference_frames, count(*) FILTER (NOT ok) AS invalid_frames, round(max(err), 6) AS max_mps, count(*) FILTER (err > 1) AS over_1_mps,
  round(list_sort(list(err) FILTER (err IS NOT NULL))[CAST(trunc(0.95e0 * (count(err) - 1)) AS INTEGER) + 1], 6) AS p95_mps, round(median(err), 6) AS median_mps FROM e GROUP BY bag_id""")
def speed_error(spark, sf_dir):
    """A22 Q-E: speed error against the approach speed."""
    rows = approach_rows(spark, sf_dir).withColumns({
        "ego_motion_valid": F.col("k") % 5 != 0, "ego_speed_mps": F.col("distance_m") / 10.0,
    })
    out = sc.speed_error(rows, BAG, bounds=[1.0, 2.0, 4.0, 8.0])
    return out.withColumns({c: F.round(c, 6) for c in ("max_mps", "p95_mps", "median_mps")})


@query("q_bag_audit", f"""WITH {FRAMES_SQL}, p AS (SELECT *, stamp_us - lag(stamp_us) OVER (PARTITION BY bag_id ORDER BY stamp_us) AS period FROM frames)
SELECT bag_id, count(*) AS frames, min(stamp_us) AS first_stamp, max(stamp_us) AS last_stamp, array_to_string(list_sort(list(DISTINCT reason)), ',') AS frame_ids,
  min(k) AS min_points, max(k) AS max_points, min(period) AS min_period, max(period) AS max_period, coalesce(bool_and(period > 0), true) AS monotonic, count(*) FILTER (period > {GAP_US}) AS gaps,
  median(CAST(period AS DOUBLE)) AS median_period, median(CAST(k AS DOUBLE)) AS median_points
FROM p GROUP BY bag_id""")
def bag_audit(spark, sf_dir):
    """Stamps, periods, gaps and sizes of every recording."""
    order, rows = frames_order(spark, sf_dir), frames(spark, sf_dir)
    facts = sc.bag_audit(rows, order, "stamp_us", "reason", "k", GAP_US)
    periods = order.lag(rows, "_b", F.col("stamp_us")).select(
        "bag_id", (F.col("stamp_us") - F.col("_b")).cast("double").alias("median_period"),
        F.col("k").cast("double").alias("median_points"),
    )
    hour = 3.6e9
    for name, bounds in (("median_period", [hour / 4, hour, 4 * hour]), ("median_points", [25.0, 50.0, 75.0])):
        facts = facts.join(
            linear_percentiles(periods, BAG, name, {name: 0.5}, bounds).drop("n"), BAG, "left"
        )
    return facts


@query("q_topic_sample", f"""WITH {FRAMES_SQL}
SELECT reason AS topic, event_id, stamp_us, row_number() OVER (PARTITION BY reason ORDER BY stamp_us) AS nth FROM frames QUALIFY nth <= 3""")
def topic_sample(spark, sf_dir):
    """First three messages of every topic."""
    order = SlicedOrder(["topic"], ["stamp_us"], frames_order(spark, sf_dir).bounds)
    rows = frames(spark, sf_dir).select(F.col("reason").alias("topic"), "event_id", "stamp_us")
    return sq.head_of_each(rows, order, 3).select(
        "topic", "event_id", "stamp_us", F.col("nth").cast("long").alias("nth")
    )


@query("q_every_nth", f"""WITH {FRAMES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY stamp_us) - 1 AS i FROM frames)
SELECT bag_id, event_id, i FROM n WHERE i % 5 = 0""")
def every_nth(spark, sf_dir):
    """Every fifth message by stamp."""
    order = frames_order(spark, sf_dir)
    rows = order.running_sum(frames(spark, sf_dir), {"i": F.lit(1)})
    return rows.withColumn("i", F.col("i") - 1).filter(F.col("i") % 5 == 0).select("bag_id", "event_id", "i")


SESSION_SQL = """
arrived AS (SELECT *, stamp_us - CASE WHEN k > 90 THEN 86400000000 ELSE 0 END AS header_us FROM frames),
sessions AS (
  SELECT *, CAST(sum(back) OVER (PARTITION BY bag_id ORDER BY event_id) AS BIGINT) AS session FROM (
    SELECT *, CASE WHEN header_us < lag(header_us) OVER (PARTITION BY bag_id ORDER BY event_id) THEN 1 ELSE 0 END AS back FROM arrived)
)"""


@query("q_session_ids", f"""WITH {FRAMES_SQL}, {SESSION_SQL}, b AS (SELECT bag_id, session, arg_min(reason, event_id) AS bound FROM sessions GROUP BY ALL)
SELECT s.bag_id, s.event_id, s.session, bound AS source_frame, reason = bound AS accepted FROM sessions s JOIN b USING (bag_id, session)""")
def session_ids(spark, sf_dir):
    """ST17 ST18: sessions split at time steps back; the first source binds its session."""
    rows = frames(spark, sf_dir).withColumn(
        "header_us", F.col("stamp_us") - F.when(F.col("k") > 90, 86_400_000_000).otherwise(0)
    )
    order = SlicedOrder.fit(rows, BAG, ["event_id"])
    rows = order.finish(sq.sessions(rows, order, "header_us"))
    bound = sq.bind_first(rows, ["bag_id", "session"], "event_id", "reason")
    return bound.select(
        "bag_id", "event_id", "session", "source_frame",
        (F.col("reason") == F.col("source_frame")).alias("accepted"),
    )


@query("q_latest_only", f"""WITH {FRAMES_SQL}, b AS (SELECT *, stamp_us // 21600000000 AS trigger_no, k * 10 AS age_ms FROM frames)
SELECT bag_id, trigger_no, arg_max(event_id, stamp_us) AS event_id, count(*) - 1 AS dropped, arg_max(age_ms, stamp_us) <= 300 AS fresh FROM b GROUP BY bag_id, trigger_no""")
def latest_only(spark, sf_dir):
    """ST15 ST16: only the newest frame of a trigger is kept; old ones are dropped by age."""
    rows = frames(spark, sf_dir).withColumns({
        "trigger_no": F.expr("stamp_us div 21600000000"), "age_ms": F.col("k") * 10,
    })
    return sq.latest_only(rows, ["bag_id", "trigger_no"], "stamp_us", "age_ms", 300)


@query("q_hits_window", f"""WITH {FRAMES_SQL}, h AS (
  SELECT *, CAST(sum(CASE WHEN state = 'OBSTACLE' THEN 1 ELSE 0 END) OVER (PARTITION BY bag_id ORDER BY stamp_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS INTEGER) AS hits,
    k / 100.0e0 AS o0, lag(k / 100.0e0, 1) OVER w AS o1, lag(k / 100.0e0, 2) OVER w AS o2 FROM frames WINDOW w AS (PARTITION BY bag_id ORDER BY stamp_us)
)
SELECT bag_id, event_id, hits, hits >= 3 AS confirmed, coalesce(o0 > o1 + 0.02e0 AND o1 > o2 + 0.02e0, false) AS drifting FROM h""")
def hits_window(spark, sf_dir):
    """Hits among the last five frames and outward drift over three offsets."""
    order = frames_order(spark, sf_dir)
    rows = sq.hits_in_window(frames(spark, sf_dir), order, sc.is_state("OBSTACLE"), 5)
    rows = sq.drifting(rows, order, F.col("k") / 100.0)
    return rows.select(
        "bag_id", "event_id", "hits", (F.col("hits") >= 3).alias("confirmed"), "drifting"
    )


@query("q_persistence", f"""WITH {FRAMES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY stamp_us) AS rn, (k - 50) / 10.0e0 AS cy FROM frames)
SELECT a.bag_id, a.event_id, CAST(1 + count(b.event_id) AS INTEGER) AS hits, 1 + count(b.event_id) >= 2 AS confirmed FROM p a
LEFT JOIN p b ON a.bag_id = b.bag_id AND b.rn BETWEEN a.rn - 4 AND a.rn - 1
  AND sqrt((a.distance_m - b.distance_m) * (a.distance_m - b.distance_m) + (a.cy - b.cy) * (a.cy - b.cy)) <= 0.5e0 + 0.002e0 * abs((a.stamp_us - b.stamp_us) / 1e6)
GROUP BY ALL""")
def persistence(spark, sf_dir):
    """Candidates repeated near the same place in the previous frames."""
    rows = sq.persistence(
        frames(spark, sf_dir), frames_order(spark, sf_dir), F.col("stamp_us") / 1e6,
        [F.col("distance_m"), (F.col("k") - 50) / 10.0], window=5, radius=0.5, speed=0.002,
    )
    return rows.select("bag_id", "event_id", "hits", (F.col("hits") >= 2).alias("confirmed"))


@query("q_synth_recall", f"""WITH {FRAMES_SQL}, s AS (
  SELECT *, k >= 10 AS visible, state = 'OBSTACLE' AND k % 2 = 0 AS hit, CASE reason WHEN 'view' THEN 'static' WHEN 'click' THEN 'box' ELSE 'crossing' END AS scenario FROM frames WHERE distance_m < 200 AND k >= 10
)
SELECT bag_id, scenario, {BIN_SQL.replace('object_m', 'distance_m')} AS from_m, count(*) AS frames, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 3) AS recall,
  CAST(round(round(count(*) FILTER (hit) / count(*), 3) * count(*)) AS BIGINT) AS swept_hits FROM s GROUP BY ALL""")
def synth_recall(spark, sf_dir):
    """Synthetic recall per distance bin and scenario."""
    scenario = (
        F.when(F.col("reason") == "view", "static").when(F.col("reason") == "click", "box")
        .otherwise("crossing")
    )
    rows = frames(spark, sf_dir).select(
        "bag_id", scenario.alias("scenario"), "distance_m", F.col("k").alias("hidden_points"),
        (sc.is_state("OBSTACLE") & (F.col("k") % 2 == 0)).alias("hit"),
    )
    return sq.synthetic_recall(rows, ["bag_id", "scenario"])


@query("q_first_hit", f"""WITH {FRAMES_SQL}
SELECT bag_id, arg_min(distance_m, stamp_us) AS first_hit_distance_m FROM frames WHERE state = 'OBSTACLE' AND k >= 10 AND distance_m < 200 GROUP BY bag_id""")
def first_hit(spark, sf_dir):
    """Distance of the first hit of every recording."""
    hit = frames(spark, sf_dir).filter("state = 'OBSTACLE' AND k >= 10 AND distance_m < 200")
    return hit.groupBy("bag_id").agg(
        F.min(F.struct("stamp_us", "distance_m")).alias("f")
    ).select("bag_id", F.col("f.distance_m").alias("first_hit_distance_m"))


@query("q_travel_window", f"""WITH {FRAMES_SQL}, t AS (
  SELECT *, sum(greatest(distance_m / 1000.0e0, 0) * coalesce(stamp_us - lag_us, 0) / 1e6) OVER (PARTITION BY bag_id ORDER BY stamp_us ROWS UNBOUNDED PRECEDING) AS travel
  FROM (SELECT *, lag(stamp_us) OVER (PARTITION BY bag_id ORDER BY stamp_us) AS lag_us FROM frames)
), w AS (
  SELECT *, travel - first_value(travel) OVER r AS gain, first_value(stamp_us) OVER r AS first FROM t WINDOW r AS (PARTITION BY bag_id ORDER BY stamp_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
)
SELECT bag_id, arg_min(first, (-round(gain, 3), stamp_us)) AS first, arg_min(stamp_us, (-round(gain, 3), stamp_us)) AS last, max(round(gain, 3)) AS travel FROM w GROUP BY bag_id""")
def travel_window(spark, sf_dir):
    """The day with the largest travel of every recording."""
    from pathclear.operators import synthetic

    order = frames_order(spark, sf_dir)
    rows = synthetic.odometry(
        frames(spark, sf_dir), order, "stamp_us", F.col("distance_m") / 1000.0, 1e6
    )
    found = synthetic.widest_window(order.finish(rows), order, "stamp_us", 86_400_000_000)
    return found.withColumn("travel", F.round("travel", 3))


@query("q_obstacle_boxes", f"""WITH {FRAMES_SQL}, c AS (
  SELECT bag_id, event_id, distance_m, 1.5e0 * (4 * abs((k - 6.0e0 * floor(k / 6.0e0)) / 6.0e0 - 0.5e0) - 1) + distance_m * 0.001e0 AS y,
    -(0.01e0 * distance_m + 0.0e0 * (distance_m * 0.001e0 + 0.0e0) + 1.9e0) / 1.0e0 AS z FROM frames
)
SELECT bag_id, event_id, round(distance_m - 0.25, 6) AS lo_x, round(y - 0.25, 6) AS lo_y, round(z, 6) AS lo_z, round(distance_m + 0.25, 6) AS hi_x, round(y + 0.25, 6) AS hi_y, round(z + 1.7e0, 6) AS hi_z FROM c""")
def obstacle_boxes(spark, sf_dir):
    """Box of a crossing object on the floor, around the route centre."""
    from pathclear.operators import synthetic

    d, k = F.col("distance_m"), F.col("k")
    centre = d * 0.001
    floor = synthetic.floor_for("crossing", (0.01, 0.0, 1.0, 1.9), d, centre)
    low, high = synthetic.obstacle_box("crossing", d, k.cast("double"), floor, centre)
    return frames(spark, sf_dir).select(
        "bag_id", "event_id",
        *[F.round(c, 6).alias(f"lo_{n}") for c, n in zip(low, "xyz")],
        *[F.round(c, 6).alias(f"hi_{n}") for c, n in zip(high, "xyz")],
    )


@query("q_tf_asof", f"""WITH {FRAMES_SQL}, tf AS (SELECT * FROM frames WHERE reason = 'signup'), clouds AS (SELECT * FROM frames WHERE reason <> 'signup'),
p AS (SELECT c.event_id, t.stamp_us, t.distance_m, t.k FROM clouds c ASOF LEFT JOIN tf t ON c.bag_id = t.bag_id AND c.stamp_us >= t.stamp_us),
n AS (SELECT c.event_id, t.stamp_us, t.distance_m, t.k FROM clouds c ASOF LEFT JOIN tf t ON c.bag_id = t.bag_id AND c.stamp_us < t.stamp_us),
j AS (SELECT c.bag_id, c.event_id, p.stamp_us IS NOT NULL AND n.stamp_us IS NOT NULL AND n.stamp_us <= c.stamp_us + 36000000000 AS ok,
  (c.stamp_us - p.stamp_us) / (n.stamp_us - p.stamp_us) AS s, p.distance_m AS x0, n.distance_m AS x1, p.k AS k0, n.k AS k1 FROM clouds c JOIN p USING (event_id) JOIN n USING (event_id))
SELECT bag_id, event_id, ok AS transform_available, CASE WHEN ok THEN round(x0 + (x1 - x0) * s, 6) END AS tx,
  CASE WHEN ok THEN round(sin((k0 + (k1 - k0) * s) / 200.0e0), 6) END AS qz, CASE WHEN ok THEN round(cos((k0 + (k1 - k0) * s) / 200.0e0), 6) END AS qw FROM j""")
def tf_asof(spark, sf_dir):
    """Transform at the measurement time, interpolated, never extrapolated."""
    half = F.col("k") / 200.0
    tfs = frames(spark, sf_dir).filter("reason = 'signup'").select(
        "bag_id", "stamp_us", F.array(F.col("distance_m"), F.lit(0.0), F.lit(0.0)).alias("translation"),
        F.array(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)).alias("quaternion"),
    )
    clouds = frames(spark, sf_dir).filter("reason <> 'signup'").select("bag_id", "event_id", "stamp_us")
    found = tl.transforms_at(
        clouds, tfs, BAG, "stamp_us", "stamp_us", frames_order(spark, sf_dir).bounds, 36_000_000_000
    )
    return found.select(
        "bag_id", "event_id", "transform_available", F.round(F.get("translation", 0), 6).alias("tx"),
        F.round(F.get("quaternion", 2), 6).alias("qz"), F.round(F.get("quaternion", 3), 6).alias("qw"),
    )


@query("q_label_intervals", f"""{FL}, c AS (
  SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY bag_id ORDER BY stamp_us) THEN 1 ELSE 0 END AS new FROM labelled
), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY bag_id ORDER BY stamp_us) AS BIGINT) AS run FROM c)
SELECT bag_id, run, min(stamp_us) AS start, max(stamp_us) AS "end", any_value(label) AS label, count(*) AS frames,
  array_to_string(list_sort(list(DISTINCT reason)), ', ') || ' ' || printf('%.1f', max(distance_m)) || '->' || printf('%.1f', min(distance_m)) || ' m' AS evidence FROM g GROUP BY bag_id, run""")
def label_intervals(spark, sf_dir):
    """Reviewed intervals as runs of equal labels, with their evidence text."""
    return sq.label_runs(labelled(spark, sf_dir), frames_order(spark, sf_dir), "stamp_us")


@query("q_frame_kinds", f"""WITH {FRAMES_SQL}, m AS (
  SELECT bag_id, stamp_us // 3600000000 AS slot, reason, CASE reason WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS priority, 'object ' || (k % 10) AS note FROM frames
), b AS (SELECT bag_id, slot, min(priority) AS best FROM m GROUP BY ALL)
SELECT m.bag_id, m.slot, any_value(reason) AS kind, array_to_string(list_sort(list(DISTINCT note)), ',') AS notes FROM m JOIN b ON m.bag_id = b.bag_id AND m.slot = b.slot AND priority = best GROUP BY m.bag_id, m.slot""")
def frame_kinds(spark, sf_dir):
    """Strongest kind per frame with only the notes of that kind."""
    order = ["error", "purchase", "signup", "click", "view"]
    marks = frames(spark, sf_dir).select(
        "bag_id", F.expr("stamp_us div 3600000000").alias("slot"), F.col("reason").alias("kind"),
        F.concat(F.lit("object "), (F.col("k") % 10).cast("string")).alias("note"),
    )
    out = sq.strongest_kind(marks, ["bag_id", "slot"], order)
    return out.withColumn("notes", F.array_join("notes", ","))


@query("q_event_references", f"""WITH {FRAMES_SQL}, {REFS_SQL}
SELECT bag_id, id, min(at_us) AS start, max(at_us) AS "end", count(*) AS frames, CAST(list(round(lo_x, 3) ORDER BY at_us)[1] AS DOUBLE) AS first_m,
  CAST(list(round(lo_x, 3) ORDER BY at_us)[-1] AS DOUBLE) AS last_m FROM refs GROUP BY ALL""")
def event_references(spark, sf_dir):
    """Reference frames gathered per event day by day in time order, then joined up."""
    return sq.event_references(
        references(spark, sf_dir).withColumn("near_m", F.round(F.get("roi_min", 0), 3)),
        ["bag_id", "id"], "at_us",
    )


@query("q_video_index", f"""WITH {FRAMES_SQL}, z AS (SELECT bag_id, min(stamp_us) AS t0 FROM frames GROUP BY 1),
i AS (SELECT bag_id, CAST(round_even((stamp_us - t0) / 1e6 * 0.001e0, 0) AS BIGINT) AS idx, min({{'stamp_us': stamp_us, 'event_id': event_id}}) AS f FROM frames JOIN z USING (bag_id) GROUP BY ALL)
SELECT bag_id, idx AS video_index, f.event_id AS event_id, coalesce(lead(idx) OVER (PARTITION BY bag_id ORDER BY idx) - idx, 1) AS copies FROM i""")
def video_index(spark, sf_dir):
    """Constant-rate frame numbers; gaps repeat the last frame, extra frames are dropped."""
    return sq.video_frames(frames(spark, sf_dir), BAG, "stamp_us", "event_id", 1e6, 0.001)


@query("q_json_rows", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT) IS NULL THEN 'absent' ELSE 'present' END AS missing,
  '{"event_id":' || event_id || ',"state":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS line FROM events""")
def json_rows(spark, sf_dir):
    """JSON rows parsed with a fixed schema and written as one object per line."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "p", F.from_json("props", "k long, missing long")
    )
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("state"), F.col("p.k").alias("k")))
    return rows.select(
        "event_id", F.col("p.k").alias("k"),
        F.when(F.col("p.missing").isNull(), "absent").otherwise("present").alias("missing"),
        line.alias("line"),
    )


@query("q_reason_text", f"""WITH {FRAMES_SQL}
SELECT bag_id, event_id,
  CASE WHEN k % 3 = 1 THEN 'OBSTACLE' || CASE WHEN k % 4 = 0 THEN '_COASTING' ELSE '' END || '_WITH_ASSUMED_CALIBRATION'
    WHEN k % 3 = 2 THEN CASE WHEN k % 4 = 0 THEN 'OBSTACLE_COASTING' ELSE 'OBSTACLE_CANDIDATE' END
    ELSE 'OBSTACLE' || CASE WHEN k % 4 = 0 THEN '_COASTING' ELSE '' END || '_WITH_UNKNOWN_CALIBRATION' END AS decision_reason,
  CASE WHEN k % 7 = 0 THEN NULL ELSE distance_m END AS offset_m, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS channels,
  'state: ' || state || chr(10) || 'distance_m: ' || CASE WHEN k % 2 = 0 THEN printf('%.1f', k / 2.0e0) ELSE '- (distance_valid: false)' END || chr(10) || 'reason: ' || reason || chr(10)
    || 'evaluated_range_m: ' || CASE WHEN k % 5 <> 0 THEN printf('%.1f', CAST(k AS DOUBLE)) ELSE '- (evaluation_region_valid: false)' END || chr(10) || 'calibration_trust: ' || CASE k % 3 WHEN 1 THEN 'ASSUMED' WHEN 2 THEN 'VERIFIED' ELSE 'UNKNOWN' END || chr(10)
    || 'result_age_ms: ' || k || chr(10) || 'stale: ' || CASE WHEN k > 90 THEN 'true' ELSE 'false' END || chr(10) || 'frame_sequence: ' || event_id || chr(10) || 'reported_objects: 2' || chr(10)
    || CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN 'confirmed_tracks: []' ELSE 'confirmed_tracks:' END || chr(10)
    || CASE WHEN k % 4 <> 0 THEN '- id ' || (event_id % 5) || ': ' || printf('%.1f', CAST(k AS DOUBLE)) || ' m, 0.5 x 0.5 x 1.5 m, hits 2' || chr(10) ELSE '' END
    || CASE WHEN k % 3 = 0 THEN '- id ' || (event_id % 5 + 5) || ': ' || printf('%.1f', k + 5.0e0) || ' m, 1.0 x 0.5 x 1.5 m, hits 3, predicted' || chr(10) ELSE '' END AS status_text
FROM frames""")
def reason_text(spark, sf_dir):
    """S22 O6 ST22: reason strings, wire evidence lists and the status text."""
    k = F.col("k")
    trust = text.decode_trust((k % 3).cast("int"))
    wire = F.array_compact(F.array(
        F.when(k % 2 == 0, "MOTION"), F.lit("GAUGE"), F.lit("OFFSET=oops"),
        F.when(k % 7 != 0, F.concat(F.lit("OFFSET="), F.col("distance_m").cast("string"))),
    ))

    def track(number, confirmed, distance, length, hits, coasting):
        return F.struct(
            number.alias("id"), confirmed.alias("confirmed"), distance.alias("distance_m"),
            F.array(F.lit(length), F.lit(0.5), F.lit(1.5)).alias("size"),
            F.lit(hits).alias("hits"), F.lit(coasting).alias("coasting"),
        )

    both = F.array(
        track(F.col("event_id") % 5, k % 4 != 0, k.cast("double"), 0.5, 2, False),
        track(F.col("event_id") % 5 + 5, k % 3 == 0, k + 5.0, 1.0, 3, True),
    )
    row = {
        "state": F.col("state"), "distance_valid": k % 2 == 0, "distance_m": k / 2.0,
        "reason": F.col("reason"), "evaluation_region_valid": k % 5 != 0,
        "evaluated_range_m": k.cast("double"), "calibration_trust": trust,
        "result_age_ms": k.cast("double"), "stale": k > 90, "frame_sequence": F.col("event_id"),
        "reported_objects": F.lit(2),
    }
    return frames(spark, sf_dir).select(
        "bag_id", "event_id", text.obstacle_reason(trust, k % 4 == 0).alias("decision_reason"),
        text.offset_from_reasons(wire).alias("offset_m"),
        text.channels_from_reasons(wire).alias("channels"),
        text.assessment_text(row, both).alias("status_text"),
    )


@query("q_manifest_check", """
WITH recorded AS (SELECT doc_id, sha256(text) AS hash FROM documents),
current_files AS (SELECT doc_id, sha256(CASE WHEN toxic = 1 THEN text || ' ' ELSE text END) AS hash FROM documents JOIN labels USING (doc_id) WHERE lang <> 'xx')
SELECT coalesce(r.doc_id, c.doc_id) AS doc_id, CASE WHEN c.hash IS NULL THEN 'missing' WHEN r.hash IS NULL THEN 'unexpected' WHEN r.hash <> c.hash THEN 'changed' ELSE 'same' END AS status, r.hash AS recorded_hash
FROM recorded r FULL JOIN current_files c ON r.doc_id = c.doc_id""")
def manifest_check(spark, sf_dir):
    """Recorded content hashes against the current ones."""
    from pathclear.plans.provenance import compare_hashes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    recorded = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    current = docs.join(labels, "doc_id").select("doc_id", F.sha2(changed, 256).alias("hash"))
    return compare_hashes(recorded, current, ["doc_id"])


@query("q_set_ops", f"""WITH {FRAMES_SQL}, used AS (SELECT DISTINCT bag_id, reason FROM frames WHERE state <> 'UNKNOWN'), quiet AS (SELECT DISTINCT bag_id, reason FROM frames WHERE state <> 'OBSTACLE')
SELECT 'except' AS op, bag_id, reason FROM (SELECT * FROM used EXCEPT SELECT * FROM quiet)
UNION ALL SELECT 'intersect', bag_id, reason FROM (SELECT * FROM used INTERSECT SELECT * FROM quiet)
UNION ALL SELECT 'union', bag_id, reason FROM (SELECT * FROM used UNION SELECT * FROM quiet)
UNION ALL SELECT 'unknown_state', bag_id, state FROM (SELECT DISTINCT bag_id, state FROM frames) WHERE state NOT IN ('OBSTACLE', 'UNKNOWN')""")
def set_ops(spark, sf_dir):
    """Set operations on distinct values: reasons of frames that decide something, and of frames without an alarm."""
    rows = frames(spark, sf_dir)
    used = rows.filter("state <> 'UNKNOWN'").select("bag_id", "reason").distinct()
    quiet = rows.filter("state <> 'OBSTACLE'").select("bag_id", "reason").distinct()
    known = rows.select("bag_id", F.explode(F.array(F.lit("OBSTACLE"), F.lit("UNKNOWN"))).alias("state"))
    strange = rows.select("bag_id", "state").distinct().subtract(known.distinct())

    def named(df, op):
        return df.select(F.lit(op).alias("op"), "bag_id", "reason")

    return (
        named(used.subtract(quiet), "except")
        .unionByName(named(used.intersect(quiet), "intersect"))
        .unionByName(named(used.union(quiet).distinct(), "union"))
        .unionByName(named(strange.withColumnRenamed("state", "reason"), "unknown_state"))
    )


@query("q_dataset_status", f"""WITH {FRAMES_SQL}, bags AS (SELECT bag_id, count(*) AS exported, max(k) AS top FROM frames GROUP BY 1),
dataset AS (SELECT CAST(n_nationkey AS BIGINT) AS bag_id, n_name AS name, n_regionkey FROM nation)
SELECT d.bag_id, name, CASE WHEN n_regionkey = 0 THEN 'no annotations' WHEN n_regionkey = 1 AND b.bag_id IS NULL THEN 'not selected' WHEN b.bag_id IS NULL THEN 'no results' ELSE 'scored' END AS status,
  coalesce(r_name, 'unassigned') AS split, exported FROM dataset d LEFT JOIN bags b ON d.bag_id = b.bag_id LEFT JOIN region r ON r.r_regionkey = d.n_regionkey + 1""")
def dataset_status(spark, sf_dir):
    """Registry against splits, selection and results."""
    from pathclear.plans.provenance import dataset_status as status

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    dataset = nation.select(
        F.col("n_nationkey").cast("long").alias("bag_id"), F.col("n_name").alias("name"), "n_regionkey",
        (F.col("n_regionkey") != 0).alias("annotated"), (F.col("n_regionkey") != 1).alias("selected"),
    )
    splits = dataset.select("bag_id", "n_regionkey").join(
        region.select((F.col("r_regionkey") - 1).alias("n_regionkey"), F.col("r_name").alias("split")), "n_regionkey"
    ).select("bag_id", "split")
    results = frames(spark, sf_dir).groupBy("bag_id").agg(F.count(F.lit(1)).alias("exported"))
    return status(dataset, splits, results, ["bag_id"]).select("bag_id", "name", "status", "split", "exported")
