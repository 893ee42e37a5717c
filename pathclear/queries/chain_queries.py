"""Queries whose frames depend on the frames before them, with SQL that goes frame by frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathclear.config import DetectorConfig
from pathclear.operators import floor, folds, graph, grids, route
from pathclear.queries.neighbour_queries import CURVE_SQL, curves
from pathclear.queries.registry import query
from pathclear.queries.views import FRAMES_SQL, POINTS_SQL, frames, points

HOLD = 3

FLOOR_HOLD_SQL = f"""
WITH RECURSIVE {FRAMES_SQL}, given AS (
  SELECT CASE WHEN bag_id < 4 THEN 0 ELSE bag_id END AS chain, event_id, k * 0.125e0 AS a, k % 3 <> 0 AS floor_valid, k * 0.3e0 AS end_x,
    reason <> 'signup' AS seen, row_number() OVER (PARTITION BY CASE WHEN bag_id < 4 THEN 0 ELSE bag_id END ORDER BY stamp_us, event_id) AS n
  FROM frames
), step AS (
  SELECT DISTINCT chain, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS kept_a, CAST(NULL AS DOUBLE) AS kept_end, 0 AS age, 0 AS failures, 0 AS next_life,
    CAST(NULL AS BOOLEAN) AS held, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS end_x, 0 AS life, CAST(NULL AS VARCHAR) AS geometry_reason
  FROM given
  UNION ALL
  SELECT chain, n,
    CASE WHEN fails AND failures = 5 THEN NULL WHEN fails OR held THEN kept_a ELSE a END,
    CASE WHEN fails AND failures = 5 THEN NULL WHEN fails OR held THEN kept_end ELSE end_x END,
    CASE WHEN fails AND failures = 5 THEN 0 WHEN fails THEN age WHEN held THEN age + 1 ELSE 0 END,
    CASE WHEN NOT fails OR failures = 5 THEN 0 ELSE failures + 1 END, next_life + CAST(fails AND failures = 5 AS INTEGER),
    held, CASE WHEN held THEN kept_a ELSE a END, CASE WHEN held THEN kept_end ELSE end_x END, next_life,
    CASE WHEN fails THEN CASE WHEN floor_valid THEN 'CORRIDOR_UNOBSERVABLE' ELSE 'GROUND_UNSUPPORTED' END END
  FROM (
    SELECT *, NOT held AND (short OR NOT seen) AS fails FROM (
      SELECT *, short AND kept_a IS NOT NULL AND age < {HOLD} AND seen AS held FROM (
        SELECT g.*, s.kept_a, s.kept_end, s.age, s.failures, s.next_life, NOT g.floor_valid OR g.end_x < 25 AS short
        FROM step s JOIN given g ON g.chain = s.chain AND g.n = s.n + 1)))
)
SELECT g.chain, g.event_id, s.held, s.life, s.geometry_reason, s.a, round(s.end_x, 6) AS end_x
FROM given g JOIN step s ON s.chain = g.chain AND s.n = g.n"""


@query("q_floor_hold", FLOOR_HOLD_SQL)
def floor_hold(spark, sf_dir):
    """ST5 ST6: floors held over frames without one, failures in a row and lives; one chain has half of all frames."""
    k = F.col("k")
    rows = frames(spark, sf_dir).select(
        F.when(F.col("bag_id") < 4, 0).otherwise(F.col("bag_id")).alias("chain"), "stamp_us", "event_id",
        (k * 0.125).alias("a"), F.lit(0.0).alias("b"), F.lit(-1.0).alias("c"), (k % 3 != 0).alias("floor_valid"),
        (k * 0.3).alias("end_x"), F.when(F.col("reason") != "signup", 1).otherwise(0).alias("detection_point_count"),
    )
    found = folds.hold_floors(rows, ["chain"], ["stamp_us", "event_id"], HOLD)
    return found.select(
        "chain", "event_id", "held", "life", "geometry_reason", "a", F.round("end_x", 6).alias("end_x"))


CONTRAST, DT = 0.005, 0.1


def _within(low: str, high: str, verdict: str) -> str:
    """Deepest shift (from 0) of a range if the verdict on it is good."""
    a, b = f"CAST(greatest(0, floor({low})) AS BIGINT)", f"CAST(least(len(depth) - 1, ceil({high})) AS BIGINT)"
    part = f"depth[{a} + 1:{b} + 1]"
    best = f"({a} + list_position({part}, list_max({part})) - 1)"
    return f"CASE WHEN {a} <= {b} AND ({verdict})[{best} + 1] THEN {best} END"


SPEED_TRACK_SQL = f"""
WITH RECURSIVE {CURVE_SQL}, e AS (
  SELECT frame_no, shift, coalesce(round(error, 9), 'inf'::DOUBLE) AS err FROM curve
), medians AS (
  SELECT frame_no, count(*) FILTER (isfinite(err)) AS known, list_sort(list(err) FILTER (isfinite(err)))[count(*) FILTER (isfinite(err)) // 2 + 1] AS median
  FROM e GROUP BY frame_no
), lowered AS (
  SELECT frame_no, shift, least(err, lag(err, 1, 'inf'::DOUBLE) OVER w, lead(err, 1, 'inf'::DOUBLE) OVER w) AS low FROM e
  WINDOW w AS (PARTITION BY frame_no ORDER BY shift)
), marked AS (
  SELECT *, CAST(low IS DISTINCT FROM lag(low) OVER (PARTITION BY frame_no ORDER BY shift) AS INTEGER) AS begins FROM lowered
), stretches AS (
  SELECT frame_no, stretch, min(shift) AS first, max(shift) AS last, min(low) AS value
  FROM (SELECT *, sum(begins) OVER (PARTITION BY frame_no ORDER BY shift) AS stretch FROM marked) GROUP BY ALL
), dips AS (
  SELECT * FROM (SELECT *, lag(value, 1, 'inf'::DOUBLE) OVER w AS before, lead(value, 1, 'inf'::DOUBLE) OVER w AS after FROM stretches WINDOW w AS (PARTITION BY frame_no ORDER BY stretch))
  WHERE isfinite(value) AND value < before AND value < after
), judged AS (
  SELECT e.frame_no, e.shift, CASE WHEN any_value(known) < 4 THEN -any_value(err) ELSE any_value(median) - any_value(err) END AS depth,
    any_value(known) >= 4 AS readable, greatest(0, coalesce(max(median - d.value), 0)) AS rival
  FROM e JOIN medians USING (frame_no) LEFT JOIN dips d ON d.frame_no = e.frame_no AND (d.first > e.shift + 3 OR d.last < e.shift - 3)
  GROUP BY e.frame_no, e.shift
), verdicts AS (
  SELECT j.frame_no, list(depth ORDER BY j.shift) AS depth, list(readable AND depth >= {CONTRAST}e0 ORDER BY j.shift) AS clear,
    list(readable AND depth >= {CONTRAST}e0 AND (j.shift > 1 OR z.err <= 0.6e0 * median) ORDER BY j.shift) AS moving,
    list(readable AND depth >= 1.5e0 * rival ORDER BY j.shift) AS alone
  FROM judged j JOIN medians USING (frame_no) JOIN e z ON z.frame_no = j.frame_no AND z.shift = 0 GROUP BY j.frame_no
), given AS (
  SELECT *, list_position(depth, list_max(depth)) - 1 AS best, CASE WHEN frame_no % 2 = 0 THEN 0 ELSE frame_no % 16 END AS chain,
    row_number() OVER (PARTITION BY CASE WHEN frame_no % 2 = 0 THEN 0 ELSE frame_no % 16 END ORDER BY frame_no) AS n
  FROM verdicts
), step AS (
  SELECT DISTINCT chain, CAST(0 AS BIGINT) AS n, 0.0e0 AS speed, false AS known, 0.0e0 AS idle, 0.0e0 AS up_speed, 0 AS up_n, 0.0e0 AS off_speed, 0 AS off_n,
    false AS valid, 0.0e0 AS moved FROM given
  UNION ALL
  SELECT chain, n,
    CASE WHEN leaves THEN off_now WHEN taken IS NOT NULL THEN taken * {0.05 / DT}e0 WHEN near IS NULL THEN speed
      WHEN idle > 0 THEN near * {0.05 / DT}e0
      ELSE speed + CASE WHEN slow THEN 0.5e0 * (near * {0.05 / DT}e0 - speed) ELSE least(greatest(0.5e0 * (near * {0.05 / DT}e0 - speed), -{2 * DT}e0), {2 * DT}e0) END END,
    CASE WHEN leaves OR taken IS NOT NULL OR near IS NOT NULL THEN true ELSE known AND idle + {DT}e0 <= 10 END,
    CASE WHEN leaves OR taken IS NOT NULL OR near IS NOT NULL THEN 0 WHEN known THEN idle + {DT}e0 ELSE idle END,
    up_now, CASE WHEN leaves OR taken IS NOT NULL THEN 0 ELSE up_count END, off_now, CASE WHEN leaves THEN 0 ELSE off_count END,
    leaves OR taken IS NOT NULL OR near IS NOT NULL OR (known AND idle + {DT}e0 <= 5),
    CASE WHEN leaves THEN off_now * {DT}e0 WHEN taken IS NOT NULL THEN taken * {0.05 / DT}e0 * {DT}e0 WHEN near IS NULL THEN CASE WHEN known AND idle + {DT}e0 <= 5 THEN speed * {DT}e0 ELSE 0 END
      WHEN idle > 0 THEN near * {0.05 / DT}e0 * {DT}e0
      ELSE (speed + CASE WHEN slow THEN 0.5e0 * (near * {0.05 / DT}e0 - speed) ELSE least(greatest(0.5e0 * (near * {0.05 / DT}e0 - speed), -{2 * DT}e0), {2 * DT}e0) END) * {DT}e0 END
  FROM (
    SELECT *, CASE WHEN up_count >= 3 THEN found END AS taken, off_count >= 25 AS leaves FROM (
      SELECT *, CASE WHEN found IS NULL THEN up_speed ELSE found * 0.05e0 / {DT}e0 END AS up_now,
        CASE WHEN found IS NULL THEN 0 WHEN abs(found * 0.05e0 / {DT}e0 - up_speed) <= 1 THEN up_n + 1 ELSE 1 END AS up_count,
        CASE WHEN away THEN best * {0.05 / DT}e0 ELSE off_speed END AS off_now,
        CASE WHEN NOT known THEN off_n WHEN NOT away THEN 0 WHEN abs(best * {0.05 / DT}e0 - off_speed) <= 1 THEN off_n + 1 ELSE 1 END AS off_count
      FROM (
        SELECT *, CASE WHEN alone[seen + 1] THEN seen END AS found FROM (
          SELECT *, CASE
              WHEN near IS NULL THEN CASE WHEN abs(read - best) <= 1 THEN read END
              WHEN slow AND abs(best - near) > 1 AND depth[best + 1] - depth[near + 1] > {CONTRAST}e0 THEN CASE WHEN clear[best + 1] THEN best END END AS seen
          FROM (
            SELECT *, CASE WHEN known THEN {_within("expected - reach", "expected + reach", "CASE WHEN slow THEN clear ELSE moving END")}
                ELSE {_within("0", "len(depth) - 1", "CASE WHEN slow THEN clear ELSE moving END")} END AS read,
              CASE WHEN known THEN {_within("floor(expected + 0.5e0) - 2", "floor(expected + 0.5e0) + 2", "CASE WHEN slow THEN clear ELSE moving END")} END AS near,
              known AND abs(best - expected) > 2 AND moving[best + 1] AND alone[best + 1] AS away
            FROM (
              SELECT g.*, s.speed, s.known, s.idle, s.up_speed, s.up_n, s.off_speed, s.off_n, s.speed * {DT}e0 / 0.05e0 AS expected,
                1 + ceil(2.0e0 * (s.idle + {DT}e0) * {DT}e0 / 0.05e0) AS reach, s.known AND s.speed < 2 AS slow
              FROM step s JOIN given g ON g.chain = s.chain AND g.n = s.n + 1))))))
)
SELECT g.chain, g.frame_no, s.valid, round(s.moved, 9) AS moved_m, round(s.speed, 9) AS speed_mps
FROM given g JOIN step s ON s.chain = g.chain AND s.n = g.n"""


@query("q_speed_track", SPEED_TRACK_SQL)
def speed_track(spark, sf_dir):
    """K12 ST2 ST3: speed followed from curve to curve; one chain has half of all frames, in slices of 100."""
    rows = curves(spark, sf_dir).select(
        F.when(F.col("frame_no") % 2 == 0, 0).otherwise(F.col("frame_no") % 16).alias("chain"), "frame_no",
        F.transform("errors", lambda e: F.round(e, 9)).alias("errors"), F.lit(DT).alias("dt_s"))
    found = folds.speed_track(rows, ["chain"], ["frame_no"], CONTRAST, slice_rows=100)
    return found.select(
        "chain", "frame_no", "valid", F.round("moved_m", 9).alias("moved_m"), F.round("speed_mps", 9).alias("speed_mps"))


def _places_sql(width: int) -> str:
    return f"""
seen AS (
  SELECT frame_seq, CAST(trunc((x - 3) / {width}) AS INTEGER) AS slice,
    CASE WHEN y > 0 THEN 2.25e0 ELSE -2.25e0 END + x * x / 512 + z / 32 + CASE WHEN floor(x / 8) % 5 = frame_seq % 5 THEN 1.5e0 ELSE 0 END AS y
  FROM points WHERE x >= 3 AND x < 120
), places AS (
  SELECT frame_seq, slice, list_sort(list(DISTINCT y)) AS ys, row_number() OVER (PARTITION BY frame_seq ORDER BY slice) AS n FROM seen WHERE abs(y) <= 12 GROUP BY frame_seq, slice
)"""


def _sides_sql(ys: str, centre: str) -> str:
    return (f"list_min(list_filter({ys}, lambda y: y BETWEEN {centre} + 1 AND {centre} + 6)) AS l, "
            f"list_max(list_filter({ys}, lambda y: y BETWEEN {centre} - 6 AND {centre} - 1)) AS r")


def _fit_sql(name: str) -> str:
    """One coefficient from the running sums."""
    top = {"c1": "t1 * s4 - t2 * s3", "c2": "s2 * t2 - s3 * t1"}[name]
    return f"CASE WHEN m >= 3 AND abs(s2 * s4 - s3 * s3) >= 1e-9 THEN ({top}) / (s2 * s4 - s3 * s3) END"


def _follow_sql(width: int, near: int, fit_from: int, middle) -> str:
    """Slices of a frame one after another; ``middle`` is the SQL of a side's reference."""
    return f"""
WITH RECURSIVE {POINTS_SQL}, {_places_sql(width)}, near AS (
  SELECT frame_seq, {_sides_sql("ys", "0")} FROM places WHERE slice < {near}
), origin AS (
  SELECT frame_seq, {middle('l')} AS l0, {middle('r')} AS r0 FROM near GROUP BY frame_seq
), step AS (
  SELECT DISTINCT frame_seq, CAST(0 AS BIGINT) AS n, 0.0e0 AS c1, 0.0e0 AS c2, 0 AS m, 0.0e0 AS s2, 0.0e0 AS s3, 0.0e0 AS s4, 0.0e0 AS t1, 0.0e0 AS t2,
    CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS shift FROM places
  UNION ALL
  SELECT frame_seq, n, CASE WHEN shift IS NOT NULL AND m >= {fit_from} THEN coalesce({_fit_sql("c1")}, c1) ELSE c1 END,
    CASE WHEN shift IS NOT NULL AND m >= {fit_from} THEN coalesce({_fit_sql("c2")}, c2) ELSE c2 END, m, s2, s3, s4, t1, t2, x, shift
  FROM (
    SELECT frame_seq, n, c1, c2, x, shift, CASE WHEN shift IS NULL THEN m ELSE m + 1 END AS m,
      CASE WHEN shift IS NULL THEN s2 ELSE s2 + x * x END AS s2, CASE WHEN shift IS NULL THEN s3 ELSE s3 + x * x * x END AS s3,
      CASE WHEN shift IS NULL THEN s4 ELSE s4 + x * x * x * x END AS s4, CASE WHEN shift IS NULL THEN t1 ELSE t1 + x * shift END AS t1,
      CASE WHEN shift IS NULL THEN t2 ELSE t2 + x * x * shift END AS t2
    FROM (
      SELECT *, list_sum([v for v in [CASE WHEN abs(l - l0 - centre) <= 0.3e0 + 0.01e0 * x THEN l - l0 END, CASE WHEN abs(r - r0 - centre) <= 0.3e0 + 0.01e0 * x THEN r - r0 END] if v IS NOT NULL])
        / nullif(len([v for v in [CASE WHEN abs(l - l0 - centre) <= 0.3e0 + 0.01e0 * x THEN l - l0 END, CASE WHEN abs(r - r0 - centre) <= 0.3e0 + 0.01e0 * x THEN r - r0 END] if v IS NOT NULL]), 0) AS shift
      FROM (
        SELECT *, {_sides_sql("ys", "centre")} FROM (
          SELECT s.frame_seq, p.n, s.c1, s.c2, s.m, s.s2, s.s3, s.s4, s.t1, s.t2, o.l0, o.r0, p.ys, {3 + width / 2}e0 + {width} * p.slice AS x,
            s.c1 * ({3 + width / 2}e0 + {width} * p.slice) + s.c2 * ({3 + width / 2}e0 + {width} * p.slice) * ({3 + width / 2}e0 + {width} * p.slice) AS centre
          FROM step s JOIN places p ON p.frame_seq = s.frame_seq AND p.n = s.n + 1 JOIN origin o ON o.frame_seq = s.frame_seq))))
)"""


def _upper(side: str) -> str:
    return f"CASE WHEN count({side}) >= 3 THEN list_sort(list({side}) FILTER ({side} IS NOT NULL))[count({side}) // 2 + 1] END"


def _plain(side: str) -> str:
    return f"CASE WHEN count({side}) >= 2 THEN median({side}) END"


ROUTE_FOLLOW_SQL = f"""{_follow_sql(1, 5, 5, _upper)}, ended AS (
  SELECT *, coalesce({_fit_sql("c1")}, c1) AS f1, coalesce({_fit_sql("c2")}, c2) AS f2 FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY frame_seq ORDER BY n DESC) = 1)
), offs AS (
  SELECT s.frame_seq, s.x, s.shift, abs(s.shift - (f1 * s.x + f2 * s.x * s.x)) AS off FROM step s JOIN ended e USING (frame_seq) WHERE s.shift IS NOT NULL
), worst AS (
  SELECT frame_seq, list_sort(list(off))[count(*) * 9 // 10 + 1] AS worst, count(*) AS followed, max(x) AS reach FROM offs GROUP BY frame_seq
), sums AS (
  SELECT frame_seq, count(*) AS m, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(x * shift) AS t1, sum(x * x * shift) AS t2, max(x) AS last
  FROM offs JOIN worst USING (frame_seq) WHERE off <= worst GROUP BY frame_seq
), fits AS (
  SELECT frame_seq, {_fit_sql("c1")} AS c1, {_fit_sql("c2")} AS c2, m, last FROM sums
), kept AS (
  SELECT frame_seq, c1, c2, m, last FROM fits JOIN worst USING (frame_seq) WHERE followed >= 10 AND reach >= 20 AND abs(c1) <= 0.05e0 AND abs(c2) <= 1 / 300.0e0
)
SELECT p.frame_seq, k.frame_seq IS NOT NULL AS valid, round(coalesce(c1, 0), 6) AS c1, round(coalesce(c2, 0), 8) AS c2, coalesce(last + 0.5e0, 0) AS max_x, coalesce(m, 0) AS shifts
FROM (SELECT DISTINCT frame_seq FROM places) p LEFT JOIN kept k USING (frame_seq)"""


def _walls(spark, sf_dir, width: int):
    """Distinct wall places per slice of a bent tunnel whose walls jump aside over some metres."""
    x, z = F.col("x"), F.col("z")
    aside = F.floor(x / 8) % 5 == F.col("frame_seq") % 5
    y = F.when(F.col("y") > 0, 2.25).otherwise(-2.25) + x * x / 512 + z / 32 + F.when(aside, 1.5).otherwise(0.0)
    seen = points(spark, sf_dir).filter((x >= 3) & (x < 120)).select("frame_seq", grids.trunc((x - 3) / width).alias("slice"), y.alias("y"))
    return seen.filter(F.abs("y") <= 12).groupBy("frame_seq", "slice").agg(F.collect_set("y").alias("ys")).groupBy("frame_seq").agg(
        F.collect_list(F.struct("slice", "ys")).alias("walls"))


@query("q_route_follow", ROUTE_FOLLOW_SQL)
def route_follow(spark, sf_dir):
    """Walls followed slice by slice around the running fit, lost where they jump aside and found again."""
    found = route.follow_walls(_walls(spark, sf_dir, 1), "walls", DetectorConfig())
    return found.select(
        "frame_seq", "raw.valid", F.round("raw.c1", 6).alias("c1"), F.round("raw.c2", 8).alias("c2"), "raw.max_x",
        F.size("raw.shifts").cast("long").alias("shifts"))


@query("q_synth_route", f"""{_follow_sql(2, 3, 4, _plain)}
SELECT frame_seq, CASE WHEN ok THEN round(c1, 6) END AS c1, CASE WHEN ok THEN round(c2, 8) END AS c2
FROM (SELECT frame_seq, arg_max(c1, n) AS c1, arg_max(c2, n) AS c2, count(shift) >= 6 AND max(x) FILTER (shift IS NOT NULL) >= 20 AS ok FROM step WHERE n > 0 GROUP BY frame_seq)""")
def synth_route(spark, sf_dir):
    """The route of each frame from its walls, apart from the detector's."""
    found = route.independent_route(_walls(spark, sf_dir, 2), "walls")
    return found.select("frame_seq", F.round("c1", 6).alias("c1"), F.round("c2", 8).alias("c2"))


@query("q_wall_contact", f"""
WITH RECURSIVE {POINTS_SQL}, plan AS (
  SELECT frame_seq, CAST(floor(x / 0.5e0) AS BIGINT) AS ix, CAST(floor(y / 0.5e0) AS BIGINT) AS iy, arg_min(y, raw_index) AS "offset"
  FROM points WHERE z + 1 BETWEEN 0.5e0 AND 2.8e0 GROUP BY ALL
), led AS (
  SELECT frame_seq, ix, iy FROM plan WHERE abs("offset") >= 1.6e0
  UNION
  SELECT p.frame_seq, p.ix, p.iy FROM led l JOIN plan p ON p.frame_seq = l.frame_seq AND p.ix BETWEEN l.ix - 1 AND l.ix + 1 AND p.iy BETWEEN l.iy - 1 AND l.iy + 1
), boxes AS (
  SELECT frame_seq, ring * 100 + CAST(floor(x / 4) AS BIGINT) AS box, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM points
  WHERE z >= 0.5e0 AND abs(y) <= 1 GROUP BY ALL
)
SELECT b.frame_seq, b.box, EXISTS (SELECT 1 FROM led l WHERE l.frame_seq = b.frame_seq
  AND l.ix BETWEEN floor(lo_x / 0.5e0) AND floor(hi_x / 0.5e0) AND l.iy BETWEEN floor(lo_y / 0.5e0) AND floor(hi_y / 0.5e0)) AS wall FROM boxes b""")
def wall_contact(spark, sf_dir):
    """K8: boxes from which occupied plan cells lead to the wall zone."""
    pts = points(spark, sf_dir)
    plan = pts.filter((F.col("z") + 1).between(0.5, 2.8)).groupBy(
        "frame_seq", F.floor(F.col("x") / 0.5).alias("ix"), F.floor(F.col("y") / 0.5).alias("iy")).agg(F.min_by("y", "raw_index").alias("offset"))
    boxes = pts.filter("z >= 0.5 AND abs(y) <= 1").groupBy("frame_seq", (F.col("ring") * 100 + F.floor(F.col("x") / 4)).alias("box")).agg(
        *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    touching = graph.wall_contact(boxes, plan, ["frame_seq"], "box").withColumn("wall", F.lit(True))
    return boxes.join(touching, ["frame_seq", "box"], "left").select("frame_seq", "box", F.coalesce("wall", F.lit(False)).alias("wall"))


SAMPLED = DetectorConfig(ground_inlier_tolerance_m=0.125)

FLOOR_SAMPLED_SQL = f"""
WITH RECURSIVE {POINTS_SQL}, scene AS (
  SELECT frame_seq, raw_index, x, y, CASE WHEN ring = 7 THEN z / 4 - 0.5e0 ELSE (frame_seq % 7) * x / 1024 - 1.5e0 + z / 32 END
    + CASE WHEN frame_seq % 3 = 0 AND floor(x) % 5 < 3 THEN 0.5e0 ELSE 0 END AS z FROM points
), celled AS (
  SELECT *, least(CAST(trunc(x - 2) AS BIGINT), 88) * 26 + least(CAST(trunc((y + 2.5e0) / 0.2e0) AS BIGINT), 25) AS cell
  FROM scene WHERE x BETWEEN 2 AND 90 AND abs(y) <= 2.5e0 AND z BETWEEN -3 AND 0.5e0
), seeds AS MATERIALIZED (
  SELECT frame_seq, p.x AS x, p.y AS y, p.z AS z, row_number() OVER (PARTITION BY frame_seq ORDER BY cell) - 1 AS i
  FROM (SELECT frame_seq, cell, min({{'z': z, 'raw_index': raw_index, 'x': x, 'y': y}}) AS p FROM celled GROUP BY ALL)
), draws AS (
  SELECT 0 AS k, (2654435769 * 1664525 + 1013904223) % 4294967296 AS v
  UNION ALL SELECT k + 1, (v * 1664525 + 1013904223) % 4294967296 FROM draws WHERE k < 767
), picks AS MATERIALIZED (
  SELECT k // 3 AS attempt, max(v) FILTER (k % 3 = 0) AS d0, max(v) FILTER (k % 3 = 1) AS d1, max(v) FILTER (k % 3 = 2) AS d2 FROM draws GROUP BY ALL
), lists AS MATERIALIZED (
  SELECT frame_seq, list({{'x': x, 'y': y, 'z': z}} ORDER BY i) AS s, count(*) AS n FROM seeds GROUP BY frame_seq HAVING count(*) >= 30
), asked AS MATERIALIZED (
  SELECT frame_seq, attempt, s[d0 % n + 1] AS a, s[d1 % n + 1] AS b, s[d2 % n + 1] AS c FROM lists CROSS JOIN picks
), triples AS MATERIALIZED (
  SELECT frame_seq, attempt, a.x AS px, a.y AS py, a.z AS pz, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz
  FROM asked
), planes AS (
  SELECT frame_seq, attempt, a, b, pz - a * px - b * py AS c FROM (
    SELECT *, (uz * vy - vz * uy) / det AS a, (ux * vz - vx * uz) / det AS b FROM (SELECT *, ux * vy - vx * uy AS det FROM triples) WHERE abs(det) >= 0.5e0)
), good AS MATERIALIZED (
  SELECT * FROM planes WHERE sqrt(a * a + b * b) <= 0.15e0 AND c BETWEEN -3 AND 0.5e0
), votes AS MATERIALIZED (
  SELECT g.frame_seq, attempt, a, b, c, a * 10 + c AS level, count(*) AS support FROM good g JOIN seeds s ON s.frame_seq = g.frame_seq AND abs(s.z - a * s.x - b * s.y - c) <= 0.125e0
  GROUP BY ALL HAVING count(*) >= 30 AND bool_or(s.x < 25) AND bool_or(s.x >= 25) AND bool_or(s.y < -0.25e0) AND bool_or(s.y > 0.25e0)
), best AS (
  SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY frame_seq ORDER BY support DESC, level, attempt) = 1
), lower AS (
  SELECT v.* FROM votes v JOIN best b USING (frame_seq) WHERE v.support * 10 >= b.support * 6 AND v.level < b.level - 0.25e0
  QUALIFY row_number() OVER (PARTITION BY v.frame_seq ORDER BY v.support DESC, v.level, v.attempt) = 1
), chosen AS (
  SELECT b.frame_seq, l.frame_seq IS NOT NULL AS lowered, coalesce(l.a, b.a) AS a, coalesce(l.b, b.b) AS b, coalesce(l.c, b.c) AS c FROM best b LEFT JOIN lower l USING (frame_seq)
), sums AS (
  SELECT frame_seq, c.a, c.b, c.c, sum(x * x) xx, sum(x * y) xy, sum(x) sx, sum(y * y) yy, sum(y) sy, count(*) m, sum(x * z) xz, sum(y * z) yz, sum(z) sz
  FROM chosen c JOIN seeds USING (frame_seq) WHERE abs(z - (x * c.a + y * c.b + c.c)) <= 0.125e0 GROUP BY ALL
), fits AS (
  SELECT *, xx * (yy * m - sy * sy) - xy * (xy * m - sx * sy) + sx * (xy * sy - sx * yy) AS det FROM sums
), refits AS (
  SELECT *, (xz * (yy * m - sy * sy) - xy * (yz * m - sz * sy) + sx * (yz * sy - sz * yy)) / det AS ra,
    (xx * (yz * m - sz * sy) - xz * (xy * m - sx * sy) + sx * (xy * sz - sx * yz)) / det AS rb,
    (xx * (yy * sz - sy * yz) - xy * (xy * sz - sx * yz) + xz * (xy * sy - sx * yy)) / det AS rc FROM fits
)
SELECT frame_seq, round(CASE WHEN ok THEN ra ELSE a END, 6) AS a, round(CASE WHEN ok THEN rb ELSE b END, 6) AS b, round(CASE WHEN ok THEN rc ELSE c END, 6) AS c
FROM (SELECT *, abs(det) >= 1e-9 AND sqrt(ra * ra + rb * rb) <= 0.15e0 AND rc BETWEEN -3 AND 0.5e0 AS ok FROM refits)"""


@query("q_floor_sampled", FLOOR_SAMPLED_SQL)
def floor_sampled(spark, sf_dir):
    """K1 K2: floor planes by seeded sampling, on slopes with returns above them and with a raised floor over most of
    some frames, and their refit."""
    ring, x, z = F.col("ring"), F.col("x"), F.col("z")
    raised = (F.col("frame_seq") % 3 == 0) & (F.floor(x) % 5 < 3)
    scene = points(spark, sf_dir).withColumn(
        "z", F.when(ring == 7, z / 4 - 0.5).otherwise((F.col("frame_seq") % 7) * x / 1024 - 1.5 + z / 32) + F.when(raised, 0.5).otherwise(0.0))
    found = floor.sampled_floor(scene, ["frame_seq"], SAMPLED)
    return found.select("frame_seq", *[F.round(c, 6).alias(c) for c in "abc"])
