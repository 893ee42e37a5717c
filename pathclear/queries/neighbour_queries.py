"""Queries with grid-neighbour joins, components, candidates and profile shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathclear.config import DetectorConfig
from pathclear.functions import geometry as g
from pathclear.functions.settling import settle
from pathclear.operators import background as bg
from pathclear.operators import candidates as cand
from pathclear.operators import graph, grids, tiles
from pathclear.operators import points as ops
from pathclear.queries import point_queries as pq
from pathclear.queries.registry import query
from pathclear.queries.views import POINTS_SQL, points

FRAME = ["frame_seq"]
CELL = 1.0

IMAGE_SQL = f"""
image AS (
  SELECT frame_seq, {pq.az_sql('1.0')} AS az, {pq.el_sql('1.0')} AS el, min({{'range': {pq.RANGE_SQL}, 'raw_index': raw_index, 'x': x, 'y': y, 'z': z}}) AS p
  FROM points GROUP BY ALL
)"""
BASELINE_SQL = f"""
{IMAGE_SQL}, baseline AS (
  SELECT frame_seq + back AS frame_seq, az, el, median(p.range) AS base, count(*) / 5 AS share
  FROM image, (VALUES (10), (9), (7), (5), (3)) t(back) WHERE frame_seq + back >= (SELECT min(frame_seq) FROM image) + 10 GROUP BY ALL
)"""


def image(spark, sf_dir):
    return grids.range_image(points(spark, sf_dir), FRAME, CELL)


def baseline(spark, sf_dir):
    # Frames are numbered from zero in these tables.
    return bg.rolling_baseline(image(spark, sf_dir), "frame_seq", bg.baseline_picks(2, 8, 5), 0)


@query("q_baseline_cells", f"""WITH {POINTS_SQL}, {BASELINE_SQL}
SELECT frame_seq, az, el, round(base, 9) AS base, share FROM baseline""")
def baseline_cells(spark, sf_dir):
    """Rolling baseline of past range images."""
    return baseline(spark, sf_dir).withColumn("base", F.round("base", 9))


@query("q_foreground_mask", f"""WITH {POINTS_SQL}, {BASELINE_SQL}
SELECT i.frame_seq, i.az, i.el, round(p.range, 9) AS range, coalesce(p.range < base - (0.5e0 + 0.02e0 * base), false) AS nearer, coalesce(share, 0) < 0.2e0 AS appeared
FROM image i LEFT JOIN baseline b ON i.frame_seq = b.frame_seq AND i.az = b.az AND i.el = b.el
WHERE coalesce(p.range < base - (0.5e0 + 0.02e0 * base), false) OR coalesce(share, 0) < 0.2e0""")
def foreground_mask(spark, sf_dir):
    """Cells nearer than the baseline or newly occupied."""
    front = bg.foreground(image(spark, sf_dir), baseline(spark, sf_dir), FRAME)
    return front.select("frame_seq", "az", "el", F.round("range", 9).alias("range"), "nearer", "appeared")


def az_sql(x, y):
    return pq.az_sql("1.0", x, y)


@query("q_history_clearance", f"""WITH {POINTS_SQL}, {IMAGE_SQL}, moved AS (
  SELECT frame_seq, az, el, frame_seq - back AS past, p.x + back * 0.5e0 AS px, p.y AS y, p.z AS z FROM image, (VALUES (6), (7), (8), (9), (10)) t(back)
), placed AS (
  SELECT *, {az_sql('px', 'y')} AS paz, {pq.el_sql('1.0', 'px', 'y', 'z')} AS pel, sqrt(px * px + y * y + z * z) AS prange FROM moved WHERE px <= 120
), c AS (
  SELECT m.frame_seq, m.az, m.el, m.past, min({{'clearance': h.p.range - prange, 'seen': h.p.range}}) AS c FROM placed m
  JOIN image h ON h.frame_seq = m.past AND h.az BETWEEN paz - 1 AND paz + 1 AND h.el BETWEEN pel - 1 AND pel + 1 GROUP BY ALL
), v AS (
  SELECT frame_seq, az, el, count(*) AS votes, list_sort(list(c.clearance))[count(*) // 2 + 1] AS median_clearance, avg(c.seen) AS reference FROM c GROUP BY ALL
)
SELECT frame_seq, az, el, votes, round(median_clearance, 6) AS median_clearance, round(reference, 6) AS reference,
  votes >= 2 AND median_clearance > 0.5e0 + 0.02e0 * reference AS foreground FROM v""")
def history_clearance(spark, sf_dir):
    """J7 ST4 ST23: clearance against past frames moved by odometry, and the foreground vote."""
    current = settle(image(spark, sf_dir).withColumnRenamed("frame_seq", "ordinal"))
    back = F.explode(F.array(*[F.lit(b) for b in range(6, 11)])).alias("back")
    links = current.select("ordinal").distinct().select(
        "ordinal", back
    ).select("ordinal", (F.col("ordinal") - F.col("back")).alias("past"), (F.col("back") * 0.5).alias("shift"))
    zero = (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    found = bg.history_clearance(current, links, current, [], CELL, 120.0, zero)
    votes = bg.foreground_vote(found, [], 0.5, 0.02)
    return votes.select(
        F.col("ordinal").alias("frame_seq"), "az", "el", "votes",
        F.round("median_clearance", 6).alias("median_clearance"),
        F.round("reference", 6).alias("reference"), "foreground",
    )


CELLS_SQL = f"""
{pq.EVIDENCE_SQL}, ev AS (SELECT * FROM evidence WHERE channels > 0),
cells AS (SELECT frame_seq, az, el, min(range) AS range, bit_or(channels) AS channels FROM ev GROUP BY ALL),
edges AS (
  SELECT a.frame_seq, a.az AS az1, a.el AS el1, b.az AS az2, b.el AS el2 FROM cells a JOIN cells b ON a.frame_seq = b.frame_seq
    AND b.az - a.az BETWEEN -2 AND 2 AND b.el - a.el BETWEEN -2 AND 2 AND (b.az > a.az OR (b.az = a.az AND b.el > a.el))
  WHERE abs(a.range - b.range) <= 0.5e0 + 0.02e0 * least(a.range, b.range)
)"""
COMPONENTS_SQL = f"""
{CELLS_SQL}, links AS (
  SELECT frame_seq, az1 * 4096 + el1 AS a, az2 * 4096 + el2 AS b FROM edges UNION ALL SELECT frame_seq, az2 * 4096 + el2, az1 * 4096 + el1 FROM edges
), cc(frame_seq, cell, component) USING KEY (frame_seq, cell) AS (
  SELECT frame_seq, az * 4096 + el, az * 4096 + el FROM cells
  UNION
  SELECT l.frame_seq, l.b, min(c.component) FROM cc c JOIN links l ON l.frame_seq = c.frame_seq AND l.a = c.cell
    JOIN recurring.cc r ON r.frame_seq = l.frame_seq AND r.cell = l.b WHERE c.component < r.component GROUP BY ALL
)"""


def cells(spark, sf_dir):
    return pq.evidence_channels(spark, sf_dir)


@query("q_cell_adjacency", f"WITH {POINTS_SQL}, {CELLS_SQL} SELECT * FROM edges")
def cell_adjacency(spark, sf_dir):
    """Neighbouring cells at compatible ranges."""
    return graph.adjacent_cells(cells(spark, sf_dir), FRAME)


@query("q_components", f"""WITH RECURSIVE {POINTS_SQL}, {COMPONENTS_SQL}
SELECT frame_seq, cell // 4096 AS az, cell % 4096 AS el, CAST(component AS BIGINT) AS component FROM cc""")
def components(spark, sf_dir):
    """K7: connected components of evidence cells."""
    return graph.cell_components(cells(spark, sf_dir), FRAME).drop("range")


def candidate_points(spark, sf_dir):
    pts = pq.evidence_points(spark, sf_dir)
    channels = F.col("channels")
    return pts.withColumns({
        "soff": g.route_offset(F.col("x"), F.col("y"), pq.ROUTE),
        "in_gauge": channels.bitwiseAND(2) > 0, "in_band": channels.bitwiseAND(1) > 0,
        "gauge_near": (F.col("off") <= 0.9) & F.col("h").between(0.6, 2.5),
        "origin_x": F.lit(0.0),
    })


def labelled_cells(spark, sf_dir):
    found = cells(spark, sf_dir).select("frame_seq", "az", "el", "range", "channels")
    return graph.cell_components(found, FRAME, carried=["channels"]).withColumnsRenamed(
        {"range": "cell_range", "channels": "cell_channels"}
    ).withColumn("motion", F.lit(True))


def features(spark, sf_dir):
    pts = candidate_points(spark, sf_dir).filter(F.col("channels") > 0)
    per_cell = cand.cell_features(pts, labelled_cells(spark, sf_dir), FRAME, pq.EVIDENCE)
    # The strip beside a low component is asked of the features and joined to them: they are read twice.
    merged = settle(cand.component_features(per_cell, FRAME))
    low = points(spark, sf_dir).withColumn("h", pq._height()).filter(
        F.col("x").between(0, 60) & (F.abs(pq._offset()) <= 1.15) & F.col("h").between(0, 1)
    )
    return cand.evidence_features(cand.raised_low(merged, low, FRAME, pq.EVIDENCE))


FEATURES_SQL = f"""
{COMPONENTS_SQL}, member AS (
  SELECT e.*, cc.component, c.range AS cell_range, c.channels AS cell_channels, {pq.OFFSET_SQL} AS soff,
    e.range <= c.range + 0.5 AS front, e.off <= 2 AS inside,
    c.channels & 1 = 0 AND e.off > 0.5 AND e.h < 1 AS structure,
    e.off <= 0.9e0 AND e.h BETWEEN 0.6e0 AND 2.5 AND e.range <= c.range + 5 AS long_part
  FROM ev e JOIN cells c USING (frame_seq, az, el) JOIN cc ON cc.frame_seq = e.frame_seq AND cc.cell = e.az * 4096 + e.el
), possible AS (
  SELECT frame_seq, component, min(x) lx, max(x) hx, min(y) ly, max(y) hy, max(h) AS top, sum(soff) / count(*) AS mean_offset FROM member WHERE front AND inside GROUP BY ALL
), low_points AS (
  SELECT frame_seq, x, y, {pq.HEIGHT_SQL} AS h FROM points WHERE x BETWEEN 0 AND 60 AND abs({pq.OFFSET_SQL}) <= 1.15e0 AND {pq.HEIGHT_SQL} BETWEEN 0 AND 1
), ctx AS (
  SELECT p.frame_seq, p.component, CASE WHEN l.x - (lx + hx) / 2 BETWEEN -2.5 AND -0.75 THEN 'before' WHEN l.x - (lx + hx) / 2 BETWEEN 0.75 AND 2.5 THEN 'after' END AS side, l.h
  FROM possible p JOIN low_points l ON l.frame_seq = p.frame_seq AND abs(l.y - (ly + hy) / 2) <= 0.25 AND abs(l.x - (lx + hx) / 2) BETWEEN 0.75 AND 2.5
  WHERE top < 1 AND abs(mean_offset) > 0.5 AND hx - lx <= 0.6e0 AND hy - ly >= 0.15e0
), upper AS (
  SELECT frame_seq, component, max(u) AS u FROM (SELECT frame_seq, component, side, list_sort(list(h))[9 * (count(*) - 1) // 10 + 1] AS u, count(*) AS n FROM ctx GROUP BY ALL)
  WHERE n >= 10 GROUP BY ALL HAVING count(*) = 2
), raised AS (
  SELECT p.frame_seq, p.component FROM possible p JOIN upper USING (frame_seq, component) WHERE top >= u + 0.15e0
), feats AS (
  SELECT m.frame_seq, m.component, bit_or(cell_channels) AS channels, count(DISTINCT cell_key) AS cells,
    min(x) FILTER (e) AS lo_x, max(x) FILTER (e) AS hi_x, min(y) FILTER (e) AS lo_y, max(y) FILTER (e) AS hi_y, min(z) FILTER (e) AS lo_z, max(z) FILTER (e) AS hi_z,
    min(off) FILTER (e) AS closest_offset, count(*) FILTER (e AND inside) AS support, count(DISTINCT cell_key) FILTER (e AND inside) AS inside_cells,
    min(z) FILTER (e AND inside) AS in_lo_z, max(z) FILTER (e AND inside) AS in_hi_z, min(x) FILTER (e AND inside) AS distance_m,
    coalesce(max(x) FILTER (long_part AND off <= 0.9e0) - min(x) FILTER (long_part AND off <= 0.9e0), max(x) FILTER (long_part) - min(x) FILTER (long_part)) AS gauge_length,
    bool_or(is_raised) AS raised
  FROM (SELECT m.*, az * 4096 + el AS cell_key, r.component IS NOT NULL AS is_raised, front AND (NOT structure OR r.component IS NOT NULL) AS e
    FROM member m LEFT JOIN raised r ON r.frame_seq = m.frame_seq AND r.component = m.component) m GROUP BY ALL
), full_feats AS (SELECT f.*, top, mean_offset FROM feats f LEFT JOIN possible p USING (frame_seq, component))"""


@query("q_component_features", f"""WITH RECURSIVE {POINTS_SQL}, {FEATURES_SQL}
SELECT frame_seq, CAST(component AS BIGINT) AS component, cells, channels, lo_x, lo_y, lo_z, hi_x, hi_y, hi_z, closest_offset, support, inside_cells, in_lo_z, in_hi_z,
  distance_m, gauge_length, top, round(mean_offset, 9) AS mean_offset, raised FROM full_feats""")
def component_features(spark, sf_dir):
    """Bounding box, support, extents and offsets of every component."""
    return features(spark, sf_dir).select(
        "frame_seq", "component", "cells", "channels", *[f"{n}_{c}" for n in ("lo", "hi") for c in "xyz"],
        "closest_offset", "support", "inside_cells", "in_lo_z", "in_hi_z",
        F.col("near.distance").alias("distance_m"), "gauge_length", "top",
        F.round("mean_offset", 9).alias("mean_offset"), "raised",
    )


@query("q_rejection_chain", f"""WITH RECURSIVE {POINTS_SQL}, {FEATURES_SQL}, centred AS (
  SELECT *, abs((lo_y + hi_y) / 2 - ((lo_x + hi_x) / 2 / 256 + (lo_x + hi_x) / 2 * ((lo_x + hi_x) / 2) / 8192)) AS mid FROM full_feats
)
SELECT frame_seq, CAST(component AS BIGINT) AS component, CASE WHEN inside_cells < 3 THEN 'FEW_CELLS' WHEN support < 5 THEN 'FEW_POINTS'
  WHEN in_hi_z - in_lo_z < CASE WHEN channels & 2 > 0 THEN 0.1e0 ELSE 0.25e0 END THEN 'LOW_EXTENT' WHEN distance_m > 60 AND in_hi_z - in_lo_z < 0.4e0 THEN 'FAR_LOW_EXTENT'
  WHEN channels = 2 AND coalesce(gauge_length, 0) > 3 THEN 'LONG_GAUGE_STRUCTURE' WHEN closest_offset > 0.9e0 AND hi_x - lo_x > 3 THEN 'LONG_EDGE_STRUCTURE'
  WHEN channels & 2 = 0 AND mid > 1.5 THEN 'OUTSIDE_ENVELOPE' WHEN top < 1 AND abs(mean_offset) > 0.5 AND NOT raised THEN 'LOW_OFF_CENTRE' END AS reason FROM centred""")
def rejection_chain(spark, sf_dir):
    """First matching rejection of every component, null for candidates; without walls and poles (``q_rejection_rules``)."""
    mid = F.abs(g.route_offset(
        (F.col("lo_x") + F.col("hi_x")) / 2, (F.col("lo_y") + F.col("hi_y")) / 2, pq.ROUTE
    ))
    reason = cand.rejection_reason(
        pq.EVIDENCE, F.lit(60.0), F.lit(True), F.lit(False), F.lit(False), mid
    )
    return features(spark, sf_dir).select("frame_seq", "component", reason.alias("reason"))


# Every rule is on, the two that a profile may switch off too.
RULES = DetectorConfig(side_structure_max_length_m=2.5, static_inner_half_width_m=0.625)


@query("q_rejection_rules", """WITH f AS (
  SELECT l_orderkey, l_linenumber, 2 + l_partkey % 16 AS inside_cells, 3 + l_suppkey % 32 AS support, (l_partkey % 13) * 0.0625e0 AS extent, 2 * l_quantity AS distance,
    1 + l_suppkey % 3 AS channels, CASE WHEN l_tax > 0 THEN round(l_tax * 100) * 0.5e0 END AS gauge_length, round(l_discount * 100) * 0.125e0 AS closest_offset,
    (l_partkey % 7) * 0.75e0 AS length, (l_suppkey % 5) * 0.125e0 AS width, (l_partkey % 11) * 0.25e0 AS top, (round(l_discount * 100) - 5) * 0.25e0 AS mean_offset,
    l_returnflag = 'R' AS raised, l_partkey % 2 = 0 AS moving, l_returnflag = 'N' AS wall, l_partkey % 9 = 0 AS pole, (l_suppkey % 8) * 0.25e0 AS centre FROM lineitem
) SELECT l_orderkey, l_linenumber, CASE WHEN inside_cells < 3 THEN 'FEW_CELLS' WHEN support < 5 THEN 'FEW_POINTS'
  WHEN extent < CASE WHEN channels >= 2 THEN 0.1e0 ELSE 0.25e0 END THEN 'LOW_EXTENT' WHEN distance > 60 AND extent < 0.4e0 THEN 'FAR_LOW_EXTENT'
  WHEN distance > 60 AND wall THEN 'FAR_WALL_CONTACT' WHEN channels = 2 AND coalesce(gauge_length, 0) > 3 THEN 'LONG_GAUGE_STRUCTURE' WHEN pole THEN 'POLE_STRUCTURE'
  WHEN closest_offset > 0.9e0 AND length > 3 THEN 'LONG_EDGE_STRUCTURE' WHEN closest_offset > 0.5 AND greatest(length, coalesce(gauge_length, 0)) > 2.5 THEN 'LONG_SIDE_STRUCTURE'
  WHEN channels >= 2 AND centre > 0.625e0 AND (length > 1 OR width < 0.15e0 OR support < 10) THEN 'WEAK_OUTER_STATIC' WHEN moving AND channels = 1 AND centre > 1.5 THEN 'OUTSIDE_ENVELOPE'
  WHEN top < 1 AND abs(mean_offset) > 0.5 AND NOT raised THEN 'LOW_OFF_CENTRE' END AS reason FROM f""")
def rejection_rules(spark, sf_dir):
    """The order of all twelve rules, on one component for each order line."""
    part, supp, zero = F.col("l_partkey"), F.col("l_suppkey"), F.lit(0.0)
    discount, tax = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({
        "inside_cells": 2 + part % 16, "support": 3 + supp % 32, "in_lo_z": zero, "in_hi_z": (part % 13) * 0.0625,
        "near": F.struct((2 * F.col("l_quantity")).alias("distance")), "channels": (1 + supp % 3).cast("int"),
        "gauge_length": F.when(F.col("l_tax") > 0, tax * 0.5), "closest_offset": discount * 0.125,
        "lo_x": zero, "hi_x": (part % 7) * 0.75, "lo_y": zero, "hi_y": (supp % 5) * 0.125, "top": (part % 11) * 0.25,
        "mean_offset": (discount - 5) * 0.25, "raised": F.col("l_returnflag") == "R",
    })
    reason = cand.rejection_reason(
        RULES, F.lit(60.0), part % 2 == 0, F.col("l_returnflag") == "N", part % 9 == 0, (supp % 8) * 0.25)
    return found.select("l_orderkey", "l_linenumber", reason.alias("reason"))



NODES_SQL = f"""
nodes AS (
  SELECT frame_seq, x, y, z, min(raw_index) AS id, count(*) AS copies, greatest(0.15e0, least(0.6e0, 2.5e0 * ({pq.RANGE_SQL} * 0.008726646259971648e0))) AS eps FROM points GROUP BY ALL
), pairs AS (
  SELECT a.frame_seq, a.id AS u, b.id AS v, a.copies AS cu, b.copies AS cv FROM nodes a JOIN nodes b ON a.frame_seq = b.frame_seq AND a.id <> b.id
    AND b.x BETWEEN a.x - 0.6e0 AND a.x + 0.6e0 AND b.y BETWEEN a.y - 0.6e0 AND a.y + 0.6e0
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= greatest(a.eps, b.eps)
)"""


def nodes(spark, sf_dir):
    """Distinct places of every frame with their copies: equal returns are one node."""
    eps = graph.neighbour_radius(g.norm(F.col("x"), F.col("y"), F.col("z")), 0.2, 0.5)
    return points(spark, sf_dir).groupBy("frame_seq", "x", "y", "z").agg(
        F.min("raw_index").alias("id"), F.count(F.lit(1)).alias("copies")
    ).withColumn("eps", eps)


@query("q_eps_neighbours", f"""WITH {POINTS_SQL}, {NODES_SQL}
SELECT n.frame_seq, n.id, any_value(n.copies) AS copies, CAST(any_value(n.copies) - 1 + coalesce(sum(cv), 0) AS BIGINT) AS neighbours FROM nodes n LEFT JOIN pairs p ON p.frame_seq = n.frame_seq AND p.u = n.id GROUP BY n.frame_seq, n.id""")
def eps_neighbours(spark, sf_dir):
    """Returns within a radius that grows with range."""
    return tiles.neighbour_counts(nodes(spark, sf_dir), FRAME)


@query("q_eps_clusters", f"""WITH RECURSIVE {POINTS_SQL}, {NODES_SQL}, cc(frame_seq, id, component) USING KEY (frame_seq, id) AS (
  SELECT frame_seq, id, id FROM nodes
  UNION
  SELECT p.frame_seq, p.v, min(c.component) FROM cc c JOIN pairs p ON p.frame_seq = c.frame_seq AND p.u = c.id
    JOIN recurring.cc r ON r.frame_seq = p.frame_seq AND r.id = p.v WHERE c.component < r.component GROUP BY ALL
), members AS (SELECT p.*, cc.component, {pq.RANGE_SQL} AS range, {pq.az_sql('0.25')} * 4096 + {pq.el_sql('0.25')} AS cell FROM points p JOIN nodes n USING (frame_seq, x, y, z) JOIN cc ON cc.frame_seq = n.frame_seq AND cc.id = n.id),
f AS (SELECT frame_seq, component, count(*) AS points, count(DISTINCT cell) AS cells, median(range) AS r, max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, max(z) - min(z) AS size_z, avg(x) AS cx FROM members GROUP BY ALL)
SELECT frame_seq, component, points, cells, round(r, 6) AS range, size_x, size_y, size_z, round(cx, 6) AS center_x,
  cells >= greatest(4, 0.3e0 * (0.5e0 / (r * 0.003490658503988659e0)) * (1.7e0 / (r * 0.008726646259971648e0))) AND size_z >= 1.0e0 - r * 0.008726646259971648e0 AND size_z <= 2.2e0 + r * 0.008726646259971648e0
    AND greatest(size_x, size_y) <= 1.2e0 + r * 0.003490658503988659e0 AS person FROM f""")
def eps_clusters(spark, sf_dir):
    """Single-link clusters with their features and the person test."""
    named = tiles.close_components(nodes(spark, sf_dir), FRAME).drop("eps")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    key = ["frame_seq", "component"]
    # A cluster is part of one frame: its ranges and cells are few, and it moves once.
    facts = named.repartition(*key).withColumns({
        "range": g.norm(x, y, z),
        "cell": g.cell_key(g.azimuth_cell(x, y, 0.25), g.elevation_cell(x, y, z, 0.25)),
    }).groupBy(*key).agg(
        F.sum("copies").alias("points"), F.size(F.collect_set("cell")).cast("long").alias("cells"),
        F.percentile("range", F.lit(0.5), F.col("copies")).alias("range"),
        *[(F.max(c) - F.min(c)).alias(f"size_{c}") for c in "xyz"],
        (F.sum(x * F.col("copies")) / F.sum("copies")).alias("center_x"),
    )
    person = bg.plausible_person(
        F.col("cells"), F.col("range"), tuple(F.col(f"size_{c}") for c in "xyz"), 0.2, 0.5
    )
    return facts.select(
        *key, "points", "cells", F.round("range", 6).alias("range"), "size_x", "size_y", "size_z",
        F.round("center_x", 6).alias("center_x"), person.alias("person"),
    )


@query("q_low_bump_context", f"""WITH {POINTS_SQL}, {pq.BOXES_SQL}, low AS (SELECT frame_seq, x, y, z + 1.5 AS h FROM points WHERE z + 1.5 BETWEEN 0 AND 1), c AS (
  SELECT b.frame_seq, box, CASE WHEN l.x < (lo_x + hi_x) / 2 THEN 'before' ELSE 'after' END AS side, h FROM boxes b JOIN low l ON l.frame_seq = b.frame_seq
    AND abs(l.x - (lo_x + hi_x) / 2) BETWEEN 0.75 AND 2.5 AND abs(l.y - (lo_y + hi_y) / 2) <= 0.25
), u AS (SELECT frame_seq, box, side, list_sort(list(h))[9 * (count(*) - 1) // 10 + 1] AS upper FROM c GROUP BY ALL)
SELECT frame_seq, box, max(upper) AS upper FROM u GROUP BY ALL HAVING count(*) = 2""")
def low_bump_context(spark, sf_dir):
    """J12 Q-C: high rank of the low returns before and behind every box."""
    bumps = pq.boxes(spark, sf_dir).select(
        "frame_seq", "box", ((F.col("lo_x") + F.col("hi_x")) / 2).alias("bx"),
        ((F.col("lo_y") + F.col("hi_y")) / 2).alias("by"),
    )
    low = points(spark, sf_dir).withColumn("h", F.col("z") + 1.5).filter(F.col("h").between(0, 1))
    return cand.bump_context(bumps, low, FRAME, "box", 1)


@query("q_pole_context", f"""WITH {POINTS_SQL}, thin AS (
  SELECT frame_seq, CAST(floor(x) AS INTEGER) * 16 + CAST(floor(y * 2) AS INTEGER) + 8 AS component, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y
  FROM points GROUP BY ALL
), h AS (
  SELECT DISTINCT t.frame_seq, component, p.z + 2 AS h FROM thin t JOIN points p ON p.frame_seq = t.frame_seq AND p.x BETWEEN lo_x - 0.2e0 AND hi_x + 0.2e0 AND p.y BETWEEN lo_y - 0.2e0 AND hi_y + 0.2e0
  WHERE hi_x - lo_x <= 0.8e0 AND hi_y - lo_y <= 0.8e0
), g AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY frame_seq, component ORDER BY h) > 1 THEN 1 ELSE 0 END AS gap FROM h),
w AS (SELECT *, max(gap) OVER (PARTITION BY frame_seq, component ORDER BY h) AS broken FROM g),
r AS (SELECT frame_seq, component, min(h) AS foot, max(h) FILTER (broken = 0) AS reach FROM w GROUP BY ALL)
SELECT frame_seq, component, coalesce(foot <= 0.55e0 AND reach >= 3.1e0, false) AS pole FROM thin LEFT JOIN r USING (frame_seq, component)""")
def pole_context(spark, sf_dir):
    """Thin columns that stand from the floor past the corridor."""
    config = DetectorConfig(corridor_height_m=3.0, hanging_tip_max_height_m=3.0)
    column = F.floor("x").cast("int") * 16 + F.floor(F.col("y") * 2).cast("int") + 8
    thin = points(spark, sf_dir).groupBy("frame_seq", column.alias("component")).agg(
        *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))],
        F.lit(99).alias("support"),
    )
    pts = points(spark, sf_dir).withColumn("h", F.col("z") + 2)
    return cand.pole_reach(thin, pts, FRAME, config).select("frame_seq", "component", "pole")


@query("q_unlinked", f"""WITH {POINTS_SQL}, {pq.BOXES_SQL}, owned AS (SELECT DISTINCT frame_seq, CAST(floor(x / 10) AS INTEGER) AS box FROM points WHERE flag = 'A' AND z = 2 AND abs(y) <= 0.5),
tips AS (SELECT frame_seq, CAST(floor(x / 0.5e0) AS INTEGER) AS tip, avg(x) AS cx, avg(y) AS cy FROM points WHERE z = 2 AND y = 0 GROUP BY ALL)
SELECT 'unlinked' AS kind, b.frame_seq, b.box AS number FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.frame_seq = b.frame_seq AND o.box = b.box)
UNION ALL SELECT 'lone_tip', t.frame_seq, t.tip FROM tips t WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.frame_seq = t.frame_seq
  AND sqrt((t.cx - (lo_x + hi_x) / 2) * (t.cx - (lo_x + hi_x) / 2) + (t.cy - (lo_y + hi_y) / 2) * (t.cy - (lo_y + hi_y) / 2)) < 0.5e0)""")
def unlinked(spark, sf_dir):
    """Clusters nobody owns, and tips with no candidate close by."""
    found, pts = pq.boxes(spark, sf_dir), points(spark, sf_dir)
    owned = pts.filter("flag = 'A' AND z = 2 AND abs(y) <= 0.5").select(
        "frame_seq", F.floor(F.col("x") / 10).cast("int").alias("box")
    ).distinct()
    free = found.join(owned, ["frame_seq", "box"], "left_anti").select(
        F.lit("unlinked").alias("kind"), "frame_seq", F.col("box").alias("number")
    )
    tips = pts.filter("z = 2 AND y = 0").groupBy(
        "frame_seq", F.floor(F.col("x") / 0.5).cast("int").alias("tip")
    ).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    centres = found.select(
        "frame_seq", ((F.col("lo_x") + F.col("hi_x")) / 2).alias("cx"),
        ((F.col("lo_y") + F.col("hi_y")) / 2).alias("cy"),
    )
    lone = graph.unmatched_near(tips, centres, FRAME, "cx", "cy", 0.5)
    return free.unionByName(lone.select(
        F.lit("lone_tip").alias("kind"), "frame_seq", F.col("tip").alias("number")
    ))


CURVE_SQL = """
bins AS (SELECT vec_id AS frame_no, u.bin AS bin, embedding[u.bin + 1] AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS bin) u),
curve AS (
  SELECT a.frame_no, s.shift AS shift, count(*) AS pairs, CASE WHEN count(*) >= 52 THEN sum(least(CAST(abs(a.v - b.v) AS DOUBLE), 0.3e0)) / count(*) END AS error
  FROM bins a, (SELECT unnest(range(0, 17)) AS shift) s, bins b WHERE b.frame_no = a.frame_no - 1 AND b.bin = a.bin + s.shift GROUP BY ALL
)"""


def curves(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    now = table.select(F.col("vec_id").alias("frame_no"), F.array("embedding").alias("now"))
    then = table.select((F.col("vec_id") + 1).alias("frame_no"), F.array("embedding").alias("then"))
    errors = bg.shift_errors(F.col("now"), F.col("then"), 16, 0.3, 52)
    return now.join(then, "frame_no").select("frame_no", errors.alias("errors"))


@query("q_profile_shift", f"WITH {CURVE_SQL} SELECT frame_no, CAST(shift AS INTEGER) AS shift, round(error, 9) AS error FROM curve")
def profile_shift(spark, sf_dir):
    """Mean capped profile difference for every forward shift."""
    return curves(spark, sf_dir).select(
        "frame_no", F.posexplode("errors").alias("shift", "error")
    ).withColumn("error", F.round("error", 9))


@query("q_speed_curve_stats", f"""WITH {CURVE_SQL}
SELECT frame_no, round(list_sort(list(error) FILTER (error IS NOT NULL))[count(error) // 2 + 1], 9) AS median, round(min(error), 9) AS best,
  CAST(arg_min(shift, (round(error, 12), shift)) FILTER (error IS NOT NULL) AS BIGINT) AS best_shift,
  round(list_sort(list(error) FILTER (error IS NOT NULL))[count(error) // 2 + 1] - min(error), 9) AS contrast,
  round(arg_min(shift, (round(error, 12), shift)) FILTER (error IS NOT NULL) * 0.05e0 / 0.1e0, 9) AS speed_mps FROM curve GROUP BY frame_no""")
def speed_curve_stats(spark, sf_dir):
    """Median, best shift, contrast and the speed of the best shift."""
    stats = bg.curve_statistics(F.col("errors"))
    df = curves(spark, sf_dir).select("frame_no", *[c.alias(n) for n, c in stats.items()])
    return df.select(
        "frame_no", F.round("median", 9).alias("median"), F.round("best", 9).alias("best"), "best_shift",
        F.round("contrast", 9).alias("contrast"),
        F.round(bg.speed_of_shift(F.col("best_shift"), F.lit(0.1)), 9).alias("speed_mps"),
    )
