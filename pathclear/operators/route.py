"""Route centre from tunnel walls and rails."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathclear.config import DetectorConfig
from pathclear.functions import geometry as g
from pathclear.functions.ranks import array_rank
from pathclear.operators.grids import WALL_MAX_M, WALL_MIN_M, WALL_MIN_X, WALL_NEAR_MAX_X, trunc

NEAR_SLICES = int(WALL_NEAR_MAX_X - WALL_MIN_X)


def _three_or_more_median(values: Column) -> Column:
    known = F.array_compact(values)
    return F.when(F.size(known) >= 3, array_rank(known, F.floor(F.size(known) / 2)))


def wall_shifts(walls: DataFrame, keys: list[str]) -> DataFrame:
    """Centre shift per slice against the near-range wall offsets (upper medians)."""
    near = walls.filter(F.col("slice") < NEAR_SLICES).groupBy(*keys).agg(
        _three_or_more_median(F.collect_list("left_y")).alias("left0"),
        _three_or_more_median(F.collect_list("right_y")).alias("right0"),
    )
    sides = F.array_compact(
        F.array(F.col("left_y") - F.col("left0"), F.col("right_y") - F.col("right0"))
    )
    total = F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)
    return (
        walls.join(near, keys)
        .withColumn("sides", F.size(sides))
        .filter(F.col("sides") > 0)
        .select(*keys, (F.col("slice") + (WALL_MIN_X + 0.5)).alias("x"),
                (total / F.col("sides")).alias("shift"))
    )


def fit_without_intercept(shifts: DataFrame, keys: list[str]) -> DataFrame:
    """y = c1 x + c2 x^2 per group, from five sums; singular groups are dropped."""
    x, s = F.col("x"), F.col("shift")
    sums = shifts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("slices"), F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"),
        F.sum(x * x * x * x).alias("s4"), F.sum(x * s).alias("t1"), F.sum(x * x * s).alias("t2"),
    )
    det = F.col("s2") * F.col("s4") - F.col("s3") * F.col("s3")
    return sums.filter((F.col("slices") >= 3) & (F.abs(det) >= 1e-9)).select(
        *keys, "slices",
        ((F.col("t1") * F.col("s4") - F.col("t2") * F.col("s3")) / det).alias("c1"),
        ((F.col("s2") * F.col("t2") - F.col("s3") * F.col("t1")) / det).alias("c2"),
    )


# Fixed values of the rail search.
RAIL_MIN_X, RAIL_MAX_X, RAIL_BIN_M, RAIL_HALF_GAUGE_M = 4.0, 30.0, 2.0, 0.797
RAIL_HEIGHT_TOLERANCE, RAIL_PAIR_TOLERANCE, RAIL_MIN_POINTS, RAIL_MIN_SLICES = 0.07, 0.1, 3, 4


def rail_shifts(points: DataFrame, keys: list[str], rail_height: Column) -> DataFrame:
    """Track centre relative to the route per 2 m slice, from one rail or a gauge-wide pair.

    Points carry ``x``, ``offset`` and ``h``.  Values are counted per distinct offset first, so a
    slice of any size is ranked without being gathered.
    """
    from pathclear.functions.ranks import rank_values, upper_median

    x, off = F.col("x"), F.col("offset")
    on_rail = points.filter(
        (x >= RAIL_MIN_X) & (x < RAIL_MAX_X)
        & (F.abs(F.col("h") - rail_height) <= RAIL_HEIGHT_TOLERANCE)
        & F.abs(off).between(0.45, 1.15)
    ).select(
        *keys, trunc((x - RAIL_MIN_X) / RAIL_BIN_M).alias("slice"),
        F.when(off > 0, "left").otherwise("right").alias("side"),
        off.cast("float").alias("rail"),
    )
    medians = rank_values(
        on_rail, [*keys, "slice", "side"], "rail", {"median": upper_median}, [-0.8, 0.0, 0.8]
    )
    strong = F.col("n") >= RAIL_MIN_POINTS

    def side(name):
        picked = F.when(strong & (F.col("side") == name), F.col("median").cast("double"))
        return F.max(picked)

    l, r = F.col("l"), F.col("r")
    pair = l.isNotNull() & r.isNotNull()
    fits = ~pair | (F.abs(l - r - 2 * RAIL_HALF_GAUGE_M) <= RAIL_PAIR_TOLERANCE)
    shift = (
        F.when(pair, (l + r) / 2)
        .when(l.isNotNull(), l - RAIL_HALF_GAUGE_M)
        .otherwise(r + RAIL_HALF_GAUGE_M)
    )
    return (
        medians.groupBy(*keys, "slice").agg(side("left").alias("l"), side("right").alias("r"))
        .filter((l.isNotNull() | r.isNotNull()) & fits)
        .select(*keys, "slice", shift.alias("shift"),
                F.when(pair, 1.0).otherwise(0.5).alias("weight"))
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), 0)


def _fit(sums: Column) -> Column:
    """(c1, c2) of y = c1 x + c2 x^2 from running sums; null with fewer than three places or where singular."""
    det = sums["s2"] * sums["s4"] - sums["s3"] * sums["s3"]
    return F.when((sums["n"] >= 3) & (F.abs(det) >= 1e-9), F.struct(
        ((sums["t1"] * sums["s4"] - sums["t2"] * sums["s3"]) / det).alias("c1"),
        ((sums["s2"] * sums["t2"] - sums["s3"] * sums["t1"]) / det).alias("c2")))


_SUMS = ("s2", "s3", "s4", "t1", "t2")


def _added(sums: Column, x: Column, s: Column) -> list[Column]:
    more = (x * x, x * x * x, x * x * x * x, x * s, x * x * s)
    return [(sums["n"] + 1).alias("n"), *[(sums[k] + v).alias(k) for k, v in zip(_SUMS, more, strict=True)]]


def _none() -> list[Column]:
    return [F.lit(0).alias("n"), *[F.lit(0.0).alias(k) for k in _SUMS]]


def _sides(ys: Column, centre: Column) -> Column:
    """Nearest wall return left and right of a centre, within the limits of the wall zone."""
    return F.struct(
        F.array_min(F.filter(ys, lambda y: y.between(centre + WALL_MIN_M, centre + WALL_MAX_M))).alias("left"),
        F.array_max(F.filter(ys, lambda y: y.between(centre - WALL_MAX_M, centre - WALL_MIN_M))).alias("right"))


@dataclass(frozen=True)
class Slices:
    """How walls are followed: length of a slice, slices near the sensor whose walls are the reference, how many of
    them have to be known and which middle one counts, and places after which the fit is used."""

    width_m: float
    near: int
    least: int
    upper: bool
    fit_from: int


DETECTOR, INDEPENDENT = Slices(1.0, NEAR_SLICES, 3, True, 5), Slices(2.0, 3, 2, False, 4)


def _followed(rows: DataFrame, walls: str, bins: int, how: Slices) -> DataFrame:
    """Adds ``_acc``: running sums, fit and shifts of the places where a wall was found."""
    def reference(side: str) -> Column:
        known = F.array_sort(F.array_compact(F.transform("_near", lambda w: w[side])))
        n = F.size(known)
        low = F.get(known, F.floor((n if how.upper else n - 1) / 2).cast("int"))
        return F.when(n >= how.least, (low + F.get(known, F.floor(n / 2).cast("int"))) / 2)

    def step(acc: Column, w: Column) -> Column:
        x = w["slice"] * how.width_m + F.lit(WALL_MIN_X + how.width_m / 2)

        def kept(found: Column) -> Column:
            shift = F.aggregate(found, F.lit(0.0), lambda a, v: a + v) / F.size(found)

            def grown(place: Column) -> Column:
                sums = F.struct(*_added(acc["sums"], place["x"], place["shift"]))
                refit = F.when(acc["sums"]["n"] >= how.fit_from - 1, _fit(sums))
                return F.struct(sums.alias("sums"), F.coalesce(refit, acc["fit"]).alias("fit"),
                                F.concat(acc["shifts"], F.array(place)).alias("shifts"))

            return F.when(F.size(found) > 0, _let(F.struct(x.alias("x"), shift.alias("shift")), grown)).otherwise(acc)

        def gated(centre: Column) -> Column:
            def near(sides: Column) -> Column:
                def moved(side: str) -> Column:
                    at = sides[side] - F.col(f"_{side}0")
                    return F.when(F.abs(at - centre) <= 0.3 + 0.01 * x, at)

                return F.array_compact(F.array(moved("left"), moved("right")))

            return _let(_let(_sides(w["ys"], centre), near), kept)

        return _let(acc["fit"]["c1"] * x + acc["fit"]["c2"] * x * x, gated)

    begin = F.struct(
        F.struct(*_none()).alias("sums"), F.struct(F.lit(0.0).alias("c1"), F.lit(0.0).alias("c2")).alias("fit"),
        F.array().cast("array<struct<x:double,shift:double>>").alias("shifts"))
    slices = F.array_sort(F.filter(walls, lambda w: w["slice"] < bins))
    df = rows.withColumn("_slices", F.transform(slices, lambda w: F.struct(
        w["slice"].cast("int").alias("slice"), F.transform(w["ys"], lambda y: y.cast("double")).alias("ys"))))
    df = df.withColumn("_near", F.transform(
        F.filter("_slices", lambda w: w["slice"] < how.near), lambda w: _sides(w["ys"], F.lit(0.0))))
    df = df.withColumns({"_left0": reference("left"), "_right0": reference("right")})
    return df.withColumn("_acc", F.aggregate("_slices", begin, step)).drop("_slices", "_near", "_left0", "_right0")


def independent_route(rows: DataFrame, walls: str) -> DataFrame:
    """Adds ``c1`` and ``c2`` of the route that the walls show, apart from the detector's own: 2 m slices up to
    121 m, plain medians of the first three as reference, every place in the fit; null where too few are seen."""
    df = _followed(rows, walls, 59, INDEPENDENT)
    enough = (F.col("_acc.sums.n") >= 6) & (F.element_at("_acc.shifts", -1)["x"] >= 20)
    return df.withColumns({c: F.when(enough, F.col(f"_acc.fit.{c}")) for c in ("c1", "c2")}).drop("_acc")


def follow_walls(rows: DataFrame, walls: str, config: DetectorConfig) -> DataFrame:
    """Adds ``raw``, the route of each frame, from ``walls``: ``array<struct<slice, ys>>``, the distinct lateral
    places of its wall returns per metre.

    Slices are followed outwards around the running fit: a wall counts only near where the fit so far expects it,
    so a wall that is lost is passed over until it comes back. What a slice does depends on all before it; it is
    an aggregate over the at most 150 slices of a frame, in the JVM.
    """
    max_x = min(config.detection_roi.high[0], 150.0)
    limit = 1.0 / (2.0 * config.route_min_radius_m)
    if not (config.route_estimation and max_x > WALL_NEAR_MAX_X):
        return rows.withColumn("raw", _no_route())
    df = _followed(rows, walls, math.ceil(max_x - WALL_MIN_X), DETECTOR)
    # The worst tenth of the places is left out of the last fit.
    df = df.withColumn("_fit", F.coalesce(_fit(F.col("_acc.sums")), F.col("_acc.fit")))
    df = df.withColumn("_places", F.transform("_acc.shifts", lambda p: F.struct(
        p["x"].alias("x"), p["shift"].alias("shift"),
        F.abs(p["shift"] - (F.col("_fit.c1") * p["x"] + F.col("_fit.c2") * p["x"] * p["x"])).alias("off"))))
    worst = F.get(F.array_sort(F.transform("_places", lambda p: p["off"])), F.floor(F.size("_places") * 9 / 10).cast("int"))
    df = df.withColumn("_worst", worst).withColumn("_places", F.filter("_places", lambda p: p["off"] <= F.col("_worst")))
    df = df.withColumn("_last", _fit(F.aggregate("_places", F.struct(*_none()), lambda a, p: F.struct(*_added(a, p["x"], p["shift"])))))
    enough = (F.col("_acc.sums.n") >= 10) & (F.element_at("_acc.shifts", -1)["x"] >= 20)
    good = enough & (F.abs("_last.c1") <= 0.05) & (F.abs("_last.c2") <= limit)
    shifts = F.transform("_places", lambda p: F.struct(p["x"].alias("x"), p["shift"].alias("shift")))
    found = F.struct(
        F.lit(0.0).alias("c0"), F.col("_last.c1").alias("c1"), F.col("_last.c2").alias("c2"), F.lit(True).alias("valid"),
        (F.element_at("_places", -1)["x"] + 0.5).alias("max_x"), shifts.alias("shifts"))
    return df.withColumn("raw", F.when(F.coalesce(good, F.lit(False)), found).otherwise(_no_route())).drop(
        "_acc", "_fit", "_places", "_worst", "_last")


def _no_route() -> Column:
    return F.struct(
        *[F.lit(0.0).alias(c) for c in ("c0", "c1", "c2")], F.lit(False).alias("valid"), F.lit(0.0).alias("max_x"),
        F.array().cast("array<struct<x:double,shift:double>>").alias("shifts"))


REFIT = T.StructType([
    *[T.StructField(c, T.DoubleType()) for c in ("c0", "c1", "c2")],
    T.StructField("rail_slices", T.IntegerType()),
])


@F.pandas_udf(REFIT)
def refit_with_rails(
    route: pd.DataFrame, rails: pd.Series, weight: pd.Series, min_radius: pd.Series
) -> pd.DataFrame:
    """Weighted refit of one route to rail centres and wall shifts (3 x 3 normal equations)."""
    out = []
    xn = (WALL_MIN_X + WALL_NEAR_MAX_X) / 2
    for i in range(len(route)):
        r, rail = route.iloc[i], rails.iloc[i]
        kept = {"c0": r["c0"], "c1": r["c1"], "c2": r["c2"], "rail_slices": 0}
        if not r["valid"] or rail is None or len(rail) < RAIL_MIN_SLICES:
            out.append(kept)
            continue
        rows, target, w = [], [], []
        for item in rail:
            x = RAIL_MIN_X + (item["slice"] + 0.5) * RAIL_BIN_M
            rows.append((1.0, x, x * x))
            target.append(r["c0"] + r["c1"] * x + r["c2"] * x * x + item["shift"])
            w.append(item["weight"] * weight.iloc[i])
        for item in r["shifts"]:
            x = item["x"]
            rows.append((0.0, x - xn, x * x - xn * xn))
            target.append(item["shift"])
            w.append(1.0)
        a, b, w = np.asarray(rows), np.asarray(target), np.asarray(w)
        normal = (a * w[:, None]).T @ a
        try:
            c0, c1, c2 = np.linalg.solve(normal, (a * w[:, None]).T @ b)
        except np.linalg.LinAlgError:
            out.append(kept)
            continue
        ok = (
            np.isfinite([c0, c1, c2]).all() and abs(c0) <= 0.5 and abs(c1) <= 0.05
            and abs(c2) <= 1.0 / (2.0 * min_radius.iloc[i])
        )
        out.append({"c0": c0, "c1": c1, "c2": c2, "rail_slices": len(rail)} if ok else kept)
    return pd.DataFrame(out)


def corridor_segments(
    end_x: Column, route: Column, plane: tuple[Column, Column, Column], start: float,
    width: float, height: float, inliers: Column, coverage_end: Column,
) -> Column:
    """Chain of 5 m segments along a valid route, else one straight segment."""
    a, b, c = plane
    step = F.when(route["valid"], F.lit(5.0)).otherwise(end_x - start)
    count = F.ceil((end_x - 1e-6 - start) / step)

    def point(x):
        y = g.route_center(x, (route["c0"], route["c1"], route["c2"]))
        return F.struct(x.alias("x"), y.alias("y"), (a * x + b * y + c).alias("z"))

    def segment(i):
        x0 = F.lit(start) + i * step
        x1 = F.least(end_x, x0 + step)
        return F.struct(
            point(x0).alias("start"), point(x1).alias("end"), F.lit(width).alias("width_m"),
            F.lit(height).alias("height_m"), g.published_plane(a, b, c).alias("ground_plane"),
            inliers.cast("int").alias("ground_inliers"), F.lit(True).alias("geometry_valid"),
            (x1 <= coverage_end + 1e-6).alias("coverage_valid"),
        )

    return F.transform(F.sequence(F.lit(0), (F.greatest(count, F.lit(1)) - 1).cast("int")), segment)


def route_margin(x: Column, route: Column, raw: Column, config: DetectorConfig) -> Column:
    """How far the route may be off laterally at ``x``."""
    if config.route_margin_per_m <= 0:
        return F.lit(0.0)
    smooth = g.route_center(x, (route["c0"], route["c1"], route["c2"]))
    plain = g.route_center(x, (raw["c0"], raw["c1"], raw["c2"]))
    jitter = F.when(raw["valid"], F.abs(plain - smooth)).otherwise(0.0)
    grown = F.least(
        F.lit(config.route_margin_max_m), config.route_margin_per_m * F.greatest(F.lit(0.0), x)
    )
    return F.when(route["valid"], grown + jitter).otherwise(0.0)
