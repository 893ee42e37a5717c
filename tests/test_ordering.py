"""Sliced windows must equal plain windows wherever the slices are cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.ranks import (
    linear_percentiles, ninth_tenth, ninth_tenth_inclusive, rank_values, truncated, upper_median,
)

CUTS = [[], [50], [10, 20, 30, 40, 50, 60, 70, 80, 90], list(range(1, 100))]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"bag": rng.integers(0, 3, 240), "t": rng.integers(0, 100, 240), "n": range(240)})
    frame["v"] = np.where(rng.random(240) < 0.4, np.nan, np.round(rng.random(240) * 10, 1))
    return spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def values(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("cuts", CUTS)
def test_windows_do_not_depend_on_the_cut(rows, cuts):
    order = SlicedOrder(["bag"], ["t", "n"], cuts)
    w = Window.partitionBy("bag").orderBy("t", "n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    v = F.col("v")
    expected = rows.withColumns({
        "sum": F.sum(F.coalesce(v, F.lit(0.0))).over(upto), "last": F.last("v", True).over(upto),
        "next": F.first("v", True).over(after), "l1": F.lag("v").over(w), "l3": F.lag("v", 3).over(w),
        "a2": F.lead("v", 2).over(w),
    }).withColumn("sum", F.round("sum", 6))
    df = order.running_sum(rows, {"sum": F.coalesce(v, F.lit(0.0))})
    df = order.last_known(df, {"last": v})
    df = order.next_known(df, {"next": v}, inclusive=False)
    df = order.lag(df, "l1", v)
    df = order.lag(df, "l3", v, 3)
    df = order.lead(df, "a2", v, 2)
    found = order.finish(df).withColumn("sum", F.round("sum", 6))
    assert values(found) == values(expected)


@pytest.mark.parametrize("cuts", CUTS)
def test_rows_around_do_not_depend_on_the_cut(rows, cuts):
    order = SlicedOrder(["bag"], ["t", "n"], cuts)
    w = Window.partitionBy("bag").orderBy("t", "n")
    wrapped = F.struct(F.col("v").alias("v"))
    expected = rows.withColumns({f"p_{i}": F.lag(wrapped, -i).over(w) for i in (-3, -2, -1, 1, 2, 3)})
    found = order.finish(order.around(rows, "p", F.col("v"), 3))
    assert values(found) == values(expected)


@pytest.mark.parametrize("cuts", CUTS)
@pytest.mark.parametrize("gap", [0, 1, 3])
def test_islands_do_not_depend_on_the_cut(rows, cuts, gap):
    plain = SlicedOrder(["bag"], ["t"], [])
    order = SlicedOrder(["bag"], ["t"], cuts)
    some = rows.filter("n % 3 = 0")
    assert values(order.islands(some, gap, {"total": F.col("n")})) == values(
        plain.islands(some, gap, {"total": F.col("n")})
    )
    tagged = order.finish(order.tag_islands(some, gap))
    by_tag = tagged.groupBy("bag", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    assert values(by_tag) == values(plain.islands(some, gap).select("bag", "island", "start", "end"))


@pytest.mark.parametrize("cuts", [[2], [0], [1, 4], list(range(0, 60))])
def test_nulls_ties_and_missing_keys_do_not_depend_on_the_cut(spark, cuts):
    order_of = [None, None, 0, 1, 2, 3, 3, 4, 5, 59, 60]
    v = [5, None, None, None, None, 1, None, 1, 1, None, 2]
    rows = spark.createDataFrame(
        [(bag, t, n, None if bag == "b" and n < 6 else x) for bag in ("a", None, "b") for n, (t, x) in enumerate(zip(order_of, v, strict=True))],
        "bag string, t int, n int, v int",
    )
    results = []
    for bounds in ([], cuts):
        order = SlicedOrder(["bag"], ["t", "n"], bounds)
        df = order.running_sum(rows, {"s": F.col("v")}, {"s": "whole"})
        for name, step in (("k", order.last_known), ("x", order.next_known)):
            df = step(df, {name: F.col("v")})
            df = step(df, {f"{name}_strict": F.col("v")}, inclusive=False)
        df = order.running_max(order.running_max(df, {"m": F.col("v")}), {"m_strict": F.col("v")}, inclusive=False)
        df = order.lead(order.lag(df, "before", F.col("v"), 2), "after", F.col("v"))
        results.append(values(order.finish(order.tag_islands(df, 1))))
    assert results[0] == results[1]


def test_a_slice_is_the_number_of_edges_passed(spark):
    from pathclear.functions.ordering import _between

    edges = [float(v) for v in range(0, 300, 3)]
    rows = spark.createDataFrame([(None,), (-1.0,), *[(v / 2,) for v in range(0, 700, 7)]], "x double")
    for bounds in (edges[:1], edges[:7], edges[:65], edges):
        for r in rows.select("x", _between(F.col("x"), bounds).alias("s")).collect():
            assert r.s == (0 if r.x is None else sum(b <= r.x for b in bounds))


def test_measured_hot_group_is_cut_and_settled(rows):
    hot = SlicedOrder.fit(rows, ["bag"], ["t", "n"], group_rows=10, rows_per_slice=40)
    assert hot.hot and 2 <= len(hot.bounds) <= 6
    calm = SlicedOrder.fit(rows, ["bag"], ["t", "n"])
    assert not calm.bounds
    total = F.coalesce(F.col("v"), F.lit(0.0))
    a = hot.finish(hot.lag(hot.running_sum(rows, {"s": total}), "p", F.col("s")))
    b = calm.finish(calm.lag(calm.running_sum(rows, {"s": total}), "p", F.col("s")))
    rounded = [F.round(c, 6).alias(c) for c in ("s", "p")]
    assert values(a.select("n", *rounded)) == values(b.select("n", *rounded))


def test_rank_rules(spark):
    def ranks(numbers):
        df = spark.createDataFrame([(1, float(v)) for v in numbers], "g long, v double")
        row = rank_values(df, ["g"], "v", {
            "b": upper_median, "c": ninth_tenth_inclusive, "d": ninth_tenth, "e": truncated(0.95),
        }, [2.5]).first()
        mid = linear_percentiles(df, ["g"], "v", {"m": 0.5, "p": 0.95}, [2.5]).first()
        return row["b"], row["c"], row["d"], row["e"], mid["m"], round(mid["p"], 6)

    for numbers in ([1, 2, 3, 4], [5], [3, 1, 2], [2, 2, 2, 9, 9], list(range(20))):
        s, n = sorted(numbers), len(numbers)
        assert ranks(numbers) == (
            s[n // 2], s[9 * (n - 1) // 10], s[n * 9 // 10], s[int(0.95 * (n - 1))],
            float(np.median(s)), round(float(np.percentile(s, 95)), 6),
        )


def test_a_frame_meets_its_neighbour_without_carrying_it(spark):
    # Frames went on with their neighbour's columns beside their own; only questions need them.
    from pathclear.operators.scoring import object_checks
    from pathclear.operators.timeline import beside_in_time

    frames = spark.createDataFrame([(0, t, "OBSTACLE", float(t)) for t in (0, 10, 20)], "bag int, t long, state string, at double")
    refs = spark.createDataFrame([(0, 12, 5.0), (0, 3, 900.0)], "bag int, asked long, reference_m double").selectExpr(
        "*", "array(-100D, -1D, -1D) AS roi_min", "array(100D, 1D, 1D) AS roi_max")
    beside = beside_in_time(refs, frames, ["bag"], "asked", "t", [])
    assert {(r.asked, r.before.t, r.after.t) for r in beside.collect()} == {(12, 10, 20), (3, 0, 10)}

    def objects(frame):
        return F.array(F.struct(F.array(frame["at"], F.lit(0.0), F.lit(0.0)).alias("center"), frame["at"].alias("distance_m")))

    found = object_checks(refs, frames, ["bag"], "asked", "t", [], 100, objects=objects)
    assert {(r.asked, r.result, r.error_m) for r in found.collect()} == {(12, "hit", 5.0), (3, "hit", -900.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and "center" not in plan.split("Window")[-1]
