"""Speed errors: slopes without interpreted lambdas, errors made once, the same rows with any cut."""

import statistics

import pytest
from pyspark.sql import functions as F

from pathclear.functions.ordering import SlicedOrder
from pathclear.operators import scoring as sc


@pytest.fixture(scope="module")
def rows(spark):
    # Stamps repeat, and distances are missing in runs.
    return spark.range(200).select(
        (F.col("id") % 2).alias("bag"), F.col("id").alias("n"), F.expr("id div 4").alias("t"),
        F.expr("CASE WHEN id % 11 <> 5 AND id NOT BETWEEN 90 AND 97 THEN CAST(pmod(id * id * 7, 41) AS DOUBLE) END").alias("d"),
        (F.col("id") % 5 != 0).alias("ego_motion_valid"), (F.col("id") % 7).cast("double").alias("ego_speed_mps"),
    )


def slopes(rows):
    out = {}
    for bag in (0, 1):
        line = sorted((r for r in rows if r["bag"] == bag), key=lambda r: (r["t"], r["n"]))
        for i, row in enumerate(line):
            near = [r for r in line[max(0, i - 3) : i + 4] if r["d"] is not None]
            found = [(b["d"] - a["d"]) / (b["t"] - a["t"]) for a in near for b in near if b["t"] > a["t"]]
            if row["d"] is not None and len(near) >= 6 and found:
                out[row["n"]] = -statistics.median(found)
    return out


@pytest.mark.parametrize("cuts", [[], [25], list(range(1, 50))])
def test_slopes_do_not_depend_on_the_cut(rows, cuts):
    order = SlicedOrder(["bag"], ["t", "n"], cuts)
    found = sc.theil_sen(rows, order, F.col("t").cast("double"), F.col("d"))
    assert {r["n"]: r["approach_mps"] for r in found.collect()} == slopes(rows.collect())


def test_errors_are_made_once(rows, capsys):
    order = SlicedOrder(["bag"], ["t", "n"], [])
    slow = sc.theil_sen(rows, order, F.col("t").cast("double"), F.col("d"))
    made = rows.sparkSession.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    sc.speed_error(slow.withColumn("ego_speed_mps", counted("ego_speed_mps")), ["bag"], [1.0]).collect()
    valid = slow.filter("ego_motion_valid").count()
    assert valid <= made.value <= slow.count()
    slow.explain()
    assert "lambdafunction((" not in capsys.readouterr().out


def test_ranks_of_the_errors(rows):
    known = rows.withColumn("approach_mps", F.col("n") / 16.0)
    found = {r["bag"]: r for r in sc.speed_error(known, ["bag"], [2.0, 4.0]).collect()}
    for bag in (0, 1):
        mine = [r for r in known.collect() if r["bag"] == bag]
        errors = sorted(abs(r["ego_speed_mps"] - r["approach_mps"]) for r in mine if r["ego_motion_valid"])
        assert found[bag]["median_mps"] == statistics.median(errors)
        assert found[bag]["p95_mps"] == errors[int(0.95 * (len(errors) - 1))]
        assert (found[bag]["reference_frames"], found[bag]["max_mps"]) == (len(mine), errors[-1])
