"""Rules that refuse: components by every rejection rule, and runs whose rows are no results."""

from pathlib import Path

import pytest

from pathclear.plans.report import runtime_report
from pathclear.plans.scoring import summary_of_run
from pathclear.queries import neighbour_queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables are not here")
def test_every_rule_decides(spark):
    counts = {r["reason"]: r["count"] for r in neighbour_queries.rejection_rules(spark, SF_DIR).groupBy("reason").count().collect()}
    assert len(counts) == 13 and None in counts and min(counts.values()) > 100


def test_runs_without_results_are_refused(spark):
    def run(*rows):
        return spark.createDataFrame(rows, "bag_id string, state string, processing_ms double")

    good = [("a", "OBSTACLE", 10.0), ("a", "UNKNOWN", 30.0), ("b", "NO_OBSTACLE_DETECTED", None)]
    found = summary_of_run(run(*good))
    assert (found["frames"], found["obstacle"], found["unknown"], found["p50"], found["bad_states"]) == (3, 1, 1, 20.0, 0)
    assert any("33.3 %" in line for line in runtime_report(found))
    untimed = summary_of_run(run(("a", "UNKNOWN", None)))
    assert untimed["frames"] == 1 and untimed["p95"] is None and untimed["unknown_fraction"] == 1.0
    for bad in (("a", "CLEAR", 1.0), ("a", None, 1.0), ("a", "UNKNOWN", -1.0), ("a", "UNKNOWN", float("nan")), ("a", "UNKNOWN", float("inf"))):
        with pytest.raises(Exception, match="no result row"):
            summary_of_run(run(*good, bad))
    with pytest.raises(ValueError, match="without frames"):
        summary_of_run(run(*good).limit(0))
