"""The detector over tunnel scenes of the given tables finds what is in them."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pathclear.queries import stateful_queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables are not here")
def test_routes_candidates_and_held_frames(spark):
    rounds = []
    rows = {r["frame_sequence"]: r for r in stateful_queries.tunnel_analysis(spark, SF_DIR, rounds).collect()}
    reasons = Counter(r["reason"] for r in rows.values())
    assert reasons["CANDIDATES_FOUND"] > 5 and reasons["GROUND_UNSUPPORTED"] > 1
    assert reasons["NO_CANDIDATE_IN_EVALUATED_REGION"] > 5
    assert all(r["route"]["valid"] for r in rows.values())
    # A box stands in one frame of three, 16 to 20 m ahead; held frames with one show it too.
    judged = {n: r for n, r in rows.items() if r["reason"] != "BASELINE_WARMUP"}
    assert all((len(r["candidates"]) > 0) == (n % 3 == 1) for n, r in judged.items())
    assert all(abs(r["candidates"][0]["distance_m"] - 16 - n % 5) < 0.2 for n, r in judged.items() if n % 3 == 1)
    assert all(r["reason"] == "GROUND_UNSUPPORTED" for n, r in judged.items() if n % 7 == 5 and n % 3 != 1)
    assert len(rounds) >= 2 and rounds == sorted(rounds, reverse=True) and rounds[-1] < rounds[0]


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables are not here")
def test_clouds_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    plain = stateful_queries.tunnel_points
    few = lambda spark, sf_dir: plain(spark, sf_dir).filter("frame_seq < 5")
    monkeypatch.setattr(stateful_queries, "tunnel_points", lambda *at: few(*at).withColumn("x", counted("x")))
    stateful_queries.tunnel_analysis(spark, SF_DIR).count()
    assert made.value == few(spark, SF_DIR).count()
