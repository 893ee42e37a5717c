"""The stream gives the batch decisions; the watchdog turns an old result into UNKNOWN."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathclear.config import DetectorConfig, TemporalConfig
from pathclear.operators.sequences import latest_only
from pathclear.operators.tracking import decide
from pathclear.plans.detector import analyse
from pathclear.queries.stateful_queries import HOURLY, analyses
from pathclear.streaming.monitor import fresh_latest, stream_decisions
from pathclear.streaming.online import analyse_stream
from tests import scenes as s

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def start(spark, folder, timeout_s, **trigger):
    stream = spark.readStream.schema(spark.read.parquet(str(folder / "in")).schema).option(
        "maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    found = stream_decisions(stream, HOURLY, timeout_s)
    return found.writeStream.format("memory").queryName(folder.name.replace("-", "_")).outputMode("append").option(
        "checkpointLocation", str(folder / "check")).trigger(**trigger).start()


def test_stream_equals_batch_and_gate_drops_repeats(rocks, tmp_path):
    spark = rocks
    rows = analyses(spark, SF).filter("source IN ('bag 0', 'bag 1')").withColumns({
        "line": F.col("source"), "received": F.col("frame_sequence"), "processing_age_ms": F.lit(5.0)})
    cut = [0, 300, 301, 700, 2000]
    for low, high in zip(cut, cut[1:]):
        rows.filter((F.col("received") >= low) & (F.col("received") < high)).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        time.sleep(1.1)
    late = rows.filter("received = 8 OR received = 16").withColumn("received", F.lit(5000).cast("long"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = start(spark, tmp_path, 10_000.0, availableNow=True)
    query.awaitTermination(240)
    names = ["source", "frame_sequence", "state", "reason", "distance_m", "calibration_trust"]
    streamed = spark.table(query.name)
    batch = decide(rows, HOURLY)
    key = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert key(streamed.filter("NOT stale")) == key(batch)
    assert {r[0] for r in streamed.select("gate_reason").distinct().collect()} == {"FIRST_SOURCE", "IN_ORDER"}
    tracks = lambda df: {(r["source"], r["frame_sequence"]): [(t["id"], t["hits"], t["confirmed"]) for t in r["tracks"]]
                         for r in df.collect()}
    assert tracks(streamed.filter("NOT stale")) == tracks(batch)


def test_watchdog(rocks, tmp_path):
    spark = rocks
    rows = analyses(spark, SF).filter("source = 'bag 2'").limit(3).withColumns({
        "line": F.col("source"), "received": F.col("frame_sequence"), "processing_age_ms": F.lit(5.0)})
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = start(spark, tmp_path, 1.0, processingTime="1 second")
    end = time.time() + 90
    while time.time() < end and not spark.table(query.name).filter("stale").count():
        time.sleep(1)
    query.stop()
    stale = spark.table(query.name).filter("stale").first()
    assert (stale["state"], stale["reason"]) == ("UNKNOWN", "INPUT_PAUSED_OR_STOPPED")
    assert not stale["tracks"] and stale["frame_sequence"] is not None


def test_latest_only_slot(spark):
    rows = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 3, 20.0), ("a", 2, 5.0), ("b", 9, 400.0), ("b", 8, 10.0)],
        "source string, received long, age_ms double")
    found = {r["source"]: (r["received"], r["dropped"]) for r in fresh_latest(rows, 300.0).collect()}
    assert found == {"a": (3, 2)}  # b's newest is too old when the slot is taken
    keyed = rows.withColumn("event_id", F.col("received"))
    batch = {r["source"]: (r["event_id"], r["dropped"]) for r in latest_only(
        keyed, ["source"], "received", "age_ms", 300.0).filter("fresh").collect()}
    assert batch == found


def test_online_analysis_equals_batch(spark, tmp_path):
    frames = [s.frame("line", i + 1, s.flat_scene(i == 4), 1_000_000_000 + i * 100_000_000) for i in range(5)]
    config = DetectorConfig(
        background_history_frames=2, background_lag_frames=1, ego_motion_compensation=False, route_estimation=False)
    table = s.table(spark, frames)
    for low, high in ((0, 3), (3, 9)):
        table.filter((F.col("frame_sequence") > low) & (F.col("frame_sequence") <= high)).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = analyse_stream(
        stream, config, str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "check")
    ).trigger(availableNow=True).start()
    query.awaitTermination(400)
    pick = lambda df: sorted((r["frame_sequence"], r["reason"], len(r["candidates"])) for r in df.collect())
    online = pick(spark.read.parquet(str(tmp_path / "out")))
    assert online == pick(analyse(table, config))
    assert online[-1] == (5, "CANDIDATES_FOUND", 1)
