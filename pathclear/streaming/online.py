"""Online analysis of arriving clouds in micro-batches.

Every trigger analyses what arrived, with as much of each session's past as the detector can look
back on, and writes the new frames' analyses.  A session is analysed from the start of its current
chain (the last place where the detector starts afresh), read from the table of clouds seen so far,
so the result equals the batch result; no state lives outside tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathclear.config import DetectorConfig
from pathclear.plans.detector import analyse
from pathclear.schemas import FRAME_KEY


def analyse_stream(
    clouds: DataFrame, config: DetectorConfig, seen_path: str, out_path: str, checkpoint: str
):
    """Starts the query; ``clouds`` is a stream of ``FRAME_INPUT`` rows."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        # Overwriting this trigger's own folder makes a repeated trigger harmless.
        rows.withColumn("source_part", F.col("source")).write.mode("overwrite").partitionBy(
            "source_part"
        ).parquet(f"{seen_path}/trigger={number}")
        fresh = spark.read.parquet(f"{seen_path}/trigger={number}").select(*FRAME_KEY)
        touched = fresh.select("source", "session").distinct()
        past = spark.read.option("basePath", seen_path).parquet(seen_path).filter(
            F.col("trigger") <= number
        ).drop("trigger", "source_part")
        known = past.join(touched, ["source", "session"], "left_semi").dropDuplicates(FRAME_KEY)
        found = analyse(known, config).join(fresh, FRAME_KEY, "left_semi")
        found.write.mode("overwrite").parquet(f"{out_path}/trigger={number}")

    return clouds.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
