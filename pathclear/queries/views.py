"""Frames, points and profiles derived from the shared tables, in Spark and in SQL.

Frames of points grow in number with the data (400 orders make one frame); all coordinates are
dyadic, so sums and products of them are exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathclear.functions.ordering import SlicedOrder

POINTS_SQL = """
points AS (
  SELECT l_orderkey // 400 AS frame_seq,
         (((l_orderkey % 400) * 8 + l_linenumber) * 134217728 + l_partkey) * 16777216
           + CAST(round(l_extendedprice * 100) AS BIGINT) AS raw_index,
         2 * l_quantity + l_linenumber * 0.25e0 AS x,
         (round(l_discount * 100) - 5) * 0.5e0 AS y,
         round(l_tax * 100) * 0.5e0 - 2 AS z,
         l_extendedprice AS intensity,
         l_linenumber AS ring,
         l_returnflag AS flag
  FROM lineitem
)"""

FRAMES_SQL = """
frames AS (
  SELECT user_id % 8 AS bag_id, event_id, epoch_us(ts) AS stamp_us,
         CASE event_type WHEN 'error' THEN 'OBSTACLE' WHEN 'view' THEN 'NO_OBSTACLE_DETECTED'
              WHEN 'click' THEN 'NO_OBSTACLE_DETECTED' ELSE 'UNKNOWN' END AS state,
         value AS distance_m, event_type AS reason,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
)"""

PROFILES_SQL = """
profiles AS (
  SELECT vec_id AS frame_no, u.bin AS bin, CAST(embedding[u.bin + 1] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(0, 64)) AS bin) u
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    place = ((F.col("l_orderkey") % 400) * 8 + F.col("l_linenumber")) * 134217728
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.expr("l_orderkey div 400").alias("frame_seq"),
        # Line numbers repeat in an order, part and price tell its lines apart: 12, 27 and 24 bits, an
        # error beyond (in both engines' checked arithmetic), never a wrapped number.
        ((place + F.col("l_partkey")) * 16777216 + cents).alias("raw_index"),
        (2 * F.col("l_quantity") + F.col("l_linenumber") * 0.25).alias("x"),
        ((F.round(F.col("l_discount") * 100) - 5) * 0.5).alias("y"),
        (F.round(F.col("l_tax") * 100) * 0.5 - 2).alias("z"),
        F.col("l_extendedprice").alias("intensity"),
        F.col("l_linenumber").alias("ring"),
        F.col("l_returnflag").alias("flag"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = (
        F.when(kind == "error", "OBSTACLE")
        .when(kind.isin("view", "click"), "NO_OBSTACLE_DETECTED")
        .otherwise("UNKNOWN")
    )
    # The table's stamps carry no zone and are UTC, whatever the session's zone is.
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 8).alias("bag_id"),
        "event_id",
        F.unix_micros(instant.cast("timestamp")).alias("stamp_us"),
        state.alias("state"),
        F.col("value").alias("distance_m"),
        kind.alias("reason"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def frames_order(spark: SparkSession, sf_dir: str) -> SlicedOrder:
    """Slices of the frames by time, measured on the data as they are now."""
    stamps = frames(spark, sf_dir).select("bag_id", "stamp_us", "event_id")
    return SlicedOrder.fit(stamps, ["bag_id"], ["stamp_us", "event_id"])


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(
        F.col("vec_id").alias("frame_no"), F.posexplode("embedding").alias("bin", "value")
    ).withColumn("value", F.col("value").cast("double"))
