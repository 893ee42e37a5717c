"""Content hashes of inputs and the state of every registered recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def compare_hashes(recorded: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """missing, unexpected, changed or same for every recorded or current item."""
    a = recorded.select(*keys, F.col("hash").alias("recorded_hash"))
    b = current.select(*keys, F.col("hash").alias("current_hash"))
    status = (
        F.when(F.col("current_hash").isNull(), "missing")
        .when(F.col("recorded_hash").isNull(), "unexpected")
        .when(F.col("recorded_hash") != F.col("current_hash"), "changed")
        .otherwise("same")
    )
    return a.join(b, keys, "full").select(*keys, status.alias("status"), "recorded_hash")


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """sha256 of whole files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", F.sha2("content", 256).alias("hash"))


def dataset_status(dataset, splits, results, keys: list[str]) -> DataFrame:
    """Registry rows with their split and why a recording is scored or not."""
    joined = dataset.join(splits, keys, "left").join(results, keys, "left")
    absent = F.col("exported").isNull()
    status = (
        F.when(~F.col("annotated"), "no annotations")
        .when(absent & ~F.col("selected"), "not selected")
        .when(absent, "no results")
        .otherwise("scored")
    )
    return joined.withColumns({
        "status": status, "split": F.coalesce(F.col("split"), F.lit("unassigned")),
    })


def run_issues(manifest: DataFrame, bags: DataFrame) -> DataFrame:
    """Reasons why a run cannot be reproduced, one row each.

    ``manifest`` is one row per run; ``bags`` one row per selected recording with ``declared``,
    ``exported``, ``status``, ``recorded_hash``, ``current_hash``, ``ordered``.
    """
    def issue(df, condition, message):
        return df.filter(condition).select("run_id", message.alias("issue"))

    whole = [
        (F.col("dirty").isNull() | F.col("dirty"), "source checkout was dirty"),
        (F.col("image_id").isNull() | (F.col("image_id") == "not_recorded"), "image id missing"),
        (F.col("commit").isNull(), "source commit missing"),
        (F.col("config_sha256").isNull() | (F.size("config_sha256") == 0), "config hashes missing"),
        (F.col("executable_sha256").isNull() | (F.size("executable_sha256") == 0),
         "executable hashes missing"),
    ]
    each = [
        (F.col("status") != "exported", F.lit("bag export incomplete")),
        (F.col("exported").isNull(), F.concat(F.lit("selected bag has no results: "), "bag_id")),
        (F.col("exported") != F.col("declared"), F.concat(F.lit("incomplete frame export: "), "bag_id")),
        (~F.col("recorded_hash").eqNullSafe(F.col("current_hash")) & F.col("exported").isNotNull(),
         F.concat(F.lit("result hash missing or changed: "), "bag_id")),
        (~F.col("ordered"), F.concat(F.lit("duplicate or unordered frames: "), "bag_id")),
    ]
    out = None
    for condition, message in whole:
        part = issue(manifest, condition, F.lit(message))
        out = part if out is None else out.unionByName(part)
    for condition, message in each:
        out = out.unionByName(issue(bags, condition, message))
    return out.distinct()


def working_range(bags: DataFrame, profiles: DataFrame) -> DataFrame:
    """Range recorded at run time, else that of the profile while its hash still matches."""
    joined = bags.join(
        profiles.select("sensor_profile", F.col("hash").alias("now"), "profile_range_m"),
        "sensor_profile", "left",
    )
    unchanged = F.col("profile_hash") == F.col("now")
    value = F.when(F.col("has_range"), F.col("working_range_m")).when(unchanged, F.col("profile_range_m"))
    return joined.select("bag_id", value.alias("working_range_m"))
