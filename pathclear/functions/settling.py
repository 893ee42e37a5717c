"""Intermediate tables that cut lineage and survive lost executors.

They are written once to a folder that all executors share and read back, so a later stage scans
only the columns it needs and the planner knows their real size: small ones are broadcast under the
session's threshold, large ones are joined by shuffle or by bucket. The folder is the one named by
``spark.checkpoint.dir``; where that is unset, one below the session's warehouse, which is shared
as well. Files go when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that the driver and all executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_settled"


def _fresh(spark: SparkSession) -> tuple[str, str]:
    name = f"settled_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark).rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name, folder


def settle(df: DataFrame) -> DataFrame:
    """The same rows as a written table."""
    spark = df.sparkSession
    _, path = _fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows as a table bucketed by ``keys``: later groups and joins on them move nothing.

    One task writes one bucket, so there are as many files as shuffle partitions; like any shuffle of the
    session it is sized by that setting.
    """
    spark = df.sparkSession
    name, path = _fresh(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
        .option("path", path).saveAsTable(name)
    )
    return spark.table(name)
