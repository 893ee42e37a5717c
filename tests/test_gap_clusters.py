"""Clusters cut at gaps: tasks stay as large as they are when the table grows, and copies change no box."""

from pyspark.sql import functions as F

from pathclear.operators import inserted


def test_tasks_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(inserted.dealt, "__defaults__", (200,))
    cpus = spark.sparkContext.defaultParallelism
    for rows in (40 * cpus, 1000 * cpus):
        pts = spark.range(rows).select(
            F.expr("id div 20").alias("frame"), (F.col("id") % 20 * 2.0).alias("x"), F.lit(0.0).alias("y"),
            F.lit(1.0).alias("z"))
        found = inserted.gap_clusters(pts, ["frame"], 1.0, 1.0)
        sizes = [n for n in found.rdd.glom().map(len).collect() if n]
        assert sum(sizes) == rows and max(sizes) <= 400


def test_boxes_with_copies(spark):
    rows = [(1, 0.0, 0.0, 5.0), (1, 0.0, 0.0, 1.0), (1, 0.5, 3.0, 2.0), (1, 0.9, 3.5, 2.0), (1, 9.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "frame long, x double, y double, z double")
    found = {
        (r["frame"], r["min_x"], r["max_x"], r["min_y"], r["max_y"], r["min_z"], r["max_z"], r["n"])
        for r in inserted.gap_clusters(pts, ["frame"], 1.0, 1.0).collect()
    }
    assert found == {
        (1, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0, 2), (1, 0.5, 0.9, 3.0, 3.5, 2.0, 2.0, 2), (1, 9.0, 9.0, 0.0, 0.0, 0.0, 0.0, 1),
        (2, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1),
    }
