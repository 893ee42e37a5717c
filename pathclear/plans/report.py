"""Markdown reports: every line is made by Spark, sorted there, and streamed to its file.

A section is a table of a DataFrame's rows. What was not measured is a dash. The number of recordings, events
or bins does not matter: no section is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE = (
    "Alarms are compared with labels frame by frame, so a hit may belong to another object in view. "
    "A dash stands for what was not measured."
)


def number(value, decimals: int = 2) -> Column:
    return F.format_number(F.col(value) if isinstance(value, str) else value, decimals)


def share(value) -> Column:
    return F.concat(number(100 * (F.col(value) if isinstance(value, str) else value), 1), F.lit(" %"))


def section(place: int, title: str, rows: DataFrame, cells: Mapping[str, Column], by: list[Column]) -> DataFrame:
    """Lines of one table: ``place, part, k1, k2, line``; ``by`` sorts its rows (a text, then a number)."""
    k1, k2 = [*by, F.lit(None), F.lit(None)][:2]
    shown = [F.coalesce(c.cast("string"), F.lit("-")) for c in cells.values()]
    body = rows.select(
        F.lit(place).alias("place"), F.lit(1).alias("part"), k1.cast("string").alias("k1"), k2.cast("double").alias("k2"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"),
    )
    head = f"\n## {title}\n\n| {' | '.join(cells)} |\n|{':--|' * len(cells)}"
    top = rows.sparkSession.range(1).select(
        F.lit(place).alias("place"), F.lit(0).alias("part"), F.lit(None).cast("string").alias("k1"),
        F.lit(None).cast("double").alias("k2"), F.lit(head).alias("line"))
    return top.unionByName(body)


def quality_report(tables: Mapping[str, DataFrame], totals: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Lines of the report of a scored run, in order (one column ``line``)."""
    c = F.col
    last = F.when(c("split") == "total", F.lit("~")).otherwise(c("split"))
    parts = [
        section(1, "Splits: frames", totals, {
            "split": c("split"), "with object": c("positive_frames"), "free": c("negative_frames"), "unclear": c("uncertain_frames"),
            "alarms on objects": c("tp"), "missed": c("fn"), "of these undecided": c("unknown_on_positive"),
            "alarms on free track": c("fp"), "found": share("frame_recall"), "right alarms": share("frame_precision"),
            "free frames alarmed": share("false_alarm_rate"),
        }, [last]),
        section(2, "Splits: events and objects", totals, {
            "split": c("split"), "events": c("positive_events"), "events with an alarm": c("detected_events"),
            "false events a minute": number("fp_events_per_min"), "object references": c("object_reference_frames"),
            "objects hit": c("object_hits"),
        }, [last]),
        section(4, "Recordings", tables["frame"].select("bag_id", "tp", "fn", "fp", "negative_frames").join(
            tables["summary"].select("bag_id", "frames", "p95"), "bag_id", "left").join(
            tables["coverage_scored"].select("bag_id", "observed", "median_evaluated_range_m"), "bag_id", "left"), {
            "recording": c("bag_id"), "frames": c("frames"), "hit": c("tp"), "missed": c("fn"), "false": c("fp"),
            "free": c("negative_frames"), "decided": share("observed"), "range looked at (median, m)": number("median_evaluated_range_m", 1),
            "ms (p95)": number("p95", 1),
        }, [c("bag_id")]),
        section(5, "Events", tables["events"], {
            "recording": c("bag_id"), "event": c("id"), "alarmed": c("detected"), "frames with alarm": c("obstacle_frames"),
            "frames": c("frames"), "first alarm after (s)": number("first_alarm_delay_s"), "at (m)": number("first_alarm_distance_m"),
            "own object seen": c("object_confirmed"), "first at (m)": number("first_matched_distance_m"),
        }, [F.concat_ws("/", "bag_id", "id")]),
        section(6, "Objects by distance", tables["by_distance"], {
            "recording": c("bag_id"), "from (m)": c("from_m"), "references": c("frames"), "alarmed": c("obstacle"),
            "hit": c("hits"), "hit share": share("recall"),
        }, [c("bag_id"), c("from_m")]),
        section(7, "Objects that must raise no alarm", tables["negative_objects"], {
            "recording": c("bag_id"), "references": c("reference_frames"), "with an alarm on it": c("alarm_frames"),
        }, [c("bag_id")]),
    ]
    if ranges is not None:
        parts.append(section(3, "Splits: within the working range", ranges, {
            "split": c("split"), "ranges (m)": F.concat_ws(", ", F.transform("ranges_m", lambda r: number(r, 0))),
            "references": c("reference_frames"), "farther away": c("beyond_frames"), "alarmed": c("obstacle"), "hit": c("hits"),
            "alarmed share": share("state_recall"), "hit share": share("object_recall"),
        }, [last]))
    title = totals.sparkSession.range(1).select(
        F.lit(0).alias("place"), F.lit(0).alias("part"), F.lit(None).cast("string").alias("k1"),
        F.lit(None).cast("double").alias("k2"), F.lit(f"# Quality of a run\n\n{NOTE}").alias("line"))
    return reduce(DataFrame.unionByName, parts, title).orderBy("place", "part", "k1", "k2").select("line")


def runtime_report(summary: Mapping) -> list[str]:
    """Lines for a run without labels."""
    lines = ["# Times of a run", "", f"{summary['frames']} frames, quality not scored.", ""]
    unknown = summary["unknown_fraction"]
    lines.append(f"- undecided: {'-' if unknown is None else f'{100 * unknown:.1f} %'}")
    return lines + [f"- {p} (ms): {'-' if summary[p] is None else round(summary[p], 3)}" for p in ("p50", "p95", "p99")]


def write_new(lines: DataFrame, path: str) -> None:
    """Streams lines to a file of any store Spark can write; never replaces an earlier report."""
    spark = lines.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(where):
        raise FileExistsError(path)
    out = files.create(where, False)
    try:
        for row in lines.toLocalIterator():
            out.write(bytearray(row["line"] + "\n", "utf-8"))
    finally:
        out.close()
