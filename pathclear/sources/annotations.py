"""Reviewed annotations, the dataset registry, splits and scene tables from YAML.

These documents are written by hand, one per recording; only their rows become tables.
"""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

INTERVALS = "bag_id string, start_ns long, end_ns long, label string, evidence string"
EVENTS = INTERVALS.replace("start_ns", "id string, start_ns") + ", envelope_class string"
REFERENCES = (
    "bag_id string, id string, label string, ref_stamp_ns long, reference_m double, "
    "uncertainty_m double, method string, returns long, roi_min array<double>, roi_max array<double>"
)
DATASET = (
    "bag_id string, path string, input_topic string, storage_id string, declared long, "
    "annotations string, sensor_profile string"
)
SPLIT_NAMES = ("development", "validation", "holdout", "regression")


class AnnotationError(ValueError):
    """The annotation cannot be used for scoring."""


def load_yaml(path: str):
    with open(path) as stream:
        return yaml.safe_load(stream) or {}


def _number(value):
    return None if value is None else float(value)


def annotation_rows(bag_id: str, document: dict) -> tuple[list, list, list]:
    """(intervals, events, references) of one reviewed annotation."""
    if not document.get("reviewed"):
        raise AnnotationError(f"{bag_id}: annotation is not reviewed")
    if document.get("time_basis") != "bag_stamp_ns":
        raise AnnotationError(f"{bag_id}: only bag_stamp_ns annotations are supported")
    intervals = [
        (bag_id, i["start_ns"], i["end_ns"], i["label"], i.get("evidence"))
        for i in document.get("reviewed_intervals") or []
    ]
    events, references = [], []
    for e in document.get("events") or []:
        events.append((bag_id, e["id"], e["start_ns"], e["end_ns"], e["label"], e.get("evidence"),
                       e.get("envelope_class")))
        for r in e.get("reference_frames") or []:
            roi = r.get("person_roi_assumed_m")
            if roi:
                references.append((
                    bag_id, e["id"], e["label"], r["bag_stamp_ns"], _number(r.get("distance_m")),
                    _number(r.get("uncertainty_m")), r.get("method"), r.get("returns"),
                    [float(v) for v in roi["min"]], [float(v) for v in roi["max"]],
                ))
    return intervals, events, references


def read_annotations(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of intervals, events and reference frames of all given recordings."""
    intervals, events, references = [], [], []
    for bag_id, path in paths.items():
        i, e, r = annotation_rows(bag_id, load_yaml(path))
        intervals += i
        events += e
        references += r
    return (
        spark.createDataFrame(intervals, INTERVALS), spark.createDataFrame(events, EVENTS),
        spark.createDataFrame(references, REFERENCES),
    )


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    rows = [
        (b["id"], b.get("path"), b.get("input_topic"), b.get("storage_id"),
         b.get("declared_message_count"), b.get("annotations"), b.get("sensor_profile"))
        for b in load_yaml(path).get("bags") or []
    ]
    return spark.createDataFrame(rows, DATASET)


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bag, split) and the blind hold-out boundaries."""
    document = load_yaml(path)
    named = [(bag, name) for name in SPLIT_NAMES for bag in document.get(name) or []]
    blind = [(e["bag"], e["from_bag_stamp_ns"]) for e in document.get("blind_holdout") or []]
    return (
        spark.createDataFrame(named, "bag_id string, split string"),
        spark.createDataFrame(blind, "bag_id string, from_ns long"),
    )


def read_scene_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of every recording's scene table, with their time window in seconds."""
    rows = []
    for bag, entry in (load_yaml(path).get("bags") or {}).items():
        for o in entry.get("objects") or []:
            start, end = (float(v) for v in o["video_s"])
            rows.append((bag, o["id"], o["envelope_class"], start, end, o.get("description")))
    return spark.createDataFrame(
        rows, "bag_id string, id string, envelope_class string, start_s double, end_s double, description string"
    )
