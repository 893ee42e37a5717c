"""Recordings in sqlite bag files as a Spark data source.

``spark.read.format("rosbag").option("path", "a.db3,b.db3").load()`` gives one row per message:
file, topic, type, timestamp, id, data.  Files are cut into timestamp ranges that are read in
parallel; topic and timestamp filters and the choice of columns are applied inside the file.
Spark keeps the filters of a loaded table for all its uses in a plan: load once for each filter.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    InputPartition, LessThan, LessThanOrEqual,
)

SCHEMA = "file string, topic string, type string, timestamp long, id long, data binary"
CLOUD_TYPE = "sensor_msgs/msg/PointCloud2"
_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_COLUMNS = {"topic": "t.name", "timestamp": "m.timestamp"}


def connect(path: str):
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class Span(InputPartition):
    path: str
    low: int
    high: int


class BagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.per_task = int(options.get("messages_per_task", "2000"))
        self.payload = options.get("payload", "true") == "true"
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _OPS and name in _COLUMNS:
                self.where.append((_COLUMNS[name], _OPS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Span]:
        spans = []
        for path in self.paths:
            with connect(path) as db:
                low, high, count = db.execute("SELECT min(id), max(id), count(*) FROM messages").fetchone()
            if not count:
                continue
            step = max(1, (high - low + 1) * self.per_task // count)
            spans += [Span(path, at, min(high, at + step - 1)) for at in range(low, high + 1, step)]
        return spans

    def read(self, span: Span):
        data = "m.data" if self.payload else "NULL"
        terms = ["m.id BETWEEN ? AND ?", *[f"{c} {op} ?" for c, op, _ in self.where]]
        values = [span.low, span.high, *[v for _, _, v in self.where]]
        with connect(span.path) as db:
            cursor = db.execute(
                f"SELECT t.name, t.type, m.timestamp, m.id, {data} FROM messages m "
                f"JOIN topics t ON m.topic_id = t.id WHERE {' AND '.join(terms)}", values,
            )
            for name, kind, stamp, number, payload in cursor:
                yield span.path, name, kind, stamp, number, payload


class BagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rosbag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BagReader:
        return BagReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BagSource)


class _Cursor:
    """Little-endian or big-endian CDR fields, aligned to their size after the 4-byte header."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        self.order = "<" if data[1] & 1 else ">"

    def number(self, code: str):
        size = struct.calcsize(code)
        self.at += -(self.at - 4) % size
        value = struct.unpack_from(self.order + code, self.data, self.at)[0]
        self.at += size
        return value

    def block(self) -> bytes:
        size = self.number("I")
        self.at += size
        return self.data[self.at - size : self.at]

    def text(self) -> str:
        return self.block()[:-1].decode()


def parse_cloud(data: bytes) -> dict:
    """PointCloud2 fields of one serialized message."""
    c = _Cursor(bytes(data))
    row = {"stamp_sec": c.number("i"), "stamp_nanosec": c.number("I"), "frame_id": c.text(),
           "height": c.number("I"), "width": c.number("I")}
    row["fields"] = [
        {"name": c.text(), "offset": c.number("I"), "datatype": c.number("B"), "count": c.number("I")}
        for _ in range(c.number("I"))
    ]
    row.update(is_bigendian=bool(c.number("B")), point_step=c.number("I"), row_step=c.number("I"))
    row["data"] = c.block()
    return row


CLOUD_FIELDS = (
    "stamp_sec long, stamp_nanosec long, frame_id string, height long, width long, "
    "fields array<struct<name:string,offset:int,datatype:int,count:int>>, is_bigendian boolean, "
    "point_step long, row_step long, data binary, parse_error string"
)


def _arrow_schema() -> pa.Schema:
    field = pa.struct([("name", pa.string()), *[(n, pa.int32()) for n in ("offset", "datatype", "count")]])
    return pa.schema([
        ("file", pa.string()), ("bag_stamp_ns", pa.int64()), ("message_id", pa.int64()), ("stamp_sec", pa.int64()),
        ("stamp_nanosec", pa.int64()), ("frame_id", pa.string()), ("height", pa.int64()),
        ("width", pa.int64()), ("fields", pa.list_(field)), ("is_bigendian", pa.bool_()),
        ("point_step", pa.int64()), ("row_step", pa.int64()), ("data", pa.binary()),
        ("parse_error", pa.string()),
    ])


def read_clouds(spark: SparkSession, paths: list[str], topic: str) -> DataFrame:
    """Cloud rows of one topic; a message that cannot be parsed keeps its ``parse_error``."""
    register(spark)
    raw = spark.read.format("rosbag").option("path", ",".join(paths)).load().filter(F.col("topic") == topic)

    def run(batches):
        schema = _arrow_schema()
        for batch in batches:
            out = []
            for message in batch.to_pylist():
                try:
                    row = {**parse_cloud(message["data"]), "parse_error": None}
                except (struct.error, UnicodeDecodeError, IndexError):
                    row = {"parse_error": "DESERIALIZATION_ERROR"}
                out.append({"file": message["file"], "bag_stamp_ns": message["timestamp"], "message_id": message["id"], **row})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return raw.filter(F.col("type") == CLOUD_TYPE).mapInArrow(
        run, "file string, bag_stamp_ns long, message_id long, " + CLOUD_FIELDS
    )


def message_index(spark: SparkSession, paths: list[str], topic: str) -> DataFrame:
    """Stamps of one topic without reading any payload."""
    register(spark)
    index = spark.read.format("rosbag").option("path", ",".join(paths)).option("payload", "false").load()
    return index.filter(F.col("topic") == topic).select("file", "timestamp", "id")
