"""Transform messages of bag files: one row per transform."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathclear.functions.geometry import all_finite
from pathclear.sources import rosbag

# Topics and type of transform messages.
MOVING, FIXED = "/tf", "/tf_static"
TRANSFORM_TYPE = "tf2_msgs/msg/TFMessage"
# A quaternion whose squared length is farther from one is no rotation; the sender's rounding is less.
LENGTH_TOLERANCE = 1e-2


def parse_transforms(data: bytes) -> list[dict]:
    """Transforms of one serialized message, in its order; a message that ends early is a ``struct.error``."""
    c = rosbag._Cursor(bytes(data))
    found = []
    for _ in range(c.number("I")):
        sec, nanosec, parent, child = c.number("i"), c.number("I"), c.text(), c.text()
        found.append({
            "stamp_ns": sec * 1_000_000_000 + nanosec, "parent": parent, "child": child,
            "translation": [c.number("d") for _ in range(3)], "quaternion": [c.number("d") for _ in range(4)],
        })
    return found


_SCHEMA = pa.schema([
    ("file", pa.string()), ("record_ns", pa.int64()), ("message_id", pa.int64()), ("place", pa.int32()),
    ("is_static", pa.bool_()), ("stamp_ns", pa.int64()), ("parent", pa.string()), ("child", pa.string()),
    ("translation", pa.list_(pa.float64())), ("quaternion", pa.list_(pa.float64())),
])
TRANSFORMS = (
    "file string, record_ns long, message_id long, place int, is_static boolean, stamp_ns long, parent string, "
    "child string, translation array<double>, quaternion array<double>"
)


def usable() -> Column:
    """Transforms that a tree of frames takes: two different names, finite numbers, a rotation of unit length."""
    q = [F.get("quaternion", i) for i in range(4)]
    numbers = [*[F.get("translation", i) for i in range(3)], *q]
    length = sum((x * x for x in q[1:]), q[0] * q[0])
    named = (F.col("parent") != "") & (F.col("child") != "") & (F.col("parent") != F.col("child"))
    return F.coalesce(named & all_finite(*numbers) & (F.abs(length - 1) <= LENGTH_TOLERANCE), F.lit(False))


def read_transforms(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Usable transforms of the moving and the fixed topic of every file (see ``TRANSFORMS``).

    A message that cannot be parsed ends the job: with a gap in the transforms, clouds would get wrong places.
    No such topic gives no rows.
    """
    rosbag.register(spark)

    def messages(topic):
        # A load for each topic: Spark keeps one set of pushed filters for all uses of a loaded table.
        raw = spark.read.format("rosbag").option("path", ",".join(paths)).load()
        return raw.filter((F.col("topic") == topic) & (F.col("type") == TRANSFORM_TYPE))

    def run(batches):
        for batch in batches:
            out = []
            for message in batch.to_pylist():
                try:
                    found = parse_transforms(message["data"])
                except (struct.error, UnicodeDecodeError, IndexError) as error:
                    raise ValueError(f"{message['file']}: broken transforms in message {message['id']}") from error
                head = {"file": message["file"], "record_ns": message["timestamp"], "message_id": message["id"],
                        "is_static": message["topic"] == FIXED}
                out += [{**head, "place": i, **one} for i, one in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    both = [messages(topic).mapInArrow(run, TRANSFORMS) for topic in (MOVING, FIXED)]
    bare = {c: F.regexp_replace(c, "^/", "") for c in ("parent", "child")}
    return both[0].unionByName(both[1]).withColumns(bare).filter(usable())
