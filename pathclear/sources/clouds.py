"""Point-cloud messages: byte layout checks and decoding into nested points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.config import CloudLimits
from pathclear.functions.text import valid_stamp_ns
from pathclear.schemas import POINT

# Scalar field codes in code order, from 1.
FIELD_TYPES = ["i1", "u1", "i2", "u2", "i4", "u4", "f4", "f8"]
FLOAT32, FLOAT64 = 7, 8


def _named(name: str) -> Column:
    return F.filter("fields", lambda f: f["name"] == name)


def layout_error(limits: CloudLimits) -> Column:
    """First problem of a cloud message; null when its points can be decoded."""
    count = F.col("width") * F.col("height")
    step, row = F.col("point_step"), F.col("row_step")
    size = F.coalesce(F.length("data"), F.lit(0))
    stamp = valid_stamp_ns(F.col("stamp_sec"), F.col("stamp_nanosec"))
    some = count > 0
    strides = (
        (step == 0) | (F.col("width") * step > row) | (row * F.col("height") > size)
    )
    chain = (
        F.when(size > limits.max_cloud_bytes, "POINTCLOUD_BYTE_LIMIT_EXCEEDED")
        .when(stamp.isNull(), "INVALID_TIMESTAMP")
        .when(count > limits.max_points, "POINT_LIMIT_EXCEEDED")
        .when(some & strides, "Invalid PointCloud2 strides or data length")
    )
    spans = []
    for name in "xyz":
        match = _named(name)
        field = F.get(match, 0)
        width = F.when(field["datatype"] == FLOAT32, 4).when(field["datatype"] == FLOAT64, 8)
        scalar = F.coalesce((F.size(match) > 0) & (field["count"] == 1) & width.isNotNull(), F.lit(False))
        chain = (
            chain.when(some & (F.size(match) > 1), "Duplicate XYZ field")
            .when(some & ~scalar, "XYZ must be scalar FLOAT32/FLOAT64")
            .when(some & (field["offset"] + width > step), "XYZ field exceeds point_step")
        )
        spans.append((field["offset"], field["offset"] + width))
    for i in range(3):
        for j in range(i + 1, 3):
            (a, b), (c, d) = spans[i], spans[j]
            chain = chain.when(some & (a < d) & (c < b), "XYZ fields overlap")
    return chain


def field_grid(message: dict, name: str, data: bytes | bytearray) -> np.ndarray:
    """One field of a message as rows and columns over its bytes, row padding and byte order respected."""
    field = next(f for f in message["fields"] if f["name"] == name)
    order = ">" if message["is_bigendian"] else "<"
    return np.ndarray(
        shape=(message["height"], message["width"]), dtype=order + FIELD_TYPES[field["datatype"] - 1],
        buffer=data, offset=field["offset"], strides=(message["row_step"], message["point_step"]),
    )


def field_view(message: dict, name: str) -> np.ndarray:
    """One field of a message as a flat array."""
    return field_grid(message, name, message["data"]).reshape(-1)


def decode(clouds: DataFrame, limits: CloudLimits = CloudLimits(), extra: tuple = (), stride: int = 1):
    """Adds ``points`` (and ``extra`` fields as double arrays) and ``decode_error``.

    NaN and zero points are kept: filtering them is the detector's business.
    """
    checked = clouds.withColumn("decode_error", layout_error(limits)).withColumn(
        "measurement_time_ns", valid_stamp_ns(F.col("stamp_sec"), F.col("stamp_nanosec"))
    )
    kept = [c for c in checked.columns if c not in ("data", "fields")]
    types = dict(checked.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept)
    schema += f", points array<{POINT}>" + "".join(f", {n} array<double>" for n in extra)

    def run(batches):
        for batch in batches:
            flat, sizes = [], []
            for message in batch.to_pylist():
                if message["decode_error"] is not None or not message["width"] * message["height"]:
                    sizes.append(0)
                    continue
                values = [field_view(message, n)[::stride].astype(float) for n in ("x", "y", "z", *extra)]
                flat.append(values)
                sizes.append(len(values[0]))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [
                pa.array(np.concatenate([f[i] for f in flat]) if flat else np.empty(0))
                for i in range(3 + len(extra))
            ]
            points = pa.StructArray.from_arrays(columns[:3], names=["x", "y", "z"])
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (points, *columns[3:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in kept], *lists],
                names=[*kept, "points", *extra],
            )

    return checked.mapInArrow(run, schema)


def encode(edited: DataFrame) -> DataFrame:
    """Cloud messages with their ``points`` written back into ``data``; ``points`` is dropped.

    ``edited``: message rows with ``points`` in the order of :func:`decode`.  Only the bytes of x, y and z change;
    other fields, padding and byte order stay, so the messages decode again.  A message whose points differ
    in number from its width and height ends the job.
    """
    kept = [f for f in edited.schema if f.name != "points"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a message at a time: clouds are wide
                one = batch.slice(i, 1)
                message = one.select([n for n in names if n != "data"]).to_pylist()[0]
                flat, data = one.column("points").flatten(), bytearray(one.column("data")[0].as_py() or b"")
                if len(flat) != message["width"] * message["height"]:
                    raise ValueError(f"{len(flat)} points for a cloud of {message['width']} x {message['height']}")
                for axis in "xyz" if len(flat) else "":
                    values = flat.field(axis).to_numpy(zero_copy_only=False)
                    field_grid(message, axis, data)[...] = values.reshape(message["height"], message["width"])
                columns = [pa.array([bytes(data)], pa.binary()) if n == "data" else one.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return edited.mapInArrow(run, schema)


def write_edited(edited: DataFrame, path: str) -> None:
    """Writes edited clouds as message rows (see :func:`encode`), to be read back and decoded like any others.

    Spark commits the files of whole tasks only, so a task that fails leaves nothing; an existing path is refused.
    """
    encode(edited).write.parquet(path)


def to_frames(decoded: DataFrame, rotation, translation, verified: bool, allow: bool) -> DataFrame:
    """Frame input rows of decoded clouds with the fixed transform of a profile."""
    return decoded.filter(F.col("decode_error").isNull()).select(
        "source", "session", "frame_sequence", "bag_stamp_ns", "measurement_time_ns", "points",
        F.lit(True).alias("transform_available"),
        F.array(*[F.lit(float(v)) for v in rotation]).alias("rotation"),
        F.array(*[F.lit(float(v)) for v in translation]).alias("translation"),
        F.lit(verified).alias("calibration_verified"), F.lit(allow).alias("allow_unverified_calibration"),
    )


def refused(decoded: DataFrame) -> DataFrame:
    """Analyses of clouds that could not be decoded; they leave the detector untouched."""
    return decoded.filter(F.col("decode_error").isNotNull()).select(
        "source", "session", "frame_sequence", "measurement_time_ns", F.lit(1).alias("status"),
        F.col("decode_error").alias("reason"), F.lit("UNKNOWN").alias("calibration_trust"),
        F.lit(False).alias("evaluation_region_valid"), F.lit(0.0).alias("evaluated_range_m"),
        F.lit(False).alias("ego_motion_valid"), F.lit(0.0).alias("ego_speed_mps"),
    )
