"""Joins along time, done as sweeps.

Interval, event and nearest-time joins put markers and frames on one time line and read running
counts or the neighbouring row there.  No pair of rows is ever formed, so overlapping intervals or
a recording with a third of all frames cost no more than their own rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.functions.ordering import SlicedOrder

# Labels, strongest first.
LABEL_ORDER = ["positive", "uncertain", "negative"]
START, FRAME, END = 0, 1, 2


def _sweep(keys: list[str], bounds, at: str = "_at") -> SlicedOrder:
    return SlicedOrder(keys, [at, "_kind"], bounds)


def label_frames(
    frames: DataFrame, intervals: DataFrame, keys: list[str], stamp: str, bounds,
    start: str = "start_ns", end: str = "end_ns",
) -> DataFrame:
    """Adds ``label``: the strongest label of all inclusive intervals over each frame."""
    names = frames.columns
    rows = frames.select(
        *keys, F.col(stamp).alias("_at"), F.lit(FRAME).alias("_kind"),
        F.lit(None).cast("string").alias("_label"), F.struct(*names).alias("_row"),
    )
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    marks = [
        intervals.select(
            *keys, F.col(c).alias("_at"), F.lit(kind).alias("_kind"),
            F.col("label").alias("_label"), none.alias("_row"),
        )
        for c, kind in ((start, START), (end, END))
    ]
    line = rows.unionByName(marks[0]).unionByName(marks[1])
    step = F.when(F.col("_kind") == START, 1).when(F.col("_kind") == END, -1).otherwise(0)
    order = _sweep(keys, bounds)
    line = order.running_sum(
        line, {f"_{n}": F.when(F.col("_label") == n, step).otherwise(0) for n in LABEL_ORDER}
    )
    label = F.lit("unlabeled")
    for name in reversed(LABEL_ORDER):
        label = F.when(F.col(f"_{name}") > 0, name).otherwise(label)
    return line.filter(F.col("_kind") == FRAME).select("_row.*", label.alias("label"))


def nearest_in_time(
    refs: DataFrame, frames: DataFrame, keys: list[str], ref_stamp: str, stamp: str, bounds,
    name: str = "frame",
) -> DataFrame:
    """Adds to every reference the frame closest in time (the earlier one on a tie)."""
    beside = beside_in_time(refs, frames, keys, ref_stamp, stamp, bounds)
    at, before, after = F.col(ref_stamp), F.col("before"), F.col("after")
    take_before = after.isNull() | (
        before.isNotNull() & (at - before[stamp] <= after[stamp] - at)
    )
    return beside.withColumn(name, F.when(take_before, before).otherwise(after)).drop(
        "before", "after"
    )


def beside_in_time(
    refs: DataFrame, frames: DataFrame, keys: list[str], ref_stamp: str, stamp: str, bounds
) -> DataFrame:
    """Adds ``before`` (at or before) and ``after`` (strictly after) frame structs."""
    payload = F.struct(*frames.columns)
    seen = frames.select(*keys, F.col(stamp).alias("_at"), F.lit(0).alias("_kind"), payload.alias("_frame"))
    asked = refs.select(
        *keys, F.col(ref_stamp).alias("_at"), F.lit(1).alias("_kind"), F.struct(*refs.columns).alias("_ref")
    )
    line = seen.unionByName(asked, allowMissingColumns=True)
    order = _sweep(keys, bounds)
    asks = F.col("_kind") == 1
    line = order.last_known(line, {"before": F.col("_frame")})
    # Only questions keep what was found: a frame goes on with its own columns, not with its neighbour's too.
    line = line.withColumn("before", F.when(asks, F.col("before")))
    line = order.next_known(line, {"after": F.col("_frame")}, inclusive=False)
    return line.filter(asks).select("_ref.*", "before", "after")


def count_in_spans(
    frames: DataFrame, spans: DataFrame, keys: list[str], span_id: str, stamp: str, bounds,
    counts: Mapping[str, Column], first: Mapping[str, Column], start: str, end: str,
) -> DataFrame:
    """Per inclusive span: sums of ``counts`` and the first non-null of ``first``, with its stamp.

    Spans may overlap.  ``first`` values come back as ``struct<at, v>``, null when outside.
    """
    measured = frames.select(
        *keys, F.col(stamp).alias("_at"), F.lit(FRAME).alias("_kind"),
        *[e.cast("long").alias(n) for n, e in counts.items()],
        *[F.when(e.isNotNull(), F.struct(F.col(stamp).alias("at"), e.alias("v"))).alias(n)
          for n, e in first.items()],
    )
    line = measured
    for c, kind in ((start, START), (end, END)):
        line = line.unionByName(
            spans.select(*keys, F.col(span_id), F.col(c).alias("_at"), F.lit(kind).alias("_kind")),
            allowMissingColumns=True,
        )
    order = _sweep(keys, bounds)
    line = order.running_sum(line, {f"_{n}": F.coalesce(F.col(n), F.lit(0)) for n in counts})
    if first:
        line = order.next_known(line, {f"_{n}": F.col(n) for n in first})
    at_start, at_end = F.col("_kind") == START, F.col("_kind") == END
    marks = line.filter(F.col("_kind") != FRAME).groupBy(*keys, span_id).agg(
        F.max(F.when(at_start, F.col("_at"))).alias(start),
        F.max(F.when(at_end, F.col("_at"))).alias(end),
        *[(F.max(F.when(at_end, F.col(f"_{n}"))) - F.max(F.when(at_start, F.col(f"_{n}")))).alias(n)
          for n in counts],
        *[F.max(F.when(at_start, F.col(f"_{n}"))).alias(n) for n in first],
    )
    return marks.withColumns(
        {n: F.when(F.col(f"{n}.at") <= F.col(end), F.col(n)) for n in first}
    )


def with_slerp(df: DataFrame, p: list[Column], q: list[Column], share: Column, name: str) -> DataFrame:
    """Adds the spherical interpolation of two unit quaternions along the shorter arc.

    The angle and the two weights are columns of their own, evaluated once per row.
    """
    dot = sum((a * b for a, b in zip(p[1:], q[1:])), p[0] * q[0])
    df = df.withColumn("_dot", dot)
    df = df.withColumn("_angle", F.acos(F.least(F.lit(1.0), F.abs("_dot"))))
    angle, close = F.col("_angle"), F.col("_angle") < 1e-9
    sign = F.when(F.col("_dot") < 0, -1.0).otherwise(1.0)
    whole = F.when(close, 1.0).otherwise(F.sin(angle))
    df = df.withColumns({
        "_wp": F.when(close, 1 - share).otherwise(F.sin((1 - share) * angle) / whole),
        "_wq": F.when(close, share).otherwise(F.sin(share * angle) / whole) * sign,
    })
    mixed = F.array(*[F.col("_wp") * u + F.col("_wq") * v for u, v in zip(p, q)])
    return df.withColumn(name, mixed).drop("_dot", "_angle", "_wp", "_wq")


def rotation_from_quaternion(q: Column) -> Column:
    """Row-major rotation matrix of a quaternion array [x, y, z, w]."""
    x, y, z, w = (F.get(q, i) for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def transforms_at(
    clouds: DataFrame, transforms: DataFrame, keys: list[str], stamp: str, tf_stamp: str, bounds,
    lookahead: int, record: str | None = None, tf_record: str | None = None, oldest: str | None = None,
) -> DataFrame:
    """Transform of every cloud at its measurement time, interpolated between two neighbours.

    ``transforms`` carry arrays ``translation`` (3) and ``quaternion`` (4).  There is no
    extrapolation and no use of the latest transform: a missing side, a record that arrived more
    than ``lookahead`` after the cloud, a side before the cloud's ``oldest`` stamp or a quaternion that is
    not of unit length leaves the cloud without a transform.
    """
    beside = beside_in_time(clouds, transforms, keys, stamp, tf_stamp, bounds)
    record, tf_record = record or stamp, tf_record or tf_stamp
    at, b, a = F.col(stamp), F.col("before"), F.col("after")
    exact = b[tf_stamp] == at
    seen = F.col(record) + lookahead
    usable = (b[tf_record] <= seen) & (exact | (a[tf_record] <= seen))
    if oldest is not None:
        usable = usable & (b[tf_stamp] >= F.col(oldest))
    share = F.when(exact, 0.0).otherwise(
        (at - b[tf_stamp]) / F.nullif(a[tf_stamp] - b[tf_stamp], F.lit(0))
    )
    beside = beside.withColumns({"_share": share, "_usable": F.coalesce(usable, F.lit(False))})
    s = F.col("_share")
    end = F.when(exact, b).otherwise(a)
    beside = beside.withColumn("_end", end)
    p = [F.get(b["quaternion"], i) for i in range(4)]
    q = [F.get(F.col("_end.quaternion"), i) for i in range(4)]
    moved = [
        F.get(b["translation"], i)
        + (F.get(F.col("_end.translation"), i) - F.get(b["translation"], i)) * s for i in range(3)
    ]
    beside = with_slerp(beside, p, q, s, "quaternion")
    beside = beside.withColumns({
        "translation": F.when(F.col("_usable"), F.array(*moved)),
        "quaternion": F.when(F.col("_usable"), F.col("quaternion")),
    })
    length = F.aggregate("quaternion", F.lit(0.0), lambda t, v: t + v * v)
    available = F.col("_usable") & (F.abs(length - 1) <= 1e-6)
    return beside.withColumn("transform_available", F.coalesce(available, F.lit(False))).drop(
        "before", "after", "_share", "_usable", "_end"
    )
