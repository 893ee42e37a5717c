"""Places of clouds in a tree of coordinate frames whose transforms were recorded beside them.

The way from a cloud's frame to the target is found once per recording and frame, on the distinct edges of the
tree. Then every cloud asks for each edge of its way at its own measurement time, all in one sweep along time, and the
answers are chained by one ordered aggregate (as many as the tree is deep).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.settling import settle
from pathclear.operators import timeline as tl

CLOUD_KEY = ["source", "session", "frame_sequence"]
# How long a moving transform is kept behind the newest one of its edge, and how far records ahead count.
KEPT_NS = 10_000_000_000
LOOKAHEAD_NS = 50_000_000
MAX_LOOKAHEAD_NS = 1_000_000_000


def in_sessions(moving: DataFrame, clouds: DataFrame, lookahead: int) -> DataFrame:
    """Moving transforms with the ``session`` in which clouds can see them; at a border a row may have several.

    A session begins after the last cloud of the one before, and looks ``lookahead`` past its own last one.
    """
    ends = clouds.groupBy("source", "session").agg(F.max("record_ns").alias("_end"))
    row = F.struct(*moving.columns)
    line = moving.select("source", F.col("record_ns").alias("_at"), F.lit(0).alias("_kind"), row.alias("_row"))
    none = F.lit(None).cast(line.schema["_row"].dataType).alias("_row")
    for kind, late in ((1, 0), (2, lookahead)):  # after a transform of the same time
        line = line.unionByName(ends.select(
            "source", (F.col("_end") + late).alias("_at"), F.lit(kind).alias("_kind"), none))
    order = SlicedOrder.fit(line.select("source", "_at", "_kind"), ["source"], ["_at", "_kind"])
    line = order.running_sum(line, {f"_n{k}": F.when(F.col("_kind") == k, 1).otherwise(0) for k in (1, 2)})
    return line.filter(F.col("_kind") == 0).select(
        "_row.*", F.explode(F.sequence(F.col("_n2").cast("long"), F.col("_n1").cast("long"))).alias("session"))


def ways(transforms: DataFrame, frames: DataFrame, target: str) -> DataFrame:
    """``steps`` from each ``frame_id`` of a ``source`` to the target: child frame and direction, in order.

    Frames that do not hang together with the target have no row. A frame with two parents in a recording has
    no certain place, nor has a circle: nothing above it is looked at.
    """
    edges = settle(transforms.groupBy("source", "child").agg(
        F.min("parent").alias("parent"), F.max("parent").alias("_other")
    ).filter("parent = _other").drop("_other"))
    asked = frames.select("source", "frame_id").where("frame_id IS NOT NULL")
    asked = asked.unionByName(asked.select("source", F.lit(target).alias("frame_id"))).distinct()
    open_ = settle(asked.withColumn("chain", F.array("frame_id")))
    done = []
    while not open_.isEmpty():  # once per level of the tree
        up = open_.withColumn("child", F.element_at("chain", -1)).join(edges, ["source", "child"], "left").drop("child")
        more = F.col("parent").isNotNull() & ~F.array_contains("chain", F.col("parent"))
        up = settle(up.withColumn("_more", F.coalesce(more, F.lit(False))))
        done.append(up.filter("NOT _more").select("source", "frame_id", "chain"))
        open_ = up.filter("_more").select(
            "source", "frame_id", F.concat("chain", F.array("parent")).alias("chain"))
    if not done:
        return asked.withColumn("steps", F.array().cast("array<struct<child:string,inverse:boolean>>"))
    chains = settle(reduce(DataFrame.unionByName, done))
    there = chains.filter(F.col("frame_id") == target).select("source", F.col("chain").alias("_there"))
    meet = F.get(F.filter("chain", lambda f: F.array_contains("_there", f)), 0)

    def below(chain: str) -> Column:
        return F.slice(chain, F.lit(1), F.array_position(chain, F.col("_meet")).cast("int") - 1)

    def steps(frames: Column, inverse: bool) -> Column:
        return F.transform(frames, lambda f: F.struct(f.alias("child"), F.lit(inverse).alias("inverse")))

    found = chains.join(there, "source").withColumn("_meet", meet).filter("_meet IS NOT NULL")
    return found.select("source", "frame_id", F.concat(
        steps(below("chain"), False), steps(F.reverse(below("_there")), True)).alias("steps"))


def _turned(q: Column, v: Column) -> list[Column]:
    """A vector (array) turned by a quaternion (array x, y, z, w)."""
    x, y, z, w = (F.get(q, i) for i in range(4))
    a, b, c = (F.get(v, i) for i in range(3))
    # v + 2 w (u x v) + 2 u x (u x v), with u the vector part
    s, t, r = y * c - z * b, z * a - x * c, x * b - y * a
    return [a + 2 * (w * s + y * r - z * t), b + 2 * (w * t + z * s - x * r), c + 2 * (w * r + x * t - y * s)]


def _product(p: Column, q: Column) -> list[Column]:
    a, b, c, d = (F.get(p, i) for i in range(4))
    x, y, z, w = (F.get(q, i) for i in range(4))
    return [d * x + a * w + b * z - c * y, d * y - a * z + b * w + c * x, d * z + a * y - b * x + c * w,
            d * w - a * x - b * y - c * z]


def chained(steps: Column) -> Column:
    """One transform ``struct<translation, quaternion>`` of ordered steps ``translation, quaternion, inverse``."""
    def back(q):
        return F.array(-F.get(q, 0), -F.get(q, 1), -F.get(q, 2), F.get(q, 3))

    def step(at, e):
        t, q = e["translation"], e["quaternion"]
        away = F.zip_with(at["translation"], t, lambda u, v: u - v)
        there = F.zip_with(F.array(*_turned(q, at["translation"])), t, lambda u, v: u + v)
        return F.when(e["inverse"], F.struct(
            F.array(*_turned(back(q), away)).alias("translation"),
            F.array(*_product(back(q), at["quaternion"])).alias("quaternion"),
        )).otherwise(F.struct(there.alias("translation"), F.array(*_product(q, at["quaternion"])).alias("quaternion")))

    start = F.struct(F.array(*[F.lit(0.0)] * 3).alias("translation"),
                     F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]).alias("quaternion"))
    return F.aggregate(steps, start, step)


def _along_records(asked: DataFrame, given: DataFrame, keys: list[str], read) -> DataFrame:
    """``asked`` rows with what ``read(order, line)`` adds, on a line of records up to each cloud's last visible one."""
    names = asked.columns
    line = given.select(*keys, F.col("record_ns").alias("_at"), F.lit(0).alias("_kind"),
                        *[F.col(c) for c in ("message_id", "place")], F.struct("translation", "quaternion").alias("_given"),
                        F.col("stamp_ns").alias("_stamp"))
    rows = asked.select(*keys, F.col("_seen").alias("_at"), F.lit(1).alias("_kind"), F.struct(*names).alias("_row"))
    line = line.unionByName(rows, allowMissingColumns=True)
    by = ["_at", "_kind", "message_id", "place"]
    order = SlicedOrder.fit(line.select(*keys, *by), keys, by)
    line, added = read(order, line)
    return line.filter(F.col("_kind") == 1).select("_row.*", *added)


def place_clouds(
    clouds: DataFrame, transforms: DataFrame, target: str, lookahead: int = LOOKAHEAD_NS, kept: int = KEPT_NS,
) -> DataFrame:
    """``transform_available``, ``translation`` and ``quaternion`` from each cloud's frame to the target.

    ``clouds``: source, session, frame_sequence, record_ns, stamp_ns, frame_id (one row per key; other columns
    are dropped).  ``transforms``: as from ``read_transforms``, with ``source``.  Moving edges are read at the stamp
    between two neighbours, never beyond them; records later than ``lookahead`` after the cloud's are not seen, nor
    moving transforms of an earlier session or more than ``kept`` older than the newest seen of their edge.  Of
    moving ones with equal stamps the first recorded counts, of fixed ones the last; an edge that is both is fixed.
    Without a stamp, a frame or a way there is no transform; a cloud in the target's frame needs none.
    """
    if not 0 <= lookahead <= MAX_LOOKAHEAD_NS:
        raise ValueError("the lookahead must be from 0 to 1 second")
    clouds = settle(clouds.select(*CLOUD_KEY, "record_ns", "stamp_ns", "frame_id"))
    stamped = clouds.filter("stamp_ns IS NOT NULL")
    transforms = settle(transforms)
    fixed, moving = transforms.filter("is_static"), transforms.filter("NOT is_static")
    way = settle(ways(transforms, stamped, target))
    # A moving and fixed edge is fixed; the name tells it.
    moving = moving.join(fixed.select("source", "child").distinct(), ["source", "child"], "left_anti")
    moving = in_sessions(moving, stamped, lookahead)
    first = F.min_by(F.struct("record_ns", "translation", "quaternion"), F.struct("record_ns", "message_id", "place"))
    # What was recorded first counts for its stamp.
    once = settle(moving.groupBy("source", "session", "child", "stamp_ns").agg(first.alias("_f"), F.min(
        F.struct("message_id", "place")).alias("_m")).select("source", "session", "child", "stamp_ns", "_f.*", "_m.*"))
    asked = settle(stamped.join(way, ["source", "frame_id"]).select(
        *CLOUD_KEY, "record_ns", "stamp_ns", (F.col("record_ns") + lookahead).alias("_seen"),
        F.posexplode("steps").alias("_step", "_edge")).select("*", "_edge.child", "_edge.inverse").drop("_edge"))
    is_fixed = fixed.select("source", "child").distinct()
    still = _along_records(asked.join(is_fixed, ["source", "child"], "left_semi"), fixed, ["source", "child"], lambda order, line: (
        order.last_known(line, {"_g": F.col("_given")}), ["_g.translation", "_g.quaternion"]))
    edge = ["source", "session", "child"]
    newest = settle(_along_records(asked.join(is_fixed, ["source", "child"], "left_anti"), once, edge, lambda order, line: (
        order.running_max(line, {"_newest": F.col("_stamp")}), ["_newest"])).withColumn("_oldest", F.col("_newest") - kept))
    times = newest.select(*edge, F.col("stamp_ns").alias("_at"), F.lit(1).alias("_kind")).unionByName(
        once.select(*edge, F.col("stamp_ns").alias("_at"), F.lit(0).alias("_kind")))
    bounds = SlicedOrder.fit(times, edge, ["_at", "_kind"]).bounds
    turned = tl.transforms_at(newest, once, edge, "stamp_ns", "stamp_ns", bounds, lookahead, "record_ns", "record_ns", "_oldest")
    answers = still.unionByName(turned.select(
        *still.columns[:-2], *[F.when(F.col("transform_available"), F.col(c)).alias(c) for c in ("translation", "quaternion")]))
    told = answers.groupBy(*CLOUD_KEY).agg(
        F.array_sort(F.collect_list(F.struct("_step", "translation", "quaternion", "inverse"))).alias("_all"))
    whole = F.forall("_all", lambda e: e["quaternion"].isNotNull())
    told = told.filter(whole).select(*CLOUD_KEY, chained(F.col("_all")).alias("_one"))
    # A way without steps: the cloud is in the target's frame.
    here = stamped.filter(F.col("frame_id") == target).select(
        *CLOUD_KEY, chained(F.array().cast(_STEPS)).alias("_one"))
    length = F.aggregate("_one.quaternion", F.lit(0.0), lambda total, v: total + v * v)
    told = told.unionByName(here).filter(F.abs(length - 1) <= 1e-6)
    return clouds.select(*CLOUD_KEY).join(told, CLOUD_KEY, "left").select(
        *CLOUD_KEY, F.col("_one").isNotNull().alias("transform_available"), "_one.translation",
        F.transform("_one.quaternion", lambda v: v / F.sqrt(length)).alias("quaternion"))


_STEPS = "array<struct<_step:int,translation:array<double>,quaternion:array<double>,inverse:boolean>>"
