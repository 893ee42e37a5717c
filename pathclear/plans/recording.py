"""From recordings to exported frame rows: read, place, analyse, decide, write.

    rows = export_recordings(spark, ["a.db3", "b.db3"], "/points", load_profile("profile.yaml"))
    jsonl.write_exports(rows, "run")
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathclear.config import CloudLimits, ConfigError, Profile
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.settling import settle
from pathclear.functions.text import valid_stamp_ns
from pathclear.operators import frametree, sequences
from pathclear.operators import timeline as tl
from pathclear.operators.tracking import decide
from pathclear.plans.detector import analyse
from pathclear.sources import clouds as cl
from pathclear.sources import jsonl, rosbag
from pathclear.sources.transforms import read_transforms

KEY = frametree.CLOUD_KEY


def bag_name() -> Column:
    """Name of a recording: its file's name without the ending."""
    return F.regexp_replace(F.regexp_extract("source", "([^/]+)/?$", 1), r"\.[^.]*$", "")


def numbered(clouds: DataFrame) -> DataFrame:
    """Adds ``frame_sequence`` (from 1, in order of arrival) and ``session`` (from 0) to stamps of messages.

    A session ends where the stamp steps back from the last valid one; messages without a valid stamp stay in it.
    """
    by = ["record_ns", "message_id"]
    order = SlicedOrder.fit(clouds, ["source"], by)
    df = order.last_known(clouds, {"_last": F.col("stamp_ns")}, inclusive=False)
    back = F.coalesce((F.col("stamp_ns") < F.col("_last")).cast("int"), F.lit(0))
    df = order.running_sum(df.withColumn("_back", back), {"session": F.col("_back"), "frame_sequence": F.lit(1)})
    return order.finish(df).drop("_last", "_back").withColumns({
        "session": F.col("session").cast("long"), "frame_sequence": F.col("frame_sequence").cast("long")})


def read_numbered(spark: SparkSession, paths: list[str], topic: str) -> DataFrame:
    """Cloud messages of a topic, numbered; payloads are read once and join their numbers by message."""
    found = settle(rosbag.read_clouds(spark, paths, topic).withColumnsRenamed({"file": "source"}))
    stamps = found.select(
        "source", "message_id", F.col("bag_stamp_ns").alias("record_ns"),
        valid_stamp_ns(F.col("stamp_sec"), F.col("stamp_nanosec")).alias("stamp_ns"))
    numbers = settle(numbered(stamps).select("source", "message_id", "session", "frame_sequence"))
    return found.join(numbers, ["source", "message_id"])


def expected_source(clouds: DataFrame, profile: Profile) -> DataFrame:
    """Adds ``frame_ok``: whether a cloud comes from the frame that the profile names or its session is bound to.

    ``bind_first`` binds a session to the first frame that is named, other than the target's and sent with points.
    """
    frame, named = F.col("frame_id"), F.length(F.trim("frame_id")) > 0
    if profile.source_frame_mode == "exact":
        # Without a name no profile frame is expected, and every named frame is looked up.
        right = named if profile.source_frame is None else frame == profile.source_frame
        return clouds.withColumn("frame_ok", F.coalesce(right, F.lit(False)))
    if not profile.has_transform:
        raise ConfigError("bind_first needs a transform in the profile")
    keys = ["source", "session"]
    may = F.coalesce(named & (frame != profile.target_frame) & F.col("stamp_ns").isNotNull() & F.col("filled"), F.lit(False))
    bound = sequences.bind_first(clouds.filter(may), keys, "frame_sequence", "frame_id")
    bound = bound.select(*keys, "source_frame").distinct()
    right = named & (frame == F.col("source_frame")) & (frame != profile.target_frame)
    return clouds.join(bound, keys, "left").withColumn("frame_ok", F.coalesce(right, F.lit(False))).drop("source_frame")


def places(stamps: DataFrame, transforms: DataFrame | None, profile: Profile, lookahead: int) -> DataFrame:
    """``transform_available, rotation, translation`` of every cloud.

    The profile's own transform goes before recorded ones. A cloud of another frame than expected has none.
    """
    stamps = expected_source(stamps, profile)
    if profile.has_transform:
        known = F.col("frame_ok") & F.col("stamp_ns").isNotNull()
        home = F.col("frame_id") == profile.target_frame
        fixed = {"rotation": profile.rotation, "translation": profile.translation}
        own = {"rotation": Profile.rotation, "translation": Profile.translation}

        def array(values):
            return F.array(*[F.lit(float(v)) for v in values])

        return stamps.select(
            *KEY, F.coalesce(known, F.lit(False)).alias("transform_available"),
            *[F.when(home, array(own[c])).otherwise(array(fixed[c])).alias(c) for c in fixed])
    asked = stamps.withColumn("frame_id", F.when(F.col("frame_ok"), F.col("frame_id")))
    found = frametree.place_clouds(asked, transforms, profile.target_frame, lookahead)
    return found.select(
        *KEY, "transform_available", tl.rotation_from_quaternion(F.col("quaternion")).alias("rotation"), "translation")


def recording_frames(
    spark: SparkSession, paths: list[str], topic: str, profile: Profile, limits: CloudLimits = CloudLimits(),
    lookahead: int = frametree.LOOKAHEAD_NS,
) -> tuple[DataFrame, DataFrame]:
    """Frames for the detector (``schemas.FRAME_INPUT``), and analyses of messages that give none."""
    messages = settle(read_numbered(spark, paths, topic))
    bad = messages.filter(F.col("parse_error").isNotNull()).withColumns({
        "decode_error": F.col("parse_error"), "measurement_time_ns": F.lit(None).cast("long")})
    good = messages.filter(F.col("parse_error").isNull()).drop("parse_error")
    decoded = settle(cl.decode(good, limits))
    stamps = decoded.select(
        *KEY, F.col("bag_stamp_ns").alias("record_ns"), F.col("measurement_time_ns").alias("stamp_ns"), "frame_id",
        (F.col("decode_error").isNull() & (F.col("width") * F.col("height") > 0)).alias("filled"))
    transforms = None
    if not profile.has_transform:
        transforms = read_transforms(spark, paths).withColumnsRenamed({"file": "source"})
    placed = settle(places(stamps, transforms, profile, lookahead))
    facts = cl.to_frames(
        decoded, profile.rotation, profile.translation, profile.calibration_verified, profile.allow_unverified_calibration
    ).drop("transform_available", "rotation", "translation")
    names = ["source", "session", "frame_sequence", "decode_error", "measurement_time_ns", "bag_stamp_ns"]
    refused = decoded.select(*names).unionByName(bad.select(*names)).filter(F.col("decode_error").isNotNull())
    times = refused.select(*KEY, "bag_stamp_ns")
    return facts.join(placed, KEY), cl.refused(refused).join(times, KEY)


def export_recordings(
    spark: SparkSession, paths: list[str], topic: str, profile: Profile, limits: CloudLimits = CloudLimits(),
    lookahead: int = frametree.LOOKAHEAD_NS,
) -> DataFrame:
    """Export rows of every message of a topic, one recording per file; messages that cannot be read are rows too.

    Stamps that are not valid are 0. Frames are worked on side by side, so no time per frame is told.
    """
    frames, refused = recording_frames(spark, paths, topic, profile, limits, lookahead)
    frames = settle(frames)
    if frames.isEmpty() and refused.isEmpty():
        raise ValueError(f"no messages of {topic}")
    analyses = analyse(frames, profile.detector)
    told = refused.withColumn("measurement_time_ns", F.coalesce("measurement_time_ns", F.lit(0).cast("long")))
    none = F.array().cast(analyses.schema["candidates"].dataType)
    zero = {c: F.lit(0).cast("long") for c in analyses.columns if c.endswith("_point_count")}
    told = told.withColumns({
        **zero, "candidates": none, "transform_applied": F.lit(False), "ground_inliers": F.lit(0).cast("long")})
    facts = {"calibration_verified": F.lit(profile.calibration_verified),
             "allow_unverified_calibration": F.lit(profile.allow_unverified_calibration)}
    seen = frames.select(*KEY, "bag_stamp_ns", *facts).unionByName(told.select(*KEY, "bag_stamp_ns").withColumns(facts))
    analyses = settle(analyses.unionByName(told.drop("bag_stamp_ns"), allowMissingColumns=True))
    # A monitor goes on through a session; the next one starts afresh.
    decided = settle(decide(analyses, profile.temporal))
    return jsonl.export_rows(analyses, decided, seen, bag_name())
