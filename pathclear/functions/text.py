"""Wire codes, reason strings and text output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire enums in code order.
STATES = ["UNKNOWN", "OBSTACLE", "NO_OBSTACLE_DETECTED"]
TRUSTS = ["UNKNOWN", "ASSUMED", "VERIFIED"]


def decode_status(code: Column) -> Column:
    """Analysis status 0..4; anything else fails closed to bad input (1)."""
    return F.when(code.between(0, 4), code).otherwise(1)


def wire_reason(code: Column, reason: Column) -> Column:
    return F.when(F.coalesce(code.between(0, 4), F.lit(False)), reason).otherwise(
        "INVALID_PROCESSING_STATUS"
    )


def _named(code: Column, names: list[str]) -> Column:
    out = F.lit(names[0])
    for i, name in enumerate(names):
        out = F.when(code == i, name).otherwise(out)
    return out


def decode_trust(code: Column) -> Column:
    return _named(code, TRUSTS)


def decode_state(code: Column) -> Column:
    return _named(code, STATES)


def channel_names(mask: Column) -> Column:
    return F.array_compact(F.array(
        F.when(mask.bitwiseAND(1) > 0, "MOTION"), F.when(mask.bitwiseAND(2) > 0, "GAUGE")
    ))


def channels_from_reasons(reasons: Column) -> Column:
    return F.when(F.array_contains(reasons, "MOTION"), 1).otherwise(0).bitwiseOR(
        F.when(F.array_contains(reasons, "GAUGE"), 2).otherwise(0)
    )


def offset_from_reasons(reasons: Column) -> Column:
    """Value of the last well-formed ``OFFSET=<float>`` entry; null when there is none."""
    texts = F.filter(reasons, lambda r: r.startswith("OFFSET="))
    values = F.transform(texts, lambda r: r.substr(F.lit(8), F.length(r)).try_cast("double"))
    good = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.try_element_at(good, F.lit(-1))


def obstacle_reason(trust: Column, coasting: Column) -> Column:
    base = F.when(coasting, "OBSTACLE_COASTING").otherwise("OBSTACLE")
    return (
        F.when(trust == "ASSUMED", F.concat(base, F.lit("_WITH_ASSUMED_CALIBRATION")))
        .when(trust == "VERIFIED", F.when(coasting, base).otherwise("OBSTACLE_CANDIDATE"))
        .otherwise(F.concat(base, F.lit("_WITH_UNKNOWN_CALIBRATION")))
    )


def valid_stamp_ns(sec: Column, nanosec: Column) -> Column:
    """Measurement time in ns; null when the stamp is not a valid positive time."""
    total = sec.cast("long") * 1_000_000_000 + nanosec.cast("long")
    return F.when((sec >= 0) & (nanosec >= 0) & (nanosec < 1_000_000_000) & (total > 0), total)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, as C and Python print them.

    ``format_string`` rounds the shortest decimal text instead, which differs where that text ends
    in a 5.  The sign of the distance to the midpoint is exact because the value is split in two.
    """
    scale = 2 * 10**digits
    halves = F.round(value * scale)
    high = value.cast("float").cast("double")
    past = (high * scale - halves) + (value - high) * scale
    below = F.floor(halves / 2)
    up = (past > 0) | ((past == 0) & (F.pmod(below, F.lit(2)) == 1))
    odd = F.pmod(halves, F.lit(2)) == 1
    units = F.when(odd, below + F.when(up, 1).otherwise(0)).otherwise(halves / 2)
    return F.format_string(f"%.{digits}f", units / 10.0**digits)


def assessment_text(row: dict[str, Column], tracks: Column) -> Column:
    """Multi-line status text; ``tracks`` are structs id, confirmed, distance_m, size, hits, coasting."""
    confirmed = F.sort_array(F.transform(
        F.filter(tracks, lambda t: t["confirmed"]),
        lambda t: F.struct(t["distance_m"].alias("d"), t.alias("t")),
    ))
    lines = F.transform(confirmed, lambda c: F.format_string(
        "- id %d: %s m, %s x %s x %s m, hits %d%s",
        c["t"]["id"], fixed(c["t"]["distance_m"], 1),
        *[fixed(F.get(c["t"]["size"], i), 1) for i in range(3)], c["t"]["hits"],
        F.when(c["t"]["coasting"], ", predicted").otherwise(""),
    ))
    known = row["distance_valid"] & row["distance_m"].isNotNull() & ~F.isnan(row["distance_m"])
    distance = F.when(known, fixed(row["distance_m"], 1)).otherwise("- (distance_valid: false)")
    region = F.when(row["evaluation_region_valid"], fixed(row["evaluated_range_m"], 1)).otherwise(
        "- (evaluation_region_valid: false)"
    )
    parts = [
        F.concat(F.lit("state: "), row["state"]),
        F.concat(F.lit("distance_m: "), distance),
        F.concat(F.lit("reason: "), row["reason"]),
        F.concat(F.lit("evaluated_range_m: "), region),
        F.concat(F.lit("calibration_trust: "), row["calibration_trust"]),
        F.concat(F.lit("result_age_ms: "), fixed(row["result_age_ms"], 0)),
        F.concat(F.lit("stale: "), row["stale"].cast("string")),
        F.concat(F.lit("frame_sequence: "), row["frame_sequence"].cast("string")),
        F.concat(F.lit("reported_objects: "), row["reported_objects"].cast("string")),
        F.concat(F.lit("confirmed_tracks:"), F.when(F.size(lines) == 0, " []").otherwise("")),
    ]
    return F.concat(F.array_join(F.concat(F.array(*parts), lines), "\n"), F.lit("\n"))
