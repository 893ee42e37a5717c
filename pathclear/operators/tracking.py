"""Tracks over frames and the three-valued decision, one frame at a time.

``Monitor`` is the only state; the batch fold and the stream processor both step it.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathclear.config import TemporalConfig
from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.settling import settle
from pathclear.operators.points import GAUGE, MOTION, OK

NAN = float("nan")
DRIFT_M = 0.02


@dataclass
class Track:
    id: int
    center: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    size: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    distance_m: float = 0.0
    history: int = 0
    age: int = 0
    misses: int = 0
    channels: int = 0
    support: int = 0
    offsets: list = field(default_factory=lambda: [NAN, NAN, NAN])
    confirmed: bool = False

    def hits(self, window: int) -> int:
        return (self.history & ((1 << window) - 1)).bit_count()

    def measure(self, c: dict, edge_retracts: bool) -> None:
        """Takes a candidate's place; edge evidence keeps a track alive but does not confirm it."""
        self.center, self.size = list(c["center"]), list(c["size"])
        self.distance_m = c["distance_m"]
        self.channels |= c["channels"]
        self.support = c["support_points"]
        offset = c["closest_offset_m"]
        self.offsets = [NAN if offset is None else offset, *self.offsets[:2]]
        if not c["edge"]:
            self.history |= 1
        elif edge_retracts and all(
            a > b + DRIFT_M for a, b in zip(self.offsets, self.offsets[1:])
        ):
            self.confirmed, self.history = False, 0
        self.misses = 0


def usable(valid, distance) -> bool:
    return bool(valid) and distance is not None and math.isfinite(distance) and distance > 0


class Monitor:
    def __init__(self, config: TemporalConfig):
        self.config = config
        self.next_id = 1
        self.reset()

    def reset(self) -> None:
        self.tracks: list[Track] = []
        self.last_ns = 0

    # State as plain values, for stream checkpoints.
    def dump(self) -> dict:
        return {"next_id": self.next_id, "last_ns": self.last_ns, "tracks": [asdict(t) for t in self.tracks]}

    def load(self, state: dict) -> "Monitor":
        self.next_id, self.last_ns = state["next_id"], state["last_ns"]
        self.tracks = [Track(**t) for t in state["tracks"]]
        return self

    def _elapsed(self, now_ns: int) -> float:
        """Seconds since the last frame; a step back or a long pause clears all tracks."""
        dt = 0.0
        if self.last_ns and now_ns:
            gap = (now_ns - self.last_ns) * 1e-9
            if now_ns < self.last_ns or gap > self.config.max_gap_s:
                self.tracks = []
            else:
                dt = gap
        if now_ns:
            self.last_ns = now_ns
        return dt

    def _associate(self, candidates: list[dict], dt: float, ego: bool) -> None:
        """Greedy one-to-one assignment inside a gate that grows with range and time."""
        cfg = self.config
        slack = (cfg.object_max_speed_mps + (0.0 if ego else cfg.unknown_ego_speed_mps)) * dt
        pairs = []
        for t, track in enumerate(self.tracks):
            gate = cfg.gate_base_m + cfg.gate_range_fraction * max(0.0, track.center[0]) + slack
            for i, c in enumerate(candidates):
                apart = math.hypot(c["center"][0] - track.center[0], c["center"][1] - track.center[1])
                if apart <= gate:
                    pairs.append((apart, t, i))
        taken_t, taken_c = set(), set()
        for track in self.tracks:
            track.history = (track.history << 1) & 0xFFFFFFFF
            track.age += 1
        for _, t, i in sorted(pairs):
            if t in taken_t or i in taken_c:
                continue
            taken_t.add(t)
            taken_c.add(i)
            self.tracks[t].measure(candidates[i], cfg.edge_retracts)
        for t, track in enumerate(self.tracks):
            if t not in taken_t:
                track.misses += 1
        for i, c in enumerate(candidates):
            if i not in taken_c:
                track = Track(id=self.next_id, age=1)
                self.next_id += 1
                track.measure(c, cfg.edge_retracts)
                self.tracks.append(track)

    def _confirm(self, track: Track, frame: dict, ego: bool) -> None:
        cfg, speed = self.config, frame["ego_speed_mps"]
        evaluated = frame["evaluated_range_m"] if frame["evaluation_region_valid"] else 0.0
        if evaluated is None or not math.isfinite(evaluated):
            evaluated = 0.0
        if track.channels == GAUGE:
            needed, window = cfg.gauge_confirm_hits, cfg.gauge_confirm_window
        else:
            needed, window = cfg.confirm_hits, cfg.confirm_window
        rules = [track.hits(window) >= needed]
        if (evaluated > 0 and track.distance_m > evaluated) or (
            cfg.far_confirm_from_m > 0 and track.distance_m > cfg.far_confirm_from_m
        ):
            rules.append(track.hits(cfg.far_confirm_window) >= cfg.far_confirm_hits)
        if cfg.outer_offset_m > 0 and track.offsets[0] > cfg.outer_offset_m:
            rules.append(track.hits(cfg.outer_confirm_window) >= cfg.outer_confirm_hits)
        if cfg.motion_gauge_speed_mps > 0 and ego and speed >= cfg.motion_gauge_speed_mps:
            rules.append(bool(track.channels & GAUGE))
        # Standing still, new motion evidence is a real change and counts at once.
        still = (
            ego and abs(speed) < cfg.still_speed_mps and track.history & 1
            and track.channels & MOTION and track.support >= cfg.still_min_points
        )
        if all(rules) or still:
            track.confirmed = True

    def _update_tracks(self, frame: dict, candidates: list[dict]) -> None:
        cfg, now_ns = self.config, frame["measurement_time_ns"] or 0
        if now_ns and now_ns == self.last_ns:
            return  # The same measurement again is no new evidence.
        dt = self._elapsed(now_ns)
        speed = frame["ego_speed_mps"]
        ego = bool(frame["ego_motion_valid"]) and speed is not None and math.isfinite(speed)
        travel = max(0.0, speed) * dt if ego else 0.0
        for track in self.tracks:
            track.center[0] -= travel
            track.distance_m -= travel
        self._associate(candidates, dt, ego)
        for track in self.tracks:
            self._confirm(track, frame, ego)
        longest = cfg.longest_window
        self.tracks = [
            t for t in self.tracks
            if t.distance_m > 0 and t.misses < (cfg.release_misses if t.confirmed else longest)
        ]
        if cfg.max_tracks is not None and len(self.tracks) > cfg.max_tracks:
            self.tracks.sort(key=lambda t: (not t.confirmed, -t.hits(longest), t.distance_m))
            sure = sum(t.confirmed for t in self.tracks)
            self.tracks = self.tracks[: max(cfg.max_tracks, sure)]

    def _summaries(self) -> list[dict]:
        return [
            {
                "id": t.id, "confirmed": t.confirmed, "coasting": t.misses > 0,
                "hits": t.hits(self.config.longest_window), "age": t.age,
                "distance_m": t.distance_m, "center": list(t.center), "size": list(t.size),
                "channels": t.channels,
            }
            for t in self.tracks
        ]

    def step(self, frame: dict) -> dict:
        """Decision on one analysed frame."""
        trust = frame["calibration_trust"]
        out = {"state": "UNKNOWN", "distance_m": None, "distance_valid": False, "calibration_trust": trust}
        if frame["status"] != OK:
            # A failed frame is no evidence: tracks are neither updated nor aged.
            return {**out, "reason": frame["reason"] or "ANALYSIS_FAILED", "tracks": self._summaries()}
        given = frame["candidates"]
        given = [] if given is None else list(given)
        ranged = [c for c in given if usable(c["distance_valid"], c["distance_m"])]
        self._update_tracks(frame, ranged)
        out["tracks"] = self._summaries()
        sure = [t for t in out["tracks"] if t["confirmed"] and usable(True, t["distance_m"])]
        if sure:
            nearest = min(sure, key=lambda t: t["distance_m"])
            return {
                **out, "state": "OBSTACLE", "distance_m": nearest["distance_m"],
                "distance_valid": True, "reason": obstacle_reason(trust, nearest["coasting"]),
            }
        tentative = any(not t.confirmed for t in self.tracks)
        return {**out, **self._without_obstacle(frame, given, ranged, tentative)}

    def _without_obstacle(self, frame, given, ranged, tentative) -> dict:
        cfg, trust = self.config, frame["calibration_trust"]
        reach, region = frame["evaluated_range_m"], bool(frame["evaluation_region_valid"])
        whole = region and reach is not None and math.isfinite(reach) and reach > 0
        if ranged or (tentative and not given):
            return {"reason": "CANDIDATE_UNCONFIRMED"}
        if given:
            return {"reason": "CANDIDATE_DISTANCE_INVALID"}
        if trust not in ("ASSUMED", "VERIFIED"):
            return {"reason": "CALIBRATION_TRUST_UNKNOWN"}
        if trust == "ASSUMED" and not cfg.assumed_clear:
            return {"reason": "ASSUMED_CALIBRATION_CANNOT_CONFIRM_CLEAR"}
        if whole and trust == "ASSUMED" and reach < cfg.assumed_clear_min_range_m:
            return {"reason": "EVALUATED_RANGE_TOO_SHORT"}
        if whole:
            assumed = trust == "ASSUMED"
            return {
                "state": "NO_OBSTACLE_DETECTED",
                "reason": "NO_CANDIDATE_ASSUMED_CALIBRATION" if assumed
                else "NO_CANDIDATE_IN_EVALUATED_REGION",
            }
        if frame["reason"] == "BACKGROUND_CANNOT_CONFIRM_CLEAR":
            return {"reason": frame["reason"]}
        return {"reason": "EVALUATION_REGION_INVALID" if region else "CORRIDOR_UNOBSERVABLE"}


def obstacle_reason(trust: str, coasting: bool) -> str:
    base = "OBSTACLE_COASTING" if coasting else "OBSTACLE"
    if trust == "VERIFIED":
        return base if coasting else "OBSTACLE_CANDIDATE"
    return f"{base}_WITH_{'ASSUMED' if trust == 'ASSUMED' else 'UNKNOWN'}_CALIBRATION"


class OrderGate:
    """Admits frames of one active source in order; rejected frames have no side effects."""

    def __init__(self):
        self.active = None  # (source, session, sequence, stamp)
        self.retired: set = set()

    def dump(self) -> dict:
        return {"active": self.active, "retired": sorted(self.retired)}

    def load(self, state: dict) -> "OrderGate":
        self.active = tuple(state["active"]) if state["active"] else None
        self.retired = set(state["retired"])
        return self

    def admit(self, source, session, sequence, stamp_ns) -> tuple[bool, bool, str]:
        """(accepted, reset, reason)."""
        if not source:
            return False, False, "INVALID_SOURCE_ID"
        if stamp_ns is None:
            return False, False, "INVALID_STAMP"
        if not sequence:
            return False, False, "INVALID_SEQUENCE"
        if source in self.retired:
            return False, False, "RETIRED_SOURCE"
        key = (source, session, sequence, stamp_ns)
        if self.active is None:
            return self._take(key, "FIRST_SOURCE")
        was = self.active
        if source != was[0]:
            self.retired.add(was[0])
            return self._take(key, "NEW_SOURCE")
        if session < was[1]:
            return False, False, "OLD_SESSION"
        if session > was[1]:
            return self._take(key, "NEW_SESSION")
        if sequence <= was[2]:
            return False, False, "DUPLICATE_OR_LATE_SEQUENCE"
        if stamp_ns < was[3]:
            return False, False, "STAMP_WENT_BACKWARDS"
        self.active = key
        return True, False, "IN_ORDER"

    def _take(self, key, reason):
        self.active = key
        return True, True, reason


def _chains(rows: DataFrame, keys: list[str], order: list[str], config: TemporalConfig) -> DataFrame:
    """Rows with ``chain``: a new one wherever the monitor clears all tracks (a step back or a long pause)."""
    by = SlicedOrder.fit(rows.select(*keys, *order), keys, order)
    now = F.when((F.col("status") == OK) & (F.coalesce("measurement_time_ns", F.lit(0)) != 0), F.col("measurement_time_ns"))
    rows = by.last_known(rows, {"_before": now}, inclusive=False)
    pause = (now - F.col("_before")) * 1e-9 > config.max_gap_s
    cut = F.coalesce((now < F.col("_before")) | pause, F.lit(False)).cast("int")
    rows = by.running_sum(rows.withColumn("_cut", cut), {"chain": F.col("_cut")})
    return by.finish(rows).drop("_before", "_cut")


def decide(analyses, config: TemporalConfig, keys=("source", "session"), order=("frame_sequence",)):
    """Assessments of analysed frames, batch form: one monitor per chain between two resets.

    No track outlives a reset, so chains are independent of each other but for the numbers of their tracks,
    which go on by the count of tracks that earlier chains have begun.
    """
    from pathclear.operators.folds import ordered_fold
    from pathclear.schemas import ANALYSIS, ASSESSMENT

    names = [c.split()[0] for c in ANALYSIS.split(", ")]
    keys, order = list(keys), list(order)

    def start():
        monitor = Monitor(config)

        def step(row):
            out = monitor.step(row)
            return {**{k: row[k] for k in names[:4]}, **out, "chain": row["chain"], "begun": monitor.next_id - 1}

        return step

    rows = _chains(analyses.select(*names), keys, order, config)
    # A chain of one reset later starts with the time of its own first frame: nothing is left to clear.
    found = settle(ordered_fold(rows, [*keys, "chain"], order, start, f"{ASSESSMENT}, chain long, begun long"))
    begun = found.groupBy(*keys, "chain").agg(F.max("begun").alias("n"))
    # One row for each chain.
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy(*keys).orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = begun.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "chain")], before.alias("_shift"))
    same = F.lit(True)
    for k in (*keys, "chain"):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    moved = F.transform("tracks", lambda t: t.withField("id", (t["id"] + F.col("_shift")).cast(_id_type(found))))
    out = found.join(shift, same).withColumn("tracks", moved)
    return out.select(*[c for c in found.columns if c not in ("chain", "begun")])


def _id_type(found: DataFrame):
    return found.schema["tracks"].dataType.elementType["id"].dataType


class _SessionOrder:
    """Frames of one session of the active source: later ones must not go back in sequence or time."""

    def __init__(self):
        self.sequence = self.stamp = None

    def __call__(self, row: dict) -> dict:
        reason = row["gate_reason"]
        if self.sequence is not None:
            late = row["sequence"] <= self.sequence
            reason = "DUPLICATE_OR_LATE_SEQUENCE" if late else "STAMP_WENT_BACKWARDS" if row["stamp_ns"] < self.stamp else "IN_ORDER"
        if self.sequence is None or reason == "IN_ORDER":
            self.sequence, self.stamp = row["sequence"], row["stamp_ns"]
        return {**row, "gate_reason": reason}


def gate_frames(frames: DataFrame, line: str = "line", received: str = "received") -> DataFrame:
    """Gate verdict per arriving frame; all sources of a line share one gate.

    A source that was not seen before always takes over, and the one it takes over from never returns. So
    the active source is the one that appeared last, the current session is the largest of its sessions so
    far, and only the order within one session is followed row by row.
    """
    from pathclear.operators.folds import ordered_fold

    c = F.col
    problem = (
        F.when(F.coalesce("source", F.lit("")) == "", "INVALID_SOURCE_ID").when(c("stamp_ns").isNull(), "INVALID_STAMP")
        .when(F.coalesce("sequence", F.lit(0)) == 0, "INVALID_SEQUENCE")
    )
    rows = frames.withColumn("_problem", problem)
    valid = rows.filter(c("_problem").isNull())
    firsts = valid.groupBy(line, "source").agg(F.min(received).alias("_first"))
    valid = valid.drop("_problem").join(firsts, [line, "source"])
    by_line = SlicedOrder.fit(valid.select(line, received), [line], [received])
    starts = c(received) == c("_first")
    valid = by_line.last_known(valid, {"_active": F.when(starts, c("source"))})
    valid = by_line.finish(by_line.running_sum(valid, {"_nth": F.when(starts, 1).otherwise(0)}))
    names = frames.columns
    retired = valid.filter(c("source") != c("_active")).select(*names, F.lit("RETIRED_SOURCE").alias("gate_reason"))
    active = valid.filter(c("source") == c("_active"))
    by_source = SlicedOrder.fit(active.select(line, "source", received), [line, "source"], [received])
    active = by_source.finish(by_source.running_max(active, {"_session": c("session")}, inclusive=False))
    old = active.filter(c("session") < c("_session")).select(*names, F.lit("OLD_SESSION").alias("gate_reason"))
    begins = (
        F.when(starts, F.when(c("_nth") == 1, "FIRST_SOURCE").otherwise("NEW_SOURCE")).otherwise("NEW_SESSION")
    )
    current = active.filter(~F.coalesce(c("session") < c("_session"), F.lit(False))).select(*names, begins.alias("gate_reason"))
    schema = ", ".join(f"{n} {t}" for n, t in frames.dtypes) + ", gate_reason string"
    followed = ordered_fold(current, [line, "source", "session"], [received], _SessionOrder, schema)
    refused = rows.filter(c("_problem").isNotNull()).select(*names, c("_problem").alias("gate_reason"))
    found = followed.unionByName(old).unionByName(retired).unionByName(refused)
    resets = c("gate_reason").isin("FIRST_SOURCE", "NEW_SOURCE", "NEW_SESSION")
    return found.withColumns({"accepted": resets | (c("gate_reason") == "IN_ORDER"), "reset": resets})
