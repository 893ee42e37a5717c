"""Online decisions: analysed frames in, assessments out, with a watchdog.

One state per ``line`` (a vehicle or a monitor): the order gate, the tracks and the last result.
The batch fold steps the same ``Monitor``, so both give the same decisions.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pathclear.config import TemporalConfig
from pathclear.operators.tracking import Monitor, OrderGate
from pathclear.schemas import ASSESSMENT

OUTPUT = f"line string, {ASSESSMENT}, stale boolean, gate_reason string, result_age_ms double, rejected long"
_NAMES = ["source", "session", "frame_sequence", "measurement_time_ns"]


def _plain(value):
    """Arrow values as plain Python ones."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


class LineMonitor(StatefulProcessor):
    """Gate, tracks and staleness of one line."""

    def __init__(self, config: TemporalConfig, timeout_s: float = 0.5):
        self.config, self.timeout_ms = config, timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("line", "state string")

    def close(self) -> None:
        pass

    def _load(self):
        monitor, gate = Monitor(self.config), OrderGate()
        kept = {"rejected": 0, "age_ms": None, "last": None}
        if self.state.exists():
            saved = json.loads(self.state.get()[0])
            monitor.load(saved["monitor"])
            gate.load(saved["gate"])
            kept = saved["kept"]
        return monitor, gate, kept

    def _save(self, monitor, gate, kept):
        self.state.update((json.dumps({"monitor": monitor.dump(), "gate": gate.dump(), "kept": kept}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        monitor, gate, kept = self._load()
        frames = pd.concat(list(rows), ignore_index=True).sort_values("received", kind="stable")
        out = []
        for frame in frames.to_dict("records"):
            frame = {k: _plain(v) for k, v in frame.items()}
            age = frame["processing_age_ms"]
            stamp = frame["measurement_time_ns"]
            stamp = int(stamp) if stamp == stamp and stamp and stamp > 0 else None
            if age is None or not math.isfinite(age) or age < 0:
                accepted, reset, why = False, False, "INVALID_PROCESSING_AGE"
            else:
                accepted, reset, why = gate.admit(
                    frame["source"], frame["session"], frame["frame_sequence"], stamp
                )
            if not accepted:
                kept["rejected"] += 1
                continue
            if reset:
                monitor.reset()
            decision = monitor.step(frame)
            names = {k: frame[k] for k in _NAMES}
            kept.update(age_ms=age, last=names)
            out.append({
                "line": key[0], **names, **decision, "stale": False, "gate_reason": why,
                "result_age_ms": age, "rejected": kept["rejected"],
            })
        if out:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            left = max(0.0, self.timeout_ms - kept["age_ms"])
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(int((now if now > 0 else time.time() * 1000) + left) + 1)
        self._save(monitor, gate, kept)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _columns()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The result has grown too old: UNKNOWN, with the key of the last frame kept."""
        monitor, gate, kept = self._load()
        row = {
            "line": key[0], **(kept["last"] or dict.fromkeys(_NAMES)), "state": "UNKNOWN",
            "reason": "INPUT_PAUSED_OR_STOPPED", "distance_m": None, "distance_valid": False,
            "calibration_trust": "UNKNOWN", "tracks": [], "stale": True, "gate_reason": None,
            "result_age_ms": self.timeout_ms, "rejected": kept["rejected"],
        }
        yield pd.DataFrame([row], columns=[c.split()[0] for c in _columns()])


def _columns() -> list[str]:
    """Top-level ``name type`` parts of the output schema."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(OUTPUT):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(OUTPUT[start:i].strip())
            start = i + 1
    return [*parts, OUTPUT[start:].strip()]


def stream_decisions(analyses: DataFrame, config: TemporalConfig, timeout_s: float = 0.5) -> DataFrame:
    """Assessments of a stream of analyses (``ANALYSIS`` plus line, received, processing_age_ms)."""
    return analyses.groupBy("line").transformWithStateInPandas(
        statefulProcessor=LineMonitor(config, timeout_s), outputStructType=OUTPUT,
        outputMode="Append", timeMode="ProcessingTime",
    )


def fresh_latest(clouds: DataFrame, max_age_ms: float) -> DataFrame:
    """Latest-only slot of one trigger (use in foreachBatch): the newest cloud per source, if it is fresh.

    As in :func:`pathclear.operators.sequences.latest_only`, the age is looked at when the slot is taken.
    """
    names = [c for c in clouds.columns if c not in ("source", "received")]
    newest = clouds.groupBy("source").agg(
        F.max(F.struct("received", *names)).alias("n"), (F.count(F.lit(1)) - 1).alias("dropped")
    )
    return newest.filter(F.col("n.age_ms") <= max_age_ms).select("source", "n.*", "dropped")
