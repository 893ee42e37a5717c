"""Forward speed from error curves.

A curve holds the matching error of every shift of the scene by 5 cm between two frames. What a single
curve says is worked out for all its shifts at once (:class:`Curve`); what several frames say together
is kept in three small counters (:class:`SpeedTracker`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STEP_M = 0.05
# Limits of the speed estimate.
MAX_ACCELERATION, STANDSTILL_SHARE, MIN_UNIQUENESS, LOW_SPEED = 2.0, 0.6, 1.5, 2.0
ESCAPE_FRAMES, CONFIRM_FRAMES, HOLD_S, FORGET_S, GAIN = 25, 3, 5.0, 10.0, 0.5
LEAST_KNOWN, NEAR_SHIFTS = 4, 3


@dataclass(frozen=True)
class Curve:
    """Per shift: depth below the median error, and three verdicts on it."""

    depth: np.ndarray
    clear: np.ndarray  # deep enough to be read
    moving: np.ndarray  # clear, and not the shallow dip at zero of a scene without structure
    alone: np.ndarray  # no separate dip is nearly as deep

    @classmethod
    def of(cls, errors: np.ndarray, min_contrast: float) -> Curve:
        shifts = np.arange(len(errors))
        finite = np.isfinite(errors)
        if finite.sum() < LEAST_KNOWN:
            never = np.zeros(len(errors), bool)
            return cls(-errors, never, never, never)
        median = np.partition(errors[finite], finite.sum() // 2)[finite.sum() // 2]
        depth = median - errors
        clear = depth >= min_contrast
        standing = errors[0] <= STANDSTILL_SHARE * median
        first, last, value = dips(errors)
        apart = (first[:, None] > shifts + NEAR_SHIFTS) | (last[:, None] < shifts - NEAR_SHIFTS)
        rival = np.where(apart, (median - value)[:, None], 0.0).max(0, initial=0.0)
        return cls(depth, clear, clear & (standing | (shifts > 1)), depth >= MIN_UNIQUENESS * rival)

    @property
    def deepest(self) -> int:
        return int(self.depth.argmax())

    def within(self, low: float, high: float, verdict: np.ndarray) -> int | None:
        """Deepest shift of a range, if the verdict on it is good."""
        a, b = int(max(0.0, np.floor(low))), int(min(len(self.depth) - 1, np.ceil(high)))
        if a > b:
            return None
        best = a + int(self.depth[a : b + 1].argmax())
        return best if verdict[best] else None


def dips(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the curve, lowered to the least of three neighbours, that are below both sides."""
    padded = np.pad(errors, 1, constant_values=np.inf)
    low = np.lib.stride_tricks.sliding_window_view(padded, 3).min(1)
    begin = np.concatenate([[True], low[1:] != low[:-1]])
    first = np.flatnonzero(begin)
    last = np.concatenate([first[1:], [len(low)]]) - 1
    value = low[first]
    around = np.pad(value, 1, constant_values=np.inf)
    dip = np.isfinite(value) & (value < around[:-2]) & (value < around[2:])
    return first[dip], last[dip], value[dip]


@dataclass
class Streak:
    """Frames in a row that tell about the same speed."""

    speed: float = 0.0
    frames: int = 0

    def tell(self, speed: float) -> int:
        self.frames = self.frames + 1 if abs(speed - self.speed) <= 1.0 else 1
        self.speed = speed
        return self.frames

    def end(self) -> None:
        self.frames = 0


@dataclass
class SpeedTracker:
    """A speed is taken up after some frames that agree, followed near its prediction, kept through gaps
    for a while, and given up for another one that stays the better reading long enough."""

    min_contrast: float
    speed: float = 0.0
    known: bool = False
    idle_s: float = 0.0  # since the last reading
    taking_up: Streak = field(default_factory=Streak)
    leaving: Streak = field(default_factory=Streak)

    def kept(self) -> list:
        """Everything that later frames depend on."""
        return [self.speed, self.known, self.idle_s, self.taking_up.speed, self.taking_up.frames, self.leaving.speed, self.leaving.frames]

    def resume(self, kept: list) -> None:
        self.speed, self.known, self.idle_s = kept[:3]
        self.taking_up, self.leaving = Streak(*kept[3:5]), Streak(*kept[5:])

    def update(self, errors, dt: float) -> tuple[bool, float]:
        """(valid, displacement in metres) of one frame; missing errors are infinite."""
        given = np.asarray(errors if errors is not None else [], dtype=float)
        if dt <= 0 or len(given) <= LEAST_KNOWN:
            return False, 0.0
        curve, per_shift = Curve.of(given, self.min_contrast), STEP_M / dt
        expected = self.speed * dt / STEP_M
        elsewhere = self._elsewhere(curve, expected, per_shift)
        verdict = curve.clear if self.known and self.speed < LOW_SPEED else curve.moving
        near = self._near(curve, expected, verdict)
        taken_up = self._taken_up(curve, near, expected, dt, verdict)
        if elsewhere is not None:
            self._restart(elsewhere)
            return True, elsewhere * dt
        if taken_up is not None:
            self._restart_reading(taken_up * per_shift)
        elif near is not None:
            self._follow(near * per_shift, dt, limited=verdict is curve.moving)
        else:
            return self._coast(dt)
        return True, self.speed * dt

    def _near(self, curve: Curve, expected: float, verdict: np.ndarray) -> int | None:
        if not self.known:
            return None
        centre = np.floor(expected + 0.5)
        return curve.within(centre - 2, centre + 2, verdict)

    def _elsewhere(self, curve: Curve, expected: float, per_shift: float) -> float | None:
        """A speed away from the prediction that has been the best reading for long."""
        best = curve.deepest
        if not self.known:
            return None
        if abs(best - expected) <= 2 or not (curve.moving[best] and curve.alone[best]):
            self.leaving.end()
            return None
        return best * per_shift if self.leaving.tell(best * per_shift) >= ESCAPE_FRAMES else None

    def _taken_up(self, curve: Curve, near: int | None, expected: float, dt: float, verdict: np.ndarray) -> int | None:
        """A shift to start from, once enough frames agree on its speed."""
        best, found = curve.deepest, None
        if near is None:
            if self.known:
                reach = 1 + np.ceil(MAX_ACCELERATION * (self.idle_s + dt) * dt / STEP_M)
                found = curve.within(expected - reach, expected + reach, verdict)
            else:
                found = curve.within(0, len(curve.depth) - 1, verdict)
            if found is not None and abs(found - best) > 1:
                found = None
        elif verdict is curve.clear and abs(best - near) > 1 and curve.depth[best] - curve.depth[near] > self.min_contrast:
            # A slow train's dip at zero may hide the one it moves to.
            found = best if verdict[best] else None
        if found is None or not curve.alone[found]:
            self.taking_up.end()
            return None
        if self.taking_up.tell(found * STEP_M / dt) < CONFIRM_FRAMES:
            return None
        self.taking_up.end()
        return found

    def _restart(self, speed: float) -> None:
        self._restart_reading(speed)
        self.taking_up.end()
        self.leaving.end()

    def _restart_reading(self, speed: float) -> None:
        self.speed, self.known, self.idle_s = speed, True, 0.0

    def _follow(self, measured: float, dt: float, limited: bool) -> None:
        if self.idle_s > 0:
            self._restart_reading(measured)
            return
        change, most = GAIN * (measured - self.speed), MAX_ACCELERATION * dt
        self.speed += float(np.clip(change, -most, most)) if limited else change

    def _coast(self, dt: float) -> tuple[bool, float]:
        if not self.known:
            return False, 0.0
        self.idle_s += dt
        self.known = self.idle_s <= FORGET_S
        kept = self.idle_s <= HOLD_S
        return kept, self.speed * dt if kept else 0.0
