"""Order-dependent steps over chains of frames.

Where a step forgets what was before at some frames, it is a set of running counts (:func:`hold_floors`) and
needs no fold. Where it keeps real numbers, :func:`carried_fold` cuts a chain into slices that run side by side
and hands states over their edges until they agree. :func:`ordered_fold` follows a chain that its caller has
already cut at resets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pathclear.functions.ordering import SlicedOrder
from pathclear.functions.settling import settle
from pathclear.operators.speed import SpeedTracker

# Failures in a row that reset the detector are more than these; least length of a usable floor.
MAX_FAILURES, MIN_END_X = 5, 25.0
#: Frames of a slice of a carried fold.
SLICE_FRAMES = 2000


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable], schema: str
) -> DataFrame:
    """Runs ``step(row) -> row`` over every chain in order; ``start`` makes a fresh step."""
    chained = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        chain, step = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if step is None or key != chain:
                    chain, step = key, start()
                out.append(step(row))
            yield pd.DataFrame(out)

    return chained.mapInPandas(run, schema)


def hold_floors(rows: DataFrame, keys: list[str], order: list[str], hold_frames: int, sliced: SlicedOrder | None = None) -> DataFrame:
    """Keeps the last floor for a few frames and counts geometry failures, by running counts alone.

    ``rows``: floor ``a, b, c, end_x``, ``floor_valid`` and ``detection_point_count``. Adds ``held``,
    ``geometry_reason`` (null for frames that can be analysed) and ``life``, which grows where too many failures
    in a row reset the detector; held frames get the kept floor.

    A frame with a floor of its own sets everything back, so what follows depends only on counts since
    then: the first ``hold_frames`` frames without one are held, unless a whole run of failures came before.
    """
    sliced = sliced or SlicedOrder.fit(rows, keys, order)
    streak = MAX_FAILURES + 1
    n, kept = F.col("_n"), F.col("_kept")
    seen = F.col("detection_point_count") > 0
    usable = F.coalesce(F.col("floor_valid") & (F.col("end_x") >= MIN_END_X), F.lit(False))
    fresh, lost = usable & seen, ~usable & seen
    df = sliced.running_sum(rows, {"_n": F.lit(1), "_lost": lost.cast("int")})
    df = sliced.last_known(df, {"_kept": F.when(fresh, F.struct("a", "b", "c", "end_x", n.alias("n"), F.col("_lost").alias("lost")))})
    may = F.coalesce(lost & (F.col("_lost") - kept["lost"] <= hold_frames), F.lit(False))
    df = sliced.last_known(df, {"_passed": F.when(fresh | may, n)})
    whole = n - F.coalesce("_passed", F.lit(0)) == streak
    df = sliced.running_sum(df, {"_runs": whole.cast("int")})
    df = sliced.last_known(df, {"_before": F.when(fresh, F.col("_runs"))})
    first = whole & (F.col("_runs") - F.coalesce("_before", F.lit(0)) == 1)
    df = sliced.last_known(df, {"_forgot": F.when(first, n)})
    # Where the kept floor is forgotten, if it is before this frame; from there on all frames fail.
    forgot = F.when(F.col("_forgot") > F.coalesce(kept["n"], F.lit(0)), F.col("_forgot"))
    df = df.withColumn("held", may & F.coalesce(n <= forgot, F.lit(True)))
    ends = F.coalesce((n - forgot) % streak == 0, F.lit(False)).cast("int")
    df = sliced.running_sum(df.withColumn("_ends", ends), {"_lives": F.col("_ends")})
    reason = F.when(F.col("floor_valid"), "CORRIDOR_UNOBSERVABLE").otherwise("GROUND_UNSUPPORTED")
    df = df.withColumns({
        "life": (F.col("_lives") - F.col("_ends")).cast("int"),
        "geometry_reason": F.when(~fresh & ~F.col("held"), reason),
    }).withColumns({c: F.when(F.col("held"), kept[c]).otherwise(F.col(c)) for c in ("a", "b", "c", "end_x")})
    return sliced.finish(df).drop("_n", "_lost", "_kept", "_passed", "_runs", "_before", "_forgot", "_ends", "_lives")


def _same(keys: list[str]):
    """Null-safe equality of ``keys`` with their copies under ``_k_``."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return same


def _copies(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *more)


def carried_fold(
    df: DataFrame, keys: list[str], order: list[str], reads: list[str], start: Callable[[str | None], Callable],
    returns: Mapping[str, str], slice_rows: int = SLICE_FRAMES, rounds: list[int] | None = None,
    sliced: SlicedOrder | None = None,
) -> DataFrame:
    """Adds ``returns`` (names and types), made by ``step(*reads)`` in the order of a chain.

    ``start(state)`` makes a step that goes on from a state, or afresh from None; ``step.state()`` is its state as
    text. A chain longer than ``slice_rows`` is cut into slices of that many rows. Each runs from a fresh state
    first; then every slice whose predecessor ended in another state than it started from runs again from that
    one, until none is left. So the rows are those of one run over the chain whatever the cut, and a step that
    soon forgets its past, as a tracker that follows readings does, takes two or three rounds. ``rounds`` gets
    the number of slices of each round; ``sliced`` saves measuring the chains again.
    """
    sliced = sliced or SlicedOrder.fit(df, keys, order)
    placed = sliced.finish(sliced.running_sum(df, {"_place": F.lit(1)}))
    rows = settle(placed.withColumn("_cut", F.expr(f"(_place - 1) div {slice_rows}")).drop("_place"))
    cut = [*keys, "_cut"]
    parts = rows.groupBy(*cut).agg(F.count(F.lit(1)).alias("_rows"))
    starts = parts.filter("_cut > 0").limit(1)
    if starts.isEmpty():
        states = None
    else:
        states = _edges(rows, parts, keys, order, reads, start, rounds)
    given = rows.withColumn("_state", F.lit(None).cast("string")) if states is None else rows.join(
        _copies(states, cut, "_state"), _same(cut), "left").drop(*[f"_k_{k}" for k in cut])
    kept = [f for f in rows.schema if f.name != "_cut"]
    made = StructType.fromDDL(", ".join(f"`{k}` {t}" for k, t in returns.items()))
    types = [f.type for f in to_arrow_schema(made)]

    def kernel(batches):
        part, step = (), None
        for batch in batches:
            out = []
            for at, values, state in _rows(batch, cut, reads):
                if at != part:
                    part, step = at, start(state)
                out.append(step(*values))
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[*(f.name for f in kept), *returns])

    schema = StructType([*kept, *made])
    return given.repartition(*cut).sortWithinPartitions(*cut, *order).mapInArrow(kernel, schema)


def _rows(batch: pa.RecordBatch, cut: list[str], reads: list[str]):
    at = zip(*(batch.column(c).to_pylist() for c in cut), strict=True)
    values = zip(*(batch.column(c).to_pylist() for c in reads), strict=True)
    return zip(at, values, batch.column("_state").to_pylist(), strict=True)


def _edges(rows, parts, keys, order, reads, start, rounds) -> DataFrame:
    """State that every slice of the chains with several starts from."""
    cut = [*keys, "_cut"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cut).schema)
    long = parts.filter("_cut > 0").select(*keys).distinct()
    wanted = rows.join(_copies(long, keys), _same(keys), "left_semi").select(*dict.fromkeys([*cut, *order, *reads]))
    wanted = settle(wanted)

    def kernel(batches):
        part, step = (), None
        for batch in batches:
            ended = []
            for at, values, state in _rows(batch, cut, reads):
                if at != part:
                    if step is not None:
                        ended.append((*part, step.state()))
                    part, step = at, start(state)
                step(*values)
            yield written(ended)
        yield written([(*part, step.state())] if step is not None else [])

    fields = to_arrow_schema(StructType([*rows.select(*cut).schema, *StructType.fromDDL("_end string")]))

    def written(ended):
        columns = zip(*ended, strict=True) if ended else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(started: DataFrame) -> DataFrame:
        given = wanted.join(_copies(started, cut, "_state"), _same(cut)).drop(*[f"_k_{k}" for k in cut])
        return given.repartition(*cut).sortWithinPartitions(*cut, *order).mapInArrow(kernel, f"{kinds}, _end string")

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return settle(old.join(_copies(new, cut), _same(cut), "left_anti").unionByName(new))

    used = settle(wanted.select(*cut).distinct().withColumn("_state", F.lit(None).cast("string")))
    ends, changed = None, used
    while True:
        if rounds is not None:
            rounds.append(changed.count())
        made = settle(run(changed))
        ends = made if ends is None else replaced(ends, made)
        after = ends.withColumn("_cut", F.col("_cut") + 1).select(*[F.col(c).alias(f"_k_{c}") for c in cut], F.col("_end"))
        changed = settle(used.join(after, _same(cut)).filter(~F.col("_state").eqNullSafe(F.col("_end"))).select(
            *cut, F.col("_end").alias("_state")))
        if changed.isEmpty():
            return used
        used = replaced(used, changed)


class SpeedStep:
    """Speed of one frame after another: (valid, displacement, speed kept)."""

    def __init__(self, state: str | None, min_contrast: float):
        self.tracker = SpeedTracker(min_contrast)
        if state is not None:
            self.tracker.resume(json.loads(state))

    def state(self) -> str:
        return json.dumps(self.tracker.kept())

    def __call__(self, errors, dt) -> tuple[bool, float, float]:
        if errors is not None:
            errors = [float("inf") if v is None or v != v else v for v in errors]
        valid, moved = self.tracker.update(errors, float(dt or 0.0))
        return valid, moved, self.tracker.speed


class MotionStep:
    """Speed and the smoothed route: (valid, displacement, speed kept, c0, c1, c2)."""

    def __init__(self, state: str | None, min_contrast: float, smoothing: float):
        speed, self.route = (None, None) if state is None else json.loads(state)
        self.speed, self.smoothing = SpeedStep(speed, min_contrast), smoothing

    def state(self) -> str:
        return json.dumps([self.speed.state(), self.route])

    def __call__(self, motion, errors, dt, route_valid, *raw) -> tuple:
        moved = self.speed(errors, dt) if motion else (False, 0.0, self.speed.tracker.speed)
        smooth = raw
        if route_valid and self.route and self.smoothing > 0:
            w = self.smoothing
            smooth = tuple(w * p + (1 - w) * q for p, q in zip(self.route, raw, strict=True))
        self.route = list(smooth) if route_valid else None
        return (*moved, *smooth)


def speed_track(rows: DataFrame, keys: list[str], order: list[str], min_contrast: float, slice_rows: int = SLICE_FRAMES,
                rounds: list[int] | None = None) -> DataFrame:
    """Adds ``valid``, ``moved_m`` and ``speed_mps`` from the error curves ``errors`` and steps ``dt_s`` of each chain."""
    return carried_fold(
        rows, keys, order, ["errors", "dt_s"], lambda state: SpeedStep(state, min_contrast),
        {"valid": "boolean", "moved_m": "double", "speed_mps": "double"}, slice_rows, rounds)


def motion_and_route(inputs: DataFrame, keys: list[str], order: list[str], min_contrast: float, smoothing: float,
                     slice_rows: int = SLICE_FRAMES, sliced: SlicedOrder | None = None) -> DataFrame:
    """Speed, odometry and the smoothed route of all analysable frames.

    Only speed and route go through the fold; distance and epochs are running sums over its rows. Distances
    are added as decimals, so their sum is the same with any cut.
    """
    sliced = sliced or SlicedOrder.fit(inputs, keys, order)
    moved = carried_fold(
        inputs, keys, order, ["motion", "errors", "dt_s", "route_valid", "raw_c0", "raw_c1", "raw_c2"],
        lambda state: MotionStep(state, min_contrast, smoothing),
        {"ego_motion_valid": "boolean", "_moved": "double", "_speed": "double", "c0": "double", "c1": "double", "c2": "double"},
        slice_rows, sliced=sliced)
    good = F.col("ego_motion_valid")
    step = F.when(good, F.col("_moved")).otherwise(0.0).cast("decimal(24,15)")
    df = sliced.running_sum(moved, {"_way": step, "epoch": (F.col("motion") & ~good).cast("int")})
    df = sliced.last_known(df, {"_last": F.when(good, F.col("_speed"))})
    return sliced.finish(df).withColumns({
        "ego_speed_mps": F.when(good & (F.col("dt_s") > 0), F.col("_moved") / F.col("dt_s")).otherwise(0.0),
        "odometry_m": F.col("_way").cast("double"), "epoch": F.col("epoch").cast("int"),
        "stood_still": F.coalesce("_last", F.lit(0.0)) < 0.5,
    }).drop("errors", "motion", "dt_s", "_moved", "_speed", "_way", "_last")
