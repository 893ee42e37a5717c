"""Ordered operations over groups of any length.

A plain ``Window.partitionBy(bag).orderBy(stamp)`` puts a whole bag into one task.  That is right
while every group is small, and ``SlicedOrder.fit`` measures it.  When one is not, groups are cut
into slices of their order column, the window runs per ``(group, slice)``, and what crosses a slice
edge is carried by a summary of one row per ``(group, slice)``.  Slice edges are literals found
once, so that a recomputed task sees the same cut.  The cut only decides where work is done: rows,
nulls and sums are the same with any edges or none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathclear.functions.settling import settle

SLICE = "_slice"
# Rows of a slice; a group of twice as many still sorts well inside one task.
SLICE_ROWS = 1_000_000
# Beyond this many edges a slice is found by search in an array instead of nested conditions.
NESTED = 64


def _between(column: Column, bounds: Sequence, first: int = 0) -> Column:
    """Number of bounds <= column, offset by ``first``; nulls sort first, so they are in slice ``first``."""
    if not bounds:
        return F.lit(first)
    if len(bounds) > NESTED:
        edges, steps = F.array(*[F.lit(b) for b in bounds]), [1]
        while steps[0] * 2 <= len(bounds):
            steps.insert(0, steps[0] * 2)
        found = F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda at, s: F.when(F.try_element_at(edges, at + s) <= column, at + s).otherwise(at),
        )
        return found + F.lit(first)
    mid = len(bounds) // 2
    return F.when(
        column >= F.lit(bounds[mid]), _between(column, bounds[mid + 1 :], first + mid + 1)
    ).otherwise(_between(column, bounds[:mid], first))


def slice_bounds(df: DataFrame, column: str, rows_per_slice: int = SLICE_ROWS) -> list:
    """Edges that split ``df`` into slices of about equal row count along ``column``.

    One pass over one column for the count and a sketch; as many slices as the rows need.  The
    sketch only places the cuts; it never enters a result.
    """
    rows = df.agg(F.count(column).alias("n")).first()["n"]
    slices = -(-rows // rows_per_slice)
    if slices < 2:
        return []
    grid = [i / slices for i in range(1, slices)]
    return sorted(set(df.agg(F.percentile_approx(column, grid, 10 * slices).alias("q")).first()["q"]))


class SlicedOrder:
    """Window operations for ``keys`` ordered by ``order``, cut on the first order column."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], bounds: Sequence, hot=False):
        self.keys, self.order, self.bounds = list(keys), list(order), list(bounds)
        self.parts = [*self.keys, SLICE] if self.bounds else self.keys
        self.hot = hot

    @classmethod
    def fit(cls, df: DataFrame, keys, order, group_rows=2 * SLICE_ROWS, rows_per_slice=SLICE_ROWS):
        """Slices for a measured table: none while its largest group fits a task.

        The edges are those of the large groups' own rows.
        """
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        large = sizes.filter(F.col("n") > group_rows).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        if large.isEmpty():
            return cls(keys, order, [])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        rows = df.join(large, same, "left_semi")
        return cls(keys, order, slice_bounds(rows, order[0], rows_per_slice), hot=True)

    def cut(self, df: DataFrame) -> DataFrame:
        """Adds the slice column.

        Summaries read their input a second time; on a hot table the input is settled first, so a
        chain of operations reads it a fixed number of times instead of twice per link.
        """
        if not self.bounds or SLICE in df.columns:
            return df
        sliced = df.withColumn(SLICE, _between(F.col(self.order[0]), self.bounds))
        return settle(sliced) if self.hot else sliced

    def local(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def _slices(self):
        """Window over the slice summaries of a group (one row for each million of its rows)."""
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def _edge(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def _attach(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """By null-safe keys: rows without a key are a group as well."""
        other = summary.select(*[
            F.col(c).alias(f"_p_{c}") if c in self.parts else F.col(c) for c in summary.columns
        ])
        same = F.lit(True)
        for c in self.parts:
            same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
        return df.join(other, same, "left").drop(*[f"_p_{c}" for c in self.parts])

    def _next_pass(self, df: DataFrame) -> DataFrame:
        return settle(df) if self.hot and SLICE in df.columns else self.cut(df)

    def running_sum(self, df, sums: Mapping[str, Column], totals: Mapping[str, str] | None = None):
        """Inclusive running sums; ``totals`` names columns for the whole group's sum."""
        df, totals = self._next_pass(df), totals or {}
        upto = self.local().rowsBetween(Window.unboundedPreceding, 0)
        if not self.bounds:
            whole = Window.partitionBy(*self.keys)
            return df.withColumns({
                **{n: F.sum(e).over(upto) for n, e in sums.items()},
                **{t: F.sum(sums[n]).over(whole) for n, t in totals.items()},
            })
        summary = df.groupBy(*self.parts).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
        before = self._slices().rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.keys)
        summary = summary.select(
            *self.parts,
            *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.sum(f"_t_{n}").over(whole).alias(t) for n, t in totals.items()],
        )
        df = df.withColumns({n: F.sum(e).over(upto) for n, e in sums.items()})
        df = self._attach(df, summary)
        # Null only while no value has come, here as without slices.
        df = df.withColumns(
            {n: F.coalesce(F.col(n) + F.col(f"_c_{n}"), F.col(n), F.col(f"_c_{n}")) for n in sums}
        )
        return df.drop(*[f"_c_{n}" for n in sums])

    def running_max(self, df, values: Mapping[str, Column], inclusive: bool = True):
        """Largest value up to each row (or strictly before it); null while there is none."""
        df = self._next_pass(df)
        upto = self.local().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        found = df.withColumns({n: F.max(e).over(upto) for n, e in values.items()})
        if not self.bounds:
            return found
        summary = df.groupBy(*self.parts).agg(*[F.max(e).alias(f"_t_{n}") for n, e in values.items()])
        before = self._slices().rowsBetween(Window.unboundedPreceding, -1)
        summary = summary.select(*self.parts, *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in values])
        found = self._attach(found, summary)
        return found.withColumns({n: F.greatest(n, f"_c_{n}") for n in values}).drop(*[f"_c_{n}" for n in values])

    def last_known(self, df, values: Mapping[str, Column], inclusive: bool = True):
        """Last non-null value at or before (or strictly before) each row."""
        return self._fill(df, values, forward=True, inclusive=inclusive)

    def next_known(self, df, values: Mapping[str, Column], inclusive: bool = True):
        """First non-null value at or after (or strictly after) each row."""
        return self._fill(df, values, forward=False, inclusive=inclusive)

    def _fill(self, df, values, forward, inclusive):
        df = self._next_pass(df)
        # Both directions read backwards: a frame that ends at the current row grows by one row at
        # a time, one that starts there is rebuilt for every row.
        frame = (Window.unboundedPreceding, 0 if inclusive else -1)
        turn = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
        inside = Window.partitionBy(*self.parts).orderBy(*[turn(c) for c in self.order])
        inside = inside.rowsBetween(*frame)
        df_filled = df.withColumns(
            {n: F.last(e, ignorenulls=True).over(inside) for n, e in values.items()}
        )
        if not self.bounds:
            return df_filled
        edge = F.max_by if forward else F.min_by
        summary = df.groupBy(*self.parts).agg(
            *[
                edge(e, F.when(e.isNotNull(), self._edge())).alias(f"_t_{n}")
                for n, e in values.items()
            ]
        )
        across = Window.partitionBy(*self.keys).orderBy(turn(SLICE)).rowsBetween(
            Window.unboundedPreceding, -1
        )
        summary = summary.select(
            *self.parts,
            *[F.last(f"_t_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values],
        )
        df = self._attach(df_filled, summary)
        df = df.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in values})
        return df.drop(*[f"_c_{n}" for n in values])

    def _beyond(self, df, wrapped: Column, count: int, following: bool):
        """Per slice: ``_far``, up to ``count`` values of the rows before (after) it, in order."""
        edge = [F.col(c).asc() if following else F.col(c).desc() for c in self.order]
        rank = F.row_number().over(Window.partitionBy(*self.parts).orderBy(*edge))
        tails = (
            df.select(*self.parts, *[c for c in self.order if c not in self.parts],
                      wrapped.alias("_v"), rank.alias("_r"))
            .filter(F.col("_r") <= count)
            .groupBy(*self.parts)
            .agg(F.sort_array(F.collect_list(F.struct(self._edge().alias("o"), "_v"))).alias("_t"))
            .select(*self.parts, F.transform("_t", lambda t: t["_v"]).alias("_t"))
        )
        far = (1, Window.unboundedFollowing) if following else (Window.unboundedPreceding, -1)
        gathered = F.flatten(F.collect_list("_t").over(self._slices().rowsBetween(*far)))
        kept = (
            F.slice(gathered, 1, count)
            if following
            else F.reverse(F.slice(F.reverse(gathered), 1, count))
        )
        return tails.select(*self.parts, kept.alias("_far"))

    def neighbours(self, df, name: str, value: Column, count: int = 1, following: bool = False):
        """Array of up to ``count`` (<= 32) values of the rows before (after) each row.

        The nearest row is the last (first) element; every element is wrapped as ``struct<v>`` so
        that nulls survive.
        """
        df = self._next_pass(df)
        wrapped = F.struct(value.alias("v"))
        near = (1, count) if following else (-count, -1)
        beside = F.collect_list(wrapped).over(self.local().rowsBetween(*near))
        if not self.bounds:
            return df.withColumn(name, beside)
        tails = self._beyond(df, wrapped, count, following).withColumnRenamed("_far", "_c")
        df = df.withColumn(name, beside)
        df = self._attach(df, tails)
        carried = F.coalesce(F.col("_c"), F.array().cast(df.schema[name].dataType))
        if following:
            joined = F.slice(F.concat(F.col(name), carried), 1, count)
        else:
            joined = F.reverse(F.slice(F.reverse(F.concat(carried, F.col(name))), 1, count))
        return df.withColumn(name, joined).drop("_c")

    def around(self, df, name: str, value: Column, count: int):
        """Columns ``name_-1`` to ``name_-count`` and ``name_1`` to ``name_count``: the value so many rows before (after).

        Each is wrapped as ``struct<v>``; null where there is no such row.
        """
        df = self._next_pass(df)
        wrapped = F.struct(value.alias("v"))
        at = self.local()
        near = {f"{name}_{-i}": F.lag(wrapped, i).over(at) for i in range(1, count + 1)}
        near |= {f"{name}_{i}": F.lead(wrapped, i).over(at) for i in range(1, count + 1)}
        if not self.bounds:
            return df.withColumns(near)
        before = self._beyond(df, wrapped, count, False).select(*self.parts, F.reverse("_far").alias("_before"))
        after = self._beyond(df, wrapped, count, True).withColumnRenamed("_far", "_after")
        df = self._attach(self._attach(df.withColumns(near), before), after)
        filled = {}
        for sign, far in ((-1, "_before"), (1, "_after")):
            # A slice with fewer rows on this side goes on in the rows beyond it.
            inside = sum((F.col(f"{name}_{sign * i}").isNotNull().cast("int") for i in range(1, count + 1)), F.lit(0))
            for i in range(1, count + 1):
                filled[f"{name}_{sign * i}"] = F.coalesce(f"{name}_{sign * i}", F.get(far, i - 1 - inside))
        return df.withColumns(filled).drop("_before", "_after")

    def lag(self, df, name: str, value: Column, back: int = 1):
        if not self.bounds:
            return df.withColumn(name, F.lag(value, back).over(self.local()))
        df = self.neighbours(df, name, value, back)
        return df.withColumn(name, F.try_element_at(name, F.lit(-back))["v"])

    def lead(self, df, name: str, value: Column, ahead: int = 1):
        if not self.bounds:
            return df.withColumn(name, F.lead(value, ahead).over(self.local()))
        df = self.neighbours(df, name, value, ahead, following=True)
        return df.withColumn(name, F.try_element_at(name, F.lit(ahead))["v"])

    def islands(self, df, gap, sums: Mapping[str, Column] | None = None):
        """Gaps and islands: rows of a group whose order steps are <= ``gap`` form one island.

        Returns one row per island with ``island`` (1-based), ``start``, ``end``, ``rows`` and the
        requested sums.  Islands are first built inside slices; only the slice summaries are then
        looked at across slices.
        """
        at = self.order[0]
        tagged = self.tag_islands_locally(self._next_pass(df), gap)
        sums = sums or {}
        parts = tagged.groupBy(*self.parts, "_isl").agg(
            F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("rows"),
            *[F.sum(e).alias(n) for n, e in sums.items()],
        )
        if not self.bounds:
            return parts.withColumnRenamed("_isl", "island")
        shifted = self._number(parts, gap)
        return shifted.groupBy(*self.keys, "island").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows").alias("rows"),
            *[F.sum(n).alias(n) for n in sums],
        )

    def tag_islands_locally(self, df, gap):
        at = self.order[0]
        step = F.col(at) - F.lag(at).over(self.local())
        df = df.withColumn("_new", F.when(step <= gap, 0).otherwise(1))
        upto = self.local().rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_isl", F.sum("_new").over(upto)).drop("_new")

    def _number(self, parts, gap):
        """Global island numbers from slice-local ones."""
        before = self._slices().rowsBetween(Window.unboundedPreceding, -1)
        edges = parts.groupBy(*self.parts).agg(
            F.min("start").alias("_lo"), F.max("end").alias("_hi"), F.max("_isl").alias("_n")
        )
        joins = F.when(F.col("_lo") - F.lag("_hi").over(self._slices()) <= gap, 1).otherwise(0)
        edges = edges.select(*self.parts, "_n", joins.alias("_j"))
        shift = F.coalesce(F.sum(F.col("_n") - F.col("_j")).over(before), F.lit(0)) - F.col("_j")
        edges = edges.select(*self.parts, shift.alias("_shift"))
        return self._attach(parts, edges).withColumn(
            "island", (F.col("_isl") + F.col("_shift")).cast("long")
        )

    def tag_islands(self, df, gap, name="island"):
        """Every row with its island number."""
        at = self.order[0]
        tagged = self.tag_islands_locally(self._next_pass(df), gap)
        if not self.bounds:
            return tagged.withColumnRenamed("_isl", name)
        edges = tagged.groupBy(*self.parts, "_isl").agg(
            F.min(at).alias("start"), F.max(at).alias("end")
        )
        numbers = self._number(edges, gap).select(
            *self.parts, "_isl", F.col("island").alias(name)
        )
        wide = SlicedOrder([*self.keys, "_isl"], self.order, self.bounds)
        return wide._attach(tagged, numbers).drop("_isl")

    def finish(self, df):
        return df.drop(SLICE)
