"""Exact order statistics without gathering a group.

Values are first counted per distinct value (combined map-side), then a sliced running count finds
the value at each wanted rank.  Five rank rules are in use and must not be mixed up.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathclear.functions.ordering import SlicedOrder, slice_bounds


def upper_median(n: Column) -> Column:
    """Zero-based rank ``n div 2``."""
    return F.floor(n / 2)


def ninth_tenth_inclusive(n: Column) -> Column:
    """Zero-based rank ``9 (n - 1) div 10``."""
    return F.floor((n - 1) * 9 / 10)


def ninth_tenth(n: Column) -> Column:
    """Zero-based rank ``9 n div 10``."""
    return F.floor(n * 9 / 10)


def truncated(share: float):
    """Zero-based rank ``int(share (n - 1))``."""
    return lambda n: F.floor(F.lit(share) * (n - 1))


def rank_values(
    df: DataFrame, keys: list[str], value: str, ranks: Mapping[str, object], bounds=None,
    weight: str | None = None,
) -> DataFrame:
    """Per group: the value at each zero-based rank (a function of the group size) and ``n``.

    ``ranks`` maps output names to functions of the row count.  Null values are ignored; a row
    counts ``weight`` times.
    """
    known = df.filter(F.col(value).isNotNull())
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counts = known.groupBy(*keys, value).agg(times.alias("_count"))
    if bounds is None:
        bounds = slice_bounds(known, value)
    order = SlicedOrder(keys, [value], bounds)
    counts = order.running_sum(counts, {"_upto": F.col("_count")}, totals={"_upto": "_n"})
    picks = []
    for name, rank in ranks.items():
        r = rank(F.col("_n"))
        hit = (F.col("_upto") - F.col("_count") <= r) & (r < F.col("_upto"))
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return counts.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)


def linear_percentiles(
    df: DataFrame, keys: list[str], value: str, shares: Mapping[str, float], bounds=None,
    weight: str | None = None,
) -> DataFrame:
    """Percentiles with linear interpolation between the two neighbouring ranks."""
    ranks = {}
    for name, share in shares.items():
        ranks[f"_lo_{name}"] = lambda n, s=share: F.floor(F.lit(s) * (n - 1))
        ranks[f"_hi_{name}"] = lambda n, s=share: F.ceil(F.lit(s) * (n - 1))
    found = rank_values(df, keys, value, ranks, bounds, weight)
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, "n", *out)


def array_rank(values: Column, rank: Column) -> Column:
    """Value at a zero-based rank of a bounded array (a frame, a grid row)."""
    return F.get(F.array_sort(values), rank.cast("int"))


def array_upper_median(values: Column) -> Column:
    return array_rank(values, F.floor(F.size(values) / 2))
