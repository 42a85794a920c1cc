"""Exact interpolated quantiles that never gather a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in the memory of one task.
That is right while the number of distinct values is small, which is checked first. Beyond it the
wanted order statistics are closed in on: a bounded sketch gives a lower and an upper value around
each rank, one counting scan finds how many values lie below and between them, and the gap
shrinks about a thousandfold per round until the few values left fit a short list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.columns import agg_row, chunks

# Distinct values of one column that ``percentile`` may hold, and of all columns of one scan.
MAX_DISTINCT = 200_000
MAX_DISTINCT_TOGETHER = 1_000_000
# Values left around a rank that are read as a list, and the accuracy of the sketches.
MAX_LIST = 10_000
SKETCH = 10_000


@dataclass
class _Rank:
    """One wanted order statistic: the ``k``-th smallest value, known to lie in [low, high]."""

    values: Column
    k: int
    total: int
    low: float | None = None
    high: float | None = None
    below: int = 0      # values before the gap
    gap: int = 0        # values strictly between low and high
    found: float | None = None

    def inside(self) -> Column:
        if self.low is None:
            return self.values
        return F.when((self.values > self.low) & (self.values < self.high), self.values)


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: list[float],
    max_distinct: int = MAX_DISTINCT,
    max_list: int = MAX_LIST,
    sketch: int = SKETCH,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each expression, NULLs skipped; ``None`` if all NULL."""
    if not values:
        return {}
    sizes = agg_row(df, {
        (n, kind): f(v) for n, v in values.items()
        for kind, f in (("count", F.count), ("distinct", F.approx_count_distinct))
    })
    out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in values}
    small = [n for n in values if sizes[n, "distinct"] <= max_distinct]
    for part in _together(small, {n: sizes[n, "distinct"] for n in small}):
        row = agg_row(df, {n: F.percentile(values[n], F.array(*map(F.lit, probs))) for n in part})
        out.update({n: list(row[n]) for n in part if row[n] is not None})
    large = {n: (v, sizes[n, "count"]) for n, v in values.items() if n not in small}
    out.update(_interpolated(df, large, probs, max_list, sketch))
    return out


def _together(names: list[str], distinct: dict[str, int]) -> list[list[str]]:
    """Groups of columns whose value lists fit one task side by side."""
    groups: list[list[str]] = []
    room = 0
    for n in names:
        if not groups or distinct[n] > room:
            groups.append([])
            room = MAX_DISTINCT_TOGETHER
        groups[-1].append(n)
        room -= distinct[n]
    return groups


def _interpolated(
    df: DataFrame, columns: dict, probs: list[float], max_list: int, sketch: int
) -> dict[object, list[float]]:
    """Quantiles of (expression, number of values) pairs; all columns share every scan."""
    ranks: dict = {}
    for name, (values, total) in columns.items():
        for p in probs:
            x = p * (total - 1)
            for k in (math.floor(x), math.ceil(x)):
                ranks.setdefault((name, k), _Rank(values, k, total))
    _close_in(df, list(ranks.values()), max_list, sketch)
    out = {}
    for name, (_, total) in columns.items():
        out[name] = []
        for p in probs:
            x = p * (total - 1)
            low, high = ranks[name, math.floor(x)].found, ranks[name, math.ceil(x)].found
            out[name].append(low + (high - low) * (x - math.floor(x)))
    return out


def _close_in(df: DataFrame, ranks: list[_Rank], max_list: int, sketch: int) -> None:
    for r in ranks:
        r.gap = r.total
    wide = 1
    while open_ranks := [r for r in ranks if r.found is None and r.gap > max_list]:
        # 1. Values a safe number of ranks before and after the wanted one.
        margin = 2.0 * wide / sketch
        def probes(r: _Rank) -> Column:
            at = (r.k - r.below + 0.5) / r.gap
            ends = [max(0.0, at - margin), min(1.0, at + margin)]
            return F.percentile_approx(r.inside(), F.array(*map(F.lit, ends)), F.lit(sketch))
        ends = agg_row(df, {i: probes(r) for i, r in enumerate(open_ranks)})
        # 2. How many values lie before, on and between them.
        counts = {}
        for i, r in enumerate(open_ranks):
            low, high = ends[i]
            counts[i, "below"] = F.count_if(r.values < low)
            counts[i, "low"] = F.count_if(r.values == low)
            counts[i, "gap"] = F.count_if((r.values > low) & (r.values < high))
            counts[i, "high"] = F.count_if(r.values == high)
        seen = agg_row(df, counts)
        missed = False
        for i, r in enumerate(open_ranks):
            low, high = ends[i]
            first = seen[i, "below"]
            gap_start = first + seen[i, "low"]
            high_start = gap_start + (seen[i, "gap"] if high > low else 0)
            if first <= r.k < gap_start:
                r.found = low
            elif gap_start <= r.k < high_start:
                r.low, r.high, r.below, r.gap = low, high, gap_start, seen[i, "gap"]
            elif high > low and high_start <= r.k < high_start + seen[i, "high"]:
                r.found = high
            else:
                missed = True  # the sketch was off by more than it promises: look wider
        wide = wide * 4 if missed else 1
    # 3. The short lists that are left.
    rest = [r for r in ranks if r.found is None]
    for part in chunks(rest, 50):
        lists = agg_row(df, {
            i: F.sort_array(F.collect_list(r.inside()))[r.k - r.below] for i, r in enumerate(part)
        })
        for i, r in enumerate(part):
            r.found = lists[i]


def grouped_quantiles(
    df: DataFrame,
    key: Column,
    values: Column,
    probs: list[float],
    max_distinct: int = MAX_DISTINCT,
    **limits,
) -> DataFrame:
    """(key, n, q) per group: the number of values and the array of exact quantiles.

    Groups with few distinct values use ``percentile``; the large ones (each holds more than
    ``max_distinct`` values, so they are few) are closed in on as if each were a column.
    """
    spark = df.sparkSession
    pairs = df.select(key.alias("key"), values.alias("v"))
    sizes = pairs.groupBy("key").agg(
        F.count("v").alias("n"), F.approx_count_distinct("v").alias("d")
    )
    large = sizes.where(F.col("d") > max_distinct).collect()
    is_large = F.lit(False)
    for r in large:
        is_large = is_large | F.col("key").eqNullSafe(F.lit(r["key"]))
    out = (
        pairs.where(~is_large).groupBy("key")
        .agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    )
    columns = {
        i: (F.when(F.col("key").eqNullSafe(F.lit(r["key"])), F.col("v")), r["n"])
        for i, r in enumerate(large)
    }
    found = _interpolated(
        pairs, columns, probs, limits.get("max_list", MAX_LIST), limits.get("sketch", SKETCH)
    )
    rows = [(r["key"], r["n"], found[i]) for i, r in enumerate(large)]
    return out.unionByName(spark.createDataFrame(rows, out.schema)) if rows else out
