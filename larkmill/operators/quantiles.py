"""Exact quantiles without one task for all values: histograms of ranges, of which only the bins that hold the wanted ranks are refined."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a range, and values of a bin that is read out instead of being refined. Where many ranges are open, each has fewer of both: about MANY
#: in all, LEAST for each range.
BINS, READ, LEAST, MANY = 4096, 4096, 64, 32_768


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0 to bins - 1, never falling as x rises: each step of the sum is monotone. Halves keep the greatest doubles from overflowing."""
    share = (x / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    return F.coalesce(F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")


class _Wanted:
    """An order statistic of a column: rank (from 0) among the values of [lo, hi], of which `left` are there."""

    def __init__(self, column: int, rank: int, lo: float, hi: float, left: int):
        self.column, self.rank, self.lo, self.hi, self.left = column, rank, lo, hi, left
        self.value = lo if lo == hi else None
        self.told_apart = False  # holds neighbouring doubles only, which bins don't tell apart

    @property
    def range(self) -> tuple[int, float, float]:
        return self.column, self.lo, self.hi


def order_statistics(df: DataFrame, columns: list[str], ranks: dict[str, list[int]], counts: list[tuple]) -> dict[tuple[str, int], float]:
    """{(column, rank): value}. counts: for each column (finite values, least, greatest, values of minus infinity, of infinity)."""
    wanted, out = [], {}
    for i, (c, (n, least, most, below, above)) in enumerate(zip(columns, counts, strict=True)):
        for rank in sorted(set(ranks[c])):
            if rank < below:
                out[c, rank] = -math.inf
            elif rank < below + n:
                wanted.append((c, rank, _Wanted(i, rank - below, least, most, n)))
            else:
                out[c, rank] = math.inf if rank < below + n + above else math.nan
    long = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias("c", "x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    while todo := [w for *_, w in wanted if w.value is None]:
        ranges = sorted({w.range for w in todo})
        size = min(BINS, max(LEAST, MANY // len(ranges)))
        few = {w.range for w in todo if w.told_apart or w.left <= min(READ, size)}
        side = F.broadcast(df.sparkSession.createDataFrame([(*r, r in few) for r in ranges], "rc int, lo double, hi double, few boolean"))  # a row for each rank at most
        inside = long.join(side, (F.col("c") == F.col("rc")) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        # a bin small enough is told apart value by value
        place = F.when(F.col("few"), F.lit(-1)).otherwise(_bin(F.col("x"), F.col("lo"), F.col("hi"), size))
        key = F.when(F.col("few"), F.col("x"))
        bins = inside.groupBy("rc", "lo", "hi", place.alias("bin"), key.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        # of a range, only the bins in which a wanted rank falls come back
        found: dict[tuple, list] = {}
        for r in bins.collect():  # `size` bins or values for each open range
            found.setdefault((r["rc"], r["lo"], r["hi"]), []).append((r["a"], r["b"], r["n"]))
        for own in found.values():
            own.sort()
        for w in todo:
            rank = w.rank
            for a, b, n in found[w.range]:
                if rank < n:
                    w.told_apart = (a, b) == (w.lo, w.hi)  # too narrow for halves of its width
                    w.rank, w.lo, w.hi, w.left = rank, a, b, n
                    w.value = a if a == b else None
                    break
                rank -= n
    return out | {(c, rank): w.value for c, rank, w in wanted}


def _counted(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """{column: (values, finite values, least, greatest, values of minus infinity, of infinity)}"""
    double = {c: F.col(f"`{c}`").cast("double") for c in columns}
    inf = float("inf")
    finite = {c: ~F.isnan(x) & (F.abs(x) < inf) for c, x in double.items()}
    asked = []
    for i, c in enumerate(columns):
        x, ok = double[c], finite[c]
        asked += [F.count(x).alias(f"n{i}"), F.count(F.when(ok, x)).alias(f"f{i}"), F.min(F.when(ok, x)).alias(f"a{i}"), F.max(F.when(ok, x)).alias(f"b{i}"), F.count(F.when(x == -inf, x)).alias(f"l{i}"), F.count(F.when(x == inf, x)).alias(f"u{i}")]
    row = df.agg(*asked).first()
    return {c: tuple(row[f"{k}{i}"] for k in "nfablu") for i, c in enumerate(columns)}


def values_at(df: DataFrame, columns: list[str], ranks: Callable[[int], list[int]]) -> dict[str, list[float]]:
    """For each column, its values at ranks(number of its values), from 0, in order; nothing where it has no values. A function of the values
    alone: neither partitions nor the order of tasks matter."""
    counted = {c: x for c, x in _counted(df, columns).items() if x[0]}
    asked = {c: ranks(x[0]) for c, x in counted.items()}
    values = order_statistics(df, list(counted), asked, [x[1:] for x in counted.values()]) if counted else {}
    return {c: [values[c, r] for r in asked.get(c, [])] for c in columns}


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """For each column, the quantiles with linear interpolation, as exact as percentile(): nulls are left out, Not-a-Number is above all else,
    a column without values gives None.

    One pass counts and finds the range, each further one narrows it by BINS; a task never has more than partial counts of bins."""
    counted = _counted(df, columns)
    places = {c: [s * (x[0] - 1) for s in shares] for c, x in counted.items() if x[0]}
    if not places:
        return {c: [None] * len(shares) for c in columns}
    ranks = {c: [f(p) for p in own for f in (math.floor, math.ceil)] for c, own in places.items()}
    values = order_statistics(df, list(places), ranks, [counted[c][1:] for c in places])

    def between(c: str, p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        a, b = values[c, low], values[c, high]
        return a if low == high or a == b else (high - p) * a + (p - low) * b

    return {c: [between(c, p) for p in places[c]] if c in places else [None] * len(shares) for c in columns}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, columns, [0.5]).items()}
