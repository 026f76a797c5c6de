"""Error measures and robust-loss columns. Four published forms of SMAPE are kept apart; each is an aggregate column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """Numeric text as double; anything else, Not-a-Number too, as 0. Java's number suffixes don't count."""
    plain = c.cast("string").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, F.trim(c.cast("string")).try_cast("double")).otherwise(F.lit(0.0))


def smape_ratio(y: Column, p: Column) -> Column:
    """200 times the mean of |y - p| over |y| + |p| (0 where both are 0)."""
    s = F.abs(y) + F.abs(p)
    return F.avg(F.abs(y - p) / F.when(s == 0, 1.0).otherwise(s)) * 200


def smape_epsilon(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y) / ((F.abs(y) + F.abs(p)) / 2 + 1e-8)) * 100


def smape_rows(y: Column, p: Column) -> Column:
    """A row's error in percent; 0 where both are 0."""
    s = F.abs(y) + F.abs(p)
    return F.when(s == 0, 0.0).otherwise(F.abs(p - y) / (F.when(s == 0, 1.0).otherwise(s) / 2) * 100)


def smape_strict(y: Column, text: Column) -> Column:
    """Mean row error of predictions given as text; a row that can't be read counts 100."""
    p = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
    return F.avg(F.coalesce(smape_rows(y, p), F.lit(100.0)))


def smape_zeroed(y: Column, text: Column) -> Column:
    """The same, but what can't be read counts as a prediction of 0."""
    return F.avg(smape_rows(y, parse_number(text)))


def huber_gradient(r: Column, delta: Column) -> Column:
    return r / F.sqrt(1 + F.pow(r / delta, 2))


def huber_hessian(r: Column, delta: Column) -> Column:
    return 1 / F.pow(1 + F.pow(r / delta, 2), 1.5)


def iqr_delta(quartiles: list[float], scale: float = 1.0, least: float = 1e-6) -> float:
    """Robust width from the first and third quartile: their distance over 1.349, times scale, at least `least`."""
    low, high = quartiles
    return max(least, max(1e-6, high - low) / 1.349 * scale)
