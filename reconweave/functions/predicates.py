"""Tolerances, windows and scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconweave.config import Tolerance


def _lit(x: float) -> Column:
    return F.lit(x).cast("decimal(18,4)")


def gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def within(a: Column, b: Column, t: Tolerance) -> Column:
    """Inside the absolute tolerance, or the per cent of the larger amount."""
    return (gap(a, b) <= _lit(t.absolute)) | (gap(a, b) * 100 <= _lit(t.percent) * F.greatest(F.abs(a), F.abs(b)))


def within_of(a: Column, base: Column, t: Tolerance) -> Column:
    """As within(), but the per cent is that of `base` alone."""
    return (gap(a, base) <= _lit(t.absolute)) | ((base != 0) & (gap(a, base) * 100 <= _lit(t.percent) * F.abs(base)))


def is_rounding(a: Column, b: Column, t: Tolerance) -> Column:
    return (gap(a, b) > 0) & (gap(a, b) <= _lit(t.rounding))


def in_window(a: Column, b: Column, days: int) -> Column:
    """A missing date on either side counts as inside."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(True))


def proximity(a: Column, b: Column, t: Tolerance) -> Column:
    """1 for equal amounts, down to 0 at the tolerance."""
    room = F.greatest(F.lit(t.absolute), F.greatest(F.abs(a), F.abs(b)).cast("double") * (t.percent / 100))
    return F.greatest(F.lit(0.0), 1 - gap(a, b).cast("double") / room)


def score(points: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), points)), 2)


def band(points: Column, high: float, medium: float) -> Column:
    return F.when(points >= high, "High").when(points >= medium, "Medium").otherwise("Low")


def rates_differ(tax_a: Column, base_a: Column, tax_b: Column, base_b: Column, percent: float) -> Column:
    """Whether two implied tax rates are more than so many points apart; no rate without a base."""
    a, b, x, y = (F.abs(c.cast("double")) for c in (tax_a, tax_b, base_a, base_b))
    return (x > 0) & (y > 0) & (F.abs(a * y - b * x) * 100 > percent * x * y)
