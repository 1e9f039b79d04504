"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x, places: int = 0) -> Column:
    """Round half towards +infinity, the rule every score in the model uses."""
    f = float(10**places)
    v = F.floor(c(x) * F.lit(f) + F.lit(0.5)).cast("double")
    return v / F.lit(f) if places else v


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c(x)))


def cap(x, hi: float) -> Column:
    return F.least(c(x), F.lit(float(hi)))


def ratio(a, b, default: float = 0.0) -> Column:
    """a / b as double, `default` where b is zero or null."""
    return F.when(c(b) > 0, c(a).cast("double") / c(b)).otherwise(F.lit(float(default)))


def let(value, fn) -> Column:
    """Bind `value` once and use it many times inside `fn`.

    Without the binding the optimizer may copy an expensive expression into a lambda
    body, where it runs once per array element.
    """
    return F.element_at(F.transform(F.array(c(value)), fn), 1)


def ladder(x, steps, default) -> Column:
    """First matching lower bound wins: ladder(x, [(70, 'a'), (50, 'b')], 'c')."""
    expr = None
    for bound, label in steps:
        cond = c(x) >= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def cascade(cases, default=None) -> Column:
    """Ordered (condition, value) pairs; values may be columns or plain values."""
    expr = None
    for cond, val in cases:
        val = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    if default is None:
        return expr
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def local_day(epoch: Column, zone: str = "UTC") -> Column:
    """The calendar day (yyyy-MM-dd) of an instant in `zone`, whatever the session's time zone."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), epoch.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date").cast("string")
