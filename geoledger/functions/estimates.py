"""Arithmetic on estimates: structs of point, lower and upper."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PARTS = ("point", "lower", "upper")


def estimate(point, lower, upper) -> Column:
    """A struct of doubles from columns or numbers."""
    each = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(*(each(v).alias(n) for n, v in zip(_PARTS, (point, lower, upper), strict=True)))


def _each(e: Column, f) -> Column:
    return F.struct(*(f(e[n]).alias(n) for n in _PARTS))


def _value(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def plus(e: Column, x) -> Column:
    return _each(e, lambda v: v + _value(x))


def minus(e: Column, x) -> Column:
    return _each(e, lambda v: v - _value(x))


def times(e: Column, x) -> Column:
    """Each part times a number, which isn't negative where bounds are to stay bounds."""
    return _each(e, lambda v: v * _value(x))


def over(e: Column, x) -> Column:
    """Each part divided by a number; a zero divisor gives null."""
    return _each(e, lambda v: F.try_divide(v, _value(x)))


def under(x, e: Column, swap: bool = False) -> Column:
    """A number divided by each part; where a part is 0 it is infinite.

    The divided parts stay in their places, so ``lower`` has the larger quotient and ``upper`` the smaller one; with
    ``swap`` they change places and the bounds are true ones.
    """
    quotient = lambda v: F.when(v == 0, F.lit(float("inf"))).otherwise(F.try_divide(_value(x), v))
    low, high = ("upper", "lower") if swap else ("lower", "upper")
    return F.struct(quotient(e["point"]).alias("point"), quotient(e[low]).alias("lower"), quotient(e[high]).alias("upper"))


def share_of(x, rest: Column, swap: bool = True) -> Column:
    """x / (x + rest): how much of a whole is seen when ``rest`` estimates what isn't."""
    part = lambda v: F.try_divide(_value(x), _value(x) + v)
    low, high = ("upper", "lower") if swap else ("lower", "upper")
    return F.struct(part(rest["point"]).alias("point"), part(rest[low]).alias("lower"), part(rest[high]).alias("upper"))
