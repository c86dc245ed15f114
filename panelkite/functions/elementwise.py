"""Operators on one row.

Missing is NULL.  NaN becomes NULL after each step that can make it, infinities
stay.  Comparisons with NULL are false, only "not equal" is true; a NULL
condition takes the first branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def known(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NaN and infinities to NULL, as rolling windows see them."""
    return F.when(~F.isnan(x) & ~x.isin(_INF, -_INF), x)


def number(x: Column) -> Column:
    return x.cast("double")


def rounded(x: Column, digits: int, signed: bool = False) -> Column:
    """To so many digits, halves away from zero: of the product x * 10**digits, as SQL engines do it.

    Spark's own round() goes through the shortest decimal text of x, which is
    slow and rounds some values the other way.  signed: zeros keep the sign of
    x, as they do in SQL.
    """
    scale = F.lit(10.0**digits)
    size = F.abs(x * scale)
    whole = F.rint(size)
    nearest = (whole + F.when(size - whole >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))) / scale
    if signed:
        # -0.0 isn't below 0.
        return F.when(size < _INF, F.when(x < 0, -nearest).when(x == 0, x).otherwise(nearest)).otherwise(x)
    # Infinite products leave x as it is; 0.0 is added against negative zeros.
    return F.when(size < _INF, F.when(x < 0, -nearest).otherwise(nearest) + F.lit(0.0)).otherwise(x)


def power(a: Column, b: Column) -> Column:
    return known(F.pow(number(a), number(b)))


def divide(a: Column, b: Column) -> Column:
    """x / 0 is infinite with the sign of x, 0 / 0 is missing; never an error."""
    a, b = number(a), number(b)
    at_zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF))
    return known(F.when(b == 0, at_zero).otherwise(F.try_divide(a, b)))


def add(a: Column, b: Column) -> Column:
    return known(number(a) + number(b))


def subtract(a: Column, b: Column) -> Column:
    return known(number(a) - number(b))


def multiply(a: Column, b: Column) -> Column:
    return known(number(a) * number(b))


def log(x: Column) -> Column:
    x = number(x)
    return F.when(x == 0, F.lit(-_INF)).when(x > 0, F.ln(x))


def sign(x: Column) -> Column:
    return F.signum(number(x))


def greater(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(number(a), number(b)))


def less(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(number(a), number(b)))


def compare(name: str, a: Column, b: Column) -> Column:
    if name == "Ne":
        return F.coalesce(a != b, F.lit(True))
    how = {"Gt": a > b, "Ge": a >= b, "Lt": a < b, "Le": a <= b, "Eq": a == b}[name]
    return F.coalesce(how, F.lit(False))


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def choose(condition: Column, a: Column, b: Column) -> Column:
    return F.when(F.coalesce(condition.cast("boolean"), F.lit(True)), a).otherwise(b)


def is_null(x: Column) -> Column:
    return x.isNull() | F.coalesce(F.isnan(number(x)), F.lit(False))


def is_inf(x: Column) -> Column:
    return F.coalesce(number(x).isin(_INF, -_INF), F.lit(False))
